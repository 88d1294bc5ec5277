"""Bundles that Spark derives from the given tables: mappings, projections, references, releases and their states.

Each table is one SQL text over the given tables. Spark and the tests' SQL engine read the same text, so what is
tested is what operators do with the rows. All tables grow with the given ones.

* mappings: one native selector of a corpus with its review; parts and suppliers are two corpora.
* native_values: values of parts' selectors, where one that isn't there differs from one that is null (value_present).
* projections: reviewed or unreviewed links of mappings to targets, three parts to a target.
* external_refs: what customers are called elsewhere.
* selectors, selector_values, selector_steps: what the parts' mappings select in the commerce graph, in all shapes.
* dependencies: what a mapping needs of its corpus; locks: the targets that an ontology has.
* variants, states: releases of small corpora (one for each supplier), and what was found of them at run time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Name: SQL that Spark and DuckDB both read; given tables are in braces.
TABLES = {
    "mappings": """
        SELECT 'parts' AS corpus, concat('p', p_partkey) AS mapping_id, 'part' AS node_type, 'label' AS feature, concat(p_name, '#', CAST(floor(p_partkey / 2) AS BIGINT)) AS value,
          CASE p_partkey % 10 WHEN 7 THEN 'native-only' WHEN 8 THEN 'ambiguous' WHEN 9 THEN 'unsupported' ELSE 'positive' END AS native_state,
          'lexicon' AS profile, CASE WHEN p_partkey % 31 = 0 THEN 'other.entry' ELSE 'lexicon.entry' END AS capability, p_size % 7 <> 0 AS reviewed,
          CASE p_partkey % 4 WHEN 0 THEN 'membership' WHEN 1 THEN 'edge-path' WHEN 2 THEN 'value-set-predicate' ELSE 'value-predicate' END AS shape
        FROM {part}
        UNION ALL
        SELECT 'suppliers', concat('s', s_suppkey), 'supplier', 's_nationkey', CAST(s_nationkey AS STRING), CASE WHEN s_suppkey % 6 = 5 THEN 'native-only' ELSE 'positive' END,
          'lexicon', 'lexicon.entry', s_suppkey % 5 <> 0, 'value-predicate'
        FROM {supplier}""",
    "native_values": """
        SELECT 'parts' AS corpus, concat('p', p_partkey) AS mapping_id, p_partkey % 4 > 1 OR p_partkey % 37 = 5 AS value_present, CASE WHEN p_partkey % 37 <> 5 THEN p_name END AS value
        FROM {part} WHERE p_size % 7 <> 0""",
    "projections": """
        SELECT 'parts' AS corpus, concat('pp', p_partkey) AS projection_id, concat('p', p_partkey) AS mapping_id,
          CASE WHEN p_partkey % 5 = 4 THEN 'authority-value' ELSE 'semantic-pivot' END AS reference_kind,
          CASE WHEN p_partkey % 5 = 4 AND p_partkey % 3 <> 0 THEN 'authority-value-filter' ELSE 'semantic-constraint' END AS query_role,
          'lexicon' AS profile, CASE WHEN p_partkey % 31 = 0 THEN 'other.entry' ELSE 'lexicon.entry' END AS capability,
          concat('urn:entry:', CAST(floor(p_partkey / 3) AS BIGINT)) AS target,
          CASE WHEN p_partkey % 97 = 0 THEN 'property' ELSE 'class' END AS formal_kind, 'annotation-value' AS semantic_role,
          CASE p_size % 6 WHEN 1 THEN 'close' WHEN 2 THEN 'broader' WHEN 3 THEN 'narrower' WHEN 4 THEN 'related' ELSE 'exact' END AS assessment,
          p_size % 4 <> 0 AS eligible,
          CASE WHEN p_size % 6 = 1 THEN 'overcoverage+undercoverage' WHEN p_size % 6 = 2 THEN 'undercoverage' WHEN p_size % 6 = 3 AND p_size % 5 <> 0 THEN 'overcoverage' ELSE '' END AS losses,
          concat('lock', p_size % 3) AS lock_id, p_partkey % 13 <> 0 AS reviewed,
          CASE p_size % 5 WHEN 0 THEN 'http://www.w3.org/2002/07/owl#equivalentClass' WHEN 1 THEN 'http://www.w3.org/2004/02/skos/core#exactMatch' END AS publication_relation
        FROM {part} WHERE p_partkey % 10 < 7 OR p_partkey % 70 = 9
        UNION ALL
        SELECT 'suppliers', concat('sp', s_suppkey), concat('s', s_suppkey), 'semantic-pivot', 'semantic-constraint', 'lexicon', 'lexicon.entry',
          concat('urn:entry:', s_suppkey), 'class', 'annotation-value', 'exact', false, '', 'lock0', s_suppkey % 13 <> 1, NULL
        FROM {supplier} WHERE s_suppkey % 6 <> 5""",
    "external_refs": """
        SELECT 'customers' AS corpus, concat('r', c_custkey) AS reference_id, concat('c', c_custkey) AS mapping_id,
          CASE c_custkey % 6 WHEN 3 THEN 'catalogue-identifier' WHEN 4 THEN 'provenance-source' WHEN 5 THEN 'locator' ELSE 'entity-identity' END AS reference_kind,
          CASE WHEN c_custkey % 23 = 0 THEN 'metadata-filter' WHEN c_custkey % 6 = 3 THEN 'identifier-filter' WHEN c_custkey % 6 = 4 THEN 'metadata-filter' WHEN c_custkey % 6 = 5 THEN 'explanation-only' ELSE 'identity-filter' END AS query_role,
          CASE WHEN c_custkey % 17 <> 0 THEN 'registry' END AS authority_system, concat('urn:person:', CAST(floor(c_custkey / 4) AS BIGINT)) AS external,
          CASE c_nationkey % 4 WHEN 0 THEN 'same-entity' WHEN 1 THEN 'probable-same-entity' WHEN 2 THEN 'related-record' ELSE 'ambiguous-identity' END AS identity_strength,
          CASE WHEN c_custkey % 19 <> 0 THEN 'ledger' END AS issuer, c_custkey % 9 <> 0 AS reviewed, CASE WHEN c_custkey % 8 <> 7 THEN c_mktsegment END AS native_value,
          CASE WHEN c_custkey % 12 = 0 THEN 'http://www.w3.org/2002/07/owl#sameAs' END AS publication_relation
        FROM {customer}""",
    "dependencies": """
        SELECT 'parts' AS corpus, concat('p', p_partkey) AS mapping_id, 'node-type-present' AS kind, CASE WHEN p_partkey % 12 = 0 THEN 'order' ELSE 'part' END AS node_type,
          CAST(NULL AS STRING) AS feature, CAST(NULL AS STRING) AS value FROM {part} WHERE p_partkey % 4 < 2
        UNION ALL
        SELECT 'parts', concat('p', p_partkey), 'path-present', 'part', 'part_supplier', NULL FROM {part} WHERE p_partkey % 4 = 1 AND p_partkey % 9 <> 0
        UNION ALL
        SELECT 'parts', concat('p', p_partkey), 'native-value-present', 'part', 'label', CASE WHEN p_partkey % 14 = 2 THEN 'else' ELSE concat(p_name, '#', CAST(floor(p_partkey / 2) AS BIGINT)) END FROM {part} WHERE p_partkey % 4 = 2""",
    "locks": """
        SELECT DISTINCT concat('lock', p_size % 3) AS lock_id, concat('urn:entry:', CAST(floor(p_partkey / 3) AS BIGINT)) AS term, concat('d', p_size % 3) AS content_digest
        FROM {part} WHERE p_partkey % 41 <> 0""",
    "selectors": """
        SELECT 'commerce' AS corpus, concat('p', p_partkey) AS mapping_id, CASE WHEN p_partkey % 101 = 50 THEN 'closure' WHEN p_partkey % 4 = 0 THEN 'membership' WHEN p_partkey % 4 = 1 THEN 'edge-path' WHEN p_partkey % 4 = 2 THEN 'value-set-predicate' ELSE 'value-predicate' END AS shape,
          CASE WHEN p_partkey % 4 > 1 THEN 'part' WHEN p_partkey % 60 = 0 THEN 'warehouse' WHEN p_size % 4 = 1 THEN 'supplier' WHEN p_size % 4 = 2 THEN 'nation' ELSE 'order' END AS node_type,
          CASE WHEN p_partkey % 4 = 2 THEN CASE WHEN p_partkey % 30 = 2 THEN 'p_colour' ELSE 'p_brand' END WHEN p_partkey % 4 = 3 THEN CASE WHEN p_size % 2 = 0 THEN 'p_size' ELSE 'p_type' END END AS feature
        FROM {part}""",
    "selector_values": """
        SELECT 'commerce' AS corpus, concat('p', p_partkey) AS mapping_id, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) ELSE p_type END AS value, CASE WHEN p_size % 2 = 0 AND p_partkey % 15 <> 3 THEN 'int' ELSE 'str' END AS value_type
        FROM {part} WHERE p_partkey % 4 = 3
        UNION ALL
        SELECT 'commerce', concat('p', p_partkey), p_brand, 'str' FROM {part} WHERE p_partkey % 4 = 2
        UNION ALL
        SELECT 'commerce', concat('p', p_partkey), concat('Brand#', p_partkey % 25), 'str' FROM {part} WHERE p_partkey % 4 = 2""",
    "selector_steps": """
        SELECT 'commerce' AS corpus, concat('p', p_partkey) AS mapping_id, 0 AS step,
          CASE WHEN p_partkey % 44 = 1 THEN 'order_parts' WHEN p_size % 4 = 0 THEN 'order_customer' WHEN p_size % 4 = 1 THEN 'supplier_nation' WHEN p_size % 4 = 2 THEN 'customer_nation' ELSE 'order_part_flag' END AS edge,
          CASE WHEN p_size % 4 = 2 THEN 'incoming' ELSE 'outgoing' END AS direction,
          CASE WHEN p_size % 4 = 0 THEN 'customer' WHEN p_size % 4 = 1 THEN 'nation' WHEN p_size % 4 = 2 THEN 'customer' ELSE 'part' END AS result_type,
          CASE WHEN p_size % 4 = 3 THEN CASE WHEN p_partkey % 8 = 1 THEN 'R' ELSE 'A+R' END WHEN p_partkey % 36 = 5 THEN 'x' END AS match_values
        FROM {part} WHERE p_partkey % 4 = 1
        UNION ALL
        SELECT 'commerce', concat('p', p_partkey), 1, CASE WHEN p_size % 4 = 2 THEN 'order_customer' ELSE 'customer_nation' END, CASE WHEN p_size % 4 = 0 THEN 'outgoing' ELSE 'incoming' END,
          CASE WHEN p_size % 4 = 0 THEN 'nation' WHEN p_size % 4 = 1 THEN 'customer' ELSE 'order' END, NULL
        FROM {part} WHERE p_partkey % 4 = 1 AND p_size % 4 < 3""",
    "variants": """
        SELECT concat('corpus', s_suppkey) AS corpus, concat('1.', s_nationkey) AS release, concat('f', s_suppkey % 7) AS fingerprint, concat('d', s_nationkey) AS parent_digest,
          CASE WHEN s_suppkey % 3 = 0 THEN 'identity-only' ELSE 'dependency-verified' END AS parent_compatibility, CASE WHEN s_suppkey % 4 <> 0 THEN concat('b', s_nationkey) END AS bundle_digest
        FROM {supplier}
        UNION ALL
        SELECT concat('corpus', s_suppkey), concat('1.', s_nationkey), CASE WHEN s_suppkey % 4 = 3 THEN 'other' ELSE concat('f', s_suppkey % 7) END, concat('d', s_nationkey),
          CASE WHEN s_suppkey % 3 = 0 THEN 'identity-only' ELSE 'dependency-verified' END, CASE WHEN s_suppkey % 4 <> 0 THEN concat('b', s_nationkey) END
        FROM {supplier} WHERE s_suppkey % 5 = 3""",
    "states": """
        SELECT concat('corpus', v.s_suppkey) AS corpus, concat('1.', v.s_nationkey) AS release,
          CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE concat('f', v.s_suppkey % 7) END AS fingerprint,
          CASE WHEN c_nationkey < 12 THEN 'verified-exact' WHEN c_nationkey < 18 THEN 'verified-compatible' WHEN c_nationkey < 20 THEN 'unverified' WHEN c_nationkey < 22 THEN 'incompatible' ELSE 'odd' END AS parent_state,
          CASE WHEN c_nationkey < 10 THEN concat('d', v.s_nationkey) ELSE 'other' END AS observed_parent_digest,
          c_custkey % 8 <> 3 AS dependencies_pass, c_custkey % 14 <> 5 AS dependencies_complete,
          CASE WHEN v.s_suppkey % 4 = 0 THEN 'not-required' WHEN c_custkey % 11 = 0 THEN 'unavailable' ELSE 'verified' END AS bundle_state,
          CASE WHEN v.s_suppkey % 4 <> 0 AND c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 13 = 0 THEN 'b' ELSE concat('b', v.s_nationkey) END END AS active_bundle_digest
        FROM {customer} JOIN {supplier} v ON v.s_suppkey = CAST(floor(c_custkey / 15) AS BIGINT) WHERE c_custkey % 15 < 1 + v.s_suppkey % 2""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table by its name."""
    given = set(re.findall(r"\{(\w+)\}", TABLES[name]))
    return spark.sql(TABLES[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in given})


def with_tables(*names: str) -> str:
    """The same tables as the beginning of an SQL text."""
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({re.sub(r'[{}]', '', TABLES[n])})" for n in names)
