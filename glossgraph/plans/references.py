"""References to entities and identifiers: key spaces of their own, where just one answer is executable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossgraph.operators.selectors import SelectionError

#: Only this strength of an identity may be executed.
EXECUTABLE = "same-entity"


def resolve_reference(references: DataFrame, corpus: str, **key: str):
    """The one reference of a corpus with a key (any columns, null equal to null); none or several are refused."""
    condition = F.col("corpus") == corpus
    for column, value in key.items():
        condition = condition & F.col(column).eqNullSafe(F.lit(value))
    found = references.where(condition).limit(2).collect()
    if len(found) != 1:
        raise SelectionError("no_reference" if not found else "multiple_references", f"{corpus} {key}")
    return found[0]


def resolve_identities(references: DataFrame, by: list[str]) -> DataFrame:
    """For each key the only same-entity reference, with a status: resolved, none or several."""
    same = F.col("strength") == EXECUTABLE
    n = F.sum(same.cast("int"))
    status = F.when(n == 1, "resolved").when(n == 0, "no_reference").otherwise("multiple_references")
    return references.groupBy(*by).agg(status.alias("status"), F.when(n == 1, F.max(F.when(same, F.col("entity")))).alias("entity"))


def lexical_iri(base: str, revision: str, node, form=None):
    """IRI of an entry in one revision, or of one of its forms."""
    entry = F.concat(F.lit(f"{base}:{revision}:lex:"), node.cast("string"))
    return entry if form is None else F.concat(entry, F.lit(":form:"), F.sha2(form, 256).substr(1, 16))


def lexical_parts(iri):
    """Revision, node and form of an IRI; null where it isn't one."""
    part = lambda k: F.regexp_extract(iri, r"^.+:([^:]+):lex:([0-9]+)(?::form:([0-9a-f]{16}))?$", k)
    text = lambda c: F.when(c != "", c)
    return text(part(1)), text(part(2)).cast("long"), text(part(3))
