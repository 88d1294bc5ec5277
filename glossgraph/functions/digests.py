"""Canonical JSON and digests: of single documents on the driver, of columns of documents, of rows, and of ordered rows."""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.operators.ordering import places
from glossgraph.session import cut

SAFE = 2**53 - 1
DEEPEST = 128
PREFIX = "sha256:"


class DigestError(ValueError):
    """A value that canonical JSON doesn't have."""


def number_text(x: float) -> str:
    """A number as ECMAScript writes it."""
    if math.isnan(x) or math.isinf(x):
        raise DigestError("NaN and infinity have no JSON")
    if x == 0:
        return "0"
    digits, exponent = f"{abs(x):.17e}".split("e")
    for n in range(17):
        short = f"{abs(x):.{n}e}"
        if float(short) == abs(x):
            digits, exponent = short.split("e")
            break
    d, e = digits.replace(".", ""), int(exponent)
    if 0 <= e < 21:
        text = d.ljust(e + 1, "0") if len(d) <= e + 1 else f"{d[: e + 1]}.{d[e + 1 :]}"
    elif -7 < e < 0:
        text = "0." + "0" * (-e - 1) + d
    else:
        text = (d if len(d) == 1 else f"{d[0]}.{d[1:]}") + ("e+" if e > 0 else "e") + str(e)
    return ("-" if x < 0 else "") + text


def canonical_json(value: object, depth: int = 0) -> str:
    """RFC 8785: keys by UTF-16, ECMAScript numbers, no white space."""
    if depth > DEEPEST:
        raise DigestError("too deep")
    if value is None or isinstance(value, bool | str):
        if isinstance(value, str) and any(0xD800 <= ord(c) < 0xE000 for c in value):
            raise DigestError("lone surrogate")
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > SAFE:
            raise DigestError("integer beyond the safe range")
        return str(value)
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(canonical_json(x, depth + 1) for x in value) + "]"
    if isinstance(value, dict):
        if any(not isinstance(k, str) for k in value):
            raise DigestError("keys are strings")
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k], depth + 1)}" for k in keys) + "}"
    raise DigestError(f"{type(value).__name__} isn't JSON")


def digest(value: object) -> str:
    """Digest of a JSON value."""
    return PREFIX + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def normalize_text(raw: bytes) -> str:
    """Strict UTF-8 without its mark, with line feeds alone."""
    return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


def text_digest(text: Column) -> Column:
    """Digest of a text with line feeds alone."""
    return F.concat(F.lit(PREFIX), F.sha2(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n"), 256))


def row_digest(fields: dict[str, Column]) -> Column:
    """Digest of strings and integers as canonical JSON; nulls are written."""
    ordered = sorted(fields, key=lambda k: k.encode("utf-16-be"))
    return F.concat(F.lit(PREFIX), F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in ordered)), {"ignoreNullFields": "false"}), 256))


def bundle_digest(files: DataFrame, by: list[str], path: str, file_digest: str) -> DataFrame:
    """(by, digest): of each bundle's files (path and digest), in the order of their paths; a bundle is as long as its list."""
    entry = F.struct(F.col(path).alias("_path"), F.struct(F.col(file_digest).alias("file_sha256"), F.col(path).alias("logical_path")).alias("entry"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"])
    return files.groupBy(*by).agg(F.concat(F.lit(PREFIX), F.sha2(F.to_json(ordered), 256)).alias("digest"))


def binding_identity(node_type: Column, feature: Column, values: Column) -> Column:
    """Identity of a value set: its values' order makes no difference."""
    return row_digest({"node_type": node_type, "feature": feature, "values": F.array_sort(F.array_distinct(values))})


#: Fields of mappings that only audits read, at the top and below it, and lists whose order means nothing.
AUDIT_TOP = frozenset({"review", "mapping_semantic_digest", "rationale", "introduced_in", "changed_in"})
AUDIT_BELOW = frozenset({"review", "projection_semantic_digest"})
UNORDERED = frozenset({"native_dependencies", "profiles", "capabilities", "evidence", "projections", "ambiguous_candidates", "external_references", "losses", "values", "match_values"})


def semantic_content(value: object, field: str | None = None, dropped: frozenset[str] = AUDIT_BELOW) -> object:
    """A mapping's or projection's content that has meaning: without audit fields, unordered lists in canonical order."""
    if isinstance(value, dict):
        return {k: semantic_content(v, k) for k, v in value.items() if k not in dropped}
    if isinstance(value, list):
        items = [semantic_content(x) for x in value]
        return sorted(items, key=lambda x: canonical_json(x).encode()) if field in UNORDERED else items
    return value


def mapping_digest(mapping: dict) -> str:
    """Digest of a mapping's meaning."""
    return digest(semantic_content(mapping, dropped=AUDIT_TOP))


def projection_digest(projection: dict) -> str:
    """Digest of a projection's meaning."""
    return digest(semantic_content(projection))


def evidence_digest(record: dict) -> str:
    """Digest of an evidence record: what was reviewed and where it comes from."""
    named = ("evidence_id", "kind", "source_uri", "reviewed_content", "source_revision", "license_ref")
    if record.get("content_mode") != "normalized-record" or not set(named[:4]) <= record.keys():
        raise DigestError("an evidence record needs an id, a kind, a source and normalised content")
    return digest({k: record[k] for k in named if k in record})


def profile_digest(profile: dict) -> str:
    """Digest of a profile: its sets in canonical order, by their ids where they have any."""
    ids = {"dependencies": "dependency_id", "ontology_locks": "lock_id", "mappings": "mapping_id"}
    utf16 = lambda x: x.encode("utf-16-be")
    out = dict(profile)
    for name, key in ids.items():
        rows = profile.get(name, [])
        if len({r[key] for r in rows}) < len(rows):
            raise DigestError(f"{key} twice")
        out[name] = sorted(rows, key=lambda r, key=key: utf16(r[key]))
    out["semantic_domains"] = sorted(profile.get("semantic_domains", []), key=utf16)
    return digest(out)


def parent_manifest_digest(manifest: dict) -> str:
    """Digest of a manifest's components: locators and licences don't count."""
    named = ("component_id", "kind", "identity_algorithm", "content_digest")
    rows = [{k: c[k] for k in named} for c in manifest["components"]]
    if not rows or len({r["component_id"] for r in rows}) < len(rows):
        raise DigestError("components must be there, each once")
    return digest({"components": sorted(rows, key=lambda r: r["component_id"].encode("utf-16-be"))})


def fingerprint(algorithm: str, **fields: object) -> str:
    """Digest of a plan, release or state under the name of its algorithm, so that no two kinds ever agree."""
    return digest({"algorithm": algorithm, **fields})


def payload_digest(files: DataFrame) -> DataFrame:
    """(digest): of a folder's files (file, sha256), in the order of their names."""
    named = files.select(F.lit(0).alias("_all"), F.regexp_extract("file", r"([^/]+)$", 1).alias("path"), F.concat(F.lit(PREFIX), "sha256").alias("digest"))
    return bundle_digest(named, ["_all"], "path", "digest").drop("_all")


def evidence_set(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, digest): of the rows of each key, whatever their order; rows are summed up before any shuffle.

    Two sums of 64-bit hashes stand for a set, as lists of all edges would have to be brought together.
    """
    others = [c for c in rows.columns if c not in by]
    wide = lambda salt: F.sum(F.xxhash64(F.lit(salt), *others).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.concat(F.lit(PREFIX), F.sha2(F.concat_ws(":", F.count("*").cast("string"), wide(0), wide(1)), 256)).alias("digest"))


# On tables

#: What a JSON document is digested as.
KINDS = {"mapping": mapping_digest, "projection": projection_digest, "profile": profile_digest, "manifest": parent_manifest_digest, "evidence": evidence_digest, "json": digest}


def document_digest(document: Column, kind: str) -> Column:
    """A struct (digest, problem) of a column of JSON texts: the digest of what each means as a document of a kind.

    Keys are ordered by UTF-16 at any depth, unordered lists by their items' canonical bytes, audit fields don't count.
    What isn't strict JSON, or isn't such a document, has a problem and no digest; null has neither.
    """
    from glossgraph.sources.strict_json import SourceError, loads

    of_kind = KINDS[kind]

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return of_kind(loads(text.encode())), None
        except SourceError:
            return None, "not_json"
        except (DigestError, KeyError, TypeError, AttributeError):
            return None, "not_" + kind

    def of(texts: pa.Array) -> pa.Array:
        both = list(map(one, texts.to_pylist()))
        return pa.StructArray.from_arrays([pa.array([x[k] for x in both], pa.string()) for k in range(2)], ["digest", "problem"])

    return F.arrow_udf(of, "struct<digest:string,problem:string>")(document)


def row_fingerprint(algorithm: str, fields: dict[str, Column]) -> Column:
    """fingerprint() of flat rows: digests under the name of their algorithm."""
    return row_digest({"algorithm": F.lit(algorithm), **fields})


#: Digests that one digest of the level above is made from.
FANOUT = 1024


def ordered_digest(rows: DataFrame, by: list[str], order: list[str], fanout: int = FANOUT) -> DataFrame:
    """(by, n, root): a digest of each key's rows in their order, by a tree of digests, so no task gathers a key's rows.

    A leaf is the digest of a row's columns as canonical JSON; each `fanout` neighbours are digested into one, level by
    level, at least once and until one is left. How the rows are dealt to partitions makes no difference; two rows that
    change places do.
    """
    columns = {c: F.col(c) for c in rows.columns if c not in by}
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    level = places(rows, by, order).select(*by, "at", row_digest(columns).alias("digest")).join(sizes, by).withColumn("left", F.col("n"))
    roots, left = None, most
    while roots is None or left > 1:
        grouped = level.groupBy(*by, F.floor(F.col("at") / fanout).alias("at")).agg(
            F.first("n").alias("n"), F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct(F.col("at").alias("place"), "digest"))).alias("parts")
        )
        joined = F.array_join(F.transform("parts", lambda x: x["digest"]), ",")
        level = cut(grouped.select(*by, "at", F.concat(F.lit(PREFIX), F.sha2(joined, 256)).alias("digest"), "n", F.ceil(F.col("left") / fanout).alias("left")))
        done = level.where("left = 1").select(*by, "n", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        level, left = level.where("left > 1"), -(-left // fanout)
    return roots


def walk_digest(plans: DataFrame, starts: DataFrame, layers: DataFrame, finals: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(plan, digest): of a walk's evidence. Binds plan and binding identity, start nodes, each layer's edges and the final
    nodes, all in their order.

    `plans` has (plan, fingerprint, binding), `starts` and `finals` (plan, ord, node), `layers` (plan, step, ord, src, dst,
    value_present, value). A layer without edges is the same as none; steps are few, so a plan's roots are one row.
    """
    ends = lambda rows: ordered_digest(rows.select("plan", "ord", "node"), ["plan"], ["ord", "node"], fanout)
    edges = ordered_digest(layers, ["plan", "step"], ["ord", "src", "dst"], fanout)
    steps = F.transform(F.array_sort(F.collect_list(F.struct("step", "root"))), lambda x: F.concat_ws(":", x["step"], x["root"]))
    of_layers = edges.groupBy("plan").agg(F.array_join(steps, ",").alias("layers"))
    joined = plans.join(ends(starts).select("plan", F.col("root").alias("start")), "plan", "left").join(of_layers, "plan", "left").join(ends(finals).select("plan", F.col("root").alias("final")), "plan", "left")
    fields = {"plan": F.col("fingerprint"), "binding": F.col("binding"), "start": F.col("start"), "layers": F.coalesce("layers", F.lit("")), "final": F.col("final")}
    return joined.select("plan", row_fingerprint("walk-evidence/1", fields).alias("digest"))
