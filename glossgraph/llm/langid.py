"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined by Bayes' rule: the likelihood of the text under byte-trigram models, the
language that the markup declares, the suffix of the address, and the languages seen on the same host. Host
priors are smoothed along a hierarchy: a host leans on its domain, the domain on its suffix, the suffix on the
whole table. They come from grouped sums of what the texts alone suggest, and a row's own text is taken out of
its host's sums, so that it isn't counted twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.llm.common import cut, small_batches

BUCKETS = 1 << 14
#: Labelled documents that the trigram models are counted on, at most, chosen by a hash of their id.
SAMPLE = 6000
#: Trigrams of a text depend on each other: this many count at most as independent evidence.
EVIDENCE = 60.0
#: Rows that a level of the hierarchy counts as, when it smooths the level below.
STRENGTH = 8.0
#: How often a declared language is right, before anything is counted.
DECLARED_RIGHT = 0.9
DECLARED_WEIGHT = 20.0
KEEP = 0.5
#: Rows of an Arrow batch, whose trigrams are looked up together.
ROWS = 200


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and for each trigram bucket the log probability under each of them."""

    languages: tuple[str, ...]
    table: np.ndarray

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text and language, the tempered log likelihood; texts of fewer than three bytes have none."""
        raws = [(x or "").lower().encode() for x in texts]
        sizes = np.array([max(len(r) - 2, 0) for r in raws], dtype=np.int64)
        out = np.zeros((len(raws), len(self.languages)))
        full = np.nonzero(sizes)[0]
        if len(full):
            codes = np.concatenate([trigrams(raws[k]) for k in full.tolist()])
            starts = np.cumsum(sizes[full]) - sizes[full]
            n = sizes[full].astype(float)
            weight = 1 / (1 + n / EVIDENCE)
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(self.table[k][codes].astype(np.float64), starts) * weight
        return out


def trigrams(raw: bytes) -> np.ndarray:
    """Bucket numbers of a text's byte trigrams."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(18)).astype(np.int32)


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Count trigrams of at most `sample` documents (doc_id, text, lang), in Spark; null languages are left out.

    The driver gets one row for each language and bucket. Without labelled documents there are no languages.
    """
    small_batches(docs.sparkSession, ROWS)
    chosen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.select(F.col("doc_id").alias("chosen"), F.col("lang").alias("language"))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))  # at most `sample` short rows

    def count(batches):
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for text, language in zip(batch["text"].to_pylist(), batch["language"].to_pylist(), strict=True):
                raw = (text or "").lower().encode()
                if len(raw) > 2:
                    at = counts.setdefault(language, np.zeros(BUCKETS, dtype=np.int64))
                    at += np.bincount(trigrams(raw), minlength=BUCKETS)
            rows = [(k, int(i), int(v[i])) for k, v in counts.items() for i in np.nonzero(v)[0]]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["language", "bucket", "n"])

    sums = joined.select("text", "language").mapInArrow(count, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted({r.language for r in sums}))
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in sums:
        table[languages.index(r.language), r.bucket] += r.n
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (its last label) of an address; null without a host."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    labels = F.split(host, r"\.")
    return host, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.element_at(labels, -1)


def declared(html: Column) -> Column:
    """The two-letter language of the html element; null where none is declared."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Markup, scripts and styles out; entities stay as they are."""
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")


def _sum_arrays(name: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(name)[k]) for k in range(n)))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return F.transform(F.array(F.transform(scores, lambda x: F.exp(x - top))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def identify(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """Fuse the evidence for rows (any columns with text, declared, host, domain, suffix; all may be null).

    Returns the rows without their text, with text_lang (by the text alone), lang, p (its posterior) and kept
    (p is at least KEEP); input columns of these four names are replaced, all others stay, and repeated rows come back as
    they are. Texts are read whole; of languages that are equally likely the first by name is taken. Rows without any
    evidence get the table's commonest language. Every level of the
    hierarchy is a grouped sum with as many rows as it has keys; a key with a large part of the rows is summed
    up before the shuffle, and its rows are joined by plain equality, so that Spark can split them.
    """
    small_batches(rows.sparkSession, ROWS)
    languages, n = list(model.languages), len(model.languages)
    if not n:
        return rows.drop("text").withColumns({"text_lang": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "p": F.lit(0.0), "kept": F.lit(False)})
    evidence = F.arrow_udf(lambda texts: pa.array(list(model.evidence(texts.to_pylist())), pa.list_(pa.float64())), "array<double>").asNondeterministic()
    key = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-"))
    scored = rows.withColumn("_ll", evidence(F.col("text"))).drop("text")
    scored = scored.withColumns({f"_{c}": key(c) for c in ("host", "domain", "suffix")})
    scored = cut(scored.withColumn("_own", _softmax(F.col("_ll"))))
    order = F.array(*map(F.lit, languages))

    by_host = scored.groupBy("_suffix", "_domain", "_host").agg(_sum_arrays("_own", n).alias("_in_host"), F.count("*").alias("_n_host"))
    by_domain = by_host.groupBy("_suffix", "_domain").agg(_sum_arrays("_in_host", n).alias("_in_domain"), F.sum("_n_host").alias("_n_domain"))
    by_suffix = by_domain.groupBy("_suffix").agg(_sum_arrays("_in_domain", n).alias("_in_suffix"), F.sum("_n_domain").alias("_n_suffix"))
    total = by_suffix.agg(_sum_arrays("_in_suffix", n).alias("s"), F.sum("_n_suffix").alias("n")).first()
    base = [((total.s[k] or 0.0) + 1 / n) / ((total.n or 0) + 1) for k in range(n)] if total.n else [1 / n] * n

    def smoothed(counts: str, size: str, parent: Column) -> Column:
        return F.transform(F.col(counts), lambda x, i: (x + STRENGTH * F.get(parent, i)) / (F.col(size) + STRENGTH))

    above = by_domain.join(by_suffix, "_suffix").withColumn("_up", smoothed("_in_suffix", "_n_suffix", F.array(*map(F.lit, base))))
    above = above.withColumn("_up", smoothed("_in_domain", "_n_domain", F.col("_up"))).select("_suffix", "_domain", "_up")
    hosts = by_host.join(above, ["_suffix", "_domain"]).select("_host", "_in_host", "_n_host", "_up")

    # how often each language is declared for texts that look like each: at most languages by declarations
    pairs = scored.where(F.col("declared").isin(languages)).groupBy("declared").agg(_sum_arrays("_own", n).alias("own")).collect()
    seen = {r.declared: r.own for r in pairs}
    said = np.array([[seen.get(d, [0.0] * n)[k] + DECLARED_WEIGHT * (DECLARED_RIGHT if d == languages[k] else (1 - DECLARED_RIGHT) / max(n - 1, 1)) for k in range(n)] for d in languages])
    said = np.log(said / said.sum(axis=0, keepdims=True))  # P(declared | language)
    by_declared = F.coalesce(*(F.when(F.col("declared") == d, F.array(*(F.lit(float(x)) for x in said[j]))) for j, d in enumerate(languages)), F.array(*[F.lit(0.0)] * n))

    fused = scored.join(hosts, "_host").withColumns(
        {"_said": by_declared, "_prior": F.transform(F.col("_in_host"), lambda x, i: (F.greatest(x - F.get("_own", i), F.lit(0.0)) + STRENGTH * F.get("_up", i)) / (F.col("_n_host") - 1 + STRENGTH))}
    )
    scores = F.transform(F.col("_ll"), lambda x, i: x + F.get("_said", i) + F.log(F.greatest(F.get("_prior", i), F.lit(1e-9))))
    fused = fused.withColumn("_post", _softmax(scores))
    best = lambda c: F.array_position(F.col(c), F.array_max(F.col(c))).cast("int")
    return fused.withColumns(
        {"text_lang": F.element_at(order, best("_own")), "lang": F.element_at(order, best("_post")), "p": F.array_max("_post"), "kept": F.array_max("_post") >= KEEP}
    ).drop("_ll", "_own", "_host", "_domain", "_suffix", "_in_host", "_n_host", "_up", "_said", "_prior", "_post")
