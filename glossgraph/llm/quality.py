"""Quality rules as a bitmask ledger.

Each rule is evaluated once for each document. The ledger keeps the measurements and one bit for each
failed rule; a policy is a versioned mask over those bits, so judging by another policy, or asking what a
rule costs, is bitwise arithmetic on the ledger and never reads a text again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossgraph.llm.common import small_batches

#: Words in the windows that may be found twice.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
SPACES = " \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_marks")

#: Bit: name and condition over the measurements (m: field name to column), in the order of the bits.
RULES = (
    ("too_few_words", lambda m: m("n_words") < 20),
    ("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    ("symbols", lambda m: 100 * m("n_symbols") > 25 * m("n_words")),
    ("duplicate_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    ("upper_case", lambda m: 100 * m("n_upper") > 60 * m("word_chars")),
    ("exclamations", lambda m: 100 * m("n_marks") > 40 * m("n_words")),
    ("long_words", lambda m: m("word_chars") > 25 * m("n_words")),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Version: the bits that reject a document.
POLICIES = {
    1: BASE,
    2: BASE | BIT["symbols"] | BIT["duplicate_lines"],
    3: (1 << len(RULES)) - 1,
}
LATEST = max(POLICIES)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words which occurs at least twice in the list."""
    n = len(words)
    if n <= width:
        return 0
    hashed = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    m = n - width + 1
    rolling = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + m]
    ordered = np.sort(rolling)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.nonzero(np.isin(rolling, twice))[0]
    exact: dict[tuple, list[int]] = {}
    for i in starts.tolist():  # equal hashes are confirmed on the words themselves
        exact.setdefault(tuple(words[i : i + width]), []).append(i)
    edges = np.zeros(n + 1, dtype=np.int64)
    for found in exact.values():
        if len(found) > 1:
            edges[found] += 1
            edges[np.array(found) + width] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_words(words),
        len(raw) - len(raw.translate(None, UPPER)),
        text.count("!"),
    )


def _measured(texts: pa.Array) -> pa.Array:
    columns = list(zip(*map(measure, texts.to_pylist()), strict=True)) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)


def ledger(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """Add a struct column: the measurements, and `fail_bits` with one bit for each failed rule.

    Null and empty texts measure 0 throughout and fail too_few_words. Repeated rows get equal ledgers.
    Input columns stay as they are; a column that has the name of `into` is replaced.
    """
    small_batches(docs.sparkSession)
    # asNondeterministic keeps the optimizer from copying the measuring into each reference: each rule is evaluated once.
    measuring = F.arrow_udf(_measured, f"struct<{','.join(f'{x}:long' for x in MEASURES)}>").asNondeterministic()
    measured = docs.withColumn(into, measuring(F.col(text)))
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        failed = fails(lambda field: F.col(into).getField(field))
        bits = bits.bitwiseOR(F.when(failed, F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn(into, F.col(into).withField("fail_bits", bits))


def judge(ledgered: DataFrame, version: int = LATEST, ledger: str = "ledger", into: str = "kept") -> DataFrame:
    """Apply one policy version to a ledger: true where none of its bits is set."""
    return ledgered.withColumn(into, F.col(f"{ledger}.fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablations(ledgered: DataFrame, ledger: str = "ledger") -> DataFrame:
    """For each policy version and rule in it: documents rejected, failing the rule, and rejected by it alone.

    The documents are first counted by their bits (128 combinations at most); all else works on these counts.
    """
    by_bits = ledgered.groupBy(F.col(f"{ledger}.fail_bits").alias("bits")).agg(F.count("*").alias("n"))
    rules = [(v, mask, name, BIT[name]) for v, mask in POLICIES.items() for name, _ in RULES if mask & BIT[name]]
    each = [F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for v, m, n, b in rules]
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    return (
        by_bits.select("bits", "n", F.inline(F.array(*each)))
        .groupBy("version", "rule")
        .agg(
            F.sum("n").alias("documents"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_by_it_alone"),
        )
    )
