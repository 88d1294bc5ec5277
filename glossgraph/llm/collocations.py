"""Collocations: phrases of two to four words, mined by dynamic itemset counting.

Texts are cut into pieces at punctuation and pieces into words. Each language's words are numbered page by page (a page
is about PAGE_BYTES of text with its own dictionary), and pages are dealt to a few shards. Counting goes round and round
over the shards. Words are counted from the first step on. A longer phrase is activated as soon as both phrases that
leave out its last or its first word have reached the threshold: from the next step on it is counted wherever it
occurs, while shorter phrases are still being counted in the same scans. It stays for one full cycle, so that it has
seen each shard once, whatever shard it began with. The scans end when no phrase is active.

In these scans a phrase is known by a hash of KEY_BITS bits. Each task sums up its phrases and sends them to buckets of hashes,
where they are added to the phrases that are still being counted; a bucket has a bounded number of them, and phrases that
completed their cycle leave. Those that reached the threshold in a step become a Bloom filter of at most FILTER_BITS
bits, by which later scans know what to activate. Hashes that collide and filters that are full only make for more
candidates: no count is ever too low. One more scan counts the candidates by their words, so the results are exact.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossgraph.llm.common import checkpoint_dir, cut

LEAST = 30
LONGEST = 4
TOP = 2000
SHARDS = 2
#: A phrase gives way to a longer one that has at least this many hundredths of its occurrences.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
PAGE_BYTES = 1 << 20
#: Phrases that a task sums up at once, and words of the corpus for each bucket of phrases.
BATCH = 1 << 21
BUCKET_WORDS = 1 << 21
FILTER_BITS = 27
PROBES = 3
#: Bits of a hash that count, and bytes of a key in sums: the bits below.
KEY_BITS = 48
_KEY_BYTES = 6
_MOST = 2**31 - 1
#: Phrases that a task of the last scans holds at once.
SPELLED = 1 << 20
#: Parts into which the phrases of one language are dealt to be ranked.
RANK_PARTS = 64
#: Everything that ends a piece becomes a full stop, a tab becomes a space, A-Z become a-z.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"." * len(_ENDS) + b" ")
_PAGE = "shard int, lang string, n_words long, words array<binary>, codes binary"
_SUMS = "k int, bucket long, old boolean, keys binary, counts binary, starts binary"
_STATE = "k int, bucket long, keys binary, counts binary, starts binary, reached binary"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _page(shard: int, lang: str, texts: list[bytes]) -> dict:
    """Words of texts as numbers of the page's dictionary; 0 stands between pieces."""
    words = b". ".join([b"", *texts, b""]).translate(_TABLE).replace(b".", b" . ").split()
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    return {"shard": shard, "lang": lang, "n_words": int(np.count_nonzero(codes)), "words": coded.dictionary, "codes": codes.astype(np.int32).tobytes()}


def pages(docs: DataFrame, text: str, lang: str, shards: int) -> DataFrame:
    """Rows of pages: shard, language, number of words, dictionary (separator first) and codes."""

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        words = pa.concat_arrays([r["words"] for r in rows])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r["words"]) for r in rows)]), pa.int32()), words)
        return pa.record_batch(
            [pa.array([r["shard"] for r in rows], pa.int32()), pa.array([r["lang"] for r in rows]), pa.array([r["n_words"] for r in rows], pa.int64()), lists, pa.array([r["codes"] for r in rows], pa.binary())],
            ["shard", "lang", "n_words", "words", "codes"],
        )

    def cut_up(batches):
        held: dict[str, list[bytes]] = {}
        size = made = 0

        def flush():
            nonlocal size, made
            for name in sorted(held):
                made += 1
                # a hash of the page's beginning deals pages alike in every run
                yield batch_of([_page((xxhash.xxh32_intdigest(held[name][0][:64]) + made) % shards, name, held[name])])
            held.clear()
            size = 0

        for batch in batches:
            for name, x in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = x.encode()
                held.setdefault(name, []).append(raw)
                size += len(raw)
                if size >= PAGE_BYTES:
                    yield from flush()
        yield from flush()

    named = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return named.mapInArrow(cut_up, _PAGE)


@dataclass(frozen=True)
class Filter:
    """A Bloom filter of 2^log bits over phrase hashes."""

    log: int
    bits: np.ndarray

    @staticmethod
    def places(hashes: np.ndarray, log: int) -> list[np.ndarray]:
        return [(_key(hashes) * np.uint64(odd)) >> np.uint64(64 - log) for odd in _ODD[:PROBES]]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for place in self.places(hashes, self.log):
            found &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


#: For each length the filters of phrases that reached the threshold, by step.
Filters = dict[int, dict[int, Filter]]


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """A hash of each word (none is empty) and its language: its bytes as digits of a number, mixed."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    digits = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=1)), _ODD[2], dtype=np.uint64))
    numbers = np.add.reduceat(digits * powers[np.arange(len(digits)) - np.repeat(starts, sizes)], starts) if len(digits) else np.zeros(0, dtype=np.uint64)
    return _joined_hash(np.full(len(numbers), xxhash.xxh64_intdigest(lang), dtype=np.uint64), numbers)


def _key(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64(2**KEY_BITS - 1)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _KEY_BYTES, 8), dtype=np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _KEY_BYTES)
    return out.view("<u8").ravel()


def _joined_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = (phrase ^ (phrase >> np.uint64(31))) * np.uint64(_ODD[0]) + word
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_ODD[1])
    return mixed ^ (mixed >> np.uint64(32))


def _latest(filters: dict[int, Filter], hashes: np.ndarray) -> np.ndarray:
    """The last step whose filter has a hash, -1 for none."""
    out = np.full(len(hashes), -1, dtype=np.int64)
    for step in sorted(filters):
        out[filters[step].has(hashes)] = step
    return out


def phrases_of(codes: np.ndarray, hashes: np.ndarray, filters: Filters, longest: int):
    """For each length the distinct phrases of a page: (length, codes of their words, counts, hashes, first step).

    Phrases of two words and more are those whose two shorter phrases the filters have; the first step is the one
    after both had reached the threshold.
    """
    v = len(hashes)
    yield 1, np.arange(1, v)[:, None], np.bincount(codes, minlength=v)[1:], hashes[1:], np.zeros(v - 1, dtype=np.int64)
    reach = _latest(filters.get(1, {}), hashes)
    reach[0] = -1
    ids, id_hashes, at = codes.astype(np.int64), hashes, reach[codes]
    for k in range(2, longest + 1):
        p = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        if not len(p):
            return
        pairs = ids[p] * v + codes[p + k - 1]
        order = np.argsort(pairs)
        fresh = np.diff(pairs[order], prepend=-1) != 0
        starts, inverse = np.flatnonzero(fresh), np.empty(len(p), dtype=np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        counts, begin = np.diff(starts, append=len(p)), p[order[starts]]
        found = _joined_hash(id_hashes[ids[begin]], hashes[codes[begin + k - 1]])
        yield k, codes[begin[:, None] + np.arange(k)], counts, found, np.maximum(at[begin], at[begin + 1]) + 1
        reach = _latest(filters.get(k, {}), found)
        ids, at = np.zeros(len(at), dtype=np.int64), np.full(len(at), -1, dtype=np.int64)
        ids[p], at[p], id_hashes = inverse, reach[inverse], found


def _summed(keys: np.ndarray, *columns: tuple[np.ufunc, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with each column folded by its function."""
    if not len(keys):
        return keys, *(c for _, c in columns)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *(f.reduceat(c[order], starts) for f, c in columns)


def _scan(paged: DataFrame, filters, step: int, shards: int, longest: int, buckets_log: int) -> DataFrame:
    """Sums of the active phrases of a shard's pages: rows of a length and a bucket of hashes."""

    def counted(batches):
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def flush():
            nonlocal size
            for k, parts in held.items():
                keys, counts, starts = _summed(*_folds(*map(np.concatenate, zip(*parts, strict=True))))
                bucket = (keys >> np.uint64(KEY_BITS - buckets_log)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, dtype=np.int64)
                cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                column = lambda a, raw=np.ndarray.tobytes, cuts=cuts: pa.array([raw(a[x:y]) for x, y in cuts], pa.binary())
                yield pa.record_batch(
                    [pa.array([k] * len(cuts), pa.int32()), pa.array(bucket[edges[:-1]]), pa.array([False] * len(cuts)), column(keys, _packed), column(np.minimum(counts, _MOST).astype(np.int32)), column(starts.astype(np.int16))],
                    ["k", "bucket", "old", "keys", "counts", "starts"],
                )
            held.clear()
            size = 0

        for batch in batches:
            for lang, words, codes in zip(batch["lang"].to_pylist(), batch["words"], batch["codes"].to_pylist(), strict=True):
                for k, _, counts, hashes, starts in phrases_of(np.frombuffer(codes, np.int32), word_hashes(lang, words.values), filters.value, longest):
                    active = np.flatnonzero(starts > step - shards)
                    if len(active):
                        held.setdefault(k, []).append((_key(hashes[active]), counts[active], starts[active]))
                        size += len(active)
                if size >= BATCH:
                    yield from flush()
        yield from flush()

    return paged.select("lang", "words", "codes").mapInArrow(counted, _SUMS)


def _folds(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple:
    return keys, (np.add, counts), (np.maximum, starts)


def _merged(sums: DataFrame, step: int, shards: int, least: int) -> DataFrame:
    """Phrases of each bucket that are still in their cycle, and the hashes of those that reached the threshold now."""

    def of(table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        keys = np.concatenate([_unpacked(x) for x in table["keys"].to_pylist()])
        counts, starts = column("counts", np.int32).astype(np.int64), column("starts", np.int16)
        sizes = [len(x) // _KEY_BYTES for x in table["keys"].to_pylist()]
        before = np.where(np.repeat(table["old"].to_numpy(), sizes), counts, 0)
        keys, counts, starts, before = _summed(keys, (np.add, counts), (np.maximum, starts), (np.add, before))
        reached = keys[(counts >= least) & (before < least)]
        active = starts + shards - 1 > step
        out = [_packed(keys[active]), np.minimum(counts[active], _MOST).astype(np.int32).tobytes(), starts[active].tobytes(), reached.tobytes()]
        return pa.table([table["k"][:1], table["bucket"][:1], *(pa.array([x], pa.binary()) for x in out)], ["k", "bucket", "keys", "counts", "starts", "reached"])

    return sums.groupBy("k", "bucket").applyInArrow(of, _STATE)


def _hashed(batches):
    for batch in batches:
        pairs = zip(batch["lang"].to_pylist(), batch["word"].to_pylist(), strict=True)
        keys = np.array([word_hashes(lang, pa.array([word.encode()]))[0] for lang, word in pairs], dtype=np.uint64)
        yield pa.record_batch([pa.array([1], pa.int32()), pa.array([keys.tobytes()], pa.binary())], ["k", "reached"])


def _filters(state: DataFrame) -> dict[int, Filter]:
    """A filter for each length of which phrases reached the threshold, of at most 2^FILTER_BITS bits."""
    sizes = {r.k: r.n for r in state.groupBy("k").agg(F.sum(F.length("reached") / 8).cast("long").alias("n")).collect() if r.n}
    logs = {k: min(max(10, (16 * n - 1).bit_length()), FILTER_BITS) for k, n in sizes.items()}
    chunk = 1 << 16

    def marked(batches):
        bits = {k: np.zeros(1 << (log - 3), dtype=np.uint8) for k, log in logs.items()}
        for batch in batches:
            for k, raw in zip(batch["k"].to_pylist(), batch["reached"].to_pylist(), strict=True):
                for place in Filter.places(np.frombuffer(raw, np.uint64), logs.get(k, 10)) if raw else ():
                    np.bitwise_or.at(bits[k], place >> np.uint64(3), np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8)))
        rows = [(k, n, b[n : n + chunk]) for k, b in bits.items() for n in range(0, len(b), chunk) if b[n : n + chunk].any()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["k", "at", "bits"])

    def either(table: pa.Table) -> pa.Table:
        joined = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
        return pa.table([table["k"][:1], table["at"][:1], pa.array([joined.tobytes()], pa.binary())], ["k", "at", "bits"])

    if not logs:
        return {}
    kind = "k int, at int, bits binary"
    rows = state.select("k", "reached").mapInArrow(marked, kind).groupBy("k", "at").applyInArrow(either, kind).collect()
    out = {k: Filter(log, np.zeros(1 << (log - 3), dtype=np.uint8)) for k, log in logs.items()}
    for r in rows:
        out[r.k].bits[r.at : r.at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _exact(paged: DataFrame, filters, lengths: range, buckets_log: int, least: int) -> DataFrame:
    """Rows (lang, k, phrase, n): phrases of these lengths that the filters have and that occur `least` times.

    Tasks send their sums as lists to the buckets of the phrases' hashes, where equal phrases are added up.
    """

    def counted(batches):
        held: dict[tuple[str, int, int], dict[bytes, int]] = {}
        size = 0

        def flush():
            nonlocal size
            keys, sums = list(held), list(held.values())
            lists = lambda items, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sums)]), pa.int32()), pa.array([x for s in sums for x in items(s)], kind))
            named = [pa.array([k[j] for k in keys], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int64()))]
            yield pa.record_batch([*named, lists(dict.keys, pa.binary()), lists(dict.values, pa.int64())], ["lang", "k", "bucket", "phrases", "counts"])
            held.clear()
            size = 0

        for batch in batches:
            for lang, words, codes in zip(batch["lang"].to_pylist(), batch["words"], batch["codes"].to_pylist(), strict=True):
                dictionary = words.values
                for k, parts, counts, hashes, _ in phrases_of(np.frombuffer(codes, np.int32), word_hashes(lang, words.values), filters.value, lengths[-1]):
                    kept = np.flatnonzero(_latest(filters.value.get(k, {}), hashes) >= 0) if k in lengths else ()
                    if not len(kept):
                        continue
                    buckets = (_key(hashes[kept]) >> np.uint64(KEY_BITS - buckets_log)).astype(np.int64)
                    order = np.argsort(buckets, kind="stable")
                    kept, buckets = kept[order], buckets[order]
                    spelled = [dictionary.take(pa.array(parts[kept, j])) for j in range(k)]
                    phrases = (spelled[0] if k == 1 else pc.binary_join_element_wise(*spelled, b" ")).to_pylist()
                    numbers = counts[kept].tolist()
                    cuts = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1)).tolist()
                    for start, end in zip(cuts, cuts[1:], strict=False):
                        sums = held.setdefault((lang, k, int(buckets[start])), {})
                        size -= len(sums)
                        for at in range(start, end):
                            sums[phrases[at]] = sums.get(phrases[at], 0) + numbers[at]
                        size += len(sums)
                if size >= SPELLED:
                    yield from flush()
        if held:
            yield from flush()

    def added(table: pa.Table) -> pa.Table:
        flat = pa.table({"phrase": pc.list_flatten(table["phrases"]), "n": pc.list_flatten(table["counts"])})
        sums = flat.group_by("phrase").aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums["n_sum"], least))
        same = lambda c: pa.repeat(table[c][0], len(sums))
        return pa.table([same("lang"), same("k"), sums["phrase"].cast(pa.string()), sums["n_sum"]], ["lang", "k", "phrase", "n"])

    found = paged.select("lang", "words", "codes").mapInArrow(counted, "lang string, k int, bucket long, phrases array<binary>, counts array<long>")
    return found.groupBy("lang", "k", "bucket").applyInArrow(added, "lang string, k int, phrase string, n long")


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, k, phrase, n) of all phrases of 2 to `longest` words with n >= least and of their words, and (lang, n) of all words."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/collocations-{uuid.uuid4().hex}"
    pages(docs, text, lang, shards).write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    paged = spark.read.schema("lang string, n_words long, words array<binary>, codes binary, shard int").parquet(folder)
    totals = cut(paged.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    buckets_log = max(4, (n_words // BUCKET_WORDS).bit_length())
    filters: Filters = {}
    state, step = None, 0
    while step < shards or any(step - shards <= s for k in range(1, longest) for s in filters.get(k, {})):
        known = spark.sparkContext.broadcast(filters)
        sums = _scan(paged.where(F.col("shard") == step % shards), known, step, shards, longest, buckets_log)
        if step >= shards:  # words have seen all shards
            sums = sums.where("k > 1")
        if state is not None:
            sums = sums.unionByName(state.where(F.length("keys") > 0).withColumn("old", F.lit(True)).select(*sums.columns))
        state = cut(_merged(sums, step, shards, least))
        for k, made in _filters(state).items():
            filters = {**filters, k: {**filters.get(k, {}), step: made}}
        step += 1
    exact = cut(_exact(paged, spark.sparkContext.broadcast(filters), range(2, longest + 1), buckets_log, least))
    # words count where a phrase has them alone
    parts = _filters(exact.where("k = 2").select("lang", F.explode(F.split("phrase", " ")).alias("word")).distinct().mapInArrow(_hashed, "k int, reached binary"))
    words = _exact(paged, spark.sparkContext.broadcast({k: {0: f} for k, f in parts.items()}), range(1, 2), buckets_log, least)
    return cut(exact.unionByName(words)), totals


def _joined(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame, totals: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Rank each language's candidates: the lowest-scoring cut counts, and phrases that longer ones cover are dropped."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    candidates = phrases.where((F.col("k") > 1) & (F.col("n") >= least)).withColumn("words", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.col("words"), 1, F.col("cut")).alias("left"), _joined(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    priced = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = priced.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*")
    # all places where a shorter candidate lies within a longer one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _joined(F.col("words"), i, n))))
    longer = candidates.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest_n"))
    free = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longest_n").isNull() | (F.lit(100) * big("longest_n") < F.lit(covered) * big("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first within parts of a language, so that no task ranks all phrases of one
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = free.withColumn("part", part).where(F.col("part") <= top).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """Each language's first `top` collocations: lang, rank, phrase, a, l, r, n, score.

    Null texts count as empty, a null language as `und`; repeated rows count each. Phrases of one score and frequency are
    ranked by their UTF-8 bytes. Whole texts are read, other columns don't matter, and empty tables give no rows.
    """
    return scored(*frequent(docs, text, lang, least, longest, shards), least, top)
