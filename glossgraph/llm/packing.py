"""Best-fit packing of tokenized documents by non-negative least squares over length patterns.

Documents become pieces of at most SEQUENCE tokens. Patterns are the ways to fill a sequence with up to PARTS
pieces, on a grid of lengths. Non-negative least squares fits how often each pattern should repeat so that the
patterns together use up the histogram of piece lengths; the counts are rounded down, and pieces that no
pattern takes are packed by best fit, longest first, into what room is left and then into new sequences.

All planning works on the histogram, which has at most SEQUENCE numbers whatever the number of documents.
Spark numbers the pieces of each length, within slots so that one length may have any share of the pieces,
and each piece finds its place in the plan by its number.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossgraph.llm.common import cut, small_batches

SEQUENCE = 4096
SEPARATOR = 1
#: Grid of the patterns: a sequence has this many units.
UNITS = 128
PARTS = 3
#: Slots within which pieces of one length are numbered.
SLOTS = 256
#: Words whose ids a Python worker remembers.
REMEMBERED = 500_000
PIECE = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Chunks that are lower-cased and split without the tokenizer: Latin letters, then ASCII punctuation.
SIMPLE = re.compile(r"([a-zA-Zß-öø-ÿÀ-ÖØ-Þ]*)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[str, int]:
    """The usual letters for bytes in byte-level vocabularies: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts by a tokenizer that never joins letters over a space; chunks between spaces are remembered.

    Simple chunks are merged by tiktoken over the same merges, with a byte that UTF-8 never has for the end of a
    word; everything else goes to the tokenizer itself. The ids are the tokenizer's in either case.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        end, letters = model["end_of_word_suffix"], byte_letters()
        raw = lambda token: bytes(map(letters.__getitem__, token.removesuffix(end))) + b"\xff" * token.endswith(end)
        ranks = {bytes([b]): b for b in range(256)}
        ids = {raw(t): i for t, i in model["vocab"].items() if set(t.removesuffix(end)) <= letters.keys()}
        for token in sorted((t for t in ids if len(t) == 2 and t[1] == 255), key=ids.__getitem__):
            ranks[token] = len(ranks)
        for pair in model["merges"]:
            ranks.setdefault(raw("".join(pair if not isinstance(pair, str) else pair.split(" "))), len(ranks))
        self.merged = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.of_rank = {rank: ids[token] for token, rank in ranks.items() if token in ids}
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def _tokens(self, chunk: str) -> list[int]:
        simple = SIMPLE.fullmatch(chunk)
        if simple:
            found = [self.of_rank[r] for x in simple.groups() if x for r in self.merged(x.lower().encode() + b"\xff")]
            return found
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _learn(self, chunks: list[str]) -> None:
        new = [c for c in chunks if c not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.ids, self.starts, new = {}, np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64), chunks
        found = list(map(self._tokens, new))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has; null texts have none."""
        plain = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", " ")
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        self._learn(chunks)
        number = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks))[coded.indices.to_numpy()]
        first, sizes = self.starts[number], self.starts[number + 1] - self.starts[number]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        totals = np.concatenate([[0], ends])[bounds]
        return ids, np.diff(totals)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def token_ids(texts: pa.Array, path: str, separator: int = SEPARATOR) -> list[np.ndarray]:
    """For each text its ids, then the separator."""
    ids, sizes = encoder(path).encode(texts)
    end = np.array([separator], dtype=np.int32)
    return [np.concatenate([x, end]) for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every document cut into pieces of at most `sequence` tokens.

    Null texts count as empty and have the separator alone. Repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)

    def of(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch["doc_id"].to_pylist(), token_ids(batch["text"], path), strict=True):
                raw = ids.astype("<u4")
                for k, at in enumerate(range(0, len(raw), sequence)):
                    part = raw[at : at + sequence]
                    out.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(of, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {PIECE}")


def patterns(units: int = UNITS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """The ways to write `units` as a sum of at most `parts` positive numbers, largest first."""

    def ways(left: int, most: int, parts: int):
        if left == 0:
            yield ()
        elif parts:
            for x in range(min(left, most), (left - 1) // parts, -1):
                for rest in ways(left - x, x, parts - 1):
                    yield (x, *rest)

    return list(ways(units, units, parts))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """Non-negative least squares by Lawson and Hanson's active sets on the normal equations, at any scale of b."""
    scale = float(np.abs(b).max(initial=0)) or 1.0
    gram, target = a.T @ a, a.T @ (b / scale)
    n = a.shape[1]
    x, active, barred = np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for _ in range(3 * a.shape[0]):
        slope = np.where(active | barred, -np.inf, target - gram @ x)
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        active[best] = True
        for _ in range(a.shape[0]):
            which = np.nonzero(active)[0]
            s = np.linalg.solve(gram[np.ix_(which, which)] + 1e-9 * np.eye(len(which)), target[which])
            if s.min() > 0:
                x[:] = 0
                x[which] = s
                barred[:] = False
                break
            low = s <= 0
            step = float(np.min(x[which][low] / np.maximum(x[which][low] - s[low], 1e-300)))
            x[which] += step * (s - x[which])
            active[which[x[which] <= tolerance * 1e-3]] = False
            x[~active] = 0
            if not active[best]:  # it left at once: another column is tried
                barred[best] = True
            if not active.any():
                break
    return np.maximum(x, 0) * scale


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, units: int = UNITS, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences): every piece of the histogram in just one of them."""
    left = dict(sorted((n, c) for n, c in histogram.items() if c > 0))
    if not left:
        return []
    opened: dict[tuple[int, ...], int] = defaultdict(int)
    if left.get(sequence):
        opened[(sequence,)] += left.pop(sequence)
    width = sequence // units
    bins: dict[int, list[int]] = defaultdict(list)  # lengths of a bin, the longest first
    for n in sorted(left, reverse=True):
        bins[-(-n // width)].append(n)
    counts = np.zeros(units)
    for k, ns in bins.items():
        counts[k - 1] = sum(left[n] for n in ns)
    ways = [w for w in patterns(units, parts) if all(counts[k - 1] for k in w)]
    if ways:
        a = np.zeros((units, len(ways)))
        for j, w in enumerate(ways):
            for k in w:
                a[k - 1, j] += 1
        repeats = np.floor(nnls(a, counts) + 1e-6).astype(np.int64)
        order = sorted(left)
        for j in np.argsort(-repeats, kind="stable").tolist():
            if not repeats[j]:
                break
            _take(ways[j], int(repeats[j]), bins, left, opened, sequence, order)
    _best_fit(left, opened, sequence)
    return sorted(opened.items(), reverse=True)


def _take(way: tuple[int, ...], times: int, bins: dict[int, list[int]], left: dict[int, int], opened: dict[tuple[int, ...], int], sequence: int, order: list[int]) -> None:
    """Open `times` sequences of one pattern in runs of equal lengths.

    All parts but the smallest take the longest lengths of their bins; the smallest takes the longest length
    that fits the room left, so that rounding to the grid wastes nothing where lengths abound.
    """
    while times:
        chosen: list[int] = []
        for k in way[:-1]:
            bins[k] = [n for n in bins[k] if left[n]]
            n = next((n for n in bins[k] if left[n] > chosen.count(n)), None)
            if n is None:
                return
            chosen.append(n)
        room = sequence - sum(chosen)
        at = bisect_right(order, room) - 1
        while at >= 0 and left[order[at]] <= chosen.count(order[at]):
            if not left[order[at]]:
                order.pop(at)
            at -= 1
        if at < 0:
            return
        chosen.append(order[at])
        run = min(times, *(left[n] // chosen.count(n) for n in set(chosen)))
        for n in chosen:
            left[n] -= run
        opened[tuple(sorted(chosen, reverse=True))] += run
        times -= run


def _best_fit(left: dict[int, int], opened: dict[tuple[int, ...], int], sequence: int) -> None:
    """Residual pieces, longest first, each into the fullest sequence that has room; equal cases at once."""
    rooms: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for way in opened:
        rooms[sequence - sum(way)].append(way)
    order = sorted(rooms)

    def put(way: tuple[int, ...], times: int) -> None:
        if not opened[way]:
            room = sequence - sum(way)
            if not rooms[room]:
                insort(order, room)
            rooms[room].append(way)
        opened[way] += times

    for n in sorted((n for n, c in left.items() if c), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                # the pieces of this length that fill a new sequence together
                many = min(sequence // n, left[n])
                run = left[n] // many
                left[n] -= many * run
                put((n,) * many, run)
                continue
            room = order[at]
            way = rooms[room][-1]
            many = min(room // n, max(left[n] // opened[way], 1))
            run = min(opened[way], left[n] // many)
            left[n] -= run * many
            opened[way] -= run
            if not opened[way]:
                del opened[way]
                rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
            put(tuple(sorted(way + (n,) * many, reverse=True)), run)


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: up to which number pieces go to a place, the first sequence there, the offset in it."""
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequences = 0
    for way, times in planned:
        offset = 0
        for n in way:
            table[n].append((times, sequences, offset))
            offset += n
        sequences += times
    return {n: (np.cumsum([t for t, _, _ in rows]), np.array([s for _, s, _ in rows]), np.array([o for _, _, o in rows])) for n, rows in table.items()}


def pack(pieced: DataFrame, sequence: int = SEQUENCE, slots: int = SLOTS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length and any more columns).

    Pieces should come from a checkpoint or a table, as they are read twice. An empty table stays empty. Null ids
    count as one document's; repeated rows are packed once each; columns of the new names are replaced.
    """
    spark = pieced.sparkSession
    pieced = pieced.drop("sequence_id", "offset")
    slotted = pieced.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)).cast("int"))
    counts = cut(slotted.groupBy("length", "_slot").agg(F.count("*").alias("_n")))  # at most sequence x slots rows
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `sequence` rows
    where = spark.sparkContext.broadcast(places(plan(histogram, sequence)))  # bounded as the plan is, by lengths

    before = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # rows that agree in all of these are alike, so a task that runs again numbers them as before
    within = Window.partitionBy("length", "_slot").orderBy("doc_id", "piece", *(c for c in ("start", "ids_crc32") if c in pieced.columns))
    numbered = slotted.withColumn("_rank", F.row_number().over(within)).join(starts, ["length", "_slot"])

    def placed(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        n, number = lengths.to_numpy(), numbers.to_numpy()
        ids, offsets = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
        for length in np.unique(n).tolist():
            which = n == length
            ends, first, offset = where.value[length]
            at = np.searchsorted(ends, number[which], side="right")
            ids[which] = first[at] + number[which] - np.where(at > 0, ends[np.maximum(at - 1, 0)], 0)
            offsets[which] = offset[at]
        return pa.StructArray.from_arrays([pa.array(ids), pa.array(offsets)], ["sequence_id", "offset"])

    place = F.arrow_udf(placed, "struct<sequence_id:long,offset:long>").asNondeterministic()
    number = F.col("_before") + F.col("_rank") - 1
    return numbered.withColumn("_at", place(F.col("length"), number)).select(*pieced.columns, "_at.sequence_id", "_at.offset")
