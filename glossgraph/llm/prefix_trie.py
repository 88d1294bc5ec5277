"""Prefix trie of conversations by range minima over sorted common prefixes.

Conversations are sorted as sequences of turns, so that those which begin alike stand next to each other. A prefix of
depth d is shared by the run of neighbours whose common prefixes are at least d turns long. A sparse table holds the
minima of these lengths over all stretches of 2^k neighbours; by it each candidate prefix finds the left and the right
end of its run by a binary search of its own, without a stack, and a second table finds the run's smallest conversation.

Spark sorts by ranges, and tasks read their range in windows of WINDOW conversations. What lies inside a window is
complete. A run that touches a window's edge may go on in the next one: its sums are parts, which are added up by the
prefix. Nothing else is moved, and a prefix that all conversations share is a row for each window.

Turns are known by two 64-bit hashes, mixed with their place, and prefixes by the xor of these. A conversation of more
than BLOCK turns is sorted as several items, each below the prefix that it follows, so no row holds a whole one. What
counts for whole subtrees is therefore summed over members instead of nodes: a first pass finds which nodes each
conversation is the smallest member of (a lower end of its path), a second one sums, over each run,
the bytes that a member shares with smaller ones, the first nodes below the run's depth, and the leaves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossgraph.llm.common import cut

#: Turns of an item, at most.
BLOCK = 256
#: Items and turns that a task looks at together.
WINDOW = 8192
WINDOW_TURNS = 1 << 20
KEY = ["depth", "k1", "k2"]
_FIRST = "depth long, k1 long, k2 long, q1 long, q2 long, n long, conv_id long, longer long, bytes long, open boolean"
_SECOND = (
    "depth long, k1 long, k2 long, n long, least struct<conv_id:long,first:long,parent:long,shared:long,longer:long>,"
    " children long, leaves long, shared long, before long, ends string, ends_first long, open boolean"
)


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, at, h1, h2, bytes): turns with their place from 1 by turn, null first, and hashes of role and text.

    Null roles and texts are empty. Turns of the same number are ordered by role, then by hashes, so that reruns agree.
    Rows without a conv_id belong to no conversation and are left out. Places come from a sort by ranges and the
    number of turns in the ranges before, so a conversation of any length is dealt to many tasks.
    """
    named = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    ).where(F.col("conv_id").isNotNull())
    hashed = named.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("bytes"))
    order = ["conv_id", "turn", "role", "h1", "h2"]
    # the salt splits repeated rows
    dealt = hashed.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    placed = cut(dealt.select("conv_id", "h1", "h2", "bytes", F.monotonically_increasing_id().alias("place")).withColumn("range", F.shiftright("place", 33)))
    runs = placed.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "range", "first", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return placed.join(runs, ["conv_id", "range"]).select("conv_id", (F.col("place") - F.col("first") + F.col("ahead") + 1).alias("at"), "h1", "h2", "bytes")


def _items(turns: DataFrame, conversations: DataFrame, block: int) -> DataFrame:
    """Blocks of each conversation's turns, with the prefix, the bytes and the turns before and the bytes of all; at least one for each."""
    mixed = turns.select("conv_id", F.expr(f"(at - 1) div {block}").alias("block"), "at", F.xxhash64("at", "h1").alias("m1"), F.xxhash64("at", "h2").alias("m2"), "bytes")
    packed = mixed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "m1", "m2", "bytes"))).alias("rows"), F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"), F.sum("bytes").alias("own")
    )
    named = conversations.select("conv_id", "n").join(packed, "conv_id", "left")
    zero = F.lit(0).cast("long")
    turns_of = F.transform(F.coalesce("rows", F.array()), lambda x: F.struct(x["m1"].alias("m1"), x["m2"].alias("m2"), x["bytes"].alias("bytes"))).alias("turns")
    single = named.where(F.col("n") <= block).select("conv_id", "n", zero.alias("block"), zero.alias("p1"), zero.alias("p2"), zero.alias("before"), F.coalesce("own", zero).alias("total"), turns_of)
    every = Window.partitionBy("conv_id")
    ahead = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda f, c: F.coalesce(f(c).over(ahead), zero)
    several = named.where(F.col("n") > block).select(
        "conv_id", "n", "block", so_far(F.bit_xor, "x1").alias("p1"), so_far(F.bit_xor, "x2").alias("p2"), so_far(F.sum, "own").alias("before"), F.sum("own").over(every).alias("total"), turns_of
    )
    return single.unionByName(several)


def _sorted(items: DataFrame) -> DataFrame:
    order = ["block", "p1", "p2", "turns", "conv_id"]
    return items.repartitionByRange(*order).sortWithinPartitions(*order)


def _windows(batches, window: int):
    """Arrow batches as tables of at most `window` items and about WINDOW_TURNS turns."""
    held, items, turns = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, window):
            part = batch.slice(at, window)
            held.append(part)
            items, turns = items + part.num_rows, turns + len(part["turns"].flatten())
            if items >= window or turns >= WINDOW_TURNS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, items, turns = [], 0, 0
    if items:
        yield pa.Table.from_batches(held).combine_chunks()


class Runs:
    """The candidate prefixes of a window of sorted items, each with the ends of its run and its smallest member."""

    def __init__(self, table: pa.Table, most: int):
        column = lambda name: table[name].to_numpy()
        lists = table["turns"].chunk(0) if table.num_rows else pa.array([], table["turns"].type)
        flat = lists.flatten()
        self.conv, self.n_turns, block = column("conv_id"), column("n"), column("block")
        self.lens = lists.value_lengths().to_numpy().astype(np.int64)
        self.off = np.cumsum(self.lens) - self.lens
        m1, m2, self.bytes = (flat.field(k).to_numpy() for k in range(3))
        p1, p2 = column("p1"), column("p2")
        size = len(self.conv)
        lcp = self._common(np.concatenate([[False], (block[1:] == block[:-1]) & (p1[1:] == p1[:-1]) & (p2[1:] == p2[:-1])]), m1, m2)
        # candidates: each prefix of an item that the item before doesn't have; the root belongs to the first block
        low = np.maximum(lcp + 1, np.where(block == 0, 0, 1))
        number = np.maximum(self.lens - low + 1, 0)
        self.item = np.repeat(np.arange(size), number)
        d = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + low[self.item]
        self.left, self.right = self._ends(self._table(lcp), d)
        self.least = self._smallest()
        self.n = self.right - self.left + 1
        # items alike stand in a row, the first of them brings their last prefix in
        fresh = np.concatenate([[True], ~((lcp[1:] == self.lens[1:]) & (self.lens[1:] == self.lens[:-1]))])[:size]
        self.run = np.cumsum(fresh) - 1
        self.last = self.n_turns == block * most + self.lens
        self.whole = d == self.lens[self.item]  # prefixes that are whole items
        self.ended = np.where(self.whole, np.bincount(self.run, weights=self.last, minlength=size).astype(np.int64)[self.run[self.item]], 0)
        self.depth = block[self.item] * most + d
        at, parent = self.off[self.item] + d, self.off[self.item] + np.maximum(d - 1, 0)
        key = lambda m, p, at: (np.concatenate([[0], np.bitwise_xor.accumulate(m)])[at] if len(m) else at * 0) ^ self._start(m, p)
        self.k1, self.k2, self.q1, self.q2 = key(m1, p1, at), key(m2, p2, at), key(m1, p1, parent), key(m2, p2, parent)
        sums = np.concatenate([[0], np.cumsum(self.bytes)])
        self.before = column("before")[self.item] + sums[parent] - sums[self.off[self.item]]
        self.last_bytes = sums[at] - sums[parent]
        self.open = (self.left == 0) | (self.right == size - 1)

    def _start(self, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (np.concatenate([[0], np.bitwise_xor.accumulate(m)])[self.off[self.item]] if len(m) else 0) ^ p[self.item]

    def _common(self, same: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
        """Turns that each item has in common with the one before; -1 below another prefix."""
        lcp = np.where(same, 0, -1)
        alive, d = np.flatnonzero(same), 0
        while len(alive):
            alive = alive[(self.lens[alive] > d) & (self.lens[alive - 1] > d)]
            a, b = self.off[alive] + d, self.off[alive - 1] + d
            alive = alive[(m1[a] == m1[b]) & (m2[a] == m2[b])]
            lcp[alive] += 1
            d += 1
        return lcp

    @staticmethod
    def _table(values: np.ndarray) -> list[np.ndarray]:
        """Sparse table: row k holds the minima of all stretches of 2^k values."""
        rows = [values]
        while 2 << (len(rows) - 1) <= len(values):
            half = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
        return rows

    def _ends(self, table: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of each candidate's run, by two binary searches over the table."""
        left, right, size = self.item.copy(), self.item.copy(), len(table[0])
        for k in reversed(range(len(table))):
            span = 1 << k
            fits = left - span >= 0
            fits[fits] = table[k][left[fits] - span + 1] >= d[fits]
            left[fits] -= span
            fits = right + span < size
            fits[fits] = table[k][right[fits] + 1] >= d[fits]
            right[fits] += span
        return left, right

    def _smallest(self) -> np.ndarray:
        """The item of each run's smallest conversation."""
        order = np.argsort(self.conv, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        table = self._table(rank)
        level = np.frexp(self.right - self.left + 1)[1] - 1
        out = np.empty(len(self.left), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[k][self.left[at]], table[k][self.right[at] - (1 << k) + 1])
        return order[out]

    def sum(self, values: np.ndarray) -> np.ndarray:
        """Sums of the items' values over each run."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.right + 1] - sums[self.left]


def _first_pass(batches, window: int, block: int):
    for table in _windows(batches, window):
        r = Runs(table, block)
        columns = [r.depth, r.k1, r.k2, r.q1, r.q2, r.n, r.conv[r.least], r.n - r.ended, r.last_bytes, r.open]
        yield pa.record_batch([pa.array(c) for c in columns], ["depth", "k1", "k2", "q1", "q2", "n", "conv_id", "longer", "bytes", "open"])


def _second_pass(batches, window: int, block: int):
    for table in _windows(batches, window):
        r = Runs(table, block)
        size = len(r.conv)
        first, parent, shared, leaf = (table[c].to_numpy() for c in ("first", "parent", "shared", "leaf"))
        # first nodes at one depth more than the run's, within the run
        places = np.sort(first * size + np.arange(size))
        below = np.searchsorted(places, (r.depth + 1) * size + r.right + 1) - np.searchsorted(places, (r.depth + 1) * size + r.left)
        least = [r.conv[r.least], first[r.least], parent[r.least], shared[r.least], (r.n_turns[r.least] > r.depth).astype(np.int64)]
        ids: dict[int, list[int]] = {}
        for run, conv in zip(r.run[r.last].tolist(), r.conv[r.last].tolist(), strict=True):
            ids.setdefault(run, []).append(conv)
        ended = [ids[run] if n else None for run, n in zip(r.run[r.item].tolist(), r.ended.tolist(), strict=True)]
        columns = [
            *map(pa.array, (r.depth, r.k1, r.k2, r.n)),
            pa.StructArray.from_arrays([pa.array(c) for c in least], ["conv_id", "first", "parent", "shared", "longer"]),
            *map(pa.array, (below, r.sum(leaf), r.sum(shared), r.before)),
            pa.array([x and ",".join(map(str, x)) for x in ended], pa.string()),
            pa.array([x and x[0] for x in ended], pa.int64()),
            pa.array(r.open),
        ]
        yield pa.record_batch(columns, ["depth", "k1", "k2", "n", "least", "children", "leaves", "shared", "before", "ends", "ends_first", "open"])


def _digests(parts: DataFrame) -> DataFrame:
    """SHA-256 of each prefix's lists of ids in their order; a list is read piece by piece, however long it is."""

    def of(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for *this, ends in zip(*(batch[c].to_pylist() for c in (*KEY, "ends")), strict=True):
                if this != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = this, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.encode())
            yield pa.record_batch([pa.array([x[k] for x in done], pa.string() if k == 3 else pa.int64()) for k in range(4)], [*KEY, "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([x]) for x in (*key, digest.hexdigest())], [*KEY, "ends_sha256"])

    dealt = parts.where(F.col("ends").isNotNull()).select(*KEY, "ends", "ends_first").repartition(*KEY).sortWithinPartitions(*KEY, "ends_first")
    return dealt.mapInArrow(of, "depth long, k1 long, k2 long, ends_sha256 string")


def _owners(items: DataFrame, window: int, block: int) -> DataFrame:
    """For each conversation: depth of the first node that it is the smallest member of, that node's parent's smallest
    member, the bytes of all such nodes, and whether it is the smallest of a leaf; conversations of no such node are left out."""
    found = cut(_sorted(items).mapInArrow(lambda batches: _first_pass(batches, window, block), _FIRST))
    value = lambda c: F.first(c).alias(c)
    joined = found.where("open").groupBy(*KEY).agg(value("q1"), value("q2"), F.min("conv_id").alias("conv_id"), F.sum("longer").alias("longer"), value("bytes"))
    nodes = found.where("not open").select(*joined.columns).unionByName(joined)
    owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "q1", "q2")).alias("top"), F.sum("bytes").alias("owned"), F.max((F.col("longer") == 0).cast("long")).alias("leaf"))
    owners = cut(owners.select("conv_id", "owned", "leaf", F.col("top.depth").alias("first"), (F.col("top.depth") - 1).alias("depth"), F.col("top.q1").alias("k1"), F.col("top.q2").alias("k2")))
    # below the root there may be very many first nodes, so its smallest member is looked up once
    root = owners.where("first = 0").select("conv_id").first()
    shallow = owners.where("first <= 1").withColumn("parent", F.when(F.col("first") == 1, F.lit(root and root.conv_id)).cast("long"))
    deep = owners.where("first > 1").join(nodes.select(*KEY, F.col("conv_id").alias("parent")), KEY)
    kept = ["conv_id", "owned", "leaf", "first", "parent"]
    return shallow.select(*kept).unionByName(deep.select(*kept))


def prefix_trie(turns: DataFrame, conversations: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each distinct prefix of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    `turns` has (conv_id, at from 1 without gaps, h1, h2, bytes), `conversations` each conv_id once, with its number of
    turns n. Members are the conversations that begin with the prefix, conv_id is the smallest of them. The root has
    depth 0; a conversation without turns is a member of the root alone. Without conversations there are no rows.
    """
    items = cut(_items(turns, conversations, block))
    known = items.join(_owners(items, window, block), "conv_id", "left").select(
        *items.columns, F.coalesce("first", F.lit(-1)).cast("long").alias("first"), F.coalesce("parent", F.lit(0)).cast("long").alias("parent"), (F.col("total") - F.coalesce("owned", F.lit(0))).cast("long").alias("shared"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")
    )
    found = cut(_sorted(known).mapInArrow(lambda batches: _second_pass(batches, window, block), _SECOND))
    parts, columns = found.where("open"), ["n", "least", "children", "leaves", "shared", "before", "ends_sha256"]
    total = lambda c: F.sum(c).alias(c)
    joined = parts.groupBy(*KEY).agg(total("n"), F.min("least").alias("least"), total("children"), total("leaves"), total("shared"), F.first("before").alias("before"))
    none = F.lit(hashlib.sha256().hexdigest())
    joined = joined.join(_digests(parts), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    closed = found.where("not open").withColumn("ends_sha256", F.when(F.col("ends").isNull(), none).otherwise(F.sha2("ends", 256)))
    nodes = closed.select("depth", *columns).unionByName(joined.select("depth", *columns))
    parent: Column = F.when(F.col("depth") > 0, F.when(F.col("least.first") < F.col("depth"), F.col("least.conv_id")).otherwise(F.col("least.parent")))
    return nodes.select(
        F.col("least.conv_id").alias("conv_id"),
        "depth",
        parent.alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.col("children") + F.col("least.longer")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("shared") - F.col("least.shared") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        "ends_sha256",
    )


def borrowed(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: (turns, conversations) for prefix_trie().

    Conversation c takes the first h turns of conversation c - c % every (all if it has fewer, none if it is absent),
    then its own after its first h; h is the CRC-32 of c's digits, modulo `most`. Remainders of negative ids are those
    of SQL, not above 0. `turns` is what numbered() gives.
    """
    sizes = cut(turns.groupBy("conv_id").agg(F.max("at").alias("own")))
    lent = sizes.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    plan = cut(lent.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("k"), "own"))
    own = turns.join(plan.select("conv_id", "h", "k"), "conv_id").where(F.col("at") > F.col("h"))
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "h1", "h2", "bytes")
    first = turns.where(F.col("at") < most).withColumnRenamed("conv_id", "base")
    heads = first.join(plan.select("conv_id", "base", "h"), "base").where(F.col("at") <= F.col("h")).select(*own.columns)
    return own.unionByName(heads), plan.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
