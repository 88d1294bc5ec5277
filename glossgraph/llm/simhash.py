"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most three bits differ in at most three bytes, so they
share at least five positional bytes. The index posts each distinct fingerprint under four of its positional
bytes at a time, in the fourteen sets of four positions whose numbers xor to zero: any three positions lie in
exactly one of these sets, and the four positions outside it all match. So no close pair is missed, and a list
has only fingerprints that agree in 32 bits. Within a list, shared positional bytes are tallied for each pair,
pairs with fewer than five are dropped, and the rest are verified on the bits.

A list longer than MOST is not compared as it stands: three differing bits leave one of four parts of the bits
not yet matched equal, so its members are posted again under each part. Below twelve unmatched bits a list
can't be longer than MOST, so every comparison is bounded and nothing is dropped. Lists report a spanning set
of their links, as only the components are asked for.

Near copies are what this index joins, confirmed by sets of five-word shingles. Texts may be similar by these and yet differ
in more than three bits; such pairs are found after that by minima of the shingles, where the index hasn't joined them. Lists
of the same minima may be long, too; what links found already needn't be compared again, see list_links().
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.llm.common import cut, small_batches
from glossgraph.llm.components import connected_components, join_one

BYTES = 8
MAX_BITS = 3
LEAST_SHARED = BYTES - MAX_BITS
MOST = 4096
BLOCKS = [c for c in itertools.combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: 255 additions fit a byte lane.
LANE_ROWS = 255
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of a text, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)), itertools.repeat(42)))


def majority_bits(hashed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` hashes: the bits that are set in over half of them (uint64)."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.nonzero(sizes)[0]
    if not len(full):
        return out
    n = sizes[full]
    pieces = -(-n // LANE_ROWS)  # a long text is counted in pieces, so that no byte lane overflows
    first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(first, pieces)
    starts = np.repeat(np.cumsum(n) - n, pieces) + within * LANE_ROWS
    for k in range(8):
        lanes = np.add.reduceat((hashed >> np.uint64(k)) & LANES, starts)
        for lane in range(8):
            ones = np.add.reduceat(((lanes >> np.uint64(8 * lane)) & np.uint64(255)).astype(np.int64), first)
            out[full] |= (2 * ones > n).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def fingerprint(text: Column, width: int = 3) -> Column:
    """The 64-bit fingerprint as a long; 0 for null texts and texts without words."""

    def of(texts: pa.Array) -> pa.Array:
        runs = [shingle_hashes(x, width) for x in texts.to_pylist()]
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        hashed = np.fromiter(itertools.chain.from_iterable(runs), dtype=np.uint64, count=int(sizes.sum()))
        return pa.array(majority_bits(hashed, sizes).view(np.int64), pa.int64())

    return F.arrow_udf(of, "long").asNondeterministic()(text)


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def postings(fps: DataFrame) -> DataFrame:
    """Rows (key, fp, mask): each fingerprint under four of its positional bytes, for each of the 14 sets."""
    rows = []
    for k, block in enumerate(BLOCKS):
        key, mask = F.lit(k << 32).cast("long"), 0
        for place, position in enumerate(block):
            key = key.bitwiseOR(F.shiftleft(_byte(F.col("fp"), position), 8 * place))
            mask |= 255 << (8 * position)
        rows.append(F.struct(key.alias("key"), F.lit(mask - (mask >> 63 << 64)).cast("long").alias("mask")))
    return fps.select("fp", F.inline(F.array(*rows)))


def _parts(mask: int) -> list[int]:
    """The bits outside a mask in four parts, as masks."""
    free = [k for k in range(64) if not mask >> k & 1]
    return [sum(1 << int(k) for k in part) for part in np.array_split(free, MAX_BITS + 1)]


def refine(long_lists: DataFrame) -> DataFrame:
    """Post the members of long lists again, under each of four parts of the bits that their list leaves open."""

    def again(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy()
            out = {"key": [], "fp": [], "mask": []}
            for mask in np.unique(batch["mask"].to_numpy()).tolist():
                which = batch["mask"].to_numpy() == mask
                for part in _parts(mask % 2**64):
                    wide = np.uint64((mask % 2**64) | part)
                    kept = fp[which].view(np.uint64) & wide
                    # two lists are the same where mask and matched bits are
                    out["key"].append(kept.view(np.int64))
                    out["fp"].append(fp[which])
                    out["mask"].append(np.full(which.sum(), wide, dtype=np.uint64).view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(out[c]) if out[c] else [], pa.int64()) for c in out], list(out))

    return long_lists.select("fp", "mask").mapInArrow(again, "key long, fp long, mask long")


def linked(members: np.ndarray, sizes: np.ndarray, least_shared: int = LEAST_SHARED, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within each run of `sizes` members (rows of one or more 64-bit numbers), as row numbers.

    Shared positional bytes are tallied for each pair that isn't joined yet; pairs with fewer than `least_shared`
    are dropped, the others verified on their bits.
    """
    members = members.reshape(len(members), -1)

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differing = members[a] ^ members[b]
        shared = (differing.view(np.uint8) == 0).sum(axis=1)
        kept = shared >= least_shared
        kept[kept] = np.bitwise_count(differing[kept]).sum(axis=1) <= max_bits
        return kept

    starts = np.cumsum(sizes) - sizes
    left, right = [starts[sizes == 2]], [starts[sizes == 2] + 1]  # most lists: all at once
    good = close(left[0], right[0])
    left[0], right[0] = left[0][good], right[0][good]
    for start, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        root = np.arange(n)
        for i in range(n - 1):
            rest = np.nonzero(root[i + 1 :] != root[i])[0] + i + 1  # those not joined yet
            near = rest[close(np.full(len(rest), start + i), start + rest)] if len(rest) else rest
            fresh = near[np.unique(root[near], return_index=True)[1]]  # one link for each group that joins
            left.append(np.full(len(fresh), start + i))
            right.append(start + fresh)
            root[np.isin(root, root[near])] = root[i]
    return np.concatenate(left), np.concatenate(right)


def _compare(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    members = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    a, b = linked(members, sizes)
    return members[a], members[b]


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (a, b): enough links between distinct fingerprints (column fp) to join all that are linked."""

    def compared(batches):
        for batch in batches:
            a, b = _compare(batch["members"])
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    posted, found = postings(fps), None
    while True:
        # sizes are summed up before the shuffle; the postings of a long list are never brought together
        sizes = posted.groupBy("key", "mask").count().where("count > 1")
        short = posted.join(sizes.where(F.col("count") <= most).drop("count"), ["key", "mask"])
        lists = short.groupBy("key", "mask").agg(F.collect_list("fp").alias("members")).select("members")
        part = lists.mapInArrow(compared, "a long, b long")
        found = part if found is None else found.unionAll(part)
        long = sizes.where(F.col("count") > most).drop("count")
        if long.isEmpty():
            return found
        posted = cut(refine(posted.join(long, ["key", "mask"])).distinct())


def _components(printed: DataFrame, first: DataFrame, found: DataFrame, prints: list[str]) -> DataFrame:
    """Component of each row of `printed`, by links between the first documents of equal fingerprints."""
    joined = connected_components(found, "a", "b").withColumnRenamed("node", "_node")
    linked = cut(first.join(joined, F.col("node") == F.col("_node")).select(*dict.fromkeys([*prints, "node"]), "first", "component"))
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    grouped = join_one(linked, smallest, "component", linked.count()).select(*prints, "component", "component_id")
    alone = first.join(linked.select("node"), "node", "left_anti").select(*prints, F.col("node").alias("component"), F.col("first").alias("component_id"))
    return printed.join(grouped.unionAll(alone), prints)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint long, component_id): the smallest doc_id reachable over fingerprint links.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows come back once for each row.
    """
    small_batches(docs.sparkSession)
    printed = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")))
    first = printed.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("fp"))
    found = links(first.select("fp"))
    return _components(printed, first, found, ["fp"]).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


# Near copies by shingle similarity: bands of minima as the index, every candidate compared on its real shingles.

#: Words of a shingle, bands of the index and minima of a band. A pair of similarity 0.8 shares no band once in
#: 2,800 times, whatever the kind of edit.
WIDE_WORDS = 5
BANDS = 20
BAND = 5
#: Least similarity (shared shingles of all shingles) of copies.
SIMILAR = 0.7
#: Shingles of a block of members; two blocks at most are in memory together.
BLOCK_SHINGLES = 1 << 19
#: Classes of size for each factor of e.
CLASSES = 8
#: How often the members of a long list are posted again under other minima, at most.
LEVELS = 3


def _salts(level: int) -> np.ndarray:
    return np.random.default_rng(42 + level).integers(0, 2**64, (2, BANDS * BAND), dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; null texts and those without words have none."""
    return [np.unique(np.array(shingle_hashes(x, WIDE_WORDS), dtype=np.uint64)) for x in texts.to_pylist()]


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def text_print(text: Column) -> Column:
    """A number for a whole text, null texts included."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _banded(text: Column, level: int = 0) -> Column:
    """A struct of the number of a text's set, its size, and a key for each band; no keys without shingles."""
    salts = _salts(level)

    def of(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts)
        sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        full = sizes > 0
        flat = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
        starts = (np.cumsum(sizes) - sizes)[full]
        keys = np.empty((full.sum(), BANDS), dtype=np.uint64)
        for band in range(BANDS if full.any() else 0):
            key = np.full(full.sum(), band, dtype=np.uint64)
            for k in range(band * BAND, band * BAND + BAND):
                least = np.minimum.reduceat((flat ^ salts[0, k]) * (salts[1, k] | np.uint64(1)), starts)
                key = (key ^ (key >> np.uint64(29)) ^ least) * np.uint64(0x9E3779B97F4A7C15)
            keys[:, band] = key
        offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
        nodes = np.array([_node(x) for x in sets], dtype=np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(nodes), pa.array(sizes), lists], ["node", "size", "bands"])

    return F.arrow_udf(of, "struct<node:long,size:long,bands:array<long>>").asNondeterministic()(text)


def _node_and_shingles(text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts)
        nodes = np.array([_node(x) for x in sets], dtype=np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(nodes), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    return F.arrow_udf(of, "struct<node:long,shingles:binary>").asNondeterministic()(text)


def similar(sets: list[np.ndarray], least: float, joined: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Spanning links between sets of shared / all >= least, as numbers of the sets; each pair not joined yet is compared.

    Sets of one number in `joined` are joined already.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    root = np.arange(len(sets)) if joined is None else np.unique(joined, return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1, dtype=bool)
    left, right = [], []
    for i in range(len(sets) - 1):
        if (root == root[0]).all():
            break
        if not (root[i + 1 :] != root[i]).any():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        mark[own] = False
        # the quotient is the same as that of Python's whole numbers
        near = i + 1 + np.nonzero((shared / (sizes[i] + sizes[i + 1 :] - shared) >= least) & (root[i + 1 :] != root[i]))[0]
        fresh = near[np.unique(root[near], return_index=True)[1]]  # one link for each group that joins
        left += [i] * len(fresh)
        right += fresh.tolist()
        root[np.isin(root, root[near])] = root[i]
    return left, right


def _weight(most: int) -> Column:
    """What a member counts for: its shingles, and a `most`-th of a block's at least."""
    return F.greatest(F.col("size"), F.lit(-(-BLOCK_SHINGLES // most)))


def _members(posted: DataFrame, most: int) -> DataFrame:
    """(key, node, size, comp, sum): members of the lists of (key, node, size, comp) that aren't one component already.

    Lists of the same members count once. Sums are by groups, so no task holds a whole list.
    """
    mixed = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.sum(_weight(most)).alias("sum"), F.min("comp").alias("low"), F.max("comp").alias("high"), *mixed)
    kept = lists.where("n > 1 AND low < high").groupBy("n", "sum", "x0", "x1").agg(F.min("key").alias("key")).select("key", "sum")
    return cut(posted.join(kept, "key"))


def _blocks(members: DataFrame, most: int) -> DataFrame:
    """(key, block, node, size, comp): long lists by classes of size, and each class in as many parts as its sum asks for, by a hash."""
    classed = members.withColumn("class", F.floor(F.log("size") * CLASSES))
    parts = classed.groupBy("key", "class").agg(F.ceil(F.sum(_weight(most)) / BLOCK_SHINGLES).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
    parted = classed.join(parts, ["key", "class"]).withColumn("block", F.shiftleft("class", 40) + part)
    return parted.select("key", "block", "node", "size", "comp")


def band_tasks(posted: DataFrame, most: int, least: float) -> DataFrame:
    """Rows (key, a, b, node, comp): comparisons in which all members of each list of (key, node, size) meet.

    Each block of a long list is compared with itself and with each other one, but where no two sizes of theirs can
    reach `least`. So no list is too long: it has more tasks, as many as the square of its blocks.
    """
    posted = posted if "comp" in posted.columns else posted.withColumn("comp", F.col("node"))
    members = _members(posted, most)
    whole = members.where(F.col("sum") <= BLOCK_SHINGLES).withColumn("block", F.lit(0).cast("long"))
    members = whole.select("key", "block", "node", "size", "comp").unionAll(_blocks(members.where(F.col("sum") > BLOCK_SHINGLES), most))
    blocks = members.groupBy("key", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    one = blocks.select("key", F.col("block").alias("a"), F.col("high"))
    other = blocks.select("key", F.col("block").alias("b"), F.col("low"))
    # a little less than `least`, as the product is rounded
    pairs = one.join(other, "key").where((F.col("a") <= F.col("b")) & (F.col("high") >= (least - 1e-9) * F.col("low")))
    tasks = pairs.select("key", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return members.join(tasks, ["key", "block"]).select("key", "a", "b", "node", "comp")


def _inside(posted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Tasks of short lists and of each block of long ones by itself, and these blocks."""
    members = _members(posted, most)
    whole = members.where(F.col("sum") <= BLOCK_SHINGLES).select("key", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "node", "comp")
    blocks = cut(_blocks(members.where(F.col("sum") > BLOCK_SHINGLES), most))
    return whole.unionAll(blocks.select("key", F.col("block").alias("a"), F.col("block").alias("b"), "node", "comp")), blocks


def list_links(posted: DataFrame, sets_of, bands_of, most: int, least: float, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows (a, b): links that join all alike members of each list of (key, node, size, comp) that share a band.

    `known` are links found before, by which members of one comp are joined already; they come back with the others. Without
    `bands_of`, lists that would be posted again come back beside the links, as rows like those of `posted`.

    Short lists are compared whole, long ones block by block first. What a block joins is one component from then on, and
    one member of each component is compared with those of the others. A list of near copies is one component after
    that. Where a few members stay outside the largest component, they are compared with all of it. A list of many
    that are not alike (of pages with one boilerplate, say) is posted again under other minima, which few of them
    share, so its work stays near its length; what is still long after LEVELS turns is compared block by block.
    """
    found: list[DataFrame] = [] if known is None else [known]

    def compare(tasks: DataFrame) -> None:
        tasks = cut(tasks)
        found.append(cut(similar_links(tasks, sets_of(tasks), least)))

    def joined(rows: DataFrame) -> DataFrame:
        comps = connected_components(functools.reduce(DataFrame.unionAll, found), "a", "b")
        return cut(rows.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))

    for level in range(LEVELS + 1):
        tasks, blocks = _inside(posted, most)
        compare(tasks)
        if blocks.isEmpty():
            break
        blocks = joined(blocks)
        heads = blocks.groupBy("key", "comp").agg(F.min(F.struct("node", "size")).alias("head"))
        compare(_inside(heads.select("key", "head.node", "head.size", "comp"), most)[0])
        blocks = joined(blocks)
        sums = blocks.groupBy("key", "comp").agg(F.sum(_weight(most)).alias("w")).groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("all"), F.max(F.struct("w", "comp")).alias("top"))
        open_lists = sums.where("n > 1").select("key", F.col("top.comp").alias("largest"), (F.col("all") - F.col("top.w")).alias("others"))
        left = cut(blocks.join(open_lists, "key"))
        if left.isEmpty():
            break
        narrow, wide = left.where(F.col("others") <= BLOCK_SHINGLES), left.where(F.col("others") > BLOCK_SHINGLES)
        outside = F.col("comp") != F.col("largest")
        largest = narrow.where(~outside)
        own = lambda rows: rows.select("key", F.lit(-1).cast("long").alias("a"), F.col("block").alias("b"), "node", "comp")
        compare(own(largest).unionAll(own(narrow.where(outside).drop("block").join(largest.select("key", "block").distinct(), "key"))))
        if wide.isEmpty():
            break
        wide = wide.select("key", "node", "size", "comp")
        if bands_of is None:
            return functools.reduce(DataFrame.unionAll, found), wide
        if level == LEVELS:
            compare(band_tasks(wide, most, least))
            break
        bands = bands_of(wide.select("node").distinct(), level + 1)
        posted = wide.join(bands, "node").select(F.xxhash64("key", F.col("band")).alias("key"), "node", "size", "comp").distinct()
    return functools.reduce(DataFrame.unionAll, found), None


def similar_links(tasks: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Rows (a, b) between nodes of (node, shingles) that are alike, spanning each task of (key, a, b, node, comp).

    Nodes of one `comp` are joined already and aren't compared.
    """

    def compared(batches):
        task, nodes, members, joined = None, [], [], []

        def links():
            left, right = similar(members, least, joined) if len(members) > 1 else ([], [])
            return pa.record_batch([pa.array([nodes[k] for k in side], pa.int64()) for side in (left, right)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("key", "a", "b")), strict=True)
            for key, node, comp, shingles in zip(keys, batch["node"].to_pylist(), batch["comp"].to_pylist(), batch["shingles"], strict=True):
                if key != task:
                    if len(nodes) > 1:
                        yield links()
                    task, nodes, members, joined = key, [], [], []
                nodes.append(node)
                joined.append(comp)
                members.append(np.frombuffer(shingles.as_py(), dtype=np.uint64))
        if len(nodes) > 1:
            yield links()

    # a task's members follow each other within one partition
    dealt = tasks.join(sets, "node").select("key", "a", "b", "node", "comp", "shingles").repartition("key", "a", "b")
    return dealt.sortWithinPartitions("key", "a", "b", "node").mapInArrow(compared, "a long, b long")


def fingerprint_groups(printed: DataFrame) -> DataFrame:
    """Lists of (key, node, size, comp): nodes of (fp, node, size) whose fingerprints the byte-position index joins.

    Any two within MAX_BITS are in one list. Sets without shingles are one node and in none.
    """
    nodes = printed.where("size > 0").select("fp", "node", "size").distinct()
    joined = connected_components(links(nodes.select("fp").distinct()), "a", "b").withColumnRenamed("node", "fp")
    key = F.coalesce("component", "fp").alias("key")
    return nodes.join(joined, "fp", "left").select(key, "node", "size", F.col("node").alias("comp")).distinct()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST, least: float = SIMILAR) -> DataFrame:
    """Rows (doc_id, print, node, component, component_id) for texts of similar five-word shingles, exact copies included.

    Two texts are linked where their fingerprints are joined within MAX_BITS or they share a band, and they share at
    least `least` of all their distinct shingles; copies are what links join. Fingerprints come first, bands are for
    what these left apart. `print` stands for a text, `node` for a set of shingles, `component` for a group of copies
    and component_id is its smallest doc_id. Null and empty texts are copies of each other.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = text_print(F.col("text")).alias("print"), fingerprint(F.col("text")).alias("fp"), _banded(F.col("text")).alias("p")
    printed = cut(named.select("doc_id", *prints).select("doc_id", "print", "fp", "p.*"))
    first = printed.groupBy("node").agg(F.min("doc_id").alias("first"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        holders = first.join(nodes, "node", "left_semi").select("first").distinct()
        return named.join(holders, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")

    def sets_of(tasks: DataFrame) -> DataFrame:
        nodes = tasks.select("node").distinct()
        sets = texts_of(nodes).select(_node_and_shingles(F.col("text")).alias("s")).select("s.*").join(nodes, "node", "left_semi")
        return sets.groupBy("node").agg(F.first("shingles").alias("shingles"))

    def bands_of(nodes: DataFrame, level: int) -> DataFrame:
        banded = texts_of(nodes).select(_banded(F.col("text"), level).alias("p")).select("p.node", F.explode("p.bands").alias("band"))
        return banded.join(nodes, "node", "left_semi").distinct()

    alike, wide = list_links(fingerprint_groups(printed), sets_of, None, most, least)
    joined = connected_components(alike, "a", "b")
    nodes = printed.select("node", "size", "bands").dropDuplicates(["node"]).join(joined, "node", "left")
    posted = nodes.select("node", "size", F.explode(F.array_distinct("bands")).alias("key"), F.coalesce("component", "node").alias("comp"))
    found = list_links(posted if wide is None else posted.unionByName(wide), sets_of, bands_of, most, least, alike)[0]
    return _components(printed.select("doc_id", "print", "node"), first, found, ["node"])
