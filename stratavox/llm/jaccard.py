"""N-gram Jaccard join: pivots, regions and triangle-inequality windows, joined recursively and exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import giving_back, materialise, remove, small_batches

#: Sizes are dealt to levels whose bounds grow by this factor, or by 100 / percent where that is more.
LADDER = 2
#: Classes of a level, as a multiple of the fullest classes that its largest sets name.
FINER = 1.5
#: Slots (as powers of two) of the tables that keep sets and regions without a partner out of later passes.
SET_BITS, REGION_BITS = 22, 26
#: Passes in which the pivots of regions are found.
PASSES = 2
#: Further pivots that a region with several components is split by at once: the member next to its pivot, and others by chance.
PIVOTS = 2
#: Bytes of texts that are cut up at once: each takes some ten bytes of shingles and regions meanwhile.
TEXT_BYTES = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, flat, and the ends of each text.

    A to Z are lower-cased. A text with fewer words than ``width`` has its whole sequence as one
    shingle; one without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(rolled)])
    out, ends = [], np.zeros(len(texts), np.int64)
    total = 0
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        if b - a >= width:
            s = np.unique(rolled[a : b - width + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            s = h
        else:
            s = words[:0]
        out.append(s)
        total += len(s)
        ends[i] = total
    return (np.concatenate(out) if out else rolled[:0]), ends


class Regions:
    """Which regions a set belongs to, such that two linked sets share one.

    The metric is the symmetric difference |x - y| + |y - x|. Sets at Jaccard similarity t or more
    differ in at most (|x| + |y|) (1 - t) / (1 + t) shingles. Hashing the shingles to m classes
    splits that distance into a sum over the classes, so all but as many classes as the bound hold
    exactly the same shingles of both: there x and y lie at distance 0. A region is a class with its
    content. In one order of all regions, fullest first, the first ones of x and of y, one more than
    the bound, must then have one in common; a set belongs to those only, which leaves out the
    classes of few shingles that unlike sets share by chance.

    The empty set is the first pivot: |x| is the distance to it, levels are its shells, and a set
    within reach of the shell below is replicated there (the triangle inequality on sizes).
    """

    def __init__(self, percent: int):
        self.percent = percent
        lower = [1]
        # Sizes of linked sets lie at most one level apart: the next level but one starts beyond the reach of this one.
        while lower[-1] < 1 << 40:
            lower.append(max(lower[-1] * LADDER, lower[-1] * 100 // percent + 1))
        self.lower = np.array(lower, np.int64)
        self.classes = np.floor(FINER * (100 - percent) / percent * (self.lower[1:] - 1) + 1e-9).astype(np.int64) + 1

    def bound(self, sizes: np.ndarray, partner: np.ndarray) -> np.ndarray:
        """Most shingles that sets of ``sizes`` can differ in from linked ones of ``partner`` shingles at most."""
        return np.floor((sizes + partner) * (100 - self.percent) / (100 + self.percent) + 1e-9).astype(np.int64)

    def of(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat region keys (int64) and the ends of each set. Sets that link with equal ones only have none."""
        n = np.diff(ends, prepend=0)
        level = np.searchsorted(self.lower, n, "right") - 1
        keys, owners = [], []
        for shift in (0, 1):
            at = level - shift
            top = self.lower[np.maximum(at, 0) + 1] - 1
            partner = top if shift else np.floor(n * 100 / self.percent + 1e-9)
            differ = self.bound(n, partner)
            rows = np.flatnonzero((n > 0) & (at >= 0) & (differ > 0) & ((n * self.percent <= top * 100) if shift else True))
            if not len(rows):
                continue
            m = np.maximum(self.classes[at[rows]], 1)
            named = np.minimum(differ[rows] + 1, m)
            first = np.cumsum(m) - m
            sizes = n[rows]
            item = np.arange(sizes.sum()) + np.repeat(ends[rows] - sizes - (np.cumsum(sizes) - sizes), sizes)
            h = flat[item]
            slot = np.repeat(first, sizes) + ((h >> np.uint64(33)) % np.repeat(m, sizes).astype(np.uint64)).astype(np.int64)
            content, count = np.zeros(m.sum(), np.uint64), np.bincount(slot, minlength=m.sum())
            np.add.at(content, slot, _mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            owner = np.repeat(np.arange(len(rows)), m)
            place = np.arange(m.sum()) - np.repeat(first, m)
            key = _mix(content + np.repeat(at[rows], m).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            # Set, fullness and 24 bits of the key in one number. What ties with the last one named is named too, so the order is one for all sets.
            order = owner.astype(np.uint64) << np.uint64(32) | (np.uint64(255) - np.minimum(count, 255).astype(np.uint64)) << np.uint64(24) | key >> np.uint64(40)
            keep = order <= np.sort(order)[first + named - 1][owner]
            keys.append(key[keep].view(np.int64))
            owners.append(rows[owner[keep]])
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return key[order], np.searchsorted(owner[order], np.arange(len(ends)), "right")


def _list_array(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


def _parts(batch: pa.RecordBatch, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of together about ``most`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _set_ids(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit id per set, from the sum of its hashes and its size; 0 for the empty set."""
    n = np.diff(ends, prepend=0)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(flat + np.uint64(77)), dtype=np.uint64)])
    own = _mix(sums[ends] - sums[ends - n] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(n > 0, own, np.uint64(0)).view(np.int64)


def describe(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id and regions of each row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions = Regions(percent)
        for batch in batches:
            for part in _parts(batch):
                flat, ends = shingle_sets(part.column("text"), width)
                keys, key_ends = regions.of(flat, ends)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends, prepend=0)), pa.array(_set_ids(flat, ends)), _list_array(keys, key_ends)],
                    names=["doc_id", "n_shingles", "set_id", "regions"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lambda batches: giving_back(rows(batches)), "doc_id long, n_shingles long, set_id long, regions array<long>")


def _slot(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits)).cast("int")


def _bit_table(rows: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """A bit for each of 2^bits slots, set where a row has it: a table of fixed size, made by partial bitmaps."""
    at = (slot + 1).alias("at")
    parts = rows.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, data in parts.collect():
        own = np.frombuffer(bytes(data), np.uint8)
        table[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(own)] = own[: len(table)]
    return table


def _has(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """set_id and shingles (array<long>) of the documents ``wanted`` (doc_id), and of a few more.

    A bit table of fixed size goes to the tasks and keeps nearly all other texts from being cut up.
    """
    table = _bit_table(wanted, _slot("doc_id", SET_BITS), SET_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_has(table, batch.column("slot").to_numpy())))
            for part in _parts(batch):
                flat, ends = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(flat, ends)), _list_array(flat.view(np.int64), ends)], names=["set_id", "shingles"])

    plain = docs.select(_slot("doc_id", SET_BITS).alias("slot"), F.col("text").cast("string").alias("text")).filter("slot is not null")
    return plain.mapInArrow(lambda batches: giving_back(rows(batches)), "set_id long, shingles array<long>")


def shared_regions(described: DataFrame) -> DataFrame:
    """g, x: the pivot of each region, its least set, with every set of the region, itself included.

    Regions of one set are left out. Least and greatest set of a region are map-side aggregates;
    the members come by an equi-join whose large partitions Spark splits. A bit table of fixed size
    (``REGION_BITS``) spares most regions of one set that second shuffle.
    """
    keyed = described.select(F.explode("regions").alias("region"), "set_id")
    found = keyed.groupBy("region").agg(F.min("set_id").alias("g"), F.max("set_id").alias("other")).filter("g < other").select("region", "g")
    # A pass for each part of the regions: only its shuffle is on disk at a time.
    passes = [materialise(found.filter(F.pmod("region", F.lit(PASSES)) == k), f"region_pivots_{k}") for k in range(PASSES)]
    pivots = reduce(DataFrame.unionByName, passes)
    mask = (1 << REGION_BITS) - 1
    table = _bit_table(pivots, F.col("region").bitwiseAND(F.lit(mask)).cast("int"), REGION_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("regions")
            region = lists.flatten().to_numpy()
            own = np.repeat(batch.column("set_id").to_numpy(), np.diff(lists.offsets.to_numpy()))
            keep = _has(table, region & mask)
            yield pa.RecordBatch.from_arrays([pa.array(region[keep]), pa.array(own[keep])], names=["region", "x"])

    some = described.filter(F.size("regions") > 0).select("regions", "set_id").mapInArrow(lambda batches: giving_back(rows(batches)), "region long, x long")
    return materialise(some.join(pivots, "region").select("g", "x").distinct(), "groups")


def _side_by_side(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b: set ids, and further columns) with the shingles of both (x, y). Equi-joins only."""
    # Both joins take ``sets`` as it is, by its own key, so that Spark shuffles it once for the two.
    some = pairs.select(F.col("a").alias("set_id")).distinct().join(sets, "set_id").select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    with_b = pairs.withColumnRenamed("b", "set_id").join(sets, "set_id").withColumnsRenamed({"set_id": "b", "shingles": "y"})
    return with_b.join(some, "a")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common, union and r (symmetric difference) of each pair: exact sizes."""
    common = F.size(F.array_intersect("x", "y")).cast("long")
    out = _side_by_side(pairs, sets).select("a", "b", common.alias("common"), (F.size("x") + F.size("y") - common).alias("union"))
    # Copies of one set may have been read from several documents; their figures are equal.
    out = out.groupBy("a", "b").agg(F.max("common").alias("common"), F.max("union").alias("union"))
    return out.withColumn("r", F.col("union") - F.col("common"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node) of a graph given by ``edges`` (a, b); nodes without edges are absent.

    Each node hooks to its least neighbour, chains are shortened by doubling, and the graph of the
    roots that are left is solved the same way. Minima are taken map-side first, so a node with
    very many edges is no burden. Each step is written to the shared folder. Only counts come to
    the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).select("node", F.least("node", "parent").alias("component"))
    least = materialise(least, "hooks")
    while True:
        upper = least.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = materialise(least.join(upper, "component").select("node", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved")), "jumps")
        least = jumped.select("node", "component")
        if jumped.filter("moved").isEmpty():
            break
    name = lambda c: least.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root"))
    cross = edges.join(name("a"), "a").join(name("b"), "b").filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    cross = materialise(cross.distinct(), "cross")
    if cross.isEmpty():
        return least
    upper = components(cross).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return materialise(least.join(upper, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.filter(F.col("common") * 100 >= F.col("union") * percent).select("a", "b")


def open_members(cells: DataFrame, percent: int) -> DataFrame:
    """The members of cells (cell, q, x, d, component) that may still link with one of another component there.

    Linked sets lie within 1 - t of each other as seen from the cell's pivot. So cells are cut into
    rings of that width around it, and what finds no second component in its own ring and the two
    beside it is done, as are pairs with the pivot itself.
    """
    rings = cells.filter("x <> q").withColumn("ring", F.floor(F.col("d") * 100 / (100 - percent) + 1e-9))
    ends = rings.groupBy("cell", "ring").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    beside = ends.select("cell", F.explode(F.array(*[F.col("ring") + k for k in (-1, 0, 1)])).alias("ring"), "lo", "hi")
    beside = beside.groupBy("cell", "ring").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("cell", "ring")
    return materialise(rings.join(beside, ["cell", "ring"], "left_semi").drop("ring"), "open")


def split_cells(cells: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The cells (cell, q, x, d, component) split by further pivots, and the links (a, b) met on the way.

    q is the pivot of a cell, already measured against all its members x. The member next
    to it becomes a pivot too (what is near to a member with changes of its own has few itself, so it
    lies in the middle), and so do the least members of other components (ids are hashes, so by
    chance), ``PIVOTS`` in all. Every member belongs to the Voronoi cell of its
    nearest pivot, and is replicated to each cell whose pivot is farther away by 2 (1 - t) at most:
    for x linked to y, p' next to x and p next to y, d(x, p) <= d(x, y) + d(y, p) <= (1 - t) + d(y, p')
    and d(y, p') <= (1 - t) + d(x, p'). So linked sets meet in a cell. Where one cell would keep all
    members, the cell stays as it was. Pivots have been measured against all members of the cell, so
    they are no members of its parts.
    """
    first = cells.groupBy("cell", "component").agg(F.min("x").alias("p"), F.min(F.struct("d", "x")).alias("next"))
    by_chance, by_distance = (F.row_number().over(Window.partitionBy("cell").orderBy(c)) for c in ("p", "next"))
    first = first.withColumns({"place": by_chance, "distance": by_distance})
    chosen = first.filter("distance = 1").select("cell", F.col("next.x").alias("p")).unionByName(first.filter((F.col("place") < PIVOTS) & (F.col("distance") > 1)).select("cell", "p"))
    chosen = materialise(chosen, "pivots")
    pairs = cells.join(chosen, "cell").filter("x <> p").select("cell", "x", "p")
    measured = materialise(_measured(pairs.select(F.col("p").alias("a"), F.col("x").alias("b")).distinct(), sets), "measured")
    seen = pairs.join(measured.select(F.col("a").alias("p"), F.col("b").alias("x"), (1 - F.col("common") / F.col("union")).alias("d")), ["p", "x"])
    rest = cells.join(chosen.select("cell", F.col("p").alias("x")), ["cell", "x"], "left_anti").select("cell", "q", "x", "d")
    every = seen.join(chosen.select("cell", F.col("p").alias("x")), ["cell", "x"], "left_anti").select("cell", F.col("p").alias("q"), "x", "d").unionByName(rest)
    own = Window.partitionBy("cell", "x")
    near = F.col("d") <= F.min("d").over(own) + F.lit(2 * (100 - percent) / 100 + 1e-9)
    # The first pivot whose cell would keep all members is found by counts of the kept rows.
    every = materialise(every.withColumn("inside", near), "distances")
    counts = every.groupBy("cell", "q").agg(F.count("*").alias("members"), F.count_if("inside").alias("kept")).groupBy("cell").agg(F.max(F.col("kept") == F.col("members")).alias("whole"))
    every = every.join(counts, "cell")
    parts = every.filter("inside and not whole").select(F.xxhash64("cell", "q").alias("cell"), "q", "x", "d")
    kept = rest.join(counts.filter("whole").select("cell"), "cell", "left_semi")
    return materialise(parts.unionByName(kept), "cells"), _linked(measured, percent)


def _differences(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """g, q, id, component, n, n_q, near, r, k, u, e of the members of cells: how they differ from the cell's pivot q."""
    t = percent / 100
    c = (1 - t) / (1 + t)
    pairs = split.select(F.col("cell").alias("g"), F.col("q").alias("a"), F.col("x").alias("b"), "component")
    both = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    near = (F.size(F.array_intersect("x", "y")) * 100 >= F.size(F.array_union("x", "y")) * percent).alias("near")
    seen = _side_by_side(pairs, sets).select("g", F.col("a").alias("q"), F.col("b").alias("id"), "component", F.size("y").alias("n"), F.size("x").alias("n_q"), near, both.alias("e"))
    seen = seen.dropDuplicates(["g", "id"]).withColumn("r", F.size("e"))
    return materialise(seen.withColumns({"k": F.floor(F.col("n") * (1 - t) / t + 1e-9), "u": F.col("r") - F.col("n") * c}), "differences")


def _ordered(seen: DataFrame) -> DataFrame:
    """``seen`` with the elements that also others of the cell have, rare ones first, in place of all (e)."""
    items = seen.select("g", "id", F.explode("e").alias("e"))
    often = items.groupBy("g", "e").agg(F.count("*").alias("often")).filter("often > 1")
    order = items.join(often, ["g", "e"]).groupBy("g", "id").agg(F.array_sort(F.collect_list(F.struct("often", "e"))).alias("order"))
    return materialise(seen.drop("e").join(order, ["g", "id"]), "ordered")


def _first_elements(ordered: DataFrame, overlap: Column) -> DataFrame:
    """The members once for each of their first elements: those in which a set must meet them that has ``overlap`` in common.

    Elements that no other set has come first of all and meet nothing.
    """
    first = F.least(F.size("order"), F.size("order") - F.greatest(F.lit(1), F.ceil(overlap - 1e-9)) + 1).cast("int")
    rows = ordered.withColumn("first", first).filter("first > 0")
    # What lies behind the first elements, and the last of them.
    rows = rows.withColumns({"rest": F.size("order") - F.col("first"), "last": F.element_at("order", F.col("first")), "firsts": F.transform(F.slice("order", F.lit(1), F.greatest(F.col("first"), F.lit(0))), lambda o: o["e"])})
    return rows.select("g", "id", "component", "r", "n", "rest", "last", "firsts", F.explode("firsts").alias("e"))


def _met(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in first elements and may have enough in common.

    Their sizes and distances must lie in the windows of the triangle inequality. All elements in
    common up to the earlier one of the two last first elements are met; behind it there are at most
    as many as that set has left. A pair meets once in a cell, in the first element that both have
    among their first ones.
    """
    c = (100 - percent) / (100 + percent)
    side = lambda rows, k: rows.select(*[x if x in ("g", "e") else F.col(x).alias(f"{x}{k}") for x in rows.columns])
    bound = c * (F.col("n1") + F.col("n2")) + 1e-6
    window = (F.abs(F.col("r1") - F.col("r2")) <= bound) & (F.col("n1") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n1") * percent)
    other = (F.col("component1") != F.col("component2")) & ((F.col("id1") < F.col("id2")) if left is right else F.lit(True))
    behind = F.when(F.col("last1") <= F.col("last2"), F.col("rest1")).otherwise(F.col("rest2"))
    spare = behind - (F.col("r1") + F.col("r2") - bound) / 2
    shared = F.array_intersect("firsts1", "firsts2")
    once = (F.element_at(shared, 1) == F.col("e")) & (F.size(shared) + spare >= 0)
    pairs = side(left, 1).join(side(right, 2), ["g", "e"]).filter(other & window & once)
    return pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))


def apart_pairs(seen: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a cell that may link by differences in common; none that does is left out.

    For sets x and y with differences E and F from the cell's pivot q, the difference of x and y is
    that of E and F, |E| + |F| - 2 |E and F|, and at most b = c (|x| + |y|) with c = (1 - t) / (1 + t)
    if they link. Sets that link with q are of one component, so one of the two, say y, does not:
    |F| > c (|y| + |q|), and |F| - c |y| is at least the least such value of the cell, v. So x needs
    |E and F| >= (|E| - c |x| + v) / 2. In any case x needs |E| - b, for |E and F| <= |F| and
    |E| - |F| <= b.
    """
    c = (100 - percent) / (100 + percent)
    least = seen.filter("not near").groupBy("g").agg(F.greatest(F.min("u"), F.min("n_q") * c).alias("v"))
    ordered = _ordered(seen.join(least, "g"))
    any_ = F.col("r") - F.col("k")
    beside_far = F.greatest((F.col("u") + F.col("v")) / 2, any_)
    far = materialise(_first_elements(ordered.filter("not near"), beside_far), "far")
    far_near = materialise(_first_elements(ordered.filter("not near"), any_), "far_near")
    near = materialise(_first_elements(ordered.filter("near"), beside_far), "near")
    remove(seen.sparkSession, ordered)
    pairs = materialise(_met(far, far, percent).unionByName(_met(far_near, near, percent)).distinct(), "apart_pairs")
    for table in (far, far_near, near):
        remove(seen.sparkSession, table)
    return pairs


def link(docs: DataFrame, percent: int = 80, width: int = 5, rounds: int = 1) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    Two documents link when 100 * |x and y| >= ``percent`` * |x or y| for their sets of distinct
    ``width``-word shingles; every link between different sets counts, found exactly:

    1. Equal sets are one node. Sets are dealt to regions (see ``Regions``); linked sets share one.
       The least set of a region is its pivot, and all its sets are measured against it.
    2. Of regions that hold several components, the sets that may still link with another one (see
       ``open_members``) are split into Voronoi cells of further pivots, boundary sets replicated
       by the triangle inequality, and these cells again, ``rounds`` times (see ``split_cells``).
    3. Cells that are still open are joined by how their sets differ from one in their middle.
       A set whose difference leaves room for that of the cell's best placed set links with it
       (one such set speaks for all pairs that need no common difference). Other sets link only if
       their differences have enough in common; those that may are compared pair by pair, within
       the windows of the triangle inequality.
    4. Components come from the links; a pair inside a component needs no comparison.

    Null and empty texts, and those without words, have no shingles and link with nothing. Repeated
    rows count each. A null doc_id keeps its row; it names no component. Extra columns are ignored;
    an empty table gives no rows. Texts are read whole; no group of documents is gathered in one
    task, and no partner or candidate is left out.
    """
    with small_batches(docs.sparkSession):
        described = materialise(describe(docs, percent, width), "sets")
        groups = shared_regions(described)
        wanted = described.join(groups.select(F.col("x").alias("set_id")).distinct(), "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
        sets = materialise(sets_of(docs, wanted, width), "shingles")
    # The regions, most of what is written so far, are not needed any more.
    fat, described = described, materialise(described.select("doc_id", "n_shingles", "set_id"), "documents")
    remove(docs.sparkSession, fat)
    measured = materialise(_measured(groups.filter("g <> x").select(F.col("g").alias("a"), F.col("x").alias("b")), sets), "measured")
    edges = materialise(_linked(measured, percent), "edges")
    found = components(edges)

    def named(rows: DataFrame, column: str) -> DataFrame:
        own = found.select(F.col("node").alias(column), F.col("component").alias("__c"))
        return rows.join(own, column, "left").withColumn("component", F.coalesce("__c", column)).drop("__c")

    def learn(links: DataFrame) -> None:
        """Join the components that ``links`` (a, b) connect."""
        nonlocal found
        ends = named(named(links, "a").withColumnRenamed("component", "c"), "b").filter("c <> component")
        cross = materialise(ends.select(F.col("c").alias("a"), F.col("component").alias("b")).distinct(), "cross")
        if cross.isEmpty():
            return
        joined = components(cross).select(F.col("node").alias("component"), F.col("component").alias("root"))
        alone = joined.join(found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("root").alias("component"))
        known = found.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        found = materialise(known.unionByName(alone), "components")

    cells = measured.select(F.col("a").alias("cell"), F.col("a").alias("q"), F.col("b").alias("x"), (1 - F.col("common") / F.col("union")).alias("d"))
    split = open_members(named(cells, "x"), percent)
    for _ in range(rounds):
        if split.isEmpty():
            break
        cells, links = split_cells(split, sets, percent)
        learn(links)
        split = open_members(named(cells, "x"), percent)
    if not split.isEmpty():
        # Seen from the member next to the pivot, for the reason given above.
        middle = split.groupBy("cell").agg(F.min(F.struct("d", "x"))["x"].alias("q"))
        differences = _differences(split.drop("q").join(middle, "cell").filter("x <> q"), sets, percent)
        seen = differences
        learn(seen.filter("near").select(F.col("q").alias("a"), F.col("id").alias("b")))
        seen = named(seen.drop("component", "q"), "id")
        best = seen.groupBy("g").agg(F.min(F.struct("u", "id")).alias("z")).select("g", F.col("z.id").alias("z"), F.col("z.u").alias("z_u"))
        sure = seen.join(best, "g").filter((F.col("u") + F.col("z_u") <= 1e-6) & (F.col("id") != F.col("z"))).select(F.col("z").alias("a"), F.col("id").alias("b"))
        learn(_linked(_measured(sure.distinct(), sets), percent))
        pairs = apart_pairs(named(seen.drop("component"), "id"), percent)
        remove(docs.sparkSession, differences)
        learn(_linked(_measured(pairs, sets), percent))

    # Every set's least document, then every component's, then the documents by their sets.
    own = described.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least_id"))
    own = materialise(named(own, "set_id"), "set_names")
    names = materialise(own.groupBy("component").agg(F.min("least_id").alias("name")), "component_names")
    own = materialise(own.join(names, "component").select(F.col("set_id").alias("own_set"), "name"), "names")
    rows = described.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("own_set")).join(own, "own_set", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("name")), F.col("doc_id")).alias("component_id"))
