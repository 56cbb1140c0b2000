"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most d bits agree in one of d + 1 blocks of bits, so they
are grouped by such a masked pattern.  In a group they are sorted by Gray rank and cut into
a tree whose nodes hold the bits their fingerprints share (mask and pattern); pairs of nodes
whose shared bits already differ in more than d places are dropped whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeloom.llm.common import HIGHEST, saved

BITS = 64
# A group of more fingerprints is split by further blocks of bits.
GROUP_ROWS = 20_000
# Groups with no more bits than these free are not split: they have 2^14 members at most.
FEW_BITS = 14
ALL_BITS = (1 << BITS) - 1
LEAF, FAN = 16, 8  # fingerprints under a lowest node, nodes under an upper one
PIECE = 100_000  # words hashed at a time
BATCH_PAIRS = 1 << 16  # pairs of nodes looked at together


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64 bits of a text, as an unsigned number.

    A-Z in lower case, words between ASCII white space, every shingle of ``shingle`` words
    (repeats included; a shorter text is one shingle) hashed by XXH64; a bit is set if more
    than half of the hashes set it.  No words: 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    total, ones = 0, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, PIECE):
        part = words[at : at + PIECE + size - 1]
        ends = np.cumsum([len(w) + 1 for w in part])
        flat = b" ".join(part)
        starts = [0, *ends[: len(part) - size].tolist()]
        stops = (ends[size - 1 :] - 1).tolist()
        found = np.array([digest(flat[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(found)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("_text")], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(bits.view(np.int64))], names=["_id", "_bits"]
        )


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Where a code stands in Gray order: neighbours differ in one bit."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Fingerprints in Gray order; each node: the bits all below share, and which these are."""

    def __init__(self, bits: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(bits), kind="stable")
        self.bits = bits[self.order]
        ones, zeros, width = self.bits, ~self.bits, LEAF
        self.levels = []  # from the lowest: mask, pattern, fan
        while True:
            starts = np.arange(0, len(ones), width)
            ones = np.bitwise_and.reduceat(ones, starts)
            zeros = np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones | zeros, ones, width))
            if len(starts) == 1:
                return
            width = FAN

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in Gray order) of the pairs that differ in at most ``distance`` bits."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > BATCH_PAIRS:
                half = len(a) // 2
                todo += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            mask, pattern, fan = self.levels[level]
            # Differences in the bits that both sides share count for all pairs below.
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
            a, b = a[apart <= distance], b[apart <= distance]
            count = len(self.levels[level - 1][0]) if level else len(self.bits)
            for at in range(0, len(a), BATCH_PAIRS // fan):
                x = a[at : at + BATCH_PAIRS // fan, None, None] * fan + np.arange(fan)[:, None]
                y = b[at : at + BATCH_PAIRS // fan, None, None] * fan + np.arange(fan)[None, :]
                x, y = np.broadcast_arrays(x, y)
                ok = (y < count) & (x <= y if level else x < y)
                x, y = x[ok], y[ok]
                if level:
                    todo.append((level - 1, x, y))
                    continue
                near = np.bitwise_count(self.bits[x] ^ self.bits[y]) <= distance
                yield x[near], y[near]


def _join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by the smaller place, for all pairs at once, until nothing changes."""
    while len(a):
        ra, rb = _roots(parent, a), _roots(parent, b)
        open_ = ra != rb
        a, b = a[open_], b[open_]
        low, high = np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]
        np.minimum.at(parent, high, low)


def _roots(parent: np.ndarray, a: np.ndarray) -> np.ndarray:
    r = parent[a]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


TREE_FAN = 32


def group_links(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``distance`` in a group, fewer than its members.

    Members of a connected set hang from each other in a tree of fan 32, so no
    fingerprint has many links and none is far from another.
    """
    tree = GrayTree(bits)
    parent = np.arange(len(bits))
    for a, b in tree.links(distance):
        _join_sets(parent, a, b)
    root = _roots(parent, np.arange(len(bits)))
    order = np.argsort(root, kind="stable")
    sorted_root = root[order]
    first = np.searchsorted(sorted_root, sorted_root)
    place = np.arange(len(order)) - first
    child = np.flatnonzero(place)
    up = first[child] + (place[child] - 1) // TREE_FAN
    own = tree.bits[order]
    return own[child], own[up]


def _group_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by mask and pattern: the links of each group, one group in memory."""
    held: list[np.ndarray] = []
    key = None

    def close() -> Iterator[pa.RecordBatch]:
        bits = np.concatenate(held) if held else np.zeros(0, np.int64)
        if len(bits) > 1:
            a, b = group_links(bits.view(np.uint64), distance)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["_a", "_b"]
                )

    for batch in batches:
        if not batch.num_rows:
            continue
        mask, pattern, bits = (batch.column(c).to_numpy() for c in ("_mask", "_pattern", "_bits"))
        new = (np.diff(mask) != 0) | (np.diff(pattern) != 0)
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            if (mask[lo], pattern[lo]) != key:
                yield from close()
                held, key = [], (mask[lo], pattern[lo])
            held.append(bits[lo:hi])
    yield from close()


def _blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the set bits of ``free`` into ``parts`` blocks, lowest bits first."""
    places = [i for i in range(BITS) if free >> i & 1]
    cuts = [len(places) * i // parts for i in range(parts + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(prints: DataFrame, distance: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(_a, _b) between distinct fingerprints ``_bits``, such that two are connected by links
    if and only if they are connected by steps of at most ``distance`` bits.

    Each fingerprint goes to the groups of its ``distance + 1`` blocks.  Groups of more than
    ``group_rows`` are counted first and go on to finer ones instead, by the same rule over
    the bits that are still free; as all fingerprints differ, a group of n free bits has at
    most 2^n, which ends the splitting after six levels whatever the data.
    """
    spark = prints.sparkSession
    level = None
    masks = [0]  # the masks of the groups to be split
    links = []
    while masks:
        finer = [
            (_signed(mask), [_signed(mask | b) for b in _blocks(~mask & ALL_BITS, distance + 1)])
            for mask in masks
        ]
        if masks == [0]:
            first = F.array(*[F.lit(m).cast("long") for m in finer[0][1]])
            rows = prints.select(F.explode(first).alias("_mask"), "_bits")
        else:
            # At most (distance + 1) ^ 6 masks, as masks that leave few bits free are not split.
            pieces = F.broadcast(spark.createDataFrame(finer, "_mask long, _finer array<long>"))
            rows = level.join(pieces, "_mask").select(F.explode("_finer").alias("_mask"), "_bits")
        rows = rows.withColumn("_pattern", F.col("_mask").bitwiseAND(F.col("_bits")))
        if masks != [0]:
            rows = rows.distinct()  # a finer group can be reached over several coarser ones
        large = saved(
            rows.groupBy("_mask", "_pattern")
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter((F.col("_n") > group_rows) & (F.bit_count("_mask") < BITS - FEW_BITS))
            .select("_mask", "_pattern"),
            "simhash-large",
        )
        large_masks = [r["_mask"] for r in large.select("_mask").distinct().collect()]
        small = rows if not large_masks else rows.join(large, ["_mask", "_pattern"], "left_anti")
        links.append(
            small.repartition("_mask", "_pattern")
            .sortWithinPartitions("_mask", "_pattern")
            .mapInArrow(lambda batches: _group_links(batches, distance), "_a long, _b long")
        )
        if large_masks:
            level = saved(
                rows.join(large, ["_mask", "_pattern"], "left_semi").select("_mask", "_bits"),
                "simhash-level",
            )
        masks = sorted(m & ALL_BITS for m in large_masks)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(_node, _root) for every end of a link: the smallest node it is connected with.

    Each round every node looks at its neighbours' grandparents and hooks itself and its
    parent to the smallest, which halves the longest way at least; rounds are written to the
    shared folder.  Links are few per node, and sums over a common parent are made map-side.
    """
    both = saved(
        links.select(F.col("_a").alias("_node"), F.col("_b").alias("_other")).union(
            links.select(F.col("_b"), F.col("_a"))
        ),
        "component-links",
    )
    state = saved(
        both.groupBy("_node").agg(F.least(F.min("_other"), F.first("_node")).alias("_up")),
        "component-state",
    )
    while True:
        up = state.select(F.col("_node").alias("_up"), F.col("_up").alias("_top"))
        grand = state.join(up, "_up").select("_node", "_up", "_top")
        seen = both.join(
            grand.select(F.col("_node").alias("_other"), F.col("_top").alias("_low")), "_other"
        ).groupBy("_node").agg(F.min("_low").alias("_low"))
        step = grand.join(seen, "_node").select(
            "_node", "_up", F.least("_top", "_low").alias("_low")
        )
        offers = step.select(
            F.explode(
                F.array(
                    F.struct(F.col("_node").alias("n"), F.col("_low").alias("l")),
                    F.struct(F.col("_up").alias("n"), F.col("_low").alias("l")),
                )
            ).alias("_o")
        )
        new = offers.groupBy(F.col("_o.n").alias("_node")).agg(F.min("_o.l").alias("_up"))
        before = state
        state = saved(
            new.join(before.withColumnRenamed("_up", "_was"), "_node").select(
                "_node", F.least("_up", "_was").alias("_up"), "_was"
            ),
            "component-state",
        )
        if not state.filter(F.col("_up") != F.col("_was")).limit(1).count():
            return state.select("_node", F.col("_up").alias("_root"))
        state = state.select("_node", "_up")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 3,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per row: the id (a long), ``fingerprint`` in hexadecimal and ``component_id``.

    ``component_id`` is the smallest id that can be reached by steps between texts whose
    fingerprints differ in at most ``distance`` bits.  Null and empty texts have fingerprint
    0 and take part like others; rows that repeat stay; a null id stays null and is reached
    last, so a component has no id only if none of its rows has one.

    Texts are read once, for a fingerprint and an id per row, which is written down.  Copies
    fall together to one fingerprint before anything else; what is compared are distinct
    ones, and all that leaves a task are links of which a component has hardly more than
    members.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    prints = saved(
        rows.mapInArrow(lambda batches: _fingerprints(batches, shingle), "_id long, _bits long"),
        "simhash-prints",
    )
    firsts = saved(
        prints.groupBy("_bits").agg(F.min(F.coalesce("_id", F.lit(HIGHEST))).alias("_first")),
        "simhash-firsts",
    )
    links = near_links(firsts.select("_bits"), distance, group_rows)
    # Most fingerprints have no link and are components of their own.
    sets = saved(
        components(saved(links, "simhash-links")).select(F.col("_node").alias("_bits"), "_root"),
        "simhash-sets",
    )
    known = firsts.join(sets, "_bits", "left").withColumn("_root", F.coalesce("_root", "_bits"))
    # Written, so that the joins below are between plain exchanges, which Spark can split
    # where a component or a fingerprint holds a large part of all rows.
    lowest = saved(
        known.groupBy("_root").agg(F.min("_first").alias("_lowest")), "simhash-lowest"
    )
    named = saved(known.join(lowest, "_root").select("_bits", "_lowest"), "simhash-named")
    return prints.join(named, "_bits").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_bits"), 16, "0")).alias("fingerprint"),
        F.nullif("_lowest", F.lit(HIGHEST)).alias("component_id"),
    )
