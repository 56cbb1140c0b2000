"""Removal of bytes that repeated substrings cover, by sorting sampled suffixes.

Of every window of ``length`` bytes one place, its anchor, is chosen by content alone: the
start of the gram with the smallest hash.  Equal windows have equal anchors, so only the
suffixes at anchors whose gram occurs twice are sorted, forwards and backwards, and a
window is equal to another one if both parts, before and after the anchor, are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storeloom.llm.common import HIGHEST, body, saved
from storeloom.llm.suffix_sort import deep_shallow

LENGTH = 100
GRAM = 32
PIECE = 1 << 21  # bytes whose grams are hashed at a time
CHUNK = 1 << 16  # suffixes sorted at a time, more only if one gram has more
# A gram with more anchors than this is not sorted in one task; its windows are counted.
GROUP_ROWS = 250_000

# A place packs the offset of the anchor and the smallest and largest distance of a window's
# start before it (7 bits each).
_AT = 14


def _grams(flat: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on."""
    n = len(flat) - GRAM + 1
    words = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for i, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(29)
        h += words[i : i + n]
        h *= np.uint64(odd)
    h ^= h >> np.uint64(32)
    return h


def _anchors(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of some strings of at least ``LENGTH`` bytes.

    Arrays: string, offset in it, smallest and largest distance before it at which a window
    starts whose anchor it is, hash of the gram.  Of equal smallest hashes the leftmost counts.
    """
    flat = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    grams = _grams(flat)
    low = np.uint64((1 << 23) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: -(span - width)], key[span - width :])
    at = (key & low).astype(np.int64)
    inside = np.ones(len(at), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    start = np.flatnonzero(inside)
    at = at[start]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    at, far, near = at[first], at[first] - start[first], at[first] - start[last]
    owner = np.searchsorted(ends, at, side="right")
    offset = at - np.append(0, ends)[owner]
    return owner, offset, near, far, grams[at]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in lots of about ``PIECE`` bytes; longer ones in parts that share no window."""
    rows, offsets, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if size and size + len(part) > 2 * PIECE:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, offsets, parts


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All anchors: gram (once per lot and gram), document, place, how many in the lot.

    Further anchors of a gram are known to repeat; they go out under a key of their own,
    so that a gram that everyone has is one row per lot.
    """
    for batch in batches:
        docs = batch.column("_doc").to_numpy()
        texts = [t.as_py().encode() for t in batch.column("_text")]
        for rows, offsets, parts in _pieces(texts):
            owner, offset, near, far, gram = _anchors(parts)
            row = np.array(rows)[owner]
            offset = offset + np.array(offsets)[owner]
            place = (offset << _AT) | (near << 7) | far
            _, first, back, count = np.unique(
                gram, return_index=True, return_inverse=True, return_counts=True
            )
            leads = np.zeros(len(gram), bool)
            leads[first] = True
            own = gram.view(np.int64).copy()
            other = (docs[row] * 0x9E3779B1 + place) * 0x85EBCA77
            own[~leads] = other[~leads]
            known = count[back]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(docs[row]), pa.array(place), pa.array(known), pa.array(leads)],
                names=["_key", "_doc", "_place", "_n", "_lead"],
            )


def _unpacked(places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Offset, smallest and largest distance."""
    return places >> _AT, (places >> 7) & 127, places & 127


def _listed(places) -> np.ndarray:
    """The places of a document, in order."""
    found = np.zeros(0, np.int64) if places is None else places.to_numpy(zero_copy_only=False)
    return np.sort(found)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with the bytes of all their windows, one of equal ones per batch.

    ``_bytes`` begins with the largest distance.  What is left out is later than its equal,
    so all its windows are repeats.
    """
    for batch in batches:
        docs = batch.column("_doc").to_numpy()
        seen: set[bytes] = set()
        keys, owners, places, blobs = [], [], [], []
        for i in np.argsort(docs, kind="stable").tolist():
            own = _listed(batch.column("_places")[i].values)
            text = batch.column("_text")[i].as_py().encode()
            offset, near, far = _unpacked(own)
            for place, at, a, b in zip(own.tolist(), offset.tolist(), near.tolist(), far.tolist()):
                blob = bytes((b,)) + text[at - b : at + LENGTH - a]
                if blob in seen:
                    continue
                seen.add(blob)
                keys.append(text[at : at + GRAM])
                owners.append(docs[i])
                places.append(place)
                blobs.append(blob)
        if not keys:
            continue
        flat = np.frombuffer(b"".join(keys), np.uint8)
        gram = _grams(flat)[::GRAM]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(gram.view(np.int64)),
                pa.array(owners, pa.int64()),
                pa.array(places, pa.int64()),
                pa.array(blobs, pa.binary()),
            ],
            names=["_key", "_doc", "_place", "_bytes"],
        )


def _repeats(key: np.ndarray, doc: np.ndarray, place: np.ndarray, blobs: pa.Array):
    """(document, place, spans) of the earliest of equal contexts, for whole groups of grams.

    Spans are starts and ends of removed bytes in turn; a context that is not given back is
    a copy of an earlier one.
    """
    early = np.lexsort((place, doc))
    key, doc, place = key[early], doc[early], place[early]
    codes = blobs.take(pa.array(early)).dictionary_encode()
    _, first = np.unique(codes.indices.to_numpy(), return_index=True)
    first = np.sort(first)
    key, doc, place = key[first], doc[first], place[first]
    texts = codes.dictionary.to_pylist()  # in order of first sight, as is ``first``
    offset, near, far = _unpacked(place)
    group, sizes = np.unique(key, return_inverse=True, return_counts=True)[1:]
    spans: list[list[int]] = [[] for _ in texts]
    rows = np.flatnonzero(sizes[group] > 1)
    if len(rows):
        rows = rows[np.argsort(group[rows], kind="stable")]
        dup = _equal_windows([texts[i] for i in rows.tolist()], group[rows], near[rows], far[rows])
        for i, d in enumerate(dup):
            at = np.flatnonzero(d)
            if not len(at):
                continue
            row = rows[i]
            cut = np.flatnonzero(np.diff(at) > 1)
            lows, highs = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
            for lo, hi in zip(lows[::-1].tolist(), highs[::-1].tolist()):
                spans[row] += [int(offset[row]) - hi, int(offset[row]) - lo + LENGTH]
    return doc, place, spans


def _equal_windows(texts: list[bytes], group, near, far) -> np.ndarray:
    """For each row and distance: whether an earlier row (they come in order of time within
    a group) has an equal window at this distance."""
    n, most = len(texts), LENGTH - GRAM
    after, before = np.zeros((n, LENGTH), np.uint8), np.zeros((n, most), np.uint8)
    for i, text in enumerate(texts):
        far_i = text[0]
        tail = np.frombuffer(text, np.uint8, -1, 1 + far_i)
        after[i, : len(tail)] = tail
        if far_i:
            before[i, :far_i] = np.frombuffer(text, np.uint8, far_i, 1)[::-1]
    order_a, lcp_a = deep_shallow(after, group)
    order_b, lcp_b = deep_shallow(before, group)
    rank_a, rank_b = np.empty(n, np.int64), np.empty(n, np.int64)
    dup = np.zeros((n, most + 1), bool)
    for distance in range(most + 1):
        rows = np.flatnonzero((near <= distance) & (distance <= far))
        if len(rows) < 2:
            continue
        rank_a[order_a] = np.cumsum(lcp_a < LENGTH - distance)
        rank_b[order_b] = np.cumsum(lcp_b < distance)
        both = rank_a[rows] * (n + 1) + rank_b[rows]
        by = np.argsort(both, kind="stable")
        again = np.diff(both[by], prepend=-1) == 0
        dup[rows[by[again]], distance] = True
    return dup


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram to spans, some whole grams at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        key = batch.column("_key").to_numpy()
        start = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else 0
        if not start:
            continue  # one gram fills the batch; wait for its end
        held[-1] = batch.slice(0, start)
        yield from _solved(held)
        held = [batch.slice(start)]
        rows = held[0].num_rows
    yield from _solved(held)


def _solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    if table is None or not table.num_rows:
        return
    key, doc, place = (table.column(c).to_numpy() for c in ("_key", "_doc", "_place"))
    doc, place, spans = _repeats(key, doc, place, table.column("_bytes").chunk(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(place), pa.array(spans, pa.list_(pa.int64()))],
        names=["_doc", "_place", "_spans"],
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts by itself: hash, document, place, distance."""
    for batch in batches:
        hashes, source, distances = [], [], []
        _, near, far = _unpacked(batch.column("_place").to_numpy())
        for i, blob in enumerate(batch.column("_bytes").to_pylist()):
            for d in range(int(near[i]), int(far[i]) + 1):
                at = 1 + blob[0] - d
                hashes.append(blake2b(blob[at : at + LENGTH], digest_size=16).digest())
                source.append(i)
                distances.append(d)
        source = pa.array(source, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hashes, pa.binary()),
                batch.column("_doc").take(source),
                batch.column("_place").take(source),
                pa.array(distances, pa.int64()),
            ],
            names=["_hash", "_doc", "_place", "_distance"],
        )


def _counted_repeats(contexts: DataFrame) -> DataFrame:
    """Spans of the contexts, from the first of each distinct window; for hot grams.

    Sums per window are made map-side, so no key is too large for a task.
    """
    windows = contexts.mapInArrow(
        _windows, "_hash binary, _doc long, _place long, _distance long"
    )
    firsts = (
        windows.groupBy("_hash")
        .agg(F.min(F.struct("_doc", "_place", "_distance")).alias("_first"))
        .select("_first.*")
        .groupBy("_doc", "_place")
        .agg(F.collect_set("_distance").alias("_firsts"))
    )
    offset = F.shiftright("_place", _AT)
    near, far = F.shiftright("_place", 7).bitwiseAND(F.lit(127)), F.col("_place").bitwiseAND(F.lit(127))
    repeated = F.array_except(F.sequence(near, far), F.col("_firsts"))
    return firsts.select(
        "_doc",
        "_place",
        F.flatten(
            F.transform(repeated, lambda d: F.array(offset - d, offset - d + F.lit(LENGTH)))
        ).alias("_spans"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without what the candidates' windows that are repeats cover."""
    for batch in batches:
        sizes, spans, kept = [], [], []
        for i, text in enumerate(batch.column("_text")):
            data = text.as_py().encode()
            places = _listed(batch.column("_places")[i].values)
            edge = np.zeros(len(data) + 1, np.int64)
            found = batch.column("_found")[i].as_py() or []
            known = {f["_place"] for f in found}
            offset, near, far = _unpacked(places)
            whole = np.array([p not in known for p in places.tolist()], bool)
            np.add.at(edge, (offset - far)[whole], 1)
            np.add.at(edge, (offset - near)[whole] + LENGTH, -1)
            for f in found:
                np.add.at(edge, f["_spans"][::2], 1)
                np.add.at(edge, f["_spans"][1::2], -1)
            gone = np.cumsum(edge)[:-1] > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            sizes.append(len(data))
            spans.append(turn)
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                batch.column("_copies"),
                pa.array(sizes, pa.int64()),
                pa.array(spans, pa.list_(pa.int64())),
                pa.array(kept, pa.binary()),
            ],
            names=["_id", "_copies", "n_bytes", "_turns", "kept"],
        )


def _numbered(rows: DataFrame) -> DataFrame:
    """One row for each id and text, numbered in the order in which they count.

    Only for tables where ids repeat.  Ranges of the order are cut by a sample of id and
    hash, so an id that a third of all rows have is spread over many tasks; the numbers are
    written down, as every later step has to see the same ones.
    """
    name = F.unhex(F.md5("_text")).alias("_name")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(
        rows.groupBy("_id", name)
        .agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
        .repartitionByRange(parts, "_id", "_name")
        .sortWithinPartitions("_id", "_name")
        .select(F.monotonically_increasing_id().alias("_doc"), "_id", "_copies", "_text"),
        "suffix-rows",
    )


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per row: the id (a long), ``n_bytes``, ``n_removed``, ``spans`` and ``kept``.

    A byte of the UTF-8 text is removed if a string of 100 bytes that covers it also starts
    earlier: in a document with a smaller id, or before in the same one.  ``spans`` are the
    maximal removed runs (from, to); ``kept`` the other bytes, which may cut a character.

    Null and empty texts have no bytes.  Rows without an id come last; rows that share an
    id count in the order of the MD5 of their texts; identical rows count as one document and
    all lose what it loses.  Other columns are not looked at.

    About one place in 35 bytes is an anchor; those whose gram stands alone are dropped after
    one shuffle of hashes.  The others fetch the bytes around them and are sorted by gram; a
    gram with more than ``group_rows`` anchors goes another exact way instead, counting its
    windows with map-side sums.  The text is exchanged once, by id.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(HIGHEST)).alias("_id"),
        body(text_col).alias("_text"),
    )
    if rows.groupBy("_id").count().filter("count > 1").limit(1).count():
        rows = _numbered(rows)
    else:
        rows = rows.select(F.col("_id").alias("_doc"), "_id", F.lit(1).cast("long").alias("_copies"), "_text")

    sampled = rows.mapInArrow(
        _sample, "_key long, _doc long, _place long, _n long, _lead boolean"
    )
    total = F.sum("_n").over(Window.partitionBy("_key"))
    candidates = saved(
        sampled.withColumn("_total", total)
        .filter(F.col("_total") > 1)
        .select(
            "_doc",
            "_place",
            F.when(F.col("_lead") & (F.col("_total") > group_rows), F.col("_key")).alias("_hot"),
        ),
        "suffix-candidates",
    )
    # At most all anchors / group_rows grams.
    hot = candidates.filter(F.col("_hot").isNotNull()).select(F.col("_hot").alias("_key")).distinct()
    hot = saved(hot, "suffix-hot")

    places = candidates.groupBy("_doc").agg(F.collect_list("_place").alias("_places"))
    with_places = rows.join(places, "_doc", "left")
    contexts = with_places.filter(F.col("_places").isNotNull()).mapInArrow(
        _contexts, "_key long, _doc long, _place long, _bytes binary"
    )
    few = contexts
    if hot.limit(1).count():
        few = contexts.join(hot, "_key", "left_anti")
    found = (
        few.repartition("_key")
        .sortWithinPartitions("_key")
        .mapInArrow(_sorted_repeats, "_doc long, _place long, _spans array<long>")
    )
    if few is not contexts:
        found = found.union(_counted_repeats(contexts.join(hot, "_key", "left_semi")))
    per_doc = found.groupBy("_doc").agg(
        F.collect_list(F.struct("_place", "_spans")).alias("_found")
    )
    cut = with_places.join(per_doc, "_doc", "left").mapInArrow(
        _cut, "_id long, _copies long, n_bytes long, _turns array<long>, kept binary"
    )
    # As many answers as there were identical rows.
    cut = cut.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    pairs = F.when(F.size("_turns") > 0, F.sequence(F.lit(0), F.size("_turns") - 2, F.lit(2)))
    spans = F.transform(
        F.coalesce(pairs, F.array().cast("array<int>")),
        lambda i: F.struct(F.col("_turns")[i].alias("from"), F.col("_turns")[i + 1].alias("to")),
    )
    return cut.select(
        F.nullif("_id", F.lit(HIGHEST)).alias(id_col),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        spans.alias("spans"),
        "kept",
    )
