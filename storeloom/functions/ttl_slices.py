"""What happens inside the tasks of ``dedup_ttl``.

All functions take and give Arrow batches and hold one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ttl_exits(at: np.ndarray, ttl: int) -> np.ndarray:
    """For each instant: the last one kept if counting resumes there."""
    n = len(at)
    hop = np.append(np.searchsorted(at, at + ttl), n)
    last = np.arange(n + 1)
    while True:
        ahead = hop[last]
        more = ahead < n
        if not more.any():
            return at[last[:n]]
        last = np.where(more, ahead, last)


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lists and their values, one behind the other."""
    return column.offsets.to_numpy(), column.values.to_numpy()


def _lists(pieces: list[np.ndarray]) -> pa.Array:
    bounds = np.zeros(len(pieces) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in pieces], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(pieces)))


def slice_steps(batches: Iterator[pa.RecordBatch], ttl: int, width: int) -> Iterator[pa.RecordBatch]:
    """(key, slice, instants) to (key, slice, upto, exit).

    Counting that resumes no later than ``upto[i]`` (and after ``upto[i-1]``) keeps
    ``exit[i]`` last within the slice.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        key, piece, instants = batch.columns
        bounds, values = _list_parts(instants)
        starts = piece.to_numpy() * width
        upto, exits = [], []
        for i, start in enumerate(starts):
            at = values[bounds[i] : bounds[i + 1]]
            if len(at) > 1:
                # Counting resumes at the latest one TTL into the slice.
                entries = int(np.searchsorted(at, start + ttl)) + 1
                out = ttl_exits(at, ttl)[:entries]
                ends = np.append(np.flatnonzero(np.diff(out)), len(out) - 1)
                upto.append(at[ends])
                exits.append(out[ends])
            else:
                upto.append(at)
                exits.append(at)
        yield pa.RecordBatch.from_arrays(
            [key, piece, _lists(upto), _lists(exits)],
            names=[*batch.schema.names[:2], "_upto", "_exit"],
        )


def _key_starts(key: pa.Array, before) -> np.ndarray:
    """True where a key's first row is, ``before`` being the key of the row in front."""
    fresh = np.ones(len(key), dtype=bool)
    fresh[0] = before is None or key[0].as_py() != before
    fresh[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(
        zero_copy_only=False
    )
    return fresh


def keep_first(batches: Iterator[pa.RecordBatch], key: str, ttl: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and ``_us``: those at least ``ttl`` after the last one kept.

    A row that follows its predecessor by ``ttl`` or more is always kept, and so is a
    key's first; such rows begin a run.  A run shorter than ``ttl`` keeps nothing else,
    so only longer ones are followed instant by instant.
    """
    current, before, since = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(key)
        at = batch.column("_us").to_numpy()
        begins = _key_starts(keys, current)
        begins |= np.diff(at, prepend=before) >= ttl
        runs = np.flatnonzero(begins)
        stay = begins.copy()
        # What the run at the end of the last batch still has here.
        rest = int(runs[0]) if len(runs) else n
        since = _follow(at, 0, rest, since, ttl, stay)
        if len(runs):
            ends = np.append(runs[1:], n)
            longer = np.flatnonzero(at[ends - 1] - at[runs] >= ttl)
            for r in longer:
                since = _follow(at, int(runs[r]) + 1, int(ends[r]), at[runs[r]] + ttl, ttl, stay)
            if not len(longer) or longer[-1] != len(runs) - 1:
                since = at[runs[-1]] + ttl
        current, before = keys[n - 1].as_py(), at[-1]
        yield batch.filter(pa.array(stay)).drop_columns(["_us"])


def _follow(at: np.ndarray, lo: int, hi: int, since: int, ttl: int, stay: np.ndarray) -> int:
    """Mark what is kept of ``at[lo:hi]``; from when on something may be kept next."""
    place = lo + int(np.searchsorted(at[lo:hi], since))
    while place < hi:
        stay[place] = True
        since = at[place] + ttl
        place = lo + int(np.searchsorted(at[lo:hi], since))
    return since


def carry(batches: Iterator[pa.RecordBatch], ttl: int) -> Iterator[pa.RecordBatch]:
    """(key, slice, upto, exit), sorted, to (key, slice, since).

    ``since`` is the instant from which the slice may keep something again, null in a
    key's first slice.  One anchor is all that is remembered from row to row.
    """
    current, since = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, piece, upto, exits = batch.columns
        fresh = _key_starts(key, current)
        current = key[batch.num_rows - 1].as_py()
        bounds, latest = _list_parts(upto)
        out = exits.values.to_numpy()
        ends = bounds[1:] - 1
        found = []
        rows = zip(fresh.tolist(), bounds.tolist(), ends.tolist(), latest[ends].tolist())
        for is_first, lo, hi, last_entry in rows:
            if is_first:
                found.append(None)
                since = int(out[lo]) + ttl
                continue
            found.append(since)
            if since <= last_entry:
                step = lo + int(np.searchsorted(latest[lo : hi + 1], since)) if hi > lo else lo
                since = int(out[step]) + ttl
        yield pa.RecordBatch.from_arrays(
            [key, piece, pa.array(found, type=pa.int64())],
            names=[*batch.schema.names[:2], "_since"],
        )


def slice_kept(batches: Iterator[pa.RecordBatch], ttl: int) -> Iterator[pa.RecordBatch]:
    """(key, slice, instants, since) to a row (key, instant) per kept instant."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, _, instants, since = batch.columns
        bounds, values = _list_parts(instants)
        resume = since.fill_null(np.iinfo(np.int64).min).to_numpy()
        first, sizes = bounds[:-1], np.diff(bounds)
        single = np.flatnonzero((sizes == 1) & (values[first] >= resume))
        owners, kept = [single], [values[first[single]]]
        for i in np.flatnonzero(sizes > 1):
            at = values[bounds[i] : bounds[i + 1]]
            place = int(np.searchsorted(at, resume[i]))
            stay = []
            while place < len(at):
                stay.append(at[place])
                place = int(np.searchsorted(at, at[place] + ttl))
            owners.append(np.full(len(stay), i))
            kept.append(np.array(stay, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [key.take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(kept))],
            names=[batch.schema.names[0], "_us"],
        )
