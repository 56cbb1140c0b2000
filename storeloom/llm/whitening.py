"""Embedding whitening with a covariance weighted by multiplicity.

Vectors become integers, equal ones are grouped, and everything after that works on one row
per distinct vector: sums, centred products, projections.  The rows of the table only meet
the finished projections by the 16-byte key of their vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeloom.llm.common import saved

# Fixed value: steps of the integer grid in one unit.
STEPS = 256
COMPONENTS = 4
# Eigenvalues below this share of the largest are rounding, not spread.
LEAST_SHARE = 1e-12
# The rows of the matrix are added up in so many tasks before the driver takes them.
PARTS = 32
# Entries beyond this are cut off there, so that they fit in a long.
LARGEST = 2.0**62


def _grid(batches: Iterator[pa.RecordBatch], with_vector: bool) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, key[, the vector on the grid as little-endian longs])."""
    for batch in batches:
        ids, keys, out = [], [], []
        for i, vector in enumerate(batch.column(1)):
            values = vector.values
            if values is None or values.null_count:
                continue
            entries = values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(entries).all():
                continue
            with np.errstate(over="ignore"):
                steps = np.floor(entries * STEPS)
            x = np.clip(steps, -LARGEST, LARGEST).astype("<i8").tobytes()
            ids.append(i)
            keys.append(blake2b(x, digest_size=16).digest())
            out.append(x)
        columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary())]
        names = ["_id", "_key"]
        if with_vector:
            columns.append(pa.array(out, pa.binary()))
            names.append("_x")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector in the batch: its rows, and the vectors as a matrix."""
    vectors = [v.as_py() for v in batch.column("_x")]
    sizes = np.array([len(v) // 8 for v in vectors])
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        if d:
            joined = np.frombuffer(b"".join(vectors[i] for i in at), "<i8")
            yield d, at, joined.reshape(len(at), d)


def _weights(batch: pa.RecordBatch, at: np.ndarray, weight: str) -> np.ndarray:
    if weight == "one":
        return np.ones(len(at), np.int64)
    return batch.column("_count").to_numpy(zero_copy_only=False)[at]


def _sums(batches: Iterator[pa.RecordBatch], weight: str) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task: the weights in all and the weighted entries, for each length."""
    total: dict[int, list] = {}
    for batch in batches:
        for d, at, x in _blocks(batch):
            w = _weights(batch, at, weight)
            held = total.setdefault(d, [0] * (d + 1))
            held[0] += int(w.sum())
            # Halves of 31 bits keep every sum of a batch inside a long.
            high, low = x >> 31, x & (2**31 - 1)
            fits = int(w.max()) * len(at) < 2**31
            for j in range(d):
                if fits:
                    held[j + 1] += (int((high[:, j] * w).sum()) << 31) + int((low[:, j] * w).sum())
                else:
                    held[j + 1] += sum(a * b for a, b in zip(x[:, j].tolist(), w.tolist()))
    for d, held in total.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d] * len(held), pa.int32()),
                pa.array(range(len(held)), pa.int32()),
                pa.array([str(v) for v in held]),
            ],
            names=["_d", "_j", "_sum"],
        )


@dataclass(frozen=True)
class Fit:
    """What whitens the vectors of one length: exact ``n`` and ``sums``, and the components."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _products(
    batches: Iterator[pa.RecordBatch], means: dict[int, np.ndarray], weight: str
) -> Iterator[pa.RecordBatch]:
    """Weighted products of the centred vectors of a task, a row for each row of the matrix."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, at, x in _blocks(batch):
            centred = x.astype(np.float64) - means[d]
            scaled = centred * _weights(batch, at, weight)[:, None]
            total[d] = total.get(d, 0.0) + scaled.T @ centred
    yield from _rows({(d, j): row for d, m in total.items() for j, row in enumerate(m)})


def _rows(total: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (d, j), row in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int32()), pa.array([j], pa.int32()), pa.array([row], pa.list_(pa.float64()))],
            names=["_d", "_j", "_row"],
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the matrix rows that came to a task: one for each row of a matrix."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for d, j, row in zip(*(batch.column(n).to_pylist() for n in ("_d", "_j", "_row"))):
            total[d, j] = total.get((d, j), 0.0) + np.array(row)
    yield from _rows(total)


def _covariances(
    distinct: DataFrame, means: dict[int, np.ndarray], n: dict[int, int], weight: str
) -> dict[int, np.ndarray]:
    """Centred products over all distinct vectors, divided by ``n``; a matrix for each length."""
    sent = distinct.sparkSession.sparkContext.broadcast(means)  # d numbers for each length
    schema = "_d int, _j int, _row array<double>"
    partial = distinct.mapInArrow(lambda b: _products(b, sent.value, weight), schema)
    added = partial.repartition(PARTS, "_d", "_j").mapInArrow(_added, schema)
    total = {d: np.zeros((d, d)) for d in means}
    for row in added.toLocalIterator():
        total[row["_d"]][row["_j"]] += np.array(row["_row"])
    return {d: m / n[d] for d, m in total.items()}


def fit(distinct: DataFrame, components: int = COMPONENTS, weight: str = "one") -> dict[int, Fit]:
    """The fit for each length of vector, from ``_x`` and ``_count`` of the distinct vectors."""
    sums: dict[int, list[int]] = {}
    partial = distinct.mapInArrow(lambda b: _sums(b, weight), "_d int, _j int, _sum string")
    exact = partial.groupBy("_d", "_j").agg(F.sum(F.col("_sum").cast("decimal(38,0)")).alias("_sum"))
    for row in exact.orderBy("_d", "_j").toLocalIterator():
        sums.setdefault(row["_d"], []).append(int(row["_sum"]))
    n = {d: s[0] for d, s in sums.items()}
    means = {d: np.array([v / s[0] for v in s[1:]]) for d, s in sums.items()}
    out = {}
    for d, covariance in _covariances(distinct, means, n, weight).items():
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        spread = values > max(values[0], 0.0) * LEAST_SHARE
        k = min(components, int(spread.sum()))
        # The largest entry of a component is positive: one sign for every run.
        peak = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[peak, np.arange(d)] < 0, -1.0, 1.0)
        trace = float(np.trace(covariance))
        out[d] = Fit(n[d], sums[d][1:], vectors[:, :k], values[:k], values[:k] / (trace or 1.0))
    return out


def _whiten(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """Each distinct vector's exact deviation and its whitened projections."""
    for batch in batches:
        m = batch.num_rows
        deviation: list[str | None] = ["0"] * m
        whitened: list[list[float]] = [[]] * m
        sizes = np.zeros(m, np.int32)
        for d, at, x in _blocks(batch):
            held = fits[d]
            white = (x.astype(np.float64) - held.mean) @ held.components / np.sqrt(held.eigenvalues)
            bound = held.n * int(np.abs(x).max()) + max(abs(s) for s in held.sums)
            if bound * bound * d < 2**63:
                away = held.n * x - np.array(held.sums, np.int64)
                square = (away * away).sum(axis=1).tolist()
            else:
                square = [sum((held.n * e - s) ** 2 for e, s in zip(row, held.sums)) for row in x.tolist()]
            for i, dev, z in zip(at.tolist(), square, white):
                deviation[i] = str(dev) if dev < 10**38 else None
                whitened[i] = z.tolist()
                sizes[i] = d
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_key"),
                pa.array(sizes, pa.int32()),
                batch.column("_count"),
                pa.array(deviation, pa.string()),
                pa.array(whitened, pa.list_(pa.float64())),
            ],
            names=["_key", "_d", "_count", "_deviation", "_white"],
        )


def _identity_errors(white: DataFrame, components: int, weight: str) -> DataFrame:
    """For each length: how far the covariance of the whitened vectors is from the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    z = [F.get("_white", F.lit(i)) for i in range(components)]
    w = F.lit(1.0) if weight == "one" else F.col("_count").cast("double")
    mean = white.groupBy("_d").agg(
        *[(F.sum(z[i] * w) / F.sum(w)).alias(f"_m{i}") for i in range(components)]
    )
    # A row per length: no more than one for each fit that the driver holds already.
    centred = white.join(F.broadcast(mean), "_d")
    products = [
        F.abs(
            F.sum((z[i] - F.col(f"_m{i}")) * (z[j] - F.col(f"_m{j}")) * w) / F.sum(w)
            - F.lit(1.0 if i == j else 0.0)
        ).alias(f"_e{i}_{j}")
        for i, j in pairs
    ]
    errors = centred.groupBy("_d").agg(*products)
    names = [F.coalesce(f"_e{i}_{j}", F.lit(0.0)) for i, j in pairs]
    worst = F.greatest(*names) if len(names) > 1 else names[0]
    return errors.select("_d", worst.alias("identity_error"))


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    weight: str = "one",
) -> DataFrame:
    """For each row and component: the id, ``component``, ``n``, ``copies``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.

    An entry c becomes floor(256 * c).  The fit list has each distinct vector of these once
    (``weight="one"``) or as often as it comes (``"count"``); n is its length, S its sums.
    ``deviation`` is the exact sum of (n * x - S)^2, a decimal, null from 10^38 on;
    ``whitened`` is (x - S/n) along a unit eigenvector of the covariance over the root of its
    eigenvalue; components are numbered from 1 by falling eigenvalue and have their largest
    entry positive.  ``identity_error`` is the largest entry of the whitened list's covariance
    minus the identity.

    Rows whose vector is null or has null or non-finite entries are left out; rows that repeat
    or have a null id stay.  Vectors of another length are a fit of their own, empty ones have
    no component, and neither has a table without spread; a component whose eigenvalue is
    rounding only is not given.  Entries beyond 2^62 steps count as 2^62.  Other columns,
    whatever their names, are not looked at.

    Equal vectors are counted map-side before they are shuffled, by a 16-byte key.  Sums and
    products of a task are one small matrix, added up in ``PARTS`` tasks; the driver holds one
    matrix for each length.  The rows carry only id and key to the whitened vectors, in a join
    whose other side is unique, so Spark can split a vector that a third of all rows share.
    """
    if weight not in ("one", "count"):
        raise ValueError(f"unknown weight {weight!r}")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_vector"))
    kind = rows.schema["_id"].dataType.simpleString()
    keyed = rows.select(F.lit(0).alias("_id"), "_vector").mapInArrow(
        lambda b: _grid(b, True), "_id int, _key binary, _x binary"
    )
    distinct = saved(
        keyed.groupBy("_key").agg(F.first("_x").alias("_x"), F.count(F.lit(1)).alias("_count")),
        "whitening-distinct",
    )
    fits = fit(distinct, components, weight)
    sent = vectors.sparkSession.sparkContext.broadcast(fits)
    white = saved(
        distinct.mapInArrow(
            lambda b: _whiten(b, sent.value),
            "_key binary, _d int, _count long, _deviation string, _white array<double>",
        ),
        "whitening-white",
    )
    known = vectors.sparkSession.createDataFrame(
        [(d, str(f.n), [float(e) for e in f.explained]) for d, f in fits.items()],
        "_d int, _n string, _explained array<double>",
    )
    # A row for each length, like the fits on the driver.
    known = known.join(_identity_errors(white, components, weight), "_d")
    ids = rows.mapInArrow(lambda b: _grid(b, False), f"_id {kind}, _key binary")
    return (
        ids.join(white, "_key")
        .select("_id", "_d", "_count", "_deviation", F.posexplode("_white").alias("_at", "whitened"))
        .join(F.broadcast(known), "_d")
        .select(
            F.col("_id").alias(id_col),
            (F.col("_at") + 1).alias("component"),
            F.col("_n").cast("long").alias("n"),
            F.col("_count").alias("copies"),
            F.col("_deviation").cast("decimal(38,0)").alias("deviation"),
            "whitened",
            F.get("_explained", F.col("_at")).alias("explained"),
            "identity_error",
        )
    )
