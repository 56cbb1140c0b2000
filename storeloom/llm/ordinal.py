"""Quality classifier: ordinal regression on graded ratings over hashed words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeloom.llm.common import Folded

GRADES = 3  # a point for good writing and one for clean language: 0, 1 or 2
BUCKETS = 1 << 18
FIT_ROWS = 20_000  # labelled documents looked at, at most: four fifths to fit, one to calibrate
SEEN_IN = 5  # documents of the fit that a bucket must stand in to carry a weight
EPOCHS, BATCH, RATE, SHRINK = 40, 512, 0.2, 3e-4
SEED = 3
# The share of top-grade labelled documents that selection may lose, at most.
MAX_LOSS = 0.01

START = 6
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(48, 58))


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(quality > 0, 1).otherwise(0) + F.when(toxic > 0, 0).otherwise(1)


def buckets(text: str | None) -> np.ndarray:
    """Distinct hashed features of a text: words in lower case, their starts, their marks.

    Words are cut at white space and stripped of ASCII punctuation at both ends; the start
    is the first six characters of a longer word; marks are what a word has besides ASCII
    letters and digits.
    """
    low = (text or "").lower()
    words = {w.strip(MARKS) for w in set(low.split())}
    starts = {"\x01" + w[:START] for w in words if len(w) > START}
    marks = {b"\x00" + m for m in set(low.encode().translate(None, LETTERS).split())}
    found = {zlib.crc32(w.encode()) % BUCKETS for w in words | starts}
    found |= {zlib.crc32(m) % BUCKETS for m in marks}
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # per bucket; the higher their sum, the better the grade
    cuts: np.ndarray  # ordered thresholds between the grades
    least: float  # tail probability from which on a document is selected


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def tails(cuts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ..., a column each."""
    return _sigmoid(scores[:, None] - cuts[None, :])


def _sums(weights: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """The sum of each document's weights, whatever documents it is worked on with."""
    sizes = np.array([len(d) for d in docs], np.int64)
    total = np.zeros(len(docs))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes[some]) - sizes[some]
        total[some] = np.add.reduceat(weights[np.concatenate([docs[i] for i in some])], starts)
    return total


def fit(docs: list[np.ndarray], grades: np.ndarray, max_loss: float = MAX_LOSS) -> OrdinalModel:
    """Fit on four of five rows by proximal AdaGrad, calibrate selection on the fifth.

    The cumulative-link likelihood shares one weight per bucket among all grades; cuts stay
    ordered as gaps are kept as logarithms; an L1 step keeps weights without evidence at 0.
    """
    held = np.arange(len(docs)) % 5 == 4
    train = np.flatnonzero(~held)
    rng = np.random.default_rng(SEED)
    counts = np.zeros(BUCKETS, np.int64)
    for i in train:
        counts[docs[i]] += 1
    used = counts >= SEEN_IN
    rows = [d[used[d]] for d in docs]
    w, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    start = np.array([(grades[train] >= k).mean() for k in range(1, GRADES)])
    start = np.clip(np.sort(start)[::-1], 0.01, 0.99) - np.arange(GRADES - 1) * 1e-3
    cuts = -np.log(start / (1 - start))
    free = np.append(cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2)))
    gf = np.full(len(free), 1e-8)
    batch = min(BATCH, max(16, len(train) // 32))  # few rows still make some steps
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            ids = train[at : at + batch]
            part = [rows[i] for i in ids]
            y = grades[ids]
            gaps = np.exp(free[1:])
            cuts = free[0] + np.append(0.0, np.cumsum(gaps))
            above = np.pad(tails(cuts, _sums(w, part)), ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0)))
            line = np.arange(len(y))
            upper, lower = above[line, y], above[line, y + 1]
            chance = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            push = -(du - dl) / len(y)  # derivative of the loss by a row's score
            by_cut = np.zeros((len(y), GRADES + 1))
            by_cut[line, y] += du
            by_cut[line, y + 1] -= dl
            cut_grad = by_cut[:, 1:GRADES].sum(0) / len(y)
            tail_grad = np.cumsum(cut_grad[::-1])[::-1]
            free_grad = np.append(tail_grad[0], tail_grad[1:] * gaps)
            gf += free_grad**2
            free = free - RATE * free_grad / np.sqrt(gf)
            sizes = [len(p) for p in part]
            grad = np.bincount(np.concatenate(part), np.repeat(push, sizes), BUCKETS)
            gw += grad**2
            pace = RATE / np.sqrt(gw)
            w = w - pace * grad
            w = np.sign(w) * np.maximum(np.abs(w) - pace * SHRINK, 0.0)
    cuts = free[0] + np.append(0.0, np.cumsum(np.exp(free[1:])))
    top = tails(cuts, _sums(w, [docs[i] for i in np.flatnonzero(held)]))[:, -1]
    best = grades[held] == GRADES - 1
    least = 0.0
    if best.any() and not best.all():
        least = float(np.sort(top[best])[int(max_loss * best.sum())])
    return OrdinalModel(w, cuts, least)


def _graded(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = [buckets(t) for t in batch.column("_text").to_pylist()]
        tail = tails(model.cuts, _sums(model.weights, docs))
        columns = [
            *batch.columns,
            pa.array(tail.sum(1)),
            pa.array(tail[:, -1]),
            pa.array(tail[:, -1] >= model.least),
        ]
        names = [*batch.schema.names, "expected_grade", "p_top", "kept"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [buckets(t) for t in batch.column("_text").to_pylist()]
        columns = [batch.column("_at"), batch.column("_grade"), pa.array(found, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["_at", "_grade", "_buckets"])


def fit_grades(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
) -> OrdinalModel | None:
    """A model from at most ``fit_rows`` labelled rows, by hashed id; None without any.

    Labels with a null are left out; of several labels of one id the lowest quality and the
    highest toxic count.  Texts are hashed where they are; the driver gets the distinct
    buckets of ``fit_rows`` rows at most, also where many rows share a labelled id.
    """
    chosen = (
        labels.select(id_col, "quality", "toxic").dropna()
        .groupBy(id_col)
        .agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(fit_rows)
        .select(id_col, grade(F.col("_q"), F.col("_t")).cast("int").alias("_grade"))
    )
    labelled = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)
    found = (
        labelled.select(F.xxhash64(id_col, "_text").alias("_at"), "_grade", "_text")
        .mapInArrow(_hashed, "_at long, _grade int, _buckets array<int>")
        .orderBy("_at", "_grade")
        .limit(fit_rows)
        .toArrow()
        .sort_by([("_at", "ascending"), ("_grade", "ascending")])
    )
    if found.num_rows < 10:
        return None
    rows = found.column("_buckets").combine_chunks()
    flat, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
    parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return fit(parts, found.column("_grade").to_numpy())


def grade_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with ``expected_grade``, ``p_top`` and ``kept``.

    ``expected_grade`` runs from 0 to 2, ``p_top`` is the probability of the top grade and
    ``kept`` whether it reaches the calibrated one.  Null and empty texts have no words and
    the grade that goes with none; repeated rows stay; an input column called like an
    added one is replaced.  Without labels all rows are kept with probability 1.

    One pass over the texts after the bounded fit, no shuffle.
    """
    added = [
        T.StructField("expected_grade", T.DoubleType()),
        T.StructField("p_top", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
    folded = Folded(docs, text_col, [f.name for f in added])
    model = fit_grades(docs, labels, id_col, text_col)
    if model is None:
        top = {"expected_grade": F.lit(float(GRADES - 1)), "p_top": F.lit(1.0), "kept": F.lit(True)}
        return folded.unfolded(folded.rows.withColumns(top))
    schema = T.StructType([*folded.rows.schema.fields, *added])
    return folded.unfolded(
        folded.rows.mapInArrow(lambda batches: _graded(batches, model), schema)
    )
