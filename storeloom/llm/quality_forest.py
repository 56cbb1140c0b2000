"""Quality rules: base rules on text statistics, then an isolation forest over them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeloom.llm.common import Folded

# The base rules and the characters they count.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

FIT_ROWS = 20_000  # labelled documents looked at, at most: half to fit, half to calibrate
TREES, PER_TREE = 200, 256
SEED = 5
# A ratio breaks its rule this many spreads beyond these quantiles of the good labelled
# documents.
NORMAL, MARGIN = 0.0005, 2.0
# The share of good labelled documents that the calibrated threshold may reject, at most.
MAX_LOSS = 0.002
# Texts of more words than this have their windows found by sorting instead of hashing.
LONG_TEXT = 50_000

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
BLANKS = b" \t\n\x0b\x0c\r"
OTHER_MARKS = b"!?.,;:'\"()[]{}=+-_/\\@^~`"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "symbols_per_word", "upper_share", "digit_share", "shouts_per_word", "marks_per_word",
    "word_length", "dup_line_share", "repeat_share", "ended_lines", "words_per_line",
)


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a five-word window found at least twice, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n > LONG_TEXT:
        return _repeat_words_sorted(words)
    first: dict[tuple, int] = {}
    starts = set()
    for i, window in enumerate(zip(*[words[j:] for j in range(WINDOW)])):
        at = first.setdefault(window, i)
        if at != i:
            starts.add(at)
            starts.add(i)
    return _covered(sorted(starts))


def _repeat_words_sorted(words: list[bytes]) -> int:
    """The same with a few arrays as long as the text: windows get ranks by doubling."""
    codes: dict[bytes, int] = {}
    rank = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    ranks, width = rank, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        _, ranks = np.unique(pairs, return_inverse=True)
        width += step
    found = np.bincount(ranks)[ranks] > 1
    return _covered(np.flatnonzero(found).tolist())


def _covered(starts: Iterable[int]) -> int:
    total, end = 0, 0
    for s in starts:
        total += s + WINDOW - max(s, end)
        end = s + WINDOW
    return total


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics and the ratios of one text, a null one as empty."""
    text = text or ""
    data = text.encode()
    words = data.split()  # at ASCII white space only
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    word_chars = len(text) - _count(data, BLANKS)
    symbols = _count(data, SYMBOLS)
    repeated = repeat_words(words)
    dup = len(lines) - len(set(lines))
    base = [n, word_chars, symbols, dup, repeated]
    at_least, chars = max(n, 1), max(word_chars, 1)
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines)
    ratios = [
        symbols / at_least,
        _count(data, UPPER) / max(_count(data, LETTERS), 1),
        _count(data, DIGITS) / chars,
        data.count(b"!") / at_least,
        _count(data, OTHER_MARKS) / at_least,
        word_chars / at_least,
        dup / max(len(lines), 1),
        repeated / at_least,
        ended / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
    ]
    return base, ratios


def base_failed(base: list[int]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]


@dataclass(frozen=True)
class Forest:
    """Trees side by side: feature (-1: leaf), cut, left child (right is next), path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    low: np.ndarray  # the normal range of every ratio and its spread
    high: np.ndarray
    spread: np.ndarray
    threshold: float  # anomaly scores above it are rejected

    def violations(self, ratios: np.ndarray) -> np.ndarray:
        """How far every ratio is outside its normal range, in spreads, on a log scale."""
        beyond = np.maximum(ratios - self.high, self.low - ratios) / self.spread
        return np.log1p(np.maximum(beyond, 0.0))


def _usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, trees: int, per_tree: int, seed: int) -> tuple[np.ndarray, ...]:
    """Trees over ``rows`` (documents by statistics): feature, cut, left child, path length."""
    rng = np.random.default_rng(seed)
    size = min(per_tree, len(rows))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    shape = (trees, 2 ** (limit + 1))
    feature, left = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
    cut, path = np.zeros(shape), np.zeros(shape)
    for t in range(trees):
        todo, free = [(0, rows[rng.choice(len(rows), size, replace=False)], 0)], 1
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            uneven = np.flatnonzero(high > low)
            if depth == limit or len(part) <= 1 or not len(uneven):
                path[t, node] = depth + _usual_path(len(part))
                continue
            f = int(rng.choice(uneven))
            at = rng.uniform(low[f], high[f])
            below = part[:, f] <= at
            feature[t, node], cut[t, node], left[t, node] = f, at, free
            todo += [(free, part[below], depth + 1), (free + 1, part[~below], depth + 1)]
            free += 2
    return feature, cut, left, path / max(_usual_path(size), 1e-9)


def fit(
    ratios: np.ndarray,
    good: np.ndarray,
    max_loss: float = MAX_LOSS,
    trees: int = TREES,
    per_tree: int = PER_TREE,
    seed: int = SEED,
) -> Forest | None:
    """A forest from labelled rows: every other row grows the trees, the rest calibrate.

    None if there are no good rows to take the normal ranges from.
    """
    grown, known = ratios[::2], good[::2]
    if not known.any():
        return None
    low, high = np.quantile(grown[known], [NORMAL, 1 - NORMAL], axis=0)
    spread = np.maximum(grown[known].std(0), 0.01)
    low, high = low - MARGIN * spread, high + MARGIN * spread
    empty = np.zeros((1, 1))
    ranges = Forest(empty, empty, empty, empty, low, high, spread, math.inf)
    parts = grow(ranges.violations(grown), trees, per_tree, seed)
    forest = replace(ranges, feature=parts[0], cut=parts[1], left=parts[2], path=parts[3])
    threshold = calibrate(anomaly(forest, ratios[1::2]), good[1::2], max_loss)
    return replace(forest, threshold=threshold)


def anomaly(forest: Forest, ratios: np.ndarray, block: int = 4096) -> np.ndarray:
    """Scores from 0 to 1; the shorter the mean path, the higher."""
    rows = forest.violations(ratios)
    out = np.zeros(len(rows))
    tree = np.arange(len(forest.feature))
    for at in range(0, len(rows), block):
        part = rows[at : at + block]
        node = np.zeros((len(part), len(tree)), np.int32)
        line = np.arange(len(part))[:, None]
        while True:
            f = forest.feature[tree, node]
            inner = f >= 0
            if not inner.any():
                break
            right = part[line, np.maximum(f, 0)] > forest.cut[tree, node]
            node = np.where(inner, forest.left[tree, node] + right, node)
        out[at : at + block] = 2.0 ** -forest.path[tree, node].mean(1)
    return out


def calibrate(scores: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The threshold that rejects most bad rows, among those that spare the good ones.

    At most ``max_loss`` of the good rows, rounded up, may score above it.  With no bad rows, or none
    that can be told from good ones, nothing is rejected.
    """
    if not len(scores) or good.all() or not good.any():
        return math.inf
    kept = np.sort(scores[good])[::-1]
    lowest = kept[min(math.ceil(max_loss * len(kept)), len(kept) - 1)]
    above = np.sort(scores[~good])
    above = above[above > lowest]
    return float((lowest + above[0]) / 2) if len(above) else math.inf


_VERDICTS = ["base_failed", "anomaly", "kept"]


def _statistics_table(
    batches: Iterator[pa.RecordBatch], forest: Forest | None
) -> Iterator[pa.RecordBatch]:
    """The batch's columns, then base statistics and verdicts, without a forest the ratios."""
    for batch in batches:
        found = [statistics(t) for t in batch.column("_text").to_pylist()]
        base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
        ratios = np.array([r for _, r in found]).reshape(-1, len(RATIOS))
        failed = np.array([base_failed(b) for b, _ in found], bool)
        score = np.zeros(len(found)) if forest is None else anomaly(forest, ratios)
        kept = ~failed if forest is None else ~failed & (score <= forest.threshold)
        columns = [*batch.columns, *[pa.array(c) for c in base.T]]
        columns += [pa.array(failed), pa.array(score), pa.array(kept)]
        names = [*batch.schema.names, *BASE, *_VERDICTS]
        if forest is None:
            columns += [pa.array(c) for c in ratios.T]
            names += RATIOS
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _scan(docs: DataFrame, text_col: str, forest: Forest | None) -> DataFrame:
    added = [T.StructField(n, T.LongType()) for n in BASE]
    added += [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("anomaly", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
    if forest is None:
        added += [T.StructField(n, T.DoubleType()) for n in RATIOS]
    folded = Folded(docs, text_col, [f.name for f in added])
    schema = T.StructType([*folded.rows.schema.fields, *added])
    return folded.unfolded(
        folded.rows.mapInArrow(lambda batches: _statistics_table(batches, forest), schema)
    )


def fit_forest(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
    max_loss: float = MAX_LOSS,
) -> Forest | None:
    """A forest and its threshold from at most ``fit_rows`` labelled rows, by hashed id.

    Rows that the base rules reject take no part.  Of the others, one half grows the trees
    and the other, by its ``quality``, sets the threshold.  Labels with a null are left out;
    of several labels of one id the lowest quality counts.  None without labelled rows.
    """
    chosen = (
        labels.select(id_col, "quality").dropna()
        .groupBy(id_col)
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(fit_rows)
    )
    # At most fit_rows ids, so small enough for every task whatever the corpus; the rows with
    # them are bounded once more below, as many may share an id.
    labelled = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    seen = _scan(labelled.select(id_col, "_quality", text_col), text_col, None)
    found = (
        seen.filter(~F.col("base_failed"))
        .select(F.xxhash64(id_col).alias("_at"), "_quality", *RATIOS)
        .orderBy("_at", "_quality", *RATIOS)
        .limit(fit_rows)
        .toArrow()
        .sort_by([(c, "ascending") for c in ("_at", "_quality", *RATIOS)])
    )
    if found.num_rows < 4:
        return None
    rows = np.column_stack([found.column(c).to_numpy() for c in RATIOS])
    good = found.column("_quality").to_numpy() > 0
    return fit(rows, good, max_loss)


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with base statistics, ``base_failed``, ``anomaly`` and ``kept``.

    A row is kept if the base rules (at least 10 words, at most 20 % of them in repeated
    five-word windows) and the forest's threshold let it pass.  A null or empty text has no
    words and fails.  Repeated rows stay; an input column called like an added one is
    replaced.  Without labels the base rules decide alone.

    One pass over the texts after the bounded fit, no shuffle.
    """
    forest = fit_forest(docs, labels, id_col, text_col)
    if forest is None:
        return _scan(docs, text_col, None).drop(*RATIOS)
    return _scan(docs, text_col, forest)
