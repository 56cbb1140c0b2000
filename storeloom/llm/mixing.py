"""Mixing documents to target weights of domains that a document belongs to in part.

A classifier fitted on the labelled table gives every document a posterior over domains;
projected-gradient least squares then finds a nonnegative rate per document so that the
expected tokens of every domain meet their targets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.llm.common import SPACES, body, saved

DOMAINS = ("clean", "poor", "toxic")
# Shares of the tokens after mixing.  Without a given total, the total is such that the
# first domain keeps all its tokens.
TARGETS = {"clean": 0.92, "poor": 0.05, "toxic": 0.03}

MARKS = r"[#*$%&|<>!]+"
BUCKETS = 1 << 16  # hashed features
FIT_ROWS = 20_000  # labelled documents the classifier is fitted on, at most
CHI2 = 20.0  # features whose counts deviate less from chance carry no weight
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
START = 6  # the start of a longer word is a feature of its own
# Weights are fitted together, under an L1 penalty: many ordinary words that lean a little
# one way would otherwise add up to false certainty.
EPOCHS, BATCH, PACE, PENALTY, SEED = 40, 512, 0.2, 3e-4, 3
# One labelled document in HELD, by its text, is kept out of the fit; on those, at most this
# share of the clean ones may count as recognised toxic.
HELD, MAX_LOSS = 5, 0.01
CLOSE = 1e-6  # stop when all domains are this close to their targets, as a share of all
# Or when a round takes less than this share off the distance, or after so many rounds.
GAIN, ROUNDS = 0.02, 16


@dataclass(frozen=True)
class DomainModel:
    """Log odds of a domain, per hashed feature and at the start (rows: domains).

    ``toxic_from`` is the calibrated toxic posterior from which a document is recognised.
    """

    start: tuple[float, ...]
    weights: Mapping[int, tuple[float, ...]]
    toxic_from: float = math.inf


def domain(quality: Column, toxic: Column) -> Column:
    """The domain a label stands for; toxic goes before poor."""
    return (
        F.when(toxic == 1, F.lit("toxic")).when(quality == 0, F.lit("poor")).otherwise("clean")
    )


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space, as an array; none in an empty text."""
    trimmed = F.btrim(F.lower(text), F.lit(SPACES))
    found = F.split(trimmed, "[ \t\n\x0b\x0c\r]+")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(found)


def marks(text: Column) -> Column:
    """Distinct runs of symbols and exclamation marks, as an array."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MARKS), F.lit(0)))


def bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _with_features(docs: DataFrame, text_col: str, known: Column | None = None) -> DataFrame:
    """Add ``_tokens`` and ``_features``: the distinct buckets, of those that are known.

    Features are words without ASCII punctuation at their ends, the starts of longer words,
    and marks.
    """
    text = body(text_col)
    rows = docs.withColumns({"_words": words(text), "_marks": marks(text)})
    rows = rows.withColumn(
        "_bare", F.array_distinct(F.transform("_words", lambda w: F.btrim(w, F.lit(PUNCTUATION))))
    )
    starts = F.transform(
        F.filter("_bare", lambda w: F.length(w) > START),
        lambda w: F.concat(F.lit("\x01"), F.substring(w, 1, START)),
    )
    found = F.transform(F.concat("_bare", starts, "_marks"), bucket)
    if known is not None:
        found = F.filter(found, lambda b: known[b])
    return rows.withColumns(
        {"_tokens": F.size("_words").cast("long"), "_features": F.array_distinct(found)}
    ).drop("_words", "_bare", "_marks")


def _flat(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The row and the feature of every entry."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)


def _shares(rows: Sequence[np.ndarray], start: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The posterior of every row, a column per domain."""
    at, features = _flat(rows)
    score = np.stack(
        [np.bincount(at, weights[features, i], len(rows)) for i in range(len(DOMAINS))], 1
    ) + start
    odds = np.exp(score - score.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True)


def _fit_weights(
    rows: Sequence[np.ndarray], kinds: np.ndarray, prior: Sequence[float], n_features: int
) -> tuple[np.ndarray, np.ndarray]:
    """Start and weights of a softmax regression, by proximal AdaGrad from the prior."""
    weights, start = np.zeros((n_features, len(DOMAINS))), np.log(np.array(prior))
    sums, start_sums = np.full(weights.shape, 1e-8), np.full(len(DOMAINS), 1e-8)
    order, rng, truth = np.arange(len(rows)), np.random.default_rng(SEED), np.eye(len(DOMAINS))
    batch = min(BATCH, max(16, len(rows) // 32))  # few rows still make some steps
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for first in range(0, len(rows), batch):
            ids = order[first : first + batch]
            part = [rows[i] for i in ids]
            push = (_shares(part, start, weights) - truth[kinds[ids]]) / len(ids)
            at, features = _flat(part)
            grad = np.stack(
                [np.bincount(features, push[at, i], n_features) for i in range(len(DOMAINS))], 1
            )
            sums += grad**2
            pace = PACE / np.sqrt(sums)
            weights = weights - pace * grad
            weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * PENALTY, 0.0)
            start_sums += push.sum(0) ** 2
            start = start - PACE / np.sqrt(start_sums) * push.sum(0)
    return start - np.log(np.exp(start).sum()), weights


def _toxic_from(shares: np.ndarray, kinds: np.ndarray, nothing: float) -> float:
    """The least toxic posterior that loses ``MAX_LOSS`` of the held-out clean rows at most.

    Above the posterior of a text that tells ``nothing``; without clean rows one half.
    """
    clean = np.sort(shares[kinds == 0, DOMAINS.index("toxic")])[::-1]
    if not len(clean):
        return max(0.5, nothing + 1e-6)
    return round(max(float(clean[int(MAX_LOSS * len(clean))]), nothing) + 2e-6, 6)


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
) -> DomainModel:
    """Fit the classifier on at most ``fit_rows`` labelled documents, chosen by hashed id.

    ``labels`` has the id, ``quality`` and ``toxic``; rows with a null are left out, of
    several rows of one id the lowest quality and the highest toxic count.  Counts are
    summed by Spark; the driver gets the buckets that tell domains apart better than chance,
    at most ``BUCKETS`` of them, and ``fit_rows`` chosen rows at most as lists of those, also
    where many rows share a labelled id.  Without
    labelled documents all domains are equally likely everywhere.
    """
    chosen = (
        labels.select(F.col(id_col), F.col("quality"), F.col("toxic"))
        .dropna()
        .groupBy(id_col)
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(fit_rows)
        .select(id_col, domain(F.col("quality"), F.col("toxic")).alias("_domain"))
    )
    # At most fit_rows ids: small enough to send to every task, whatever the corpus.
    labelled = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    kind = F.array_position(F.array(*map(F.lit, DOMAINS)), F.col("_domain")).cast("int") - 1
    text = body(text_col)
    seen = saved(
        _with_features(labelled, text_col).select(
            kind.alias("_kind"),
            # Copies of a text are held out together.
            (F.pmod(F.xxhash64(F.lit("held"), text), F.lit(HELD)) == 0).alias("_held"),
            F.xxhash64(id_col, text).alias("_at"),
            "_features",
        ),
        "mixing-features",
    )
    fitted = seen.filter("NOT _held")
    counts = {r["_kind"]: r["n"] for r in fitted.groupBy("_kind").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if not n:
        return DomainModel((-math.log(len(DOMAINS)),) * len(DOMAINS), {})
    prior = [(counts.get(i, 0) + 1.0) / (n + len(DOMAINS)) for i in range(len(DOMAINS))]
    per_domain = [
        F.count(F.when(F.col("_kind") == i, 1)).alias(f"n_{i}") for i in range(len(DOMAINS))
    ]
    tally = (
        fitted.select("_kind", F.explode("_features").alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("n"), *per_domain)
    )
    telling = F.lit(False)
    for i, p in enumerate(prior):
        off = F.col(f"n_{i}") - F.col("n") * p
        telling = telling | (off * off > CHI2 * p * (1 - p) * F.col("n"))
    told = np.array(sorted(r["_bucket"] for r in tally.filter(telling).select("_bucket").collect()), np.int64)
    isin = np.zeros(BUCKETS, bool)
    isin[told] = True
    known = _table([str(x).lower() for x in isin], "boolean")
    found = (
        seen.select("_at", "_kind", "_held", F.filter("_features", lambda b: known[b]).alias("_features"))
        .orderBy("_at", "_kind")
        .limit(fit_rows)
        .toArrow()
        .sort_by([("_at", "ascending"), ("_kind", "ascending")])
    )
    lists = found.column("_features").combine_chunks()
    flat, ends = np.searchsorted(told, lists.values.to_numpy()), lists.offsets.to_numpy()
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    kinds = found.column("_kind").to_numpy()
    held = found.column("_held").to_numpy()
    start, fit = _fit_weights(
        [rows[i] for i in np.flatnonzero(~held)], kinds[~held], prior, len(told)
    )
    start, fit = start.round(6), fit.round(6)
    shares = _shares([rows[i] for i in np.flatnonzero(held)], start, fit)
    nothing = _shares([flat[:0]], start, fit)[0, DOMAINS.index("toxic")]
    weights = {int(b): tuple(map(float, w)) for b, w in zip(told, fit) if w.any()}
    return DomainModel(
        tuple(map(float, start)), weights, _toxic_from(shares, kinds[held], float(nothing))
    )


def _table(values: Sequence[float], kind: str = "double") -> Column:
    """A constant array that the optimizer folds once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _score(model: DomainModel, i: int) -> Column:
    """Log odds of domain ``i`` for a row's telling buckets."""
    at_start = F.lit(model.start[i])
    if not model.weights:
        return at_start
    weights = _table([model.weights[b][i] if b in model.weights else 0.0 for b in range(BUCKETS)])
    return F.aggregate("_features", at_start, lambda s, b: s + weights[b])


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """The rows with ``n_tokens`` and ``p_<domain>`` for every domain.

    A null text has no tokens and the posterior of an empty one.  Probabilities have six
    digits and sum to 1, so sums over them do not depend on the order of the rows.
    """
    rows = docs.withColumn("_text", body(text_col))
    known = None
    if model.weights:
        known = _table([str(b in model.weights).lower() for b in range(BUCKETS)], "boolean")
    rows = _with_features(rows, "_text", known)
    scores = [_score(model, i) for i in range(len(DOMAINS))]
    rows = rows.withColumns({f"_s{i}": s for i, s in enumerate(scores)})
    top = F.greatest(*[f"_s{i}" for i in range(len(scores))])
    total = sum((F.exp(F.col(f"_s{i}") - top) for i in range(1, len(scores))), F.exp(F.col("_s0") - top))
    shares = {
        f"p_{d}": F.round(F.exp(F.col(f"_s{i}") - top) / total, 6)
        for i, d in enumerate(DOMAINS)
        if i
    }
    rows = rows.withColumns(shares)
    rest = F.lit(1.0)
    for d in DOMAINS[1:]:
        rest = rest - F.col(f"p_{d}")
    # Two shares rounded up can leave the first one a millionth short of nothing.
    first = F.greatest(F.round(rest, 6), F.lit(0.0))
    rows = rows.withColumns({f"p_{DOMAINS[0]}": first, "n_tokens": F.col("_tokens")})
    return rows.drop("_text", "_tokens", "_features", *[f"_s{i}" for i in range(len(scores))])


def least_rate(keep_from: float | None) -> Column:
    """The bound of a row's rate: 1 from a posterior of the first domain on, else 0."""
    if keep_from is None:
        return F.lit(0.0)
    return F.when(F.col(f"p_{DOMAINS[0]}") >= keep_from, 1.0).otherwise(0.0)


def rate(
    steps: Sequence[Sequence[float]], keep_from: float | None = None, most: float | None = None
) -> Column:
    """The rate after the given projected steps, from 1, for a row with posteriors.

    The steps are a constant that is gone through row by row, so that many of them make no
    long expression.
    """
    if not len(steps):
        return F.lit(1.0)
    least = least_rate(keep_from)

    def moved(r: Column, step: Column) -> Column:
        move = F.col(f"p_{DOMAINS[0]}") * step[f"c{0}"]
        for i, d in enumerate(DOMAINS[1:], 1):
            move = F.col(f"p_{d}") * step[f"c{i}"] + move
        r = F.greatest(least, r - move)
        return r if most is None else F.least(F.lit(float(most)), r)

    moves = F.array(*[F.struct(*[F.lit(float(c)).alias(f"c{i}") for i, c in enumerate(s)]) for s in steps])
    return F.aggregate(moves, F.lit(1.0), moved)


class Steps(list):
    """Steps for ``rate``, with the tokens per domain that they lead to and those aimed at."""

    def __init__(self, steps: Sequence = (), expected: Sequence[float] = (), wanted: Sequence[float] = ()) -> None:
        super().__init__(steps)
        self.expected = dict(zip(DOMAINS, map(float, expected)))
        self.wanted = dict(zip(DOMAINS, map(float, wanted)))

    @property
    def miss(self) -> float:
        """The largest distance of a domain from its target, as a share of all tokens wanted."""
        total = sum(self.wanted.values())
        gaps = [abs(self.expected[d] - w) for d, w in self.wanted.items()]
        return max(gaps) / total if total else 0.0


def fit_rates(
    soft: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    total: float | None = None,
    keep_from: float | None = None,
    most: float | None = None,
) -> Steps:
    """Steps of projected gradient descent, to be given to ``rate``.

    Minimises the squared distance of the domains' expected tokens from their targets over
    nonnegative rates, or such that are at least 1 where the posterior of the first domain
    reaches ``keep_from``.  Rates move in the metric of token counts, so documents of equal
    posteriors keep equal rates, and the gradient is scaled by the token moments of the
    documents whose rate is above its bound, which makes one the right step length.  A round is one
    sum over all rows; only a few numbers per domain reach the driver.  Ends at the targets
    (``CLOSE``), or when a round gains hardly more (``GAIN``) or after ``ROUNDS``; the steps tell
    which by their ``miss``.  Domains without tokens cannot meet a target and are left
    out; an empty table gives no steps.  With ``most`` no rate exceeds it, and the targets
    are upper bounds: a domain that has less from the start is not made more.
    """
    cols = [F.col(f"p_{d}") for d in DOMAINS]
    k = range(len(DOMAINS))
    steps: list[list[float]] = []

    def state() -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens per domain, and the moments of what is above its bound."""
        rows = soft.select("n_tokens", *cols, rate(steps, keep_from, most).alias("_rate"))
        free = F.col("_rate") > least_rate(keep_from) if steps else F.lit(True)
        mass = F.when(free, F.col("n_tokens")).otherwise(0)
        got = rows.agg(
            *[F.sum(F.col("n_tokens") * c * F.col("_rate")).alias(f"t{i}") for i, c in enumerate(cols)],
            *[F.sum(mass * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in k for j in k],
        ).first()
        return (
            np.array([got[f"t{i}"] or 0.0 for i in k]),
            np.array([[got[f"m{i}_{j}"] or 0.0 for j in k] for i in k]),
        )

    now, moments = state()
    if not now.sum():
        return Steps()
    share = np.array([targets[d] for d in DOMAINS], dtype=float)
    share /= share.sum()
    if total is None:
        total = now[0] / share[0] if now[0] and share[0] else now.sum()
    goal = np.where(now > 0, share * total, 0.0)
    if most is not None:
        goal = np.minimum(goal, now)
    whole = np.linalg.pinv(moments, rcond=1e-6, hermitian=True)

    def distance(tokens: np.ndarray) -> float:
        return float((tokens - goal) @ whole @ (tokens - goal))

    while np.abs(now - goal).max() > CLOSE * total and len(steps) < ROUNDS:
        active = np.linalg.pinv(moments, rcond=1e-6, hermitian=True)
        best, old = None, list(steps)
        # The last, with the moments of all documents, is the step that never overshoots.
        for inverse, length in ((active, 1.0), (active, 0.5), (active, 0.25), (whole, 1.0)):
            move = [float(f"{length * c:.9g}") for c in inverse @ (now - goal)]
            steps[:] = [*old, move]
            tried = state()
            if best is None or distance(tried[0]) < distance(best[0][0]):
                best = tried, move
            if distance(tried[0]) < (1 - 0.5 * length) * distance(now):
                break
        if not distance(best[0][0]) < (1 - GAIN) * distance(now):
            steps[:] = old
            break
        (now, moments), steps[:] = best[0], [*old, best[1]]
    return Steps(steps, now, goal)


def copies(rates: Column, id_col: str, seed: int = 11) -> Column:
    """How often a row is taken: its rate, rounded up or down by a hash of its id."""
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rates + chance).cast("long")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    total: float | None = None,
) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``p_<domain>``, ``rate``, ``copies`` and ``miss``.

    ``miss`` is one value: how far the domain that is farthest from its target stays off it
    after the fit, as a share of all tokens wanted.  Null and empty texts have no tokens and the prior of the domains; repeated rows are
    rows like others; other columns are not looked at.  Every text is read once for the
    few labelled ones and once for the posteriors, which are written down; the rounds read
    only those narrow rows.  No text is shuffled.
    """
    model = fit_domains(docs, labels, id_col, text_col)
    names = [f"p_{d}" for d in DOMAINS]
    soft = saved(
        with_posteriors(docs.select(id_col, text_col), model, text_col).select(
            id_col, "n_tokens", *names
        ),
        "mixing-posteriors",
    )
    steps = fit_rates(soft, targets, total)
    return soft.withColumns(
        {"rate": rate(steps), "copies": copies(rate(steps), id_col), "miss": F.lit(steps.miss)}
    )


def take_mixed(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_from: float | None = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that mixing takes at least once, each once, columns unchanged.

    Recognised toxic documents (``DomainModel.toxic_from``) go first, whatever their share
    of the corpus.  Of the others, documents whose posterior of the first domain reaches
    ``keep_from`` have a rate of one and so stay; the rest is thinned out towards the
    targets, which are upper bounds, as no rate exceeds one.  Null and empty texts have the
    posterior of the prior.
    """
    model = fit_domains(docs, labels, id_col, text_col)
    names = [f"p_{d}" for d in DOMAINS]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(
        F.struct(*columns).alias("_whole"), F.col(id_col).alias("_id"), F.col(text_col).alias("_body")
    )
    # Written with the posteriors, so that the rates are worked out on these few columns.
    scored = saved(
        with_posteriors(whole, model, "_body").select("_whole", "_id", "n_tokens", *names),
        "mixing-scored",
    )
    left = scored.filter(F.col("p_toxic") < F.lit(model.toxic_from))
    steps = fit_rates(left, targets, keep_from=keep_from, most=1.0)
    return left.filter(copies(rate(steps, keep_from, 1.0), "_id") >= 1).select("_whole.*")
