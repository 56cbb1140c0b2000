"""Semantic search over a knowledge base, and conversation context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.functions.hot import HOT_ROWS
from storeloom.functions.ordered import running_sum
from storeloom.functions.vectors import cosine_distance, norm

# Fixed value: the category that must never reach a customer conversation.
HIDDEN_CATEGORY = "dev_reference"


def governed(
    corpus: DataFrame, category: str = "categoria", hidden: str = HIDDEN_CATEGORY
) -> DataFrame:
    """The part of the knowledge base a sales conversation may see; rows without a
    category may be seen."""
    return corpus.filter(~F.col(category).eqNullSafe(F.lit(hidden)))


def knn(
    corpus: DataFrame,
    query: Sequence[float],
    k: int,
    row_id: str,
    vector: str,
    allowed: Column | None = None,
) -> DataFrame:
    """The ``k`` nearest rows by cosine distance, ties by id.

    ``allowed`` filters before ranking.  Each task keeps its own best ``k``; vectors
    without a direction (null, zero, other length) have no distance and are left out.
    """
    if allowed is not None:
        corpus = corpus.filter(allowed)
    return (
        corpus.withColumn("distance", cosine_distance(F.col(vector), query))
        .filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
        .drop(vector)
        .orderBy("distance", row_id)
        .limit(k)
    )


def knn_lsh(
    corpus: DataFrame,
    query: Sequence[float],
    k: int,
    row_id: str,
    vector: str,
    tables: int = 8,
    bucket: float = 0.5,
    seed: int = 7,
    report: bool = False,
) -> DataFrame:
    """Approximate search through random projections of the unit vectors.

    Only rows sharing a hash bucket with the query are compared; buckets are widened until
    ``k`` rows are found, and where that is not enough the exact search answers.  With
    ``report`` an exact search runs too, and ``exact_hit`` tells which of the answers it gives;
    its mean is the recall.  A query without a direction has no neighbours.  For searches with
    a measured recall over many queries see ``vector_cells``.
    """
    length = sum(float(x) ** 2 for x in query) ** 0.5
    unit = [float(x) / (length or 1.0) for x in query]
    usable = (norm(F.col(vector)) > 0) & (F.size(vector) == len(unit))
    scaled = F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector)))
    points = corpus.filter(usable).select(row_id, array_to_vector(scaled).alias("_unit"))
    wanted = min(k, points.limit(k).count())
    found = None
    # Unit vectors are at most 2 apart, so wider buckets than 8 change nothing any more.
    while length and bucket < 32:
        lsh = BucketedRandomProjectionLSH(
            inputCol="_unit", outputCol="_hashes", numHashTables=tables, bucketLength=bucket, seed=seed
        )
        near = lsh.fit(points).approxNearestNeighbors(points, Vectors.dense(unit), k, distCol="_d")
        # Squared straight-line distance is twice the cosine distance.
        near = near.select(row_id, F.round(F.col("_d") * F.col("_d") / 2, 6).alias("distance"))
        rows = near.collect()  # k rows at most
        if len(rows) >= wanted:
            found = corpus.sparkSession.createDataFrame(rows, near.schema)
            break
        bucket *= 4
    if found is None:
        # The border between buckets at zero parts some rows from the query at any width.
        exact = knn(corpus.select(row_id, vector), query, k, row_id, vector)
        found = exact.select(row_id, F.round("distance", 6).alias("distance"))
    if not report:
        return found
    hits = knn(corpus.select(row_id, vector), query, k, row_id, vector).select(row_id)
    return found.join(hits.withColumn("exact_hit", F.lit(True)), row_id, "left").fillna(False, ["exact_hit"])


def check_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows per defect: missing, wrong length, not-a-number, no direction."""
    v = F.col(vector)
    bad_number = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    fits = v.isNotNull() & (F.size(v) == dim)
    checks = {
        "missing": v.isNull(),
        "wrong_length": v.isNotNull() & (F.size(v) != dim),
        "not_a_number": fits & bad_number,
        "zero_length": fits & ~bad_number & (norm(v) == 0),
    }
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    lines = [
        F.struct(F.lit(name).alias("defect"), F.col(name).alias("n_rows")) for name in checks
    ]
    return counts.select(F.inline(F.array(*lines)))


def compact(
    turns: DataFrame,
    conversation: str,
    turn: str,
    role: str,
    text: str,
    budget: int,
    pinned: str = "system",
    turns_per_bucket: int = 256,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mark the turns of each conversation that stay within a budget of characters.

    Counting runs from the newest turn back; pinned (system) turns always stay and use
    none of the budget.  Rows get ``kept``, so what is dropped can be reported.
    """
    is_pinned = F.coalesce(F.col(role) == pinned, F.lit(False))
    cost = F.when(is_pinned, 0).otherwise(F.coalesce(F.length(text), F.lit(0)))
    used = running_sum(
        turns,
        [conversation],
        F.floor(F.col(turn) / F.lit(turns_per_bucket)),
        [F.col(turn).desc()],
        cost,
        "used",
        newest_first=True,
        hot_rows=hot_rows,
    )
    return used.withColumn("kept", is_pinned | (F.col("used") <= budget))
