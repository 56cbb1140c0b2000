"""Semantic search and conversation context on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.operators import search, vector_cells
from storeloom.operators.knn_join import knn_join
from storeloom.plans.fixtures import table
from storeloom.plans.registry import query
from storeloom.session import work_folder

DISTANCE = """round(round(1 - list_cosine_similarity(CAST({a}.embedding AS DOUBLE[]),
    CAST({b}.embedding AS DOUBLE[])), 9), 6)"""


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row, handed over by whoever asks."""
    probe = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == 0)
    return probe.select("embedding").first()["embedding"]


@query(
    "knn_exact",
    f"""
    SELECT e.vec_id, e.label, {DISTANCE.format(a="e", b="q")} AS distance
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
        DESC, vec_id LIMIT 4
    """,
)
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.knn(
        table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 4, "vec_id", "embedding"
    )
    return near.withColumn("distance", F.round("distance", 6))


@query(
    "knn_governed",
    f"""
    SELECT e.vec_id, {DISTANCE.format(a="e", b="q")} AS distance
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
    LEFT JOIN labels l ON l.doc_id = e.vec_id,
         (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE d.lang = 'en' AND coalesce(l.toxic, 0) <> 1
    ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
        DESC, vec_id LIMIT 10
    """,
)
def knn_governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Toxic documents play the hidden category; unlabelled ones have no category.
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("vec_id"),
        F.when(F.col("toxic") == 1, search.HIDDEN_CATEGORY).alias("categoria"),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    corpus = (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "embedding")
        .join(docs, "vec_id")
        .join(labels, "vec_id", "left")
    )
    near = search.knn(
        search.governed(corpus),
        _probe(spark, sf_dir),
        10,
        "vec_id",
        "embedding",
        allowed=F.col("lang") == "en",
    )
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "knn_join",
    f"""
    SELECT query_id, corpus_id, rank, distance FROM (
        SELECT q.vec_id AS query_id, c.vec_id AS corpus_id,
               {DISTANCE.format(a="q", b="c")} AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(
                   CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9),
                   c.vec_id) AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id)
    WHERE rank <= 3
    """,
)
def knn_join_(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    near = knn_join(vectors, vectors, 3, "vec_id", "vec_id", "embedding", skip_same_id=True)
    return near.withColumn("distance", F.round("distance", 6))


@query(
    "knn_join_cells",
    f"""
    SELECT query_id, corpus_id, rank, distance FROM (
        SELECT q.vec_id AS query_id, c.vec_id AS corpus_id,
               {DISTANCE.format(a="q", b="c")} AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(
                   CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9),
                   c.vec_id) AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id)
    WHERE rank <= 2
    """,
)
def knn_join_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of large query sets, cell by cell."""
    vectors = table(spark, sf_dir, "embeddings")
    near = knn_join(
        vectors, vectors, 2, "vec_id", "vec_id", "embedding", skip_same_id=True, broadcast_bytes=0
    )
    return near.withColumn("distance", F.round("distance", 6))


@query("knn_lsh")
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn_lsh(
        table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 4, "vec_id", "embedding", report=True
    )


# Small cells, so that the smallest tables have some.
CELL_ROWS, NEIGHBOURS = 64, 10


def _cells(spark: SparkSession, sf_dir: str) -> tuple[vector_cells.VectorCells, DataFrame, DataFrame]:
    """The index of all vectors, the vectors, and those that are asked for."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    root = work_folder(spark, "vector_cells")
    index = vector_cells.build_cells(vectors, "vec_id", "embedding", root, NEIGHBOURS, CELL_ROWS)
    return index, vectors, vectors.filter("vec_id % 100 = 0")


@query("knn_cells")
def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _, queries = _cells(spark, sf_dir)
    near = vector_cells.search_cells(index, queries, "vec_id", "embedding", NEIGHBOURS)
    return near.withColumn("distance", F.round("distance", 6))


@query(
    "knn_cells_recall",
    f"""
    SELECT count(*) FILTER (vec_id % 100 = 0) AS queries,
           count(*) FILTER (vec_id % 100 = 0) * least({NEIGHBOURS}, count(*)) AS answers,
           true AS recall_reached
    FROM embeddings
    """,
)
def knn_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the queries' exact neighbours, nine of ten are found through the cells."""
    index, vectors, queries = _cells(spark, sf_dir)
    near = vector_cells.search_cells(index, queries, "vec_id", "embedding", NEIGHBOURS)
    keys = ["query_id", "corpus_id"]
    exact = knn_join(queries, vectors, NEIGHBOURS, "vec_id", "vec_id", "embedding").select(*keys)
    both = near.select(*keys, F.lit(1).alias("found")).join(
        exact.withColumn("right", F.lit(1)), keys, "full_outer"
    )
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        F.sum("found").alias("answers"),
        (F.count(F.col("found") + F.col("right")) >= 0.9 * F.sum("right")).alias("recall_reached"),
    )


@query(
    "embedding_check",
    """
    SELECT 'missing' AS defect, count(*) FILTER (label = 0) AS n_rows FROM embeddings
    UNION ALL SELECT 'wrong_length', count(*) FILTER (label = 1) FROM embeddings
    UNION ALL SELECT 'not_a_number', count(*) FILTER (label = 2) FROM embeddings
    UNION ALL SELECT 'zero_length', count(*) FILTER (label = 3) FROM embeddings
    """,
)
def embedding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The clean vectors of four labels are damaged, each label in its own way.
    label, v = F.col("label"), F.col("embedding")
    damaged = (
        F.when(label == 0, F.lit(None))
        .when(label == 1, F.slice(v, 1, 63))
        .when(label == 2, F.transform(v, lambda x: F.when(x > 0, F.lit(float("nan"))).otherwise(x)))
        .when(label == 3, F.transform(v, lambda x: x * F.lit(0).cast("float")))
        .otherwise(v)
    )
    vectors = table(spark, sf_dir, "embeddings").select(damaged.alias("embedding"))
    return search.check_vectors(vectors, "embedding", 64)


@query(
    "context_compact",
    """
    SELECT conv_id, turn, role, used, role = 'system' OR used <= 2000 AS kept FROM (
        SELECT conv_id, turn, role,
               CAST(sum(CASE WHEN role = 'system' THEN 0 ELSE length(text) END)
                   OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS used
        FROM conversations)
    """,
)
def context_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return search.compact(turns, "conv_id", "turn", "role", "text", 2000).drop("text")


@query(
    "context_compact_hot",
    """
    SELECT conv_id, turn, role, used, role = 'system' OR used <= 2000 AS kept FROM (
        SELECT conv_id, turn, role,
               CAST(sum(CASE WHEN role = 'system' THEN 0 ELSE length(text) END)
                   OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST) AS BIGINT) AS used
        FROM (SELECT * REPLACE (CASE WHEN turn <> 3 THEN turn END AS turn) FROM conversations))
    """,
)
def context_compact_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation cut into buckets, one turn without a number."""
    turns = table(spark, sf_dir, "conversations")
    turns = turns.withColumn("turn", F.when(F.col("turn") != 3, F.col("turn")))
    return search.compact(
        turns, "conv_id", "turn", "role", "text", 2000, turns_per_bucket=2, hot_rows=1
    ).drop("text")
