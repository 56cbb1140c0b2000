import numpy as np
import pytest
from pyspark.sql import functions as F

from storeloom.operators import search, vector_cells
from storeloom.operators.knn_join import knn_join
from storeloom.plans import search_queries


def vectors(spark, n, dim, seed, copies=0):
    """Random vectors; ``copies`` of them are the same vector."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype("float32")
    m[:copies] = m[0]
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(m)], "id BIGINT, vec ARRAY<FLOAT>"
    )
    return m.astype("float64"), df


def brute_force(q, c, k, skip):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = np.round(1 - unit(q) @ unit(c).T, 9)
    if skip:
        np.fill_diagonal(distance, np.inf)
    out = {}
    for i, row in enumerate(distance):
        order = sorted(range(len(row)), key=lambda j: (row[j], j))
        out[i] = [j for j in order[:k] if np.isfinite(row[j])]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.corpus_id)
    return out


@pytest.mark.parametrize("copies", [0, 130])
@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_knn_join_is_exact_both_ways(spark, copies, budget):
    m, df = vectors(spark, 400, 6, 1, copies)
    got = knn_join(df, df, 3, "id", "id", "vec", True, broadcast_bytes=budget, chunk_rows=32, cell_rows=8)
    assert found(got) == brute_force(m, m, 3, True)


def test_knn_join_by_cells_with_fewer_rows_than_k_and_other_queries(spark):
    c, corpus = vectors(spark, 5, 4, 2)
    q, queries = vectors(spark, 40, 4, 3)
    got = knn_join(queries, corpus, 8, "id", "id", "vec", broadcast_bytes=0, cell_rows=20, chunk_rows=4)
    assert found(got) == brute_force(q, c, 8, False)


@pytest.fixture
def small_frames(spark, monkeypatch):
    """Fails a task whose function gives Spark a frame of more than 1024 rows, or of more than
    the 256 trial queries' ten neighbours."""
    frame = type(spark.range(1))
    plain = frame.mapInPandas

    def checked(self, function, *rest, **named):
        def bounded(batches):
            for out in function(batches):
                assert len(out) <= 2560
                yield out

        return plain(self, bounded, *rest, **named)

    monkeypatch.setattr(frame, "mapInPandas", checked)


def test_knn_join_by_cells_names_all_cells_of_a_query_in_one_row(spark, small_frames):
    # Without groups among the vectors every query meets all of the 100 cells.
    m, df = vectors(spark, 400, 24, 12)
    got = knn_join(df.coalesce(1), df, 3, "id", "id", "vec", True, broadcast_bytes=0, cell_rows=4)
    assert found(got) == brute_force(m, m, 3, True)


def bytes_shuffled(spark):
    """What lies in Spark's local folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


@pytest.mark.parametrize("n", [300, 900])
def test_knn_join_by_cells_writes_no_row_once_per_cell(spark, n):
    # Without groups among the vectors every query meets all of the cells.
    _, df = vectors(spark, n, 24, 12)
    before = bytes_shuffled(spark)
    got = knn_join(df, df, 3, "id", "id", "vec", True, broadcast_bytes=0, cell_rows=8, chunk_rows=64)
    assert got.count() == 3 * n
    # Each side a few times, and three finds of a query from each task.
    assert bytes_shuffled(spark) - before <= 15 * n * 24 * 8


def test_knn_join_by_cells_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr("storeloom.operators.knn_join.SLICE_BYTES", 40 * 6 * 8)
    m, df = vectors(spark, 200, 6, 1, 60)
    got = knn_join(df, df, 3, "id", "id", "vec", True, broadcast_bytes=0, chunk_rows=32, cell_rows=8)
    assert found(got) == brute_force(m, m, 3, True)


@pytest.mark.parametrize("kind", ["FLOAT", "DOUBLE"])
@pytest.mark.parametrize("skip", [True, False])
def test_knn_join_by_cells_with_copies_and_repeated_ids(spark, skip, kind):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(240, 5)).astype("float32").astype("float64")
    m[:90] = m[0]  # copies, many of them under few ids
    ids = [f"id{i % 7}" if i < 60 else f"id{i}" if i % 50 else None for i in range(240)]
    df = spark.createDataFrame([(x, v.tolist()) for x, v in zip(ids, m)], f"id STRING, vec ARRAY<{kind}>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = np.round(1 - unit @ unit.T, 9)
    want = []
    for q in set(ids):
        some = [
            (distance[i, j], ids[j] is not None, ids[j] or "")
            for i in range(240)
            for j in range(240)
            if ids[i] == q and not (skip and q is not None and ids[j] == q)
        ]
        want += [(q or "", r + 1, x[2], x[0]) for r, x in enumerate(sorted(some)[:3])]
    got = knn_join(df, df, 3, "id", "id", "vec", skip, broadcast_bytes=0, cell_rows=6, chunk_rows=16)
    have = [(r.query_id or "", r.rank, r.corpus_id or "", r.distance) for r in got.collect()]
    assert [x[:3] for x in sorted(have)] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in sorted(have)], [x[3] for x in sorted(want)], atol=2e-9)


def test_knn_join_by_cells_finds_rows_beside_an_infinite_vector(spark):
    # In few dimensions a cell has neighbours beyond its border; the vector is no pivot.
    m, df = vectors(spark, 200, 3, 6)
    infinite = spark.createDataFrame([(n, [float("inf"), 1.0, 0.0]) for n in (1000, 1001)], df.schema)
    df = df.unionByName(infinite)
    pivots = df.orderBy(F.xxhash64("id"), "id").limit(11).collect()
    assert not {r.id for r in pivots} & {1000, 1001}
    got = knn_join(df, df, 3, "id", "id", "vec", True, broadcast_bytes=0, cell_rows=20)
    assert found(got) == brute_force(m, m, 3, True)


def test_knn_join_skips_vectors_without_direction(spark):
    bad = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [1.0, 1.0])],
        "id BIGINT, vec ARRAY<FLOAT>",
    )
    for budget in (1 << 20, 0):
        got = knn_join(bad, bad, 2, "id", "id", "vec", True, broadcast_bytes=budget, cell_rows=1)
        assert found(got) == {1: [6], 6: [1]}
    assert knn_join(bad.limit(0), bad, 2, "id", "id", "vec").isEmpty()
    assert knn_join(bad, bad.limit(0), 2, "id", "id", "vec", broadcast_bytes=0, cell_rows=20).isEmpty()


def test_knn_ties_by_id_and_leaves_out_unfit_vectors(spark):
    df = spark.createDataFrame(
        [(3, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 1.0])],
        "id BIGINT, vec ARRAY<FLOAT>",
    )
    got = search.knn(df, [5.0, 0.0], 10, "id", "vec")
    assert [(r.id, r.distance) for r in got.collect()] == [(1, 0.0), (3, 0.0), (6, 1.0)]


def test_hidden_category_is_filtered_before_ranking(spark):
    df = spark.createDataFrame(
        [(1, "dev_reference", [1.0, 0.0]), (2, None, [1.0, 0.1]), (3, "faq", [0.0, 1.0])],
        "id BIGINT, categoria STRING, vec ARRAY<FLOAT>",
    )
    got = search.knn(search.governed(df), [1.0, 0.0], 2, "id", "vec")
    assert [r.id for r in got.collect()] == [2, 3]


def test_lsh_reports_its_hits(spark):
    m, df = vectors(spark, 300, 8, 5)
    got = search.knn_lsh(df, list(m[0]), 5, "id", "vec", tables=16, bucket=2.0, report=True).collect()
    assert len(got) == 5
    plain = search.knn_lsh(df, list(m[0]), 5, "id", "vec", tables=16, bucket=2.0)
    assert plain.columns == ["id", "distance"] and {r.id for r in plain.collect()} == {r.id for r in got}
    exact = {r.id for r in search.knn(df, list(m[0]), 5, "id", "vec").collect()}
    assert {r.id for r in got if r.exact_hit} == exact & {r.id for r in got}
    assert sum(r.exact_hit for r in got) >= 3


@pytest.mark.parametrize("n, cell_rows", [(3000, 64), (30, 2048)])
def test_cells_reach_their_recall(spark, tmp_path, n, cell_rows):
    rng = np.random.default_rng(4)
    groups = rng.normal(size=(40, 16)) * 2
    m = (groups[rng.integers(0, 40, n)] + rng.normal(size=(n, 16))).astype("float32")
    m[: n // 3] = m[0]  # a third of all rows are copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(n, None), (n + 1, [0.0] * 16), (n + 2, [1.0])]
    df = spark.createDataFrame(rows, "id BIGINT, vec ARRAY<FLOAT>")
    index = vector_cells.build_cells(df, "id", "vec", str(tmp_path / "cells"), 10, cell_rows)
    assert index.rows.count() == index.cells.selectExpr("sum(n)").first()[0] == n
    queries = df.filter("id % 10 = 7")
    got = vector_cells.search_cells(index, queries, "id", "vec", 10)
    exact = knn_join(queries, df, 10, "id", "id", "vec")
    assert got.count() == exact.count()
    # Copies tie in great number; what counts is that no nearer row was missed.
    assert vector_cells.recall(got, exact) >= 0.9 and index.recall >= 0.9
    if n > 1000:
        assert index.cells.count() > 10 and index.probes < index.cells.count()


def test_cells_find_all_when_all_are_probed(spark, tmp_path):
    m, df = vectors(spark, 400, 6, 9, 50)
    index = vector_cells.build_cells(df, "id", "vec", str(tmp_path / "cells"), 3, 20)
    got = vector_cells.search_cells(index, df, "id", "vec", 3, index.cells.count(), True)
    assert found(got) == brute_force(m, m, 3, True)


def test_cells_search_names_all_coarse_cells_of_a_query_in_one_row(spark, tmp_path, small_frames):
    m, df = vectors(spark, 400, 24, 12)
    index = vector_cells.build_cells(df, "id", "vec", str(tmp_path / "cells"), 3, 4)
    assert len(index.coarse) == 10
    got = vector_cells.search_cells(index, df.coalesce(1), "id", "vec", 3, index.cells.count(), True)
    assert found(got) == brute_force(m, m, 3, True)


def test_recall_query_of_many_queries_hands_out_small_frames(spark, tmp_path, small_frames):
    m, df = vectors(spark, 1000, 8, 6)
    made = df.selectExpr("id * 100 AS vec_id", "vec AS embedding", "0 AS label")
    made.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = search_queries.knn_cells_recall(spark, str(tmp_path)).first()
    assert tuple(got) == (1000, 10_000, True)


def test_cells_found_in_many_small_groups_are_the_same(spark, tmp_path, monkeypatch):
    m, df = vectors(spark, 400, 6, 9, 50)
    index = vector_cells.build_cells(df, "id", "vec", str(tmp_path / "cells"), 3, 20)
    assert index.cells.filter("n >= 50").count()  # the copies' cell, in several chunks below
    few = {p: found(vector_cells.search_cells(index, df, "id", "vec", 3, p)) for p in (2, 7)}
    monkeypatch.setattr(vector_cells, "CHUNK_ROWS", 30)
    monkeypatch.setattr(vector_cells, "MEET_ROWS", 3)
    for p, wanted in few.items():
        assert found(vector_cells.search_cells(index, df, "id", "vec", 3, p)) == wanted
    got = vector_cells.search_cells(index, df, "id", "vec", 3, index.cells.count(), True)
    assert found(got) == brute_force(m, m, 3, True)


def test_cells_search_of_repeated_and_missing_query_ids(spark, tmp_path):
    m, df = vectors(spark, 60, 4, 3)
    index = vector_cells.build_cells(df, "id", "vec", str(tmp_path / "cells"), 2, 8)
    rows = [(i, [float(x) for x in m[j]]) for i, j in ((None, 0), (7, 1), (7, 1), (7, 2))]
    queries = spark.createDataFrame(rows, "id BIGINT, vec ARRAY<FLOAT>")
    got = vector_cells.search_cells(index, queries, "id", "vec", 3, 4 * index.cells.count())
    want = brute_force(m, m, 3, False)
    # One id's vectors are one query.
    assert found(got.filter("query_id = 7")) == {7: [1, 1, 2]}
    assert found(got.filter("query_id IS NULL").fillna(0, "query_id")) == {0: want[0]}
    assert vector_cells.search_cells(index, queries.limit(0), "id", "vec", 3).isEmpty()


def test_check_vectors_puts_each_row_in_one_class(spark):
    df = spark.createDataFrame(
        [(None,), ([1.0],), ([float("nan"), 0.0],), ([0.0, 0.0],), ([1.0, 0.0],)], "v ARRAY<FLOAT>"
    )
    assert [r.n_rows for r in search.check_vectors(df, "v", 2).collect()] == [1, 1, 1, 1]


def test_compact_keeps_system_turns_and_the_newest(spark):
    turns = spark.createDataFrame(
        [("c", 0, "system", "x" * 50), ("c", 1, "user", "a" * 6), ("c", 2, "bot", "b" * 5), ("c", 300, "user", "d" * 5)],
        "conv STRING, turn INT, role STRING, text STRING",
    )
    for hot_rows in (0, 10**6):
        got = search.compact(turns, "conv", "turn", "role", "text", 10, hot_rows=hot_rows)
        assert {r.turn: r.kept for r in got.collect()} == {0: True, 1: False, 2: True, 300: True}
