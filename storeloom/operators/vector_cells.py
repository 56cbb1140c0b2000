"""Approximate neighbours through stored cells of two levels.

The corpus is cut into coarse cells by k-means on a bounded sample, each coarse cell into fine
ones by k-means on a sample of its own, and written once, by fine cell.  A search looks at the
fine cells whose centres are nearest to the query; how many is found out when the cells are
built, as few as give the wanted recall against an exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storeloom.operators.knn_join import _PAIRS, _best_k, _block_best, _pieces, _unit, _usable, knn_join
from storeloom.session import work_folder

# Rows of a fine cell on average.
CELL_ROWS = 2048
# Rows the coarse centres, or the fine ones of a coarse cell, are fitted on, at most, and rows
# of a sample per fine centre.
FIT_ROWS, ROWS_PER_CENTRE = 100_000, 64
# Queries the number of cells to probe is found with, and the recall they are to reach.
TRIAL_QUERIES, WANTED_RECALL = 256, 0.95
# Rows of the cells that are searched as one group, and queries of a group; a cell with more
# rows is searched in several.
CHUNK_ROWS = 8192
# Queries and centres that meet in one group.
MEET_ROWS = 1024
ROUNDS, SEED = 12, 11


def centres(unit: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means; fewer centres where there are fewer different rows."""
    rng = np.random.default_rng(SEED)
    found = np.unique(unit, axis=0)
    found = found[rng.permutation(len(found))[:n]]
    for _ in range(ROUNDS):
        own = _nearest(unit, found)
        sums = np.zeros_like(found)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(length > 0, sums / np.where(length > 0, length, 1), found)
    return found


def _nearest(unit: np.ndarray, points: np.ndarray) -> np.ndarray:
    best = np.empty(len(unit), np.int64)
    step = max(1, _PAIRS // len(points))
    for lo in range(0, len(unit), step):
        best[lo : lo + step] = (unit[lo : lo + step] @ points.T).argmax(axis=1)
    return best


@dataclass(frozen=True)
class VectorCells:
    """A built index: ``rows`` (coarse, fine, corpus_id, vec) and ``cells`` (coarse, fine,
    centre, n) as written tables, the coarse centres, how many fine cells a search probes and
    in how many coarse ones, and the recall of that on the trial queries."""

    rows: DataFrame
    cells: DataFrame
    coarse: np.ndarray
    probes: int
    wide: int
    recall: float


def _coarse(points: np.ndarray, row_id: str, kind: str, df: DataFrame) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(points)  # at most sqrt(corpus / CELL_ROWS) rows

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            unit = _unit(pdf["vec"])
            yield pdf.assign(vec=list(unit), coarse=_nearest(unit, sent.value).astype("int32"))

    return df.mapInPandas(assign, f"{row_id} {kind}, vec array<double>, coarse int")


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by coarse cell, its centres (as one row) first: each row's fine cell."""
    points = None
    for batch in batches:
        centres_of = batch.column("centres")
        heads = np.flatnonzero(centres_of.is_valid().to_numpy(zero_copy_only=False))
        bounds = np.unique(np.concatenate([[0], heads, [batch.num_rows]]))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            part = batch.slice(lo, hi - lo)
            if centres_of[lo].is_valid:
                held = centres_of.slice(lo, 1).flatten()
                points = held.flatten().to_numpy().reshape(len(held), -1)
                part = part.slice(1)
            if not part.num_rows:
                continue
            unit = part.column("vec").flatten().to_numpy().reshape(part.num_rows, -1)
            own = pa.array(_nearest(unit, points).astype("int32"))
            names = ["coarse", "corpus_id", "vec"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), own], names=[*names, "fine"])


def build_cells(
    corpus: DataFrame,
    row_id: str,
    vector: str,
    root: str,
    k: int = 10,
    cell_rows: int = CELL_ROWS,
    wanted_recall: float = WANTED_RECALL,
) -> VectorCells:
    """Cut the corpus into cells below ``root`` and find how many a search has to probe.

    Every row with a direction is in a cell; others have no neighbours and are none.  A
    corpus of n rows has about sqrt(n / cell_rows) coarse cells, each with as many fine ones
    as its rows ask for, so fine cells keep their size as the corpus grows.  Rows move once,
    to their coarse cell; a coarse cell with very many rows is dealt over several tasks, each
    of which gets the cell's centres ahead of the rows.
    """
    spark = corpus.sparkSession
    usable = _usable(corpus, row_id, vector).withColumnRenamed(row_id, "corpus_id")
    dim = usable.agg(F.mode(F.size("vec"), True)).first()[0]
    usable = usable.filter(F.size("vec") == F.lit(dim or 0))
    kind = usable.schema["corpus_id"].dataType.simpleString()
    n = usable.count()
    by_hash = F.xxhash64("corpus_id")
    sample = usable.orderBy(by_hash, "corpus_id").limit(FIT_ROWS).select("vec").toPandas()
    if not n:
        raise ValueError("no row has a vector with a direction")
    coarse = centres(_unit(sample["vec"]), max(1, ceil(sqrt(n / cell_rows))))
    placed = _coarse(coarse, "corpus_id", kind, usable)

    every = max(1, cell_rows // ROWS_PER_CENTRE)
    sizes = placed.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = max(1, ceil(int(pdf["n"].iloc[0]) / cell_rows))
        found = centres(np.vstack(pdf["vec"].to_numpy()), wanted)
        return pd.DataFrame({"coarse": [key[0]], "n": [int(pdf["n"].iloc[0])], "centres": [list(map(list, found))]})

    # By hash, and the least hash of each cell, so that a small cell is not left without.
    least = placed.groupBy("coarse").agg(F.min(by_hash).alias("_least"))
    seen = (
        placed.join(sizes.join(least, "coarse"), "coarse")
        .filter(
            (F.pmod(by_hash, F.greatest(F.lit(every), F.ceil(F.col("n") / FIT_ROWS))) == 0)
            | (by_hash == F.col("_least"))
        )
        .select("coarse", "n", "vec")
    )
    seen.groupBy("coarse").applyInPandas(
        fit, "coarse int, n long, centres array<array<double>>"
    ).write.mode("overwrite").parquet(f"{root}/centres")
    heads = spark.read.parquet(f"{root}/centres")

    salt = F.lit(cell_rows * 64)
    parts = heads.select("coarse", F.ceil(F.col("n") / salt).cast("long").alias("_parts"))
    nothing = F.lit(None)
    rows = placed.join(F.broadcast(parts), "coarse").select(
        "coarse",
        F.pmod(by_hash, "_parts").alias("_part"),
        F.lit(1).alias("_order"),
        "corpus_id",
        "vec",
        nothing.cast("array<array<double>>").alias("centres"),
    )
    first = heads.select(
        "coarse",
        F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / salt).cast("long") - 1)).alias("_part"),
        F.lit(0).alias("_order"),
        nothing.cast(kind).alias("corpus_id"),
        nothing.cast("array<double>").alias("vec"),
        "centres",
    )
    (
        rows.unionByName(first)
        .repartition("coarse", "_part")
        .sortWithinPartitions("coarse", "_part", "_order")
        .mapInArrow(_fine, f"coarse int, corpus_id {kind}, vec array<double>, fine int")
        .sortWithinPartitions("coarse", "fine")
        .write.mode("overwrite")
        .parquet(f"{root}/rows")
    )
    written = spark.read.parquet(f"{root}/rows")
    counted = written.groupBy("coarse", "fine").agg(F.count(F.lit(1)).alias("n"))
    named = heads.select("coarse", F.posexplode("centres").alias("fine", "centre"))
    counted.join(named, ["coarse", "fine"]).write.mode("overwrite").parquet(f"{root}/cells")
    cells = spark.read.parquet(f"{root}/cells")

    trial = usable.orderBy(by_hash.desc(), "corpus_id").limit(TRIAL_QUERIES)
    trial = trial.select(F.col("corpus_id").alias("query_id"), "vec")
    # A bounded query set against all rows.
    exact = knn_join(trial, usable.select("corpus_id", "vec"), k, "query_id", "corpus_id", "vec", dim=dim)
    asked = trial.toPandas()
    probes, wide, recall = _calibrate(
        asked["query_id"].tolist(), _unit(asked["vec"]), exact, written, cells, coarse, wanted_recall
    )
    return VectorCells(written, cells, coarse, probes, wide, recall)


def _calibrate(
    ids: list, unit: np.ndarray, exact: DataFrame, rows: DataFrame, cells: DataFrame, coarse: np.ndarray, wanted: float
) -> tuple[int, int, float]:
    """How many fine and coarse cells to probe, so that the wanted share of the trial queries'
    exact neighbours lies in them, and the share that does.

    For each neighbour the cells nearer to the query than its own are counted in one pass
    over the centres; the driver holds ``TRIAL_QUERIES`` vectors and their neighbours.
    """
    found = exact.join(rows.select("corpus_id", "coarse", "fine"), "corpus_id")
    pairs = found.join(cells.select("coarse", "fine", "centre"), ["coarse", "fine"]).select(
        "query_id", "coarse", "centre"
    ).toPandas()
    place = {q: i for i, q in enumerate(ids)}
    query = np.array([place[q] for q in pairs["query_id"]], np.int64)
    own = unit[query]
    near = (own * np.vstack(pairs["centre"].to_numpy())).sum(axis=1)
    sent = rows.sparkSession.sparkContext.broadcast((unit, query, near))

    def nearer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, at, gap = sent.value
        count = np.zeros(len(at), np.int64)
        for pdf in _pieces(batches):
            like = asked @ np.vstack(pdf["centre"].to_numpy()).T
            # A little slack, as products are added up in another order here.
            count += (like[at] > gap[:, None] + 1e-9).sum(axis=1)
        yield pd.DataFrame({"pair": np.arange(len(at)), "n": count})

    counted = cells.select("centre").mapInPandas(nearer, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    fine_rank = counted.orderBy("pair").toPandas()["n"].to_numpy() + 1
    like = unit @ coarse.T
    coarse_rank = (like[query] > like[query, pairs["coarse"].to_numpy()][:, None]).sum(axis=1) + 1
    probes = int(np.sort(fine_rank)[min(len(query) - 1, ceil(wanted * len(query)))])
    inside = fine_rank <= probes
    return probes, int(coarse_rank[inside].max()), float(inside.mean())


def search_cells(
    index: VectorCells,
    queries: DataFrame,
    query_id: str,
    vector: str,
    k: int,
    probes: int | None = None,
    skip_same_id: bool = False,
) -> DataFrame:
    """The ``k`` nearest rows of every query among those in the cells probed: ``query_id``,
    ``corpus_id``, ``rank``, ``distance``.

    Every query meets the centres of the coarse cells that lie nearest and then the rows of
    the fine cells chosen; given ``probes``, it meets all coarse ones.  Fine cells are searched
    in packs of a coarse cell's neighbouring ones, so that a query travels once per pack and
    a pack gives its best ``k`` per query; cells with very many rows are searched in chunks.
    The usable queries are written down, each with a number, and only numbers are sorted.
    """
    wide = min(index.wide if probes is None else len(index.coarse), len(index.coarse))
    probes = index.probes if probes is None else probes
    spark = queries.sparkSession
    asked = _usable(queries, query_id, vector).withColumnRenamed(query_id, "query_id")
    asked = asked.filter(F.size("vec") == index.coarse.shape[1])
    asked = asked.withColumn("ask", F.monotonically_increasing_id())
    path = work_folder(spark, "cells_asked")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    n_asked = asked.count()
    kind = asked.schema["query_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(index.coarse)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            unit = _unit(pdf["vec"])
            order = np.argsort(-(unit @ sent.value.T), axis=1, kind="stable")[:, :wide]
            yield pdf.assign(vec=list(unit), wide=list(order.astype("int32")))

    met = asked.mapInPandas(nearest, f"query_id {kind}, vec array<double>, ask long, wide array<int>")

    def gaps(asks: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or cells.empty:
            return pd.DataFrame({n: [] for n in ("query_id", "ask", "coarse", "fine", "gap")}, dtype=object)
        unit, centre = np.vstack(asks["vec"].to_numpy()), np.vstack(cells["centre"].to_numpy())
        gap = -(unit @ centre.T)
        order = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        row = np.repeat(np.arange(len(asks)), order.shape[1])
        return pd.DataFrame(
            {
                "query_id": asks["query_id"].to_numpy()[row],
                "ask": asks["ask"].to_numpy()[row],
                "coarse": asks["coarse"].to_numpy()[row],
                "fine": cells["fine"].to_numpy()[order.ravel()],
                "gap": gap[row, order.ravel()],
            }
        )

    zero = F.lit(0).cast("long")

    def dealt(df: DataFrame, rows: int) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64("ask"), F.lit(max(1, ceil(n_asked / rows)))))

    def for_all(rows: int):
        """The parts that ``dealt`` makes, for the side that all of them meet."""
        return F.explode(F.sequence(zero, F.lit(max(1, ceil(n_asked / rows)) - 1).cast("long")))

    # Queries of a coarse cell are dealt over groups; so are its centres, should it have many.
    blocks = index.cells.groupBy("coarse").agg(F.floor(F.max("fine") / MEET_ROWS).alias("_last"))
    asks_of = dealt(met.select("query_id", "vec", "ask", F.explode("wide").alias("coarse")), MEET_ROWS)
    asks_of = asks_of.join(blocks, "coarse").select(
        "query_id", "vec", "ask", "coarse", "_part", F.explode(F.sequence(zero, "_last")).alias("_block")
    )
    block = F.floor(F.col("fine") / MEET_ROWS).alias("_block")
    centres_of = index.cells.select("coarse", "fine", "centre", block, for_all(MEET_ROWS).alias("_part"))
    meeting = ["coarse", "_part", "_block"]
    chosen = (
        asks_of.groupBy(*meeting)
        .cogroup(centres_of.groupBy(*meeting))
        .applyInPandas(gaps, f"query_id {kind}, ask long, coarse int, fine int, gap double")
    )
    best = Window.partitionBy("query_id").orderBy("gap", "coarse", "fine")
    probed = chosen.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= probes)

    def in_packs(df: DataFrame) -> DataFrame:
        before = F.sum("n").over(Window.partitionBy("coarse").orderBy("fine")) - F.col("n")
        packs = index.cells.select(
            "coarse",
            "fine",
            F.floor(before / CHUNK_ROWS).alias("_pack"),
            F.ceil(F.col("n") / CHUNK_ROWS).cast("long").alias("_chunks"),
        )
        return df.join(packs, ["coarse", "fine"])

    pack = ["coarse", "_pack", "_chunk"]
    rows = in_packs(index.rows).withColumn("_chunk", F.pmod(F.xxhash64("corpus_id"), "_chunks"))
    rows = rows.select(*pack, "fine", "corpus_id", "vec", for_all(CHUNK_ROWS).alias("_part"))
    asks = (
        in_packs(probed)
        .withColumn("_chunk", F.explode(F.sequence(zero, F.col("_chunks") - 1)))
        .groupBy("ask", *pack)
        .agg(F.collect_list("fine").alias("fines"))
        .join(asked, "ask")
    )
    asks = dealt(asks, CHUNK_ROWS).select(*pack, "_part", "query_id", "vec", "fines")
    c_kind = index.rows.schema["corpus_id"].dataType.simpleString()
    found = (
        rows.groupBy(*pack, "_part")
        .cogroup(asks.groupBy(*pack, "_part"))
        .applyInPandas(
            lambda block, own: _search_pack(block, own, k, skip_same_id),
            f"query_id {kind}, corpus_id {c_kind}, distance double",
        )
    )
    return _best_k(found, k).select("query_id", "corpus_id", "rank", "distance")


def _search_pack(block: pd.DataFrame, own: pd.DataFrame, k: int, skip: bool) -> pd.DataFrame:
    """The best ``k`` rows of the pack per query among the cells that the query named."""
    best = pd.DataFrame({"query_id": [], "corpus_id": [], "distance": []})
    if block.empty or own.empty:
        return best
    unit, ids = _unit(own["vec"]), own["query_id"].to_numpy()
    names = np.concatenate(own["fines"].to_numpy())
    askers = np.repeat(np.arange(len(own)), own["fines"].str.len())
    askers = askers[np.argsort(names, kind="stable")]
    names = np.sort(names)
    new, held = [], 0
    for fine, cell in block.groupby("fine", sort=False):
        at = askers[slice(*np.searchsorted(names, [fine, fine + 1]))]
        if not len(at):
            continue
        rows = np.vstack(cell["vec"].to_numpy())
        new.append(_block_best(ids[at], unit[at], cell["corpus_id"].to_numpy(), rows, k, skip))
        held += len(new[-1])
        if held > _PAIRS // 4:
            best, new, held = _merged([best, *new], k), [], 0
    return _merged([best, *new], k)


def _merged(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    some = [f for f in found if len(f)]
    if len(some) < 2:
        return some[0] if some else found[0]
    # Nulls first, as in Spark.
    both = pd.concat(some, ignore_index=True)
    both = both.sort_values(["query_id", "distance", "corpus_id"], na_position="first")
    return both.groupby("query_id", sort=False, dropna=False).head(k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers (query_id, corpus_id) that were found."""
    keys = ["query_id", "corpus_id"]
    hits = exact.select(*keys).join(found.select(*keys), keys, "left_semi").count()
    return hits / max(exact.count(), 1)
