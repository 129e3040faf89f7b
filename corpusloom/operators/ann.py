"""Approximate nearest neighbours by cosine: cells fitted on a bounded sample, an index of every vector, several cells probed, exact scores.

The cells' centres come from k-means on the unit sphere over at most SAMPLE vectors, those of least id hash, so the same table gives
the same cells. Every vector is in the cell of its nearest centre. A query looks into the cells nearest to it and is scored exactly
against what is in them; how many cells is measured on the sample, as the least number that meets TARGET of the true neighbours of
ASKED of its vectors: few where vectors form clusters, over half of them where they are spread evenly in all directions. Cells are cut into blocks of about BLOCK vectors, so a cell that holds a third of all rows is many tasks,
and a block's product with the queries that want it is one matrix product that keeps k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.retrieval import unit

#: Vectors that the cells are fitted on, at most; rounds of the fit.
SAMPLE, ROUNDS = 16_384, 12
CELLS, TARGET, ASKED = 128, 0.96, 256
BLOCK = 2048


@dataclass(frozen=True)
class Cells:
    """Unit centres, and the number of them that a query looks into."""

    centres: np.ndarray
    probes: int


def fit_cells(vectors: DataFrame, k: int = 40, cells: int = CELLS, sample: int = SAMPLE, target: float = TARGET) -> Cells | None:
    """Cells (as many or fewer) for the k nearest of the vectors (id, vector); None for a table without usable vectors. The sample of `sample` rows is all that the driver sees."""
    rows = vectors.select("id", unit(F.col("vector")).alias("v")).where("v is not null").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not rows:
        return None
    size = len(rows[0]["v"])
    x = np.array([r["v"] for r in rows if len(r["v"]) == size])
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    nearest = (x @ centres.T).argmax(axis=1)
    some = min(k, len(x))
    met = []
    for q in x[:ASKED]:
        order = np.empty(len(centres), np.int64)
        order[np.argsort(-(centres @ q), kind="stable")] = np.arange(len(centres))
        met.append(order[nearest[np.argpartition(-(x @ q), some - 1)[:some]]])
    return Cells(centres, 1 + int(np.quantile(np.concatenate(met), target, method="higher")))


def cells_of(rows: DataFrame, key: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(key, cell, v): each row's unit vector with the cells nearest to it; rows without a usable vector of that length are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # cells times dimensions
    key_type = rows.schema[key].dataType.simpleString()
    size = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        some = min(probes, len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            near = np.argpartition(-(x @ centres.T), some - 1, axis=1)[:, :some]
            at = np.repeat(np.arange(len(x)), some)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(near.ravel().astype(np.int32)), batch.column(1).take(pa.array(at))], names=[key, "cell", "v"])

    usable = rows.select(key, unit(F.col("vector")).alias("v")).where((F.size("v") == size) & F.col(key).isNotNull())
    return usable.mapInArrow(run, f"{key} {key_type}, cell int, v array<double>")


def blocked(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(cell, block, keys array, vs array): the rows of a cell in blocks of about `block` rows."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / block)).cast("int"))  # one row a cell
    item = F.collect_list(F.struct(F.col(key).alias("key"), "v"))
    return dealt.groupBy("cell", "block").agg(item.alias("items")).select("cell", "block", F.transform("items", lambda x: x["key"]).alias("keys"), F.transform("items", lambda x: x["v"]).alias("vs"))


def ann_topk(queries: DataFrame, vectors: DataFrame, k: int, cells: Cells | None = None) -> DataFrame:
    """(query_id, id, similarity, vector_rank): as retrieval.vector_topk, from the probed cells only. queries: (query_id, vector); vectors: (id, vector).

    Null, empty and zero vectors, and those of another length than the cells, never match; rows without an id neither. Equal rows
    of vectors are rows of their own; ties go by id. With as many probes as cells the result is exact.
    """
    spark = queries.sparkSession
    cells = cells or fit_cells(vectors, k)
    types = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    schema = f"query_id {types[0]}, id {types[1]}, similarity double"
    if cells is None:
        return spark.createDataFrame([], schema + ", vector_rank bigint")
    centres, probes = cells.centres, cells.probes
    index = blocked(cells_of(vectors, "id", centres, 1), "id").select("cell", F.col("keys").alias("ids"), "vs")
    asked = blocked(cells_of(queries, "query_id", centres, probes), "query_id").select("cell", F.col("keys").alias("query_ids"), F.col("vs").alias("qs"))
    size = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vs, query_ids, qs = (batch.column(c)[i].values for c in range(4))
                x = vs.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                q = qs.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                scores = np.round(q @ x.T, 6)
                some = min(k, len(x))
                # all that are as near as the k-th, so that ties can go by id
                least = np.partition(scores, len(x) - some, axis=1)[:, len(x) - some]
                a, b = np.nonzero(scores >= least[:, None])
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(scores[a, b])], names=["query_id", "id", "similarity"])

    found = asked.join(index, "cell").select("ids", "vs", "query_ids", "qs").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("vector_rank", rank.cast("bigint")).where(F.col("vector_rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (wanted, met, recall): the share of the exact rows (query_id, id) that are found."""
    rows = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return rows.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("met")).withColumn("recall", F.col("met") / F.nullif("wanted", F.lit(0)))
