"""Exact top-k search by vector approximation files.

Vectors are whole numbers (floor of SCALE times each component). Every dimension's range is cut into CELLS equal cells, and
the approximation of a vector is its cells, a byte each. Approximations are written to the shared folder as a file of their
own, a few thousand vectors in a row; queries are packed into blocks of at most BLOCK. Only approximations meet the blocks:
the product of a query with the middles of the cells, give or take half a cell in each dimension, bounds the inner product
from both sides. A task carries on each query's kth lower bound and returns what can still beat it; the kth lower bound of
all tasks then rules out more. What is left is read exactly in the order of its upper bounds: first READ times k vectors of
each query, then those whose upper bound the kth exact score doesn't beat, which makes the result certain.

Queries are a stated set against all rows, so each approximation meets each block of queries once; nothing of either comes
to the driver but counts, the ranges of dimensions and the numbers of components that there are. Exact vectors are read by
joins on id that shuffle. Rows that share an id are all candidates, of other ids' queries; of queries that share an id the
least by value is taken. Ties go to the smaller id.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; a query meets
vectors of its own number of components only. A score beyond 64 bits is left out. An empty table, or one without a query,
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SCALE, CELLS, BLOCK, TOP = 1024, 256, 1 << 14, 10
#: Vectors in a row of the file; queries whose bounds are held at once; vectors that are read first, as a multiple of k.
ROWS, AT_ONCE, READ = 4096, 256, 4


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"))
    return rows.filter(F.col("id").isNotNull() & _finite("raw") & (F.size("raw") > 0)).select("id", _scaled("raw").alias("v"))


def _finite(column: str) -> Column:
    return F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def _scaled(column: str) -> Column:
    return F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))


class Cells:
    """Equal cells of each dimension, and the bounds that they give."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low, self.cells = low, cells
        self.step = (high - low) / cells
        # half a cell, and what the arithmetic may be off by
        self.half = self.step / 2 + 1e-12 * np.maximum(np.abs(low), np.abs(high)) + 1e-9

    def approximate(self, vectors: np.ndarray) -> np.ndarray:
        step = np.where(self.step > 0, self.step, 1)
        return np.clip(np.floor((vectors - self.low) / step), 0, self.cells - 1).astype(np.uint8)

    def middles(self, codes: np.ndarray) -> np.ndarray:
        return self.low + (codes + 0.5) * self.step

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """How far a query's product with middles may be from its product with any vector of the cells."""
        slack = np.abs(queries) @ (np.abs(self.low) + self.cells * self.step) * 1e-12
        return np.abs(queries) @ self.half * (1 + 1e-9) + slack


def _blocks(rows: DataFrame, size: int, encode) -> DataFrame:
    """(block, ids, body): rows (id, v) packed into blocks of at most so many."""

    def packed(batches):
        part, k, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            at = pa.array([(part << 32) + k], pa.int64())
            return pa.record_batch({"block": at, "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "body": pa.array([encode(np.array(vectors)).tobytes()], pa.binary())})

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield block()
                    k, ids, vectors = k + 1, [], []
        if ids:
            yield block()

    return common.checkpointed(rows.mapInArrow(packed, "block long, ids binary, body binary"))


class Running:
    """The k best lower bounds so far of each query of a block."""

    def __init__(self, k: int, queries: int):
        self.k, self.best = k, np.full((k, queries), -np.inf)

    def bar(self, products: np.ndarray, part: slice) -> np.ndarray:
        """The kth best of all products so far, these included."""
        both = np.concatenate([self.best[:, part], products])
        self.best[:, part] = np.partition(both, len(both) - self.k, axis=0)[-self.k :]
        return self.best[:, part].min(0)


def _bounded(pairs: DataFrame, cells: Cells, size: int, k: int) -> DataFrame:
    """(query_id, id, lower, upper) of the pairs that a task can't rule out."""

    def bounded(batches):
        running: dict[int, tuple] = {}  # by block of queries
        for batch in batches:
            for block, ids, body, own_ids, own in zip(*[batch.column(c).to_pylist() for c in ("query_block", "query_ids", "query_body", "ids", "body")], strict=True):
                if block not in running:
                    queries = np.frombuffer(body, np.int64).reshape(-1, size).astype(float)
                    running[block] = (np.frombuffer(ids, np.int64), queries, cells.reach(queries), Running(k, len(queries)))
                query_ids, queries, reach, best = running[block]
                rows, middles = np.frombuffer(own_ids, np.int64), cells.middles(np.frombuffer(own, np.uint8).reshape(-1, size))
                for a in range(0, len(queries), AT_ONCE):
                    part = slice(a, a + AT_ONCE)
                    products = middles @ queries[part].T
                    products[rows[:, None] == query_ids[None, part]] = -np.inf
                    bar = best.bar(products, part) - 2 * reach[part]
                    row, q = np.nonzero((products >= bar) & (products > -np.inf))
                    found, r = products[row, q], reach[part][q]
                    yield pa.record_batch({"query_id": pa.array(query_ids[part][q]), "id": pa.array(rows[row]), "lower": pa.array(found - r), "upper": pa.array(found + r)})

    return pairs.mapInArrow(bounded, "query_id long, id long, lower double, upper double")


def _kth(rows: DataFrame, order: str, k: int) -> DataFrame:
    """(query_id, bar): each query's kth greatest value."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(order)))
    return rows.withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.min(order).alias("bar"), F.count("*").alias("n")).filter(F.col("n") == k).select("query_id", "bar")


def candidates(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, upper) of the pairs whose bounds leave them a chance, from approximations alone."""
    size = rows.select(F.size("v").alias("n")).first()["n"]
    spread = rows.select([F.min(F.col("v")[d]).alias(f"a{d}") for d in range(size)] + [F.max(F.col("v")[d]).alias(f"b{d}") for d in range(size)]).first()
    cells = Cells(np.array(spread[:size], float), np.array(spread[size:], float))
    file = _blocks(rows, ROWS, cells.approximate)
    many = -(-queries.count() // block)
    asked = _blocks(queries.repartition(max(1, many)), block, lambda v: v.astype(np.int64))
    asked = asked.select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("body").alias("query_body"))
    pairs = file.crossJoin(asked)  # blocks, not rows: each block of the stated queries against the whole file
    near = common.checkpointed(_bounded(pairs, cells, size, k))
    kept = near.join(_kth(near, "lower", k), "query_id", "left").filter(F.col("bar").isNull() | (F.col("upper") >= F.col("bar")))
    return kept.groupBy("query_id", "id").agg(F.max("upper").alias("upper"))


def _exact(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) from the vectors themselves; a row for each row of the id."""
    read = pairs.select("query_id", "id").join(rows, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.try_multiply(a, b)), F.lit(0).cast("long"), lambda total, x: F.try_add(total, x))
    return read.select("query_id", "id", product.alias("score")).filter("score IS NOT NULL")


def search(table: DataFrame, is_query, *, id_col="vec_id", vector_col="embedding", k: int = TOP, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of each query row with all other rows."""
    rows = usable(table, id_col, vector_col)
    parts = []
    for size in [r["size"] for r in rows.groupBy(F.size("v").alias("size")).count().orderBy("size").collect()]:
        mine = rows.filter(F.size("v") == size)
        queries = mine.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
        if queries.isEmpty():
            continue
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "id"))
        left = common.checkpointed(candidates(mine, queries, k, block).withColumn("place", place))
        first = common.checkpointed(_exact(left.filter(F.col("place") <= READ * k), mine, queries))
        rest = left.filter(F.col("place") > READ * k).join(_kth(first, "score", k), "query_id", "left")
        rest = rest.filter(F.col("bar").isNull() | (F.col("upper") >= F.col("bar")))
        parts.append(first.unionByName(_exact(rest, mine, queries)))
    if not parts:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    found = search(common.table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


OP2_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""
