"""Exact top-k search by inner product over norm-sorted, SVD-rotated vectors.

Vectors are quantised to integers, sorted by descending length and packed into blocks, so that a
block is one row with its greatest length. The eigenvectors of the d x d Gram matrix (the right
singular vectors of all data) rotate the vectors, which gathers most of an inner product in the first
few rotated components; Cauchy-Schwarz bounds the rest by the product of the residual lengths.

1. Blocks of candidates are processed by descending length, in rounds of 1, 4, 16, ... times as many
   blocks. After a round each query has its k best scores so far; the worst of them is its floor, below
   which nothing matters in the rounds that follow.
2. Queries are sorted by length as well. A block of queries meets a block of candidates only if some
   query's length times the block's greatest length can reach that query's floor. When the next block
   is too short for a block of queries, it takes no part any more; when it is too short for all, the
   search ends.
3. Within a pair of blocks, partial sums plus the residual bound leave the few candidates whose
   integer score is computed. Bounds carry a slack for rounding, so no result is lost.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part.
Shorter vectors count as filled up with zeros. Equal scores go by the smaller id. A query's own id is
never its candidate. Rows that repeat an id each stay a candidate; as queries they are one (the
smallest vector). Null ids take no part. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assurelake.llm.common import cut, drop_cut, table

#: Rows of a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 2048, 512
FOUND_SCHEMA = "q long, place int, query_id long, vec_id long, score long"
_EXACT = 2.0**52


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): components as floor(scale * x); only rows that take part."""
    x = F.col("_v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("_v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(~bad)
    return rows.select("id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal columns, strongest first, from the Gram matrix of all rows."""

    def gram(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for frame in frames:
            m = matrix(frame.column(0), dim).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "x"])

    cells = rows.select("v").mapInArrow(gram, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()  # dim * dim rows
    total = np.zeros(dim * dim)
    total[cells["cell"].to_numpy()] = cells["x"].to_numpy()
    values, vectors = np.linalg.eigh(total.reshape(dim, dim))
    return np.ascontiguousarray(vectors[:, np.argsort(-values)])


def pack(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of the rows of each partition, in their order: ids, vectors and the greatest length."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, rest = TaskContext.get().partitionId(), 0, np.empty(0, np.int64), np.empty((0, dim), np.int64)

        def block(i: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            top = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max())
            cols = [pa.array([(part << 32) + seq]), pa.array([top]), pa.array([i.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "top", "ids", "m"])

        for frame in frames:
            ids = np.concatenate([ids, frame.column(0).to_numpy()])
            rest = np.concatenate([rest, matrix(frame.column(1), dim)])
            while len(ids) >= size:
                yield block(ids[:size], rest[:size])
                seq, ids, rest = seq + 1, ids[size:], rest[size:]
        if len(ids):
            yield block(ids, rest)

    return rows.select("id", "v").mapInArrow(run, "block long, top double, ids binary, m binary")


def unpack(ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.int64).reshape(len(i), -1)


def best_of(qi, qm, ci, cm, k: int, floor: np.ndarray, turn: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score): for each query up to k best candidates that reach its floor."""
    q, c = qm.astype(np.float64), cm.astype(np.float64)
    ql, cl = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    qr, cr = q @ turn, c @ turn
    part = qr[:, :lead] @ cr[:, :lead].T
    part += np.linalg.norm(qr[:, lead:], axis=1)[:, None] * np.linalg.norm(cr[:, lead:], axis=1)[None, :]
    slack = 1e-9 * ql[:, None] * cl[None, :] + 1e-6
    may = part + slack >= floor[:, None]
    may &= qi[:, None] != ci[None, :]
    out_q, out_i, out_s = [], [], []
    small = ql.max(initial=0) * cl.max(initial=0) < _EXACT
    for n in np.flatnonzero(may.any(axis=1)).tolist():
        at = np.flatnonzero(may[n])
        s = np.rint(c[at] @ q[n]).astype(np.int64) if small else cm[at] @ qm[n]
        keep = np.lexsort((ci[at], -s))[:k]
        keep = keep[s[keep] >= floor[n]]
        out_q.append(np.full(len(keep), n))
        out_i.append(ci[at[keep]])
        out_s.append(s[keep])
    if not out_q:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


ROUND_GROWTH = 4


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, lead: int | None = None) -> DataFrame:
    """The k best candidates (all other rows) of each row for which the condition `is_query` on column
    `id` holds: query_id, rank, vec_id, score. `lead`: rotated components before the bound (a quarter)."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    lead = lead or max(1, dim // 4)
    turn = spark.sparkContext.broadcast(rotation(rows, dim))  # dim * dim numbers

    def by_length(some: DataFrame) -> DataFrame:
        length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("len2")
        return some.select("id", "v", length).repartitionByRange(F.desc("len2"), F.col("id")).sortWithinPartitions(F.desc("len2"), "id")

    # blocks are numbered by partition and place, in descending length: `number` counts them through
    packed = cut(pack(by_length(rows), dim, BLOCK), "topk-packed")
    part = F.shiftright("block", 32)
    counts = packed.groupBy(part.alias("part")).agg(F.count("*").alias("c")).orderBy("part").collect()  # a number a partition
    before = {r["part"]: sum(x["c"] for x in counts if x["part"] < r["part"]) for r in counts}
    total = sum(r["c"] for r in counts)
    offset = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    number = (offset[part] + F.col("block").bitwiseAND((1 << 32) - 1)).alias("number")
    candidates = packed.select(number, "top", F.col("ids").alias("c_ids"), F.col("m").alias("c_m"))
    asked = rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    queries = cut(pack(by_length(asked), dim, QUERY_BLOCK).select(F.col("block").alias("q"), "ids", "m"), "topk-queries")

    def with_floors(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block of queries with its floors so far, and the least length of a candidate that matters."""
        for frame in frames:
            for row in frame.to_pylist():
                qi, qm = unpack(row["ids"], row["m"])
                floor = np.full(len(qi), -np.inf)
                for f in row["floors"] or ():
                    # a score too large for a double counts a little less, so that its equals stay
                    floor[f["place"]] = f["floor"] if abs(f["floor"]) < _EXACT else np.nextafter(f["floor"], -np.inf)
                lengths = np.linalg.norm(qm.astype(np.float64), axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(floor <= 0, 0.0, floor / lengths * (1 - 1e-9))
                cols = [pa.array([row["q"]]), pa.array([row["ids"]], pa.binary()), pa.array([row["m"]], pa.binary()), pa.array([floor.tobytes()], pa.binary()), pa.array([float(reach.min())])]
                yield pa.RecordBatch.from_arrays(cols, names=["q", "ids", "m", "floor", "reach"])

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(frame.num_rows):
                row = frame.slice(at, 1).to_pylist()[0]
                (qi, qm), (ci, cm) = unpack(row["ids"], row["m"]), unpack(row["c_ids"], row["c_m"])
                n, i, s = best_of(qi, qm, ci, cm, k, np.frombuffer(row["floor"]), turn.value, lead)
                cols = [pa.array(np.full(len(n), row["q"])), pa.array(n.astype(np.int32)), pa.array(qi[n]), pa.array(i), pa.array(s)]
                yield pa.RecordBatch.from_arrays(cols, names=["q", "place", "query_id", "vec_id", "score"])

    best = spark.createDataFrame([], FOUND_SCHEMA)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    start, size = 0, 1
    while start < total:
        stop = min(start + size, total)
        full = best.groupBy("q", "place", "query_id").agg(F.count("*").alias("c"), F.min("score").alias("floor")).filter(F.col("c") >= k)
        floors = full.groupBy("q").agg(F.collect_list(F.struct("place", F.col("floor").cast("double").alias("floor"))).alias("floors"))  # QUERY_BLOCK at most
        ready = cut(queries.join(floors, "q", "left").mapInArrow(with_floors, "q long, ids binary, m binary, floor binary, reach double"), "topk-floors")
        here = candidates.filter(F.col("number").between(start, stop - 1))
        longest = here.agg(F.max("top").alias("top")).first()["top"]
        # which blocks meet: a few numbers for each, by equality on the block's number
        meet = ready.filter(F.col("reach") <= longest).select("q", "reach", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(stop - 1).cast("long"))).alias("number"))
        meet = meet.join(here.select("number", "top"), "number").filter("top >= reach").select("q", "number")
        found = meet.join(here, "number").join(ready, "q").mapInArrow(search, FOUND_SCHEMA)
        merged = best.unionByName(found).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("rank")
        following = cut(merged, "topk-best")
        if start:
            drop_cut(best)
        done = longest is None or ready.filter(F.col("reach") <= longest).isEmpty()
        drop_cut(ready)
        best = following
        if done:
            break
        start, size = stop, size * ROUND_GROWTH
    return best.withColumn("rank", F.row_number().over(ranked)).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
