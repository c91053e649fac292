"""Hard negatives by a vertical scan (branch and bound on decomposed vectors).

Vectors are quantised to integers and stored once as blocks in column order: for each dimension its values in
the block next to each other, with their least and greatest. For an anchor and a block

1. the dimensions are read in descending order of the anchor's magnitudes, a few at a time;
2. the partial scores plus the least and greatest contribution of the dimensions that are left bound each
   candidate's score from both sides, and candidates that no window of the anchor can want leave the bitmap;
3. the few that are left after the last dimension have their exact scores, which decide the windows.

A window is a range of scores with the k best found in it so far; once it has k, the worst of those is its
lower edge. An anchor's positives are one window over all scores of its own label; each positive then gives a
window from `low` to `high` percent of its score over all other labels.

Anchors go to the tasks in waves of WAVE_BYTES at most; candidates are never shuffled again, and each task hands
on k rows for each window of a wave at most. Of the blocks, one in SEEDS is scanned first, which raises
the edges for all others. Waves are dealt by the sizes of packed anchors, a row for thousands of them.

Defined results: rows with a null id, a null label, a null vector or a null or non-finite component take no
part. Shorter vectors count as filled up with zeros. Equal scores go by the smaller id. Other rows are those
with another id. Rows that repeat an id each stay a candidate; as anchors they are one, the least by label and
vector. Windows without a score are empty: a positive with a negative score has no negatives. An anchor
without positives, and an empty table, give no rows. Labels are integers. Scores beyond 64 bits wrap around.
Other columns are ignored, whatever they are named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assurelake.llm.common import cut, drop_cut, drop_path, table, work_path
from assurelake.llm.topk import matrix

#: Rows of a block, and of a packed row of anchors.
BLOCK, ANCHORS = 2048, 1024
#: Bytes of anchors that are sent to all tasks at once, at most.
WAVE_BYTES = 32 << 20
#: One block in so many is scanned first.
SEEDS = 16
#: Dimensions that are read between two looks at the bounds.
STEP = 8
_EXACT = 2.0**52
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND_SCHEMA = "anchor_id long, place int, vec_id long, score long"


def labelled(vectors: DataFrame, label: Column | str = "label", id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v): components as floor(scale * x); only rows that take part."""
    x = F.col("_v")
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("_v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(~bad)
    return rows.select("id", "label", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def packed(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of the rows of each partition, in their order: ids, labels, and the columns one after another
    with their least and greatest values, in the narrowest integers that hold them."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, labels, rest = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dim), np.int64)

        def block(n: int) -> pa.RecordBatch:
            m = rest[:n]
            low, high = m.min(axis=0), m.max(axis=0)
            kind = np.result_type(np.min_scalar_type(low.min(initial=-1)), np.min_scalar_type(high.max(initial=0)))
            kind = kind if np.issubdtype(kind, np.signedinteger) else np.dtype(np.int64)
            raw = [ids[:n].tobytes(), labels[:n].tobytes(), low.tobytes(), high.tobytes(), np.ascontiguousarray(m.T).astype(kind).tobytes()]
            cols = [pa.array([(part << 32) + seq]), pa.array([seq]), *(pa.array([r], pa.binary()) for r in raw)]
            return pa.RecordBatch.from_arrays(cols, names=["block", "seq", "ids", "labels", "low", "high", "columns"])

        for frame in frames:
            ids, labels = np.concatenate([ids, frame.column(0).to_numpy()]), np.concatenate([labels, frame.column(1).to_numpy()])
            rest = np.concatenate([rest, matrix(frame.column(2), dim)])
            while len(ids) >= size:
                yield block(size)
                seq, ids, labels, rest = seq + 1, ids[size:], labels[size:], rest[size:]
        if len(ids):
            yield block(len(ids))

    return rows.select("id", "label", "v").mapInArrow(run, "block long, seq long, ids binary, labels binary, low binary, high binary, columns binary")


def unpacked(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, least, greatest, and the columns as [dimension, row]."""
    ids, labels, low, high = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "low", "high"))
    width = len(row["columns"]) // max(1, dim * len(ids))
    return ids, labels, low, high, np.frombuffer(row["columns"], np.dtype(f"i{width or 8}")).reshape(dim, len(ids))


@dataclass
class Wave:
    """Some anchors with their windows: of each, `k` scores from lower to upper are wanted."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # [anchor, dimension]
    lower: np.ndarray  # [anchor, window]
    upper: np.ndarray
    k: int
    same: bool  # candidates have the anchor's label, or another


def vertical(anchor: np.ndarray, order: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, bitmap: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the candidates in the bitmap whose score can be from least to most. Scores are exact
    after the last dimension, as far as doubles are."""
    a = anchor[order]
    ends = a * low[order], a * high[order]
    # what the dimensions from each place on can add at least and at most
    rest_low = np.append(np.minimum(*ends)[::-1].cumsum()[::-1], 0.0)
    rest_high = np.append(np.maximum(*ends)[::-1].cumsum()[::-1], 0.0)
    places = np.flatnonzero(bitmap)
    part = np.zeros(len(places))
    whole = len(places) == len(bitmap)
    for start in range(0, len(order), STEP):
        dims = order[start : start + STEP]
        some = columns[dims] if whole else columns[dims[:, None], places[None, :]]
        part += a[start : start + STEP] @ some
        stop = start + len(dims)
        keep = (part >= least - rest_high[stop]) & (part <= most - rest_low[stop])
        if not keep.all():
            places, part, whole = places[keep], part[keep], False
            if not len(places):
                break
    return places, part


class Found:
    """The best scores of every window of a wave, as the blocks of one task raise them."""

    def __init__(self, wave: Wave):
        self.wave, (n, p) = wave, wave.lower.shape
        self.edge = wave.lower.copy()
        self.count = np.zeros((n, p), np.int64)
        self.score, self.vec = np.zeros((n, p, wave.k), np.int64), np.zeros((n, p, wave.k), np.int64)
        self.vectors = wave.vectors.astype(np.float64)
        self.plus, self.minus = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        self.order = np.argsort(-np.abs(self.vectors), axis=1, kind="stable")
        self.live = wave.lower <= wave.upper

    def visit(self, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, columns: np.ndarray) -> None:
        w, k = self.wave, self.wave.k
        # of whole anchors: a label that the block has, and bounds that reach a window
        inside = (w.labels >= labels.min()) & (w.labels <= labels.max()) if w.same else (w.labels != labels.min()) | (w.labels != labels.max())
        lowest, highest = low.astype(np.float64), high.astype(np.float64)
        limit = np.abs(self.vectors) @ np.maximum(np.abs(lowest), np.abs(highest))
        slack = np.where(limit < _EXACT, 0.0, 1e-9 * limit)
        top, bottom = self.plus @ highest + self.minus @ lowest + slack, self.plus @ lowest + self.minus @ highest - slack
        open_ = self.live & (self.edge <= top[:, None]) & (w.upper >= bottom[:, None])
        floats = columns.astype(np.float64)
        for n in np.flatnonzero(inside & open_.any(axis=1)).tolist():
            here = np.flatnonzero(open_[n])
            bitmap = (labels == w.labels[n]) if w.same else (labels != w.labels[n])
            bitmap &= ids != w.ids[n]
            edges = self.edge[n, here]
            at, scores = vertical(self.vectors[n], self.order[n], floats, lowest, highest, bitmap, float(edges.min()) - slack[n], float(w.upper[n, here].max()) + slack[n])
            if not len(at):
                continue
            exact = scores.astype(np.int64) if limit[n] < _EXACT else w.vectors[n] @ columns[:, at].astype(np.int64)
            names = ids[at]
            for p, edge in zip(here.tolist(), edges.tolist(), strict=True):
                self.put(n, p, edge, exact, names, k)

    def put(self, n: int, p: int, edge: int, exact: np.ndarray, names: np.ndarray, k: int) -> None:
        c = self.count[n, p]
        fits = (exact >= edge) & (exact <= self.wave.upper[n, p])
        if c == k:  # an equal score counts with a smaller id only
            fits &= (exact > edge) | (names < self.vec[n, p, k - 1])
        if not fits.any():
            return
        s, i = np.concatenate([self.score[n, p, :c], exact[fits]]), np.concatenate([self.vec[n, p, :c], names[fits]])
        best = np.lexsort((i, -s))[:k]
        c = len(best)
        self.count[n, p], self.score[n, p, :c], self.vec[n, p, :c] = c, s[best], i[best]
        if c == k:
            self.edge[n, p] = s[best[-1]]

    def rows(self) -> Iterator[pa.RecordBatch]:
        anchor, place = np.nonzero(self.count)
        for some in np.array_split(np.arange(len(anchor)), len(anchor) // 50_000 + 1):
            a, p = anchor[some], place[some]
            full = np.arange(self.wave.k)[None, :] < self.count[a, p][:, None]
            n = full.sum(axis=1)
            cols = [np.repeat(self.wave.ids[a], n), np.repeat(p, n).astype(np.int32), self.vec[a, p][full], self.score[a, p][full]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["anchor_id", "place", "vec_id", "score"])


def scanned(blocks: DataFrame, wave: Wave, dim: int) -> tuple[DataFrame, object]:
    """The best of each task for each window, and the broadcast that they need."""
    sent = blocks.sparkSession.sparkContext.broadcast(wave)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for frame in frames:
            for at in range(frame.num_rows):
                found = found or Found(sent.value)
                found.visit(*unpacked(frame.slice(at, 1).to_pylist()[0], dim))
        if found:
            yield from found.rows()

    return blocks.select("ids", "labels", "low", "high", "columns").mapInArrow(run, FOUND_SCHEMA), sent


def best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def searched(blocks: DataFrame, wave: Wave, dim: int, name: str) -> DataFrame:
    """(anchor_id, place, vec_id, score, rank) of every window over all blocks, as a written table. The blocks
    scanned first raise the edges of the windows for the rest."""
    is_seed = F.col("seq") % SEEDS == 0
    first, sent = scanned(blocks.filter(is_seed), wave, dim)
    seeds = cut(best(first, wave.k).drop("rank"), f"{name}-seeds")
    sent.destroy()
    edges = seeds.groupBy("anchor_id", "place").agg(F.count("*").alias("c"), F.min("score").alias("edge")).filter(F.col("c") == wave.k)
    edges = edges.toPandas()  # a row a window of the wave at most
    if len(edges):
        by_id = np.argsort(wave.ids)
        at = by_id[np.searchsorted(wave.ids, edges["anchor_id"].to_numpy(), sorter=by_id)]
        lower = wave.lower.copy()
        lower[at, edges["place"].to_numpy()] = edges["edge"].to_numpy()
        wave = Wave(wave.ids, wave.labels, wave.vectors, lower, wave.upper, wave.k, wave.same)
    others, sent = scanned(blocks.filter(~is_seed), wave, dim)
    out = cut(best(seeds.unionByName(others), wave.k), name)
    sent.destroy()
    drop_cut(seeds)
    return out


def waves(anchors: DataFrame) -> list[list[int]]:
    """Numbers of packed rows that go together, WAVE_BYTES at most (one row at least)."""
    sizes = anchors.select("block", (F.octet_length("ids").cast("long") * (2 + F.octet_length("low") / 8)).cast("long").alias("bytes")).orderBy("block").collect()
    out: list[list[int]] = []
    left = 0
    for r in sizes:
        if not out or r["bytes"] > left:
            out.append([])
            left = WAVE_BYTES
        out[-1].append(r["block"])
        left -= r["bytes"]
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor (a condition on `id`) and each of its first `positives` rows of the same label, the first
    `negatives` rows of another label whose score is from `low` to `high` percent of the positive's:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    rows: (id, label, v) as `labelled` makes them.
    """
    spark = rows.sparkSession
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    by_label = rows.withColumn("len2", length).repartitionByRange("label", F.desc("len2"), "id").sortWithinPartitions("label", F.desc("len2"), "id")
    blocks = cut(packed(by_label, dim, BLOCK), "negatives-blocks")
    asked = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("_a")).select("id", "_a.label", "_a.v")
    anchors = cut(packed(asked, dim, ANCHORS), "negatives-anchors")
    out = work_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    spark.createDataFrame([], schema).write.parquet(out)
    for numbers in waves(anchors):
        got = [unpacked(r.asDict(), dim) for r in anchors.filter(F.col("block").isin(numbers)).collect()]
        ids, labels = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        vectors = np.concatenate([g[4].T.astype(np.int64) for g in got])
        every = np.full((len(ids), 1), _LEAST), np.full((len(ids), 1), _MOST)
        near = searched(blocks, Wave(ids, labels, vectors, *every, positives, True), dim, "negatives-positives")
        found = near.select("anchor_id", "rank", "vec_id", "score").toPandas()  # `positives` rows an anchor of the wave at most
        by_id = np.argsort(ids)
        at = by_id[np.searchsorted(ids, found["anchor_id"].to_numpy(), sorter=by_id)]
        place, score = found["rank"].to_numpy() - 1, found["score"].to_numpy()
        lower, upper = np.full((len(ids), positives), 1), np.full((len(ids), positives), 0)  # no window
        lower[at, place], upper[at, place] = [-(-low * s // 100) for s in score.tolist()], [high * s // 100 for s in score.tolist()]
        hard = searched(blocks, Wave(ids, labels, vectors, lower, upper, negatives, False), dim, "negatives-hard")
        chosen = near.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        paired = hard.join(chosen, ["anchor_id", "place"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), (F.col("place") + 1).cast("int").alias("positive_rank")
        )
        paired.write.mode("append").parquet(out)
        drop_cut(near, hard)
    drop_cut(anchors, blocks)
    return spark.read.schema(schema).parquet(out)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, with the contract's labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(labelled(table(spark, sf_dir, "embeddings"), label), F.col("id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank
  FROM s WHERE same
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_rank ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  WHERE p.positive_rank <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM n WHERE rank <= 3
"""
