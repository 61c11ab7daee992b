"""Hard negatives: for each anchor and positive, the rows of other labels that score just below the positive.

Vectors become integers, and all are turned by one orthogonal matrix (the eigenvectors of the sum of outer products, summed
in tasks and merged by treeAggregate), after which the leading components hold most of the length. A task goes over its
rows in small blocks: matrix products of the leading components give partial scores; what the rest can add is bounded by the
product of the two remainders' norms, plus slack for rounding. Pairs whose bound does not reach what the anchor still looks for
are left; the others get more components, and what is left in the end is scored in integers. The bound is exact, so nothing
is lost; where components hold no more than their share, less is left early and the products go on to the end.

Anchors are a stated set of queries (vec_id divisible by 100) against all rows. They are sent to all tasks in blocks of about
8,192, each two passes over the rows: one finds the anchors' positives, one the negatives. A task holds a block and
the best few rows of each anchor (or positive); it gives those, and a window over anchors keeps the best. So rows are
never shuffled, no row meets another but through anchors, and equal vectors or a label with a third of all
rows only add rows to tasks that hold them anyway. A block's results are written to the shared folder.

Defined edge cases: rows without a label, a vec_id or a vector, and those whose vector holds null or non-finite entries,
take no part. Shorter vectors count as followed by zeros. An anchor's other rows are those of another vec_id. Repeated rows
count row by row as positives and negatives; equal anchors (vec_id, label and vector) are searched for once. A positive of
negative score has no negatives, since 80 hundredths of it are more than it. Anchors without rows give none; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, table, written
from .whitening import finite, matrix, scaled, summed

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: Anchors sent to all tasks at a time, about; cells of a block of partial scores.
BLOCK, CELLS = 8192, 1 << 22
#: Below this share of pairs left, they are scored one by one instead of going through further components.
SPARSE = 1 / 16


@dataclass
class Vectors:
    """Rows with what the search needs of them. tails: norms of what follows each of cuts."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turned: np.ndarray
    tails: list[np.ndarray]
    norms: np.ndarray

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.whole[at], self.turned[at], [t[at] for t in self.tails], self.norms[at])


@dataclass
class Rotation:
    """An orthogonal matrix, the numbers of components after which bounds are tested, and the slack for rounding."""

    matrix: np.ndarray
    cuts: list[int] = field(init=False)
    slack: float = field(init=False)

    def __post_init__(self):
        d = len(self.matrix)
        self.cuts = sorted({max(1, d // 4), max(1, d // 2), d})
        # Turning a vector errs by d ** 1.5 * eps of its norm, in norm; a product of two by as much again, and by d * eps.
        eps = np.finfo(float).eps
        self.slack = float(np.linalg.norm(self.matrix @ self.matrix.T - np.eye(d))) + 8 * d**1.5 * eps

    def vectors(self, ids, labels, whole) -> Vectors:
        turned = whole.astype(np.float64) @ self.matrix
        square = turned * turned
        return Vectors(ids, labels, whole, turned, [np.sqrt(square[:, c:].sum(1)) for c in self.cuts], np.sqrt(square.sum(1)))


def fit_rotation(vectors: DataFrame, width: int) -> Rotation:
    """Eigenvectors of the sum of all vectors' outer products, the leading ones first."""

    def part(x):
        x = x.astype(np.float64)
        return [x.T @ x]

    (moments,) = summed(vectors, part, [np.zeros((width, width))])
    return Rotation(np.ascontiguousarray(np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]))


def survivors(rotation: Rotation, anchors: Vectors, rows: Vectors, low: np.ndarray, high: np.ndarray, other_labels: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose score may lie from the anchor's low to its high; of different labels if asked for."""
    a, r, begin, scores = np.arange(len(anchors.ids)), np.arange(len(rows.ids)), 0, 0.0
    for k, cut in enumerate(rotation.cuts):
        scores = scores + rows.turned[r, begin:cut] @ anchors.turned[a, begin:cut].T
        room = np.outer(rows.tails[k][r], anchors.tails[k][a]) + rotation.slack * np.outer(rows.norms[r], anchors.norms[a])
        left = (scores + room >= low[a]) & (scores - room <= high[a])
        if other_labels:
            left &= rows.labels[r][:, None] != anchors.labels[a]
        if cut == rotation.cuts[-1] or np.count_nonzero(left) <= SPARSE * left.size:
            at, of = np.nonzero(left)
            return a[of], r[at]
        some_rows, some_anchors = left.any(1), left.any(0)
        if not some_rows.all() or not some_anchors.all():
            scores, r, a = scores[np.ix_(some_rows, some_anchors)], r[some_rows], a[some_anchors]
        begin = cut
    raise AssertionError


def products(anchors: Vectors, rows: Vectors, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs."""
    if not len(a):
        return np.zeros(0, np.int64)
    most = int(np.abs(anchors.whole).max()) * int(np.abs(rows.whole).max()) * rows.whole.shape[1]
    kind = np.int64 if most < 2**63 else object
    parts = [(anchors.whole[a[i : i + 65536]].astype(kind) * rows.whole[r[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536)]
    return np.concatenate(parts).astype(np.int64)


class Best:
    """The first k of each slot by falling score, then by rising id."""

    def __init__(self, slots: int, k: int):
        self.filled = np.zeros((slots, k), bool)
        self.scores, self.ids = np.zeros((slots, k), np.int64), np.zeros((slots, k), np.int64)

    def floors(self) -> np.ndarray:
        """The least score that can still enter each slot."""
        return np.where(self.filled[:, -1], self.scores[:, -1].astype(np.float64), -np.inf)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(slots):
            return
        k, touched = self.filled.shape[1], np.unique(slots)
        slots = np.concatenate([np.repeat(touched, k), slots])
        filled = np.concatenate([self.filled[touched].ravel(), np.ones(len(scores), bool)])
        scores, ids = np.concatenate([self.scores[touched].ravel(), scores]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -scores, ~filled, slots))
        begins = np.searchsorted(slots[order], touched)
        first = order[begins[:, None] + np.arange(k)]
        self.filled[touched], self.scores[touched], self.ids[touched] = filled[first], scores[first], ids[first]

    def rows(self):
        """slots, scores and ids of all entries."""
        slots, k = np.nonzero(self.filled)
        return slots, self.scores[slots, k], self.ids[slots, k]


def blocks_of(batches, rotation: Rotation, anchors: int):
    """The rows of Arrow batches (vec_id, label, x) in blocks of at most CELLS cells with so many anchors."""
    step = max(16, CELLS // max(1, anchors))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            yield rotation.vectors(some.column("vec_id").to_numpy(), some.column("label").to_numpy(), matrix(some.column("x")))


def find_positives(held):
    """(slot, score, vec_id): of each anchor (its slot) the best rows of its label that a task has."""

    def run(batches):
        import pyarrow as pa

        rotation, anchors = held.value
        best = Best(len(anchors.ids), POSITIVES)
        of_label = {x: np.flatnonzero(anchors.labels == x) for x in np.unique(anchors.labels).tolist()}
        for rows in blocks_of(batches, rotation, len(anchors.ids)):
            for label in np.unique(rows.labels).tolist():
                if (ours := of_label.get(label)) is None:
                    continue
                mine, wanted = rows.take(np.flatnonzero(rows.labels == label)), anchors.take(ours)
                low = best.floors()[ours]
                a, r = survivors(rotation, wanted, mine, low, np.full(len(ours), np.inf), False)
                score = products(wanted, mine, a, r)
                good = (mine.ids[r] != wanted.ids[a]) & (score >= low[a])
                best.offer(ours[a[good]], score[good], mine.ids[r[good]])
        slots, scores, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(scores), pa.array(ids)], names=["slot", "score", "vec_id"])

    return run


def find_negatives(held):
    """(slot, score, vec_id): of each anchor's k-th positive (slot POSITIVES * anchor + k) the best rows within its bounds."""

    def run(batches):
        import pyarrow as pa

        rotation, anchors, least, most = held.value
        best = Best(least.size, NEGATIVES)
        asked = least <= most
        high = np.where(asked, most, -np.inf).max(1)
        for rows in blocks_of(batches, rotation, len(anchors.ids)):
            low = np.maximum(np.where(asked, least, np.inf), best.floors().reshape(least.shape))
            a, r = survivors(rotation, anchors, rows, low.min(1), high, True)
            score = products(anchors, rows, a, r)
            for k in range(POSITIVES):
                good = asked[a, k] & (least[a, k] <= score) & (score <= most[a, k]) & (score >= low[a, k])
                best.offer(POSITIVES * a[good] + k, score[good], rows.ids[r[good]])
        slots, scores, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(scores), pa.array(ids)], names=["slot", "score", "vec_id"])

    return run


def first(found: DataFrame, most: int) -> DataFrame:
    """The first so many of each slot, with their rank."""
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= most)


FOUND = "slot long, score long, vec_id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_negatives(rows: DataFrame, is_anchor: Column, label: Column, scale: int = SCALE, low: int = 80, high: int = 100) -> DataFrame:
    """For the rows (vec_id, embedding) with a label, of which is_anchor picks the anchors: up to five negatives of each of an
    anchor's five positives, scoring from low to high hundredths of the positive."""
    spark = rows.sparkSession
    good = rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), "embedding", is_anchor.alias("is_anchor"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite("embedding"), F.lit(False)))
    width = good.agg(F.max(F.size("embedding"))).first()[0]
    whole = good.select("vec_id", "label", scaled(good, "embedding", scale, 0, max(width or 1, 1)).alias("x"), "is_anchor")
    anchors = written(whole.where("is_anchor").select("vec_id", "label", "x").distinct(), "anchors")
    blocks = -(-anchors.count() // BLOCK)
    if not blocks:
        return spark.createDataFrame([], MINED)
    whole, anchors = whole.drop("is_anchor"), anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks)))
    rotation = fit_rotation(whole.select("x"), max(width, 1))
    path = f"{shared_folder(spark)}/corpusloom/negatives-{uuid.uuid4().hex}"
    for block in range(blocks):
        ours = anchors.where(F.col("block") == block).drop("block").toArrow().combine_chunks()
        n = len(ours)
        if not n:
            continue
        queries = rotation.vectors(ours.column("vec_id").to_numpy(), ours.column("label").to_numpy(), matrix(ours.column("x").combine_chunks()))
        top = first(whole.mapInArrow(find_positives(spark.sparkContext.broadcast((rotation, queries))), FOUND), POSITIVES).toArrow()
        slots, ranks = top.column("slot").to_numpy(), top.column("rank").to_numpy() - 1
        ids, scores = np.zeros((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), np.int64)
        ids[slots, ranks], scores[slots, ranks] = top.column("vec_id").to_numpy(), top.column("score").to_numpy()
        least, most = np.ones((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), np.int64)
        for s, r in zip(slots.tolist(), ranks.tolist(), strict=True):
            p = int(scores[s, r])
            least[s, r], most[s, r] = -(-low * p // 100), high * p // 100
        found = first(whole.mapInArrow(find_negatives(spark.sparkContext.broadcast((rotation, queries, least, most))), FOUND), NEGATIVES)
        asked = spark.createDataFrame([(s * POSITIVES + r, int(queries.ids[s]), int(ids[s, r]), int(scores[s, r])) for s, r in zip(slots.tolist(), ranks.tolist(), strict=True)], "slot long, anchor_id long, positive_id long, positive_score long")
        named = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(asked), "slot")  # five rows an anchor of a block
        named.select(*[f.split()[0] for f in MINED.split(", ")]).write.mode("append").parquet(path)
    return spark.read.schema(MINED).parquet(path)


def op12_pca_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % ANCHOR_EVERY == 0, label)


OP12_SQL = """
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
    FROM good a, good r WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""
