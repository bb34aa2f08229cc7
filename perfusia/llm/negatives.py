"""Hard negatives by slot-decomposed selection.

A row's score is its integer inner product with an anchor. An anchor's positives are its first rows of the same label; each asks for
the first negatives of other labels whose scores lie in a window below its own. The positives' upper limits split
scores into disjoint slots, from the highest limit down. As a task reads rows it keeps, for each anchor and slot, the first `negatives`
rows alone, a combiner; those of all tasks are merged. A window holds whole slots from its upper limit down, so its answer is a suffix of
the slots in falling order, the first rows of it, less what lies under its lower limit. Windows may overlap at will: each row is kept in one slot.

Anchors go to tasks in parts of at most `part_rows`, broadcast, and all rows are read once a part for positives and once for
negatives; a larger table makes more passes instead of a larger broadcast. Rows are dealt evenly by a hash, whatever their label
or vector, and what a task holds doesn't depend on how many rows tie. Nothing is sampled or dropped.

Defined cases: rows with a null vec_id or label, or a vector that is null, empty or holds null or non-finite numbers take no part; rows meet only
vectors of their own length; ties go to the smaller vec_id; of rows that repeat a vec_id the one with the greatest (label, vector bytes) counts, and
an anchor is never its own positive; an anchor without positives, or a positive without negatives in its window, has no rows;
a window above a negative score is empty; components, or scores, that no long can hold are an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from perfusia.llm.shared import Scratch, table

#: Rows and anchors that meet in one matrix product.
ROWS, ANCHORS = 2048, 1024
#: Stands below all scores; it can be negated.
LEAST = -(1 << 62)


def quantised(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vector, size, top): vectors of floor(scale * component) in the least integer type that holds them, of `size` components, `top` the largest magnitude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, label, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.floor(scale * np.asarray(values.values.to_numpy(zero_copy_only=False), np.float64))
                if len(x) and np.isfinite(x).all():
                    top = float(np.abs(x).max())
                    if top >= 2.0**31:
                        raise ValueError(f"the components of vector {vec_id} are too large for integer scores")
                    out.append((vec_id, label, x.astype(np.int16 if top < 2**15 else np.int32).tobytes(), len(x), int(top)))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["vec_id", "label", "vector", "size", "top"])

    known = embeddings.where("vec_id is not null and label is not null and embedding is not null")
    found = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(run, "vec_id long, label long, vector binary, size long, top long")
    return found.groupBy("vec_id").agg(F.max(F.struct("label", "vector", "size", "top")).alias("r")).select("vec_id", "r.*")


def matrix(held: list[bytes], size: int, kind: type) -> np.ndarray:
    """Vectors of `size` components."""
    out = np.empty((len(held), size), kind)
    for width, stored in ((2, np.int16), (4, np.int32)):
        own = [i for i, v in enumerate(held) if len(v) == width * size]
        if own:
            out[own] = np.frombuffer(b"".join(held[i] for i in own), stored).reshape(-1, size)
    return out


class Combiner:
    """The first k rows of each slot of each anchor: larger scores first, ties by smaller id."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.slots, self.k = slots, k
        self.scores, self.ids = np.full((anchors * slots, k), LEAST), np.full((anchors * slots, k), np.iinfo(np.int64).max)

    def add(self, cell: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows (score, id) for cells anchor * slots + slot."""
        late = self.scores[cell, -1]
        better = (scores > late) | ((scores == late) & (ids < self.ids[cell, -1]))
        if not better.any():
            return
        cell, scores, ids = cell[better], scores[better], ids[better]
        touched = np.unique(cell)
        at = np.concatenate([np.repeat(touched, self.k), cell])
        scores, ids = np.concatenate([self.scores[touched].ravel(), scores]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.scores[at[keep], place[keep]], self.ids[at[keep], place[keep]] = scores[keep], ids[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, scores and ids of what is held."""
        cell, place = np.nonzero(self.scores > LEAST)
        return cell, self.scores[cell, place], self.ids[cell, place]


@dataclass(frozen=True)
class Part:
    """Anchors of one length, with the falling upper limits of their slots and the least score that any window takes."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    upper: np.ndarray | None = None
    lower: np.ndarray | None = None


def _combined(rows: DataFrame, parts: dict[int, Part], k: int, kind: type) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the first k of each task's rows in each slot. Without upper limits: rows of the anchor's label, one slot."""
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {size: Combiner(len(p.ids), 1 if p.upper is None else p.upper.shape[1], k) for size, p in shared.value.items()}
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in set(sizes.tolist()) & held.keys():
                own = np.flatnonzero(sizes == size)
                for at in np.split(own, range(ROWS, len(own), ROWS)):
                    some = batch.take(pa.array(at))
                    ids, labels, x = some.column(0).to_numpy(), some.column(1).to_numpy(), matrix(some.column(2).to_pylist(), size, kind)
                    for first in range(0, len(shared.value[size].ids), ANCHORS):
                        _meet(shared.value[size], slice(first, first + ANCHORS), held[size], ids, labels, x)
        for size, combiner in held.items():
            cell, scores, ids = combiner.rows()
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[size].ids[cell // combiner.slots]), pa.array((cell % combiner.slots).astype(np.int32)), pa.array(ids), pa.array(scores)], ["anchor_id", "slot", "vec_id", "score"])

    return rows.select("vec_id", "label", "vector", "size").mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")


def _meet(part: Part, some: slice, combiner: Combiner, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
    """Some anchors against some rows, straight into the combiner."""
    scores = np.asarray(part.vectors[some] @ x.T).astype(np.int64)
    same = part.labels[some, None] == labels
    if part.upper is None:
        a, r = np.nonzero(same & (part.ids[some, None] != ids))
        combiner.add(a + some.start, scores[a, r], ids[r])
        return
    upper = part.upper[some]
    a, r = np.nonzero(~same & (scores <= upper[:, :1]) & (scores >= part.lower[some, None]))
    value = scores[a, r]
    slot = (value[:, None] <= upper[a]).sum(1) - 1  # the last slot whose upper limit isn't below it
    combiner.add((a + some.start) * combiner.slots + slot, value, ids[r])


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of all tasks; Spark keeps no more than k of each task."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256, part_rows: int = 32_768, task_rows: int = 16_384
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among embeddings (vec_id, label, embedding).

    A negative of another label fits a positive of score p if low_percent * p <= 100 * its score <= high_percent * p.
    """
    scratch = Scratch(embeddings.sparkSession, "negatives")
    seen = Observation()
    made = quantised(embeddings, scale).observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.col("top")).alias("top"), F.max("size").alias("size"), F.count_if(is_anchor).alias("anchors"))
    made = scratch.keep(made)
    total, anchors = seen.get["n"] or 0, seen.get["anchors"] or 0
    largest = (seen.get["top"] or 0) ** 2 * (seen.get["size"] or 0)
    if largest >= 2**56:
        raise ValueError("scores are too large for exact comparison by percents")
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64  # each exact up to there
    rows = scratch.keep(made.drop("top").repartition(max(1, -(-total // task_rows)), "vec_id"))
    parts = -(-anchors // part_rows)
    out = None
    for part in range(parts):
        own = rows.where(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)).select("vec_id", "label", "vector", "size").collect()
        sizes = {size: [r for r in own if r["size"] == size] for size in {r["size"] for r in own}}
        asked = {s: Part(np.array([r.vec_id for r in some]), np.array([r.label for r in some]), matrix([bytes(r.vector) for r in some], s, kind)) for s, some in sizes.items()}
        found = scratch.keep(_first(_combined(rows, asked, positives, kind), ["anchor_id"], positives).select("anchor_id", "vec_id", "score"))
        limits: dict[int, list[int]] = {}
        for r in found.collect():  # at most `positives` an anchor of this part
            limits.setdefault(r.anchor_id, []).append(r.score)
        windows = {s: w for s, p in asked.items() if (w := _with_slots(p, limits, positives, low_percent, high_percent))}
        slots = _first(_combined(rows, windows, negatives, kind), ["anchor_id", "slot"], negatives)
        ends = scratch.keep(_windows(found, slots, negatives, low_percent, high_percent))
        out = ends if out is None else out.union(ends)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _with_slots(part: Part, limits: dict[int, list[int]], positives: int, low: int, high: int) -> Part | None:
    """The part's anchors that have positives, with their slots. Windows of negative scores are empty and make no slot."""
    keep = np.array([any(p >= 0 for p in limits.get(a, ())) for a in part.ids.tolist()], bool)
    if not keep.any():
        return None
    scores = [sorted((p for p in limits[a] if p >= 0), reverse=True) for a in part.ids[keep].tolist()]
    upper = np.array([[p * high // 100 for p in s] + [LEAST] * (positives - len(s)) for s in scores], np.int64)
    return Part(part.ids[keep], part.labels[keep], part.vectors[keep], upper, np.array([-(-s[-1] * low // 100) for s in scores], np.int64))


def _windows(found: DataFrame, slots: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Each positive's negatives: the suffix of its anchor's slots from its own down, in falling order, the first of them, then the lower limit."""
    # slots are in falling order and each is sorted, so an anchor's rows sorted by score are its slots one after another
    merged = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("fall"), "vec_id"))).alias("all"))
    both = found.where("score >= 0").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("p")).join(merged, "anchor_id")
    suffix = F.slice(F.filter("all", lambda n: -n["fall"] * 100 <= F.col("p") * high), 1, negatives)
    inside = F.filter(suffix, lambda n: -n["fall"] * 100 >= F.col("p") * low)
    return both.select("anchor_id", "positive_id", "p", F.posexplode(inside).alias("pos", "n")).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p").alias("positive_score"), (-F.col("n.fall")).alias("negative_score")
    )


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The query's table: the label of every seventh vector is the next one of ten."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op11_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES = {"op11_slot_negatives": op11_slot_negatives}

ORACLES = {
    "op11_slot_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM positive JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
}
