"""Target-distribution importance resampling with a head-tail vocabulary.

Documents are drawn in proportion to how much likelier their words are in the benchmark than in the corpus. Features are
words and, with `longest` 2, pairs of words in turn, dealt to buckets by CRC-32. The head of the vocabulary, at most `head` of the words that
tasks see most and as many pairs, is broadcast: a frequent word brings its finished CRC state, which pairs are
continued from, a frequent pair its bucket. Any other feature takes its CRC directly, so buckets are the same whichever
features the head holds, and what the head is chosen from can be cut to each task's most frequent without an effect on results.
Bucket totals are exact sums over all documents. A document's weight is the floored mean gain of its features; Gumbel noise
from a hash of doc_id turns the largest scores into a draw without replacement.

Documents are tokenised twice, for the head and for the buckets; each one's buckets are kept in a durable table of two bytes a
feature, from which totals and weights are taken. Ranks come from a sort by range: only a number a range reaches the driver.

Defined cases: a null or empty text has no words, no features and weight 0; long texts are read whole; a null doc_id is hashed as an
empty one and comes after others at ties; repeated rows are documents of their own, with equal scores and following ranks; an empty benchmark leaves
all its bucket counts 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from perfusia.llm.shared import Scratch, table

#: Bytes of a word: digits, small letters and what lies beyond ASCII. Capitals become small ones, the rest separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct features that a task counts before it hands on its most frequent.
_HELD = 500_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def _texts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("text").cast("binary").alias("text"), *more)


@dataclass(frozen=True)
class Head:
    """CRC states of frequent words and buckets of frequent pairs. Neither decides a feature's bucket; both only spare work."""

    buckets: int
    words: dict[bytes, int] = field(default_factory=dict)
    pairs: dict[tuple[bytes, bytes], int] = field(default_factory=dict)

    def features(self, words: list[bytes], longest: int) -> np.ndarray:
        """Buckets of all words and, if longest is 2, of all pairs of words in turn."""
        known, crc = self.words.get, zlib.crc32
        states = [crc(w) if (s := known(w)) is None else s for w in words]
        found = np.array(states, np.int64) % self.buckets
        if longest == 1:
            return found
        pair = self.pairs.get
        tails = [crc(b" " + w, s) % self.buckets if (b := pair((v, w))) is None else b for v, w, s in zip(words, words[1:], states)]
        return np.concatenate([found, np.array(tails, np.int64)])


def find_head(documents: DataFrame, buckets: int, longest: int, head: int) -> Head:
    """The features that are most frequent by what each task has counted; at most `head` words and as many pairs reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(longest)]

        def most() -> pa.RecordBatch:
            top = [(size, f, n) for size, counts in enumerate(seen, 1) for f, n in counts.most_common(head)]
            for counts in seen:
                counts.clear()
            kinds, names, n = zip(*top) if top else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.binary()), pa.array(n, pa.int64())], ["size", "feature", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                seen[0].update(words)
                if longest > 1:
                    seen[1].update(map(b" ".join, zip(words, words[1:])))
                if any(len(c) > _HELD for c in seen):
                    yield most()
        yield most()

    counted = _texts(documents).mapInArrow(run, "size int, feature binary, n long").groupBy("size", "feature").agg(F.sum("n").alias("n"))
    top = [[bytes(r.feature) for r in counted.where(F.col("size") == k).orderBy(F.desc("n"), "feature").limit(head).select("feature").collect()] for k in range(1, longest + 1)]
    pairs = {tuple(f.split(b" ")): zlib.crc32(f) % buckets for f in top[1]} if longest > 1 else {}
    return Head(buckets, {w: zlib.crc32(w) for w in top[0]}, pairs)


def _kept_buckets(rows: DataFrame, head: Head, longest: int, scratch: Scratch, *more: str) -> DataFrame:
    """A durable table of n_words and the features' buckets, two or four bytes each, beside the columns `more`."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(head), "<u2" if head.buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(0)]
            held = [shared.value.features(w, longest).astype(kind).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(map(len, words), pa.int64()), pa.array(held, pa.binary())], [*batch.schema.names[1:], "n_words", "features"])

    texts = _texts(rows, *more)
    extra = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in texts.schema.fields[1:])
    return scratch.keep(texts.mapInArrow(run, f"{extra}n_words long, features binary"))


def bucket_totals(kept: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows; a row for each bucket at most reaches the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.bincount(np.frombuffer(held.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = kept.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows.bucket.to_numpy(int)] = rows.n.to_numpy(np.int64)
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    t, s, n = target.astype(float), source.astype(float), len(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weights(kept: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    shared, kind = kept.sparkSession.sparkContext.broadcast(gain), "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(2)]
            weight = [int(shared.value[f].sum()) // len(f) if len(f) else 0 for f in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, held), pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return kept.select("doc_id", "n_words", "features").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, eligible: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """scored with a column rank: 1, 2, .. for the `most` rows of highest score among `eligible` ones, null for the others.

    Rows are dealt by ranges of their order and ranked in each, from the number of rows in the ranges before.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    dealt = scratch.keep(eligible.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dict(sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect()))
    before = dict(zip(counts, accumulate(counts.values(), initial=0)))
    open_ = [k for k in counts if before[k] < most]
    moved = F.create_map(*[F.lit(x).cast("long") for k in open_ for x in (k, before[k])]) if open_ else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + moved[F.col("_range").cast("long")]
    top = dealt.where(F.col("_range").isin(open_)).withColumn("rank", place.cast("long")).where(F.col("rank") <= most)
    return scored.join(top.select("_row", "rank"), "_row", "left")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, head: int = 65_536) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document (doc_id, text), drawn to look like target (text)."""
    if longest not in (1, 2):
        raise ValueError("features are words, or words and pairs")
    scratch = Scratch(documents.sparkSession, "resample")
    found = find_head(documents, buckets, longest, head)
    kept = _kept_buckets(documents, found, longest, scratch, "doc_id")
    gain = gains(bucket_totals(_kept_buckets(target, found, longest, scratch), buckets), bucket_totals(kept, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    weighed = _weights(kept, gain).withColumns({"score": F.col("weight") + noise, "_row": F.monotonically_increasing_id()})
    seen = Observation()
    scored = scratch.keep(weighed.observe(seen, F.count_if(F.col("n_words") >= least_words).alias("n")))
    most = (seen.get["n"] or 0) * percent // 100
    return drawn(scored, scored.where(F.col("n_words") >= least_words), most, scratch).drop("_row")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}

ORACLES = {
    "op13_importance_resampling": r"""
WITH steps AS (
  SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT kind, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), vocabulary AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)
), dealt AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, steps
), counted AS (
  SELECT bucket, count(*) FILTER (kind = 'b') AS t, count(*) FILTER (kind = 'd') AS s FROM words JOIN dealt USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), weighed AS (
  SELECT row, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM words JOIN dealt USING (word) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (row) WHERE kind = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""
}
