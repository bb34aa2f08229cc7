"""Hard negatives, vantage-point search and importance resampling beside brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import mismatch
from perfusia.llm import negatives, resample, vantage

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"
ODD = [(None, [1.0, 2.0], 1), (7001, None, 1), (7002, [0.0, 0.0], 1), (7003, [1.0, None], 1), (7004, [math.nan, 1.0], 1), (7005, [], 1), (7006, [math.inf, 1.0], 1)]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_slot_negatives", "op12_vantage_point_trees", "op13_importance_resampling"])
def test_query_matches_sql(spark, name):
    assert mismatch(spark, name, DATA) == ""


# -- hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=10):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v and label is not None]
    out = []
    for a, la, va in rows:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in rows if i != a and len(v) == len(va))
        own = [(i, -s) for s, i, label in scored if label == la][:positives]
        for i, p in own:
            fits = [(n, -s) for s, n, label in scored if label != la and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(a, i, rank, n, p, s) for rank, (n, s) in enumerate(fits, 1)]
    return sorted(out)


def clustered(n, size, labels, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    rows = [(i, (centres[i % 5] + spread * rng.normal(size=size)).round(3).tolist(), int(rng.integers(labels))) for i in range(n)]
    return [*rows, *((n + i, list(rows[0][1]), i % labels) for i in range(n // 2))]  # a third of all are copies


@pytest.mark.parametrize(("size", "part_rows", "task_rows"), [(6, 8, 64), (3, 1000, 10_000)])
def test_negatives_match_brute_force(spark, size, part_rows, task_rows):
    rows = clustered(300, size, 4, size)
    table = spark.createDataFrame([*rows, *rows[:5], *ODD, (9000, [0.5] * (size + 1), 1), (9010, [1.0] * (size + 1), 2), (9020, [2.0] * (size + 1), 1)], VECTORS).repartition(7)
    found = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, part_rows=part_rows, task_rows=task_rows)
    extra = [(9000, [0.5] * (size + 1), 1), (9010, [1.0] * (size + 1), 2), (9020, [2.0] * (size + 1), 1)]
    assert sorted(map(tuple, found.collect())) == plain_negatives([*rows, *extra], lambda i: i % 10 == 0)


def test_negatives_at_zero_and_below(spark):
    """A positive of score 0 takes scores of 0; one below 0 takes nothing; large components are compared exactly."""
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, -1.0], 2), (3, [-1.0, 0.0], 1), (4, [-0.5, 0.0], 2), (5, [90_000.0, 1.0], 1), (6, [80_000.0, 1.0], 2)]
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0)
    got = sorted(map(tuple, found.collect()))
    assert got == plain_negatives(rows, lambda i: i == 0)
    assert (0, 1, 1, 2, 0, 0) in got and not any(r[1] == 3 for r in got)


def test_negatives_of_nothing_and_of_too_large_components(spark):
    empty = spark.createDataFrame([], VECTORS).withColumn("anchor_id", F.lit(1))
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame(ODD, VECTORS), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e9], 1)], VECTORS), F.col("vec_id") == 0).count()


def test_a_combiner_keeps_the_first_of_ties():
    rng = np.random.default_rng(5)
    cell, scores, ids = rng.integers(0, 6, 4000), rng.integers(-3, 3, 4000), rng.permutation(4000)
    held = negatives.Combiner(3, 2, 7)
    for part in np.array_split(np.arange(4000), 13):
        held.add(cell[part], scores[part], ids[part])
    got = sorted(zip(*(x.tolist() for x in held.rows())))
    want = [(c, s, i) for c in range(6) for s, i in sorted(((s, i) for k, s, i in zip(cell.tolist(), scores.tolist(), ids.tolist()) if k == c), key=lambda r: (-r[0], r[1]))[:7]]
    assert got == sorted(want)


# -- vantage points


def plain_nearest(rows, queries, k=5):
    rows = [(i, np.array(v)) for i, v, _ in rows if v]
    out = {}
    for q, vq in rows:
        if queries(q):
            near = [(-float(np.add.accumulate(vq * v)[-1] / np.sqrt(np.add.accumulate(vq * vq)[-1] * np.add.accumulate(v * v)[-1])), i) for i, v in rows if i != q and len(v) == len(vq)]
            out[q] = [(rank, i, -s) for rank, (s, i) in enumerate(sorted(near)[:k], 1)]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect()):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize(("size", "shard_rows", "spread"), [(8, 60, 0.2), (3, 10_000, 1.0), (8, 25, 0.0)])
def test_factor_one_is_exact(spark, size, shard_rows, spread):
    """Also with a third of all rows equal, in regions of several shards, and with vectors of other lengths."""
    rows = [*clustered(400, size, 3, size, spread), (9000, [0.5] * 5, 1), (9010, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (9020, [1e200, 1e180], 0)]
    table = spark.createDataFrame([*rows, *rows[:9], *ODD], VECTORS).repartition(5)
    found = vantage.nearest(table, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, sample=256)
    want = {q: n for q, n in plain_nearest(rows[:-1], lambda i: i % 10 == 0).items() if n}
    assert by_query(found) == want


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(200, 16)) for c in centres])
    u = vantage.units(x)
    tree, leaf = vantage.grow(u, 5)
    bounds = tree.bounds(vantage.distances(u[:50], tree.pivots))
    true = vantage.distances(u[:50], u)
    for j in range(32):
        assert (leaf == j).any() and (true[:, leaf == j].min(1) >= bounds[:, j] - vantage.SLACK).all()
    exact, all_seen = vantage.search(np.arange(50), x[:50], np.full(50, -2.0), np.arange(len(x)), x, 5, 1.0, 64)
    assert all_seen < 50 * len(x) / 4  # clusters are passed over
    want = np.argsort(np.where(np.arange(len(x)) == np.arange(50)[:, None], 9, true), axis=1)[:, :5]
    assert (np.sort(exact.ids) == np.sort(want)).all()


def test_larger_factors_visit_less_and_recall_is_measured():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 5))
    ids, queries = np.arange(len(x)), x[:100]
    run = lambda factor: vantage.search(ids[:100], queries, np.full(100, -2.0), ids, x, 5, factor, 32)
    (exact, most), (some, fewer), (loose, least) = run(1.0), run(1.5), run(4.0)
    recall = lambda got: np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got.ids.tolist(), exact.ids.tolist())])
    assert most > fewer > least and recall(some) >= 0.9 and recall(some) >= recall(loose)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS).withColumn("region", F.lit(1))
    assert vantage.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert vantage.nearest(spark.createDataFrame(ODD, VECTORS), F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], VECTORS)
    assert [tuple(r) for r in vantage.nearest(alone, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 1.0)]


# -- importance resampling


def plain_resampling(documents, target, longest, buckets, percent=10, least=2, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    held = [(i, *features(t)) for i, t in documents]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for _, text in target for b in features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, n, f in held:
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(order[: len(order) * percent // 100], 1)}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize(("longest", "head", "buckets"), [(1, 65_536, 100), (2, 5, 100_000), (2, 0, 50), (2, 1000, 300)])
def test_resampling_matches_brute_force(spark, longest, head, buckets):
    rng = np.random.default_rng(head)
    words = ["Alpha", "beta", "ÉTÉ", "straße", "漢字", "x1", "don't", "3.14", "the", "\x00nul", "Zz"]
    text = lambda: "  ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(1, 12) / 66))
    documents = [(int(i), text()) for i in range(200)] + [(None, "alpha beta the"), (300, None), (301, ""), (302, "the " * 20_000), (303, ".,;")]
    target = [(1, "alpha beta alpha beta straße"), (2, None), (3, text())]
    table = spark.createDataFrame(documents, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x")}).repartition(5)
    found = resample.resample(table, spark.createDataFrame(target, "item_id long, text string"), percent=20, least_words=2, longest=longest, buckets=buckets, head=head)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_resampling(documents, target, longest, buckets, 20)


def test_resampling_of_nothing_and_of_repeated_rows(spark):
    schema = "doc_id long, text string"
    target = spark.createDataFrame([(1, "a b")], schema)
    assert resample.resample(spark.createDataFrame([], schema), target).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 10, schema)
    found = resample.resample(same, spark.createDataFrame([], schema), percent=30, least_words=3).collect()
    assert len({r.score for r in found}) == 1 and sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3]
