"""Operators that SQL can't express, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from perfusia.llm import decontaminate, language_id, neighbours, packing, quality, repeats, shared, similar, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def brute_repeats(texts, length):
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "finer"), [(1 << 18, {}), (2000, {}), (1 << 18, {"finer": 200, "finer_anchors": (64, 168)}), (1000, {"finer": 200, "finer_anchors": (64, 168)})])
def test_repeats_match_brute_force(spark, hot, finer):
    rng = random.Random(3)
    shared_passage, line = words(rng, 120), words(rng, 30)
    texts = [words(rng, rng.randrange(1, 400)) for _ in range(20)]
    texts += [words(rng, 60) + " " + shared_passage + " " + words(rng, 60) for _ in range(12)]
    texts += [texts[0]] * 3 + [texts[1] + " tail", "é" + texts[2], None, "", "x" * 399, "x" * 400, "ab" * 900, "abc" * 300 + words(rng, 50) + "abc" * 300]
    texts += [line + words(rng, 90) + line + words(rng, 90), words(rng, 100) + " " + (edit := words(rng, 150)), words(rng, 20) + edit[:600] + "!" + edit[601:]]
    found = {r.doc_id: r for r in repeats.repeats(docs(spark, enumerate(texts)), hot_bytes=hot, block_bytes=20000, **finer).collect()}
    for column, length in (("spans", 400), ("finer_spans", 200))[: 1 + bool(finer)]:
        for i, want in enumerate(brute_repeats(texts, length)):
            raw, spans = bytes(found[i].bytes), repeats.merged([s.asDict() for s in found[i][column] or []])
            kept = repeats.kept(raw, spans)
            assert (len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) == want, (column, i, want)


def test_matching_statistics_match_brute_force():
    rng = random.Random(21)
    for _ in range(40):
        passages = [bytes(rng.choice(b"ab\0c"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 6))]
        passages += passages[:1] * rng.randrange(2)
        want = []
        for i, p in enumerate(passages):
            for a in range(len(p) + 1):
                lengths = [next((n for n in range(len(p) - a + 1) if a + n >= len(p) or b + n >= len(q) or p[a + n] != q[b + n]), 0) for j, q in enumerate(passages) for b in range(len(q)) if (i, a) != (j, b)]
                want.append(max(lengths, default=0))
        index = repeats.RunLengthIndex(passages)
        assert index.matching_statistics().tolist() == want and index.run_lengths.sum() == len(want)


def test_passages_of_long_texts_and_of_many_texts_are_the_same(monkeypatch):
    rng = random.Random(22)
    texts = [words(rng, n).encode() for n in (1, 50, 200, 0, 90)] + [b"ab" * 300]
    whole = [tuple(x[k].item() for x in found) for found in [repeats.passages_of(texts, 200, 64)] for k in range(len(found[0]))]
    apart = [(i, *(x[k].item() for x in found[1:])) for i, t in enumerate(texts) for found in [repeats.passages_of([t], 200, 64)] for k in range(len(found[0]))]
    assert whole == apart and {w[0] for w in whole} == {1, 2, 4, 5} and all(w[5] for w in whole if w[0] == 5)
    bytes_of = defaultdict(set)
    for i, a, b, h, d, _ in whole:
        bytes_of[h, d, b - a].add(texts[i][a:b])
    assert all(len(x) == 1 for x in bytes_of.values())


def test_sketches_bound_the_difference_of_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 63, 64, 100, 120, 1000, 1100, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for s in sets]
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(i)])
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in pairs])
    for kind in (0, 1):
        seen = similar.fewest_differing([similar.parities(s, similar.sketch_bits(len(s))[kind]) for s in sets], *pairs.T)
        assert (seen <= true).all() and ((true - seen) % 2 == 0).all()
    least = np.array([min(len(sets[i]), len(sets[j])) for i, j in pairs])
    assert seen[(true > 500) & (least >= 900)].min() > 300


def test_repeats_of_an_empty_table_and_stripping(spark):
    assert repeats.repeats(docs(spark, [])).count() == 0
    passage = "é" * 400
    out = {r.doc_id: r for r in repeats.strip_repeats(docs(spark, [(1, "a" + passage), (2, "b" + passage), (3, "c"), (None, None)])).collect()}
    assert (out[1].text, out[2].text, out[3].text, out[None].text) == ("a", "b", "c", "") and out[1].had_repeats and not out[3].had_repeats


def brute_simhash(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = low.split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> k & 1 for g in grams) * 2 > len(grams) for k in range(64)]
    return sum(1 << k for k, b in enumerate(bits) if b)


def brute_components(n, linked):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("crowded", [128, 2])
def test_simhash_matches_brute_force(spark, crowded):
    rng = random.Random(5)
    base = [words(rng, 300, 500) for _ in range(6)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(6):
            w = b.split()
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts += [None, "", " \t\x0b", "One", "one", "Two words", "É é\xa0x y z"]
    rng.shuffle(texts)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, enumerate(texts)), crowded=crowded).collect()}
    prints = [brute_simhash(t) for t in texts]
    assert [found[i].fp & (2**64 - 1) for i in range(len(texts))] == prints
    assert [found[i].component_id for i in range(len(texts))] == brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)


def test_simhash_broadcasts_no_cells(spark, monkeypatch):
    plans, keep = [], simhash.Scratch.keep
    monkeypatch.setattr(simhash.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    rng = random.Random(6)
    assert simhash.near_duplicates(docs(spark, enumerate(words(rng, 30) for _ in range(20)))).count() == 20
    met = [p for p in plans if "members" in p and "cell" in p]
    assert met and not any("BroadcastExchange" in p for p in met)


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize(("block", "turns"), [(256, 0), (4, 2)])
def test_near_copies_match_brute_force(spark, block, turns):
    rng = random.Random(15)
    line = words(rng, 12)
    texts = [words(rng, 60) + " " + line for _ in range(20)]
    for _ in range(8):
        base = words(rng, rng.randrange(30, 300)).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            texts.append(" ".join(w))
    texts += [None, "", " \t", "One", "one", "Two words", "two words", texts[0].upper(), texts[1] + " end"]
    rng.shuffle(texts)
    frame = docs(spark, enumerate(texts)).selectExpr("doc_id as k", "text")
    named = {r.k: r.component for r in similar.near_copies(frame, ("k",), sample=5, block=block, turns=turns).collect()}
    sets = [five_words(t) for t in texts]
    want = brute_components(len(texts), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    least = {}
    assert [least.setdefault(named[i], i) for i in range(len(texts))] == want
    assert similar.near_copies(frame.limit(0), ("k",)).count() == 0


def test_near_copies_gather_no_lists(spark, monkeypatch):
    plans, keep = [], similar.Scratch.keep
    monkeypatch.setattr(similar.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    rng = random.Random(16)
    base = [words(rng, 60).split() for _ in range(4)]
    texts = [" ".join(["edit" if at == 9 * k else w for at, w in enumerate(b)]) for b in base for k in range(4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert similar.near_copies(rows, ("id",), block=2).select("component").distinct().count() == 4
    assert plans and not any("collect_list" in p for p in plans)


def test_whole_groups_cross_batches():
    keys, nodes = [1, 1, 1, 2, 3, 3, 3, 3, 4, 4], list(range(10))
    made = lambda part: pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(nodes[part]), pa.array([bytes([k]) for k in nodes[part]])], ["key", "node", "sketch"])
    for size in (1, 2, 3, 4, 10):
        got = [[(c[1][p:q].tolist(), s[p:q]) for p, q in bounds] for c, s, bounds in similar._whole_groups((made(slice(k, k + size)) for k in range(0, 10, size)), 1)]
        assert [n for g in got for n, _ in g] == [[0, 1, 2], [3], [4, 5, 6, 7], [8, 9]] and all(s == [bytes([k]) for k in n] for g in got for n, s in g)


def test_near_copies_run_no_step_that_decides_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "links", lambda *a: pytest.fail("set prefixes find every pair that neighbouring fingerprints would"))
    rng = random.Random(3)
    base = words(rng, 80).split()
    texts = [" ".join(base), " ".join([*base[:-1], "edit"]), words(rng, 80)]
    frame = docs(spark, enumerate(texts)).selectExpr("doc_id as k", "text")
    named = {r.k: r.component for r in similar.near_copies(frame, ("k",)).collect()}
    assert named[0] == named[1] != named[2]


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, centre = [], rng.standard_normal((3, 16))
    for i in range(240):
        v = centre[i % 3] + rng.standard_normal(16) * 0.03 if i < 60 else rng.standard_normal(16)
        rows.append((i, v.tolist(), i % 2))
    rows += [(240, rows[0][1], 0), (241, rows[0][1], 1), (242, [x * 2 for x in rows[0][1]], 0), (243, None, 0), (244, [0.0] * 16, 0), (245, [float("nan")] * 16, 0), (246, [None] * 16, 0), (247, rows[0][1], None), (248, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in neighbours.near_duplicates(frame, block=16, leaf=16).collect()}

    def linked(i, j):
        (_, a, x), (_, b, y) = rows[i], rows[j]
        good = lambda v: v and None not in v and np.isfinite(v).all() and np.any(v)
        return bool(x == y and x is not None and good(a) and good(b)) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98

    assert [found[i].component_id for i in range(len(rows))] == brute_components(len(rows), linked)
    assert [found[i].n_links for i in range(len(rows))] == [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0


def test_two_tight_groups_linked_across_are_one_component(spark):
    rng = np.random.default_rng(2)
    axis = np.eye(32)[0]
    turned = np.cos(0.17) * axis + np.sin(0.17) * np.eye(32)[1]  # cosine 0.9856
    rows = [(i, (v + rng.standard_normal(32) * 0.002).tolist(), 0) for i, v in enumerate([axis] * 100 + [turned] * 100)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), enlarged=16)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {r.vec_id: r for r in found.found.collect()}
    assert found.recall == 1 and found.links_audited > 0
    assert {r.component_id for r in got.values()} == {0} and [got[i].n_links for i in range(200)] == ((x @ x.T >= 0.98).sum(1) - 1).tolist()


def test_a_search_that_finds_too_little_is_an_error(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(16)[i % 16] + rng.standard_normal(16) * 0.02).tolist(), 0) for i in range(160)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(neighbours, "_forest", lambda near, joined=None: (np.zeros(0, int), np.zeros(0, int)))
    with pytest.raises(ArithmeticError, match="audited links"):
        neighbours.near_duplicates(frame, rounds=1, leaf=16)


def test_packing_is_an_exact_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(60)] + [words(rng, 3000), None, "", "  two  spaces \n\n x\n y", "don't, stop.\nNow!", "tab\tend ", "<|endoftext|> a", "日本 語"]
    pieces = packing.pack(docs(spark, enumerate(texts)).coalesce(2), path, block_tokens=8192).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in enumerate(texts):
        ids, at = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def plain_balance(lengths, capacity, linear, quadratic):
    """The same choices by looking at every sequence."""
    pieces, rest, first = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, first, 0))
            first += 1
        rest += [(n % capacity, d, n - n % capacity)] * (n % capacity > 0)
    full = sum(r[0] for r in rest) // capacity
    used, cost = [0] * full, [0.0] * full
    while any(u < capacity for u in used):
        rest.sort(key=lambda r: (-r[0], r[1], r[2]))
        n, d, start = rest.pop(0)
        fits = [i for i in range(full) if capacity - used[i] >= n] or [i for i in range(full) if used[i] < capacity]
        i = min(fits, key=lambda i: (cost[i], i))
        part = min(n, capacity - used[i])
        pieces.append((d, start, part, first + i, used[i]))
        used[i] += part
        cost[i] += linear * part + quadratic * part * part
        rest += [(n - part, d, start + part)] * (part < n)
    return pieces


def test_pieces_go_to_the_lowest_cost_with_room():
    rng = random.Random(23)
    for capacity in (8, 32, 128):
        for _ in range(25):
            lengths = [rng.choice([1, 2, capacity // 2, capacity, rng.randrange(1, 3 * capacity)]) for _ in range(rng.randrange(0, 60))]
            want = plain_balance(lengths, capacity, 1.0, 1 / capacity)
            got = packing.balance(lengths, capacity, 1.0, 1 / capacity)
            assert got[: len(want)] == want and sum(p[2] for p in got) == sum(lengths)
            tail = defaultdict(int)
            for p in got[len(want) :]:
                tail[p[3]] += p[2]
            assert all(n & (n - 1) == 0 for n in tail.values()) and len(set(tail.values())) == len(tail)


def test_warc_ranges_own_each_record_once(spark):
    rng = random.Random(4)
    pages = [(i, f"http://h{i % 3}.org/{i}", words(rng, rng.randrange(0, 400))) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", "same"), (53, "u\r\nX: y", "same"), (None, "u", "same"), (54, "u", "\x1f\x8b\x08WARC/1.1")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(frame, shared.Scratch(spark, "warc"))
    for split in (97, 4096, 1 << 30):
        got = {r.page_id: r for r in warc.read_archives(manifest, split).collect()}
        assert len(got) == len(pages) == warc.read_archives(manifest, split, payloads=False).count()
        for i, _, html in pages:
            assert got[i].payload_digest == warc.base32_sha1((html or "").encode()) and got[i].payload_bytes == len((html or "").encode())
            assert got[i].payload is None if got[i].record_type == "revisit" else bytes(got[i].payload) == (html or "").encode()
        assert got[53].refers_to is None and got[52].refers_to == 53 == got[None].refers_to and got[50].refers_to == 51
    assert warc.read_archives(warc.write_archives(frame.limit(0), shared.Scratch(spark, "warc"))).count() == 0


def test_tiling_catches_reordered_passages(spark):
    rng = random.Random(6)
    item = words(rng, 40).split()
    parts = [item[a : a + 8] for a in range(0, 40, 8)]
    moved = [w for p in parts[::-1] for w in p]
    rows = [(1, words(rng, 50) + " " + " ".join(moved).upper() + ". " + words(rng, 50)), (2, words(rng, 300)), (3, " ".join(item[:20])), (4, None), (5, ", ".join(item)), (6, "tiny Item!")]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "tiny item"), (9, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 2)) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect())
    assert got == [(1, 7, 1.0), (5, 7, 1.0), (6, 8, 1.0)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), bench, part_bytes=100).collect()) == [(1, 7), (5, 7), (6, 8)]
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0 == decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count()


@pytest.mark.parametrize("most", [1 << 21, 1])
def test_tiling_catches_blocks_of_three_and_four(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate.Benchmark.candidates, "__defaults__", (most,))
    rng = random.Random(16)
    item = [f"i{k}" for k in range(40)]
    shuffled = {n: [w for a in reversed(range(0, 40, n)) for w in item[a : a + n]] for n in (2, 3, 4)}
    edited = [f"e{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    rows = [(1, " ".join(shuffled[4])), (2, words(rng, 30) + " " + " ".join(shuffled[3])), (3, " ".join(edited)), (4, " ".join(shuffled[2])), (5, " ".join(item[:30])), (6, " ".join(item[:12] * 4))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, words(rng, 40))], "item_id long, text string")
    got = {r.doc_id: round(r.coverage, 3) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {1: 1.0, 2: 0.975, 3: 0.8}  # one token is left of 40 in blocks of 3


def test_tiles_match_a_plain_greedy_search():
    rng = random.Random(8)
    for _ in range(60):
        item, doc = (np.array([rng.randrange(4) for _ in range(n)]) for n in (14, 22))
        free_i, free_d, want = [True] * 14, [True] * 22, 0
        while True:
            best = max(
                ((n, -p, -q) for p in range(14) for q in range(22) if (n := next((k for k in range(15) if p + k >= 14 or q + k >= 22 or not free_i[p + k] or not free_d[q + k] or item[p + k] != doc[q + k]), 0)) >= 3),
                default=None,
            )
            if best is None:
                break
            n, p, q = best[0], -best[1], -best[2]
            free_i[p : p + n], free_d[q : q + n] = [False] * n, [False] * n
            want += n
        got = decontaminate.tiles_of(item, doc, 3)
        assert all((item[p : p + n] == doc[q : q + n]).all() for p, q, n in got) and sum(t[2] for t in got) == want


def test_deobfuscation_restores_words():
    counts = np.zeros(toxicity.SIZE**3)
    for w in ["idiot", "stupid", "the", "trash", "letter", "was", "person"] * 50:
        c = toxicity.codes(f"  {w}  ")
        np.add.at(counts, (c[:-2] * toxicity.SIZE + c[1:-1]) * toxicity.SIZE + c[2:], 1)
    costs = toxicity.trigram_costs(counts)
    for raw, want in {"1d10t": "idiot", "i d i o t": "idiot", "s.t.u.p.1.d": "stupid", "stuuuupid": "stupid", "tr@$h": "trash", "letter": "letter", "id*ot": "idiot"}.items():
        assert toxicity.decode(raw, costs) == want
    assert toxicity.Restorer(costs).restore("The i d i o t was tr@$h, 1234!") == "the idiot was trash 1234!".replace("trash ", toxicity.decode("tr@$h", costs) + " ")


def readings(span):
    """(cost of the channel, codes, letters) of every reading of a span, by plain recursion."""
    t, parted = toxicity, toxicity.SPACED.fullmatch(span) is not None

    def grow(i, last, run):
        if i == len(span):
            yield 0.0, (), ""
            return
        c, separator = span[i], parted and i % 2 == 1 and span[i] in t.SEPARATORS
        if not separator:
            run, last = (run + 1 if c == last else 0), c
        if separator:
            options = [(t.PARTED, (0,), " "), (t.JOINED, (), "")]
        elif c.isalpha():
            options = [(0.0, (t._code(c),), c)]
        else:
            options = [(t.SUBSTITUTED, (t._code(x),), x) for x in t.LOOKALIKES.get(c, "")]
        if not separator and run:
            options.append((t.SECOND if run == 1 else t.REPEATED, (), ""))
        elif not separator and not c.isalpha():
            options.append((t.DROPPED, (0,), " "))
        for cost, codes, letters in options:
            for more, rest, tail in grow(i + 1, last, run):
                yield cost + more, codes + rest, letters + tail

    return grow(0, "", 0)


def test_viterbi_finds_the_cheapest_of_all_readings():
    rng = random.Random(24)
    counts = np.random.default_rng(5).integers(0, 50, toxicity.SIZE**3) * (np.random.default_rng(6).random(toxicity.SIZE**3) < 0.05)
    costs = toxicity.trigram_costs(counts)

    def price(codes):
        path = (0, 0, *codes, 0)
        return sum(float(costs[(a * toxicity.SIZE + b) * toxicity.SIZE + c]) for a, b, c in zip(path, path[1:], path[2:]))

    spans = ["1d10t", "a b c d", "i.d.1.o.t", "aabb1!", "$$$", "**x"] + ["".join(rng.choice("aab1!*$e3") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    for span in spans:
        best = min((cost + price(codes), letters) for cost, codes, letters in readings(span))
        assert toxicity.decode(span, costs) == best[1], (span, best)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad, toxic = i % 3 == 0, i % 5 == 0
        text = " ".join(f"{w}%%%" for w in words(rng, 40, 300).upper().split()) if bad else words(rng, 60, 300)
        text += " you idiot" if toxic else ""
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return docs(spark, [*rows, (None, None), (900, "")]), spark.createDataFrame([*labels, (901, None, None)], "doc_id long, quality int, toxic int")


def brute_size(text, sides, block):
    total = [0, 0]
    for i in range(0, len(text), block):
        for k, side in enumerate(sides):
            found = []
            for raw in side:
                coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
                found.append(len(coder.compress(text[i : i + block])))
            total[k] += min(found)
    return total


def test_quality_scores_match_plain_compression(spark, labelled):
    documents, labels = labelled
    model = quality.fit(documents, labels, per_class=200, dictionary_bytes=2048, many=3)
    assert len(model.good) == len(model.bad) == 3
    extra = docs(spark, [(0, "same text"), (0, "same text"), (1, None), (2, ""), (3, "w1 W2% " * 30_000), (4, "é猫" * 700), (5, "W1%%% W2%%% W3%%%")])
    rows = quality.score(extra, model).collect()
    assert len(rows) == 7 and len({(r.score, r.difference) for r in rows if r.doc_id == 0}) == 1
    for r, text in zip(sorted(rows, key=lambda r: r.doc_id), ["same text"] * 2 + ["", "", "w1 W2% " * 30_000, "é猫" * 700, "W1%%% W2%%% W3%%%"]):
        good, bad = brute_size(text.encode(), (model.good, model.bad), 512)
        d = (bad - good) / max(good, bad, 1)
        assert abs(r.difference - d) < 1e-12
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(np.dot([10 * d, 100 * d * d, 1000 * d**3, 1], model.weights), -30, 30)))) < 1e-9


def test_quality_learns_and_handles_edges(spark, labelled):
    documents, labels = labelled
    model = quality.fit(documents, labels, per_class=300, dictionary_bytes=4096)
    got = {r.doc_id: r.score for r in quality.score(documents, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in range(900)]) > 0.97 and 0 <= got[None] <= 1 and got[None] == got[900]
    assert quality.fit(documents, labels.limit(0)) is None
    assert {r.score for r in quality.score(documents, None).collect()} == {0.5} and quality.score(documents.limit(0), model).count() == 0


def test_toxicity_learns_and_handles_edges(spark, labelled):
    documents, labels = labelled
    model = toxicity.fit(documents, labels)
    extra = docs(spark, [(1000, "hello 1d10t there"), (1001, "hello i d i o t"), (1002, "hello friend"), (1003, None)])
    got = {r.doc_id: r.score for r in toxicity.score(documents.where("doc_id is not null").union(extra), model).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 5 == 0) for i in range(900)]) > 0.97
    assert got[1000] > 0.3 and got[1001] > 0.3 and got[1002] < 0.3 and got[1003] == got[900]
    nothing = toxicity.fit(documents, labels.limit(0))
    assert all(r.score < 1e-6 for r in toxicity.score(documents, nothing).collect())


def test_language_fusion(spark):
    english, german = "the cat and the dog were in the house with a friend", "der hund und die katze waren mit einem freund im haus"
    train = spark.createDataFrame([(english, "en"), (german, "de")] * 20 + [(None, "en"), (english, None)], "text string, lang string")
    model = language_id.fit_text_model(train, shared.Scratch(spark, "language"))
    assert [m.languages for m in model] == [("de", "en", "und")]
    pages = [(1, "http://a.de/x", f"<html lang='de'><p>{german}</p>"), (2, "http://b.com", f'<HTML LANG="en"><script>der die das</script>{english}'), (3, "http://a.de/y", ""), (4, None, None), (5, "nonsense", "<p>zqx jkv wpf xqz vkj fpw qzx kvj" + " xq zj kv wp" * 20)]
    pages += [(10 + i, "http://a.de/z", f"<html lang=de>{german}") for i in range(8)]
    frame = language_id.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.page_id: r for r in language_id.identify(frame, model, ["page_id", "host"], shared.Scratch(spark, "language")).collect()}
    assert [got[i].language for i in (1, 2, 3, 5)] == ["de", "en", "de", "und"] and len(got) == len(pages)
    assert got[3].text_language is None and got[2].host == "b.com" and all(0 < r.confidence <= 1 for r in got.values())
    assert language_id.identify(frame.limit(0), model, ["page_id"], shared.Scratch(spark, "language")).count() == 0
    nothing = language_id.fit_text_model(train.limit(0), shared.Scratch(spark, "language"))
    assert [m.languages for m in nothing] == [("und",)]
    assert {r.language for r in language_id.identify(frame, nothing, ["page_id"], shared.Scratch(spark, "language")).collect()} == {"und"}


def brute_posterior(train, rows, full_at=400, strength=0.25, host_weight=20.0, suffix_weight=50.0):
    """Languages and their posteriors, from counts by plain dictionaries."""
    size, languages = language_id.SIZE, sorted({x.strip().lower() for _, x in train if x})
    counts = {x: defaultdict(int) for x in languages}
    one = [0] * size
    grams = lambda t: [(g // size // size, g // size % size, g % size) for g in language_id.trigrams(t or "").tolist()]
    for text, lang in train:
        if lang and text is not None:
            for g in grams(text):
                counts[lang.strip().lower()][g] += 1
                one[g[2]] += 1
    single = [(x + 1) / (sum(one) + size) for x in one]
    names = [*languages, "und"]

    def log_p(name, g):
        if name == "und":
            return np.log(0.5 * single[g[2]] + 0.5 / size)
        c = counts[name]
        two, of_two = sum(n for h, n in c.items() if h[1:] == g[1:]), sum(n for h, n in c.items() if h[1] == g[1])
        return np.log((c[g] + 5 * (two + 20 * single[g[2]]) / (of_two + 20)) / (sum(n for h, n in c.items() if h[:2] == g[:2]) + 5))

    ll, top = [], []
    for text, *_ in rows:
        own = grams(text)
        ll.append([sum(log_p(x, g) for g in own) / len(own) * min(len(own), full_at) * strength if own else 0.0 for x in names])
        top.append(int(np.argmax(ll[-1])) if own else None)
    places = range(len(names))
    votes = lambda keep: [float(sum(t == k and keep(r) for t, r in zip(top, rows))) for k in places]
    smooth = lambda n, towards, w: [(x + w * y) / (sum(n) + w) for x, y in zip(n, towards)]
    total = votes(lambda r: True)
    share = smooth(total, [1 / len(names)] * len(names), 1.0)
    kinds = len({r[1] for r in rows if r[1]}) or 1
    out = []
    for (_, declared, host, suffix), own in zip(rows, ll):
        prior = smooth(votes(lambda r: r[2:] == (host, suffix)), smooth(votes(lambda r: r[3] == suffix), share, suffix_weight), host_weight)
        said = votes(lambda r: r[1] == declared) if declared else None
        post = [own[k] + np.log(prior[k]) + (np.log((said[k] + 1) / (total[k] + kinds)) if said else 0) for k in places]
        out.append((names[int(np.argmax(post))], 1 / sum(np.exp(np.array(post) - max(post)))))
    return out


@pytest.mark.parametrize("part", [16, 2])
def test_language_posteriors_match_brute_force_in_several_scripts(spark, part):
    plain = {
        "en": "the cat and the dog were in the house", "de": "der hund und die katze im haus", "ru": "кошка и собака были в доме с другом", "uk": "кішка і собака були в будинку з другом",
        "el": "η γάτα και ο σκύλος ήταν στο σπίτι", "zh": "猫和狗在房子里和朋友在一起 我们都在这里", "ja": "ねことイヌはともだちといえにいました", "ar": "القط والكلب كانا في البيت مع صديق", "xx": "one row only is enough",
    }
    train = [(t, x) for x, t in plain.items() for _ in range(1 if x == "xx" else 5)] + [(None, "en"), ("und text", "und"), ("no language", None), ("", "de")]
    rows = [(t, "", f"h{i % 3}", "org" if i % 2 else "") for i, t in enumerate(plain.values())]
    rows += [(plain["ru"], "uk", "h0", ""), (None, "el", "h1", "org"), ("", "", "h1", "org"), (plain["zh"] * 40, "ja", "h9", "cn"), ("same", "", "h0", ""), ("same", "", "h0", ""), ("zqxj vkw", "en", "h0", "")]
    scratch = shared.Scratch(spark, "language")
    model = language_id.fit_text_model(spark.createDataFrame(train, "text string, lang string"), scratch, part)
    assert sum(len(m.languages) for m in model) == 10 and max(len(m.languages) for m in model) <= part + 1
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, host string, suffix string")
    got = {r.id: r for r in language_id.identify(frame, model, ["id"], scratch).collect()}
    want = brute_posterior([(t, x) for t, x in train if x != "und"], rows)
    assert [got[i].language for i in range(len(rows))] == [w[0] for w in want]
    assert np.allclose([got[i].confidence for i in range(len(rows))], [w[1] for w in want], atol=1e-3)
    assert [got[i].language for i in range(8)] == list(plain)[:8]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long"), shared.Scratch(spark, "c")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
