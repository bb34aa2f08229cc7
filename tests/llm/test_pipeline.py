"""The pipeline against brute force, and SQL texts of the corpus queries."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_large import brute_components, brute_simhash

from compare import mismatch

DATA = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("an er on th in re he nd at st".split()) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def expected(texts, items):
    """doc_id -> text after all stages but packing; every language is known here."""
    prints = {i: brute_simhash(t) for i, t in texts.items()}
    ids = sorted(texts)
    groups = brute_components(len(ids), lambda a, b: (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 2)
    kept = {ids[k]: texts[ids[k]] for k in range(len(ids)) if groups[k] == k}
    seen = defaultdict(int)
    for t in kept.values():
        for p in range(len(t) - 399):
            seen[t[p : p + 400]] += 1
    cut = {}
    for i, t in kept.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        rest = "".join(np.array(list(t or ""))[~gone]) if len(t) else ""
        if rest or not gone.any():
            cut[i] = rest
    return {i: t for i, t in cut.items() if not any(f" {x} " in f" {t} " for x in items)}


def test_pipeline_matches_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(11)
    passage, item = prose(rng, 150), prose(rng, 30)
    texts = {i: prose(rng, rng.randrange(20, 200)) for i in range(30)}
    texts |= {30: texts[3], 31: texts[4] + " end", 32: prose(rng, 80) + " " + passage, 33: passage + " " + prose(rng, 90), 34: prose(rng, 40) + " " + item + " " + prose(rng, 40), 35: "", 36: passage[:450], 37: prose(rng, 2500)}
    rows = [(i, t, "en", f"src{i % 2}", len(t), 7) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id].append((p.start, p.length, p.ids_crc32))
    want = expected(texts, [item])
    assert set(got) == set(want)
    for i, text in want.items():
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert sum(n for _, n, _ in got[i]) == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in got[i])


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    same = prose(rng, 60)
    rows = [(1, same, "en", "s", 1, "x"), (1, same, "en", "s", 1, "x"), (None, None, None, None, None, None), (None, prose(rng, 50), "en", None, 5, "y"), (2, "", "en", "s", 0, "z"), *[(10 + i, prose(rng, 60), "en", "s", 9, "w") for i in range(6)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, base string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        found = out.collect()
        assert {r.doc_id for r in found} >= {1, *range(10, 16)}, name
        if name == "near_duplicates":
            assert sum(r.doc_id == 1 for r in found) == 1
        if name in ("language", "benchmark_leaks"):
            assert len(found) == len(rows)


NAMES = ["_id", "_text", "col1", "bytes", "had_repeats", "fp", "component", "tkey", "spans", "node", "base", "h", "language", "declared", "host", "more", "a b", "c0"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    passage = prose(rng, 90)
    rows = [(i, prose(rng, 60) + (" " + passage if i < 3 else ""), "en", "s", 9, *(f"{n}{i}" for n in NAMES)) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.columns, name
        got = out.collect()
        assert len(got) == len(rows), name
        assert all(r[5:] == tuple(f"{n}{r.doc_id}" for n in NAMES) for r in got), name
        if name == "repeated_passages":
            assert sum(r.text == rows[r.doc_id][1] for r in got) == 5
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() >= 8


def test_texts_in_no_language_go(spark):
    import corpus_pipeline

    rng = random.Random(18)
    rows = [(i, prose(rng, 60), "en", f"s{i % 2}", 9) for i in range(100)]
    noise = [(300 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(60)), x, "s1", 9) for i, x in enumerate([None, None, ""])]
    docs = spark.createDataFrame([*rows, *noise, (200, "", "en", "s0", 0), (201, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert {*range(100)} <= got and got & {300, 301, 302} == set()


def test_texts_that_deny_their_declared_language_go(spark):
    """Planted: texts of one language declared as another. Codes with a region, free text for a language, and short or undeclared texts stay."""
    import corpus_pipeline

    rng = random.Random(19)
    other = lambda n: " ".join("".join(rng.choice("der ung ich sch ein ver lich keit".split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, prose(rng, 120) if i % 2 else other(120), "en" if i % 2 else "de", f"s{i % 4}", 9) for i in range(200)]
    wrong = [(300, other(200), "en", "s1", 9), (301, prose(rng, 200), "de", "s0", 9), (302, other(150), "EN-us", "s3", 9)]
    right = [(400, prose(rng, 90), "EN-GB", "s0", 9), (401, other(90), None, "s1", 9), (402, prose(rng, 90), "written in English", "s2", 9), (403, "an er", "de", "s2", 9), (404, "", "de", "s1", 0)]
    right += [(405, prose(rng, 120) + ". " + other(400), "en", "s1", 9)]  # a third of it is in the declared language
    same = [(500, wrong[0][1], "de", "s0", 9)]  # the text of 300 under its own language
    docs = spark.createDataFrame([*rows, *wrong, *right, *same], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert {r[0] for r in [*rows, *wrong, *right, *same]} - got == {300, 301, 302}


def test_near_copies_with_a_few_edits_go(spark):
    import corpus_pipeline

    rng = random.Random(14)
    texts = {}
    for i in range(10):
        w = prose(rng, 120).split()
        texts[10 * i] = " ".join(w)
        for k in range(1, 3):  # two words edited: at most 10 of 116 shingles differ
            texts[10 * i + k] = " ".join(f"{x}q" if at in (20 + k, 90 - k) else x for at, x in enumerate(w))
        texts[10 * i + 3] = " ".join(f"{x}q" if at % 30 == 4 else x for at, x in enumerate(w))  # 4 words: 20 shingles each way, similarity 0.71
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {i for i in texts if i % 10 in (0, 3)}


def test_repeated_passages_of_51_words_are_cut(spark):
    import corpus_pipeline

    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    own = lambda: " ".join(word(9) for _ in range(40))
    passage, line = (" ".join(word(5) for _ in range(n)) for n in (51, 36))  # 305 and 215 bytes
    texts = {i: f"{own()} {p} {own()}" for i, p in enumerate([passage, passage, line, line])}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    for i in (0, 1):
        assert passage[1:-1] not in got[i].text and got[i].n_chars == len(got[i].text) and 700 < len(got[i].text) < 810
    assert [got[i].text for i in (2, 3)] == [texts[2], texts[3]]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op2_nn_descent", "op6_warc_round_trip", "op8_chat_prefix_targets"])
def test_queries_match_their_sql(spark, name):
    assert mismatch(spark, name, DATA) == ""


def test_chat_of_odd_rows(spark):
    from perfusia.llm import chat_format

    rows = [(1, None, None, None), (1, 0, "user", "a\\b <|im_end|> \\"), (1, 1, "assistant", "<|im_start|>"), (1, 1, "assistant", "<|im_start|>"), (None, 0, "assistant", ""), (2, 5, "user", "only"), (3, 0, "<s>", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as key")
    examples = chat_format.expand(frame)
    out = {r.conv_id: r for r in chat_format.digest(examples).collect()}
    assert (out[1].n_turns, out[1].loss_chars, out[2].n_turns, out[2].loss_chars, out[None].n_turns, out[3].n_turns) == (4, 24, 1, 0, 1, 1)
    turns = examples.where("conv_id = 1").orderBy("example").select(chat_format.parse(examples.text).alias("t")).collect()[-1].t
    assert [(t.role, t.text) for t in turns] == [("", ""), ("user", "a\\b <|im_end|> \\"), ("assistant", "<|im_start|>"), ("assistant", "<|im_start|>")]
    assert chat_format.expand(frame.limit(0)).count() == 0


def test_words_are_encoded_as_one_text():
    """Ids of parts of a text, told apart where a word starts; unsafe parts cost a search for seams in their own texts only."""
    import numpy as np
    import public_tokenizers

    from perfusia.llm import packing

    coder = packing.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    keys = ["word", "straße", "\x02bare", "漢字", "x1,", "ʰa", "Ⅷ", "it's"]
    ids, lengths = coder.ids_of(keys)
    want = [coder.tokenizer.encode(k[1:] if k[0] == "\x02" else " " + k, add_special_tokens=False).ids for k in keys]
    assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
    texts, asked = ["a  b c", "a b\tc. d", "", "\n\n x\n", "plain words only", "a\x02 b"], []
    whole = coder.sought
    coder.sought = lambda text: asked.append(text) or whole(text)
    for _ in range(2):
        got = coder.encode(texts)
        assert all(np.array_equal(g, coder.tokenizer.encode(t, add_special_tokens=False).ids) for g, t in zip(got, texts))
    assert "plain words only" not in asked
