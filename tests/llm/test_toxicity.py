"""The toxicity score on the given tables: held-out figures, and what deobfuscation adds."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest

from perfusia.llm import toxicity
from perfusia.llm.quality import fold
from perfusia.llm.shared import table

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def fitted(spark):
    """The query's model, and (doc_id, text, toxic) of the rows held out."""
    documents, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.fit(documents, labels.where(~fold(4, 2)))
    held = documents.join(labels.where("toxic is not null"), "doc_id").where(fold(4, 2)).select("doc_id", "text", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    return model, held


def scores(model, texts):
    measure = model.scorer()
    *slopes, base = model.curve
    return np.array([1 / (1 + np.exp(-np.dot(slopes, measure(t or "")[0]) - base)) for t in texts])


def test_fifty_toxic_rows_teach_something(spark, fitted):
    """Some toxic rows hold no toxic word at all, so no more than two thirds can be found by words."""
    model, held = fitted
    got, toxic = scores(model, [r.text for r in held]), np.array([r.toxic for r in held]) == 1
    auc = np.mean([(a > b) + (a == b) / 2 for a in got[toxic] for b in got[~toxic]])
    assert auc > 0.75 and (got[toxic] >= 0.3).mean() > 0.6 and (got[~toxic] >= 0.3).mean() < 0.03
    by_spark = {r.doc_id: r.score for r in toxicity.score(table(spark, DATA, "documents"), model).collect()}
    assert all(abs(by_spark[r.doc_id] - s) < 1e-9 for r, s in zip(held, got))


@pytest.mark.parametrize("disguise", [
    lambda w: w.translate(str.maketrans("aeios", "@310$")), lambda w: " ".join(w), lambda w: w[0] + "".join(c * 3 for c in w[1:]), lambda w: ".".join(w.translate(str.maketrans("io", "10"))),
])
def test_disguised_words_are_found_by_decoding_alone(fitted, monkeypatch, disguise):
    """Each toxic word of the held-out rows is disguised. With Viterbi decoding almost all rows that were found still are; without it hardly any."""
    model, held = fitted
    # the table's invective; a row counts if it was found as it stands
    found = [r.text.lower() for r, s in zip(held, scores(model, [r.text for r in held])) if r.toxic == 1 and s >= 0.3]
    words = {w for t in found for w in model.scorer()(t)[1] if model.weights.get(w, 0) > 2}
    assert len(found) >= 8 and len(words) >= 3
    hidden = []
    for text in found:
        for w in sorted(words, key=len, reverse=True):
            text = text.replace(w, disguise(w))
        hidden.append(text)
    read = (scores(model, hidden) >= 0.3).mean()
    monkeypatch.setattr(toxicity, "decode", lambda span, costs: "")
    unread = (scores(model, hidden) >= 0.3).mean()
    assert read >= 0.7 and unread <= read - 0.4, (read, unread)
