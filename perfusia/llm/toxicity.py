"""Toxicity after noisy-channel deobfuscation.

A character trigram model is counted over all documents. A token that holds look-alike symbols, repeated
letters or single letters set apart is a lattice: each position may stand for itself, for the letters it
imitates, or, if it repeats or separates, for nothing. Viterbi search finds the reading of least channel
cost plus language-model cost. Restored words are then scored: weights of words and of runs of 4 to 6 letters in
them are log odds learned from labelled rows and shrunk towards zero, the more the fewer toxic rows they are seen in. A logistic curve turns a text's two
highest weights and its length, by which high weights come up by chance, into a probability; it is fitted on what each half of
the labelled rows gets from a lexicon of the other half, while the lexicon in use is that of all of them.

Labelled rows are a bounded sample: at most `per_class` toxic and twice as many other rows, those of least
hash of doc_id. The lexicon holds all features that `least_rows` toxic rows of the sample have and whose shrunk weight is over 0.5.
Counts of the character model and scores cover whole texts of all rows.

Defined cases: a null text is an empty text and scores as one without evidence; null labels train nothing;
without rows of both labels every score is the share of toxic rows, 0 if there are none, and with too few to cross the lexicon's halves the curve has slope 1; a null doc_id
isn't held out; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.quality import fold, logistic
from perfusia.llm.shared import table

# Letters that a symbol imitates, and marks that set letters apart.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = " ._-*"
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
SIZE, OTHER = 64, 63

SUBSTITUTED, SECOND, REPEATED, JOINED, PARTED, DROPPED = 1.0, 2.0, 0.3, 0.3, 1.0, 3.0
SUSPECT = re.compile(r"(?s)(?=.*[^\W\d_])(?:.*[0-9@$!|+(€£*]|.*([^\W\d_])\1)")
DOUBLED = re.compile(r"([^\W\d_])\1")
SPACED = re.compile(r"(?<!\S)\S(?:[ ._\-*]\S){2,}(?!\S)")
EDGES = ".,;:?!\"'()[]{}<>«»“”…"

_CODES = np.zeros(0x250, np.int64)
_CODES[[c for c in range(0x250) if chr(c).isalpha()]] = OTHER
for _i, _c in enumerate(LETTERS):
    _CODES[ord(_c)] = _i + 1


def codes(text: str) -> np.ndarray:
    """Alphabet codes: 0 for what is no letter, OTHER for letters outside LETTERS."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], OTHER)


def _code(c: str) -> int:
    return int(_CODES[ord(c)]) if ord(c) < len(_CODES) else OTHER


def count_trigrams(documents: DataFrame) -> np.ndarray:
    """Counts over whole texts of all rows; what reaches the driver is at most a row for each of SIZE ** 3 trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for first in range(0, len(batch), 512):
                c = codes("\n\n".join(x or "" for x in batch.column(0).slice(first, 512).to_pylist()))
                if len(c) > 2:
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["trigram", "n"])

    rows = documents.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[rows.trigram.to_numpy(int)] = rows.n.to_numpy(float)
    return counts


def trigram_costs(counts: np.ndarray, prior: float = 5.0) -> np.ndarray:
    """-log P(third | first two), backing off to bigrams and letters."""
    three = counts.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + prior * p1) / (two.sum(1, keepdims=True) + prior)
    p3 = (three + prior * p2) / (three.sum(2, keepdims=True) + prior)
    return -np.log(p3).astype(np.float32).ravel()


def decode(span: str, costs: np.ndarray) -> str:
    """The likeliest reading of a lower-case span: exact Viterbi over states of the last two letters."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last, run = "", 0
    parted = SPACED.fullmatch(span) is not None
    for i, c in enumerate(span):
        separator = parted and i % 2 == 1 and c in SEPARATORS
        run = run + 1 if c == last and not separator else (run if separator else 0)
        last = last if separator else c
        emits = [(_code(c), c, 0.0)] if c.isalpha() else [(_code(x), x, SUBSTITUTED) for x in LOOKALIKES.get(c, "")]
        skip = None
        if separator:
            emits, skip = [(0, " ", PARTED)], JOINED
        elif run:
            skip = SECOND if run == 1 else REPEATED
        elif not c.isalpha():
            emits, skip = [*emits, (0, " ", DROPPED)], None
        after: dict = {}
        for (a, b), (cost, chain) in states.items():
            if skip is not None and ((a, b) not in after or cost + skip < after[a, b][0]):
                after[a, b] = cost + skip, chain
            row = (a * SIZE + b) * SIZE
            for k, x, w in emits:
                total = cost + w + float(costs[row + k])
                if (b, k) not in after or total < after[b, k][0]:
                    after[b, k] = total, (chain, x)
        states = after
    _, chain = min(((cost + float(costs[(a * SIZE + b) * SIZE]), chain) for (a, b), (cost, chain) in states.items()), key=lambda s: s[0])
    out = []
    while chain is not None:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out))


def features(word: str) -> list[str]:
    """The word and the runs of letters inside it."""
    return [word, *{f"~{word[i : i + n]}" for n in (4, 5, 6) if len(word) > n for i in range(len(word) - n + 1)}]


@dataclass
class Restorer:
    """Restored words of texts; readings of tokens are kept while a task runs, in a bounded cache."""

    costs: np.ndarray
    most: int = 500_000
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def words(self, token: str) -> tuple[str, ...]:
        """The words of a lower-case token, as they stand and as restored."""
        found = self.known.get(token)
        if found is None:
            core = token.strip(EDGES)
            if core.isalpha() and not DOUBLED.search(core):  # most tokens: nothing to split or restore
                found = (core,)
            else:
                plain = [x for x in re.split(r"[\W\d_]+", core) if x]
                if SUSPECT.match(core) or SPACED.fullmatch(core):
                    plain += decode(core, self.costs).split()
                found = tuple(dict.fromkeys(plain))
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[token] = found
        return found

    def tokens(self, text: str) -> set[str]:
        low = text.lower()
        return {*low.split(), *(m.group() for m in SPACED.finditer(low))}

    def restore(self, text: str) -> str:
        """The text in lower case with suspect spans replaced by their readings."""
        low = SPACED.sub(lambda m: decode(m.group(), self.costs), text.lower())
        return re.sub(r"\S+", lambda m: decode(core, self.costs) if SUSPECT.match(core := m.group().strip(EDGES)) else m.group(), low)


#: What the curve takes: a text's highest and second highest weight, the log of its length beyond 200 distinct tokens.
TERMS = 3


@dataclass(frozen=True)
class ToxicityModel:
    costs: np.ndarray
    weights: dict[str, float]
    curve: tuple[float, ...]  # a weight for each of TERMS, then the intercept

    def scorer(self):
        restorer, cache, inside = Restorer(self.costs), {}, ahocorasick.Automaton()
        for f, weight in self.weights.items():
            if f[0] == "~":
                inside.add_word(f[1:], (weight, f))
        inside.make_automaton()
        runs = inside.iter if len(inside) else lambda w: ()

        def best(token: str):
            """The heaviest feature of a token's words: the words themselves, and runs of letters found in one pass."""
            found = None
            for w in restorer.words(token):
                hits = [hit for _, hit in runs(w) if len(hit[1]) <= len(w)]  # a run is shorter than its word
                if w in self.weights:
                    hits.append((self.weights[w], w))
                if hits and (found is None or (*max(hits), w) > found):
                    found = (*max(hits), w)
            return found

        def evidence(text: str) -> tuple[list[float], list[str]]:
            hits, tokens = {}, restorer.tokens(text)
            for token in tokens:
                if token not in cache:
                    if len(cache) >= 1_000_000:
                        cache.clear()
                    cache[token] = best(token)
                if (hit := cache[token]) is not None:
                    hits[hit[1]] = hit
            top = sorted((h[0] for h in hits.values()), reverse=True)
            return [*(top + [0.0, 0.0])[:2], math.log(max(len(tokens), 200) / 200)], sorted({h[2] for h in hits.values()})

        return evidence


def _evidence(documents: DataFrame, model: ToxicityModel, extra: str = "") -> DataFrame:
    """doc_id, evidence, hits and the integer column `extra`."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = shared.value.scorer()
        for batch in batches:
            found = [measure(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.list_(pa.string())), *batch.columns[2:]],
                ["doc_id", "evidence", "hits", *batch.schema.names[2:]],
            )

    kind = f", {extra} int" if extra else ""
    return documents.select("doc_id", "text", *[extra] * bool(extra)).mapInArrow(run, f"doc_id long, evidence array<double>, hits array<string>{kind}")


def lexicon(counts: dict[str, tuple[int, int]], clean: int, toxic: int, least_rows: int, prior: float = 2.0, shrink: float = 3.0) -> dict[str, float]:
    """Shrunk log odds from numbers of clean and toxic rows, of each feature and in all."""
    out = {}
    for f, (c, t) in counts.items():
        if t >= least_rows:
            share = prior * (c + t) / (clean + toxic)
            weight = math.log((t + share) / (toxic + prior)) - math.log((c + share) / (clean + prior))
            if (weight := weight * t / (t + shrink)) > 0.5:
                out[f] = weight
    return out


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 6000, least_rows: int = 3) -> ToxicityModel:
    """labels (doc_id, toxic)."""
    costs = trigram_costs(count_trigrams(documents))
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    pick = lambda k, n: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = documents.select("doc_id", "text").join(F.broadcast(pick(1, per_class).union(pick(0, 2 * per_class))), "doc_id").withColumn("half", (F.abs(F.xxhash64("doc_id", F.lit(7))) % 2).cast("int"))
    shared = documents.sparkSession.sparkContext.broadcast(costs)
    names = ["c0", "t0", "c1", "t1"]  # clean and toxic rows of each half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            counts = [Counter() for _ in names]
            for text, toxic, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = {w for t in restorer.tokens(text.as_py() or "") for w in restorer.words(t)}
                counts[2 * half + toxic].update({f for w in words for f in features(w)} | {""})
            found = [*set().union(*counts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[f] for f in found], pa.int64()) for c in counts)], ["feature", *names])

    seen = rows.select("text", "toxic", "half").mapInArrow(run, "feature string, " + ", ".join(f"{n} long" for n in names)).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    n = {r.feature: r[1:] for r in seen.where((F.col("t0") + F.col("t1") >= least_rows) | (F.col("feature") == "")).toPandas().itertuples(index=False)}
    c0, t0, c1, t1 = n.pop("", (0, 0, 0, 0))
    prior_odds = math.log(max(share, 1e-12) / max(1 - share, 1e-12))
    if not c0 + c1 or not t0 + t1:
        return ToxicityModel(costs, {}, (*[0.0] * TERMS, prior_odds))
    weights = lexicon({f: (k[0] + k[2], k[1] + k[3]) for f, k in n.items()}, c0 + c1, t0 + t1, least_rows)
    if not all((c0, t0, c1, t1)):
        return ToxicityModel(costs, weights, (1.0, *[0.0] * (TERMS - 1), prior_odds))
    halves = [lexicon({f: k[:2] for f, k in n.items()}, c0, t0, least_rows), lexicon({f: k[2:] for f, k in n.items()}, c1, t1, least_rows)]
    crossed = [_evidence(rows.where(F.col("half") == k), ToxicityModel(costs, halves[1 - k], (0.0,) * (TERMS + 1)), "toxic") for k in (0, 1)]
    other = crossed[0].union(crossed[1]).select("evidence", "toxic").toPandas()
    *slopes, base = map(float, logistic(np.array(other.evidence.tolist(), float), other.toxic.to_numpy(float)))
    odds = other.toxic.mean() / (1 - other.toxic.mean())
    return ToxicityModel(costs, weights, (*slopes, base + math.log(share / (1 - share) / odds)))


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, evidence, hits (restored words that count) and score."""
    *slopes, base = model.curve
    log_odds = sum((F.col("evidence")[i] * w for i, w in enumerate(slopes)), F.lit(base))
    return _evidence(documents, model).withColumn("score", 1 / (1 + F.exp(-log_odds)))


def op9_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels").where(~fold(4, 2)))
    return score(documents, model).select(
        "doc_id", fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits"
    )


QUERIES = {"op9_noisy_channel_toxicity": op9_noisy_channel_toxicity}
