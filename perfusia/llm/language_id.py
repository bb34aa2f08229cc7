"""Language identification by Bayesian evidence fusion.

Three kinds of evidence are multiplied: the likelihood of the text under character trigram models, one a
language and one of shuffled letters called `und`; the likelihood of the declared language, from how often
texts of a language carry that declaration; and a prior of the host, smoothed towards that of its address
suffix and that towards all rows. Declarations and priors are counted by grouped aggregation over all
rows, each counted under the language its text alone suggests. Trigram counts come from all documents.

Text evidence is the mean log likelihood of a trigram times a weight that grows with the text up to
`full_at` trigrams, since trigrams of a text are not independent.

A declaration is a code of two or three letters, alone or before a region or script (`pt`, `pt-BR`); whatever else stands there
declares nothing, so that a dirty column makes no models.

Defined cases: a null or empty text brings no evidence; nor do a null or empty declaration; a null host or
suffix is a host or suffix like others; ties go to the language first in order; repeated rows are
judged each; an empty table gives no rows; without a training row every row is `und`; columns that the
caller doesn't name aren't read, and those to keep are carried through under their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.shared import Scratch, table
from perfusia.llm.toxicity import LETTERS

UNKNOWN = "und"


#: Codes of letters: 0 is no letter, then those of LETTERS, then codes that all other letters share.
SIZE = 96
SHARED = SIZE - len(LETTERS) - 1
_CODES = np.array([1 + len(LETTERS) + c * 40503 % 65521 % SHARED if chr(c).isalpha() else 0 for c in range(0x10000)], np.int64)
_CODES[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    beyond = 1 + len(LETTERS) + points.astype(np.int64) * 40503 % 65521 % SHARED
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], beyond)


def trigrams(text: str) -> np.ndarray:
    c = codes(text)
    if len(c) > 1:
        c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    return (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:] if len(c) > 2 else np.zeros(0, np.int64)


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of trigrams for some languages; UNKNOWN is the last of the last part."""

    languages: tuple[str, ...]
    logs: np.ndarray  # languages x trigrams
    full_at: int = 400
    strength: float = 0.25

    def evidence(self, texts: list[str]) -> np.ndarray:
        grams = [trigrams(t) for t in texts]
        lengths = np.array(list(map(len, grams)))
        flat, some = np.concatenate([*grams, [0]]).astype(np.int64), lengths > 0
        starts = (np.cumsum(lengths) - lengths)[some]
        out = np.zeros((len(texts), len(self.languages)))
        for k, row in enumerate(self.logs):
            if len(starts):
                values = row[flat].astype(np.float64)
                values[-1] = 0
                out[some, k] = np.add.reduceat(values, starts) / lengths[some] * np.minimum(lengths[some], self.full_at) * self.strength
        return out


def code(column: Column | str) -> Column:
    """The language code that a declaration starts with, empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_][a-z0-9_-]*)?$", 1), F.lit(""))


def fit_text_model(documents: DataFrame, scratch: Scratch, part: int = 16) -> list[TextModel]:
    """From documents (text, lang), lang as declared: models of all languages, `part` in each."""
    known = documents.where("text is not null").select(code("lang").alias("lang"), "text").where(~F.col("lang").isin("", UNKNOWN))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for first in range(0, len(batch), 256):
                part: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(batch.column(0).slice(first, 256).to_pylist(), batch.column(1).slice(first, 256)):
                    part.setdefault(lang, []).append(trigrams(text.as_py()))
                for lang, grams in part.items():
                    found.setdefault(lang, []).append(np.unique(np.concatenate(grams), return_counts=True))
            for lang, counts in found.items():
                at, place = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c[1] for c in counts]), len(at)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n)], ["lang", "trigram", "n"])

    counted = scratch.keep(known.mapInArrow(count, "lang string, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n")))
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    one = np.zeros(SIZE)
    for r in counted.groupBy((F.col("trigram") % SIZE).alias("letter")).agg(F.sum("n").alias("n")).collect():
        one[r.letter] = r.n
    single = (one + 1) / (one.sum() + SIZE)
    shuffled = np.tile(np.log(0.5 * single + 0.5 / SIZE), SIZE * SIZE).astype(np.float32)
    models = []
    for first in range(0, max(len(languages), 1), part):
        names = languages[first : first + part]
        logs = []
        # at most a row for each trigram and language of the part reaches the driver
        rows = counted.where(F.col("lang").isin(names)).toPandas() if names else None
        for name in names:
            own = rows[rows.lang == name]
            c = np.zeros(SIZE**3)
            c[own.trigram.to_numpy(int)] = own.n.to_numpy(float)
            c = c.reshape(SIZE, SIZE, SIZE)
            two = c.sum(0)
            p2 = (two + 20 * single) / (two.sum(1, keepdims=True) + 20)
            logs.append(np.log((c + 5 * p2) / (c.sum(2, keepdims=True) + 5)).ravel().astype(np.float32))
        if first + part >= len(languages):
            names, logs = [*names, UNKNOWN], [*logs, shuffled]
        models.append(TextModel(tuple(names), np.array(logs, np.float32)))
    return models


def _shares(counts: Column, size: int, towards: Column, weight: float) -> Column:
    """(n + weight * towards) / (sum + weight) for each language, from a map of counts by place."""
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, x: s + x) + weight
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.coalesce(F.try_element_at(counts, k), F.lit(0.0)) + weight * towards[k]) / total)


def identify(rows: DataFrame, models: list[TextModel], keep: list[str], scratch: Scratch, host_weight: float = 20.0, suffix_weight: float = 50.0) -> DataFrame:
    """rows (text, declared, host, suffix) and the columns `keep`: adds language, confidence, text_language."""
    spark = rows.sparkSession
    names = [x for m in models for x in m.languages]
    renamed = [f"keep_{i}" for i in range(len(keep))]
    text = rows.select(
        *[F.col(f"`{c}`").alias(r) for c, r in zip(keep, renamed)], code("declared").alias("declared"),
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"), F.array().cast("array<double>").alias("ll"), "text",
    )
    for i, model in enumerate(models):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=i == len(models) - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, len(batch), 256):
                    part = batch.slice(first, 256)
                    found = shared.value.evidence([t or "" for t in part.column("text").to_pylist()])
                    ll = [before + own for before, own in zip(part.column("ll").to_pylist(), found.tolist())]
                    columns = [*part.columns[:-2], pa.array(ll, pa.list_(pa.float64())), *part.columns[-1:]]
                    yield pa.RecordBatch.from_arrays(columns[:-1] if last else columns, part.schema.names[:-1] if last else part.schema.names)

        out = text.schema.fields[:-1] if i == len(models) - 1 else text.schema.fields
        text = text.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out))
    # rows without text evidence vote for nothing
    text = scratch.keep(text.withColumn("top", F.when(F.array_max("ll") < 0, F.array_position("ll", F.array_max("ll")).cast("int") - 1)))
    votes = scratch.keep(text.groupBy("suffix", "host", "declared", "top").agg(F.count("*").cast("double").alias("n")))

    def counts(*by: str) -> DataFrame:
        """A map from place to votes for each of `by`, with an entry a language at most."""
        summed = votes.where("top is not null").groupBy(*by, "top").agg(F.sum("n").alias("n"))
        lists = summed.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("top", "n"))).alias("votes"))
        return votes.select(*by).distinct().join(lists, list(by), "left").select(*by, F.coalesce("votes", F.create_map().cast("map<int,double>")).alias("votes"))

    overall = {r.top: r.n for r in votes.where("top is not null").groupBy("top").agg(F.sum("n").alias("n")).collect()}
    totals = [overall.get(k, 0.0) for k in range(len(names))]
    share = F.array(*[F.lit((g + 1 / len(names)) / (sum(totals) + 1)) for g in totals])
    suffixes = counts("suffix").select("suffix", _shares(F.col("votes"), len(names), share, suffix_weight).alias("p"))
    priors = counts("suffix", "host").join(suffixes, "suffix").select("suffix", "host", F.transform(_shares(F.col("votes"), len(names), F.col("p"), host_weight), lambda x: F.log(x)).alias("prior"))
    declared = counts("declared").where("declared <> ''")
    kinds_declared = votes.where("declared <> ''").select("declared").distinct().count() or 1
    # P(declaration | language): a language's own declarations and one of each kind more
    spoken = F.array(*[F.lit(float(g) + kinds_declared) for g in totals])
    declared = declared.select("declared", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.log((F.coalesce(F.try_element_at("votes", k), F.lit(0.0)) + 1.0) / spoken[k])).alias("said"))
    nothing = F.array_repeat(F.lit(0.0), len(names))
    fused = (
        text.join(priors, ["suffix", "host"]).join(declared, "declared", "left")
        .withColumn("post", F.zip_with(F.zip_with("ll", "prior", lambda a, b: a + b), F.coalesce("said", nothing), lambda a, b: a + b))
    )
    best = F.array_max("post")
    language = F.array(*map(F.lit, names))
    return fused.select(
        *[F.col(r).alias(c) for c, r in zip(keep, renamed)],
        F.element_at(language, F.array_position("post", best).cast("int")).alias("language"),
        (1 / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("post")))).alias("confidence"),
        F.when(F.col("top").isNotNull(), F.element_at(language, F.col("top") + 1)).alias("text_language"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """text, declared, host and suffix of pages (url, html)."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[#\w]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select(
        "*", text.alias("text"), F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)).alias("declared"),
        host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
    )


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "language")
    models = fit_text_model(table(spark, sf_dir, "documents"), scratch)
    pages = page_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = identify(pages, models, ["page_id", "declared", "host", "suffix"], scratch)
    return found.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", F.col("declared").alias("declared_language"), "host", "suffix")


QUERIES = {"op5_language_fusion": op5_language_fusion}
