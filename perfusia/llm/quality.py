"""Quality by compression: zstandard dictionaries of good and bad text, and a calibrated size difference.

Labelled good documents are dealt to a few groups, each with a dictionary of its own, and so are bad ones: a
document goes to the dictionary that packs it best, dictionaries are built anew, and so on for some rounds.
Each whole text is compressed in small blocks, so that dictionaries help throughout a long text, each block
with the good and with the bad dictionary that pack it best. The score is a logistic function of
(size with bad dictionaries - size with good) / (larger of the two) alone, fitted on labelled rows that trained
no dictionary. Labelled rows are a bounded sample: at most `per_class` rows of each label, those of least hash
of doc_id, of texts up to `max_train_bytes`. Everything else reads whole texts of all rows.

Defined cases: a null text is an empty text, which gets the score of difference 0; a null label trains
nothing; with fewer than 16 rows of either label the score is 0.5; dictionaries of equal size go by order; a null doc_id isn't held out; repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.shared import table


def fold(modulus: int, held_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held_out, F.lit(False))


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last: damped Newton steps on standardised features."""
    mean, scale = features.mean(0), np.maximum(features.std(0), 1e-9)
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])
    penalty = ridge * np.append(np.ones(features.shape[1]), 0)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - labels @ (x @ w) + penalty @ (w * w) / 2
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (labels - p) - penalty * w)
        rate = 1.0
        while rate > 1e-4 and loss(w + rate * step) > loss(w):
            rate /= 2
        w = w + rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


@dataclass(frozen=True)
class CompressionModel:
    good: tuple[bytes, ...]
    bad: tuple[bytes, ...]
    weights: tuple[float, ...]
    level: int = 3
    block_bytes: int = 512

    def sizes(self, texts: Iterable) -> np.ndarray:
        """Bytes, and compressed bytes with good and with bad dictionaries, of each text (a buffer or None)."""
        good, bad = ([_compressor(raw, self.level) for raw in side] for side in (self.good, self.bad))
        rows = []
        for text in texts:
            view = memoryview(text or b"")
            g = b = 0
            for i in range(0, len(view), self.block_bytes):
                block = view[i : i + self.block_bytes]
                g += min([len(c(block)) for c in good])
                b += min([len(c(block)) for c in bad])
            rows.append((len(view), g, b))
        return np.array(rows, float).reshape(-1, 3)

    def score(self, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([calibration_terms(sizes), np.ones(len(sizes))]) @ np.array(self.weights), -30, 30)))


def _compressor(raw: bytes, level: int):
    dictionary = zstandard.ZstdCompressionDict(raw)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_dict_id=False).compress


def difference(sizes: np.ndarray) -> np.ndarray:
    return (sizes[:, 2] - sizes[:, 1]) / np.maximum(np.maximum(sizes[:, 1], sizes[:, 2]), 1)


def calibration_terms(sizes: np.ndarray) -> np.ndarray:
    """The difference and its powers, so that the curve needn't be symmetric."""
    d = 10 * difference(sizes)
    return np.column_stack([d, d * d, d**3])


def _dictionary(texts: list[bytes], size: int, level: int, block: int, most: int) -> bytes:
    """A dictionary from blocks of texts, `most` of them, spread evenly; the texts themselves where there are too few or too like."""
    blocks = [t[i : i + block] for t in texts for i in range(0, len(t), block)]
    blocks = blocks[:: -(-len(blocks) // most)]
    try:
        return zstandard.train_dictionary(size, blocks, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[:size]


def dictionaries(texts: list[bytes], many: int, size: int, level: int, block: int, rounds: int = 3, most: int = 6000) -> tuple[bytes, ...]:
    """`many` dictionaries of texts, fewer if there are under 16 texts for each, grouped by which of them packs a text's first 4 KiB best."""
    many = max(1, min(many, len(texts) // 16))
    group = [i % many for i in range(len(texts))]
    found: list[bytes] = []
    for _ in range(rounds if many > 1 else 1):
        own = [[t for t, g in zip(texts, group) if g == k] for k in range(many)]
        found = [_dictionary(x if len(x) >= 8 else texts[k::many], size, level, block, most) for k, x in enumerate(own)]
        packers = [_compressor(raw, level) for raw in found]
        cost = [[sum(len(c(t[i : i + block])) for i in range(0, min(len(t), 4096), block)) for c in packers] for t in texts]
        group = [x.index(min(x)) for x in cost]
    return tuple(found)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 3000, max_train_bytes: int = 65536, dictionary_bytes: int = 112640, many: int = 6, block_bytes: int = 512, level: int = 3) -> CompressionModel | None:
    """labels (doc_id, quality). Rows of even hash rank train the dictionaries, the others the calibration."""
    texts = {}
    for label in (1, 0):
        ids = labels.where((F.col("quality") == label) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows = documents.select("doc_id", "text").where(F.octet_length("text").between(1, max_train_bytes)).join(F.broadcast(ids), "doc_id")
        texts[label] = [r.text.encode() for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text").limit(per_class).collect()]
    if min(map(len, texts.values())) < 16:
        return None
    good, bad = (dictionaries(texts[k][::2], many, dictionary_bytes, level, block_bytes) for k in (1, 0))
    model = CompressionModel(good, bad, (), level, block_bytes)
    rest = texts[1][1::2], texts[0][1::2]
    w = logistic(calibration_terms(model.sizes([*rest[0], *rest[1]])), np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])]))
    return replace(model, weights=tuple(map(float, w)))


def score(documents: DataFrame, model: CompressionModel | None) -> DataFrame:
    """documents' doc_id and its size difference and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = model.sizes(x.as_buffer() for x in batch.column(1)) if model else np.zeros((len(batch), 3))
            p = model.score(sizes) if model else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(difference(sizes)), pa.array(p)], ["doc_id", "difference", "score"])

    return documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, difference double, score double")


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels").where(~fold(3, 1)))
    return score(documents, model).select(
        "doc_id", fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op3_compression_quality": op3_compression_quality}
