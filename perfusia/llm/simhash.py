"""SimHash near-duplicates by segment popcounts.

A fingerprint's segments are mapped to their numbers of set bits. Manhattan distance between these
vectors is at most the Hamming distance, so fingerprints within two bits lie within distance two on the
integer grid, and then some grid cell lies within one of both. Each distinct fingerprint goes to its own
cell and those one step away; fingerprints that meet in a cell are compared exactly. A crowded cell is
split by a finer grid: with segments of one bit the cells are the fingerprints one flip away, and all that
meet in one are within two bits, so a star links them. No cell is compared whole beyond `crowded` members
and none is left out. Links are of distinct fingerprints; copies share one.

Defined cases: null and empty texts, and texts of white space, have fingerprint 0 and are linked like
others; texts of fewer words than a shingle are one shingle; repeated rows share a fingerprint; a null
doc_id is ignored as a component's name, and a component of null doc_ids only has a null name; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.shared import Scratch, components, table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A grid cell within one step of either end lies between any two vectors at this Manhattan distance or less.
REACH = 2


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles in parts of bounded size; none without words."""
    words = text.translate(LOWER).split()  # bytes.split() parts at \x20 and \x09-\x0d
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    starts, ends = starts.tolist(), ends.tolist()
    for first in range(0, len(starts), 1 << 14):
        yield np.array([hashed(line[a:b], seed) for a, b in zip(starts[first : first + (1 << 14)], ends[first : first + (1 << 14)])], "<u8")


def majority(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of shingle hashes: bits set in more than half of them."""
    votes, n = np.zeros(64, np.int64), 0
    for h in parts:
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, width, seed))


def fingerprints(documents: DataFrame, width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of longs to carry, and the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or b"", width) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], "fp"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *carry, "fp")))


def segment_cells(prints: np.ndarray, segments: int) -> np.ndarray:
    """For each fingerprint, the cell of its segment popcounts and all cells one step away."""
    bits = 64 // segments
    if bits == 1:
        return np.column_stack([prints, *(prints ^ np.uint64(1 << i) for i in range(64))])
    digit = (bits + 2).bit_length()  # holds counts from -1 to bits + 1, moved up by one
    own = np.zeros(len(prints), np.uint64)
    for i in range(segments):
        part = prints >> np.uint64(bits * i) & np.uint64((1 << bits) - 1)
        own += (np.bitwise_count(part).astype(np.uint64) + np.uint64(1)) << np.uint64(digit * i)
    steps = [np.uint64(1 << digit * i) for i in range(segments)]
    return np.column_stack([own, *(own + s for s in steps), *(own - s for s in steps)])


def _cells(distinct: DataFrame, segments: int) -> DataFrame:
    """(cell, fp) for each cell that a fingerprint goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            cells = segment_cells(prints.view(np.uint64), segments).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(prints, cells.shape[1]))], ["cell", "fp"])

    return distinct.select("fp").mapInArrow(run, "cell long, fp long")


def links(distinct: DataFrame, scratch: Scratch, segments: int = 16, crowded: int = 128) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints (fp) within REACH bits."""
    cells = _cells(distinct, segments)
    many = cells.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    # Spark sizes both by the fingerprints that they come from, at a sixteenth of what they are, and would broadcast them
    met = scratch.keep(cells.join(many.hint("merge"), "cell"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                x = np.unique(members.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= REACH, 1))
                root = list(range(len(x)))  # a spanning forest of the cell's links is enough

                def top(k: int) -> int:
                    while root[k] != k:
                        root[k] = root[root[k]]
                        k = root[k]
                    return k

                for p, q in zip(i.tolist(), j.tolist()):
                    if (r := top(p)) != (s := top(q)):
                        root[s] = r
                        a.append(x[p])
                        b.append(x[q])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64), pa.int64()) for v in (a, b)], ["a", "b"])

    compared = met.where(F.col("members") <= crowded).groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(verify, "a long, b long")
    flips = _cells(met.where(F.col("members") > crowded).select("fp").distinct(), 64)
    hubs = flips.groupBy("cell").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # at most 65 in a cell
    return compared.union(hubs.select("a", F.explode("fps").alias("b")).where("a <> b")).distinct()


def near_duplicates(documents: DataFrame, width: int = 3, segments: int = 16, crowded: int = 128, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of longs to carry, fp, component (the least fp linked) and component_id, the smallest doc_id of those linked."""
    scratch = Scratch(documents.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(documents, width, carry))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = components(links(distinct.select("fp"), scratch, segments, crowded), scratch)
    named = scratch.keep(distinct.join(grouped.hint("merge"), distinct.fp == grouped.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(names.hint("merge"), "component").select("fp", "component", "component_id").hint("merge"), "fp").select("doc_id", *carry, "fp", "component", "component_id")


def op7_simhash_popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_popcounts": op7_simhash_popcounts}
