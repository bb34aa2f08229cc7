"""Benchmark decontamination by greedy string tiling.

Words in lower case without surrounding marks are tokens. Seeds, runs of `min_tile` tokens that a document
shares with a benchmark item, are counted first by their places in the item: fewer than could cover `coverage`
of it, had they no token in common, drop the pair. A pair goes on only if the shared runs do cover as much,
which bounds what tiles can. Tiling then marks the longest matches of unmarked tokens again and
again, found by running Karp-Rabin hashes of falling length, so passages in another order count in full.
A pair is reported if tiles cover at least `coverage` of the item's tokens.

The benchmark is broadcast in parts of bounded size, `part_bytes` of text each, cut by a hash of its rows;
a larger benchmark makes more passes over the documents instead of a larger broadcast. Documents are
neither shuffled nor sampled, and each whole text is searched.

Defined cases: null and empty texts have no tokens and no pairs; an item of fewer tokens than a
seed has one seed, its whole self; ties between matches go to the earlier place in the item, then in the
document; repeated rows of documents are reported each, repeated benchmark rows once; null ids are carried
through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.shared import table

EDGES = ".,;:?!\"'`()[]{}<>«»“”‘’…|*#%$&-–—_=+~/\\"
BASE = np.uint64(0x9E3779B97F4A7C15)
PAIRS = "doc_id long, item_id long, coverage double, matched_tokens long, item_tokens long, tiles array<struct<item_start:int,doc_start:int,length:int>>"


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of this width; unsigned arithmetic wraps."""
    n = len(tokens) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        out = out * BASE + tokens[i : i + n].astype(np.uint64)
    return out ^ (out >> np.uint64(31))


def tiles_of(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiling (item start, document start, length); negative document tokens match nothing."""
    free_i, free_d = np.ones(len(item), bool), doc >= 0
    out: list[tuple[int, int, int]] = []
    width = max(min_tile, min(20, len(item)))
    while True:
        matches = []
        longest = 0
        if len(item) >= width <= len(doc):
            open_i = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(free_i, width).all(1))
            open_d = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(free_d, width).all(1))
            at: dict[int, list[int]] = {}
            for p, h in zip(open_d.tolist(), window_hashes(doc, width)[open_d].tolist()):
                at.setdefault(h, []).append(p)
            for p, h in zip(open_i.tolist(), window_hashes(item, width)[open_i].tolist()):
                for q in at.get(h, ()):
                    n = 0
                    while p + n < len(item) and q + n < len(doc) and free_i[p + n] and free_d[q + n] and item[p + n] == doc[q + n]:
                        n += 1
                    if n >= width:
                        matches.append((-n, p, q))
                        longest = max(longest, n)
        if longest > 2 * width:
            width = longest
            continue
        for n, p, q in sorted(matches):
            if free_i[p : p - n].all() and free_d[q : q - n].all():
                free_i[p : p - n] = free_d[q : q - n] = False
                out.append((p, q, -n))
        if matches and width > min_tile:
            # shorter remains of occluded matches are found at the widths below
            width = max(min_tile, width - 1)
        elif width > 2 * min_tile:
            width //= 2
        elif width > min_tile:
            width = min_tile
        elif not matches:
            return sorted(out)


class Benchmark:
    """Tokens and seeds of one part of the benchmark."""

    def __init__(self, rows: list[tuple], min_tile: int, coverage: float):
        self.words, self.known = {}, {}
        self.ids, self.items = [], []
        for item_id, text in rows:
            words = [w for t in (text or "").lower().split() if (w := t.strip(EDGES))]
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int64))
        self.width = [min(min_tile, len(x)) for x in self.items]
        #: places of seeds that a pair has to share at least
        self.least = np.array([np.ceil((coverage * len(x) - 1e-9) / w) for x, w in zip(self.items, self.width)])
        self.by_width = {}
        for width in sorted(set(self.width)):
            hashes = [window_hashes(x, width) for x, w in zip(self.items, self.width) if w == width]
            owners = np.repeat([i for i, w in enumerate(self.width) if w == width], list(map(len, hashes)))
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.by_width[width] = flat[order], owners[order]

    def token(self, raw: str) -> int:
        """-2: no word, -1: a word of no item."""
        found = self.known.get(raw)
        if found is None:
            word = raw.strip(EDGES)
            found = self.words.get(word, -1) if word else -2
            if len(self.known) > 150_000:
                self.known.clear()
            self.known[raw] = found
        return found

    def candidates(self, tokens: np.ndarray, docs: np.ndarray, most: int = 1 << 21) -> list[tuple[int, int]]:
        """(document, item) pairs that share enough seeds; documents lie one after another, parted by -1. At most about `most` places are held at once."""
        out: list[tuple[int, int]] = []
        for width, (seeds, owners) in self.by_width.items():
            if len(tokens) < width:
                continue
            at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(tokens >= 0, width).all(1))
            h = window_hashes(tokens, width)[at]
            low, high = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            # a seed counts once a document
            d, low, high = np.unique(np.stack([docs[at[hit]], low[hit], high[hit]], 1), axis=0).T
            sizes = high - low
            heads = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            for first, last in zip(heads.tolist(), [*heads[1:].tolist(), len(d)]):
                counts, start = np.zeros(len(self.items), np.int64), first
                reached = np.cumsum(sizes[first:last])
                while start < last:
                    before = int(reached[start - first - 1]) if start > first else 0
                    stop = max(start + 1, first + int(np.searchsorted(reached, before + most, "right")))
                    n = sizes[start:stop]
                    places = np.repeat(low[start:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    counts += np.bincount(owners[places], minlength=len(self.items))
                    start = stop
                out += [(int(d[first]), i) for i in np.flatnonzero((counts > 0) & (counts >= self.least)).tolist()]
        return out

    def tile(self, i: int, doc: np.ndarray, coverage: float) -> list[tuple[int, int, int]] | None:
        """Tiles of item i in a document, None if shared runs can't cover enough."""
        item, width = self.items[i], self.width[i]
        usable = np.isin(doc, item)
        whole = np.lib.stride_tricks.sliding_window_view(usable, width).all(1) if len(doc) >= width else np.zeros(0, bool)
        near = np.zeros(len(doc) + 1, int)
        starts = np.flatnonzero(whole)
        np.add.at(near, starts, 1)
        np.add.at(near, starts + width, -1)
        keep = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        if not len(keep):
            return None
        # runs that could match, parted by a token that matches nothing
        gaps = np.flatnonzero(np.diff(keep) > 1) + 1
        short = np.insert(doc[keep], gaps, -1)
        places = np.insert(keep, gaps, -1)
        shared = np.isin(window_hashes(item, width), window_hashes(short, width))
        bound = np.zeros(len(item) + 1, int)
        np.add.at(bound, np.flatnonzero(shared), 1)
        np.add.at(bound, np.flatnonzero(shared) + width, -1)
        if (np.cumsum(bound)[:-1] > 0).sum() < coverage * len(item):
            return None
        return [(p, int(places[q]), n) for p, q, n in tiles_of(item, short, width)]


def find_leaks(documents: DataFrame, benchmark: DataFrame, min_tile: int = 3, coverage: float = 0.8, part_bytes: int = 4 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of documents (doc_id, text) and benchmark items (item_id, text) in columns PAIRS, and the documents' columns of longs to carry."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // part_bytes) or 1
    names = [x.split()[0] for x in PAIRS.partition(", tiles")[0].split(", ")] + ["tiles", *carry]
    tile_type = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), tile_type, *[pa.int64()] * len(carry)]
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    schema = PAIRS + "".join(f", {c} long" for c in carry)
    out = None
    for part in range(parts):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()]
        shared = spark.sparkContext.broadcast(Benchmark(rows, min_tile, coverage))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in batches:
                for first in range(0, len(batch), 512):
                    ids = batch.column(0).slice(first, 512).to_pylist()
                    more = [batch.column(c).slice(first, 512).to_pylist() for c in carry]
                    tokens = []
                    for text in batch.column(1).slice(first, 512).to_pylist():
                        found = np.array([bench.token(t) for t in (text or "").lower().split()], np.int64)
                        tokens.append(np.append(found[found != -2], -1))
                    owner = np.repeat(np.arange(len(tokens)), list(map(len, tokens)))
                    held = []
                    for d, i in sorted(bench.candidates(np.concatenate(tokens), owner)):
                        tiles = bench.tile(i, tokens[d], coverage)
                        covered = sum(t[2] for t in tiles or ())
                        if tiles and covered >= coverage * len(bench.items[i]):
                            held.append((ids[d], bench.ids[i], covered / len(bench.items[i]), covered, len(bench.items[i]), [dict(zip(("item_start", "doc_start", "length"), t)) for t in tiles], *(m[d] for m in more)))
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

        own = source.mapInArrow(run, schema)
        out = own if out is None else out.union(own)
    return out


def op10_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_greedy_string_tiling": op10_greedy_string_tiling}
