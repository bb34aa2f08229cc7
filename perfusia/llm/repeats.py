"""Long repeated passages by run-length indexes.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else. Every window of
that length is dealt to the group named by the least hash of its `anchor` byte strings, so equal windows
meet in one group, and a passage is a run of windows of one group. Groups met once are done. Passages that
are equal throughout need no text. The other passages, one of each kind, go to tasks that index some
megabytes of whole groups: a run-compressed Burrows-Wheeler transform with the suffixes at run ends
sampled. Common prefixes with the neighbours in suffix order are computed at run ends only and streamed
from there, since within a run each is one less than that of the position before; where the longer of the
two reaches `length` a window is marked. A group of over `hot_bytes` is dealt again by longer anchors, at
last by whole windows, which counting settles; so no task gets an unbounded group and none is dropped.

Defined cases: a null text is empty bytes; texts shorter than `length` keep everything; repeated rows and
equal texts under other ids repeat each other; a null doc_id is carried through; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.shared import Scratch, table

CHUNK = 1 << 22  # bytes of a text whose anchors are found at once
#: Words of a passage of over 50; bytes of a window that finds them: 99.9 % of the runs of 51 words in the given documents have as many.
OVER_WORDS, PASSAGE, PASSAGE_ANCHORS = 51, 200, (64, 168, 192, 198)
BATCH = 1 << 18  # bytes of texts that are worked on together, a longer one apart
PASSAGES = "doc_id long, tkey long, start long, stop long, h long, d long, self boolean"


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-byte string, by doubling along the bits of k."""
    odd, mix = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
    n = len(data) - k + 1
    power, size, done, out = (data.astype(np.uint64) + np.uint64(1)) * mix, 1, 0, None
    while True:
        if k & size:
            part = power[done : done + n]
            out = part.copy() if out is None else out * odd + part
            done += size
        if size * 2 > k:
            break
        left, right = power[:-size], power[size:]
        power = (left * (odd + np.uint64(2 * size))) ^ (right + (right >> np.uint64(29)))
        size *= 2
    out ^= out >> np.uint64(32)
    out *= mix
    return out ^ (out >> np.uint64(29))


def least_of_windows(values: np.ndarray, w: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = values
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        odd = 0x9E3779B97F4A7C15
        for i, x in enumerate((odd, pow(odd, -1, 1 << 64))):
            steps = np.full(1 << (n - 1).bit_length(), x, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return [x[:n] for x in _POWERS]


def passages_of(texts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, start, stop, h, d, self) of the passages of texts; self: a window may recur within the passage. Texts lie one after another, so that all are worked on at once."""
    w, sizes = length - anchor + 1, np.array(list(map(len, texts)))
    last = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, bool),)
    grams = gram_hashes(data, anchor)
    least = least_of_windows(grams, w) if w > 1 else grams
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:n] == owner[length - 1 :]  # no window crosses texts
    new = np.append(True, (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1])) if w > 1 else np.ones(n, bool)
    new |= np.append(True, ~inside[:-1])
    heads = np.flatnonzero(new & inside)
    stops = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
    names = least[heads]
    # a digest of a passage's strings of anchor length, by sums of their hashes times powers
    up, down = powers(len(grams) + 1)
    sums = np.append(np.uint64(0), np.cumsum(grams * up[:-1], dtype=np.uint64))
    d = (sums[stops + w - 1] - sums[heads]) * down[heads]
    d ^= d >> np.uint64(32)
    d *= np.uint64(0xD6E8FEB86659FD93)
    again = np.zeros(len(heads), bool)
    if w > 1:
        spans = stops + w - 1 - heads
        for first in range(0, len(heads), 1 << 12):
            part = slice(first, first + (1 << 12))
            ends = np.cumsum(spans[part])
            at = np.arange(ends[-1]) + np.repeat(heads[part] - ends + spans[part], spans[part])
            again[part] = np.add.reduceat((grams[at] == np.repeat(names[part], spans[part])).astype(np.int64), ends - spans[part]) > 1
    base = (last - sizes)[owner[heads]]
    return owner[heads], heads - base, stops + length - 1 - base, names.view(np.int64), d.view(np.int64), again


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, by place where they are equal, and the keys in order; one sort of numbers holds both if the bits suffice."""
    place = (len(key) - 1).bit_length()
    if bits + place > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key << np.uint64(place) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << place) - 1)).astype(np.int64), both >> np.uint64(place)


def suffix_order(letters: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by prefix doubling, and the ranks of each doubling for common-prefix queries. Letter 0 ends a passage: each is unlike all others, an earlier one less.

    A rank is the first place of those of equal strings, so that each doubling sorts only those that are still equal to others.
    """
    n = len(letters)
    width = max(1, int(letters.max()).bit_length())
    fit = max(1, (64 - (n - 1).bit_length()) // width)
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(fit):
        ahead = np.append(letters[i:], np.zeros(min(i, n), letters.dtype))[:n].astype(np.uint64)
        key = key << np.uint64(width) | ahead * open_
        open_ &= ahead > 0
    order, found = _sorted(key, fit * width)
    # strings that reach the end of a passage differ, and places order them
    new = np.append(True, (found[1:] != found[:-1]) | ~open_[order[1:]])
    places, size, levels, rank, bits = np.arange(n), fit, [], np.empty(n, np.int32), n.bit_length()
    while True:
        rank[order[places]] = np.maximum.accumulate(np.where(new, places, 0))
        levels.append((size, rank.copy()))
        alone = new & np.append(new[1:], True)
        places = places[~alone]
        if not len(places):
            return order, levels
        own = order[places]
        behind = own + size
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by, found = _sorted(rank[own].astype(np.uint64) << np.uint64(bits) | second.astype(np.uint64), 2 * bits)
        order[places] = own[by]
        new = np.append(True, found[1:] != found[:-1])
        size *= 2


def common_prefix(a: np.ndarray, b: np.ndarray, symbols: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    n, out = len(symbols), np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        padded = np.append(rank, [-1])
        x, y = np.minimum(a + out, n), np.minimum(b + out, n)
        same = (padded[x] == padded[y]) & (x < n) & (y < n)
        out += np.where(same, size, 0)
    padded = np.append(symbols, [-1])
    for _ in range(levels[0][0]):
        x, y = np.minimum(a + out, n), np.minimum(b + out, n)
        out += (padded[x] == padded[y]) & (x < n) & (y < n)
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of passages with the suffixes at its run ends sampled."""

    def __init__(self, passages: list[bytes]):
        marks, sizes = len(passages), np.array([len(p) + 1 for p in passages])
        self.starts = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"\0".join([*passages, b""]), np.uint8)
        ends = self.starts + sizes - 1
        letters = (np.cumsum(np.bincount(text, minlength=256) > 0).astype(np.uint16))[text]
        letters[ends] = 0
        self.symbols = text.astype(np.int32) + marks
        self.symbols[ends] = np.arange(marks)
        order, levels = suffix_order(letters)
        before = self.symbols[order - 1]  # each mark is unlike all else, so its rows are runs of their own
        edge = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_symbols = before[np.append(0, edge)]
        self.run_lengths = np.diff(np.concatenate([[0], edge, [len(before)]]))
        self.run_heads, self.run_tails = order[np.append(0, edge)], order[np.append(edge - 1, len(order) - 1)]
        # neighbours across a border between runs: the head of one, the tail of the one before
        self.border = common_prefix(self.run_heads[1:], self.run_tails[:-1], self.symbols, levels)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match with a suffix that starts elsewhere, streamed from run ends."""
        n = len(self.symbols)
        reach = np.zeros((2, n), np.int64)
        reach[0, self.run_heads[1:]] = self.run_heads[1:] + self.border
        reach[1, self.run_tails[:-1]] = self.run_tails[:-1] + self.border
        return np.maximum(np.maximum.accumulate(reach.max(0)) - np.arange(n), 0)


def repeated_spans(passages: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each passage, spans covered by strings of this length that start twice among the passages."""
    index = RunLengthIndex(passages)
    far = index.matching_statistics() >= length
    # windows that recur, in runs: a gap of more than a window or a new passage starts a span
    hit = np.flatnonzero(far)
    of = np.searchsorted(index.starts, hit, "right") - 1
    cut = np.flatnonzero((np.diff(hit) > length) | (np.diff(of) > 0)) + 1
    first, last = (hit[np.append(0, cut)], hit[np.append(cut, len(hit)) - 1] + length) if len(hit) else (hit, hit)
    out: list[list[tuple[int, int]]] = [[] for _ in passages]
    for i, x, y in zip(of[np.append(0, cut)].tolist() if len(hit) else [], first.tolist(), last.tolist()):
        base = int(index.starts[i])
        out[i].append((x - base, y - base))
    return out


def _emit(pieces: DataFrame, length: int, anchor: int) -> DataFrame:
    names = [x.split()[0] for x in PASSAGES.split(", ")]

    def found(ids: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
        at, start, stop, h, d, again = passages_of(texts, length, anchor)
        doc_id, tkey, base = np.array(ids, np.int64).reshape(-1, 3).T
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc_id[at], tkey[at], base[at] + start, base[at] + stop, h, d, again)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, tkey, base, text in zip(*(c.to_pylist() if i < 3 else c for i, c in enumerate(batch.columns))):
                raw = text.as_py()
                for first in range(0, max(1, len(raw) - length + 1), CHUNK):
                    ids.append((doc_id, tkey, base + first))
                    texts.append(raw[first : first + CHUNK + length - 1])
                    size += len(texts[-1])
                    if size >= BATCH:
                        yield found(ids, texts)
                        ids, texts, size = [], [], 0
            if ids:
                yield found(ids, texts)

    return pieces.where(F.octet_length("text") >= length).select("doc_id", "tkey", "base", "text").mapInArrow(run, PASSAGES)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tkey", "base", "h", "hot", "needed", "text"]
    for batch in batches:
        rows = []
        for doc_id, tkey, base, text, asked in zip(*(c.to_pylist() if i != 3 else c for i, c in enumerate(batch.columns))):
            raw = text.as_py()
            rows += [(doc_id, tkey, x["start"], x["h"], x["hot"], x["needed"], raw[x["start"] - base : x["stop"] - base]) for x in asked]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def _level(pieces: DataFrame, scratch: Scratch, length: int, anchor: int, hot_bytes: int, block_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Spans (doc_id, tkey, start, stop) settled with this anchor, and the pieces left for a longer one."""
    all_of = scratch.keep(_emit(pieces, length, anchor))
    met = all_of.groupBy("h").agg(F.count("*").alias("n"), F.max("self").alias("any_self")).where("n > 1 or any_self")
    found = scratch.keep(all_of.join(met, "h"))
    scratch.drop(all_of)
    kinds = scratch.keep(
        found.withColumn("size", F.col("stop") - F.col("start")).groupBy("h", "d", "size")
        .agg(F.count("*").alias("copies"), F.max("self").alias("self"), F.min(F.struct("doc_id", "tkey", "start", "stop")).alias("one"))
    )
    spans = found.join(kinds.where("copies > 1").select("h", "d", "size"), ["h", "d"]).where("size = stop - start").select("doc_id", "tkey", "start", "stop")
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("self").alias("any_self"), F.sum("size").alias("bytes")).where("kinds > 1 or any_self")
    asked = (
        kinds.join(groups.select("h", "kinds", (F.col("bytes") > hot_bytes).alias("hot")), "h")
        .where("kinds > 1 or self")
        .select("one.*", "h", "hot", (F.col("copies") == 1).alias("needed"))
        .groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "stop", "h", "hot", "needed")).alias("asked"))
    )
    # a piece holds those passages that lie in it; a document is one piece
    at = pieces.join(asked, ["doc_id", "tkey"]).select(
        "doc_id", "tkey", "base", "text", F.filter("asked", lambda x: (x["start"] >= F.col("base")) & (x["stop"] <= F.col("base") + F.octet_length("text"))).alias("asked")
    ).where("size(asked) > 0")
    texts = scratch.keep(at.mapInArrow(_slices, "doc_id long, tkey long, base long, h long, hot boolean, needed boolean, text binary").dropDuplicates(["doc_id", "tkey", "base", "h"]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def mark() -> pa.RecordBatch:
            marked = [
                (doc_id, tkey, base + a, base + b)
                for (doc_id, tkey, base, needed, _), own in zip(held, repeated_spans([x[4] for x in held], length))
                if needed
                for a, b in own
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*marked) if marked else ([],) * 4)], ["doc_id", "tkey", "start", "stop"])

        for batch in batches:
            for doc_id, tkey, base, h, needed, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= block_bytes and h != last:
                    yield mark()
                    held, size = [], 0
                held.append((doc_id, tkey, base, needed, text))
                size, last = size + len(text), h
        if held:
            yield mark()

    indexed = texts.where("not hot").select("doc_id", "tkey", "base", "h", "needed", "text").repartition("h").sortWithinPartitions("h")
    spans = spans.union(indexed.mapInArrow(index, "doc_id long, tkey long, start long, stop long"))
    hot = texts.where("hot").select("doc_id", "tkey", "base", "text")
    return scratch.keep(spans), hot if hot.limit(1).count() else None


def _spans(pieces: DataFrame, scratch: Scratch, length: int, anchors: tuple[int, ...], hot_bytes: int, block_bytes: int) -> DataFrame:
    """Spans (doc_id, tkey, start, stop) covered by strings of this length that recur among the pieces."""
    spans = None
    for anchor in (*anchors, length):
        own, pieces = _level(pieces, scratch, length, anchor, hot_bytes, block_bytes)
        spans = own if spans is None else spans.union(own)
        if pieces is None:
            break
    return spans.distinct()


def _listed(spans: DataFrame, least: int, name: str) -> DataFrame:
    """doc_id, tkey and the merged spans of `least` bytes or more, in order, of documents that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "stop": b} for a, b in merged(x) if b - a >= least] for x in batch.column(2).to_pylist()]
            full = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["doc_id", "tkey", name])
            yield full.filter(pa.array([bool(x) for x in found], pa.bool_()))

    lists = spans.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return lists.mapInArrow(run, f"doc_id long, tkey long, {name} array<struct<start:bigint,stop:bigint>>")


def _regions(rows: DataFrame) -> DataFrame:
    """Pieces of the texts (doc_id, tkey, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (doc_id, tkey, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
                raw = batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((doc_id, tkey, x["start"], raw[x["start"] : x["stop"]]) for x in spans)), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "tkey", "base", "text"])

    return rows.mapInArrow(run, "doc_id long, tkey long, base long, text binary")


def repeats(
    documents: DataFrame, length: int = 400, anchors: tuple[int, ...] = (128, 336, 384, 396), hot_bytes: int = 5 << 18, block_bytes: int = 1 << 19, carry: list[str] | tuple[str, ...] = (), once: bool = False,
    finer: int = 0, finer_anchors: tuple[int, ...] = (),
) -> DataFrame:
    """doc_id, bytes (the text's), spans (start, stop) to remove, in order, and other columns to carry.

    once: rows of equal doc_id and text are one document, which doesn't repeat itself by that. finer: strings of so many bytes that recur
    give the column finer_spans; those of `length` are then looked for only where these cover as much, as nowhere else one can recur.
    """
    scratch = Scratch(documents.sparkSession, "repeats")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("more"))
    rows = rows.withColumn("tkey", F.xxhash64("text"))
    # joins are on ids without nulls: a null doc_id goes under a number of its own
    none = F.lit(-(1 << 63)).cast("long")
    pieces = rows.select(F.coalesce("doc_id", none).alias("doc_id"), "tkey", F.lit(0).cast("long").alias("base"), "text")
    if once:
        several = scratch.keep(pieces.groupBy("doc_id", "tkey").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "tkey"))
        pieces = pieces.join(several, ["doc_id", "tkey"], "left_anti").union(pieces.join(several, ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"]))
        pieces = pieces.select("doc_id", "tkey", "base", "text")
    if finer:
        short = scratch.keep(_spans(pieces, scratch, finer, finer_anchors, hot_bytes, block_bytes))
        regions = scratch.keep(_listed(short, length, "spans"))
        pieces = scratch.keep(_regions(pieces.join(regions, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "spans")))
    listed = _listed(_spans(pieces, scratch, length, anchors, hot_bytes, block_bytes), 0, "spans")
    if finer:
        listed = _listed(short, 0, "finer_spans").join(scratch.keep(listed), ["doc_id", "tkey"], "left")
    joined = rows.withColumn("id", F.coalesce("doc_id", none)).alias("a").join(listed.alias("b"), (F.col("a.id") == F.col("b.doc_id")) & (F.col("a.tkey") == F.col("b.tkey")), "left")
    found = [F.col(f"b.{x}").alias(x) for x in ("spans", *["finer_spans"] * bool(finer))]
    return joined.select(F.col("a.doc_id").alias("doc_id"), F.col("a.text").alias("bytes"), *found, *[F.col("a.more")[f"c{i}"].alias(c) for i, c in enumerate(carry)])


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if out and s["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["stop"])
        else:
            out.append((s["start"], s["stop"]))
    return out


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the borders of UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def long_passages(raw: bytes, spans: list[dict] | None, least_words: int, long_bytes: int) -> list[tuple[int, int]]:
    """Merged spans of least_words words or more, parts of words counted, or of long_bytes bytes."""
    return [(a, b) for a, b in merged(spans) if b - a >= long_bytes or len(raw[a:b].split()) >= least_words]


def strip_repeats(documents: DataFrame, carry: list[str] | tuple[str, ...] = (), least_words: int = 0, long_bytes: int = 0, flag: str = "had_repeats", **options) -> DataFrame:
    """doc_id, text without repeated passages, cut at whole characters only, `flag`, whether there were any, and columns to carry; one row a document.

    Passages of fewer than least_words words stay unless they have long_bytes bytes. A column to carry may not be named as one of these three.
    """
    if taken := {"doc_id", "text", flag} & set(carry):
        raise ValueError(f"columns to carry have names of the result: {sorted(taken)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, had = [], []
            for raw, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = raw.as_py()
                spans = long_passages(raw, spans, least_words, long_bytes)
                texts.append(kept(raw, whole_characters(raw, spans)).decode("utf-8", "replace"))
                had.append(bool(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(had, pa.bool_()), *batch.columns[3:]], ["doc_id", "text", "had_repeats", *batch.schema.names[3:]])

    # carried columns go through Arrow under names of their own
    inner = {c: f"c{i}" for i, c in enumerate(carry)}
    found = repeats(documents.select("doc_id", "text", *[F.col(f"`{c}`").alias(i) for c, i in inner.items()]), carry=list(inner.values()), **options)
    kinds = "".join(f", {i} {documents.schema[c].dataType.simpleString()}" for c, i in inner.items())
    return found.mapInArrow(run, f"doc_id long, text string, had_repeats boolean{kinds}").select("doc_id", "text", F.col("had_repeats").alias(flag), *[F.col(i).alias(c) for c, i in inner.items()])


def op1_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what stays, by strings of 400 bytes, and the number and bytes of passages of over 50 words that recur, by strings of 200."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, spans, finer in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw, spans = raw.as_py(), merged(spans)
                passages = long_passages(raw, finer, OVER_WORDS, len(raw) + 1)
                rows.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(raw, spans)).hexdigest(), len(passages), sum(b - a for a, b in passages)))
            types = [pa.string() if i == 4 else pa.int64() for i in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"])

    found = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), finer=PASSAGE, finer_anchors=PASSAGE_ANCHORS)
    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")


QUERIES = {"op1_run_length_repeats": op1_run_length_repeats}
