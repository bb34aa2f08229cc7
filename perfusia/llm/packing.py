"""Cost-balanced packing of token sequences.

A document's tokens are those of its whole text and one end-of-document id. Attention over a sequence
costs `linear` a token and `quadratic` a squared piece length. Each task packs its own rows in blocks of
`block_tokens`: pieces of descending length go to the sequence of lowest cost that has room for them, the
first of equals; where none takes a piece whole, that of lowest cost takes what fits. A block's sequences are full but for its last tokens,
which fill sequences of descending powers of two, so nothing is padded. There is no shuffle, a task
holds one block, and a lost task is run again on the same rows.

Defined cases: a null or empty text is one end-of-document token; a null doc_id is carried through;
repeated rows are packed each; texts longer than a sequence are cut; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from perfusia.llm.shared import table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A single space between characters that aren't white space: the tokenizer never joins across it.
SEAM = re.compile(r"(?<=\S) (?=\S)")
#: A mark between a letter and white space is a token run of its own.
MARK = re.compile(r"[.,](?=[ \n])(?<=[^\W\d_].)")
#: What starts a key: a part of a text stands without a space before it, or came from a search for seams.
BARE, SOUGHT = "\x02", "\x03"


class CachedTokenizer:
    """Exact ids by `tokenizers`, asked once for each part of a text while the cache holds it."""

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        tokens = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(tokens.values()) + 1, bool)
        # byte-level merges see a space as this character
        self.spaced[[i for x, i in tokens.items() if x.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def parts(self, text: str) -> list[str]:
        """Keys of parts whose tokens, one after another, are the text's, unless a part is unsafe."""
        if not text:
            return []
        if BARE in text or SOUGHT in text:
            return [SOUGHT + text]
        return (BARE + MARK.sub(" \x02\\g<0>", text)).replace("\n", " \x02\n").split(" ")

    @staticmethod
    def unsafe(key: str) -> bool:
        """White space at an end may join with that of the next part."""
        raw = key[1:] if key[:1] == BARE else key
        return key[:1] != SOUGHT and (not raw or raw[-1].isspace() or raw[0].isspace() and raw is key)

    @staticmethod
    def sought(text: str) -> list[str]:
        first, *rest = SEAM.split(text)
        return [SOUGHT + first, *(f"{SOUGHT} {x}" for x in rest)]

    def ids_of(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys, one after another, and how many each has. Words of letters are encoded as one text, in which each starts at a token with a space in front."""
        words = [i for i, key in enumerate(keys) if key.isalpha()]
        others = [i for i, key in enumerate(keys) if not key.isalpha()]
        asked = [" " + " ".join([keys[i] for i in words])] if words else []
        asked += [keys[i][1:] if keys[i][:1] in (BARE, SOUGHT) else " " + keys[i] for i in others]
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)]
        starts = np.flatnonzero(self.spaced[found[0]]) if words else np.zeros(0, np.int64)
        if len(starts) != len(words):
            raise ArithmeticError(f"{len(words)} words were told apart as {len(starts)}")
        lengths = np.zeros(len(keys), np.int64)
        lengths[words] = np.diff(starts, append=len(found[0])) if words else 0
        lengths[others] = list(map(len, found[len(asked) - len(others) :]))
        # words and others stand in two runs; each key's ids are taken from where they are
        order = np.array(words + others, np.int64)
        first = np.zeros(len(keys), np.int64)
        first[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(found)[_runs(first, lengths)], lengths

    def places(self, keys: list[str]) -> np.ndarray:
        """The place of each key in starts and lengths, with those met first learned; the length of an unsafe one is -1."""
        base = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        new = [*islice(reversed(self.index), len(self.index) - base)][::-1]
        if new:
            safe = np.fromiter((not self.unsafe(key) for key in new), bool, len(new))
            lengths = np.full(len(new), -1, np.int64)
            if safe.any():
                ids, lengths[safe] = self.ids_of([*compress(new, safe)])
                self.pool = np.concatenate([self.pool, ids])
            taken = np.maximum(lengths, 0)
            self.starts = np.concatenate([self.starts, len(self.pool) - taken.sum() + np.cumsum(taken) - taken])
            self.lengths = np.concatenate([self.lengths, lengths])
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > self.most:
            self.clear()
        cut = [self.parts(t) for t in texts]
        at = self.places([*chain.from_iterable(cut)])
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        unsafe = self.lengths[at] < 0
        if unsafe.any():  # the texts that hold these are cut at seams instead
            own = np.split(at, np.cumsum(counts)[:-1])
            for i in np.unique(np.repeat(np.arange(len(cut)), counts)[unsafe]).tolist():
                own[i] = self.places(self.sought(texts[i]))
            counts, at = np.fromiter(map(len, own), np.int64, len(own)), np.concatenate(own)
        lengths = self.lengths[at]
        tokens = self.pool[_runs(self.starts[at], lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts])]
        return [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


_TOKENIZERS: dict[tuple[str, int], CachedTokenizer] = {}


def tokenizer(path: str, most: int) -> CachedTokenizer:
    """One a Python worker, kept from task to task."""
    if (path, most) not in _TOKENIZERS:
        _TOKENIZERS[path, most] = CachedTokenizer(path, most)
    return _TOKENIZERS[path, most]


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these token counts."""
    out, rest, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((-(n % capacity), doc, n - n % capacity))
    total = -sum(r[0] for r in rest)
    full = total // capacity
    used, costs = [0] * full, [0.0] * full
    # pieces come in descending length: a sequence without room waits by its room until they are short enough
    ready: list[tuple[float, int]] = [(0.0, i) for i in range(full)]
    waiting: list[list[int]] = [[] for _ in range(capacity)]
    least: list[tuple[float, int]] = []  # of those that wait; entries of others are passed over
    waits = [False] * full
    heapq.heapify(rest)
    free, wanted = full, capacity
    while free:
        size, doc, start = heapq.heappop(rest)
        size = -size
        for room in range(size, wanted):
            for i in waiting[room]:
                if waits[i] and capacity - used[i] == room:
                    waits[i] = False
                    heapq.heappush(ready, (costs[i], i))
            waiting[room] = []
        wanted = size
        if ready:
            _, i = heapq.heappop(ready)
        else:
            cost, i = heapq.heappop(least)
            while not waits[i] or cost != costs[i]:
                cost, i = heapq.heappop(least)
            waits[i] = False
        part = min(size, capacity - used[i])
        out.append((doc, start, part, sequence + i, used[i]))
        used[i] += part
        costs[i] += linear * part + quadratic * part * part
        room = capacity - used[i]
        if not room:
            free -= 1
        elif room >= size:
            heapq.heappush(ready, (costs[i], i))
        else:
            waits[i] = True
            waiting[room].append(i)
            heapq.heappush(least, (costs[i], i))
        if part < size:
            heapq.heappush(rest, (part - size, doc, start + part))
    sequence += full
    left, room, offset = total - full * capacity, 0, 0
    while rest:
        size, doc, start = heapq.heappop(rest)
        size = -size
        if offset == room:
            sequence, room, offset = sequence + (room > 0), 1 << (left.bit_length() - 1), 0
        part = min(size, room - offset)
        out.append((doc, start, part, sequence, offset))
        offset, left = offset + part, left - part
        if part < size:
            heapq.heappush(rest, (part - size, doc, start + part))
    return out


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, block_tokens: int = 1 << 22, linear: float = 1.0, quadratic: float = 1 / 2048, text_batch: int = 1 << 22, cached: int = 800_000, keep_cache: bool = True) -> DataFrame:
    """Pieces of documents (doc_id, text) in columns PIECES. cached: parts of texts whose ids a worker keeps; keep_cache: from task to task. A worker
    waits with what it keeps while other stages run."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(tokenizer_path, cached)
        base, sequences = TaskContext.get().partitionId() << 40, 0
        ids, tokens, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, tokens, held, sequences
            pieces = balance([len(t) for t in tokens], capacity, linear, quadratic)
            rows = [
                (ids[d], start, n, zlib.crc32(tokens[d][start : start + n].tobytes()), len(tokens[d]), base + sequences + s, offset)
                for d, start, n, s, offset in pieces
            ]
            sequences += max((p[3] for p in pieces), default=-1) + 1
            ids, tokens, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for batch in batches:
            keys, texts, size = batch.column(0).to_pylist(), batch.column(1), 0
            first = 0
            for i in range(len(keys)):
                size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                if size >= text_batch or i == len(keys) - 1:
                    for key, found in zip(keys[first : i + 1], coder.encode([t or "" for t in texts.slice(first, i + 1 - first).to_pylist()])):
                        ids.append(key)
                        tokens.append(np.append(found, end_id).astype("<u4"))
                        held += len(tokens[-1])
                    first, size = i + 1, 0
                    if held >= block_tokens:
                        yield flush()
        if ids:
            yield flush()
        if not keep_cache:
            coder.clear()

    return documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, PIECES)


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_cost_balanced_packing": op4_cost_balanced_packing}
