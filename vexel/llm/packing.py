"""Packing token streams into fixed windows by order-preserving dynamic programming.

Documents keep the order in which a partition reads them and form one token stream. A window may end at the end of a
document (free) or of a sentence (SENTENCE_CUT). Only where a stretch without either is longer than a window may one end
inside it, at every STEP tokens (HARD_CUT). The cuts minimise padding plus these truncation penalties, all counted in tokens:

    cost(j) = penalty(j) + min over i with 0 < p(j) - p(i) <= size of cost(i) + size - (p(j) - p(i))

The bracket depends on i by cost(i) + p(i) alone, so a monotone queue of that value gives each minimum in constant
amortised time. The stream is solved in blocks of BLOCK tokens; the last window of a block is carried over. What is
left at a partition's end is cut into windows of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vexel.llm.token_counts import byte_symbols
from vexel.plans.storage import bounded_batches

SIZE = 2048
END = 1
SENTENCE_CUT = 2
HARD_CUT = 8
STEP = 16
BLOCK = 1 << 18
#: Fixed value: the pattern that byte-level vocabularies of this family split texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of this many characters without or of white space go to the slower library, whose cost on them is even.
LONG_WORD, LONG_SPACE = 20_000, re.compile(r"\s{2000}")


class Encoder:
    """Ids of a byte-level vocabulary file, equal to its own library's: the same merges by a faster engine, which is
    given the file's ids as ranks. Special tokens' strings in a text become those tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.path, self.library = path, None
        self.ends_sentence = np.zeros(max(vocab.values()) + 2, bool)
        for token, i in ranks.items():
            self.ends_sentence[i] = token.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, then END."""
        if not text:
            return np.array([END], np.uint32)
        if len(text) >= 2000 and (LONG_SPACE.search(text) or len(text) >= LONG_WORD and max(map(len, text.split()), default=0) >= LONG_WORD):
            self.library = self.library or Tokenizer.from_file(self.path)
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.engine.encode(text, allowed_special="all")
        ids.append(END)
        return np.array(ids, np.uint32)

    def cuts(self, ids: np.ndarray, size: int = SIZE) -> tuple[list[int], list[int]]:
        """Places inside and at the end of a document where a window of size tokens may end, and their penalties."""
        n = len(ids)
        ends = np.flatnonzero(self.ends_sentence[ids[: max(0, n - 2)]]) + 1
        places = np.append(ends, n)
        penalty = np.full(len(places), SENTENCE_CUT)
        penalty[-1] = 0
        gaps = np.diff(places, prepend=0)
        wide = np.flatnonzero(gaps > size)
        if len(wide):
            more = np.concatenate([np.arange(places[k] - gaps[k] + STEP, places[k], STEP) for k in wide])
            places = np.concatenate([places, more])
            order = np.argsort(places, kind="stable")
            places, penalty = places[order], np.concatenate([penalty, np.full(len(more), HARD_CUT)])[order]
        return places.tolist(), penalty.tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def best_cuts(places: Sequence[int], penalties: Sequence[int], size: int = SIZE, open_end: bool = False) -> list[int]:
    """The ends of the windows, the last place included, that cost least. places ascend from above 0, no two next
    to each other (or 0) further apart than size. With open_end the last window's padding doesn't count, because it
    goes on or needs none."""
    place, cost, back = [0, *places], [0], [0]
    value = [0]
    queue = deque([0])
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        if open_end and j == len(place) - 1:
            i = min((i for i in range(j - 1, -1, -1) if place[i] >= p - size), key=cost.__getitem__)
        c = penalties[j - 1] + value[i] + size - p
        back.append(i)
        cost.append(c)
        v = c + p
        value.append(v)
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], len(place) - 1
    while j:
        out.append(place[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Packs one partition's documents. Rows are (key, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, encode: Encoder, first: int, size: int = SIZE, block: int = BLOCK):
        self.encode, self.size, self.block, self.sequence = encode, size, block, first
        self.ids: list[np.ndarray] = []
        self.keys: list[object] = []
        self.begins: list[int] = []  # of the documents in the buffer; below 0 for one that is partly packed
        self.lengths: list[int] = []
        self.places: list[int] = []
        self.penalties: list[int] = []
        self.end = 0

    def add(self, key: object, text: str | None) -> list[tuple]:
        ids = self.encode.encode(text)
        places, penalties = self.encode.cuts(ids, self.size)
        self.keys.append(key)
        self.begins.append(self.end)
        self.lengths.append(len(ids))
        self.ids.append(ids)
        self.places += [self.end + p for p in places]
        self.penalties += penalties
        self.end += len(ids)
        return self._flush(False) if self.end >= self.block else []

    def close(self) -> list[tuple]:
        return self._flush(True) if self.end else []

    def _flush(self, last: bool) -> list[tuple]:
        ids = np.concatenate(self.ids)
        ends = best_cuts(self.places, self.penalties, self.size, open_end=True)
        open_ = ends[-2] if len(ends) > 1 else 0
        if last:
            ends.pop()
            left, k = self.end - open_, self.size
            if left < self.size:
                at = open_
                while left:
                    k = 1 << (left.bit_length() - 1)
                    at += k
                    left -= k
                    ends.append(at)
            else:
                ends.append(self.end)
            open_ = self.end
        else:
            ends.pop()
        rows = []
        begin = 0
        for end in ends:
            d = bisect_right(self.begins, begin) - 1
            at = begin
            while at < end:
                stop = min(end, self.begins[d] + self.lengths[d])
                rows.append((self.keys[d], at - self.begins[d], stop - at, zlib.crc32(ids[at:stop]), self.lengths[d], self.sequence, at - begin))
                at = stop
                d += 1
            self.sequence += 1
            begin = end
        d = bisect_right(self.begins, open_) - 1
        if open_ >= self.end:
            d = len(self.begins)
        self.ids = [ids[open_:]]
        self.keys, self.lengths = self.keys[d:], self.lengths[d:]
        self.begins = [b - open_ for b in self.begins[d:]]
        k = bisect_right(self.places, open_)
        self.places, self.penalties = [p - open_ for p in self.places[k:]], self.penalties[k:]
        self.end -= open_
        return rows


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every partition packs the documents it reads, in their order; nothing is shuffled, and a lost task packs the same
    rows again. sequence_id is the partition's number times 2**33 plus a count. Documents longer than a window go on
    in the next. Null or empty text: the end id alone. Null keys and repeated rows are documents like others. Empty
    table: no rows. Columns other than key and text are not read. size must be a power of two.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(encoder(vocabulary), (context.partitionId() if context else 0) << 33, size)
        key_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [key_type, *[pa.int64()] * 6], strict=True)], names)

        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if rows := packer.add(k, t.as_py()):
                    yield out(rows)
        if rows := packer.close():
            yield out(rows)

    pieces = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
    return pieces.withColumnRenamed("k", key)
