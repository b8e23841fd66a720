"""Token counts of whole texts by heap-and-linked-list byte-pair merging, with no identifiers emitted.

A word's symbols form a doubly linked list; a heap holds the adjacent pairs that have a merge rank. The pair of
lowest rank (leftmost on ties) is popped again and again and joined; entries whose symbols have changed since are
skipped. The count is the number of initial symbols minus the merges made. Words recur, so each worker keeps the
counts of the words it has met; that memory is bounded by MEMO words and dropped when full.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vexel.plans.storage import bounded_batches

#: Words whose counts a worker remembers.
MEMO = 600_000
#: Longest word that is remembered, in characters.
MEMO_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is a visible
    Latin-1 character, else the next unused code point from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens as the vocabulary file's own library does, for its one family: canonical composition, runs of
    white space as one space, lower case, words by pattern, bytes as symbols, a suffix on a word's last symbol."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {m: i for i, m in enumerate(merges)}
        steps = {x["type"]: x for x in spec["pre_tokenizer"]["pretokenizers"]}
        # White space of the file's pattern language has no U+001C to U+001F, which Python's \s has.
        pattern = steps["Split"]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.marks = specials
        self.symbol = byte_symbols()
        self.library: Tokenizer | None = None
        self.memo: dict[str, int] = {}
        self.known: set[str] = set()  # characters that were met, all of them in Python's tables

    def symbols(self, word: str) -> list[str]:
        return [self.symbol[b] for b in word.encode("utf-8", "surrogatepass")]

    def merged(self, symbols: list[str]) -> int:
        """Initial symbols of a word minus its merges."""
        parts: list[str | None] = list(symbols)
        n = len(parts)
        parts[-1] = f"{parts[-1]}{self.suffix}"
        rank = self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = left + right, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return n - merges

    def _assigned(self, text: str) -> bool:
        """Whether Python's tables know every character; pattern engines differ on the class and case of others."""
        new = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.known |= new
        return True

    def _plain(self, text: str) -> int:
        if not text.isascii():
            if not self._assigned(text):
                library = self.library = self.library or Tokenizer.from_file(self.path)  # its tables alone say where such words end
                split = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
                return sum(self.merged(list(w)) for w, _ in split)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case is by single characters: no final form
        memo, total = self.memo, 0
        words = self.words.findall(text.lower())
        for w, n in zip(words, map(memo.get, words)):
            if n is None:
                n = self.merged(self.symbols(w))
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special token's string inside it counts as that one token."""
        if not text:
            return 0
        if self.special is None or not any(m in text for m in self.marks):
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(self._plain(p) for p in pieces if p)


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary is the path of the vocabulary file on every worker. Nothing is shuffled and rows are independent.
    Null or empty text: 0 bytes, 0 tokens. Null keys and repeated rows stay. Texts of any length are counted
    whole. Empty table: no rows. Columns other than key and text are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("n_bytes"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["k", "n_bytes", "n_tokens"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long").select(
        F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
