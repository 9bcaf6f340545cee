"""Packing token sequences by non-negative least squares.

Every document becomes its token ids and an end id. Whole windows are cut off its front; the tails of a group of
documents are packed together: all combinations of two or three tail lengths that fill a window are enumerated,
their repeat counts solved as non-negative least squares against the histogram of tail lengths, rounded, and made
while tails last. What is left is packed greedily (the largest tail that fits; when none does, one is cut). A
group's last, partly filled window is cut into powers of two, which take no padding.

A group is a scan partition's documents, at most GROUP_DOCS of them: nothing is shuffled, and a sequence id is the
partition's number and a count in it. Defined results: a null text counts as empty and is the end id alone; ids may
be null or repeated, each row is packed on its own; an empty table gives an empty table; only id and text are read,
so that clashing extra columns don't matter. Texts are read whole.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loam.llm.common import kept, map_rows

WINDOW, GROUP_DOCS, END_ID = 1024, 32768, 0

#: Adjacent white space: only there does a token reach over a space or line break.
_ADJACENT = re.compile(r"\s\s|<\|")
_LATIN = re.compile(r" ?[\x21-\x7eÀ-ɏ]+")


class WordCache(dict):
    """Token ids (little-endian 32-bit) of a word, with or without the space before it."""

    MOST, LONGEST = 500_000, 64  # words that are remembered, and their characters: texts without spaces must not pile up

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(self.before + word)).tobytes() if self.before + word else b""
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = ids
        return ids


class ByteTokens:
    """Token ids of whole texts, as the tokenizers library gives them for the file."""

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later = WordCache(self._word, ""), WordCache(self._word, " ")
        self.line_end = np.array(self._word("\n"), "<u4").tobytes()

    def _word(self, word: str) -> list[int]:
        if self.fast and _LATIN.fullmatch(word):
            return self.fast(word)
        return self.library.encode(word, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _ADJACENT.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:])))
        return self.line_end.join(lines)


def tokens(path: str, ranks_path: str | None) -> ByteTokens:
    return kept((path, ranks_path), lambda: ByteTokens(path, ranks_path))


def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, that sum to window; a = 0 for a pair."""
    a, b = np.meshgrid(np.arange(window // 3 + 1), np.arange(1, window), indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c)
    return np.stack([a[ok], b[ok], c[ok]], 1)


_combinations: dict[int, np.ndarray] = {}


def repeat_counts(columns: np.ndarray, histogram: np.ndarray, steps: int = 40) -> np.ndarray:
    """x >= 0 that brings the lengths used by x[j] repeats of combination j close to the histogram (least squares)."""
    size = len(histogram)
    real = columns > 0
    use = lambda x: np.bincount(columns.ravel(), np.where(real, x[:, None], 0).ravel(), size)
    back = lambda y: np.where(real, y[columns], 0).sum(1)
    target = back(histogram.astype(float))
    x = np.full(len(columns), histogram.sum() / (3 * max(len(columns), 1)))
    for _ in range(steps):  # multiplicative steps keep x non-negative
        x = x * target / np.maximum(back(use(x)), 1e-9)
    return x


def packed(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences of (padded size, pieces), a piece being (index into lengths, start, length)."""
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by length: (index, start)
    for i, n in enumerate(lengths.tolist()):
        free[n].append((i, 0))
    if window not in _combinations:
        _combinations[window] = combinations(window)
    histogram = np.bincount(lengths, minlength=window + 1)
    columns = _combinations[window]
    columns = columns[((histogram[columns] > 0) | (columns == 0)).all(1)]
    if len(columns):
        sums = np.floor(np.cumsum(repeat_counts(columns, histogram)) + 0.5).astype(np.int64)  # rounds without losing the total
        repeats = np.diff(sums, prepend=0)
        for j in np.flatnonzero(repeats).tolist():
            lens = [n for n in columns[j].tolist() if n]
            for _ in range(int(repeats[j])):
                if any(len(free[n]) < lens.count(n) for n in lens):
                    break
                out.append((window, [(*free[n].pop(), n) for n in lens]))
    open_, room = [], window
    there = sorted(n for n, held in free.items() if held)
    while there:
        k = bisect.bisect_right(there, room) - 1
        n = there[max(k, 0)] if k >= 0 else there[-1]
        i, start = free[n].pop()
        if not free[n]:
            there.remove(n)
        if k >= 0:
            open_.append((i, start, n))
            room -= n
        else:
            open_.append((i, start, room))
            rest = n - room
            if not free[rest]:
                bisect.insort(there, rest)
            free[rest].append((i, start + room))
            room = 0
        if not room:
            out.append((window, open_))
            open_, room = [], window
    left = window - room
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        part, need = [], size
        while need:
            i, start, n = open_.pop(0)
            take = min(n, need)
            part.append((i, start, take))
            need -= take
            if take < n:
                open_.insert(0, (i, start + take, n - take))
        out.append((size, part))
    return out


def packed_pieces(docs: DataFrame, path: str, ranks_path: str | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    path: the library's file; ranks_path: the same vocabulary as ranks, for words of Latin letters and ASCII (faster).
    """

    def each(rows):
        codec, end = tokens(path, ranks_path), np.array([END_ID], "<u4").tobytes()
        top, count = TaskContext.get().partitionId() << 36, 0
        held: list[tuple] = []  # (doc_id, where the tail starts, all tokens, tail)

        def piece(k, start, raw, total, seq, offset):
            row = (k, start, len(raw) // 4, zlib.crc32(raw), total, seq, offset)
            return (*row, np.frombuffer(raw, "<u4").astype(np.int64)) if with_ids else row

        def flush():
            nonlocal count
            for _, parts in packed(np.array([len(h[3]) // 4 for h in held], np.int64), window):
                offset = 0
                for i, start, n in parts:
                    k, base, total, raw = held[i]
                    yield piece(k, base + start, raw[4 * start : 4 * (start + n)], total, top + count, offset)
                    offset += n
                count += 1

        for k, t in rows:
            raw = codec.encode(t or "") + end
            total = len(raw) // 4
            whole = total // window
            for w in range(whole):
                yield piece(k, w * window, raw[4 * w * window : 4 * (w + 1) * window], total, top + count, 0)
                count += 1
            if total % window:
                held.append((k, whole * window, total, raw[4 * whole * window :]))
            if len(held) >= group_docs:
                yield from flush()
                held = []
        if held:
            yield from flush()

    columns = f"doc_id {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], each, columns)
