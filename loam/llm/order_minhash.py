"""Document fingerprints by Order MinHash.

The k-mers of a text (runs of K characters) are numbered by occurrence, so that repeats count. Each of SKETCHES orders
picks the PICKS smallest numbered k-mers; their texts, in the order in which they stand in the document, are hashed to
one 16-bit part. Likeness is the share of equal parts: it falls with edits and with changes of order.

To compare each document with the next one, texts are dealt once into sorted ranges of ids (and, within one id, of the
fronts of texts), which are streamed; the first and last documents of the ranges are paired afterwards, by the ranges'
numbers. Defined results: a null text counts as empty; a text shorter than K is a
single k-mer; equal ids stand in the order of their texts and null ids come last; with a single row, the next document
is that row itself; an empty table gives an empty table; only id and text are read, so that clashing extra columns don't
matter. Texts are read whole, in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from loam.llm.common import map_rows, stage

K, PICKS, SKETCHES = 6, 2, 48
#: Characters of a text's front that cut rows of one id.
FRONT = 32
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)  # Fixed values: constants of a public 32-bit mixer
_BLOCK = 1 << 15
_FACTORS = np.random.default_rng(11).integers(0, 1 << 31, SKETCHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * _M1
    x = (x ^ (x >> np.uint32(13))) * _M2
    return x ^ (x >> np.uint32(16))


def kmer_hashes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = min(K, len(c))
    h = np.zeros(max(len(c) - k + 1, 0) if k else 0, np.uint32)
    for j in range(k):
        h = h * np.uint32(0x01000193) + c[j : j + len(h)]
        h ^= h >> np.uint32(15)
    return _mixed(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how many equal ones came before)."""
    packed = np.sort((h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64))
    at, value = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), packed >> np.uint64(32)
    place = np.arange(len(h))
    first = np.ones(len(h), bool)
    first[1:] = value[1:] != value[:-1]
    number = np.empty(len(h), np.uint32)
    number[at] = place - np.maximum.accumulate(np.where(first, place, 0))
    return _mixed(h + number * np.uint32(0x9E3779B1))


def fingerprint(text: str | None) -> np.ndarray:
    """SKETCHES parts of 16 bits."""
    h = kmer_hashes(text or "")
    if not len(h):
        return np.zeros(SKETCHES, np.uint16)
    key = numbered(h)
    picks = min(PICKS, len(h))
    rows, best, where = np.arange(SKETCHES), [], []
    for low in range(0, len(key), _BLOCK):
        v = key[None, low : low + _BLOCK] * _FACTORS[:, None]
        for _ in range(min(picks, v.shape[1])):
            i = v.argmin(1)
            best.append(v[rows, i])
            where.append(i + low)
            v[rows, i] = np.uint32(0xFFFFFFFF)
    best, where = np.stack(best, 1), np.stack(where, 1)
    if best.shape[1] > picks:
        chosen = np.argsort(best, 1, kind="stable")[:, :picks]
        where = np.take_along_axis(where, chosen, 1)
    where.sort(1)
    out = np.zeros(SKETCHES, np.uint32)
    for j in range(picks):
        out = _mixed(out * np.uint32(31) + h[where[:, j]] + np.uint32(j + 1))
    return (out ^ (out >> np.uint32(16))).astype(np.uint16)


def written(parts: np.ndarray) -> str:
    return parts.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint."""

    def each(rows):
        for k, t in rows:
            yield k, written(fingerprint(t))

    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], each, f"doc_id {dict(docs.dtypes)[key]}, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last third of text replaced by as much of the front of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compared(k, text: str, mine: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    other = fingerprint(edited)
    return k, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(mine), written(other), likeness(mine, other), likeness(mine, theirs)


def compared_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one below in descending order of ids; after the last one comes the first.
    """
    kind = dict(docs.dtypes)[key]
    columns = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # ranges are cut by ids and the front of texts, so that the sample that finds the cuts holds no whole texts and the
    # rows of one id (or of none) are cut as well
    front = F.substring("text", 1, FRONT)
    dealt = rows.repartitionByRange(F.desc_nulls_last("doc_id"), front).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")

    def each(rows):
        part, first, last = TaskContext.get().partitionId(), None, None
        none = (None,) * 3
        for k, t in rows:
            now = (k, t, fingerprint(t))
            if last is None:
                first = now
            else:
                yield *_compared(*last, *now[1:]), *none
            last = now
        if first is not None:
            yield first[0], *(None,) * 6, part, True, first[1]
            yield last[0], *(None,) * 6, part, False, last[1]

    found = stage(map_rows(dealt, ["doc_id", "text"], each, f"{columns}, part int, is_first boolean, edge string", 500), "compared")
    # the last document of each range goes with the first of the next that has any; the numbers of the ranges are paired
    # first (a number a range in one task), then the two texts of each pair are joined by number
    edges = found.where("part is not null")
    numbers = edges.where("is_first").select("part")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(every)).alias("next"))
    firsts = edges.where("is_first").select(F.col("part").alias("next"), F.col("edge").alias("following"))
    pairs = edges.where("not is_first").select("doc_id", "edge", "part").join(numbers, "part").join(firsts, "next").select("doc_id", "edge", "following")

    def finish(rows):
        for k, t, f in rows:
            yield _compared(k, t, fingerprint(t), f, fingerprint(f))

    return found.where("part is null").drop("part", "is_first", "edge").union(map_rows(pairs, ["doc_id", "edge", "following"], finish, columns))
