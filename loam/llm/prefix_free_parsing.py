"""Exact substring deduplication by suffix arrays over prefix-free parsing.

A byte goes if a WIDTH-byte string that covers it also starts in a document with a smaller id. Rolling-hash triggers cut
all documents into phrases, which overlap by WIDTH - 1 bytes, so that every string lies whole in one phrase and the
groups of equal strings can be read from the order of the suffixes of the distinct phrases: the dictionary. The parse
tells which documents have a phrase. Steps, all distributed:

1. parse: every task sends each of its phrases once, to a part of the dictionary by its name (a 128-bit hash).
2. dictionary: distinct phrases, told apart by their bytes, with their smallest id. Two phrases of one name are found
   here, and all is done again with another seed: no decision rests on equal hashes.
3. Every string has an anchor (the least GRAM-byte hash in it), so that equal strings have equal anchors. Strings whose
   anchor is in one phrase only are in no other; the rest go as fragments of the dictionary to buckets, by anchor (by the
   strings themselves, if the anchor is in very many phrases).
4. There the fragments are themselves parsed prefix-free, and the suffix arrays of their dictionary and parse combined
   into the order of all suffixes, in which equal strings are neighbours, compared by their bytes. Every string gets the
   smallest id of its group.
5. The strings' smallest ids go back to the dictionary, from there by name to the parse, and as ranges to the documents.

Repeated text costs a row a phrase, whatever its number of copies. Parts and buckets exchange a row for each pair of
them, as a shuffle has a segment for each pair of its tasks; at 100 TB parts of 1 GB (BLOCK) keep these rows at 4 kB.
A phrase, or a row, that a third of all documents have is a hot key of a join only, which adaptive execution splits.

Defined results: a null text counts as empty; documents of one id (repeated rows) never remove each other's bytes; null
ids come after all others; an empty table gives an empty table; only id (an integer) and text are read, so that clashing
extra columns don't matter. Texts are read whole; very long ones in segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from loam.llm.common import bound_batches, drop_staged, lean, leaving, leanly, map_rows, stage

WIDTH, GRAM = 50, 24
#: Bytes of distinct phrases in a part; bytes that are parsed at once; mean bytes of a phrase; phrases of one anchor that go to one place.
BLOCK, SEGMENT, PHRASE, HOT = 16 << 20, 1 << 19, 256, 1 << 15
#: Parts of a bucket; bytes of fragments that are sorted together (a part more at most); bytes of phrases that a task knows, and that it sends at once.
PARTS, AT_ONCE, KNOWN, SENT = 1024, 1 << 18, 24 << 20, 16 << 20
#: Seeds that are tried, should two phrases have one name.
SEEDS = 8
NO_ID = (1 << 63) - 1
_ANCHOR = np.uint64(0xFFFFFFFFFF000000)  # bits of a hash that order anchors; the place decides between equal ones

_rng = np.random.default_rng(5)
_TABLE = _rng.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_held: dict[str, np.ndarray] = {"n": np.zeros(0)}


def rolling(b: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all strings of each width in b; equal strings have equal hashes wherever they stand."""
    n = len(b)
    if len(_held["n"]) < n:
        size = max(n, SEGMENT + WIDTH)
        _held.update(n=np.zeros(size), up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[b] * _held["up"][:n], out=sums[1:])
    out = []
    for w in widths:
        h = (sums[w:] - sums[: n + 1 - w]) * _held["down"][: n + 1 - w] if n >= w else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    done, m = 1, x
    while 2 * done <= w:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - done : w - done + len(x) - w + 1])


class Flat:
    """Texts laid end to end, and the strings of WIDTH bytes in each."""

    def __init__(self, raws: list[bytes]):
        self.raw = b"".join(raws)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        lens = np.array([len(x) for x in raws], np.int64)
        self.low = np.cumsum(lens) - lens
        self.strings = np.maximum(lens - WIDTH + 1, 0)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, number of strings) of every phrase, in order."""
        (grams,) = rolling(self.bytes, (GRAM,))
        at = np.flatnonzero(grams < np.uint64((1 << 64) // PHRASE))
        owner = np.searchsorted(self.low, at, side="right") - 1
        inside = at - self.low[owner] < self.strings[owner] - 1
        at, owner = at[inside], owner[inside]
        # a trigger is the anchor of the string that begins with it, so that no anchor's strings lie in two phrases
        own = grams[at] & _ANCHOR
        inside = np.ones(len(at), bool)
        for j in range(1, WIDTH - GRAM + 1):
            inside &= grams[at + j] & _ANCHOR >= own
        at, owner = at[inside] + 1, owner[inside]
        some = np.flatnonzero(self.strings)
        start = np.concatenate([self.low[some], at])
        owner = np.concatenate([some, owner])
        order = np.argsort(start, kind="stable")
        start, owner = start[order], owner[order]
        end = self.low[owner] + self.strings[owner]
        end[:-1] = np.where(owner[1:] == owner[:-1], start[1:], end[:-1])
        return owner, start, end - start

    def anchored(self) -> tuple[np.ndarray, ...]:
        """(place, text, hash, anchor, anchor's place) of every string."""
        grams, strings = rolling(self.bytes, (GRAM, WIDTH))
        place = np.arange(len(grams), dtype=np.uint64)
        least = window_min((grams & _ANCHOR) | place, WIDTH - GRAM + 1)
        owner = np.repeat(np.arange(len(self.low)), self.strings)
        first = np.cumsum(self.strings) - self.strings
        at = np.arange(len(owner)) - first[owner] + self.low[owner]
        least = least[at]
        anchor_at = (least & ~_ANCHOR).astype(np.int64)
        return at, owner, strings[at], grams[anchor_at] >> np.uint64(16), anchor_at


def _chunks(sizes: list[int], most: int):
    """Ranges of texts of about `most` bytes together."""
    low, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def _squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _whole(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _coded(names: list[bytes], texts: list[bytes], least: np.ndarray, most: np.ndarray) -> tuple[bytes, bytes]:
    """Phrases as two cells: texts; names, lengths, smallest ids and whether there is a larger one."""
    extra = b"".join(names) + np.array([len(t) for t in texts], "<u4").tobytes() + least.astype("<i8").tobytes() + (most > least).tobytes()
    return _squeezed(b"".join(texts)), _squeezed(extra)


class Phrases:
    """Names, smallest ids, whether two ids have the phrase, and texts if asked for."""

    def __init__(self, extra: bytes, texts: bytes | None = None):
        extra = _whole(extra)
        n = len(extra) // 29
        self.names, self.lens = extra[: 16 * n], np.frombuffer(extra, "<u4", n, 16 * n).astype(np.int64)
        self.least = np.frombuffer(extra, "<i8", n, 20 * n)
        self.several = np.frombuffer(extra, bool, n, 28 * n)
        if texts is not None:
            raw, cuts = _whole(texts), [0, *np.cumsum(self.lens).tolist()]
            self.texts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def name(self, i: int) -> bytes:
        return self.names[16 * i : 16 * i + 16]


_NAMED, _SENT = "name binary, row binary, id long, start long", "part long, texts binary, about binary"


def parsed(rows: DataFrame, seed: int, segment: int, parts: int | None = None) -> DataFrame:
    """rows (row, id, raw) -> the phrases of every row (name, row, id, start).

    With parts: instead, the phrases themselves by part of the dictionary, each once a task (again if it has a smaller id,
    or a second one).
    """
    bound_batches(rows.sparkSession)
    schema = pa.schema([("part", pa.int64()), ("texts", pa.binary()), ("about", pa.binary())] if parts else [("name", pa.binary()), ("row", pa.binary()), ("id", pa.int64()), ("start", pa.int64())])

    def batch_of(made):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    def cut(batches):
        """(row's key, id, start, phrase) of every phrase."""
        for batch in batches:
            keys, ids, raws = (c.to_pylist() for c in batch.columns)
            pieces = [(i, low, raw[low : low + segment + WIDTH - 1]) for i, raw in enumerate(raws) for low in range(0, len(raw) - WIDTH + 1, segment)]
            for a, b in _chunks([len(x[2]) for x in pieces], segment):
                flat = Flat([x[2] for x in pieces[a:b]])
                owner, place, strings = flat.phrases()
                for j, low, start, end in zip(owner.tolist(), (place - flat.low[owner]).tolist(), place.tolist(), (place + strings + (WIDTH - 1)).tolist()):
                    i, base, _ = pieces[a + j]
                    yield keys[i], NO_ID if ids[i] is None else ids[i], base + low, flat.raw[start:end]

    def named(batches):
        out = []
        for key, k, start, phrase in cut(batches):
            out.append((xxhash.xxh3_128_digest(phrase, seed), key, k, start))
            if len(out) >= 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def sent(batches):
        known: dict[bytes, list] = {}  # phrase: name, smallest id sent, whether two ids were sent
        held: dict[int, list[tuple]] = {}
        size = size_known = 0

        def blobs():
            for part, own in held.items():
                ids = np.array([k for _, _, k in own], np.int64)
                yield batch_of([(part, *_coded([h for h, _, _ in own], [t for _, t, _ in own], ids, ids))])
            held.clear()

        for _, k, _, phrase in cut(batches):
            got = known.get(phrase)
            if got is None:
                if size_known > KNOWN:
                    known.clear()
                    size_known = 0
                size_known += len(phrase) + 200
                got = known[phrase] = [xxhash.xxh3_128_digest(phrase, seed), k, False]
            elif k < got[1] or k != got[1] and not got[2]:
                got[1], got[2] = min(k, got[1]), True
            else:
                continue
            held.setdefault(int.from_bytes(got[0][:8], "little") % parts, []).append((got[0], phrase, k))
            size += len(phrase)
            if size >= SENT:
                yield from blobs()
                size = 0
        yield from blobs()

    return rows.select("row", "id", "raw").mapInArrow(lean(sent if parts else named, __name__), _SENT if parts else _NAMED)


def _packed(x: np.ndarray) -> bytes:
    """Ascending numbers, as their differences, byte by byte."""
    return _squeezed(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_whole(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


#: What parts and buckets send each other: anchors, fragments, smallest ids.
_ROW = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary()), ("places", pa.binary())])
_SQL = "bucket long, part long, keys binary, extra binary, places binary"
CLASH = "two phrases of one name"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows) if rows else [[]] * 5, _ROW.types)], schema=_ROW)


def _by_bucket(bucket: np.ndarray):
    """(bucket, which) of the items of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(bucket[order[low]]), order[low:high]


class Part:
    """The phrases of one part of the dictionary, told apart by their bytes, in an order that doesn't depend on how they came."""

    def __init__(self, t: pa.Table):
        held: dict[bytes, list] = {}  # phrase: name, smallest id, largest id
        for texts, about in zip(t.column("texts"), t.column("about")):
            some = Phrases(about.as_py(), texts.as_py())
            for i, (text, k) in enumerate(zip(some.texts, some.least.tolist())):
                got = held.get(text)
                if got is None:
                    held[text] = [some.name(i), k, k]
                elif k < got[1]:
                    got[1] = k
                elif k > got[2]:
                    got[2] = k
        rows = sorted((name, text, low, high) for text, (name, low, high) in held.items())
        self.names, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        if len(set(self.names)) < len(rows):
            raise RuntimeError(CLASH)
        self.least, most = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        self.several = most > self.least
        self.number = t.column("part")[0].as_py()


def _asked(t: pa.Table, buckets: int, segment: int) -> pa.Table:
    """Of one part: by bucket, the anchors of its strings with numbers of phrases."""
    part, anchors = Part(t), []
    for a, b in _chunks([len(x) for x in part.texts], segment):
        _, owner, _, anchor, at = Flat(part.texts[a:b]).anchored()
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        anchors.append(_distinct(anchor[new], owner[new])[0])
    keys, counts = np.unique(np.concatenate(anchors), return_counts=True)
    counts = np.minimum(counts, 65535).astype("<u2")
    return _table([(k, part.number, _packed(keys[which]), _squeezed(counts[which].tobytes()), None) for k, which in _by_bucket((keys % np.uint64(buckets)).astype(np.int64))])


def _distinct(anchor: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    order = np.lexsort((owner, anchor))
    a, o = anchor[order], owner[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    return a[new], o[new]


def _looked_up(t: pa.Table, hot: int) -> pa.Table:
    """Of one bucket: for each part its anchors that are in two phrases (extra: which are in very many)."""
    own = [(r["part"], _unpacked(r["keys"]), np.frombuffer(_whole(r["extra"]), "<u2")) for r in t.to_pylist()]
    a, c = np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own]).astype(np.int64)
    inverse = np.unique(a, return_inverse=True)[1]
    total = np.bincount(inverse, c)[inverse]
    out, low = [], 0
    for part, mine, _ in own:
        n = total[low : low + len(mine)]
        low += len(mine)
        if (n > 1).any():
            out.append((0, part, _packed(mine[n > 1]), _squeezed((n[n > 1] > hot).tobytes()), None))
    return _table(out)


def _fragments(t: pa.Table, found: pa.Table, buckets: int, segment: int) -> pa.Table:
    """Of one part: fragments whose strings may be in other phrases, by bucket (extra: ids, numbers of strings, parts of the bucket), and where they stand."""
    rows = found.to_pylist()
    if not rows:
        return _table([])
    part = Part(t)
    shared = np.concatenate([_unpacked(r["keys"]) for r in rows])
    hot = np.concatenate([np.frombuffer(_whole(r["extra"]), bool) for r in rows])
    order = np.argsort(shared)
    shared, hot = shared[order], hot[order]
    sent: dict[int, tuple[list, list, list]] = {}
    for a, b in _chunks([len(x) for x in part.texts], segment):
        flat = Flat(part.texts[a:b])
        at, owner, string, anchor, anchor_at = flat.anchored()
        place = np.searchsorted(shared, anchor)
        place[place == len(shared)] = 0
        which = np.flatnonzero(shared[place] == anchor)
        if not len(which):
            continue
        at, owner, string, anchor, anchor_at, alone = at[which], owner[which], string[which], anchor[which], anchor_at[which], hot[place[which]]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor_at[1:] != anchor_at[:-1]) | alone[1:] | alone[:-1]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(at))
        key = np.where(alone[first], string[first], anchor[first])
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        sub = (key // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64)
        start, owner = at[first], owner[first]
        about = np.stack([part.least[a + owner], size, sub], 1)
        for k, mine in _by_bucket(bucket):
            texts, numbers, places = sent.setdefault(k, ([], [], []))
            texts += [flat.raw[s : s + n + WIDTH - 1] for s, n in zip(start[mine].tolist(), size[mine].tolist())]
            numbers.append(about[mine])
            places.append(np.stack([a + owner[mine], start[mine] - flat.low[owner[mine]], size[mine]], 1))
    packed = lambda x, kind: _squeezed(np.concatenate(x).astype(kind).tobytes())
    return _table([(k, part.number, _squeezed(b"".join(texts)), packed(numbers, "<i8"), packed(places, "<u4")) for k, (texts, numbers, places) in sent.items()])


def _ranks(value: np.ndarray, last: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Ranks of all suffixes of groups laid end to end (by their first depth items); last: the place of the end of each item's group."""
    n = len(value)
    if not n:
        return np.zeros(0, np.int64)
    there = np.zeros(int(value.max()) + 1, bool)
    there[value] = True
    rank = np.cumsum(there)[value]  # from 1; 0 is the end
    bits = int(rank.max()).bit_length()
    left = last - np.arange(n)  # items after this one in its group
    first, step = rank, 1
    while (step + 1) * bits <= 62:  # as many items as a word holds are compared at once
        rank = rank << bits
        rank[: n - step] += np.where(left[: n - step] >= step, first[step:], 0)
        step += 1
    rank = np.unique(rank, return_inverse=True)[1] + 1
    longest = min(int(left.max()) + 1, depth or n)
    while step < longest:
        key = rank * (n + 2)
        key[: n - step] += np.where(left[: n - step] >= step, rank[step:], 0)
        classes = rank.max()
        rank = np.unique(key, return_inverse=True)[1] + 1
        if rank.max() == classes:  # nothing more is told apart
            break
        step *= 2
    return rank


def suffix_order(texts: list[bytes], firsts: np.ndarray | None = None, depth: int | None = None, trigger: int = 4, modulus: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of distinct texts (the first firsts[i] of texts[i], or all; by depth bytes, or all), and where each text starts.

    Positions are those of the texts laid end to end. A suffix that ends sorts before one that goes on.
    """
    lens = np.array([len(t) for t in texts])
    starts = np.cumsum(lens) - lens
    # each text is closed by `trigger` zeros, which no byte (1 to 256 here) equals
    size = int(lens.sum()) + trigger * len(texts)
    x = np.zeros(size, np.uint16)
    at = np.arange(int(lens.sum())) + np.repeat(np.arange(len(texts)) * trigger, lens)
    x[at] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    low = starts + np.arange(len(texts)) * trigger  # of each text in x
    high = low + lens
    h = np.zeros(size, np.uint32)
    for j in range(trigger):
        h[: size - trigger + 1] = h[: size - trigger + 1] * np.uint32(0x01000193) + x[j : size - trigger + 1 + j]
    h ^= h >> np.uint32(15)
    starting = (h * np.uint32(0x9E3779B1)) >> np.uint32(16) & np.uint32(modulus - 1) == 0
    owner = np.zeros(size, bool)
    owner[at] = True
    inside = np.zeros(size, bool)  # where a trigger may start: it must lie in its text
    inside[at] = True
    for j in range(1, trigger):
        inside[:-j] &= owner[j:]
    starting &= inside
    starting[low[lens > 0]] = True
    begin = np.flatnonzero(starting)
    text_of = np.searchsorted(low, begin, side="right") - 1
    follows = np.append(text_of[1:] == text_of[:-1], False)  # the next phrase is of the same text
    end = np.where(follows, np.append(begin[1:], size), high[text_of]) + trigger
    raw = x.astype(">u2").tobytes()
    phrases = [raw[2 * b : 2 * e] for b, e in zip(begin.tolist(), end.tolist())]
    dictionary = {p: i for i, p in enumerate(sorted(set(phrases)))}
    parse = np.array([dictionary[p] for p in phrases])
    # suffixes of the dictionary's phrases
    plen = np.array([len(p) // 2 for p in dictionary])
    pstart = np.cumsum(plen) - plen
    letters = np.frombuffer(b"".join(dictionary), ">u2").astype(np.int64)
    inner = _ranks(letters, np.repeat(pstart + plen - 1, plen), depth and depth + trigger)
    # suffixes of the parse, text by text
    ends = np.flatnonzero(~follows)
    outer = _ranks(parse, ends[np.searchsorted(ends, np.arange(len(parse)))], depth)
    after = np.where(follows, np.append(outer[1:], 0), 0)
    chosen = np.arange(len(at))
    if firsts is not None:
        chosen = chosen[chosen - np.repeat(starts, lens) < np.repeat(firsts, lens)]
        at = at[chosen]
    phrase_at = np.searchsorted(begin, at, side="right") - 1
    key = inner[pstart[parse[phrase_at]] + at - begin[phrase_at]] * (len(parse) + 2) + after[phrase_at]
    return chosen[np.argsort(key)], starts


def least_ids(texts: list[bytes], ids: np.ndarray, strings: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each of the first strings[i] strings of `width` bytes in texts[i]: the smallest id of a text that has it."""
    order, starts = suffix_order(texts, strings, width)
    whole = np.frombuffer(b"".join(texts) + b"\0" * width, np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    same = np.zeros(len(order), bool)
    for low in range(0, len(order) - 1, 1 << 17):
        a, b = order[low : low + (1 << 17) + 1][:-1], order[low + 1 : low + 1 + (1 << 17)]
        a, equal = a[: len(b)], np.arange(len(b))
        for j in range(0, width, 2):  # both ends first: most neighbours differ near one of them
            for k in {j // 2, width - 1 - j // 2}:
                equal = equal[whole[a[equal] + k] == whole[b[equal] + k]]
        same[low + 1 + equal] = True
    group = np.cumsum(~same) - 1
    least = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(~same)) if len(order) else np.zeros(0, np.int64)
    flat = np.full(len(owner), NO_ID)
    flat[order] = least[group]
    return [flat[s : s + n] for s, n in zip(starts.tolist(), strings.tolist())]


def _compared(t: pa.Table) -> pa.Table:
    """Of one bucket: for the fragments of each part, the smallest id of every string, as runs (their number a fragment, strings a run, ids)."""
    rows = t.to_pylist()
    parts: dict[int, dict[bytes, int]] = {}  # the parts of a bucket share no strings
    least, strings, asked = [], [], []
    for r in rows:
        low, raw = 0, _whole(r["keys"])
        which = []
        for k, n, sub in np.frombuffer(_whole(r["extra"]), "<i8").reshape(-1, 3).tolist():
            text = raw[low : low + n + WIDTH - 1]
            low += len(text)
            i = parts.setdefault(sub, {}).setdefault(text, len(least))
            if i == len(least):
                least.append(k)
                strings.append(n)
            elif k < least[i]:
                least[i] = k
            which.append(i)
        asked.append(np.array(which))
    ids, counts = np.array(least), np.array(strings)
    low = np.cumsum(counts) - counts
    found = np.empty(int(counts.sum()), np.int64)
    some: dict[bytes, int] = {}
    total = 0
    for last, part in enumerate(parts.values(), 1 - len(parts)):
        some |= part
        total += sum(map(len, part))
        if last == 0 or total >= AT_ONCE:
            which = np.array(list(some.values()))
            for i, x in zip(which.tolist(), least_ids(list(some), ids[which], counts[which])):
                found[low[i] : low[i] + len(x)] = x
            some, total = {}, 0
    out = []
    for r, which in zip(rows, asked):
        n = counts[which]
        owner = np.repeat(np.arange(len(which)), n)
        value = found[np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + low[which][owner]]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        out.append((r["bucket"], r["part"], _squeezed(np.diff(first, append=len(owner)).astype("<u4").tobytes()), _squeezed(value[first].astype("<i8").tobytes()), r["places"]))
    return _table(out)


_ANSWER = pa.schema([("name", pa.binary()), ("runs", pa.list_(pa.int32())), ("least", pa.list_(pa.int64()))])


def _answered(t: pa.Table, got: pa.Table) -> pa.Table:
    """Of one part: for every phrase of which a string may go, the smallest ids of its strings, as runs."""
    part = Part(t)
    strings = np.array([len(x) - WIDTH + 1 for x in part.texts])
    found = got.to_pylist()
    joined = lambda column, kind: np.concatenate([np.frombuffer(_whole(r[column]), kind) for r in found] or [np.zeros(0, kind)]).astype(np.int64)
    runs, values, places = joined("keys", "<u4"), joined("extra", "<i8"), joined("places", "<u4").reshape(-1, 3)
    # a run lies in one fragment: it starts in the fragment that holds its first string
    ends = np.cumsum(places[:, 2])
    run_at = np.cumsum(runs) - runs
    owner = np.searchsorted(ends, run_at, side="right")
    phrase = places[owner, 0]
    start = places[owner, 1] + run_at - (ends[owner] - places[owner, 2])
    order = np.lexsort((start, phrase))
    phrase, start, runs, values = phrase[order], start[order], runs[order], values[order]
    out = []
    for a, b in _chunks(strings.tolist(), 1 << 21):
        lo, hi = np.searchsorted(phrase, (a, b))
        base = np.cumsum(strings[a:b]) - strings[a:b]
        least = np.repeat(part.least[a:b], strings[a:b])
        at = np.repeat(base[phrase[lo:hi] - a] + start[lo:hi] - (np.cumsum(runs[lo:hi]) - runs[lo:hi]), runs[lo:hi]) + np.arange(int(runs[lo:hi].sum()))
        least[at] = np.repeat(values[lo:hi], runs[lo:hi])
        owner = np.repeat(np.arange(b - a), strings[a:b])
        wanted = part.several[a:b].copy()
        wanted[owner[least < part.least[a:b][owner]]] = True
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        size, keep = np.diff(first, append=len(owner)), wanted[owner[first]]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[first][keep], minlength=b - a)[wanted])]), pa.int32())
        names = [part.names[i] for i in (a + np.flatnonzero(wanted)).tolist()]
        out.append(pa.Table.from_arrays([pa.array(names, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(size[keep], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(least[first][keep], pa.int64()))], schema=_ANSWER))
    return pa.concat_tables(out) if out else _ANSWER.empty_table()


def _row_key(key: str, text: str):
    """128 bits of a cryptographic hash of id and text: rows of one key have both in common, and so their result."""
    return F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), F.coalesce(F.col(text), F.lit("")).cast("binary")), 256), 1, 32))


def with_ranges(docs: DataFrame, key: str, text: str, block: int = BLOCK, hot: int = HOT, segment: int = SEGMENT) -> tuple[DataFrame, list[DataFrame]]:
    """docs with _cuts, the ranges of strings that go (place, runs, smallest ids), or null; and staged tables to drop after use."""
    rows = docs.select(_row_key(key, text).alias("row"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // block))
    for seed in range(SEEDS):
        # one exchange of phrases by part, which three steps read: none of them is so costly that its result is stored
        own = parsed(rows, seed, segment, n).groupBy("part")
        asked = own.applyInArrow(lambda t: leanly(__name__, _asked, t, n, segment), _SQL)
        found = asked.groupBy("bucket").applyInArrow(lambda t: leanly(__name__, _looked_up, t, hot), _SQL)
        sent = own.cogroup(found.groupBy("part")).applyInArrow(lambda t, f: leanly(__name__, _fragments, t, f, n, segment) if t.num_rows else _ROW.empty_table(), _SQL)
        least = sent.groupBy("bucket").applyInArrow(lambda t: leanly(__name__, _compared, t), _SQL)
        answers = own.cogroup(least.groupBy("part")).applyInArrow(lambda t, g: leanly(__name__, _answered, t, g) if t.num_rows else _ANSWER.empty_table(), "name binary, runs array<int>, least array<bigint>")
        try:
            answers = stage(answers, "answers")
            break
        except PySparkException as e:
            if CLASH not in str(e) or seed + 1 == SEEDS:
                raise
    hits = parsed(rows, seed, segment).join(answers, "name").where(F.exists("least", lambda x: x < F.col("id")))
    ranges = hits.dropDuplicates(["row", "start"]).groupBy("row").agg(F.collect_list(F.struct("start", "runs", "least")).alias("_cuts"))
    keyed = docs.withColumn("_row", _row_key(key, text))
    return keyed.join(ranges.withColumnRenamed("row", "_row"), "_row", "left").drop("_row"), [answers]


def _gone(k: int | None, size: int, cuts: list[dict]) -> np.ndarray:
    """Which bytes of a document go."""
    k = NO_ID if k is None else k
    edge = np.zeros(size + 1, np.int32)
    for c in cuts:
        at = c["start"]
        for n, least in zip(c["runs"], c["least"]):
            if least < k:
                edge[at] += 1
                edge[at + n + WIDTH - 1] -= 1
            at += n
    return np.cumsum(edge[:-1]) > 0


def _kept(raw: bytes, gone: np.ndarray | None) -> bytes:
    return raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes()


def removal_report(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, hot: int = HOT, segment: int = SEGMENT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked, used = with_ranges(rows, "doc_id", "text", block, hot, segment)

    def each(rows):
        for k, t, cuts in rows:
            raw, n, spans, gone = (t or "").encode("utf-8", "surrogatepass"), 0, 0, None
            if cuts:
                gone = _gone(k, len(raw), cuts)
                n, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
            yield k, len(raw), n, spans, hashlib.sha256(_kept(raw, gone)).hexdigest()

    out = stage(map_rows(marked, ["doc_id", "text", "_cuts"], each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "removed")
    for x in used:
        drop_staged(x)
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, hot: int = HOT, segment: int = SEGMENT) -> DataFrame:
    """docs without the repeated bytes, with the columns of docs; characters that lose only some of their bytes go whole."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*own)  # no name can clash
    k, t = (own[docs.columns.index(c)] for c in (key, text))
    marked, used = with_ranges(renamed, k, t, block, hot, segment)
    bound_batches(docs.sparkSession)
    marked = marked.select(*own, "_cuts")

    def run(batches):
        for b in batches:
            texts = []
            for i, raw, cuts in zip(b.column(own.index(k)).to_pylist(), b.column(own.index(t)).to_pylist(), b.column(len(own)).to_pylist()):
                if cuts:
                    raw = raw.encode("utf-8", "surrogatepass")
                    raw = _kept(raw, _gone(i, len(raw), cuts)).decode("utf-8", "ignore")
                texts.append(raw)
            at = own.index(t)
            columns = [pa.array(texts, b.column(at).type) if j == at else b.column(j) for j in range(len(own))]
            yield pa.RecordBatch.from_arrays(columns, own)

    return leaving(marked.mapInArrow(lean(run, __name__), renamed.schema).toDF(*docs.columns), *used)
