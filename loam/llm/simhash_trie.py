"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Distinct fingerprints form a binary trie. Pairs of its nodes are traversed together; differing bits accumulate, and a
pair is pruned once they exceed the budget. The trie is cut at a depth at which its largest subtree is small; each
pair of subtrees whose prefixes are within the budget is a task of its own, so that every link is found exactly once
without any bucket's cap. A task keeps the links as a spanning forest (a tree has no more edges than fingerprints);
components of all forests are found by distributed stars.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
repeated rows share a fingerprint; null ids are kept and take their component's smallest id, null if it has none; an
empty table gives an empty table; only id and text are read, so that clashing extra columns don't matter. Texts are
read whole.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loam.llm.common import bound_batches, drop_left, drop_staged, lean, leaving, map_rows, stage
from loam.llm.components import component_labels

WIDTH, SEED, BUDGET = 3, 42, 2
#: The trie is cut where no subtree has more fingerprints than this.
SUBTREE = 1 << 16
#: Sketches of near copies: their minima; bands, and minima of each (two texts alike to 0.8 share a band with a chance of
#: 0.98); fingerprints of a band beyond which it is dealt again.
SKETCH, BANDS, ROWS, GROUP = 128, 10, 5, 1 << 14


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(width)))] if len(words) > width else [b" ".join(words)]
    counts = np.zeros(64, np.int64)
    for low in range(0, len(grams), 1 << 16):
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[low : low + (1 << 16)]], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(grams), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: str | None = None, width: int = WIDTH) -> DataFrame:
    """doc_id, fp; and the column that digest names, if any."""

    def each(rows):
        for k, t, *more in rows:
            f = fingerprint(t, width)
            yield k, f - (1 << 64) if f >> 63 else f, *more

    more = [F.col(digest).alias("digest")] if digest else []
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *more)
    return map_rows(rows, rows.columns, each, f"doc_id {dict(docs.dtypes)[key]}, fp long" + (", digest string" if digest else ""))


class Forest:
    """Spanning forest of links between n values, kept as labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            if not len(i):
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def trie_links(v: np.ndarray, split: int | None, depth: int, diff: int, budget: int = BUDGET, batch: int = 1 << 17):
    """Index pairs (arrays i, j) of values that differ in at most budget bits.

    v: sorted distinct uint64 of one subtree (split None), or of two, the second from index split; depth: bits that the
    values of a subtree share; diff: differing bits of the two subtrees' prefixes.
    """
    n = len(v)
    ones: dict[int, np.ndarray] = {}
    start = (0, n, 0, n, 0) if split is None else (0, split, split, n, diff)
    stack = [(63 - depth, tuple(np.array([x]) for x in start))]
    while stack:
        bit, (a0, a1, b0, b1, d) = stack.pop()
        if len(a0) > batch:
            half = len(a0) // 2
            stack += [(bit, tuple(x[:half] for x in (a0, a1, b0, b1, d))), (bit, tuple(x[half:] for x in (a0, a1, b0, b1, d)))]
            continue
        few = ((a1 - a0) * (b1 - b0) <= 16) | (bit < 0)
        if few.any():
            x0, y0, nx, ny = a0[few], b0[few], (a1 - a0)[few], (b1 - b0)[few]
            size = nx * ny
            which = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            i, j = x0[which] + at // ny[which], y0[which] + at % ny[which]
            ok = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            if ok.any():
                yield i[ok], j[ok]
        if few.all():
            continue
        a0, a1, b0, b1, d = (x[~few] for x in (a0, a1, b0, b1, d))
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((v >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        c = ones[bit]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])  # where the ones begin
        same = a0 == b0
        parts = [(a0, am, b0, bm, d, None), (am, a1, bm, b1, d, None), (a0, am, bm, b1, d + 1, None), (am, a1, b0, bm, d + 1, ~same)]
        kept = []
        for p0, p1, q0, q1, e, ok in parts:
            live = (p1 > p0) & (q1 > q0) & (e <= budget)
            if ok is not None:
                live &= ok
            kept.append(tuple(x[live] for x in (p0, p1, q0, q1, e)))
        merged = tuple(np.concatenate(x) for x in zip(*kept))
        if len(merged[0]):
            stack.append((bit - 1, merged))


def _forest_edges(a: int, b: int, raw: np.ndarray, depth: int, budget: int):
    v = np.unique(raw.view(np.uint64))
    split = None if a == b else int(np.searchsorted(v, np.uint64(b << (64 - depth))))
    forest = Forest(len(v))
    for i, j in trie_links(v, split, depth, (a ^ b).bit_count(), budget):
        forest.add(i, j)
    child = np.flatnonzero(forest.label != np.arange(len(v)))
    s = v.view(np.int64)
    return s[child], s[forest.label[child]]


def cut_depth(nodes: DataFrame, subtree: int = SUBTREE) -> int:
    depth = 4
    while depth < 24:
        top = nodes.groupBy(F.shiftrightunsigned("fp", 64 - depth)).count().agg(F.max("count")).first()[0] or 0
        if top <= subtree:
            break
        depth += 4
    return depth


def links(nodes: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE) -> DataFrame:
    """nodes (fp), distinct -> (u, v): a spanning forest of the links of each pair of subtrees."""
    depth = cut_depth(nodes, subtree)
    masks = [sum(1 << x for x in bits) for k in range(budget + 1) for bits in itertools.combinations(range(depth), k)]
    mine = F.shiftrightunsigned("fp", 64 - depth)
    dealt = nodes.select("fp", mine.alias("p"), F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    other = F.col("p").bitwiseXOR(F.col("mask").cast("long"))
    dealt = dealt.select(F.least("p", other).alias("a"), F.greatest("p", other).alias("b"), "fp").repartition("a", "b").sortWithinPartitions("a", "b")
    bound_batches(nodes.sparkSession)

    def run(batches):
        held, now = [], None

        def out():
            u, v = _forest_edges(*now, np.concatenate(held), depth, budget)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            a, b, f = (np.asarray(c) for c in batch.columns)
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if now is not None and now != (int(a[low]), int(b[low])):
                    yield out()
                    held = []
                now = (int(a[low]), int(b[low]))
                held.append(f[low:high].copy())
        if held:
            yield out()

    return dealt.mapInArrow(lean(run, __name__), "u long, v long")


def _labelled(nodes: DataFrame, budget: int, more: DataFrame | None = None) -> DataFrame:
    """nodes (fp, ...), distinct -> the same with label, one of each component of their links (and of more links u, v)."""
    found = links(nodes, budget)
    edges = component_labels(found if more is None else found.union(more))
    labels = edges.withColumnRenamed("node", "fp")
    out = stage(nodes.join(labels, "fp", "left").select(*nodes.columns, F.coalesce("label", "fp").alias("label")), "labelled")
    drop_left(edges)
    return out


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row a document: doc_id, fingerprint, component_id (the smallest id of its component)."""
    prints = stage(fingerprints(docs, key, text), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labelled = _labelled(nodes, budget)
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    member = labelled.join(least, "label").select("fp", "component_id")
    drop_staged(nodes)
    return leaving(prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), prints, labelled)


def _digest(text: str) -> Column:
    """128 bits of SHA-256 of a text; equality of those is trusted."""
    return F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32)


class Sketcher:
    """Minima of the hashes of a text's distinct shingles, under SKETCH orders."""

    MOST = 100_000  # words whose hashes are remembered

    def __init__(self, width: int):
        self.width, self.words = width, {}
        rng = np.random.default_rng(29)
        self.factors = rng.integers(0, 1 << 31, SKETCH).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.powers = rng.integers(0, 1 << 63, width).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def _word(self, w: bytes) -> int:
        if len(self.words) >= self.MOST:
            self.words.clear()
        h = xxhash.xxh64_intdigest(w, SEED)
        if len(w) <= 64:
            self.words[w] = h
        return h

    def minima(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode("utf-8", "surrogatepass").lower().split(), self.words
        each = np.array([known[w] if w in known else self._word(w) for w in words], np.uint64)
        width = min(self.width, len(each))
        n = len(each) - width + 1 if width else 0
        h = np.zeros(max(n, 1), np.uint64)
        for j in range(width):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[j : j + n] * self.powers[j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        small = (h >> np.uint64(32)).astype(np.uint32)
        out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
        for low in range(0, len(small), 1 << 12):
            out = np.minimum(out, (small[None, low : low + (1 << 12)] * self.factors[:, None]).min(1))
        return out


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """rows (doc_id, text, digest) -> doc_id, fp, digest, sketch (the minima, 16 bits each), bands (hashes of some of them)."""

    def each(rows):
        sketcher = Sketcher(width)
        for k, t, digest in rows:
            f, m = fingerprint(t, width), sketcher.minima(t)
            raw = m[: BANDS * ROWS].astype("<u4").tobytes()
            bands = [xxhash.xxh64_intdigest(raw[4 * ROWS * i : 4 * ROWS * (i + 1)], i) for i in range(BANDS)]
            yield k, f - (1 << 64) if f >> 63 else f, digest, (m ^ (m >> np.uint32(16))).astype("<u2").tobytes(), [b - (1 << 64) if b >> 63 else b for b in bands]

    return map_rows(rows.select("doc_id", "text", "digest"), ["doc_id", "text", "digest"], each, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long, digest string, sketch binary, bands array<long>")


def _alike(fps: np.ndarray, parts: np.ndarray, likeness: float):
    """A spanning forest of the pairs of rows of parts that are alike: every row found is compared with those not found yet."""
    left, u, v = np.arange(len(fps)), [], []
    while len(left) > 1:
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            x = open_.pop()
            hit = np.concatenate([(parts[left[low : low + (1 << 15)]] == parts[x]).sum(1) for low in range(0, len(left), 1 << 15)]) >= likeness * parts.shape[1]
            if hit.any():
                found = left[hit]
                u += [int(fps[x])] * len(found)
                v += fps[found].tolist()
                open_ += found.tolist()
                left = left[~hit]
    return u, v


def near_links(prints: DataFrame, likeness: float, group: int = GROUP) -> DataFrame:
    """(u, v): links of fingerprints whose shingle sets have an estimated Jaccard likeness of at least `likeness`.

    Texts that share a band's minima meet; a band that more than `group` fingerprints share is dealt again, by further
    bands of its sketches. Each group gives a spanning forest, never its pairs.
    """
    one = prints.groupBy("fp").agg(F.min(F.struct("sketch", "bands")).alias("s"))  # texts of one fingerprint are linked already
    rows = one.select("fp", "s.sketch", F.explode("s.bands").alias("band"))
    many = rows.groupBy("band").count().where(F.col("count") > group).select("band", F.lit(True).alias("many"))
    finer = F.array(*(F.xxhash64("band", F.lit(i), F.substring("sketch", 2 * ROWS * (BANDS + i) + 1, 2 * ROWS)) for i in range(BANDS)))
    dealt = rows.join(many, "band", "left").select("fp", "sketch", F.explode(F.when(F.col("many"), finer).otherwise(F.array("band"))).alias("band"))
    dealt = dealt.repartition("band").sortWithinPartitions("band", "fp")
    bound_batches(prints.sparkSession)

    def run(batches):
        held, now = [], None

        def out():
            if sum(len(f) for f, _ in held) < 2:
                return None
            u, v = _alike(np.concatenate([f for f, _ in held]), np.concatenate([p for _, p in held]), likeness)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]) if u else None

        for batch in batches:
            f, b = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            parts = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SKETCH)
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if now is not None and now != int(b[low]):
                    if (made := out()) is not None:
                        yield made
                    held = []
                now = int(b[low])
                held.append((f[low:high].copy(), parts[low:high]))
        if held and (made := out()) is not None:
            yield made

    return dealt.select("fp", "sketch", "band").mapInArrow(lean(run, __name__), "u long, v long")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET, width: int = WIDTH, likeness: float | None = None) -> DataFrame:
    """One row of docs for each component, with the columns of docs: that of the smallest id, then of the smallest digest.

    Fingerprints of width words link at budget differing bits, by the trie. That reaches few of the texts that have four
    fifths of their five-word shingles in common (their fingerprints differ in 3 to 17 bits of 64, too many for any
    budget that prunes); with likeness, fingerprints are linked too if the sketches of their shingle sets say so
    (near_links). Rows are told apart by id and text, so that different texts under one id each stay in their own
    component. Rows with a null id are a class of their own: one of them stays in each component too, even beside a row
    with an id.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), _digest(text).alias("digest"))
    prints = stage(fingerprints(rows, digest="digest", width=width) if likeness is None else sketches(rows, width), "fingerprints")
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))).alias("named")
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.col("digest"))).alias("nameless")
    nodes = stage(prints.groupBy("fp").agg(named, nameless), "nodes")
    labelled = _labelled(nodes, budget, None if likeness is None else near_links(prints, likeness))
    least = stage(labelled.groupBy("label").agg(F.min("named").alias("named"), F.min("nameless").alias("nameless")), "least")
    for used in (prints, nodes, labelled):
        drop_staged(used)
    found = least.where("named is not null").select(F.col("named.doc_id").alias("_id"), F.col("named.digest").alias("_stays"))
    found = found.union(least.where("nameless is not null").select(F.lit(None).cast(rows.schema["doc_id"].dataType), "nameless"))
    marked = docs.withColumn("_digest", _digest(text))
    kept = marked.join(found, marked[key].eqNullSafe(found["_id"]) & (marked["_digest"] == found["_stays"]), "left_semi")
    return leaving(kept.dropDuplicates([key, "_digest"]).select(*docs.columns), least)
