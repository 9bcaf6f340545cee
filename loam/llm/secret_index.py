"""Secret scans over a trigram inverted index.

From each rule's regular expression comes a Boolean query over trigrams that every match must hold (in lower case).
Blocks of documents get an inverted index of the trigrams that the queries name; postings are intersected and united,
and only candidate documents are verified with the expression. A rule without mandatory trigrams scans every document.

Defined results: a null text counts as empty and has no spans; ids may be null or repeated, each row is scanned on its
own; an empty table gives an empty table; only id and text are read, so that clashing extra columns don't matter. Texts
are read whole; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from re import _constants as sre, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loam.llm.common import bound_batches, lean, map_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False
    base: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The three base kinds, in order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, False, True),
)
# Published formats of further credentials.
# A rule whose start can repeat is tried at the front of a run of its characters only, so that a text takes linear time.
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"(?<![\w-])(?=[\w-]+\.eyJ[\w-]{8,}\.[\w-]{8})[\w-]*?eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_password", r"(?<![a-z0-9+.-])[0-9+.-]*[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]{6,}@[A-Za-z0-9.-]+"),
)

#: A query is True (any text), a trigram, or ("and" | "or", parts).
Query = bool | bytes | tuple
_MOST = 64  # strings that are followed at once


def conjoined(parts: Iterable[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def united(parts: Iterable[Query]) -> Query:
    kept = list(dict.fromkeys(parts))
    return True if True in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]) -> Query:
    raw = [s.encode() for s in sorted(strings)]
    return united(conjoined(r[i : i + 3] for i in range(len(r) - 2)) for r in raw)


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings that the items match, or None if there are too many; the query)."""
    exact: set[str] = {""}
    parts: list[Query] = []
    whole = True

    def cut():
        nonlocal exact, whole
        parts.append(_of_strings(exact))
        exact, whole = {""}, False

    for op, value in items:
        strings, query = _one(op, value)
        if strings is not None and len(exact) * len(strings) <= _MOST:
            exact = {a + b for a in exact for b in strings}
            continue
        cut()
        if strings is not None:
            exact = strings
        else:
            parts.append(query)
    if whole:
        return exact, _of_strings(exact)
    parts.append(_of_strings(exact))
    return None, conjoined(parts)


def _one(op, value) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, True
    if op is sre.AT:
        return {""}, True
    if op is sre.IN:
        if len(value) <= 8 and all(o is sre.LITERAL for o, _ in value):
            return {chr(v).lower() for _, v in value}, True
        return None, True
    if op is sre.SUBPATTERN:
        return _walk(value[3])
    if op is sre.BRANCH:
        found = [_walk(x) for x in value[1]]
        if all(s is not None for s, _ in found) and len(union := set().union(*(s for s, _ in found))) <= _MOST:
            return union, True
        return None, united(q for _, q in found)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = value
        strings, query = _walk(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        return None, query if low else True
    return None, True


def trigram_query(rule: Rule) -> Query:
    return _walk(_parser.parse(rule.pattern))[1]


def _trigrams(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(_trigrams, query[1]))


class TrigramIndex:
    """Postings of chosen trigrams over a block of texts."""

    STEP = 1 << 20

    def __init__(self, trigrams: Iterable[bytes]):
        self.trigrams = sorted(trigrams)
        self.place = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(self.trigrams):
            self.place[int.from_bytes(t, "big")] = k + 1

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        ends = np.cumsum([len(t) + 2 for t in texts])
        whole = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)
        at, which = [], []
        for low in range(0, len(whole), self.STEP):
            b = whole[low : low + self.STEP + 2].astype(np.uint32)
            code = self.place[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]] if len(b) > 2 else np.zeros(0, np.uint16)
            hit = np.flatnonzero(code)
            which.append(code[hit])
            at.append(np.searchsorted(ends, hit + low, side="right"))
        which, at = np.concatenate(which), np.concatenate(at)
        return {t: np.unique(at[which == k + 1]) for k, t in enumerate(self.trigrams)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings[query]
    parts = sorted((candidates(q, postings, n) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class Scanner:
    BLOCK = 1 << 20  # bytes of text that share an index

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        self.index = TrigramIndex(set().union(*map(_trigrams, self.queries)))

    def block(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, place of the rule, end) of every span of every text, sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index.postings([t.encode("utf-8", "surrogatepass").lower() for t in texts])
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for i in candidates(query, postings, len(texts)).tolist():
                found[i] += [(s, k, e) for s, e in rule.spans(texts[i])]
        return [sorted(x) for x in found]

    def scan(self, texts: Iterable[str | None]):
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= self.BLOCK:
                yield from self.block(held)
                held, size = [], 0
        if held:
            yield from self.block(held)


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def found_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: doc_id, spans array<struct<kind, start, end, base>> by start, then kind as listed."""

    def each(rows):
        held, size = [], 0

        def out():
            for (k, _), spans in zip(held, scanner(rules).block([t for _, t in held])):
                yield k, [{"kind": rules[r].kind, "start": s, "end": e, "base": rules[r].base} for s, r, e in spans]

        for k, t in rows:
            held.append((k, t or ""))
            size += len(held[-1][1])
            if size >= Scanner.BLOCK:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    kind = dict(docs.dtypes)[key]
    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], each, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redacted_text(text: str, spans: list[tuple[int, int, int]], mask: str = "[secret]") -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, with each run of overlapping spans replaced by a mask; null texts stay null."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t if not s else redacted_text(t, s) for t, s in zip(texts, scanner(rules).scan(texts))]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(lean(run, __name__), docs.schema)
