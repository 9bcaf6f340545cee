"""Quality rules as a short-circuit cascade.

Every rule rejects documents. Its cost (seconds a document) and selectivity (share rejected) are estimated on
a bounded sample, and the rules run in descending order of rejection per cost; a document stops at the first
rule that rejects it. The verdict is a conjunction, so the estimated order changes the work, never the result.

Defined results: a null text counts as empty; empty texts have no words and are rejected by `words`; ties and
repeated rows are judged each on their own; an empty table gives an empty table; columns other than the text are
carried through untouched, whatever their names. Whole texts are read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loam.llm.common import filter_rows, map_rows

#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000

_SYMBOLS = "#*$%&|<>"
_NOT_SYMBOL = re.compile(f"[^{re.escape(_SYMBOLS)}]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_NOT_UPPER, _NOT_LETTER = re.compile(r"[^A-Z]+"), re.compile(r"[^A-Za-z]+")


class Features:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._kept: dict = {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        value = getattr(self, "_" + name)()
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # ASCII white space only

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        t = self.text
        return len(t) - sum(t.count(c) for c in " \t\n\x0b\x0c\r")

    def _n_symbols(self) -> int:
        return sum(self.text.count(c) for c in _SYMBOLS)

    def _n_lines(self) -> int:
        return len(self.lines)

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_upper(self) -> int:
        return len(_NOT_UPPER.sub("", self.text))

    def _n_letters(self) -> int:
        return len(_NOT_LETTER.sub("", self.text))

    def _n_repeat_words(self) -> int:
        return repeat_words(self.words)


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        key = key * len(known) + ids[k : n + k]
        if k + 1 < width:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


#: A rule is true for texts that it rejects.
RULES: dict[str, Callable[[Features], bool]] = {
    "words": lambda x: x.n_words < 50,
    "repeats": lambda x: 100 * x.n_repeat_words > 50 * x.n_words,
    "symbols": lambda x: 10 * x.n_symbols > x.n_words,
    "shouting": lambda x: 2 * x.n_upper > x.n_letters,
    "lines": lambda x: 2 * x.n_dup_lines > x.n_lines,
    "word_length": lambda x: not 2 * x.n_words <= x.word_chars <= 25 * x.n_words,
}


def measure(docs: DataFrame, text: str = "text", rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """(seconds a document, share rejected) of each rule, on at most sample_rows documents."""
    names = list(rules)

    def each(rows):
        cost, rejected, n = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0), 0
        for (t,) in rows:
            n += 1
            for name in names:
                began = time.perf_counter()
                rejected[name] += rules[name](Features(t))
                cost[name] += time.perf_counter() - began
        return [(name, cost[name], rejected[name], n) for name in names]

    total = docs.select(F.lit(1)).count()
    some = docs.select(F.col(text).alias("text"))
    if total > sample_rows:
        some = some.where(F.pmod(F.xxhash64("text"), F.lit(total // sample_rows)) == 0).limit(sample_rows)
    found = map_rows(some, ["text"], each, "name string, cost double, rejected long, n long").groupBy("name").agg(*(F.sum(c).alias(c) for c in ("cost", "rejected", "n"))).collect()
    return {r.name: (r.cost / max(r.n, 1), r.rejected / max(r.n, 1)) for r in found}


def ordered(measured: dict[str, tuple[float, float]], rules: dict = RULES) -> list[str]:
    """Rule names by rejection per cost, highest first; rules that were not measured come last."""
    return sorted(rules, key=lambda k: -measured[k][1] / max(measured[k][0], 1e-9) if k in measured else 1)


def first_rejection(x: Features, order: list[str], rules: dict = RULES) -> str | None:
    return next((k for k in order if rules[k](x)), None)


def passing(docs: DataFrame, text: str = "text", rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    order = ordered(measure(docs, text, rules, sample_rows), rules)
    return filter_rows(docs, text, lambda texts: [first_rejection(Features(t), order, rules) is None for t in texts])


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a document: key, base statistics, kept, and the rule that rejected it first (null: none)."""
    order = ordered(measure(docs, text, rules, sample_rows), rules)

    def each(rows):
        for k, t in rows:
            x = Features(t)
            why = first_rejection(x, order, rules)
            yield k, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, why is None, why

    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], each, f"doc_id {dict(docs.dtypes)[key]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, kept boolean, rejected_by string")
