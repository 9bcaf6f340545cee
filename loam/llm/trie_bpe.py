"""BPE encoding and decoding by prefix-sharing trie traversal.

The last token of a prefix's encoding determines the rest: of all vocabulary tokens that end a prefix, exactly one
may follow the last token of what precedes it (two tokens may stand side by side if encoding their joined symbols
gives the two again). Distinct words go into a trie of symbols; a depth-first traversal hands the last-token states
down, so that the encoding of a prefix shared by many words is computed once.

Defined results: a null text counts as empty and has no tokens; ids may be null or repeated; an empty table gives
an empty table; only id and text are read, so that clashing extra columns don't matter. Texts are read whole; a word
of n symbols takes time in proportion to n.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from loam.llm.common import kept, map_rows

_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class TrieEncoder:
    """Encodes words (strings of the vocabulary's symbols) with an end-of-word suffix on the last symbol."""

    PAIRS = 1_000_000  # pairs of tokens whose standing side by side is remembered

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = "</w>"):
        self.vocab, self.suffix = vocab, suffix
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, made))
            self.parts.setdefault(made, (vocab[a], vocab[b]))
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(suffix)}
        self.final = {t[: -len(suffix)]: i for t, i in vocab.items() if t.endswith(suffix)}
        self.longest = max(map(len, (*self.inner, *self.final)))
        self._symbols: dict[int, tuple[int, ...]] = {}
        self._side: dict[int, bool] = {}
        self._sound: dict[int, bool] = {}

    def symbols(self, token: int) -> tuple[int, ...]:
        if token not in self._symbols:
            p = self.parts.get(token)
            self._symbols[token] = self.symbols(p[0]) + self.symbols(p[1]) if p else (token,)
        return self._symbols[token]

    def merged(self, ids: list[int]) -> list[int]:
        """Plain BPE of a few symbols."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.pairs[ids[i], ids[i + 1]][1]]
        return ids

    def sound(self, token: int) -> bool:
        if token not in self._sound:
            self._sound[token] = self.merged(self.symbols(token)) == [token]
        return self._sound[token]

    def side_by_side(self, a: int, b: int) -> bool:
        return self.merged(self.symbols(a) + self.symbols(b)) == [a, b]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The encoding of each distinct word.

        The trie is held as its words in depth-first order: a word shares the states of as many symbols as it has in
        common with the word before it.
        """
        out: dict[str, list[int]] = {}
        if len(self._side) > self.PAIRS:
            self._side.clear()
        last, start = [-1], [0]  # by depth: the last token of the current path's first symbols, and where it starts
        inner, final, side, longest, before = self.inner, self.final, self._side, self.longest, ""
        for w in sorted(set(words)):
            n, depth = len(w), 0
            for a, b in zip(before, w):
                if a != b:
                    break
                depth += 1
            depth = min(depth, n - 1, len(last) - 1)
            del last[depth + 1 :], start[depth + 1 :]
            for d in range(depth + 1, n + 1):
                known = inner if d < n else final
                for at in range(d - 1, max(d - longest, 0) - 1, -1):
                    token = known.get(w[at:d])
                    if token is not None:
                        if at:
                            pair = last[at] << 20 | token
                            fits = side.get(pair)
                            if fits is None:
                                fits = side[pair] = self.side_by_side(last[at], token)
                        else:
                            fits = self.sound(token)
                        if fits:
                            break
                else:
                    raise ValueError(f"no token of the vocabulary ends {w[:d]!r}")
                if d < n:
                    last.append(token)
                    start.append(at)
            ids = [token]
            while at:
                ids.append(last[at])
                at = start[at]
            ids.reverse()
            out[w] = ids
            before = w
        return out


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself where it can be printed, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TextEncoder:
    """Encodes whole texts as the tokenizers library does with the same file, and decodes ids.

    Normalizing and splitting of texts outside ASCII and Latin-1 letters is left to the library's own normalizer and pre-tokenizer; the
    words that come out are encoded by TrieEncoder.
    """

    CACHED = 500_000  # pieces between white space that a worker remembers, with their encodings
    CHARACTERS = 8_000_000  # of those pieces: texts without spaces must not pile up

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        raw = json.loads(open(path, encoding="utf-8").read())
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.words = TrieEncoder(raw["model"]["vocab"], (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]), raw["model"]["end_of_word_suffix"])
        self.tokens = {i: t for t, i in raw["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._plain = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
        self._split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")  # the file's pattern over lower-case ASCII and Latin-1 letters
        self._bytes = {b: c for b, c in byte_symbols().items()}
        self.cache: dict[str, tuple[bytes, bytes]] = {}  # ids in decimal, and decoded
        self.known: dict[str, tuple[bytes, bytes]] = {}  # the same of words
        self.held = 0  # characters of what both remember

    def split(self, piece: str) -> list[str | int]:
        """Words, as strings of byte symbols, and ids of special tokens."""
        out: list[str | int] = []
        for part in self._special.split(piece) if "<|" in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
            elif self._plain.fullmatch(part):
                part = part.lower()
                words = [part] if part.isalpha() else self._split.findall(part)
                out += words if part.isascii() else [w.encode().decode("latin-1").translate(self._bytes) for w in words]
            else:
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def _form(self, ids: list[int]) -> tuple[bytes, bytes]:
        return " ".join(map(str, ids)).encode(), " ".join(self.tokens[i] for i in ids).encode()

    def learn(self, pieces: Iterable[str]) -> None:
        new = {p for p in pieces if p not in self.cache}
        if not new:
            return
        if len(self.cache) + len(new) > self.CACHED:
            self.cache.clear()
        if len(self.known) > self.CACHED:
            self.known.clear()
        self.held += sum(map(len, new))
        split = {p: self.split(p) for p in new}
        for w, ids in self.words.encode_words(w for ws in split.values() for w in ws if isinstance(w, str) and w not in self.known).items():
            self.known[w] = self._form(ids)
        for p, ws in split.items():
            forms = [self.known[w] if isinstance(w, str) else self._form([w]) for w in ws]
            self.cache[p] = forms[0] if len(forms) == 1 else (b" ".join([f[0] for f in forms]), b" ".join([f[1] for f in forms]))

    def encoded(self, texts: list[str]) -> Iterable[tuple[bytes, bytes]]:
        """(ids in decimal, decoded text) of each text; both joined by one space."""
        split = [_SPACE.split(t) for t in texts]
        todo = set().union(*split) if split else set()
        held = self.cache
        if self.held > self.CHARACTERS:
            held.clear()
            self.known.clear()
            self.held = 0
        elif len(held) + len(todo) > self.CACHED:
            held.clear()
        self.learn(todo)
        for ps in split:
            forms = [f for p in ps if (f := held[p])[0]]
            yield b" ".join([f[0] for f in forms]), b" ".join([f[1] for f in forms])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(iter(self.encoded([text])))[0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


def encoder(path: str) -> TextEncoder:
    return kept(path, lambda: TextEncoder(path))


def _mapped(docs: DataFrame, path: str, key: str, text: str, form, columns: str) -> DataFrame:
    def each(rows):
        held, size = [], 0

        def out():
            for (k, _), (ids, decoded) in zip(held, encoder(path).encoded([t for _, t in held])):
                yield k, *form(ids, decoded)

        for k, t in rows:
            held.append((k, t or ""))
            size += len(held[-1][1])
            if size >= 1 << 20:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], each, f"doc_id {dict(docs.dtypes)[key]}, {columns}", 500)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, ids array<int>, decoded string."""
    return _mapped(docs, path, key, text, lambda ids, decoded: ([int(x) for x in ids.split()], decoded.decode()), "ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _mapped(docs, path, key, text, lambda ids, decoded: (ids.count(b" ") + bool(ids), sha(ids), sha(decoded)), "n_tokens long, ids_sha256 string, decoded_sha256 string")
