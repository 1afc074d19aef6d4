"""Byte-pair encoding of words in batched numpy merge rounds, and decoding.

The vocabulary file is of the kind that lower-cases, splits at a pattern, drops white space and ends
words by a suffix. New words of a batch lie as symbols in one flat array. In each round every word
merges its pair of lowest rank, wherever it occurs, left to right; ranks are found by binary search
over the sorted pair keys, and only pairs beside a merge are looked up again. A finished word leaves
the array. Encoded words are kept up to a bound, so that a frequent word is merged once per worker.

Null and empty texts have no ids. The strings of special tokens inside a text count as those tokens.
Texts of any length are split and digested in pieces of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, functions as F
from tokenizers import Tokenizer

#: Words in one piece of a text, characters of one batch, and encoded words a worker keeps.
PIECE_WORDS = 200_000
BATCH_CHARS = 2_000_000
KNOWN_WORDS = 400_000
#: Longer words are merged one pair at a time from a heap: their rounds would each pass over all of the word.
LONG_WORD = 20_000
_NEVER = np.int64(2**62)


class Merges:
    """Ranks of symbol pairs as sorted keys, and the symbol each pair becomes."""

    def __init__(self, pairs: list[tuple[int, int, int]], symbols: int) -> None:
        """``pairs``: (left, right, merged) by rank. A merged symbol may only take part in later ranks."""
        table = np.array(pairs, np.int64).reshape(-1, 3)
        born = np.full(symbols, -1, np.int64)
        rank = np.arange(len(table))
        born[table[:, 2]] = rank
        if (born[table[:, :2]] >= rank[:, None]).any():
            raise ValueError("a pair ranks before one of its symbols")
        key = table[:, 0] * symbols + table[:, 1]
        order = np.argsort(key)
        self.symbols, self.key, self.rank, self.to = symbols, key[order], rank[order], table[:, 2][np.argsort(rank)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NEVER`` where there is none."""
        if not len(self.key):
            return np.full(len(left), _NEVER)
        key = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NEVER)

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of ``sizes`` symbols (at least one each) after all merges: flat symbols and sizes."""
        done_word, done_symbol = [], []
        word = np.repeat(np.arange(len(sizes)), sizes)
        for w in np.flatnonzero(sizes > LONG_WORD):
            one = self._one_by_one(symbols[word == w].tolist())
            done_word.append(np.full(len(one), w))
            done_symbol.append(np.array(one, np.int64))
        short = sizes[word] <= LONG_WORD
        symbol, word = symbols[short].astype(np.int64), word[short]
        rank = self._beside(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            over = least == _NEVER
            if over.any():
                done_word.append(word[over])
                done_symbol.append(symbol[over])
                symbol, word, rank, least = symbol[~over], word[~over], rank[~over], least[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == least)
            # In a row of overlapping occurrences every second one merges.
            begins = np.concatenate([[True], np.diff(hit) != 1])
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            symbol[hit] = self.to[rank[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            new = (np.cumsum(stay) - 1)[hit]
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            near = np.concatenate([new, new[new > 0] - 1])
            rank[near] = self._beside(symbol, word, near)
        word, symbol = np.concatenate([*done_word, word]), np.concatenate([*done_symbol, symbol])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(sizes))

    def _beside(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at ``at``; none at the end of a word."""
        out = np.full(len(at), _NEVER)
        inner = np.flatnonzero(at + 1 < len(symbol))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        left = at[inner]
        out[inner] = self.ranks(symbol[left], symbol[left + 1])
        return out

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """The same merges for one long word, from a heap of (rank, place)."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (r := known.get((a, b))) is None:
                r = known[a, b] = int(self.ranks(np.array([a]), np.array([b]))[0])
            return r

        heap = [(rank(symbols[i], symbols[i + 1]), i, symbols[i], symbols[i + 1]) for i in range(n - 1)]
        heap = [h for h in heap if h[0] < _NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = int(self.to[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    x, y = symbols[left], symbols[after[left]]
                    if (r := rank(x, y)) < _NEVER:
                        heapq.heappush(heap, (r, left, x, y))
        return [s for s in symbols if s >= 0]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class WordTokenizer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, split = held["model"], held["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in held["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or not model["end_of_word_suffix"] or held["decoder"]:
            raise ValueError(f"{path} is no vocabulary of words with an end mark")
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], len(self.names))
        self._inner = np.array([vocab[c] for c in letters], np.int64)
        self._last = np.array([vocab[c + end] for c in letters], np.int64)
        self._byte = {c: b for b, c in enumerate(letters)}
        self._words = regex.compile(split["pattern"]["Regex"])
        self._marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._library = Tokenizer.from_file(path)
        self._settled: set[str] = set(map(chr, range(128)))
        self._known: dict[str | bytes, int] = {}
        self._flat, self._start = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
        self._tables()

    def _tables(self) -> None:
        self._ids, self._starts = np.concatenate(self._flat), np.concatenate(self._start)
        self._flat, self._start = [self._ids], [self._starts]

    def _alike(self, text: str) -> bool:
        """Whether Python's tables and the library's agree on all characters: assigned in both, with the same place among marks."""
        new = set(text) - self._settled
        if all(unicodedata.category(c) != "Cn" and (not unicodedata.combining(c) or self._same_order(c)) for c in new):
            self._settled |= new
            return True
        return False

    def _same_order(self, mark: str) -> bool:
        # Before a mark of the highest class, and after one of the lowest.
        probes = [f"a\u0345{mark}", f"a{mark}\u0334"]
        return all(self._library.normalizer.normalize_str(p) == unicodedata.normalize("NFC", p).lower() for p in probes)

    def pieces(self, text: str | None) -> Iterator[list[str | bytes]]:
        """Words of a text, in lists of bounded size; the strings of special tokens stand for themselves."""
        for k, part in enumerate(self._marks.split(text) if text else []):
            if k % 2:
                yield [part]
            elif part and (part.isascii() or self._alike(part)):
                # The library lower-cases letter by letter, so a sigma has one small form.
                plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                if len(plain) < PIECE_WORDS:
                    yield self._words.findall(plain)
                else:
                    found = (m.group() for m in self._words.finditer(plain))
                    while words := list(islice(found, PIECE_WORDS)):
                        yield words
            elif part:
                split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part))
                yield [bytes(self._byte[c] for c in w) for w, _ in split]

    def _learn(self, new: list[str | bytes]) -> None:
        """Encodes words that are not known yet."""
        raw = [w if isinstance(w, bytes) else w.encode("utf-8") for w in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        held = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self._inner[held]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self._last[held[ends]]
        symbols, sizes = self.merges.merged(symbols, sizes)
        marks = [k for k, w in enumerate(new) if w in self.special]
        at = len(self._starts) - 1
        self._known.update(zip(new, range(at, at + len(new)), strict=True))
        self._flat.append(symbols)
        self._start.append(self._starts[-1] + np.cumsum(sizes))
        self._tables()
        for k in marks:
            self._known[new[k]] = -1 - self.special[new[k]]

    def encode(self, lists: list[list[str | bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of words one after another, and how many each list has."""
        if len(self._known) > KNOWN_WORDS:
            self._known.clear()
            self._flat, self._start = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
            self._tables()
        known = self._known
        new = list({w for words in lists for w in words if w not in known})
        if new:
            self._learn(new)
        n = [len(words) for words in lists]
        word = np.fromiter((known[w] for words in lists for w in words), np.int64, sum(n))
        mark = word < 0
        own = np.where(mark, 0, word)
        size = np.where(mark, 1, self._starts[own + 1] - self._starts[own]) if len(self._starts) > 1 else np.ones(len(word), np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self._starts[own] - (ends - size), size)
        ids = self._ids[np.minimum(place, len(self._ids) - 1)] if len(self._ids) else np.zeros(total, np.int64)
        if mark.any():
            ids[(ends - size)[mark]] = -1 - word[mark]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> str:
        """The names of the ids with a space between; numbers that are no ids are left out."""
        names = self.names
        return " ".join([names[i] for i in ids.tolist() if 0 <= i < len(names) and names[i]])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _encoded(own: WordTokenizer, texts: list[str | None]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(text, whether it is its last piece, ids), several short texts at a time."""
    held: list[tuple[int, bool, list]] = []
    size = 0

    def flush() -> Iterator[tuple[int, bool, np.ndarray]]:
        ids, n = own.encode([h[2] for h in held])
        for (i, last, _), part in zip(held, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            yield i, last, part

    for i, text in enumerate(texts):
        for words in own.pieces(text):
            held.append((i, False, words))
            size += len(words)
            if size >= PIECE_WORDS:
                yield from flush()
                held, size = [], 0
        held.append((i, True, []))
    if held:
        yield from flush()


def encode(text: Column, path: str) -> Column:
    """Ids of each text as array<int>; an empty array for null and empty texts."""

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[np.ndarray]] = [[] for _ in texts]
            for i, _, ids in _encoded(tokenizer(path), [t if isinstance(t, str) else None for t in texts]):
                out[i].append(ids)
            yield pd.Series([np.concatenate(o).astype(np.int32) for o in out], dtype=object)

    return ids_of(text)


def decode(ids: Column, path: str) -> Column:
    """The text that the names of the ids give; empty for null, null ids are left out."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([tokenizer(path).decode(np.array(r, np.int64)) if r is not None else "" for r in rows], dtype=object)

    return text_of(F.transform(ids, lambda i: F.coalesce(i, F.lit(-1))))


def digests(text: Column, path: str) -> Column:
    """Each text encoded and decoded again: struct of n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit numbers) and decoded_sha256 (UTF-8). Ids and texts do not leave the task."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = tokenizer(path)
            rows, n, coded, plain = [], 0, hashlib.sha256(), hashlib.sha256()
            for _, last, ids in _encoded(own, [t if isinstance(t, str) else None for t in texts]):
                if len(ids):
                    coded.update(ids.astype("<u4").tobytes())
                    plain.update(((" " if n else "") + own.decode(ids)).encode("utf-8"))
                    n += len(ids)
                if last:
                    rows.append((n, coded.hexdigest(), plain.hexdigest()))
                    n, coded, plain = 0, hashlib.sha256(), hashlib.sha256()
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest.asNondeterministic()(text)
