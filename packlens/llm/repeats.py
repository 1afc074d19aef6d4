"""Removal of repeated passages by sliding runs of sentences.

A text is cut into sentences: a word that ends in a full stop, exclamation or question mark ends one,
and so does a line. A stretch of more than ``LONGEST`` words without an end is cut before each word whose
hash is the least among its ``AROUND`` neighbours on either side, so that equal words get equal pieces
wherever they stand, and after ``LONGEST`` words where no such place comes. Every run of consecutive
sentences with at least ``LEAST_WORDS`` words (of pieces of one stretch, with more than ``LONGEST``) is
hashed in its shortest form from each first and to each last sentence; longer runs cover no more than
the shortest ones in them. The hashes of all texts meet in one aggregation: the occurrence of least key,
and within a text the earliest, is the first, and sentences covered by any other are removed. Spelling
counts without case of A-Z and width of white space; words are what ASCII white space separates.

Texts are read once as bytes, a batch at a time. Postings and the ends of all sentences are written to
the shared folder; texts without a cut are not touched again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from packlens.llm.common import staged
from packlens.llm.shingles import mixed

LEAST_WORDS = 20
LONGEST = 24
AROUND = 3
#: Bytes of the texts that are cut at one time; a longer text is cut alone.
BATCH_BYTES = 1 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".!?"))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        full = np.full(max(n, BATCH_BYTES + 1), base, np.uint64)
        full[0] = 1
        _powers[base] = np.cumprod(full, dtype=np.uint64)
    return _powers[base][:n]


def _spans(values: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of ``values[first:end]``, the same wherever the values stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    return (sums[end] - sums[first]) * _power(pow(base, -1, 2**64), len(values) + 1)[first]


class Cut(NamedTuple):
    """Sentences of a batch of texts: words hashed, first words of sentences, and where those lie."""

    words: np.ndarray  # hash of each word
    bounds: np.ndarray  # first word of each sentence, and the number of words
    ends: np.ndarray  # whether a sentence is the last piece of its stretch
    text: np.ndarray  # the text of each sentence
    stop: np.ndarray  # characters of the text up to the sentence's end


def cut(texts: list[bytes]) -> Cut:
    """Sentences of UTF-8 texts; together the sentences of a text are the text, if it has a word."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(size + 1)])  # a line end stands after each text
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, end = edge[::2], edge[1::2]
    words = mixed(_spans(_LOWER[raw] + np.uint64(1), first, end, _STEP) + (end - first).astype(np.uint64))
    text = np.searchsorted(begin, first, "right") - 1
    lines = np.flatnonzero(raw == 10)
    after = np.append(first[1:], len(raw)) if len(first) else first
    last = _STOP[raw[end - 1]] | (np.searchsorted(lines, end) < np.searchsorted(lines, after))
    starts = np.concatenate([[0], np.flatnonzero(last) + 1])[: int(last.sum())]
    length = np.diff(np.append(starts, len(words)))
    if (length > LONGEST).any():
        wide = np.repeat(length > LONGEST, length)
        low = _least(words, text)
        starts = np.unique(np.concatenate([starts, low[wide[low]]]))
        length = np.diff(np.append(starts, len(words)))
        more = (np.maximum(length, 1) - 1) // LONGEST
        starts = np.repeat(starts, more + 1)
        starts = starts + LONGEST * (np.arange(len(starts)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
    own = text[starts] if len(starts) else starts
    # A sentence reaches to the next one's first word, the last one to the end of its text.
    begins = np.append(first[starts], len(raw)) if len(starts) else np.array([len(raw)])
    final = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
    reach = np.where(final, begin[own + 1] - 1, begins[1:])
    if (raw >= 128).any():
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        stop = chars[reach] - chars[begin[own]]
    else:
        stop = reach - begin[own]
    bounds = np.append(starts, len(words)).astype(np.int64)
    return Cut(words, bounds, last[bounds[1:] - 1] if len(starts) else final, own, stop)


def _least(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of words whose hash is below those of the neighbours before and not above those after, in one text."""
    n, r = len(words), AROUND
    if n <= 2 * r:
        return np.empty(0, np.int64)
    own = words[r : n - r]
    found = text[: n - 2 * r] == text[2 * r :]
    for j in range(1, r + 1):
        found &= (own < words[r - j : n - r - j]) & (own <= words[r + j : n - r + j])
    return np.flatnonzero(found) + r


def runs_of(c: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and hash of each shortest run from a first or to a last sentence."""
    words, n = c.bounds, len(c.bounds) - 1
    at, ends = np.arange(n), np.flatnonzero(c.ends)
    # The first stretch's end at or after a first sentence, and the last one before a last sentence.
    after = np.append(ends, 2 * n)[np.searchsorted(ends, at)]
    before = np.append(-1, ends)[np.searchsorted(ends, at)]
    stop = np.minimum(after + 2, np.searchsorted(words, words[:-1] + LONGEST + 1, "left"))
    stop = np.maximum(stop, np.searchsorted(words, words[:-1] + LEAST_WORDS, "left"))
    start = np.maximum(before, np.searchsorted(words, words[1:] - LONGEST - 1, "right") - 1)
    start = np.minimum(start, np.searchsorted(words, words[1:] - LEAST_WORDS, "right") - 1)
    on, back = stop <= n, start >= 0
    first, last = np.concatenate([at[on], start[back]]), np.concatenate([stop[on], at[back] + 1])
    inside = c.text[first] == c.text[last - 1]
    first, last = np.divmod(np.unique(first[inside] * (n + 1) + last[inside]), n + 1)
    a, b = words[first], words[last]
    size = (b - a + ((last - first) << 32)).astype(np.uint64)
    return first, last - first, mixed(_spans(c.words, a, b, _BASE) + size).view(np.int64)


def sentences(text: str | None) -> list[str]:
    """Sentences of a text that together are the text; none for null and empty texts, a blank text comes back whole."""
    stop = cut([(text or "").encode("utf-8", "surrogatepass")]).stop.tolist()
    return [text[a:b] for a, b in zip([0, *stop], stop, strict=False)] or ([text] if text else [])


def runs(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of sentences that are given: first sentence, number of sentences, hash."""
    split = [cut([p.encode("utf-8", "surrogatepass")]) for p in pieces]
    n = np.array([len(s.words) for s in split], np.int64)
    words = np.concatenate([np.empty(0, np.uint64), *[s.words for s in split]])
    ends = np.array([bool(s.words.size) and (p.rstrip()[-1] in ".!?" or "\n" in p) for s, p in zip(split, pieces, strict=True)], bool)
    return runs_of(Cut(words, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), ends, np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)))


def _again(text: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether a run's hash stands earlier in the same text; runs come in order."""
    out = np.zeros(len(hashed), bool)
    key = hashed.view(np.uint64) ^ mixed(text.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    seen = set()
    for i in np.flatnonzero(np.isin(key, twice)).tolist() if len(twice) else []:
        place = (int(text[i]), int(hashed[i]))
        out[i] = place in seen
        seen.add(place)
    return out


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_sentences, n_removed): each row of ``docs`` without sentences covered by a non-first repeat.

    Rows with a null key, and texts without a word, come back as they are; null texts stay null. Rows
    that repeat a key count as one place, so neither is a repeat of the other.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("p", F.xxhash64("k", "t"))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _slices(batch.column(1)):
                yield from _posted(batch.slice(at, n))

    found = staged(source.select("k", "t", "p").mapInArrow(posted, f"k {kind}, p long, h long, span long, ends array<int>, again boolean"), "runs")
    places = found.filter("h is not null")
    meeting = places.filter("not again").select("h", "k", "p", "span")
    repeated = staged(meeting.groupBy("h").agg(F.min("k").alias("origin"), F.max("k").alias("other")).filter("origin < other").select("h", "origin"), "repeated")
    others = meeting.join(repeated, "h").filter(F.col("k") > F.col("origin")).select("k", "p", "span")
    covered = others.unionByName(places.filter("again").select("k", "p", "span")).groupBy("k", "p").agg(
        F.collect_set("span").alias("spans")  # bounded by the sentences of one text
    )
    whole = found.filter("h is null").groupBy("k", "p").agg(F.any_value("ends").alias("ends"))
    kept = staged(_same_row(whole, covered).select("k", "p", "ends", "spans").mapInArrow(_kept, f"k {kind}, p long, kept array<struct<a:int,b:int>>, n_sentences long, n_removed long"), "kept")
    joined = _same_row(source, kept).select("k", "t", "kept", "n_sentences", "n_removed")
    cleaned = joined.mapInArrow(_cleaned, f"k {kind}, t string, n_sentences long, n_removed long")
    return cleaned.withColumnsRenamed({"k": key, "t": text})


def _same_row(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the facts of the same key and text."""
    facts = facts.withColumnsRenamed({"k": "_k", "p": "_p"})
    return rows.join(facts.hint("shuffle_hash"), (rows["p"] == facts["_p"]) & rows["k"].eqNullSafe(facts["_k"]), "left")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of about ``BATCH_BYTES``."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if size and size + n > BATCH_BYTES:
            yield start, i - start
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts) - start


def _posted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row for each text with the ends of its sentences, and one for each of its runs if its key is not null."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary()
    c = cut([t or b"" for t in batch.column(1).cast(kind).to_pylist()])
    n = len(batch)
    offsets = np.searchsorted(c.text, np.arange(n + 1)).astype(np.int32)
    ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.stop.astype(np.int32)))
    none = pa.nulls(n, pa.int64())
    names = ["k", "p", "h", "span", "ends", "again"]
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), none, none, ends, pa.nulls(n, pa.bool_())], names)
    first, length, hashed = runs_of(c)
    of = c.text[first]
    keyed = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)[of] if len(of) else np.zeros(0, bool)
    first, length, hashed, of = first[keyed], length[keyed], hashed[keyed], of[keyed]
    again, span = _again(of, hashed), ((first - offsets[of]) << 20) | length
    rows = pa.array(of)
    columns = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(hashed), pa.array(span), pa.nulls(len(of), ends.type), pa.array(again)]
    for at in range(0, len(of), 1 << 16):
        yield pa.RecordBatch.from_arrays([x.slice(at, 1 << 16) for x in columns], names)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of characters that stay, for each text with a cut; counts for all texts."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        kept, total, removed = [], [], []
        for ends, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            gone = np.zeros(len(ends) + 1, np.int64)
            for s in spans or ():
                gone[s >> 20] += 1
                gone[(s >> 20) + (s & 0xFFFFF)] -= 1
            out = np.cumsum(gone)[:-1] > 0
            total.append(len(ends))
            removed.append(int(out.sum()))
            bounds = np.concatenate([[0], ends]).astype(np.int64)
            edge = np.flatnonzero(np.diff(~out, prepend=False, append=False)).reshape(-1, 2)
            kept.append([{"a": a, "b": b} for a, b in bounds[edge].tolist()] if removed[-1] else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, kind), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["k", "p", "kept", "n_sentences", "n_removed"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a cut put together from what stays; other texts pass as they are."""
    for batch in batches:
        text, total, removed = batch.column(1), pc.fill_null(batch.column(3), 0), pc.fill_null(batch.column(4), 0)
        hit = pc.greater(removed, 0)
        at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
        if len(at):
            few = pa.array(at)
            new = ["".join([t[r["a"] : r["b"]] for r in kept]) for t, kept in zip(text.take(few).to_pylist(), batch.column(2).take(few).to_pylist(), strict=True)]
            text = pc.replace_with_mask(text, hit, pa.array(new, text.type))
        yield pa.RecordBatch.from_arrays([batch.column(0), text, total, removed], ["k", "t", "n_sentences", "n_removed"])
