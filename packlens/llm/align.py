"""Alignment of two tokenizers over a corpus, counted in bitmaps of documents per pair of ids.

Two token sequences of one text cut its bytes into groups where both end a token; the last tokens of
a group are linked. Each block of documents keeps, per linked pair of ids, a compressed bitmap of its
documents for every binary digit of the number of links (multiplicity planes): entries of a plane, a
word's place and sixteen documents' bits, empty words left out. Parts of a block are OR-merged, the
planes of a word OR-merged and popcounted give the pair's documents, planes popcounted by weight its
links. Popcounts add up over blocks, which share no document. For the scores the bitmaps go back as
posting lists: each block meets the corpus-wide counts of its pairs and adds them up per document.

A text that is null or empty, or whose tokens do not give back space and text byte by byte, has no
tokens. Repeated rows, and rows with a null key, count as documents of their own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from packlens.llm.bpe import byte_letters
from packlens.llm.common import staged

#: Documents of one block and links after which a block is closed; one text may go beyond the latter.
SLOTS = 16_384
BLOCK_POSTINGS = 1_500_000
BATCH_CHARS = 1_500_000
#: The split of the byte-level vocabulary. Fixed value.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SEPARATORS = (b",", b"|", b";", b"")
_GAP = 1 << 17
#: The faster encoder overflows its stack on much longer white space; such texts go to the library of the file.
LONG_SPACE = 2_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)


class Pair:
    """Two tokenizers: A byte-level from a json file, B a model of pieces, which puts a space first."""

    def __init__(self, a_path: str, b_path: str) -> None:
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        names = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items() if all(c in byte for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [model["vocab"][x + y] for x, y in merges] != list(range(256, 256 + len(merges))):
            raise ValueError(f"ids of {a_path} are not in the order of its merges")
        ranks = {names[i]: i for i in range(256 + len(merges))}
        self.a = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.a_len = np.array([len(names.get(i, b"")) for i in range(256 + len(merges))])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        most = max(len(self.a_len), len(pieces))
        if most > _GAP:
            raise ValueError("too many ids")
        # An id followed by each separator, at id + gap * separator.
        self.written = [b""] * (_GAP * len(_SEPARATORS))
        for k, mark in enumerate(_SEPARATORS):
            for i in range(most):
                self.written[k * _GAP + i] = b"%d%s" % (i, mark)

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B; none for texts that do not come back."""
        none = np.empty(0, np.int64)
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        for i, ids in zip(full, self.b.encode([texts[i] for i in full], num_threads=1) if full else [], strict=True):
            spaced = " " + texts[i]
            if b"".join(map(self.b_bytes.__getitem__, ids)) != spaced.encode("utf-8"):
                continue
            plain = len(spaced) < LONG_SPACE or not _LONG_SPACE.search(spaced)
            out_a[i] = np.array(self.a.encode_ordinary(spaced) if plain else self.library.encode(spaced, add_special_tokens=False).ids, np.int64)
            out_b[i] = np.array(ids, np.int64)
        return out_a, out_b

    def align(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, digest of the groups) per text; text, A id and B id of every link."""
        list_a, list_b = self.tokens(texts)
        a, b = np.concatenate([np.empty(0, np.int64), *list_a]), np.concatenate([np.empty(0, np.int64), *list_b])
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        n_bytes = int(end_a[-1]) if len(end_a) else 0
        of_a, of_b = np.zeros(n_bytes + 1, bool), np.zeros(n_bytes + 1, bool)
        of_a[end_a], of_b[end_b] = True, True
        cut_a, cut_b = of_b[end_a], of_a[end_b]
        at_a, at_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        # A group's tokens of A stand before its tokens of B, and all of them before the next group.
        before_b = np.concatenate([[0], at_b + 1])[np.cumsum(cut_a) - cut_a]
        before_a = (at_a + 1)[np.cumsum(cut_b) - cut_b] if len(at_a) else np.empty(0, np.int64)
        coded = np.empty(len(a) + len(b), np.int64)
        coded[np.arange(len(a)) + before_b] = a + np.where(cut_a, _GAP, 0)
        coded[np.arange(len(b)) + before_a] = b + np.where(cut_b, 2 * _GAP, 0)
        n_a, n_b = np.array([len(x) for x in list_a], np.int64), np.array([len(x) for x in list_b], np.int64)
        stop = np.cumsum(n_a + n_b)
        coded[stop[n_a > 0] - 1] += _GAP  # nothing follows the last id of a text
        of_link = np.repeat(np.arange(len(texts)), n_a)[cut_a]
        groups = np.bincount(of_link, minlength=len(texts))
        facts, written, start = [], self.written.__getitem__, 0
        for i, end in enumerate(stop.tolist()):
            digest = hashlib.sha256()
            for at in range(start, end, 1 << 20):
                digest.update(b"".join(map(written, coded[at : min(end, at + (1 << 20))].tolist())))
            facts.append((int(n_a[i]), int(n_b[i]), int(groups[i]), digest.hexdigest() if end > start else ""))
            start = end
        return facts, of_link, a[at_a], b[at_b]


@functools.lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


# ------------------------------------------------------------------ bitmaps

# An entry of 32 bits: plane (5), place of a word (10), bits of sixteen documents (16).
_WORD_BITS = np.uint64(16)


def planes(pair: np.ndarray, slot: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (pair, plane, word) and the bits of documents there; (pair, slot) may come in parts, but once each."""
    keys, bits = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for plane in range(int(times.max()).bit_length() if len(times) else 0):
        on = (times >> plane) & 1 == 1
        keys.append(((pair[on] << 15) | (plane << 10) | (slot[on] >> 4)).astype(np.uint64))
        bits.append(np.uint64(1) << (slot[on] & 15).astype(np.uint64))
    return or_merged(np.concatenate(keys), np.concatenate(bits))


def or_merged(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of equal keys made one by OR, in order of keys."""
    if not len(keys):
        return keys, bits
    order = np.argsort(keys, kind="stable")
    keys, bits = keys[order], bits[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.bitwise_or.reduceat(bits, first)


def _bitmaps(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair, documents, links, entries and their offsets of each pair in a block."""
    keys, bits = or_merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    pair = keys >> np.uint64(15)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    plane = (keys >> np.uint64(10)) & np.uint64(31)
    links = np.add.reduceat(np.bitwise_count(bits).astype(np.int64) << plane.astype(np.int64), first)
    place = (pair << np.uint64(10)) | (keys & np.uint64(1023))
    seen, held = or_merged(place, bits)
    own = seen >> np.uint64(10)
    docs = np.add.reduceat(np.bitwise_count(held).astype(np.int64), np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])))
    entries = (((keys & np.uint64(0x7FFF)) << _WORD_BITS) | bits).astype("<u4")
    return pair[first].astype(np.int64), docs, links, entries, np.append(first, len(entries)).astype(np.int64)


def posted(entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Postings of bitmaps: index of the entry, slot and weight of each set bit, bit by bit."""
    plane, word = (entries >> np.uint32(26)).astype(np.int64), ((entries >> np.uint32(16)) & np.uint32(1023)).astype(np.int64)
    for bit in range(16):
        at = np.flatnonzero((entries >> np.uint32(bit)) & np.uint32(1))
        yield at, word[at] * 16 + bit, np.int64(1) << plane[at]


# ------------------------------------------------------------------ jobs

_PARTS = "block long, slot int, {key} n_a long, n_b long, n_groups long, groups_sha256 string, pair long, docs long, links long, bits binary"


def linked(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents, written once: a row per document (``pair`` null), and per block and linked pair
    its bitmap with its documents and links. ``pair`` is A's id times 2^17 plus B's id."""
    kind = docs.schema[key].dataType.simpleString()
    schema = _PARTS.format(key=f"k {kind},")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, slot, postings, held = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            for at, n in _slices(batch.column(1)):
                while n:
                    take = min(n, SLOTS - slot)
                    facts, of_link, a, b = own.align(batch.column(1).slice(at, take).to_pylist())
                    yield _doc_rows(block, slot, batch.column(0).slice(at, take), facts)
                    # The pairs of a text, counted.
                    code, times = np.unique((of_link << 34) | (a << 17) | b, return_counts=True)
                    if len(code):
                        held.append(planes(code & ((1 << 34) - 1), (code >> 34) + slot, times))
                    slot, at, n, postings = slot + take, at + take, n - take, postings + len(code)
                    if slot >= SLOTS or postings >= BLOCK_POSTINGS:
                        yield from _pair_rows(block, held, batch.schema.field(0).type)
                        block, slot, postings, held = block + 1, 0, 0, []
            kept = batch.schema.field(0).type
        if held:
            yield from _pair_rows(block, held, kept)

    return staged(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(parts, schema), "linked")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of about ``BATCH_CHARS`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t.as_py() or "")
        if size >= BATCH_CHARS:
            yield start, i + 1 - start
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts) - start


_TYPES = [("block", pa.int64()), ("slot", pa.int32()), ("k", None), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
          ("pair", pa.int64()), ("docs", pa.int64()), ("links", pa.int64()), ("bits", pa.binary())]


def _rows(n: int, kind: pa.DataType, given: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays = [given[c] if c in given else pa.nulls(n, t or kind) for c, t in _TYPES]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in _TYPES])


def _doc_rows(block: int, slot: int, keys: pa.Array, facts: list[tuple]) -> pa.RecordBatch:
    n = len(facts)
    columns = dict(zip(("n_a", "n_b", "n_groups"), (pa.array([f[i] for f in facts], pa.int64()) for i in range(3)), strict=True))
    more = {"block": pa.array(np.full(n, block)), "slot": pa.array(np.arange(slot, slot + n, dtype=np.int32)), "k": keys, "groups_sha256": pa.array([f[3] for f in facts], pa.string())}
    return _rows(n, keys.type, columns | more)


def _pair_rows(block: int, held: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    pair, docs, links, entries, offsets = _bitmaps(held)
    for at in range(0, len(pair), 20_000):
        p, o = pair[at : at + 20_000], offsets[at : at + 20_001]
        own = (o - o[0]).astype(np.int32) * 4
        bits = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(own.tobytes()), pa.py_buffer(entries[o[0] : o[-1]].tobytes())])
        yield _rows(len(p), kind, {"block": pa.array(np.full(len(p), block)), "pair": pa.array(p), "docs": pa.array(docs[at : at + 20_000]), "links": pa.array(links[at : at + 20_000]), "bits": bits})


def pair_scores(parts: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best, pair) of every pair of ids linked anywhere: in how many documents, how often,
    and whether no other pair of its B id has more links."""
    counted = staged(parts.filter("pair is not null").groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links")), "pair-counts")
    ids = counted.withColumns({"a": F.shiftright("pair", 17), "b": F.col("pair").bitwiseAND(_GAP - 1)})
    most = ids.groupBy("b").agg(F.max("n_links").alias("most"))
    return ids.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"), "pair")


def document_scores(parts: DataFrame, scores: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document: its links, those
    whose pair is the best of its B id, and the corpus-wide links of their pairs summed over its links."""
    kind = parts.schema["k"].dataType.simpleString()
    lists = parts.filter("pair is not null").select("block", "pair", "bits").join(scores.select("pair", "n_links", "best"), "pair")
    lists = lists.select(F.col("block").alias("of_block"), "n_links", "best", "bits")
    docs = parts.filter("pair is null").select("block", "slot", "k", "n_a", "n_b", "n_groups", "groups_sha256")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        links, best, total = (np.zeros(SLOTS, np.int64) for _ in range(3))
        if right.num_rows:
            bits = right.column("bits").combine_chunks()
            bits = bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits
            width = np.int64 if pa.types.is_large_binary(bits.type) else np.int32
            offsets = np.frombuffer(bits.buffers()[1], width)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
            entries = np.frombuffer(bits.buffers()[2], "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0])
            row = np.repeat(np.arange(len(bits)), np.diff(offsets) // 4)
            count, is_best = right.column("n_links").to_numpy()[row], right.column("best").to_numpy()[row].astype(bool)
            for at, slot, weight in posted(entries):
                np.add.at(links, slot, weight)
                np.add.at(best, slot, weight * is_best[at])
                np.add.at(total, slot, weight * count[at])
        slot = left.column("slot").to_numpy()
        columns = [left.column(c) for c in ("k", "n_a", "n_b", "n_groups")]
        sums = [pa.array(x[slot]) for x in (links, best, total)]
        return pa.Table.from_arrays([*columns, *sums, left.column("groups_sha256")], ["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return docs.groupBy("block").cogroup(lists.groupBy("of_block")).applyInArrow(scored, out).withColumnRenamed("k", key)
