"""Splitting texts into overlapping chunks, row by row and without a shuffle."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from packlens.functions.text import few_at_once
from packlens.settings import CHUNK_OVERLAP, CHUNK_SIZE

CHUNKS = "array<struct<start:int,chunk:string>>"


def fixed_chunks(documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of ``size`` characters, each repeating the last ``overlap`` of the one before.

    The text is cut once into pieces of the stride; a chunk is a piece with the head of those that
    follow, so a text costs time in proportion to its length.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    stride = size - overlap
    more = -(-size // stride)  # pieces that a chunk reaches into
    length = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((length - overlap) / F.lit(float(stride))).cast("int") - 1)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    cut = documents.where(length > 0).withColumns({"_last": last}).withColumn("_pieces", F.explode(F.array(pieces)))
    chunks = F.transform(
        F.sequence(F.lit(0), F.col("_last")),
        lambda i: F.struct(
            (i * stride).alias("start"), F.substring(F.array_join(F.slice("_pieces", i + 1, F.lit(more)), ""), 1, size).alias("chunk")
        ),
    )
    return _one_each(cut.withColumn("_chunks", chunks).drop("_last", "_pieces"))


def boundary_chunks(documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of at most ``size`` characters that end at a paragraph, a line or a word.

    A chunk ends after the last blank line in the second half of its window, else the last
    line end there, else the last space, else at the full size. The next one starts at most
    ``overlap`` characters before that end, at the first word start in the overlap. Each step
    looks at one window only, so a text costs time in proportion to its length.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be below half the size")

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return cut_batches(batches, lambda t: boundary_spans(t, size, overlap))

    return _one_each(documents.where(F.length(text) > 0).withColumn("_chunks", F.pandas_udf(cut, CHUNKS)(F.col(text))))


def cut_batches(batches: Iterator[pd.Series], spans: Callable[[str], Iterator[tuple[int, int]]]) -> Iterator[pd.Series]:
    """The chunks of each text of the batches; those of a few texts are held at once."""
    for batch in batches:
        for texts in few_at_once(batch):
            yield pd.Series([[{"start": s, "chunk": t[s:e]} for s, e in spans(t)] for t in texts], dtype=object)


def boundary_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk of ``boundary_chunks``."""
    position, half = 0, size // 2
    while position < len(text):
        end = min(len(text), position + size)
        if end < len(text):
            for separator in ("\n\n", "\n", " "):
                found = text.rfind(separator, position + half, end)
                if found >= 0:
                    end = found + len(separator)
                    break
        yield position, end
        if end >= len(text):
            return
        position = end - overlap
        gaps = [g for g in (text.find(s, position, end) for s in " \n") if g >= 0]
        gap = min(gaps) - position + 1 if gaps else 0
        if 1 <= gap < overlap:
            position += gap


# Where a text is cut, the coarsest first; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_chunks(documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of at most ``size`` characters, merged from pieces between the coarsest separators that do.

    A text is cut at its coarsest separator; pieces of ``size`` or more are cut again at the next
    one. Pieces are merged up to ``size``; a chunk starts with the last pieces of the one before, up
    to ``overlap`` characters. Chunks lose white space at both ends. Blank texts give none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return cut_batches(batches, lambda t: recursive_spans(t, size, overlap))

    rows = documents.where(F.length(text) > 0).withColumn("_chunks", F.pandas_udf(cut, CHUNKS)(F.col(text)))
    return _one_each(rows).where(F.col("chunk").isNotNull())


def recursive_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk of ``recursive_chunks``."""
    reached = 0
    for start, end in _merged_pieces(text, 0, len(text), SEPARATORS, size, overlap):
        inner = text[start:end]
        start += len(inner) - len(inner.lstrip())
        end = start + len(inner.strip())
        if end > max(start, reached):  # else it repeats the overlap and white space alone
            yield start, end
            reached = end


def _merged_pieces(text: str, start: int, end: int, separators: tuple[str, ...], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of one part of the text: runs of short pieces are merged, long pieces are cut further."""
    while len(separators) > 1 and text.find(separators[0], start, end) < 0:
        separators = separators[1:]
    short: list[tuple[int, int]] = []
    for piece in _pieces(text, start, end, separators[0]):
        if piece[1] - piece[0] < size or len(separators) == 1:
            short.append(piece)
            continue
        yield from _merged(short, size, overlap)
        short = []
        yield from _merged_pieces(text, *piece, separators[1:], size, overlap)
    yield from _merged(short, size, overlap)


def _pieces(text: str, start: int, end: int, separator: str) -> Iterator[tuple[int, int]]:
    """The part cut before each separator."""
    if not separator:
        yield from ((i, i + 1) for i in range(start, end))
        return
    at = start
    while (found := text.find(separator, at + len(separator) if at > start or text.startswith(separator, start) else start, end)) >= 0:
        yield at, found
        at = found
    if end > at:
        yield at, end


def _merged(pieces: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    held: deque[tuple[int, int]] = deque()
    for piece in pieces:
        if held and piece[1] - held[0][0] > size:
            yield held[0][0], held[-1][1]
            while held and (held[-1][1] - held[0][0] > overlap or piece[1] - held[0][0] > size):
                held.popleft()
        held.append(piece)
    if held:
        yield held[0][0], held[-1][1]


def _one_each(rows: DataFrame) -> DataFrame:
    """One row for each of the ``_chunks``."""
    # The outer form keeps the optimizer from computing the chunks twice, once as a filter.
    return (
        rows.withColumn("_chunk", F.explode_outer("_chunks"))
        .withColumns({"start_index": F.col("_chunk.start"), "chunk": F.col("_chunk.chunk")})
        .drop("_chunk", "_chunks")
    )
