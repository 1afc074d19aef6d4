"""Near-duplicate groups by an inverted join of signature coordinates.

1. Texts with the same shingle set form a class; from here on a class has one representative, so
   copies never meet each other.
2. A class's min-hash signature has ``COORDINATES`` coordinates. It is posted under the (coordinate,
   value) pairs of its prefix. Lists of one class are skipped. The other lists are cut into blocks
   and each two blocks of a list meet in one task, which counts the coordinates in which two
   signatures agree and joins those with at least ``matches(percent)``. A task returns a spanning forest,
   never its pairs. What is connected this way is a family.
3. In a family, again cut into blocks, whole shingle sets are compared exactly: each two sets meet
   in one task, through products of incidence matrices. A spanning forest of the confirmed links
   leaves each task, and connected components of these give the result.

A pair at the threshold agrees in fewer coordinates than that (40 of 64 at 0.85, 35 at 0.80), or at
0.80 and more misses all 12 posted ones, with a chance of some millionths; no list, group or number
of candidates is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packlens.llm.common import staged
from packlens.llm.graph import components
from packlens.llm.shingles import SHINGLE, Shingler, Signer, digest_of

COORDINATES = 64
#: Chance that a pair at the threshold agrees in fewer coordinates than are asked for.
MISSED = 2.5e-6
PREFIX = 12
#: Members of a block of a posting list or a family, and shingles of a block of a family.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 17
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85


def matches(percent: int) -> int:
    """The most coordinates that can be asked for, so that a pair at ``percent`` is missed with a chance of ``MISSED`` at most."""
    p, missed = percent / 100, 0.0
    for k in range(COORDINATES):
        missed += comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if missed > MISSED:
            return k
    return COORDINATES


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: (key, n_shingles, component_id, kept).

    Rows with equal sets, and sets linked directly or through others, share a component: the least
    key among them. A text without words is its own component, as is any text linked with nothing.
    Rows with a null key take no part: component null, kept false. Several rows with one key each
    follow their own text.
    """
    keys = docs.schema[key].dataType
    rows = staged(_signed(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), size), "signed")
    classes = staged(
        rows.filter("n > 0 and id is not null").groupBy("digest")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("posts").alias("posts")),
        "classes",
    )
    # One key may stand for several texts; the node of the graph is the class, named by its digest.
    nodes = classes.withColumn("node", F.xxhash64("rep", "digest"))
    families = components(_soft_edges(nodes, matches(percent)))
    family = staged(
        nodes.join(families, "node").select("rep", "digest", "node", F.col("n").cast("long").alias("n"), F.col("component").alias("family")), "family"
    )
    links = components(_exact_edges(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), family, size, percent))
    named = nodes.join(links, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    named = staged(named, "named")
    least = staged(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    answer = staged(named.join(least, "component").select("digest", "least"), "answer")
    return (
        rows.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
        .join(answer, "digest", "left")
        .select(
            F.col("id").cast(keys).alias(key),
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).cast(keys).alias("component_id"),
            F.coalesce(F.coalesce("least", "id") == F.col("id"), F.lit(False)).alias("kept"),
        )
    )


def _signed(texts: DataFrame, size: int) -> DataFrame:
    """(id, n, digest, sig, posts) of (id, t)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(size), Signer(COORDINATES)
        tags = np.arange(PREFIX, dtype=np.int64) << np.int64(32)
        for batch in batches:
            n, digest, sig, posts = [], [], [], []
            for t in batch.column(1):
                s = shingler.set_of(t.as_py())
                n.append(len(s))
                digest.append(digest_of(s))
                signature = signer.sign(s)
                sig.append(signature.tobytes())
                posts.append((signature[:PREFIX].astype(np.int64) | tags) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(posts, pa.list_(pa.int64()))],
                ["id", "n", "digest", "sig", "posts"],
            )

    return texts.mapInArrow(signed, "id long, n int, digest binary, sig binary, posts array<long>")


def _in_cells(rows: DataFrame, group: str, blocks: str, member: str) -> DataFrame:
    """Each row once for every cell it meets: a cell is two blocks of one group, or one with itself."""
    own = rows.withColumn("own", F.pmod(F.xxhash64(member, group), F.col(blocks)).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))).select(
        "*", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    )


def _soft_edges(nodes: DataFrame, least: int) -> DataFrame:
    """Spanning forests of the pairs that agree in ``least`` coordinates and share a posted one."""
    posted = nodes.select("node", F.explode("posts").alias("token"))
    lists = staged(posted.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1"), "lists")
    members = posted.join(lists, "token").withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    rows = members.join(nodes.select("node", "sig"), "node")
    cells = _in_cells(rows, "token", "blocks", "node").select("token", "x", "y", "own", "node", "sig")

    def agree(own: np.ndarray, sig: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        s = np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), COORDINATES)
        for i in range(len(s) - 1):
            yield i, i + 1 + np.flatnonzero((s[i + 1 :] == s[i]).sum(axis=1) >= least)

    return _forests(cells, ["token", "x", "y"], agree)


def _exact_edges(texts: DataFrame, family: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning forests of the pairs of a family whose whole sets meet the threshold."""
    sizes = staged(family.groupBy("family").agg(F.sum("n").alias("all"), F.count("*").alias("members")).filter("members > 1"), "sizes")
    wanted = family.join(sizes, "family").select(
        "rep", F.col("digest").alias("wanted"), "node", "family",
        F.greatest(F.ceil(F.col("all") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK)).alias("blocks"),
    )
    found = texts.filter("id is not null").join(wanted.hint("shuffle_hash"), F.col("id") == F.col("rep")).select("t", "wanted", "node", "family", "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            keep, out = [], []
            for i, (t, wanted_) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                s = shingler.set_of(t.as_py())
                if digest_of(s) == wanted_.as_py():
                    keep.append(i)
                    out.append(s.tobytes())
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(out, pa.binary())], ["node", "family", "blocks", "shingles"])

    whole = found.mapInArrow(sets, "node long, family long, blocks long, shingles binary").dropDuplicates(["node"])
    cells = _in_cells(whole, "family", "blocks", "node").select("family", "x", "y", "own", "node", "shingles")

    def linked(own: np.ndarray, shingles: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        yield from linked_sets([np.frombuffer(b, np.uint64) for b in shingles], percent)

    return _forests(cells, ["family", "x", "y"], linked)


def linked_sets(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each i, the later sets j with 100 * |i & j| >= percent * |i | j|. Sets hold distinct numbers."""
    size = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, min(4096, (1 << 24) // max(1, len(sets))))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[rows[a:b], column[a:b] - start] = 1
        both += part @ part.T
    for i in range(len(sets) - 1):
        common = both[i, i + 1 :].astype(np.int64)
        yield i, i + 1 + np.flatnonzero(100 * common >= percent * (size[i] + size[i + 1 :] - common))


def _forests(cells: DataFrame, by: list[str], pairs: Callable[[np.ndarray, list[bytes]], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """Edges (a, b) of a spanning forest of each cell, from ``pairs`` of its rows.

    ``cells`` has the columns of ``by``, ``own``, ``node`` and a payload. The rows of a cell come
    together by a shuffle and a sort on ``by``; a task holds one cell at a time.
    """
    sorted_rows = cells.repartition(*by).sortWithinPartitions(*by)

    def forest(nodes: np.ndarray, own: np.ndarray, payload: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        top = np.arange(len(nodes))
        for i, others in pairs(own, payload):
            if len(others):
                met = np.unique(np.append(top[others], top[i]))
                for label in met[1:]:
                    top[top == label] = met[0]
        moved = np.flatnonzero(top != np.arange(len(nodes)))
        return nodes[moved], nodes[top[moved]]

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(by)
        held: list[pa.RecordBatch] = []
        held_key: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(k)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, s])
                if held and key != held_key:
                    out.append(_close(held, k, forest))
                    held = []
                held_key = key
                held.append(batch.slice(s, e - s))
            if out:
                yield _edges(out)
        if held:
            yield _edges([_close(held, k, forest)])

    return sorted_rows.mapInArrow(forests, "a long, b long")


def _close(held: list[pa.RecordBatch], k: int, forest: Callable) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.concatenate([b.column(k + 1).to_numpy(zero_copy_only=False) for b in held])
    if len(nodes) < 2:
        return nodes[:0], nodes[:0]
    own = np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held])
    return forest(nodes, own, [v for b in held for v in b.column(k + 2).to_pylist()])


def _edges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
