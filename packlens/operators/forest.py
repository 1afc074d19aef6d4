"""Random-forest state-of-health model: train, record, score.

Trees are grown to full depth, and no process holds more of one than a task's share. The training rows are staged
as blocks. A tree draws its rows from them block by block; where a tree has more than a task should hold, its
first splits are chosen from histograms that all tasks count, and the rows below are dealt by node. Each task then
grows the trees, or the parts of them, whose rows it was dealt. The forest is a table of these parts; scoring
sends the requests to the tasks that hold them and adds up in a fixed order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructType

from packlens.functions import trees as kernel
from packlens.operators.cells import FEATURES, latest_versions, regression_metrics, split_train_test, with_features
from packlens.session import staging_path
from packlens.settings import (
    BLOCK_BYTES, BROADCAST_BYTES, FOREST_BINS, FOREST_DEPTH, FOREST_NODE_ROWS, FOREST_PARTITION_ROWS, FOREST_PARTITIONS,
    FOREST_ROUND_BYTES, FOREST_TREES, SEED, TEST_SHARE,
)
from packlens.sources.cells import RAW_INPUTS
from packlens.sources.sinks import append_rows, staged

MODEL_NAME = "soh-forest"
RUN_SCHEMA = (
    "model string, version string, run_id string, trees int, depth int, test_share double, n_train bigint,"
    " n_test bigint, mae double, rmse double, r2 double, features array<string>, path string"
)
#: Parts of trees: the part below one node of a tree's first splits, its nodes in level order.
PART_SCHEMA = "tree int, node int, size bigint, split binary, value binary"
#: Tasks that score at least, where there are as many parts.
LEAST_SLOTS = 32
#: Rows of a block, as it is staged and sent.
BLOCK_ROWS = 32_768
_ROW_BYTES = 8 * (len(FEATURES) + 1) + 1


@dataclass(frozen=True)
class Forest:
    """A trained forest: the folder of its parts, the first splits of each tree, and the parts with their sizes."""

    path: str
    tops: list[tuple[np.ndarray, np.ndarray]]
    parts: list[tuple[int, int, int]]


def dealt(cells: DataFrame, partitions: int = FOREST_PARTITIONS, rows: int = FOREST_PARTITION_ROWS) -> DataFrame:
    """The training columns, dealt by their values and sorted: the same rows lie alike however they were read.

    There are ``partitions`` of them, or more where these would hold more than ``rows`` rows on average, so
    that what a task of a training pass reads does not grow with the table.
    """
    columns = [*FEATURES, "soh"]
    number = max(partitions, ceil(cells.count() / rows))
    return with_features(cells, "soh").repartition(number, *columns).sortWithinPartitions(*columns)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition by blocks."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            taken = batch.slice(0, BLOCK_ROWS - size)
            held, size, batch = [*held, taken], size + taken.num_rows, batch.slice(taken.num_rows)
            if size == BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, columns: list[int]) -> np.ndarray:
    """Columns as rows of an array; what is null or no number has no place in a tree."""
    found = np.array([table.column(c).to_numpy() for c in columns], np.float64).reshape(len(columns), table.num_rows)
    if any(table.column(c).null_count for c in columns) or np.isnan(found).any():
        raise ValueError("null or NaN among the inputs of the forest")
    return found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of training rows; the label comes first in them."""
    part = TaskContext.get().partitionId()
    for block, table in enumerate(_tables(batches)):
        rows = _numbers(table, list(range(len(FEATURES) + 1)))
        yield _batch({"part": ("int32", [part]), "block": ("int32", [block]), "size": ("int64", [table.num_rows]),
                      "low": ("float64", [rows[0].min()]), "high": ("float64", [rows[0].max()]), "data": ("binary", [rows.tobytes()])})


def _batch(columns: dict[str, tuple[str, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.type_for_alias(t)) for t, v in columns.values()], list(columns))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one at a time; a batch's binaries are views of it, not copies."""
    for batch in batches:
        columns = {n: c if pa.types.is_binary(c.type) else c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        for i in range(batch.num_rows):
            yield {n: (c[i].as_buffer() if c[i].is_valid else None) if isinstance(c, pa.Array) else c[i] for n, c in columns.items()}


def _rows_of(data: pa.Buffer, kind: type = np.float64, lines: int = 1) -> np.ndarray:
    found = np.frombuffer(data, kind)
    return found.reshape(lines, -1) if lines > 1 else found


def _drawn(row: dict, tree: int, seed: int) -> np.ndarray:
    """How often a tree drew each row of a block: as with replacement, at random by the tree and the block's place."""
    return np.random.default_rng([seed, tree, row["part"], row["block"]]).poisson(1.0, row["size"]).astype(np.uint8)


# -- the first splits of trees with more rows than a task should hold ------------------------------------------


def _quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's quantiles of each feature, over all of its rows."""
    for row in _each(batches):
        data = _rows_of(row["data"], lines=len(FEATURES) + 1)[1:]
        found = np.quantile(data, np.linspace(0, 1, FOREST_BINS + 1), axis=1, method="inverted_cdf").T
        yield _batch({"part": ("int32", [row["part"]]), "block": ("int32", [row["block"]]), "data": ("binary", [np.ascontiguousarray(found).tobytes()])})


def _edges(blocks: DataFrame) -> list[np.ndarray]:
    """Thresholds to choose from, for each feature: quantiles of the blocks' quantiles."""
    rows = blocks.mapInArrow(_quantiles, "part int, block int, data binary").collect()
    found = np.concatenate([np.frombuffer(r["data"]).reshape(len(FEATURES), -1) for r in sorted(rows, key=lambda r: (r["part"], r["block"]))], axis=1)
    return [np.unique(np.quantile(f, np.linspace(0, 1, FOREST_BINS + 1)[1:-1], method="inverted_cdf")) for f in found]


def _histograms(tops: dict, wide: dict, edges: list[np.ndarray], seed: int, centre: float, scale: float):
    """For each tree, its wide nodes' weights and label sums by feature and bin, and their labels' range, over a task's blocks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = FOREST_BINS
        sums = {t: np.zeros((len(edges), 2, len(nodes), bins)) for t, nodes in wide.items()}
        spans = {t: np.tile([[np.inf], [-np.inf]], len(nodes)) for t, nodes in wide.items()}
        for row in _each(batches):
            data = _rows_of(row["data"], lines=len(edges) + 1)
            x, q = data[1:], kernel.steps(data[0], centre, scale)
            places = [np.searchsorted(e, v) for e, v in zip(edges, x, strict=True)]
            for tree, nodes in wide.items():
                w = _drawn(row, tree, seed)
                number = np.full(len(tops[tree][0]), -1)
                number[nodes] = np.arange(len(nodes))
                local = number[kernel.walk(*tops[tree], x)]
                at = np.flatnonzero((w > 0) & (local >= 0))
                local, weight, label = local[at], w[at].astype(np.float64), q[at]
                np.minimum.at(spans[tree][0], local, label)
                np.maximum.at(spans[tree][1], local, label)
                for f, place in enumerate(places):
                    cell = local * bins + place[at]
                    for k, values in enumerate((weight, weight * label)):
                        sums[tree][f, k] += np.bincount(cell, values, len(nodes) * bins).reshape(len(nodes), bins)
        for tree in wide:
            yield _batch({"tree": ("int32", [tree]), "sums": ("binary", [sums[tree].tobytes()]), "span": ("binary", [spans[tree].tobytes()])})

    return counted


def _chosen(wide: dict, edges: list[np.ndarray]):
    """The best split of each wide node by the sums over all tasks; without one ``feature`` is null."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, spans = {}, {}
        for row in _each(batches):
            t, found, span = row["tree"], _rows_of(row["sums"]), _rows_of(row["span"], lines=2)
            sums[t] = sums[t] + found if t in sums else found
            spans[t] = np.array([np.minimum(spans[t][0], span[0]), np.maximum(spans[t][1], span[1])]) if t in spans else span
        for t, found in sums.items():
            found = found.reshape(len(edges), 2, len(wide[t]), FOREST_BINS)
            for i, node in enumerate(wide[t]):
                w, s = found[:, 0, i], found[:, 1, i]
                nl, sl = np.cumsum(w, 1), np.cumsum(s, 1)
                n, total = nl[0, -1], sl[0, -1]
                valid = (nl > 0) & (nl < n)
                score = np.where(valid, sl**2 / np.maximum(nl, 1) + (total - sl) ** 2 / np.maximum(n - nl, 1), -1.0)
                f, j = np.unravel_index(int(np.argmax(score)), score.shape)
                pure, splits = bool(spans[t][0][i] == spans[t][1][i]), bool(valid[f, j])
                yield _batch({
                    "tree": ("int32", [t]), "node": ("int32", [int(node)]), "weight": ("float64", [n]), "total": ("float64", [total]), "pure": ("bool", [pure]),
                    "feature": ("int32", [int(f) if splits else None]), "threshold": ("float64", [float(edges[f][j]) if splits else None]),
                    "left": ("float64", [nl[f, j] if splits else None]),
                })

    return choose


def _first_splits(
    blocks: DataFrame, trees: int, depth: int | None, seed: int, centre: float, scale: float, rows: int, node_rows: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[tuple[int, int], float]]:
    """The first splits of each tree, down to nodes of ``node_rows`` draws or less, and the mean label of the leaves among them.

    Thresholds of these are chosen from quantiles; below them, from all values.
    """
    leaf = (np.array([-1], np.int8), np.zeros(1))
    tops, ended = [leaf] * trees, {}
    wide = {t: [0] for t in range(trees)} if rows > node_rows else {}
    edges = _edges(blocks) if wide else []
    schema = "tree int, node int, weight double, total double, pure boolean, feature int, threshold double, left double"
    level = 0
    while wide:
        found, todo = {}, sorted(wide)
        while todo:
            # As many trees in a pass as a task can hold histograms of.
            size = np.cumsum([len(wide[t]) * len(edges) * FOREST_BINS * 16 for t in todo])
            pass_ = {t: wide[t] for t in todo[: max(1, int(np.searchsorted(size, BLOCK_BYTES, "right")))]}
            todo = todo[len(pass_) :]
            counted = blocks.mapInArrow(_histograms({t: tops[t] for t in pass_}, pass_, edges, seed, centre, scale), "tree int, sums binary, span binary")
            for r in counted.repartition("tree").mapInArrow(_chosen(pass_, edges), schema).collect():
                found[r["tree"], r["node"]] = r
        following: dict[int, list[int]] = {}
        for t, nodes in wide.items():
            split, value = tops[t]
            split, value, fresh = split.copy(), value.copy(), []
            for node in nodes:  # in level order, as their children are
                r = found[t, node]
                if r["pure"] or (depth is not None and level >= depth):
                    ended[t, node] = centre + r["total"] / r["weight"] / scale
                elif r["feature"] is not None:
                    split[node], value[node] = r["feature"], r["threshold"]
                    fresh += [r["left"], r["weight"] - r["left"]]
            following[t] = [len(split) + i for i, n in enumerate(fresh) if n > node_rows]
            tops[t] = np.concatenate([split, np.full(len(fresh), -1, np.int8)]), np.concatenate([value, np.zeros(len(fresh))])
        wide = {t: nodes for t, nodes in following.items() if nodes}
        level += 1
    return tops, ended


# -- the trees below them ------------------------------------------------------------------------------------------


def _depths(split: np.ndarray) -> np.ndarray:
    """The depth of each node of a tree in level order."""
    found, left = np.zeros(len(split), np.int64), 2 * np.cumsum(split >= 0) - 1
    for node in np.flatnonzero(split >= 0):
        found[left[node] : left[node] + 2] = found[node] + 1
    return found


def _samples(tops: dict, slots: dict[tuple[int, int], int], seed: int):
    """The rows that each tree drew from the blocks, by the node that they come to."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            data = _rows_of(row["data"], lines=len(FEATURES) + 1)
            for tree, top in tops.items():
                w = _drawn(row, tree, seed)
                at = np.flatnonzero(w)
                nodes = kernel.walk(*top, data[1:, at])
                for node in np.unique(nodes):
                    if (tree, int(node)) in slots:
                        taken = at[nodes == node]
                        yield _batch({
                            "slot": ("int32", [slots[tree, int(node)]]), "tree": ("int32", [tree]), "node": ("int32", [int(node)]), "part": ("int32", [row["part"]]),
                            "block": ("int32", [row["block"]]), "weights": ("binary", [w[taken].tobytes()]), "data": ("binary", [data[:, taken].tobytes()]),
                        })

    return drawn


def _grown(left: dict[tuple[int, int], int | None], centre: float, scale: float):
    """The part of a tree below each node dealt to a task; ``left`` has the levels that remain below the node."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, node), rows in groupby(_each(batches), lambda r: (r["tree"], r["node"])):
            held = [(_rows_of(r["weights"], np.uint8), _rows_of(r["data"], lines=len(FEATURES) + 1)) for r in rows]
            w, data = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
            del held
            yield _part(tree, node, *kernel.grow(data[1:], data[0], kernel.steps(data[0], centre, scale), w, left[tree, node]))

    return grow


def _part(tree: int, node: int, split: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return _batch({"tree": ("int32", [tree]), "node": ("int32", [node]), "size": ("int64", [len(split)]),
                   "split": ("binary", [split.tobytes()]), "value": ("binary", [value.tobytes()])})


def _append(parts: DataFrame, path: str) -> None:
    """Nodes are numbers of many digits: zstd finds a little in them, other codecs next to nothing."""
    parts.write.mode("append").option("compression", "zstd").parquet(path)


def fit_forest(
    cells: DataFrame, trees: int = FOREST_TREES, depth: int | None = FOREST_DEPTH, seed: int = SEED, partitions: int = FOREST_PARTITIONS,
    path: str | None = None, node_rows: int = FOREST_NODE_ROWS,
) -> Forest:
    """A forest over the stress features, stored below ``path``; every feature is considered at every split.

    A node is split until its labels are equal or no feature parts its rows, or down to ``depth``. Rows are drawn
    at random by their place among the ``dealt`` rows: the same rows give the same forest however they were read.
    """
    spark = cells.sparkSession
    path = path or staging_path(spark, "forest")
    fields = "part int, block int, size bigint, low double, high double, data binary"
    blocks = staged(dealt(cells, partitions).mapInArrow(_packed, fields), "training")
    known = blocks.agg(F.sum("size").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if not known["n"]:
        raise ValueError("no rows to train a forest with")
    centre = (known["low"] + known["high"]) / 2
    # Draws number as many as rows, but for chance; twice as many is beyond it, or the rows are few.
    scale = kernel.step_scale(2 * known["n"] + 1000, known["high"] - centre)
    tops, ended = _first_splits(blocks, trees, depth, seed, centre, scale, known["n"], node_rows)
    if ended:
        rows = [(t, n, 1, np.array([-1], np.int8).tobytes(), np.array([v]).tobytes()) for (t, n), v in ended.items()]
        _append(spark.createDataFrame(rows, PART_SCHEMA), f"{path}/parts")
    cores = spark.sparkContext.defaultParallelism
    # Trees in a round: what they drew lies on the disks at one time. Whole turns of all cores, where there are that many.
    round_ = max(1, int(FOREST_ROUND_BYTES / (0.64 * known["n"] * _ROW_BYTES)))
    round_ = round_ // cores * cores or round_
    for first in range(0, trees, round_):
        now = {t: tops[t] for t in range(first, min(first + round_, trees))}
        left = {}
        for t, (split, _) in now.items():
            deep = _depths(split)
            left |= {(t, int(n)): None if depth is None else depth - int(deep[n]) for n in np.flatnonzero(split < 0) if (t, int(n)) not in ended}
        if not left:
            continue
        number = min(len(left), max(4 * cores, ceil(len(now) * 0.64 * known["n"] * _ROW_BYTES / BROADCAST_BYTES)))
        slots = {key: i % number for i, key in enumerate(left)}
        sampled = blocks.mapInArrow(_samples(now, slots, seed), "slot int, tree int, node int, part int, block int, weights binary, data binary")
        sorted_ = sampled.repartitionById(number, F.col("slot")).sortWithinPartitions("tree", "node", "part", "block")
        _append(sorted_.mapInArrow(_grown(left, centre, scale), PART_SCHEMA), f"{path}/parts")
        del sampled, sorted_
        # The rows of this round leave the disks with their plan, when the collectors find it gone.
        spark.sparkContext._jvm.System.gc()
    firsts = [(t, s.tobytes(), v.tobytes()) for t, (s, v) in enumerate(tops)]
    spark.createDataFrame(firsts, "tree int, split binary, value binary").write.parquet(f"{path}/tops")
    return load_forest(spark, path)


def load_forest(spark: SparkSession, path: str) -> Forest:
    tops = spark.read.schema("tree int, split binary, value binary").parquet(f"{path}/tops").sort("tree").collect()
    parts = spark.read.schema(PART_SCHEMA).parquet(f"{path}/parts").select("tree", "node", "size").collect()
    return Forest(path, [(np.frombuffer(r["split"], np.int8), np.frombuffer(r["value"])) for r in tops], sorted((r["tree"], r["node"], r["size"]) for r in parts))


# -- scoring ---------------------------------------------------------------------------------------------------------


def _slots(parts: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """Which parts lie together in a task, in order: a few dozen tasks, more where they would hold too much. The forest alone decides."""
    found, slot, held = {}, 0, 0
    most = min(BROADCAST_BYTES, 17 * sum(size for *_, size in parts) / LEAST_SLOTS)
    for tree, node, size in parts:
        if held and held + 17 * size > most:
            slot, held = slot + 1, 0
        found[tree, node] = slot
        held += 17 * size
    return found


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of requests, all their columns, with a number of their own."""
    first = TaskContext.get().partitionId() << 32
    for block, table in enumerate(_tables(batches)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        x = _numbers(table, list(range(table.num_columns - len(FEATURES), table.num_columns)))
        yield _batch({"request": ("int64", [first + block]), "data": ("binary", [x.tobytes()]), "columns": ("binary", [sink.getvalue().to_pybytes()])})


def _held(slots: dict[tuple[int, int], int]) -> dict[int, dict[int, list[int]]]:
    """For each slot its trees, and for each of them the nodes whose parts are there."""
    found: dict[int, dict[int, list[int]]] = {}
    for (tree, node), slot in slots.items():
        found.setdefault(slot, {}).setdefault(tree, []).append(node)
    return found


def _sent(tops: list[tuple[np.ndarray, np.ndarray]], slots: dict[tuple[int, int], int]):
    """The inputs of each block's requests, to the slots that hold parts for them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(slots)
        for row in _each(batches):
            x = _rows_of(row["data"], lines=len(FEATURES))
            for slot, trees in held.items():
                wanted = np.zeros(x.shape[1], bool)
                for tree, nodes in trees.items():
                    if wanted.all():
                        break
                    wanted |= np.isin(kernel.walk(*tops[tree], x), nodes)
                at = np.flatnonzero(wanted)
                if at.size:
                    yield _batch({"slot": ("int32", [slot]), "kind": ("int32", [1]), "a": ("int64", [row["request"]]), "b": ("int32", [0]),
                                  "split": ("binary", [at.tobytes()]), "value": ("binary", [x[:, at].tobytes()])})

    return send


def _walked(tops: list[tuple[np.ndarray, np.ndarray]]):
    """The sums of a slot's trees over the requests sent to it: its parts come first, then the blocks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts = None, []
        for row in _each(batches):
            if row["slot"] != slot:
                slot, parts = row["slot"], []
            if row["kind"] == 0:
                parts.append((row["a"], row["b"], _rows_of(row["split"], np.int8), _rows_of(row["value"])))
                continue
            x = _rows_of(row["value"], lines=len(FEATURES))
            sums = np.zeros(x.shape[1])
            for tree, of_tree in groupby(parts, lambda p: p[0]):
                leaves = kernel.walk(*tops[tree], x)
                for _, node, split, value in of_tree:
                    at = np.flatnonzero(leaves == node)
                    sums[at] += value[kernel.walk(split, value, x[:, at])]
            yield _batch({"request": ("int64", [row["a"]]), "slot": ("int32", [slot]), "at": ("binary", [row["split"].to_pybytes()]), "data": ("binary", [sums.tobytes()])})

    return walk


def _averaged(trees: int, kept: int):
    """The requests of each block with their mean over all trees; sums are added in the order of the slots."""

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_each(batches), lambda r: r["request"]):
            # The request's own columns come first, as slot -1.
            table = pa.ipc.open_stream(next(rows)["data"]).read_all()
            total = np.zeros(table.num_rows)
            for r in rows:
                total[_rows_of(r["at"], np.int64)] += _rows_of(r["data"])
            table = table.select(list(range(kept))).append_column("predicted_soh", pa.array(total / trees))
            yield from table.to_batches()

    return average


def score(model: Forest, requests: DataFrame, *keep: str) -> DataFrame:
    """``predicted_soh`` of each request, next to its inputs and the columns to keep. For tables, and for streams batch by batch."""
    spark, slots = requests.sparkSession, _slots(model.parts)
    inputs = with_features(requests, *keep)
    blocks = staged(inputs.mapInArrow(_requests, "request bigint, data binary, columns binary"), "requests")
    fields = "slot int, kind int, a bigint, b int, split binary, value binary"
    where = spark.createDataFrame([(t, n, s) for (t, n), s in slots.items()], "tree int, node int, slot int")
    parts = spark.read.schema(PART_SCHEMA).parquet(f"{model.path}/parts").join(F.broadcast(where), ["tree", "node"])
    held = parts.select("slot", F.lit(0).alias("kind"), F.col("tree").cast("long").alias("a"), F.col("node").alias("b"), "split", "value")
    sent = blocks.select("request", "data").mapInArrow(_sent(model.tops, slots), fields)
    number = max(slots.values()) + 1
    together = held.unionByName(sent).repartitionById(number, F.col("slot")).sortWithinPartitions("slot", "kind", "a", "b")
    sums = together.mapInArrow(_walked(model.tops), "request bigint, slot int, at binary, data binary")
    own = blocks.select("request", F.lit(-1).alias("slot"), F.lit(None).cast("binary").alias("at"), F.col("columns").alias("data"))
    kept = [*keep, *RAW_INPUTS]
    schema = StructType([*inputs.schema.fields[: len(kept)]]).add("predicted_soh", DoubleType())
    gathered = own.unionByName(sums).repartition("request").sortWithinPartitions("request", "slot")
    return gathered.mapInArrow(_averaged(len({t for t, _, _ in model.parts}), len(kept)), schema)


def train_and_test(
    cells: DataFrame, key: str = "cell_id", trees: int = FOREST_TREES, depth: int | None = FOREST_DEPTH, partitions: int = FOREST_PARTITIONS,
    path: str | None = None,
) -> tuple[Forest, DataFrame]:
    """Fit on the training rows; the metrics are those of the held-out rows."""
    marked = split_train_test(cells, key, TEST_SHARE, SEED)
    model = fit_forest(marked.where(~F.col("is_test")), trees, depth, partitions=partitions, path=path)
    tested = score(model, marked.where("is_test"), "soh")
    return model, regression_metrics(tested, "soh", "predicted_soh")


def next_version(runs: DataFrame, model: str = MODEL_NAME) -> int:
    newest = latest_versions(runs.where(F.col("model") == model)).select("version").first()
    return int(newest["version"]) + 1 if newest else 1


def record_training(
    spark: SparkSession, cells: DataFrame, folder: str, trees: int = FOREST_TREES, depth: int | None = FOREST_DEPTH,
    partitions: int = FOREST_PARTITIONS,
) -> DataFrame:
    """Train, save the model below ``folder`` and append a row to its runs table; returns the row. A null depth has no bound."""
    path = f"{folder}/models/{MODEL_NAME}/{uuid.uuid4().hex}"
    _, metrics = train_and_test(cells, trees=trees, depth=depth, partitions=partitions, path=path)
    figures = metrics.first()
    runs_path = f"{folder}/runs"
    # An empty append creates the table, so the first run needs no special case.
    append_rows(spark.createDataFrame([], RUN_SCHEMA), runs_path)
    version = next_version(spark.read.schema(RUN_SCHEMA).parquet(runs_path))
    row = (
        MODEL_NAME, str(version), f"{MODEL_NAME}-{version}", trees, depth, TEST_SHARE,
        cells.count() - figures["n"], figures["n"], figures["mae"], figures["rmse"], figures["r2"], list(FEATURES), path,
    )
    run = spark.createDataFrame([row], RUN_SCHEMA)
    append_rows(run, runs_path)
    return run


def load_latest(spark: SparkSession, folder: str) -> tuple[Forest, str]:
    """The newest recorded model and its version."""
    runs = spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/runs").where(F.col("model") == MODEL_NAME)
    newest = runs.orderBy(F.col("version").cast("bigint").desc()).select("version", "path").first()
    if newest is None:
        raise RuntimeError(f"no recorded model '{MODEL_NAME}'; train one first")
    return load_forest(spark, newest["path"]), newest["version"]
