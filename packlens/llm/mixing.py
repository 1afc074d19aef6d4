"""Mixing sources to target sizes by min-cost flow.

A document belongs to one or more sources; documents with the same sources form a pattern. Each
pattern offers its words once per layer, and a layer costs more than the one before (convex
repetition cost). Capacity flows from patterns to the quotas of their sources. As costs lie on the
pattern side alone, the cheapest largest flow is found layer by layer: a largest flow with one
layer open, extended with the next one. Within a pattern, documents are then taken in a seeded
order until its flow is used.

Sources that share documents, directly or through others, form a component, found by join rounds.
Every pattern goes through the network of its component, and each component is solved in a task of
its own: nothing meets on the driver, no pattern is left out or folded. A component's patterns are
held by its task, without their documents. Where every document has one source, each component is
one pattern with one quota.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from packlens.llm.common import WORD, staged
from packlens.llm.graph import components

LAYERS = 2
BITS = 10


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, name: str = "source") -> DataFrame:
    """``sources`` with ``position``, from 0, by code point with null last; sorted over all tasks, never in one."""
    ordered = staged(
        sources.orderBy(F.col(name).asc_nulls_last()).withColumn("part", F.spark_partition_id())
        .withColumn("within", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)),
        "ranked",
    )
    parts = ordered.groupBy("part").agg(F.count("*").alias("rows"))
    offset = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each partition of the sort, as many as spark.sql.shuffle.partitions at most.
    return ordered.join(F.broadcast(parts.withColumn("offset", offset)), "part").withColumn("position", F.col("offset") + F.col("within")).drop(
        "part", "within", "rows", "offset"
    )


def water_targets(sources: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size, target) of ``sources`` (source, source_size).

    Weights repeat over the sources by code point. The sources share ``share`` times all sizes by
    weight; a target stops at ``most`` times its source's size and the excess is shared anew until
    no target is above. That is one level for all: target = least of level * weight and the stop.
    The level is found by a few aggregations, whatever the number of sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    table = staged(ranked(sources).withColumn("weight", weight).withColumn("stop", F.col("source_size") * most).drop("position"), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("stop") <= F.lit(level) * F.col("weight")
        stopped, open_ = table.agg(F.sum(F.when(full, F.col("stop"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:
            break
        found = (share * total - (stopped or 0.0)) / open_
        if found <= level:
            break
        level = found
    return table.select("source", "source_size", F.least(F.col("stop"), F.lit(level) * F.col("weight")).alias("target"))


def largest_flow(patterns: list[tuple[list[int], int]], quotas: list[int], layers: int = LAYERS) -> list[int]:
    """Words drawn from each pattern (its sources, its size) so that quotas are met as far as possible at least cost."""
    n = len(patterns)
    sink = n + len(quotas) + 1
    graph: list[list[list[int]]] = [[] for _ in range(sink + 1)]  # edges [to, capacity, index of the reverse edge]

    def edge(a: int, b: int, capacity: int) -> list[int]:
        graph[a].append([b, capacity, len(graph[b])])
        graph[b].append([a, 0, len(graph[a]) - 1])
        return graph[a][-1]

    entries = [edge(0, p + 1, 0) for p in range(n)]
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            edge(p + 1, n + 1 + s, 1 << 62)
    for s, quota in enumerate(quotas):
        edge(n + 1 + s, sink, quota)
    for _ in range(layers):
        for entry, (_, size) in zip(entries, patterns, strict=True):
            entry[1] += size
        _augment(graph, 0, sink)
    return [layers * size - entry[1] for entry, (_, size) in zip(entries, patterns, strict=True)]


def _augment(graph: list[list[list[int]]], source: int, sink: int) -> None:
    """Largest flow by level graphs and blocking flows."""
    while True:
        level = [-1] * len(graph)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, capacity, _ in graph[u]:
                if capacity > 0 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return
        at = [0] * len(graph)
        path: list[tuple[int, int]] = []
        u = source
        while True:
            if u == sink:
                room = min(graph[a][i][1] for a, i in path)
                for a, i in path:
                    e = graph[a][i]
                    e[1] -= room
                    graph[e[0]][e[2]][1] += room
                path, u = [], source
            while at[u] < len(graph[u]) and not (graph[u][at[u]][1] > 0 and level[graph[u][at[u]][0]] == level[u] + 1):
                at[u] += 1
            if at[u] < len(graph[u]):
                path.append((u, at[u]))
                u = graph[u][at[u]][0]
            elif path:
                u = path.pop()[0]
                at[u] += 1
            else:
                break


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", sources: str = "sources", size: str = "size", seed: int = 17) -> DataFrame:
    """``docs`` with ``copies``, how often a document is taken: 0, 1 or 2. A column of that name is replaced.

    ``sources`` is an array of source names (null is a name too); ``targets`` has (source, target).
    Documents without sources are not taken. A pattern's flow takes all its documents as often as it
    holds them, then documents in seeded order as long as they bring the sum nearer, and one more is
    added or left out if that brings it nearer still. The order depends on key and size alone:
    reruns agree. Empty documents follow their pattern's whole rounds.
    """
    rows = docs.withColumn("_pattern", F.to_json(F.array_sort(F.array_distinct(sources)))).withColumn(
        "_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(size)), 64 - 3 * BITS)
    )
    narrow = staged(rows.select(key, size, sources, "_pattern", "_h"), "sizes")
    plan = _flows(narrow.groupBy("_pattern", sources).agg(F.sum(size).alias("words")), targets, sources)
    # Where the flow of a pattern stops in the seeded order: by first digits of the hash, then by the next ones, then by rows.
    first, second = F.shiftright("_h", 2 * BITS), F.shiftright("_h", BITS) % (1 << BITS)
    order = Window.partitionBy("_pattern").orderBy("_bin")
    before = F.sum("_words").over(order) - F.col("_words")

    def stop(binned: DataFrame, plan: DataFrame, bin_: Column, left: str, name: str) -> DataFrame:
        sums = binned.groupBy("_pattern", bin_.alias("_bin")).agg(F.sum(size).alias("_words"))
        hit = sums.withColumn("_before", before).join(plan.select("_pattern", left), "_pattern")
        hit = hit.filter((F.col("_before") <= F.col(left)) & (F.col("_before") + F.col("_words") > F.col(left)))
        return staged(
            plan.join(hit.select("_pattern", F.col("_bin").alias(name), (F.col(left) - F.col("_before")).alias(f"{name}_left")), "_pattern", "left"), "stop"
        )

    plan = stop(narrow, plan, first, "_rest", "_one")
    inside = narrow.join(plan.select("_pattern", "_one"), "_pattern").filter(first == F.col("_one")).drop("_one")
    plan = stop(inside, plan, second, "_one_left", "_two")
    last = narrow.join(plan.select("_pattern", "_one", "_two", "_two_left"), "_pattern").filter((first == F.col("_one")) & (second == F.col("_two")))
    running = F.sum(size).over(Window.partitionBy("_pattern").orderBy("_h", key, size).rowsBetween(Window.unboundedPreceding, 0))
    # A row of the last bin is taken if the sum is nearer to what is left with it than without it.
    edge = last.withColumn("_sum", running).filter(2 * F.col("_sum") - F.col(size) <= 2 * F.col("_two_left")).groupBy("_pattern").agg(
        F.max(F.struct("_h", key, size)).alias("_edge"), F.max("_sum").alias("_edge_sum")
    )
    plan = staged(plan.join(edge, "_pattern", "left"), "plan")
    mark = F.struct("_h", F.col(key), F.col(size))
    more = (
        F.when(F.col("_one").isNull(), F.lit(False))
        .when(first != F.col("_one"), first < F.col("_one"))
        .when(F.col("_two").isNull(), F.lit(False))
        .when(second != F.col("_two"), second < F.col("_two"))
        .otherwise(F.coalesce(mark <= F.col("_edge"), F.lit(False)))
    )
    # One document that, added or left out, brings the sum nearest.
    gap = F.coalesce(F.col("_two_left") - F.coalesce("_edge_sum", F.lit(0)), F.lit(0))
    change = F.when(more, -F.col(size)).otherwise(F.col(size))
    swap = (
        narrow.join(plan, "_pattern").filter(F.abs(gap - change) < F.abs(gap))
        .groupBy("_pattern").agg(F.min(F.struct(F.abs(gap - change).alias("off"), mark.alias("mark"))).alias("_swap"))
    )
    plan = staged(plan.join(swap.select("_pattern", F.col("_swap.mark").alias("_swap")), "_pattern", "left"), "plan")
    more = more != F.coalesce(mark == F.col("_swap"), F.lit(False))
    taken = rows.join(plan, "_pattern", "left").withColumn("copies", F.coalesce(F.col("_rounds") + more.cast("int"), F.lit(0)).cast("int"))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"], "copies")


def _node(name: Column) -> Column:
    """A source as a node of a graph; null is a source too."""
    return F.xxhash64(name.isNull(), name)


def _components(patterns: DataFrame, name: str) -> DataFrame:
    """(node, component) of the sources that share a document with another one; ``name`` is the array of sources."""
    names = F.array_distinct(name)
    several = patterns.filter(F.size(names) > 1).select(_node(F.element_at(names, 1)).alias("a"), F.explode(F.slice(names, 2, F.size(names))).alias("other"))
    return components(several.select("a", _node(F.col("other")).alias("b")).distinct())


def _flows(patterns: DataFrame, targets: DataFrame, sources: str) -> DataFrame:
    """(_pattern, _rounds, _rest): how often a pattern is taken whole, and the words beyond."""
    patterns = staged(patterns.filter(F.size(sources) > 0), "patterns")
    # A pattern that names a source twice is the same pattern.
    merged = patterns.groupBy("_pattern").agg(F.sum("words").alias("words"), F.array_sort(F.array_distinct(F.min_by(sources, F.size(sources)))).alias("names"))
    joined = staged(_components(merged, "names"), "components")

    def placed(rows: DataFrame, name: Column) -> DataFrame:
        found = rows.withColumn("node", _node(name)).join(joined, "node", "left")
        return found.withColumn("component", F.coalesce("component", "node")).drop("node")

    left = placed(merged, F.element_at("names", 1))
    right = placed(targets.select(F.col("source").alias("name"), F.floor("target").cast("long").alias("quota")), F.col("name"))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("_pattern")
        name = right["name"].astype(object).where(right["name"].notna(), None)
        place = {s: i for i, s in enumerate(name)}
        reached = [[place[s] for s in names if s in place] for names in left["names"]]
        words = left["words"].astype(int).tolist()
        flow = largest_flow(list(zip(reached, words, strict=True)), right["quota"].astype(int).tolist())
        return pd.DataFrame({"_pattern": left["_pattern"].to_numpy(), "words": words, "flow": flow}).astype({"words": "int64", "flow": "int64"})

    flows = left.groupBy("component").cogroup(right.groupBy("component")).applyInPandas(solve, "_pattern string, words long, flow long")
    words = F.greatest("words", F.lit(1))
    return staged(flows.select("_pattern", F.floor(F.col("flow") / words).cast("int").alias("_rounds"), (F.col("flow") % words).alias("_rest")), "flows")
