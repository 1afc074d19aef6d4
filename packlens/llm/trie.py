"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A turn is a digest of role and text; a prefix is known by two 64-bit XOR sums over its turns at their
places. Both sums and places run within slices of a conversation, and slice totals are put before
them, so no conversation lies in one task.

Subtree totals come from contraction rounds: *compress* removes every chain of nodes with one child at
once (pointer doubling gives each the sum down to the chain's end, whose node then hangs below the
chain's parent), *rake* removes all leaves into their parents. Each round at least halves the leaves.
Going back through the rounds, a removed chain node's total is its sum plus the total of the chain's
end. Nodes are keys of joins; sums into one parent are partial sums; nothing is collected.

Null roles and texts count as empty, null turns come first, turns of one number are ordered by digest,
so that repeated rows are turns of their own. Rows with a null conv_id are left out. Without
conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from packlens.llm.common import staged

#: Turns in a slice of a conversation, and neighbouring conv_ids that are joined to one text before hashing (2^12).
SLICE = 1_024
ENDS_BITS = 12
#: Conversations whose ids share all but the last two digits share the first turns of the first of them.
FAMILY, MOST_SHARED = 100, 5


def _with_slices(rows: DataFrame, slice_of: Column, order: list, running: dict[str, Column], zero: dict[str, Column]) -> DataFrame:
    """Adds inclusive running values per ``c``; ``running`` are aggregates, put together across slices by ``zero``."""
    sliced = rows.withColumn("_s", slice_of)
    totals = sliced.groupBy("c", "_s").agg(*[a.alias(f"_t_{n}") for n, a in running.items()])
    before = Window.partitionBy("c").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("c", "_s", *[z.over(before).alias(f"_o_{n}") for n, z in zero.items()]).filter(F.col(f"_o_{next(iter(zero))}").isNotNull())
    inside = Window.partitionBy("c", "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = sliced.withColumns({n: a.over(inside) for n, a in running.items()})
    return own.join(offsets, ["c", "_s"], "left").drop("_s")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, pos, digest, size): every turn's place from 1 on, its digest, and the code points of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).cast("long").alias("size"),
    )
    slice_of = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(2**62)))
    order = [F.col("turn").asc_nulls_first(), "digest"]
    placed = _with_slices(rows, slice_of, order, {"n": F.count(F.lit(1))}, {"n": F.sum("_t_n")})
    return placed.select("c", (F.col("n") + F.coalesce("_o_n", F.lit(0))).alias("pos"), "digest", "size")


def shared_turns(c: Column) -> Column:
    """How many first turns a conversation takes from the first one of its family."""
    return F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, depth, digest, size): the first turns of the family's first conversation, then the own ones after as many.

    A conversation without any turn has one row with depth 0.
    """
    convs = turns.select("c").distinct().withColumns({"h": shared_turns(F.col("c")), "base": F.col("c") - F.col("c") % FAMILY})
    first = turns.filter((F.col("c") % FAMILY == 0) & (F.col("pos") <= MOST_SHARED))
    lists = first.groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("heads"))  # five at most
    headed = convs.join(lists, "base", "left").withColumn("heads", F.slice(F.coalesce("heads", F.array()), 1, F.col("h").cast("int")))
    taken = headed.select("c", F.explode("heads").alias("x")).select("c", F.col("x.pos").alias("depth"), "x.digest", "x.size")
    # Only where the family's first conversation is shorter than asked for, the own turns move up.
    short = headed.filter(F.size("heads") < F.col("h")).select("c", (F.col("h") - F.size("heads")).alias("missing"))
    own = turns.filter(F.col("pos") > shared_turns(F.col("c"))).join(short, "c", "left")
    own = own.select("c", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("depth"), "digest", "size")
    root = convs.select("c", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("size"))
    return taken.unionByName(own).unionByName(root)


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, depth, size, x, y, px, py): both sums of every prefix and of the one before it."""
    placed = rows.withColumns({k: F.when(F.col("digest").isNull(), F.lit(0)).otherwise(F.xxhash64("digest", "depth", F.lit(i))) for i, k in enumerate("uw")})
    slice_of = F.floor(F.col("depth") / SLICE)
    sums = {"x": F.bit_xor("u"), "y": F.bit_xor("w")}
    run = _with_slices(placed, slice_of, ["depth"], sums, {k: F.bit_xor(f"_t_{k}") for k in sums})
    full = run.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(f"_o_{k}", F.lit(0))) for k in sums})
    return full.select("c", "depth", "size", "x", "y", F.col("x").bitwiseXOR(F.col("u")).alias("px"), F.col("y").bitwiseXOR(F.col("w")).alias("py"))


def _nodes(paths: DataFrame) -> DataFrame:
    """(v, p, depth, x, y, n_convs, saved, n_children): nodes and parents as (smallest member, depth)."""
    found = staged(
        paths.groupBy("depth", "x", "y").agg(
            F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"), F.min("px").alias("px"), F.min("py").alias("py")
        ).withColumn("v", F.struct("c", "depth")),
        "trie-prefixes",
    )
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("v").alias("p"))
    root = found.filter("depth = 0").withColumn("p", F.lit(None).cast(found.schema["v"].dataType))
    linked = staged(found.filter("depth > 0").join(up, ["depth", "px", "py"]).select(root.columns).unionByName(root), "trie-links")
    children = linked.filter("p is not null").groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("n_children"))
    return staged(
        linked.join(children, "v", "left").select(
            "v", "p", "depth", "x", "y", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.coalesce("n_children", F.lit(0)).alias("n_children")
        ),
        "trie-nodes",
    )


def _sums_to_chain_ends(unary: DataFrame, sums: list[str]) -> DataFrame:
    """(v, t, sums): from each chain node its sums down to the chain's last one, whose child is ``t``."""
    chain = staged(unary.withColumn("open", F.lit(True)), "trie-chain")
    while not chain.filter("open").isEmpty():
        ahead = chain.select(F.col("v").alias("t"), F.col("t").alias("_t"), F.col("open").alias("_open"), *[F.col(m).alias(f"_{m}") for m in sums])
        moved = chain.filter("open").join(ahead, "t", "left").select(
            "v", F.coalesce("_t", "t").alias("t"), *[(F.col(m) + F.coalesce(f"_{m}", F.lit(0))).alias(m) for m in sums], F.coalesce("_open", F.lit(False)).alias("open")
        )
        chain = staged(moved.unionByName(chain.filter("not open")), "trie-chain")
    return chain.drop("open")


def subtree_totals(tree: DataFrame, sums: list[str]) -> DataFrame:
    """(v, sums) of every node of one tree ``(v, p, sums)``: each sum over the node's subtree. ``p`` is null at the root only."""
    state, rounds, at_once = tree.select("v", "p", *sums), [], [F.sum(m).alias(m) for m in sums]
    while True:
        kids = state.filter("p is not null").groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("kids"), F.min("v").alias("child"))
        state = staged(state.join(kids, "v", "left"), "trie-state")
        if state.filter("p is not null").isEmpty():
            break
        inner = F.col("kids").eqNullSafe(1) & F.col("p").isNotNull()
        unary = state.filter(inner)
        rest, gains = state.filter(~inner), []
        chain = None
        if not unary.isEmpty():
            chain = _sums_to_chain_ends(unary.select("v", F.col("child").alias("t"), *sums), sums)
            tops = unary.select("v", "p").join(unary.select(F.col("child").alias("v")), "v", "left_anti")
            ends = staged(chain.join(tops, "v").select("t", F.col("p").alias("above"), *sums), "trie-ends")
            rest = rest.join(ends.select(F.col("t").alias("v"), "above"), "v", "left").withColumn("p", F.coalesce("above", "p"))
            gains.append(ends.select(F.col("above").alias("v"), *sums))
        rest = staged(rest.select("v", "p", "kids", *sums), "trie-rest")
        leaf = F.col("kids").isNull() & F.col("p").isNotNull()
        leaves = rest.filter(leaf)
        gains.append(leaves.select(F.col("p").alias("v"), *sums))
        gained = reduce(DataFrame.unionByName, gains).groupBy("v").agg(*at_once).withColumnsRenamed({m: f"_{m}" for m in sums})
        state = staged(
            rest.filter(~leaf).join(gained, "v", "left").select("v", "p", *[(F.col(m) + F.coalesce(f"_{m}", F.lit(0))).alias(m) for m in sums]), "trie-state"
        )
        rounds.append((chain, leaves.select("v", *sums)))
    known = [state.select("v", *sums)]
    for chain, leaves in reversed(rounds):
        known.append(leaves)
        if chain is not None:
            below = reduce(DataFrame.unionByName, known).select(F.col("v").alias("t"), *[F.col(m).alias(f"_{m}") for m in sums])
            known.append(staged(chain.join(below, "t").select("v", *[(F.col(m) + F.col(f"_{m}")).alias(m) for m in sums]), "trie-expanded"))
    return reduce(DataFrame.unionByName, known)


def _ends(paths: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of every prefix that is a whole conversation: its conv_ids in order, hashed as one stream.

    Neighbouring ids of a node are joined first; a node of very many conversations is read by one task in
    order, never held by it.
    """
    last = paths.groupBy("c").agg(F.max(F.struct("depth", "x", "y")).alias("e")).select("e.depth", "e.x", "e.y", "c")
    parts = last.groupBy("depth", "x", "y", F.shiftright("c", ENDS_BITS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("ids"))
    ordered = parts.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "part")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, digest = ["depth", "x", "y", "ends_sha256"], None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*done, strict=True), strict=True)))
        if now is not None:
            yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip(names, (*now, digest.hexdigest()), strict=True)})

    return ordered.mapInArrow(hashed, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the
    trie of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    paths = staged(prefixes(rebuilt(staged(turns_of(conversations), "trie-turns"))), "trie-paths")
    nodes = _nodes(paths)
    tree = nodes.select("v", "p", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(totals, "v").join(_ends(paths), ["depth", "x", "y"], "left").select(
        F.col("v.c").alias("conv_id"), "depth", F.col("p.c").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
