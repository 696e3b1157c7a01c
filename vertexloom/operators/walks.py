"""Random walks: all walks of all rounds move together, one equi-join for each step.

The neighbours of a node are rows, not an array. Each row carries what the next step needs to know
about the node it leads to, and a step asks for one (node, slot) only, so the walkers that stand on a
hub are spread over as many keys as the hub has neighbours. Where very heavy weights hold many walkers
on one edge, adaptive execution splits that key (the step row is the single-row side). The step table is written in
buckets by (node, slot) once: a step shuffles the walkers only. For uniform walks on an undirected graph, whose walkers are spread as the
degrees are, a table above PACKED_ROWS rows, which each step would read and sort again, is written in packed blocks (`steps.py`); walks are the same.
A table that fits into a task is given to all tasks, which make whole walks (`carried.py`).
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import unit
from ..plans.lineage import bucketed, cut
from ..plans.skew import lookup
from . import carried
from .graph import Graph, induced_subgraph
from .sampling import pick_table, positions, slot_of
from .steps import meet_steps, pack_steps

SEGMENT = 8  # steps between two cuts
PACKED_ROWS = 4_000_000  # moves from which packed blocks cost less than their fixed part
MEETS = "_at_key = _key AND _at_slot = _slot AND lo <= _t AND _t < hi"
EVEN = "\u0000even"  # key of the rows that stand for "any node"


def uniform_steps(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step table with equal shares, and the totals of each node."""
    placed = positions(adj.select("src", "dst"), ["src"], ["src", "dst"], "order")
    table = placed.select("src", slot_of(F.col("pos"), F.col("n"), F.col("n")).alias("slot"), "dst",
                          F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"))
    return table, adj.groupBy("src").agg(F.count(F.lit(1)).alias("total")).withColumn("slots", F.col("total"))


def weighted_steps(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step table with shares in proportion to the weight, and the totals of each node."""
    return pick_table(adj.select("src", "dst", "weight"), ["src"], ["dst"], "weight")


def _with_next(table: DataFrame, totals: DataFrame, into: DataFrame) -> DataFrame:
    """Step rows with the totals of the node they lead to."""
    known = totals.select("src", *totals.columns[1:])
    take = {c: f"next_{c}" for c in totals.columns[1:]}
    return lookup(table, "dst", known, "src", take, ["src", "slot"], "left", counts=into)


def _nowhere():
    """A slot that no step row has, different for each walk."""
    return -1 - F.pmod(F.xxhash64("round", "start"), F.lit(1 << 40))


def _moves(steps: DataFrame) -> DataFrame:
    """The step table by (node, slot)."""
    known = steps.select(F.col("src").alias("_key"), F.col("slot").cast("bigint").alias("_slot"), "dst", "lo", "hi", *[c for c in steps.columns if c.startswith(("next_", "back_"))])
    return bucketed(known, ["_key", "_slot"], "steps")


def _rows(totals: DataFrame) -> int:
    """Moves of a step table: one for each slot, about."""
    return totals.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]


def _line(table: DataFrame, totals: DataFrame) -> DataFrame:
    """(src, dst, lo, hi) of a guide table: each move once, in the slot in which it begins."""
    first = slot_of(F.col("lo"), F.col("total"), F.col("slots"))
    known = table.filter("src IS NOT NULL").join(totals.select("src", "total", "slots"), "src")
    return known.filter(F.col("slot") == first).select("src", "dst", "lo", "hi")


def _meeting(steps: DataFrame, totals: DataFrame, spread: bool):
    """Function from rows that ask by (_at_key, _at_slot, _t) to these with the move they meet; spread: no few nodes can hold most walkers."""
    if spread and (rows := _rows(totals)) >= PACKED_ROWS:
        packed = pack_steps(steps, rows)
        return lambda asked: meet_steps(asked, packed)
    moves = _moves(steps)
    return lambda asked: asked.join(moves, F.expr(MEETS), "left")


def _walk(nodes: DataFrame, steps: DataFrame, totals: DataFrame, num_walks: int, walk_length: int, seed: int,
          index_size: int = 0, spread: bool = False) -> DataFrame:
    """(round, start, path). Each path is kept in segments that are joined at the end."""
    extra = [c for c in totals.columns if c not in ("src", "total", "slots")]
    state = (nodes.select(F.col("id").alias("start")).join(totals.withColumnRenamed("src", "start"), "start", "left")
             .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
             .select("round", "start", F.col("start").alias("cur"), "total", "slots", *extra, F.array("start").alias("seg")))
    done = []
    meet = _meeting(steps, totals, spread)
    for step in range(1, walk_length):
        u = unit("round", "start", F.lit(step), seed=seed)
        point = F.floor(u * F.col("total")).cast("bigint")
        key, slot = F.col("cur"), slot_of(point, F.col("total"), F.col("slots"))
        if "even" in extra:  # part of the row is spread evenly over all nodes
            anywhere = unit("round", "start", F.lit(step), F.lit("even"), seed=seed) < F.coalesce("even", F.lit(0.0))
            node = F.floor(unit("round", "start", F.lit(step), F.lit("node"), seed=seed) * F.lit(index_size)).cast("bigint")
            key, slot = F.when(anywhere, F.lit(EVEN)).otherwise(key), F.when(anywhere, node).otherwise(slot)
            point = F.when(anywhere, F.lit(0).cast("bigint")).otherwise(point)
        asked = state.select("*", point.alias("_t"), key.alias("_at_key"), F.coalesce(slot, _nowhere()).alias("_at_slot"))
        met = meet(asked)
        moved = F.col("dst").isNotNull()
        state = met.select("round", "start", F.coalesce("dst", "cur").alias("cur"), F.col("next_total").alias("total"),
                           F.col("next_slots").alias("slots"), *[F.col(f"next_{c}").alias(c) for c in extra],
                           F.when(moved, F.concat("seg", F.array("dst"))).otherwise(F.col("seg")).alias("seg"))
        if step % SEGMENT == 0 or step == walk_length - 1:
            state = cut(state, "walk")
            done.append(state.select("round", "start", F.lit(step).alias("_at"), "seg"))
            state = state.filter(F.col("slots").isNotNull() | (F.col("even") > 0 if "even" in extra else F.lit(False))).withColumn("seg", F.array().cast("array<string>"))
    if not done:
        return state.select("round", "start", F.col("seg").alias("path"))
    parts = done[0]
    for more in done[1:]:
        parts = parts.unionByName(more)
    if len(done) == 1:
        return parts.select("round", "start", F.col("seg").alias("path"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "seg")))
    return (parts.groupBy("round", "start").agg(ordered.alias("p"))
            .select("round", "start", F.flatten(F.transform("p", lambda s: s["seg"])).alias("path")))


def _arrivals(adj: DataFrame) -> DataFrame:
    return adj.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def deepwalk_walks(graph: Graph, num_walks: int = 10, walk_length: int = 80, seed: int = 0) -> DataFrame:
    """Uniform walks from every node; a walk stops early at a node without neighbours."""
    moves, nodes = graph.adj.count(), graph.nodes.count()
    if carried.fits(moves, nodes, carried.UNIFORM):
        placed = positions(graph.adj.select("src", "dst").filter("src IS NOT NULL"), ["src"], ["src", "dst"], "order").withColumnRenamed("pos", "lo")
        pieces = carried.packed(placed, carried.MOVES, "src", ["dst", "lo"], moves)
        return carried.carried_walks(graph.nodes, cut(pieces, "pieces"), num_walks, walk_length, seed, SEGMENT)
    table, totals = uniform_steps(graph.adj)
    steps = _with_next(table, totals, _arrivals(graph.adj))
    return _walk(graph.nodes, steps, totals, num_walks, walk_length, seed, spread=not graph.directed)


def weighted_walks(nodes: DataFrame, cells: DataFrame, even: DataFrame | None = None, index: DataFrame | None = None,
                   num_walks: int = 10, walk_length: int = 80, seed: int = 0) -> DataFrame:
    """Walks by the weights of a transition table (row, col, value).

    `even` has (row, mass): the share of the row that leads to any node alike; `index` numbers the nodes.
    """
    adj = cut(cells.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight")), "cells")
    table, totals = weighted_steps(adj)
    moves, ids = _rows(totals), nodes.count()
    if carried.fits(moves, ids * (1 if even is None else 2), carried.WEIGHTED):
        pieces, spread = carried.packed(_line(table, totals), carried.MOVES, "src", ["dst", "lo", "hi"], moves), 0
        if even is not None:
            spread = index.count()
            share = even.filter("row IS NOT NULL").select(F.col("row").alias("src"), F.col("mass").cast("double").alias("even"))
            pieces = pieces.unionByName(carried.packed(share, carried.EVEN, "src", ["even"], ids)).unionByName(
                carried.packed(index.select(F.col("id").alias("src"), F.col("idx").cast("bigint").alias("idx")), carried.INDEX, "src", ["idx"], ids))
        return carried.carried_walks(nodes, cut(pieces, "pieces"), num_walks, walk_length, seed, SEGMENT, spread)
    into = _arrivals(adj)
    size = 0
    if even is not None:
        size = index.count()
        share = even.select(F.col("row").alias("src"), F.col("mass").alias("even"))
        totals = totals.join(share, "src", "full")
        anywhere = index.select(F.lit(EVEN).alias("src"), F.col("idx").alias("slot"), F.col("id").alias("dst"),
                                F.lit(0).cast("bigint").alias("lo"), F.lit(1).cast("bigint").alias("hi"))
        table = table.select("src", "slot", "dst", "lo", "hi").unionByName(anywhere)
        into = None
    return _walk(nodes, _with_next(table, totals, into), totals, num_walks, walk_length, seed, size)


def node2vec_walks(graph: Graph, p: float = 0.5, q: float = 0.5, num_walks: int = 10, walk_length: int = 80,
                   seed: int = 0) -> DataFrame:
    """Second-order walks: from prev over cur to x with weight w/p if x = prev, w if x has an edge to
    prev, else w/q.

    A step first chooses between the way back and all other neighbours, as if each of these had the larger of 1 and 1/q as bias. The way back is
    then taken; another neighbour is drawn by w from the line of cur without prev, and accepted with its bias / the largest; a refused
    walk chooses again in the next pass. This draws from the stated distribution exactly, whatever p is, and looks at one
    neighbour of cur and one edge to prev at a time, never at whole neighbour lists.
    """
    table, totals = weighted_steps(graph.adj)
    moves, nodes = _rows(totals), graph.nodes.count()
    if carried.fits(moves, nodes, carried.SECOND):
        pieces = carried.packed(_line(table, totals), carried.MOVES, "src", ["dst", "lo", "hi"], moves)
        others = graph.adj.filter("NOT coalesce(weight > 0, false) AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
        pieces = pieces.unionByName(carried.packed(others, carried.LINKS, "src", ["dst"], 1))
        return carried.carried_walks(graph.nodes, cut(pieces, "pieces"), num_walks, walk_length, seed, SEGMENT, second=(p, q))
    table = cut(table, "line")
    # a step row also knows where the edge back lies on the line of the node it leads to
    back = table.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("lo").alias("back_lo"), F.col("hi").alias("back_hi")).distinct()
    moves = _moves(_with_next(table.join(back, ["src", "dst"], "left"), totals, _arrivals(graph.adj)))
    links = bucketed(graph.adj.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct(), ["_from", "_to"], "links")
    top = max(1.0, 1.0 / q)
    state = (graph.nodes.select(F.col("id").alias("start")).join(totals.withColumnRenamed("src", "start"), "start", "left")
             .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
             .select("round", "start", F.lit(1).alias("step"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("prev"),
                     F.col("start").alias("cur"), "total", "slots", F.lit(None).cast("bigint").alias("b_lo"), F.lit(None).cast("bigint").alias("b_hi"), F.array("start").alias("seg")))
    done, passes = [], 0
    while True:
        passes += 1
        keys = ("round", "start", "step", "attempt")
        active = F.col("slots").isNotNull() & (F.col("step") < walk_length)
        gap = F.coalesce(F.col("b_hi") - F.col("b_lo"), F.lit(0))
        rest, mass = F.col("total") - gap, gap / F.lit(float(p))
        returns = (gap > 0) & ((rest <= 0) | (unit(*keys, F.lit("back"), seed=seed) * (mass + rest * top) < mass))
        drawn = F.floor(unit(*keys, seed=seed) * rest).cast("bigint")
        point = F.when(returns, F.col("b_lo")).when(drawn >= F.col("b_lo"), drawn + gap).otherwise(drawn)
        asked = state.select("*", returns.alias("_back"), point.alias("_t"), F.col("cur").alias("_at_key"),
                             F.when(active, slot_of(point, F.col("total"), F.col("slots"))).otherwise(_nowhere()).alias("_at_slot"))
        met = asked.join(moves, F.expr(MEETS), "left")
        # a walk that has no edge to look up asks for a key of its own, so these do not meet in one task
        alone = F.concat(F.lit("\u0000"), F.xxhash64("round", "start").cast("string"))
        sure = F.col("_back") | F.col("prev").isNull()
        met = (met.select("*", F.coalesce("dst", alone).alias("_x"), F.when(sure, alone).otherwise(F.col("prev")).alias("_want"))
               .join(links, (F.col("_x") == F.col("_from")) & (F.col("_want") == F.col("_to")), "left"))
        bias = F.when(F.col("_to").isNotNull(), F.lit(1.0)).otherwise(F.lit(1.0 / q))
        taken = F.col("dst").isNotNull() & (sure | (unit(*keys, F.lit("accept"), seed=seed) * top < bias))
        refused = F.col("dst").isNotNull() & ~taken
        met = met.select("*", taken.alias("_ok"), refused.alias("_no"))
        state = met.select(
            "round", "start", F.when(F.col("_ok"), F.col("step") + 1).otherwise(F.col("step")).alias("step"),
            F.when(F.col("_no"), F.col("attempt") + 1).otherwise(F.lit(0)).alias("attempt"),
            *[F.when(F.col("_ok"), F.col(new)).otherwise(F.col(old)).alias(old) for old, new in (
                ("prev", "cur"), ("cur", "dst"), ("total", "next_total"), ("slots", "next_slots"), ("b_lo", "back_lo"), ("b_hi", "back_hi"))],
            F.when(F.col("_ok"), F.concat("seg", F.array("dst"))).otherwise(F.col("seg")).alias("seg"))
        if passes % SEGMENT == 0 or passes == walk_length - 1:
            state = cut(state, "walk")
            done.append(state.select("round", "start", F.lit(passes).alias("_at"), "seg"))
            state = state.filter(active).withColumn("seg", F.array().cast("array<string>"))
            if state.isEmpty():
                break
    parts = done[0]
    for more in done[1:]:
        parts = parts.unionByName(more)
    ordered = F.array_sort(F.collect_list(F.struct("_at", "seg")))
    return (parts.groupBy("round", "start").agg(ordered.alias("p"))
            .select("round", "start", F.flatten(F.transform("p", lambda s: s["seg"])).alias("path")))


def walk_pairs(graph: Graph, flags: DataFrame, num_walks: int = 50, walk_length: int = 5, seed: int = 0) -> DataFrame:
    """(src, dst) from the start of a walk on the training subgraph to each other node it visits.

    The node that the last of walk_length moves reaches is not visited.
    """
    train = flags.filter(~F.col("test") & ~F.col("val")).select("id")
    walks = deepwalk_walks(induced_subgraph(graph, train), num_walks, walk_length, seed)
    return (walks.select(F.col("start").alias("src"), F.explode(F.slice("path", 2, walk_length)).alias("dst"))
            .filter("src <> dst"))


def skipgram_pairs(walks: DataFrame, window: int = 10) -> DataFrame:
    """(centre, context) for the places of a walk that are at most `window` apart; no shuffle."""
    seen = walks.select("path", F.posexplode("path").alias("_i", "centre"))
    span = F.slice("path", F.greatest(F.col("_i") + 1 - window, F.lit(1)),
                   F.col("_i") + 1 + window - F.greatest(F.col("_i") + 1 - window, F.lit(1)) + 1)
    near = seen.select("centre", "_i", F.greatest(F.col("_i") - window, F.lit(0)).alias("_from"), span.alias("near"))
    return (near.select("centre", "_i", "_from", F.posexplode("near").alias("_j", "context"))
            .filter(F.col("_from") + F.col("_j") != F.col("_i")).select("centre", "context"))
