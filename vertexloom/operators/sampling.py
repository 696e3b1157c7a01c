"""Random choice as joins: every draw is a hash of its keys, every pick is one equi-join.

A weighted choice uses a guide table: the items of a group lie one after another on a line of 2^52
units, each as long as its share, and the line is cut into as many equal slots as there are items. A
draw falls into one slot and meets on average at most two items there, however uneven the weights.
Positions and running sums are made in hash buckets of bounded size, so no group, a hub's
neighbour list or the whole node set, is ever held by one task.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import SPAN, draw, unit
from ..plans.lineage import cut, discard
from ..plans.ranks import first_k, with_row_index
from ..plans.skew import salted_join
from .graph import Graph, canonical

BUCKET_ROWS = 100_000
SLOT_BLOCK = 4096


def _in_buckets(df: DataFrame, group: list[str], item: list[str], counts: DataFrame, seed) -> DataFrame:
    """Rows with their group's values from `counts`, the order key `_h` and a bucket of bounded size."""
    rows = salted_join(df, counts, group, item, counts=counts).withColumn("_h", draw(*item, seed=seed))
    buckets = F.ceil(F.col("n") / F.lit(BUCKET_ROWS))
    return rows.withColumn("_b", F.floor(F.col("_h") / F.lit(float(SPAN)) * buckets).cast("int"))


def positions(df: DataFrame, group: list[str], item: list[str], seed) -> DataFrame:
    """Adds n (rows of the group) and pos, 0..n-1 within the group in the order of the item's draw."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    rows = _in_buckets(df, group, item, counts, seed)
    sizes = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_b", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *item)
    return (rows.join(starts, group + ["_b"]).withColumn("pos", F.col("_start") + F.row_number().over(inside) - 1)
            .drop("_b", "_h", "_start"))


def slot_of(point, total, slots) -> Column:
    """Slot of a point on a line of `total` units in `slots` equal parts."""
    return F.least(F.floor(point.cast("double") / total.cast("double") * slots), slots - 1).cast("bigint")


def pick_table(df: DataFrame, group: list[str], item: list[str], weight: str, seed="order") -> tuple[DataFrame, DataFrame]:
    """Guide table (group, slot, item, lo, hi) and totals (group, total, slots) for weighted choice.

    Items with weight 0 or less are never chosen and get no place.
    """
    rows = df.filter(F.col(weight) > 0)
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("_sum"))
    rows = _in_buckets(rows, group, item, sums, seed).withColumn(
        "_mass", F.greatest(F.round(F.col(weight) / F.col("_sum") * float(SPAN)).cast("bigint"), F.lit(1)))
    rows = cut(rows.select(*group, *item, "n", "_h", "_b", "_mass"), "masses")
    masses = rows.groupBy(*group, "_b").agg(F.sum("_mass").alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a bucket knows its group's total, so the lines needn't be joined with the totals as well
    starts = masses.select(*group, "_b", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"), F.sum("_size").over(every).alias("total"))
    totals = cut(rows.groupBy(*group).agg(F.sum("_mass").alias("total"), F.count(F.lit(1)).alias("slots")), "totals")
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *item).rowsBetween(Window.unboundedPreceding, 0)
    line = (rows.join(starts, group + ["_b"]).withColumn("hi", F.col("_start") + F.sum("_mass").over(inside))
            .withColumn("lo", F.col("hi") - F.col("_mass")).select(*group, *item, "lo", "hi", "total", F.col("n").alias("slots")))
    first = slot_of(F.col("lo"), F.col("total"), F.col("slots"))
    last = slot_of(F.col("hi") - 1, F.col("total"), F.col("slots"))
    line = cut(line.withColumn("_first", first).withColumn("_last", last).drop("total", "slots"), "line")
    discard(rows)
    narrow = line.filter(F.col("_last") - F.col("_first") < SLOT_BLOCK)
    wide = (line.filter(F.col("_last") - F.col("_first") >= SLOT_BLOCK)
            .withColumn("_first", F.explode(F.sequence("_first", "_last", F.lit(SLOT_BLOCK).cast("bigint"))))
            .withColumn("_last", F.least("_last", F.col("_first") + SLOT_BLOCK - 1)).repartition("_first", *item))
    table = (narrow.unionByName(wide).withColumn("slot", F.explode(F.sequence("_first", "_last")))
             .select(*group, "slot", *item, "lo", "hi"))
    return table, totals


def weighted_choice(draws: DataFrame, table: DataFrame, totals: DataFrame, group: list[str], u) -> DataFrame:
    """One item for each row of `draws`, chosen by u in [0, 1) from the row's group."""
    spread = [c for c in draws.columns if c not in group]
    rows = salted_join(draws.withColumn("_u", u), totals, group, spread)
    rows = rows.withColumn("_t", F.floor(F.col("_u") * F.col("total"))).withColumn(
        "slot", slot_of(F.col("_t"), F.col("total"), F.col("slots"))).drop("total", "slots", "_u")
    # a group with few items and very many draws is hot here as well
    met = salted_join(rows, table, group + ["slot"], spread)
    return met.filter((F.col("lo") <= F.col("_t")) & (F.col("_t") < F.col("hi"))).drop("_t", "slot", "lo", "hi")


def _choose_global(draws: DataFrame, table: DataFrame, totals: DataFrame, u) -> DataFrame:
    """weighted_choice with one group: its totals are a single row."""
    size = totals.first()
    rows = draws.withColumn("_t", F.floor(u * F.lit(size.total)).cast("bigint")).withColumn(
        "slot", slot_of(F.col("_t"), F.lit(size.total), F.lit(size.slots)))
    return (rows.join(table, "slot").filter((F.col("lo") <= F.col("_t")) & (F.col("_t") < F.col("hi")))
            .drop("_t", "slot", "lo", "hi"))


def numbers(spark, n: int, name: str = "i") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def neighbor_sample(adj: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(src, slot 0..k-1, dst): k neighbours of each node that has any.

    More than k neighbours: k different ones. Fewer: k draws with repeats. Exactly k: all.
    """
    placed = positions(adj.select("src", "dst"), ["src"], ["src", "dst"], seed)
    placed = cut(placed, "places")
    whole = placed.filter((F.col("n") >= k) & (F.col("pos") < k)).select("src", F.col("pos").alias("slot"), "dst")
    few = placed.filter(F.col("n") < k)
    wanted = (few.filter("pos = 0").select("src", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")).alias("slot"))
              .withColumn("pos", F.floor(unit("src", "slot", seed=f"{seed}|pad") * F.col("n"))))
    return whole.unionByName(wanted.join(few.drop("n"), ["src", "pos"]).select("src", "slot", "dst"))


def neighbor_subsample(sampled: DataFrame, num_samples: int, seed: int = 0) -> DataFrame:
    """A uniform part of the sampled neighbours: num_samples slots of each node, renumbered."""
    mixed = Window.partitionBy("src").orderBy(draw("src", "slot", seed=f"{seed}|mix"), "slot")
    return (sampled.withColumn("_r", F.row_number().over(mixed)).filter(F.col("_r") <= num_samples)
            .select("src", (F.col("_r") - 1).cast("bigint").alias("slot"), "dst"))


def khop_support(batch: DataFrame, sampled: DataFrame, num_samples: list[int], seed: int = 0) -> DataFrame:
    """(root, hop, path, node): hop 0 is the batch; each hop fans out, the last layer's count first.

    `path` numbers the rows of one hop of one root. A node without neighbours stops its branch.
    """
    level = batch.select(F.col("id").alias("root"), F.lit(0).alias("hop"), F.lit(0).cast("bigint").alias("path"), F.col("id").alias("node"))
    out = level
    for hop, count in enumerate(reversed(num_samples), 1):
        part = neighbor_subsample(sampled, count, seed).withColumnRenamed("src", "node")
        level = (salted_join(level, part, ["node"], ["root", "path"])
                 .select("root", F.lit(hop).alias("hop"), (F.col("path") * count + F.col("slot")).alias("path"), F.col("dst").alias("node")))
        out = out.unionByName(level)
    return out


def negative_table(degree: DataFrame, power: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Guide table over all nodes with weight degree^power."""
    weights = degree.select(F.lit(0).alias("all"), F.col("id").alias("node"), F.pow(F.col("degree").cast("double"), F.lit(power)).alias("w"))
    table, totals = pick_table(weights, ["all"], ["node"], "w")
    return table.drop("all"), totals


def negative_sample(draws: DataFrame, degree: DataFrame, keys: list[str], seed: int = 0, power: float = 0.75,
                    table: tuple | None = None) -> DataFrame:
    """Adds `node`, drawn in proportion to degree^power, to each row; repeats are allowed."""
    guide, totals = table or negative_table(degree, power)
    return _choose_global(draws, guide, totals, unit(*keys, seed=seed))


def negative_sample_loguniform(draws: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Adds class 0..n-1 with P(c) = log((c+2)/(c+1)) / log(n+1)."""
    picked = F.floor(F.exp(unit(*keys, seed=seed) * math.log(n + 1.0))) - 1
    return draws.withColumn("class", F.least(picked, F.lit(n - 1)).cast("bigint"))


def edge_sample(edges: DataFrame, num_draws: int, seed: int = 0) -> DataFrame:
    """(i, src, dst) for i = 0..num_draws-1: edges in proportion to their weight."""
    weighted = edges.select(F.lit(0).alias("all"), "src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    table, totals = pick_table(weighted, ["all"], ["src", "dst"], "weight")
    return _choose_global(numbers(edges.sparkSession, num_draws), table.drop("all"), totals, unit("i", seed=seed))


def sample_non_edges(graph: Graph, index: DataFrame, k: int, seed: int = 0, also: DataFrame | None = None) -> DataFrame:
    """k distinct pairs (src, dst) of two different nodes that are no edge, nor in `also`.

    Candidates are numbered hash draws; the first k that pass are taken. Rounds with more candidates
    follow until k pass.
    """
    n = index.count()
    known = graph.edges.select("src", "dst")
    if also is not None:
        known = known.union(also.select("src", "dst"))
    known = canonical(known, graph.directed)
    slots = n * (n - 1) // (1 if graph.directed else 2)
    if k > slots:
        raise ValueError(f"{k} pairs wanted, only {slots} exist")
    tries = 2 * k + 64
    while True:
        cand = numbers(index.sparkSession, tries).select(
            "i", F.floor(unit("i", F.lit("a"), seed=seed) * n).alias("_a"), F.floor(unit("i", F.lit("b"), seed=seed) * n).alias("_b"))
        cand = (cand.filter("_a <> _b").join(index.select(F.col("idx").alias("_a"), F.col("id").alias("src")), "_a")
                .join(index.select(F.col("idx").alias("_b"), F.col("id").alias("dst")), "_b").drop("_a", "_b"))
        fresh = (canonical(cand, graph.directed).groupBy("src", "dst").agg(F.min("i").alias("i"))
                 .join(known, ["src", "dst"], "left_anti"))
        fresh = cut(fresh, "non-edges")
        found = fresh.count()
        if found >= k:
            return fresh.filter(first_k(fresh, k, "i", ["src"], span=tries)).select("src", "dst")
        if tries > 64 * slots + 4096 or slots - known.distinct().filter("src <> dst").count() < k:
            raise ValueError(f"fewer than {k} pairs are no edge")
        tries *= 4


def minibatches(items: DataFrame, keys: list[str], batch_size: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """Adds batch_id: the rows in shuffled order, cut every batch_size rows."""
    mixed = items.withColumn("_h", draw(*keys, F.lit(epoch), seed=seed))
    return (with_row_index(mixed, ["_h", *keys], "_i").withColumn("batch_id", F.floor(F.col("_i") / batch_size))
            .drop("_h", "_i"))


def subset(items: DataFrame, keys: list[str], size: int, seed: int = 0) -> DataFrame:
    """A random subset of the given size (all rows when there are fewer)."""
    keyed = items.withColumn("_h", draw(*keys, seed=seed))
    return keyed.filter(first_k(keyed, size, "_h", keys)).drop("_h")
