"""Readers for the text and JSON inputs; every reader returns tables with an explicit schema."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import Graph, canonical, edge_train_mask
from ..operators.matrix import standard_scale

NODE_LINK = ("nodes array<struct<id:string,val:boolean,test:boolean>>,"
             "links array<struct<source:string,target:string>>")

# Fixed value: the summary lines of a run log, with the time, the AUC and the two F1 scores as groups.
LOG_PATTERN = (r"(?s)STEP3: end learning embeddings; time cost: (\d+\.\d+)s.*roc= (\d+\.\d+).*"
               r"\{'micro': (\d+\.\d+), 'macro': (\d+\.\d+), 'samples': \d+\.\d+, 'weighted': \d+\.\d+\}")


def _tokens(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    line = F.col("value")
    if comment:
        line = F.split_part(line, F.lit(comment), F.lit(1))
    return (spark.read.text(path).select(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ").alias("t"))
            .filter(F.col("t")[0] != ""))


def read_adjlist(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """`u v1 v2 ...`: unweighted edges from u; a line with only u is an isolated node."""
    rows = _tokens(spark, path, "#")
    nodes = rows.select(F.explode("t").alias("id")).distinct()
    edges = rows.select(F.col("t")[0].alias("src"), F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("dst"))
    edges = canonical(edges, directed).distinct().withColumn("weight", F.lit(None).cast("double"))
    return Graph(nodes, edges, directed)


def read_edgelist(spark: SparkSession, path: str, weighted: bool = False, directed: bool = False) -> Graph:
    """`u v [w]`: the last line of a repeated edge wins; without `weighted` the third column is not read."""
    rows = _tokens(spark, path, "#").filter(F.size("t") > 1)
    weight = F.coalesce(F.try_element_at("t", F.lit(3)).cast("double"), F.lit(1.0)) if weighted else F.lit(None).cast("double")
    raw = rows.select(F.col("t")[0].alias("src"), F.col("t")[1].alias("dst"), weight.alias("weight"),
                      F.monotonically_increasing_id().alias("_line"))
    edges = canonical(raw, directed).groupBy("src", "dst").agg(F.max_by("weight", "_line").alias("weight"))
    nodes = edges.select("src").union(edges.select("dst")).distinct().toDF("id")
    return Graph(nodes, edges, directed)


def _floats(tokens):
    return F.transform(F.slice(tokens, 2, F.size(tokens) - 1), lambda x: x.cast("double"))


def read_node_attr(spark: SparkSession, path: str) -> DataFrame:
    """`id a1 ... aM` -> (id, features)."""
    return _tokens(spark, path).select(F.col("t")[0].alias("id"), _floats(F.col("t")).alias("features"))


def read_node_labels(spark: SparkSession, path: str) -> DataFrame:
    """`id l1 [l2 ...]`, split at single blanks -> (id, labels)."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("t"))
    return rows.select(F.col("t")[0].alias("id"), F.slice("t", 2, F.size("t") - 1).alias("labels"))


def read_edge_labels(spark: SparkSession, path: str) -> DataFrame:
    """`u v label` -> (src, dst, label)."""
    return spark.read.csv(path, sep=" ", schema="src string, dst string, label string",
                          ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Header `n dim` at the start of each file, then `id x1 ... xd` -> (id, vector)."""
    lines = spark.read.csv(path, schema="value string", header=True, sep="\u0001", quote="\u0000")
    return (lines.select(F.split(F.trim("value"), r"\s+").alias("t"))
            .select(F.col("t")[0].alias("id"), _floats(F.col("t")).alias("vector")))


def _odd_quotes(value):
    """Is there a string that begins or ends elsewhere?"""
    return F.length(F.regexp_replace(F.regexp_replace(value, r"\\\\.", ""), '[^"]', "")) % 2 == 1


def _flat_objects(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, val, test, source, target) of the flat objects in a JSON file, which Spark reads in ranges cut at closing braces; None where that
    can't tell them: a brace inside a string, or an object inside one of them."""
    piece = spark.read.option("lineSep", "}").text(path)
    nested = F.col("value").rlike(r'(?s)"(id|val|test|source|target)"\s*:.*\{') | (~F.contains("value", F.lit("{")) & F.contains("value", F.lit(":")))
    if not piece.filter(_odd_quotes(F.col("value")) | nested).isEmpty():
        return None
    text = F.concat(F.regexp_extract("value", r"(?s)\{[^{]*\z", 0), F.lit("}"))
    return piece.filter(F.contains("value", F.lit("{"))).select(F.from_json(text, "id string, val boolean, test boolean, source string, target string").alias("o")).select("o.*")


def read_node_link_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Node-link graph file -> nodes(id, val, test) with both marks, edges(src, dst, train_removed).

    One document is read in many tasks, unless braces stand in its strings or its nodes and links have objects inside: then by one. A graph can also come
    as many documents, each on its own line.
    """
    flat = None if lines else _flat_objects(spark, path)
    if flat is None:
        doc = spark.read.schema(NODE_LINK).json(path, multiLine=not lines)
        found = doc.select(F.explode("nodes").alias("n")).select("n.id", "n.val", "n.test")
        links = doc.select(F.explode("links").alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"))
    else:
        found = flat.filter("id IS NOT NULL AND source IS NULL").select("id", "val", "test")
        links = flat.filter("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    nodes = found.filter(F.col("val").isNotNull() & F.col("test").isNotNull()).distinct()
    plain = Graph(nodes.select("id"), canonical(links, False).distinct())
    return nodes, edge_train_mask(plain, nodes)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object id -> number, or id -> list, as rows (id, value) with the value as text.

    It is read in ranges cut at commas, or at closing brackets where the first value is a list; by one task where that can't tell the entries.
    """
    first = spark.read.option("lineSep", ",").text(path).first()
    close = "]" if first is not None and "[" in first.value else ""
    piece = spark.read.option("lineSep", close or ",").text(path).filter(~F.col("value").rlike(r"^[\s{},]*$"))
    entry = r'(?s)^[\s{,]*"((?:[^"\\]|\\.)*)"\s*:\s*' + (r"(\[[^\[\]{}]*)$" if close else r'("(?:[^"\\]|\\.)*"|[^\[\]{}",:]*?)[\s}]*$')
    if not piece.filter(~F.col("value").rlike(entry)).isEmpty():
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "value"))
    text = F.concat(F.lit('{"k":"'), F.regexp_extract("value", entry, 1), F.lit('","v":'), F.regexp_extract("value", entry, 2), F.lit(close + "}"))
    return piece.select(F.from_json(text, "k string, v string").alias("e")).select(F.col("e.k").alias("id"), F.col("e.v").alias("value"))


@dataclass
class GraphData:
    """A graph with its marks and what belongs to its nodes."""

    graph: Graph
    nodes: DataFrame  # id, val, test
    edges: DataFrame  # src, dst, train_removed
    labels: DataFrame  # id, labels
    features: DataFrame | None  # id, features
    walks: DataFrame | None  # src, dst


def read_graph_data(spark: SparkSession, prefix: str, features: DataFrame | None = None, normalize: bool = True, walks: bool = False) -> GraphData:
    """`<prefix>-G.json`, `-class_map.json`, `-id_map.json` and (walks) `-walks.txt` as one.

    `features` has (place, features) rows, which the id map gives to nodes. With `normalize` they are scaled by mean and deviation of the nodes
    that are neither for validation nor for testing. A class is a label; a list of marks for each class gives those that are set.
    """
    nodes, edges = read_node_link_json(spark, f"{prefix}-G.json")
    known = nodes.select("id")
    classes = read_id_map(spark, f"{prefix}-class_map.json").join(known, "id", "left_semi")
    marks = F.from_json("value", "array<int>")
    set_ = F.filter(F.transform(marks, lambda x, i: F.when(x != 0, i.cast("string"))), lambda x: x.isNotNull())
    labels = classes.select("id", F.when(F.col("value").startswith("["), set_).otherwise(F.array("value")).alias("labels"))
    feats = None
    if features is not None:
        place = read_id_map(spark, f"{prefix}-id_map.json").select("id", F.col("value").cast("bigint").alias("place")).join(known, "id", "left_semi")
        feats = place.join(features, "place").select("id", F.col("features").cast("array<double>").alias("features"))
        if normalize:
            feats = standard_scale(feats, nodes.filter("NOT val AND NOT test"))
    graph = Graph(known, edges.select("src", "dst", F.lit(None).cast("double").alias("weight")))
    return GraphData(graph, nodes, edges, labels, feats, read_pairs(spark, f"{prefix}-walks.txt") if walks else None)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """`u<TAB>v` -> (src, dst)."""
    return spark.read.csv(path, sep="\t", schema="src string, dst string")


def parse_logs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run logs as (path, value) rows -> mean scores for each (dataset, method), and the files without them."""
    stem = F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit(1))
    found = [F.try_element_at(F.regexp_extract_all("value", F.lit(LOG_PATTERN), F.lit(i)), F.lit(-1)).cast("double").alias(n)
             for i, n in ((1, "seconds"), (2, "auc"), (3, "micro_f1"), (4, "macro_f1"))]
    rows = (files.filter(F.col("path").endswith(".log"))
            .select("path", F.split(stem, "-").alias("s"), *found)
            .withColumn("dataset", F.col("s")[0]).withColumn("method", F.try_element_at("s", F.lit(2))).drop("s"))
    good = rows.filter(F.col("method").isNotNull() & F.col("auc").isNotNull())
    bad = rows.filter(F.col("method").isNull() | F.col("auc").isNull()).select("path")
    means = good.groupBy("dataset", "method").agg(
        F.count(F.lit(1)).alias("samples"), *[F.avg(c).alias(c) for c in ("auc", "micro_f1", "macro_f1", "seconds")])
    return means, bad


def read_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All `*.log` files of a folder through parse_logs."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.log")
    return parse_logs(files.select(F.input_file_name().alias("path"), "value"))
