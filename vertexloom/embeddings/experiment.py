"""The whole run: hold out edges, embed, score."""

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.evaluate import lp_auc, lp_score, lp_test_set, nc_evaluate, run_summary
from ..operators.graph import Graph, node_index
from ..plans.lineage import cut
from ..sources.writers import write_embeddings
from .factor import aane, tadw
from .gradient import asne, line
from .result import Embedding
from .sage import sagegcn, sagemean
from .spectral import attrpure, grarep
from .walked import abrw, attrcomb, deepwalk, node2vec

STRUCTURE = {"deepwalk": deepwalk, "node2vec": node2vec, "line": line, "grarep": grarep}
WITH_ATTRIBUTES = {"abrw": abrw, "attrcomb": attrcomb, "tadw": tadw, "aane": aane, "asne": asne, "sagemean": sagemean, "sagegcn": sagegcn}
METHODS = ["attrpure", *STRUCTURE, *WITH_ATTRIBUTES]


def embed(method: str, graph: Graph, attrs: DataFrame | None = None, **options) -> Embedding:
    """One of METHODS; the attributes are read only by methods that use them."""
    if method == "attrpure":
        return attrpure(attrs, **options)
    if method in STRUCTURE:
        return STRUCTURE[method](graph, **options)
    if method in WITH_ATTRIBUTES:
        return WITH_ATTRIBUTES[method](graph, attrs, **options)
    raise ValueError(f"method is one of {', '.join(METHODS)}")


@dataclass
class Run:
    vectors: DataFrame
    metrics: DataFrame


def run_experiment(graph: Graph, method: str, attrs: DataFrame | None = None, labels: DataFrame | None = None, task: str = "lp_and_nc",
                   link_remove: float = 0.2, label_reserved: float = 0.5, emb_path: str | None = None, seed: int = 0, **options) -> Run:
    """task: none, lp, nc or lp_and_nc. Returns the vectors and one row of metrics; scores not asked for are null."""
    if task not in ("none", "lp", "nc", "lp_and_nc"):
        raise ValueError("task is none, lp, nc or lp_and_nc")
    pairs, took = None, {}
    began = time.time()
    if task in ("lp", "lp_and_nc"):
        graph, pairs = lp_test_set(graph, cut(node_index(graph.nodes), "index"), link_remove, seed)
        graph, pairs = graph.with_edges(cut(graph.edges, "edges")), cut(pairs, "pairs")
    took["prepare"], began = time.time() - began, time.time()
    vectors = cut(embed(method, graph, attrs, **options).vectors, "vectors")
    took["embed"], began = time.time() - began, time.time()
    if emb_path:
        write_embeddings(vectors, emb_path)
    none = F.lit(None).cast("double")
    scores = graph.nodes.sparkSession.range(1).select(F.lit(0).alias("_one"))
    if pairs is not None:
        auc = cut(lp_auc(lp_score(pairs, vectors)), "auc")
        scores = scores.join(auc.withColumn("_one", F.lit(0)), "_one")
    else:
        scores = scores.withColumns({"positives": F.lit(None).cast("bigint"), "negatives": F.lit(None).cast("bigint"), "auc": none})
    if task in ("nc", "lp_and_nc"):
        f1 = cut(nc_evaluate(vectors, labels, label_reserved, seed), "f1")
        scores = scores.join(f1.withColumn("_one", F.lit(0)), "_one")
    else:
        scores = scores.withColumns({c: none for c in ("micro", "macro", "samples", "weighted")})
    took["evaluate"] = time.time() - began
    summary = run_summary(graph, took).withColumn("_one", F.lit(0))
    return Run(vectors, scores.join(summary, "_one").drop("_one").withColumn("method", F.lit(method)))
