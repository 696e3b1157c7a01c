"""Walk-based embeddings: walks, co-occurrence counts, skip-gram on vertex tables."""

from pyspark.sql import DataFrame, functions as F

from ..operators.graph import Graph, node_index
from ..operators.knn import attr_knn
from ..operators.linalg import truncated_svd
from ..operators.matrix import biased_transition, combine_vectors
from ..operators.pair_counts import pair_counts
from ..operators.walks import deepwalk_walks, node2vec_walks, weighted_walks
from ..plans.lineage import cut
from .gradient import train_pairs
from .result import Embedding


def skipgram(nodes: DataFrame, walks: DataFrame, dim: int = 128, window: int = 10, epochs: int = 10, negatives: float = 5.0,
             learning_rate: float = 0.05, batch_size: int | None = None, passes: int = 5, hs: bool = False, seed: int = 0) -> Embedding:
    """Skip-gram on the pairs of the walks, with negative sampling or (hs) hierarchical softmax. Vectors start small and contexts from 0.

    Equal pairs are counted first, so an epoch reads each distinct pair once however often it was walked.
    """
    pairs = cut(pair_counts(walks, window).select(F.col("centre").alias("u"), F.col("context").alias("v"), F.col("n").alias("w")), "pairs")
    seen = walks.select(F.explode("path").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return train_pairs(nodes, pairs, seen, dim, epochs, negatives, learning_rate, batch_size, passes, seed=seed, scale=0.5 / dim, context_scale=0.0, hs=hs)


def deepwalk(graph: Graph, dim: int = 128, num_walks: int = 10, walk_length: int = 80, window: int = 10, seed: int = 0, hs: bool = True, **train) -> Embedding:
    walks = cut(deepwalk_walks(graph, num_walks, walk_length, seed), "walks")
    return skipgram(graph.nodes, walks, dim, window, hs=hs, seed=seed, **train)


def node2vec(graph: Graph, dim: int = 128, p: float = 0.5, q: float = 0.5, num_walks: int = 10, walk_length: int = 80,
             window: int = 10, seed: int = 0, **train) -> Embedding:
    walks = cut(node2vec_walks(graph, p, q, num_walks, walk_length, seed), "walks")
    return skipgram(graph.nodes, walks, dim, window, seed=seed, **train)


def abrw(graph: Graph, attrs: DataFrame, dim: int = 128, topk: int = 30, beta: float = 0.2, beta_mode: int = 1, alpha: float = 2.71828,
         num_walks: int = 10, walk_length: int = 80, window: int = 10, probes: int | None = None, seed: int = 0, recall: float | None = None, **train) -> Embedding:
    """Walks on the mix of neighbours and attribute-similar nodes; `recall` or `probes` makes the similarity search approximate."""
    similar = cut(attr_knn(attrs, topk, probes, seed=seed, recall=recall), "similar")
    cells, even = biased_transition(graph, similar, beta_mode, beta, alpha)
    walks = cut(weighted_walks(graph.nodes, cells, cut(even, "even"), cut(node_index(graph.nodes), "index"), num_walks, walk_length, seed), "walks")
    return skipgram(graph.nodes, walks, dim, window, seed=seed, **train)


def attrcomb(graph: Graph, attrs: DataFrame, dim: int = 128, comb_method: str = "concat", comb_with: str = "deepwalk",
             num_walks: int = 10, walk_length: int = 80, window: int = 10, p: float = 0.8, q: float = 0.8, seed: int = 0, **train) -> Embedding:
    """SVD of the attributes joined with a walk embedding (half the width each when they are put side by side)."""
    width = dim // 2 if comb_method == "concat" else dim
    if comb_with == "deepwalk":
        walked = deepwalk(graph, width, num_walks, walk_length, window, seed, **train)
    elif comb_with == "node2vec":
        walked = node2vec(graph, width, p, q, num_walks, walk_length, window, seed, **train)
    else:
        raise ValueError("comb_with is deepwalk or node2vec")
    return Embedding(combine_vectors(truncated_svd(attrs, width)[0], walked.vectors, comb_method), walked.history)
