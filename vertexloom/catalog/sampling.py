"""Sampling and walks."""

from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..operators import graph as G, sampling as S, walks as K
from ..operators.pair_counts import pair_counts
from ..plans.lineage import cut
from .base import P, V, h, node_flags, purchases, query, u, vectors
from .graphs import flags_of
from .matrices import BETAS, biased, biased_sql


def line_sql(name: str, source: str, weight: str, group: str = "src", items: tuple = ("dst",)) -> str:
    """CTE of items on their group's line: lo, hi and the group's total."""
    cols = ", ".join(items)
    return f"""{name}_w AS MATERIALIZED (SELECT {group} AS grp, {cols}, {h(*items, seed='order')} AS hh,
  greatest(1, round({weight} / sum({weight}) OVER (PARTITION BY {group}) * 4503599627370496.0::DOUBLE)::BIGINT) AS mass FROM {source} WHERE {weight} > 0),
{name} AS MATERIALIZED (SELECT grp, {cols}, sum(mass) OVER (PARTITION BY grp ORDER BY hh, {cols} ROWS UNBOUNDED PRECEDING)::BIGINT AS hi, mass,
  (sum(mass) OVER (PARTITION BY grp))::BIGINT AS total FROM {name}_w)"""


def hit(t: str, uu: str) -> str:
    """Does the draw fall on this item?"""
    point = f"floor({uu} * {t}.total::DOUBLE)::BIGINT"
    return f"{t}.hi - {t}.mass <= {point} AND {point} < {t}.hi"


def path_rows(walks):
    return (walks.select(F.col("round").cast("bigint").alias("round"), "start", F.posexplode("path").alias("i", "node"))
            .withColumn("i", F.col("i").cast("bigint")))


@query("weighted_choice", f"""WITH {P}, {line_sql('line', 'p_adj', 'weight')}
SELECT id AS src, i, dst FROM p_nodes, (SELECT unnest(range(0, 3)) AS i), line
WHERE grp = id AND {hit('line', u('id', 'i', seed=31))}""")
def weighted_choice(spark, sf):
    g = purchases(spark, sf)
    table, totals = S.pick_table(g.adj, ["src"], ["dst"], "weight")
    draws = g.nodes.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("i"))
    return S.weighted_choice(draws, table, totals, ["src"], unit("src", "i", seed=31)).select("src", "i", "dst")


def uniform_walk_sql(adj: str, nodes: str, rounds: int, length: int, seed) -> str:
    return f"""pos AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {h('src', 'dst', seed='order')}, src, dst) - 1 AS pos,
  count(*) OVER (PARTITION BY src) AS n FROM {adj}),
w AS (SELECT r AS round, id AS start, 0::BIGINT AS i, id AS node FROM {nodes}, (SELECT unnest(range(0, {rounds})) AS r)
  UNION ALL SELECT w.round, w.start, w.i + 1, p.dst FROM w JOIN pos p ON p.src = w.node
    AND p.pos = floor({u('w.round', 'w.start', 'w.i + 1', seed=seed)} * p.n)::BIGINT WHERE w.i + 1 < {length})"""


@query("deepwalk_walks", f"WITH RECURSIVE {V}, {uniform_walk_sql('v_adj', 'v_nodes', 10, 80, 3)} SELECT round, start, i, node FROM w")
def deepwalk_walks(spark, sf):
    return path_rows(K.deepwalk_walks(vectors(spark, sf), seed=3))


@query("node2vec_walks", f"""WITH RECURSIVE {V}, {line_sql('line', 'v_adj', 'weight')}, totals AS (SELECT DISTINCT grp, total FROM line),
w AS (SELECT r::BIGINT AS round, id AS start, 1::BIGINT AS step, 0::BIGINT AS attempt, NULL::VARCHAR AS prev, id AS cur, true AS moved FROM v_nodes, (SELECT unnest(range(0, 10)) AS r)
  UNION ALL
  SELECT round, start, CASE WHEN ok THEN step + 1 ELSE step END, CASE WHEN ok THEN 0 ELSE attempt + 1 END,
         CASE WHEN ok THEN cur ELSE prev END, CASE WHEN ok THEN x ELSE cur END, ok
  FROM (SELECT c.round, c.start, c.step, c.attempt, c.prev, c.cur, l.dst AS x,
          c.prev IS NULL OR c.goes_back OR {u('c.round', 'c.start', 'c.step', 'c.attempt', "'accept'", seed=4)} * 1.25::DOUBLE < CASE WHEN k.src IS NOT NULL THEN 1.0 ELSE 1 / 0.8::DOUBLE END AS ok
        FROM (SELECT *, CASE WHEN goes_back THEN lo WHEN drawn >= lo THEN drawn + gap ELSE drawn END AS point
              FROM (SELECT *, gap > 0 AND (total <= gap OR {u('round', 'start', 'step', 'attempt', "'back'", seed=4)} * (gap / 0.5::DOUBLE + (total - gap) * 1.25::DOUBLE) < gap / 0.5::DOUBLE) AS goes_back,
                      floor({u('round', 'start', 'step', 'attempt', seed=4)} * (total - gap)::DOUBLE)::BIGINT AS drawn
                    FROM (SELECT w.*, t.total, b.hi - b.mass AS lo, coalesce(b.mass, 0) AS gap FROM w JOIN totals t ON t.grp = w.cur
                          LEFT JOIN line b ON b.grp = w.cur AND b.dst = w.prev WHERE w.step < 80))) c
        JOIN line l ON l.grp = c.cur AND l.hi - l.mass <= c.point AND c.point < l.hi
        LEFT JOIN v_adj k ON k.src = l.dst AND k.dst = c.prev))
SELECT round, start, step - 1 AS i, cur AS node FROM w WHERE moved""")
def node2vec_walks(spark, sf):
    return path_rows(K.node2vec_walks(vectors(spark, sf), 0.5, 0.8, seed=4))


@query("weighted_walks", f"""WITH RECURSIVE {biased_sql(BETAS[1])}, {line_sql('line', 't', 'value', '"row"', ('col',))},
w AS (SELECT r AS round, id AS start, 0::BIGINT AS i, id AS node FROM v_nodes, (SELECT unnest(range(0, 10)) AS r)
  UNION ALL SELECT w.round, w.start, w.i + 1, l.col FROM w JOIN line l ON l.grp = w.node
    AND {hit('l', u('w.round', 'w.start', 'w.i + 1', seed=6))} WHERE w.i + 1 < 80)
SELECT round, start, i, node FROM w""")
def weighted_walks(spark, sf):
    cells, even = biased(spark, sf, 1)
    g = vectors(spark, sf)
    return path_rows(K.weighted_walks(g.nodes, cells, even, G.node_index(g.nodes), seed=6))


SPLIT = node_flags(0.1, 0.2, 11)
TRAIN_ADJ = """train AS (SELECT id FROM flags WHERE NOT test AND NOT val),
t_adj AS (SELECT src, dst FROM v_adj WHERE src IN (SELECT id FROM train) AND dst IN (SELECT id FROM train))"""


@query("walk_pairs", f"""WITH RECURSIVE {V}, {SPLIT}, {TRAIN_ADJ}, {uniform_walk_sql('t_adj', 'train', 50, 5, 8)}
SELECT start AS src, node AS dst, count(*) AS n FROM w WHERE node <> start GROUP BY 1, 2""")
def walk_pairs(spark, sf):
    g = vectors(spark, sf)
    pairs = K.walk_pairs(g, flags_of(spark, sf, g), 50, 5, seed=8)
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("skipgram_pairs", f"""WITH RECURSIVE {V}, {uniform_walk_sql('v_adj', 'v_nodes', 10, 80, 9)}
SELECT a.node AS centre, b.node AS context, count(*) AS n FROM w a JOIN w b ON a.round = b.round AND a.start = b.start
AND a.i <> b.i AND abs(a.i - b.i) <= 10 GROUP BY 1, 2""")
def skipgram_pairs(spark, sf):
    return pair_counts(cut(K.deepwalk_walks(vectors(spark, sf), seed=9), "walks"))


def sample_sql(name: str, adj: str, k: int, seed) -> str:
    return f"""{name}_p AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {h('src', 'dst', seed=seed)}, src, dst) - 1 AS pos,
  count(*) OVER (PARTITION BY src) AS n FROM {adj}),
{name} AS (SELECT src, pos AS slot, dst FROM {name}_p WHERE n >= {k} AND pos < {k}
  UNION ALL SELECT p.src, s.slot, p.dst FROM {name}_p p JOIN (SELECT src, n, unnest(range(0, {k})) AS slot FROM {name}_p WHERE n < {k} AND pos = 0) s
    ON p.src = s.src AND p.pos = floor({u('s.src', 's.slot', seed=f'{seed}|pad')} * s.n)::BIGINT)"""


@query("neighbor_sample", f"WITH {P}, {sample_sql('sampled', 'p_adj', 32, 13)} SELECT src, slot, dst FROM sampled")
def neighbor_sample(spark, sf):
    return S.neighbor_sample(purchases(spark, sf).adj, 32, seed=13)


def subsample_sql(name: str, source: str, k: int, seed) -> str:
    return f"""{name} AS (SELECT src, r - 1 AS slot, dst FROM (SELECT src, dst,
  row_number() OVER (PARTITION BY src ORDER BY {h('src', 'slot', seed=f'{seed}|mix')}, slot) AS r FROM {source}) WHERE r <= {k})"""


@query("neighbor_subsample", f"""WITH {P}, {sample_sql('sampled', 'p_adj', 32, 13)}, {subsample_sql('part_of', 'sampled', 10, 14)}
SELECT src, slot, dst FROM part_of""")
def neighbor_subsample(spark, sf):
    return S.neighbor_subsample(S.neighbor_sample(purchases(spark, sf).adj, 32, seed=13), 10, seed=14)


@query("khop_support", f"""WITH {V}, {sample_sql('sampled', 'v_adj', 10, 13)}, {subsample_sql('near', 'sampled', 3, 15)}, {subsample_sql('far', 'sampled', 5, 15)},
hop1 AS (SELECT id AS root, slot AS path, dst AS node FROM v_nodes JOIN near ON src = id)
SELECT id AS root, 0 AS hop, 0::BIGINT AS path, id AS node FROM v_nodes UNION ALL SELECT root, 1, path, node FROM hop1
UNION ALL SELECT root, 2, path * 5 + slot, dst FROM hop1 JOIN far ON src = node""")
def khop_support(spark, sf):
    g = vectors(spark, sf)
    return S.khop_support(g.nodes, S.neighbor_sample(g.adj, 10, seed=13), [5, 3], seed=15)


DEGREE = """deg AS (SELECT id, count(src) AS degree FROM v_nodes LEFT JOIN v_adj ON src = id GROUP BY id),
dw AS (SELECT 0 AS one, id AS node, pow(degree::DOUBLE, 0.75) AS w FROM deg)"""
NEGATIVES = f"{DEGREE}, {line_sql('nline', 'dw', 'w', 'one', ('node',))}"


@query("negative_sample", f"""WITH {V}, {NEGATIVES}
SELECT src, dst, i, node FROM v_edges, (SELECT unnest(range(0, 2)) AS i), nline WHERE {hit('nline', u('src', 'dst', 'i', seed=17))}""")
def negative_sample(spark, sf):
    return negatives(vectors(spark, sf), 2, 17)


def negatives(g, count, seed, edges=None):
    """(src, dst, i, node): `count` negatives for each edge, with the further columns of `edges` where these are given."""
    edges = g.edges.select("src", "dst") if edges is None else edges
    draws = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")).alias("i"))
    return S.negative_sample(draws, G.degrees(g), ["src", "dst", "i"], seed).select("src", "dst", "i", "node", *[c for c in edges.columns if c not in ("src", "dst")])


@query("negative_sample_loguniform", f"""WITH {P}, sz AS (SELECT count(*) AS n FROM p_nodes)
SELECT src, dst, least(floor(exp({u('src', 'dst', seed=18)} * ln(n + 1.0::DOUBLE)))::BIGINT - 1, n - 1) AS class FROM p_edges, sz""")
def negative_sample_loguniform(spark, sf):
    g = purchases(spark, sf)
    return S.negative_sample_loguniform(g.edges.select("src", "dst"), g.nodes.count(), ["src", "dst"], 18)


@query("edge_sample", f"""WITH {P}, one AS (SELECT 0 AS one, * FROM p_edges), {line_sql('line', 'one', 'weight', 'one', ('src', 'dst'))},
draws AS (SELECT i, floor({u('i', seed=19)} * (SELECT any_value(total) FROM line)::DOUBLE)::BIGINT AS t FROM (SELECT unnest(range(0, (SELECT count(*) FROM p_edges))) AS i)),
cuts AS (SELECT hi - mass AS lo, src, dst FROM line)
SELECT i, src, dst FROM draws ASOF JOIN cuts ON draws.t >= cuts.lo""")
def edge_sample(spark, sf):
    g = purchases(spark, sf)
    return S.edge_sample(g.edges, g.edges.count(), seed=19).select("i", "src", "dst")


def non_edge_sql(nodes: str, edges: str, k: str, seed) -> str:
    """CTE non_edges: the first k numbered candidates that are no edge; one round is enough here."""
    return f"""idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM {nodes}),
want AS (SELECT {k} AS k),
cand AS (SELECT i, floor({u('i', "'a'", seed=seed)} * (SELECT count(*) FROM idx))::BIGINT AS a, floor({u('i', "'b'", seed=seed)} * (SELECT count(*) FROM idx))::BIGINT AS b
  FROM (SELECT unnest(range(0, (SELECT 2 * k + 64 FROM want))) AS i)),
fresh AS (SELECT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst, min(i) AS i FROM cand JOIN idx x ON x.idx = a JOIN idx y ON y.idx = b
  WHERE a <> b GROUP BY 1, 2),
non_edges AS (SELECT src, dst FROM (SELECT f.src, f.dst, row_number() OVER (ORDER BY i) AS r FROM fresh f ANTI JOIN {edges} e ON e.src = f.src AND e.dst = f.dst), want WHERE r <= k)"""


@query("sample_non_edges", f"""WITH {P}, {non_edge_sql('p_nodes', 'p_edges', '(SELECT floor(0.1::DOUBLE * count(*))::BIGINT FROM p_edges)', 20)} SELECT src, dst FROM non_edges""")
def sample_non_edges(spark, sf):
    g = purchases(spark, sf)
    return S.sample_non_edges(g, G.node_index(g.nodes), int(0.1 * g.edges.count()), seed=20)


@query("minibatches", f"""WITH {P} SELECT src, dst, (row_number() OVER (ORDER BY {h('src', 'dst', '2', seed=22)}, src, dst) - 1) // 128 AS batch_id FROM p_edges""")
def minibatches(spark, sf):
    return S.minibatches(purchases(spark, sf).edges.select("src", "dst"), ["src", "dst"], 128, epoch=2, seed=22)
