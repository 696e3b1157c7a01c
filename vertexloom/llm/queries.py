"""The queries of this subpackage and their SQL."""

from pyspark.sql import functions as F

from ..catalog.base import table
from . import chat, conversation_repair, decontaminate, exact_dedup, hard_negatives, lattice_lm, near_dedup, pieces, repeats, sharding, token_counts, toxicity, url_filter

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_sentencepiece")
def op1(spark, sf):
    """Each document's pieces with merge-dropout, and whether they decode to the document."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    coded = pieces.with_pieces(docs, tokenizer("piece_bpe_32k.model"), ["doc_id", "n_bytes"])
    return coded.select("doc_id", "n_bytes", F.coalesce(F.array_size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids", "lossless")


@query("op2_token_counts")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                          token_counts.token_count("text", tokenizer("byte_bpe_50k.json")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


#: Bytes of text in a shard: so few that tables of every size are split.
SHARD_BYTES = 128 << 10


def sharding_sql(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS a FROM documents),
p AS (SELECT *, a >> (60 - depth) AS prefix FROM d, unnest(range(0, 61)) AS t(depth)),
n AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY 1, 2 HAVING sum(n_bytes) <= {limit} OR min(a) = max(a)),
s AS (SELECT doc_id, min(depth) AS depth FROM p JOIN n USING (depth, prefix) GROUP BY 1)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth::INT) END AS shard, depth::BIGINT AS depth, n_bytes, shard_bytes, shard_rows,
       shard_bytes > {limit} AS oversized
FROM s JOIN p USING (doc_id, depth) JOIN n USING (depth, prefix)"""


@query("op4_sharding", sharding_sql(SHARD_BYTES))
def op4(spark, sf, limit: int = SHARD_BYTES):
    placed = sharding.assign(table(spark, sf, "documents"), ["doc_id"], limit)
    return placed.select("row.doc_id", "shard", F.col("depth").cast("bigint").alias("depth"), "n_bytes", "shard_bytes", "shard_rows", "oversized")


@query("op3_near_dedup", f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + least(len(w), 2) - 1] AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d JOIN r ON d.doc_id = r.a LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n""")
def op3(spark, sf):
    return near_dedup.near_groups(table(spark, sf, "documents"), width=2)


@query("op5_decontamination", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, w[s:s + least(len(w), 10) - 1] AS win
       FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, l, s, w[s:s + l - 1] AS win FROM d, (SELECT DISTINCT l FROM iw) AS x(l), unnest(range(1, len(w) - l + 2)) AS t(s)),
hit AS (SELECT DISTINCT doc_id, item_id, s, l FROM dw JOIN iw USING (l, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(s, s + l)) AS t(p) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op5(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op6_exact_dedup", """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op6(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


@query("op8_suffix_dedup", """
WITH v AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + 50], ' ')) AS g FROM v, unnest(range(1, len(w) - 49)) AS u(i)),
shared AS (SELECT g FROM t GROUP BY g HAVING count(*) > 1),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, (2 * p + 1)::INT, 800)) AS k FROM d, unnest(range(0, (len(h) // 2 - 399)::BIGINT)) AS t(p) WHERE len(h) >= 800),
r AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
b AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM b) GROUP BY doc_id, g),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM s),
k AS (SELECT doc_id, string_agg(substr(h, (2 * before + 1)::INT, (2 * (a - before))::INT) || CASE WHEN back = 1 THEN substr(h, (2 * z + 1)::INT) ELSE '' END, '' ORDER BY a) AS kept,
             sum(z - a) AS n_removed, count(*) AS n_spans FROM e JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256, doc_id IN (SELECT doc_id FROM t JOIN shared USING (g)) AS shares_passage FROM d LEFT JOIN k USING (doc_id)""")
def op8(spark, sf):
    found = repeats.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.expr("cast(size(removed) / 2 as bigint)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


@query("op7_chat_format")
def op7(spark, sf):
    """All conversations and one whose texts hold the control strings of several templates, read back from the windows."""
    told = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.read_back(chat.windows(told.unionByName(extra), tokenizer("byte_bpe_50k.json")))


#: Host, path, and what becomes of a URL.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op9_url_filter")
def op9(spark, sf):
    return url_filter.verdicts(table(spark, sf, "pages"), URL_RULES)


@query("op10_toxicity")
def op10(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.is_held_out()))
    return toxicity.scored(docs, model).select("doc_id", toxicity.is_held_out().alias("held_out"), "score",
                                               (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op12_conversation_repair")
def op12(spark, sf):
    told = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_report(conversation_repair.damaged(told))


@query("op13_lm_scoring")
def op13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return lattice_lm.lm_scores(docs, ~lattice_lm.is_held_out(), tokenizer("piece_bpe_32k.model"))


@query("op11_hard_negatives", """
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op11(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepared(table(spark, sf, "embeddings"), label), F.col("id") % 100 == 0)
