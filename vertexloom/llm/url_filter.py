"""URL filter: rules by host and path, and for the rest two character language models, in DataFrame operations only.

Rules (host, path, allow or block): a rule fits its host and all hosts below it, if the path starts with the rule's;
the longest wins. Rows whose URL a rule decides are the examples: one variable-order Markov model of the characters of
the accepted ones, one of the rejected ones. The probability of a character after a context of up to ORDER characters
is smoothed by Witten and Bell's rule down to shorter contexts: (count + kinds * p of the shorter context) /
(total + kinds), so a context that the model hasn't seen leaves all to the shorter one. A URL's score is the difference
of the two log-likelihoods for each character. The threshold is calibrated on the examples: the point between the
classes' mean scores at which both are as many standard deviations away. Scores at or over it are accepted.

Every model is a table of distinct character runs, so what is joined grows with their number; an URL's own runs are counted
within the URL before they meet the models, and equal URLs are scored once; in the models and in the calibration an URL counts as often as it has rows. A run that nearly all URLs share is hot in
that join only, a plain equi-join which adaptive execution splits. Log probabilities are rounded to 1e-9 and summed as
whole numbers, so that results don't depend on the order of the rows.

Null URLs and those without '://' have an empty host and path and no rule; the method sees them as they are (null:
empty). Without examples of both kinds, all URLs that no rule decides are accepted when there are accepted examples or none,
and blocked otherwise. Each row of the input gives one row, a table without rows none; columns but the id and the URL aren't read, whatever their names.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut

ORDER = 4
ALPHABET = 256.0  # the shortest context spreads evenly over so many characters
SCALE = 10**9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def decided(urls: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """Adds host, path, rule (host and path of the longest rule that fits) and ruled (allow or block)."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return urls.withColumns({"host": host(url_col), "path": path(url_col)}).withColumns({"rule": rule, "ruled": verdict})


def _runs(texts: DataFrame, order: int) -> DataFrame:
    """(text's columns, run, times): the character runs of order + 1 of each text, which begins with order blanks, counted in the text."""
    padded = F.concat(F.lit(" " * order), F.col("text"))
    runs = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(padded, i, F.lit(order + 1)))
    # the table of URLs is small and its runs are many: spread it before
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = texts.filter("length(text) > 0").repartition(parts, "text").select("*", F.explode(runs).alias("run"))
    return exploded.groupBy(*texts.columns, "run").agg(F.count(F.lit(1)).alias("times"))


def _log_probabilities(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(run, accepted, rejected): whole log probabilities, times SCALE, of the last character of each run after the others.

    `counts` has (run, accepted, rejected): how often the examples of each kind have the run.
    """
    result = wanted.select("run").distinct().withColumns({"accepted": F.lit(1 / ALPHABET), "rejected": F.lit(1 / ALPHABET)})
    for k in range(order + 1):  # contexts of k characters
        tail = F.substring("run", order + 1 - k, k + 1)
        seen = counts.groupBy(tail.alias("tail")).agg(*(F.sum(c).alias(f"{c}_n") for c in ("accepted", "rejected")))
        context = F.substring("tail", 1, k)
        totals = seen.groupBy(context.alias("context")).agg(*(x for c in ("accepted", "rejected") for x in (
            F.sum(f"{c}_n").alias(f"{c}_total"), F.sum((F.col(f"{c}_n") > 0).cast("bigint")).alias(f"{c}_kinds"))))
        result = result.withColumns({"tail": tail, "context": F.substring("run", order + 1 - k, k)}).join(seen, "tail", "left").join(totals, "context", "left")
        result = result.select("run", *(
            F.when(F.coalesce(f"{c}_total", F.lit(0)) == 0, F.col(c)).otherwise(
                (F.coalesce(f"{c}_n", F.lit(0)) + F.col(f"{c}_kinds") * F.col(c)) / (F.col(f"{c}_total") + F.col(f"{c}_kinds"))).alias(c)
            for c in ("accepted", "rejected")))
    return result.select("run", *(F.round(F.log(c) * SCALE).cast("bigint").alias(c) for c in ("accepted", "rejected")))


def verdicts(urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """One row for each row of urls: id_col, host, path, rule, verdict, score (null where a rule decides)."""
    known = decided(urls.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("text")), rules, "text")
    texts = cut(known.groupBy("text", "ruled").agg(F.count(F.lit(1)).alias("rows")), "urls")
    pieces = cut(_runs(texts, order), "runs")
    uses = F.col("times") * F.col("rows")
    counts = cut(pieces.filter("ruled is not null").groupBy("run").agg(
        F.sum(F.when(F.col("ruled") == "allow", uses).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("ruled") == "block", uses).otherwise(0)).alias("rejected")), "counts")
    logs = cut(_log_probabilities(pieces, counts, order), "logs")
    scored = cut(pieces.join(logs, "run").groupBy("text", "ruled", "rows").agg(
        F.sum(F.col("times") * (F.col("accepted") - F.col("rejected"))).alias("log_ratio"))
        .withColumn("score", F.col("log_ratio") / F.length("text") / SCALE), "scores")

    kinds = {r["ruled"]: r for r in scored.filter("ruled is not null").groupBy("ruled").agg(
        F.sum("rows").alias("n"), F.sum(F.round(F.col("score") * SCALE).cast("decimal(20,0)") * F.col("rows")).alias("s"),
        F.sum(F.round(F.col("score") * 10**6).cast("decimal(10,0)") * F.round(F.col("score") * 10**6).cast("decimal(10,0)") * F.col("rows")).alias("q")).collect()}
    if len(kinds) == 2:
        accept = F.coalesce("score", F.lit(0.0)) >= _threshold(kinds["allow"], kinds["block"])
    else:
        accept = F.lit("block" not in kinds)
    marked = known.join(scored.filter("ruled is null").select("text", "score"), "text", "left")
    return marked.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(accept, "allow").otherwise("block")).alias("verdict"),
                         F.when(F.col("rule").isNull(), F.col("score")).alias("score"))


def _threshold(allow, block) -> float:
    mean, spread = {}, {}
    for name, r in (("allow", allow), ("block", block)):
        mean[name] = float(r["s"]) / SCALE / r["n"]
        spread[name] = max(float(r["q"]) / 10**12 / r["n"] - mean[name] ** 2, 1e-12) ** 0.5
    return (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])
