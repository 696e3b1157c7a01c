"""Writers for embeddings, pairs and results."""

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import width


def write_embeddings(emb: DataFrame, path: str, form: str = "text") -> None:
    """Text: every part file starts with `n dim`, then `id x1 ... xd`. Parquet keeps the table as it is."""
    if form == "parquet":
        emb.write.parquet(path)
        return
    header = f"{emb.count()} {width(emb, 'vector')}"
    numbers = F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")
    emb.select(F.concat_ws(" ", "id", numbers).alias(header)).write.csv(path, header=True, sep="\u0001", quote="\u0000")


def export_tsv(emb: DataFrame, labels: DataFrame, vectors_path: str, labels_path: str) -> None:
    """Vectors and labels in id order, one row each; an error unless both tables have the same ids."""
    both = emb.select("id", "vector").join(labels.select("id", "labels"), "id", "full")
    alone = both.filter(F.col("vector").isNull() | F.col("labels").isNull()).select("id")
    if (example := alone.first()) is not None:
        raise ValueError(f"ids of vectors and labels differ, for example {example.id}")
    ordered = both.orderBy(F.expr("try_cast(id AS bigint)"), "id")
    ordered.select(F.array_join(F.transform("vector", lambda x: x.cast("string")), "\t")).write.text(vectors_path)
    ordered.select(F.array_join("labels", " ")).write.text(labels_path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("src", "dst").write.csv(path, sep="\t")


def write_results(metrics: DataFrame, path: str) -> None:
    metrics.orderBy("dataset", "method").write.csv(path, header=True)
