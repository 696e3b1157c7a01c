"""Shared scratch folder and lineage cuts."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Folder from spark.checkpoint.dir; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="vertexloom-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/vertexloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    The rows are computed once, survive the loss of any executor, and the planner sees their real
    size, so its broadcast threshold works on facts.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, keys: list[str], name: str = "buckets", parts: int | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder that is dealt and sorted by `keys` into `parts` buckets, else as many as a shuffle has partitions.

    A join on these keys shuffles its other side only, however often it is made.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = f"vertexloom_{uuid.uuid4().hex}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).sortBy(*keys).option("path", path).saveAsTable(known, format="parquet")
    out = spark.table(known)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of cut() that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_scratch", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
