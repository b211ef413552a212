"""Tables that several steps read, and places in an order: what a plan can't keep, the shared folder keeps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if the session is
    one process; on a cluster that is an error, as each executor would write to its own disk."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, so later steps neither repeat it nor need its executors."""
    at = f"{shared_dir(df.sparkSession)}/logloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._logloom_at = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    for df in tables:
        at = getattr(df, "_logloom_at", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def positioned(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with `name`, their place from 1 in the order of the columns, ties in any order but each place once.

    Rows are dealt by ranges of the order, sorted there and written; each range is counted, and the counts before a range,
    a row per range, are what its places begin after. No task holds more than a range. Rows of equal order columns are
    dealt apart by a number of their own, so no tie makes a range large.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_k{i}" for i in range(len(keys))]
    uid, part, at = "_uid", "_part", "_at"
    held = stored(rows.select("*", *[k.alias(n) for k, n in zip(keys, names)], F.monotonically_increasing_id().alias(uid)), "positioned-rows")
    dealt = held.repartitionByRange(*names, uid).sortWithinPartitions(*names, uid).drop(*names, uid)
    dealt = stored(dealt.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "positioned-ranges")
    dropped(held)
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_n"))  # a row per range: a table of the size of the cluster
    before = sizes.select(part, (F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    place = F.col(at) - F.shiftleft(F.col(part), 33) + F.col("_before") + 1
    return dealt.join(F.broadcast(before), part).withColumn(name, place).drop(part, at, "_before")
