"""Work folders, size-checked joins, prefix sums and connected components shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its counted rows stay below this; every broadcast row here is a few dozen bytes.
BROADCAST_ROWS = 200_000
#: A key too hot for one task is dealt over this many salted copies of the small side.
SALTS = 16


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared spark.checkpoint.dir. Where that is unset in local mode (tests), one is set; on a
    cluster a folder of one machine would lose rows, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sentrel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sentrel-{name}-{uuid.uuid4().hex[:12]}"


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Arrow batches of whole texts hold at most so many rows, unless the session asks for fewer: a task holds a batch
    twice, in the executor and in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder: a lost executor costs only its own tasks."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files behind a settled table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Joins a side keyed by group (sources, labels, ...): broadcast while its counted rows are few, else salted so
    that a key with a third of all rows is spread over SALTS tasks."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    row_salt = (F.monotonically_increasing_id() % SALTS).cast("int")
    return big.withColumn("__salt", row_salt).join(salted, [*on, "__salt"], how).drop("__salt")


def join_checked(big: DataFrame, other: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Joins a side that may grow with the data: broadcast only while its counted rows are few, else a shuffled join whose
    hot keys adaptive execution splits; the side is never copied."""
    return big.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other, on, how)


def exclusive_sums(df: DataFrame, order: str, value: str, out: str, tie: str | None = None, rows: int = 1 << 18) -> DataFrame:
    """Adds the sum of value over all rows before this one in ascending order (nulls first).

    Two levels: key ranges of about `rows` rows each, at most 4096, whose totals are one small window, then a window inside
    each range. A key with more rows than a range (nulls, one id that many rows share) has a range of its own, which is
    dealt by a hash of the column tie; rows of one key are in no order but that one."""
    from pyspark.sql import Window as W

    ranges = min(4096, max(16, -(-df.count() // rows)))
    found = df.select(order).na.drop().stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges) or []
    hot = {int(c) for c in found if found.count(c) > 1}
    cuts = sorted({int(c) for c in found} | {c + 1 for c in hot})
    slot = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(_range_of(F.col(order), cuts))
    dealt = F.col(order).isNull() | (F.col(order).isin(*hot) if hot else F.lit(False))
    part = F.when(dealt, F.pmod(F.xxhash64(tie), F.lit(ranges))).otherwise(F.lit(0)) if tie else F.lit(0).cast("long")
    ranged = df.withColumns({"__range": slot, "__part": part})
    keys = ["__range", "__part"]
    totals = ranged.groupBy(*keys).agg(F.sum(value).alias("__t"))
    before = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)  # at most a few ranges squared of sums
    totals = totals.select(*keys, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*keys).orderBy(F.col(order), F.col(value)).rowsBetween(W.unboundedPreceding, -1)
    return (
        join_checked(ranged, totals, keys, "inner")
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__range", "__part", "__base")
    )


def _range_of(column: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below the key, by a balanced tree of comparisons."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(int(cuts[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    edges has long columns u, v. Rounds of large-star and small-star, each written to the shared folder; the minimum
    per node is a map-side combined aggregate and the joins may be split by adaptive skew handling."""
    from functools import reduce

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = stamp(now)
    while mark[0]:
        both = reduce(DataFrame.unionByName, [now, now.select(F.col("v").alias("u"), F.col("u").alias("v"))])
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = settle(small, name)
        forget(now)
        now, was, mark = after, mark, stamp(after)
        if mark == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
