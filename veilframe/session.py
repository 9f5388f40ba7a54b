"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", partitions: int = 8, app: str = "veilframe") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder of the session and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
    neither that setting nor a checkpoint folder exists and everything runs on one machine
    (tests) a folder of our own is made. On a cluster without such a folder this raises.
    """
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, read back: for loops, in which a checkpoint would carry on the
    planner's size estimates, squared with every join."""
    path = f"{ensure_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if it isn't yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None), sc.master))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint_folder(named: str | None, master: str) -> str:
    """The named folder; where none is named, a folder of this machine, which only a local master can use."""
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="veilframe-checkpoint-")


def with_parts(df: DataFrame, keys: list[str], most: int, spread_by: list[str], name: str = "parts", few: int = 200_000) -> DataFrame:
    """``df`` with a column ``name``: into how many parts the rows of its key are to be cut, so that a part holds about ``most`` rows.

    Only hot keys are looked up. They are broadcast while there are at most ``few`` of them (counted);
    beyond that they are joined by shuffle, the rows of a key spread over 64 places. Null keys have one part.
    """
    hot = cut(df.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias(name)))
    if hot.count() <= few:
        joined = df.join(F.broadcast(hot), keys, "left")
    else:
        salted = df.withColumn("_place", F.pmod(F.xxhash64(*spread_by), F.lit(64)).cast("int"))
        everywhere = hot.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = salted.join(everywhere, [*keys, "_place"], "left").drop("_place")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(1)))


def in_parts(df: DataFrame, parts: str = "parts", place: str = "part") -> DataFrame:
    """Every row once for each part of its key: the other side of a join with rows that are spread over the parts."""
    return df.withColumn(place, F.explode(F.when(F.col(parts) > 1, F.sequence(F.lit(0), F.col(parts) - 1)).otherwise(F.array(F.lit(0)))))


def spread_over(df: DataFrame, spread_by: list[str], parts: str = "parts", place: str = "part") -> DataFrame:
    """Every row in one of the parts of its key, chosen by hash."""
    return df.withColumn(place, F.pmod(F.xxhash64(*spread_by), F.col(parts)).cast("int"))


def spread(df: DataFrame, per_core: int = 8 << 20) -> DataFrame:
    """Small inputs over all cores, for stages where the work is in Python; larger ones as they are.

    A table of a few megabytes is one split; it is moved once, at most ``per_core`` bytes a core. Larger tables
    have enough splits and aren't shuffled, so small runs have one exchange more than large ones and the same rows.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < per_core * cores else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by the keys into the session's number of shuffle partitions, which AQE then leaves alone;
    a distinct or group on these keys needs no further shuffle, and Python stages behind it keep their width."""
    return df.repartition(shuffle_width(df), *keys)


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def sample_of(texts: DataFrame, rows: int) -> list[str]:
    """At most so many distinct values of ``text``, least hashes first; copies count once, and only hashes are shuffled to choose."""
    hashed = texts.select("text", F.xxhash64("text").alias("hash"))
    chosen = hashed.select("hash").distinct().orderBy("hash").limit(rows)
    return hashed.join(F.broadcast(chosen), "hash", "left_semi").distinct().orderBy("hash", "text").toPandas()["text"].tolist()
