"""Session settings the library is tuned for, and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Let a join reuse an existing partitioning on a subset of its keys: the score
# join then rides on the shuffle already made for the identity windows.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app_name: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Zone-free input timestamps are read as UTC everywhere in the library."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Joins on more than what rows are dealt by ride on that deal, also in a session made elsewhere.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A private folder is made only on a local master, where there is no cluster
    to share it with; on a cluster without the setting this is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="riskloom-ckpt-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: like ``cut_lineage``, but by column and compressed, for many rows."""
    spark = df.sparkSession
    home = f"{checkpoint_dir(spark)}/riskloom-{spark.sparkContext.applicationId}"
    path = f"{home}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_as_dealt(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, and plans over the result know how its rows are dealt and sorted.

    Adaptive execution hides that, so it is off for this write: for plans that deal out no more than small tables.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def dealt(
    df: DataFrame, by: Sequence[str], order: Sequence[str], then: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Rows dealt out by ``by`` and sorted by that and ``order``, stored once.

    Windows, groupings and joins by ``by``, or by more, then move and sort no row again, however often the result
    is read. ``then`` is applied after the deal. All before the deal runs as ever, skewed joins split.
    """
    spark = df.sparkSession
    rows = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    rows = DataFrame(rows, spark).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    return cut_as_dealt((then(rows) if then else rows).sortWithinPartitions(*by, *order))
