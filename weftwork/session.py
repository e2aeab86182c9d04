"""Session helpers: cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the one the cluster names, else (local mode only) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftwork-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there: survives lost executors, is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def release(spark: SparkSession) -> None:
    """Removes shuffle files and checkpoints of what is no longer used, as the driver does when it collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ready(spark: SparkSession, root: str) -> SparkSession:
    """The session with a checkpoint folder, and workers that find the package at ``root``."""
    ensure_checkpoint_dir(spark)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return spark


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key: a key that holds a great share of ``many`` is spread.

    ``by``: columns of ``many`` that tell a key's rows apart. ``one`` is repeated ``salts`` times, so it should be the small side.
    """
    spread = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    repeated = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
