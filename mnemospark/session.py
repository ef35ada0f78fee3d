"""Session helpers: building a local session, cutting lineage, sizing partitions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    That is enough where they see the same files. Elsewhere the package comes with the job (``--py-files``).
    """
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, here])
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return share_package(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mnemospark")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a temporary one only where the master is local and none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="mnemospark-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    Results that several later stages read are computed once, and a lost executor
    costs a re-read instead of the whole lineage.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(rows: int, rows_per_partition: int) -> int:
    """How many partitions hold ``rows`` at no more than ``rows_per_partition`` each."""
    return max(1, -(-int(rows) // rows_per_partition))
