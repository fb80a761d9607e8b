"""Cutting lineage so that a lost executor costs a stage, not the whole job.

Checkpoints and intermediate tables go to the shared folder the cluster names in
``spark.checkpoint.dir``.  Where that is unset a folder of our own is made, but only if driver and
executors are one process (tests, notebooks); on a cluster it is an error.  Intermediate tables are
deleted when the process ends, or by ``forget``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process: (session, path).
_WRITTEN: list[tuple[SparkSession, str]] = []


def _own_dir() -> str:
    """A folder for tests and notebooks, gone with the process; clusters name theirs."""
    own = tempfile.mkdtemp(prefix="plinth-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + own


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach; the context's checkpoint directory is set to it once."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _own_dir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage replaced by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    Unlike ``cut`` it keeps column pruning for every later reader.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"plinth-{label}-{uuid.uuid4().hex}")
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def forget() -> None:
    """Deletes the tables written so far; results that still read them must have been taken."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing but a local folder can still be reached
            if "://" not in path or path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
