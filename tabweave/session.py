"""Session helpers: local builder for tests/bench and the checkpoint folder.

On a cluster the session is built by the caller; the library only *reads*
`spark.checkpoint.dir`. A folder of our own is set only when the session has
none (local tests, the bench), never on a cluster that names one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.sql.shuffle.partitions": "8",
}


def local_session(cores: int | str = "*", app: str = "tabweave", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a private one only when unset.

    A folder already given to the SparkContext wins, then `spark.checkpoint.dir`
    (shared storage on a cluster). A fresh temp folder, removed when the process
    ends, is the fallback of a `local` master; any other master must name one,
    since its executors do not see the driver's disk.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder (master {sc.master})")
    local = tempfile.mkdtemp(prefix="tabweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return local
