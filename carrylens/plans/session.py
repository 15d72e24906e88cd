"""Session construction and the checkpoint-directory rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "carrylens") -> SparkSession:
    """A session configured for these jobs.

    AQE stays on (runtime coalescing, skew-join splitting, broadcast
    conversion behind Spark's own size check).  The UI is off.  Shuffle
    partitions default to 2x the local cores; on a cluster pass a number
    sized to ~128-256 MB per shuffle partition at the target scale.
    """
    master = master or os.environ.get("CARRYLENS_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    n = shuffle_partitions or int(os.environ.get("CARRYLENS_SHUFFLE_PARTITIONS", "16"))
    for k, v in {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("CARRYLENS_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.log.level": "WARN",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when that setting is absent *and* the master is local (tests,
    single-node runs) do we create our own scratch folder; on a cluster an
    unset directory is an error, because a machine-local folder would not
    survive the loss of the executor that wrote it.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="carrylens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Cut lineage where a result feeds several branches of one plan.

    Column pruning gives each branch a slightly different subtree, so Spark
    cannot reuse the exchange and would recompute the (expensive) input
    aggregation per branch.  A reliable ``checkpoint`` writes the result once
    to the shared checkpoint folder and every branch reads it back; a lost
    executor re-reads the files instead of recomputing the lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
