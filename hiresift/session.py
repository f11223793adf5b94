"""Session defaults. Nothing here overrides what a cluster has already set."""
from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int = 8, app: str = "hiresift", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass the session you were given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a scratch folder only where none is set."""
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    scratch = tempfile.mkdtemp(prefix="hiresift-ckpt-")
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result several consumers share and read it back.

    A written table cuts lineage, outlives lost executors, and gives the optimizer real sizes: small tables
    are then broadcast because they are known to be small, large ones are not.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffled(df: DataFrame) -> DataFrame:
    """The rows as a side of a join that is shuffled.

    Texts composed in a projection are far larger than the optimizer's estimate, which starts from the files of the
    table they are composed from: by that estimate whole texts would be collected in the driver for a broadcast.
    """
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context: tasks import it by name there."""
    context = spark.sparkContext
    if getattr(context, "_hiresift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name))
    context._hiresift_shipped = True
