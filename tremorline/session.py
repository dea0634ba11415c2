"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

# Runtime settings every operator relies on. Static cluster sizing (executors, memory) stays with spark-submit.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a Python worker holds a few arrays of the size of a batch
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    # keyed streams hold maps and timers, which only this state store offers
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created, and send it this package."""
    _ship(spark.sparkContext)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _ship(context: SparkContext) -> None:
    """Make the package importable in the Python workers, wherever they run."""
    if getattr(context, "_tremorline_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tremorline-"), "tremorline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    # workers that a stream starts on the driver get no files, only the environment
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = os.pathsep.join([archive, known] if known else [archive])
    context._tremorline_shipped = True


def local_session(app: str = "tremorline", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        # recording the call site of every column expression doubles the time to build long plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing setting is an error,
    because a machine-local folder would be lost with its machine.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="tremorline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df, name: str):
    """Cut the lineage by writing a table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
