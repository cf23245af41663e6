"""Session defaults, table access and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillframe", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings every test and bench run uses; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILLFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python workers find it on any host."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="quillframe-", suffix=".zip", delete=False) as file:
        with zipfile.ZipFile(file, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
    context.addPyFile(file.name)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory, as stored."""
    ship(spark)
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's setting, or a temporary one where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillframe-checkpoint-"))
    elif folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives the loss of any executor."""
    ship(df.sparkSession)
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
