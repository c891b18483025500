"""Session helpers: a local session with sound settings, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker; the usual limits let one of long texts be four times as large.
ARROW_BYTES = 4 << 20


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine for tests, the command line and benchmarks; keys of ``conf`` use ``__`` for dots."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tarn")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); on one machine, where none is set, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where if "://" in where or where.startswith("file:") else "file://" + where
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tarn-")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors once per application, so that Python workers can import it anywhere.

    Arrow batches of the session are kept to ARROW_BYTES, so that workers need as much memory for long texts as for short.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name).rstrip("b")
    if not usual.isdigit() or int(usual) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="tarn-", suffix=".zip")  # read by the driver alone, which serves it
        os.close(handle)
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, str(file.relative_to(root.parent)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
