"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that matter for results (UTC) and for plans at scale (AQE, skew join).

    Cluster sizing (executors, memory, shuffle partitions) is left to the caller.
    """
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Executors have no copy of it, and even local workers only find it from the right folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="dyadflow-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def local_session(cores: int | str = "*", app: str = "dyadflow", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    partitions = str(cores) if str(cores).isdigit() else "8"
    builder = configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", conf.pop("spark__checkpoint__dir", None) or tempfile.mkdtemp(prefix=f"{app}-"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
