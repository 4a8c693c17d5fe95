"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    # local-cluster masters have executors with folders of their own.
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def durable(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and read them back.

    A Parquet table is computed once, unlike a checkpoint, and is read with
    column pruning and known sizes. Zstandard writes less than the default. The
    caller owns the folder and empties it between jobs.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/terrace/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_COMPILING: dict[str, str | int] = {"jobs": 0}
_COMPILING_LOCK = Lock()


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Generated code stays within what HotSpot compiles (8,000 bytes a method); a wider fused stage would be interpreted row by row.

    Of jobs side by side the first sets the limit and the last takes it back.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    with _COMPILING_LOCK:
        if not _COMPILING["jobs"]:
            _COMPILING["before"] = spark.conf.get(key)
            spark.conf.set(key, "8000")
        _COMPILING["jobs"] += 1
    try:
        yield
    finally:
        with _COMPILING_LOCK:
            _COMPILING["jobs"] -= 1
            if not _COMPILING["jobs"]:
                spark.conf.set(key, _COMPILING["before"])


def shuffle_width(spark: SparkSession) -> int:
    """Shuffle partition count of the session; sizes value buckets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def storage_bytes(spark: SparkSession) -> int:
    """Memory that all executors have for kept rows; of several block managers the least is taken for the driver's and left out."""
    entries = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().toList()
    sizes = sorted(int(entries.apply(i)._2()._1()) for i in range(entries.size()))
    return sum(sizes[1:] or sizes)
