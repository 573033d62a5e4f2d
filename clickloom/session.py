"""Session settings and the shared folders that jobs write to."""

from __future__ import annotations

import hashlib
import pathlib
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the next aggregate then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a query shuffled goes when it is over, not when the driver next collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Keyed stream state lives on disk, not in the executors' heaps.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings every operator relies on to a running session."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Functions of this package travel to the executors by value, so they need no installation there.
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    return spark


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clickloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder of the machine.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="clickloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a single file, or a table whose write was committed (it has the success marker)."""
    place, fs = _file_system(spark, path)
    if not fs.exists(place):
        return False
    return fs.getFileStatus(place).isFile() or fs.exists(_file_system(spark, f"{path.rstrip('/')}/_SUCCESS")[0])


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names directly below a folder; none if it is not there."""
    place, fs = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def tables_print(spark: SparkSession, folder: str) -> str:
    """A fingerprint of a folder of tables: name, length and time of each file, one level down."""
    place, fs = _file_system(spark, folder)
    seen = []
    for top in fs.listStatus(place):
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def code_print() -> str:
    """A fingerprint of this package's source, so that stored stages of other versions are not taken for its own."""
    top, seen = pathlib.Path(__file__).parent, hashlib.md5()
    for f in sorted(p for d in ("", "catalog", "functions", "operators", "plans", "sources") for p in (top / d).glob("*.py")):
        seen.update(f.read_bytes())
    return seen.hexdigest()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nobody has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``fresh_dir`` named."""
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a Parquet table under the shared folder and read it back.

    Survives the loss of executors, keeps column pruning, and later plans know the table's size.
    """
    path = fresh_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
