"""Session settings, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "fixgrain", **conf: str) -> SparkSession:
    """A session for tests and for the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fixgrain-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"{package.name}/{file.relative_to(package)}")
    context.addPyFile(str(archive))
    atexit.register(_remove_local, str(archive.parent))


#: Bytes of files a core, below which a table is spread over all cores after it is read.
SMALL_SHARE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores if their files are too small to give each core a part of its own.

    For work that is done row by row and costs far more than reading: a file of one row group is
    read by one task, however much work its rows are. Larger tables are left as they are read, so
    nothing is shuffled for this where it would cost anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 256 << 10 < size < cores * SMALL_SHARE else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the setting is absent a temporary folder is used, but only with a local master: on a
    cluster a folder of one machine would lose the tables with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = _OWN.get("root")
    if root is None:
        root = _OWN["root"] = "file://" + tempfile.mkdtemp(prefix="fixgrain-")
        atexit.register(_remove_local, root)
    return root


_OWN: dict[str, str] = {}


def _remove_local(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Tables written to the shared folder to cut lineage; any executor can read them again."""

    def __init__(self, spark: SparkSession, tag: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> str:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return path

    def read(self, path: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(path)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return self.read(self.write(df, name), df)

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
