"""Written tables and files in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "4m"
_own: list[str] = []
_sent: set[str] = set()


def shared(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, as in tests on one machine, a folder that goes at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="meridia-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    if "://" not in root and not root.startswith("file:"):
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)).toString()
    return f"{root.rstrip('/')}/meridia-{uuid.uuid4().hex}"


def written(df: DataFrame, free: bool = True) -> DataFrame:
    """The table, written as Parquet in the shared folder and read again, which cuts its lineage.

    free: ask the driver to drop shuffle files that no live DataFrame needs any more.
    """
    path = shared(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if free:
        release(df.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release(spark: SparkSession) -> None:
    gc.collect()
    with contextlib.suppress(AttributeError):  # a remote session has no JVM of its own
        spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, unless PYTHONPATH or the working folder has it for them."""
    package = Path(__file__).resolve().parents[1]
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _sent or any(x and Path(x).resolve() == package.parent for x in places):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="meridia-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at so many bytes too, so that long texts don't gather in one; workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(uri: str) -> tuple[FileSystem, str]:
    """The file system of a URI and the path in it; for executors, which have no JVM gateway."""
    return FileSystem.from_uri(uri)


def put(uri: str, content: list[bytes]) -> int:
    """Writes a file of these parts and returns its length. A name is written once: callers make it unique to the attempt."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:  # else a name that ends in .zst is packed again
        for part in content:
            out.write(part)
    return sum(map(len, content))
