"""Session settings, stored stages, and the place where a plan may be cut."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelwright", cpus: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.openCostInBytes", "524288")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, for executors that don't have it installed."""
    context = spark.sparkContext
    if any(name.endswith("/panelwright.zip") for name in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="panelwright-package-")) / "panelwright.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(target))


def tasks_for(spark: SparkSession) -> int:
    """Partitions for rows that are few but each much work; adaptive execution leaves a given number alone."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: month arithmetic must not depend on the machine."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a local one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if configured:
            spark.sparkContext.setCheckpointDir(configured)
        elif spark.sparkContext.master.startswith("local"):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelwright-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured or spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_path(spark: SparkSession, name: str) -> str:
    """The folder of a stored stage of this application."""
    return f"{shared_dir(spark)}/stages/{spark.sparkContext.applicationId}/{name}"


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of all files below ``path``."""
    target, files = _file_system(spark, path)
    entries, found = files.listFiles(target, True), []
    while entries.hasNext():
        entry = entries.next()
        found.append(f"{entry.getPath()} {entry.getLen()} {entry.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def stage_table(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table between two stages: written once per application, then scanned.

    Later stages get column pruning, pushed filters and file statistics, and a
    lost executor only costs a re-read. A write that died leaves no success
    marker, so it is written again.
    """
    path = stage_path(spark, name)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    target, files = _file_system(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(target)] if files.exists(target) else []


def committed_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` whose write has been committed."""
    return [name for name in folder_names(spark, path) if path_exists(spark, f"{path}/{name}/_SUCCESS")]


def delete_path(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file at once and whole, only if there is none of its name; False if there is.

    It is written under another name and then renamed, which no store lets two writers do to one name.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, files = _file_system(spark, path)
    if files.exists(target):
        return False
    files.mkdirs(target.getParent())
    draft = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        context = hadoop.FileContext.getFileContext(target.getParent().toUri(), spark._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(files.makeQualified(draft), files.makeQualified(target), none)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    finally:
        files.delete(draft, False)
