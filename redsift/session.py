"""Session helpers: the shared folder that every executor can reach, and tables written into it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "redsift") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, one of our own on a local master (tests); on a
    cluster a folder of one machine would not do, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="redsift-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; deleted when the driver's Python ends, if Spark still
    runs then or the folder is mounted."""
    path = f"{shared_dir(spark)}/redsift/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(cleaned, spark, path)
    return path


_OWN: set[str] = set()


def cleaned(spark: SparkSession, path: str | None = None) -> None:
    """Delete all tables of this application in the shared folder, once no result that reads them is needed."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        deleted(spark, path or own_dir(spark))
    elif path and path.startswith("file:"):  # Spark has stopped, but the folder is mounted here
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as a table and read it back.

    The table outlives the executor that wrote it, so a lost executor costs its running tasks only. Operators delete
    with :func:`dropped` what nothing reads any more; what a returned plan still reads goes with the application.
    """
    path = shared_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that no later plan reads."""
    for df in tables:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles() if "/redsift/" in p}:
            deleted(spark, f)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how wide a stage of Python tasks is made."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
