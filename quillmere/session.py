"""Session helpers: a tuned local session, table loading and lineage cuts on shared storage."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quillmere", cpus: int | str = "*", **conf: object) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it as the driver does, by the working folder or PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = {os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if root in known or app in _shipped:
        return
    import shutil
    import tempfile

    _shipped.add(app)
    folder = tempfile.mkdtemp()  # of the driver, who serves the file while the session lives
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "quillmere"), "zip", root, "quillmere"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    path = os.path.join(tempfile.gettempdir(), f"quillmere-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage before the files, so a lost executor costs only the reading tasks.
    The files are removed by ``unstage``, or when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmere-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._quillmere_path = path
    return staged


def unstage(staged: DataFrame) -> None:
    """Remove the files of a staged table from which nothing will be read any more."""
    path = getattr(staged, "_quillmere_path", None)
    if path:
        remove(staged.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete files of a shared folder."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a shared folder; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
