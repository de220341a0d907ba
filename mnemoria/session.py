"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that a local session gets; on a cluster the submitter's settings hold.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "mnemoria", cpus: int = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for name, value in LOCAL_CONF.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str) -> bool:
    """Whether a master runs everything in one JVM; ``local-cluster`` doesn't."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests on one machine) gets a
    temporary folder, which is removed again when the process ends. On a cluster no
    folder of one machine would do, so the session is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="mnemoria-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    atexit.register(lambda: __import__("shutil").rmtree(made, ignore_errors=True))
    return f"file://{made}"


_cleaned: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def work_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/mnemoria/{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)

        def clean() -> None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001 - the session may be gone already
                pass

        atexit.register(clean)
    return path


def materialize(df: DataFrame, label: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage like a checkpoint does, survives the loss of any
    executor, and stays columnar, so that later steps read only the columns they
    need. Several passes over one result use this and never compute it twice.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _plain_path(path: str) -> str:
    """``file:/x`` and ``file:///x`` are the same."""
    scheme, _, rest = path.rpartition(":/") if path.count("://") == 0 else path.partition("://")
    return f"{scheme}:{rest.lstrip('/')}"


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized result that nothing reads any more."""
    spark = df.sparkSession
    own = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    prefix = _plain_path(own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()) + "/"
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if _plain_path(path).startswith(prefix):
            _delete(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each application."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_mnemoria_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="mnemoria-code-")) / "mnemoria.zip"
    atexit.register(lambda: __import__("shutil").rmtree(target.parent, ignore_errors=True))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*")):
            if path.is_file() and path.suffix not in (".pyc",):
                archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._mnemoria_shipped = True
