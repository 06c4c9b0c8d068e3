"""Session helpers: a local session for tests/bench, and the shared
checkpoint folder every lineage cut or state store must live in."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "quire", event_log_dir: str | None = None) -> SparkSession:
    """A local[N] session tuned like a small cluster: AQE on, UI off, Arrow on."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else os.cpu_count() or 8)
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to shared storage. Only a local
    session (tests, bench) gets a private temporary folder when it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written meanwhile go as soon as it is written. Otherwise they
    stay until the driver happens to collect its garbage, which a query of many steps may not live to see."""
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)


def materialize(df, label: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: later stages reuse it instead of recomputing its lineage,
    and a lost executor only loses work done after this point."""
    return _write(df.write, df.sparkSession, label)


def store(df, label: str):
    """:func:`materialize` for tables that grow with the corpus: smaller on disk, and the
    shuffle files of their making go at once."""
    with shuffles_dropped(df.sparkSession):
        return _write(df.write.option("compression", "zstd"), df.sparkSession, label)


def _write(writer, spark: SparkSession, label: str):
    import uuid

    path = f"{checkpoint_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    writer.mode("overwrite").parquet(path)
    _written.append(path)
    return spark.read.parquet(path)


def forget(*frames) -> None:
    """Remove tables of :func:`store` or :func:`materialize` that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            kept = [p for p in _written if path == p or path.endswith(f"/tables/{p.rsplit('/', 1)[1]}")]
            for p in kept:
                _written.remove(p)
                _delete(df.sparkSession, p)


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_written: list[str] = []
_named: list[str] = []


def keep_table(name: str, path: str) -> None:
    """Leave a catalog table and its folder to :func:`drop_tables`."""
    _named.append(name)
    _written.append(path)


def drop_tables(spark) -> int:
    """Remove the tables that :func:`materialize` and :func:`keep_table` left since the last call. Frames that
    read them can't be used any more, so call it when a query's result is stored."""
    n = 0
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    while _written:
        n += _delete(spark, _written.pop())
    return n


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable in every Python worker (the ``--py-files``
    step): zip the package once per SparkContext and ``addPyFile`` it."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="quire-pkg-")
    archive = shutil.make_archive(os.path.join(out, "quire"), "zip", root_dir=os.path.dirname(pkg),
                                  base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    sc._quire_shipped = True
