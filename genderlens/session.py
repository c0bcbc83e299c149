"""Session helpers: a tuned local session for tests/bench, the shared
checkpoint folder, tables of known size and the spread of under-split scans."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a table with a static bound (a bucket count, a fixed lexicon) up to
# which it is broadcast outright: about 10 MB of narrow rows.
BROADCAST_KNOWN_ROWS = 100_000

# Bytes of words that a file's dictionary may hold, so that texts cut into words
# are written as numbers (1 MB, the default, is full before a file's words are).
DICTIONARY = 16 << 20

# Applications whose workers have been sent the package.
_SHIPPED: set[str] = set()

# Scratch folders of local sessions without the setting, by application.
_SCRATCH: dict[str, str] = {}


def get_spark(master: str | None = None, app: str = "genderlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GENDERLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: functions that run in tasks
    refer to it by name. Spark sends it to the executors as a zip (once per
    application) unless ``PYTHONPATH`` already names its folder."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="genderlens-zip-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared filesystem).
    Only a local-mode session without the setting (tests) gets a fresh
    scratch folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        if app not in _SCRATCH:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            _SCRATCH[app] = tempfile.mkdtemp(prefix="genderlens-ckpt-", dir="/tmp")
        path = _SCRATCH[app]
    return path


def sized(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back (runs a
    job). The files give the planner the true size in bytes, so a join
    broadcasts the table exactly if it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise;
    nothing is computed twice, nothing stays cached on executors, and a lost
    executor loses nothing. With ``by``, a column of few values, a filter on it
    reads only the files of its value."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/sized-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, then=lambda df: df) -> DataFrame:
    """``df`` written to the shared checkpoint folder in buckets of ``column``
    and read back (runs a job), row-wise changed by ``then`` on the way: its rows are dealt by ``column`` from then on, so
    grouping by it, or joining it with other tables, does not move them again.
    Spark reads buckets through its catalog only; the entry is dropped at once,
    the files stay."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    then(df.repartition(n, column)).write.format("parquet").option("path", path).option("compression", "zstd").option("parquet.dictionary.page.size", DICTIONARY).bucketBy(n, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def broadcast_known(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count has the static bound ``rows``;
    above ``BROADCAST_KNOWN_ROWS`` the planner decides."""
    return F.broadcast(df) if rows <= BROADCAST_KNOWN_ROWS else df


def spread(df: DataFrame, factor: int = 2, pieces: int = 8) -> DataFrame:
    """Give CPU-heavy per-row work enough tasks.

    A scan with fewer partitions than ``factor`` x the cores (a small table,
    or one big row group) is redistributed round-robin, into at most
    ``pieces`` tasks per scan partition. At scale the input splits far
    outnumber the cores and this is a no-op (no shuffle), whatever the
    storage."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD access (e.g. a remote session): keep the scan as is
        return df
    target = min(par * factor, max(1, parts) * pieces)
    return df.repartition(target) if parts < target else df


def small_batches(batches, column: int, limit: int = 1 << 20):
    """Cut Arrow record batches so that a text column holds about ``limit``
    bytes each (one row at least): a batch has a bound on its rows only, and as
    Python objects long texts would take a worker's memory."""
    for b in batches:
        step = max(1, b.num_rows * limit // max(b.column(column).nbytes, 1))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
