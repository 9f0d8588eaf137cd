"""Session settings and table access shared by every query."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for clusters; a session that sets them already keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "paperloom", **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` wins over them."""
    b = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once in a session, wherever they run and whatever their path."""
    sc = spark.sparkContext
    if getattr(sc, "_paperloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="paperloom-")
    path = os.path.join(folder, "paperloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._paperloom_shipped = True
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (file or folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local default only on a local master, on a cluster without one an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(own)
        return own
    if not (own := spark.sparkContext.getCheckpointDir()):
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables can't lie on one machine's disk")
        own = f"file:///tmp/paperloom-checkpoints-{os.getpid()}"
        spark.sparkContext.setCheckpointDir(own)
    return own


def bounded_sample(df: DataFrame, key: str, n: int, of: int | None = None, spare: int = 8) -> DataFrame:
    """At most n rows in the order of a hash of `key`, the same at each run; of: the rows that df is chosen from.

    A threshold on the hash first leaves about `spare` times n rows whatever the table's size, so neither a task nor the
    driver meets more. A df of less than 1/spare of the table may give fewer than n.
    """
    total = df.count() if of is None else of
    slots = 1 << 30
    most = min(slots, spare * n * slots // max(1, total) + 1)
    return df.where(F.pmod(F.xxhash64(key), F.lit(slots)) < most).orderBy(F.pmod(F.xxhash64(key), F.lit(slots)), key).limit(n)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage at files that every executor can read: a table written to the shared folder and read back. Deleted when Python ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/paperloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: The same, where it serves to compute something once for several readers.
keep = cut


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
