"""Session helpers: code shipping, shared scratch tables, session defaults."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
RELEASE_SECONDS = 8.0
_released = 0.0
_shipped: set[str] = set()
_fallback: dict[str, str] = {}


def session(name: str = "tessera", cpus: str | int = "*") -> SparkSession:
    """A local session with the defaults that the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so Arrow functions can import it there.

    Also bounds Arrow batches by bytes: texts differ in length by orders of
    magnitude, and ten thousand of them in one batch would cost the JVM and
    every Python worker several times their size.
    """
    if spark.conf.get(_BATCH_SETTING, None) in (None, "67108864b", "67108864"):  # unless the user chose a size
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / f"tessera_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or our own where it is unset.

    Without the setting a local session uses a temporary folder; a cluster has
    to name one, as no folder is sure to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor share")
    if sc.applicationId not in _fallback:
        _fallback[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    return _fallback[sc.applicationId]


class Scratch:
    """Tables written once to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, then let Spark free the shuffles behind it, and read it back."""
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def write_dealt(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Write df as a table in so many buckets by a column: joins on it needn't shuffle this side."""
        table = f"tessera_{uuid.uuid4().hex}"
        df.write.mode("overwrite").option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(buckets, column).saveAsTable(table)
        self.tables.append(table)
        del df
        self.release()
        return self.spark.table(table)

    def release(self) -> None:
        """Shuffle files go when the driver collects the plans that own them; every RELEASE_SECONDS at most, as a collection takes time."""
        global _released
        if time.monotonic() - _released > RELEASE_SECONDS:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            _released = time.monotonic()

    def drop(self, *names: str) -> None:
        for n in names:
            self._delete(f"{self.root}/{n}")

    def clear(self) -> None:
        try:
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            self.tables.clear()
            self._delete(self.root)
        except Exception:  # the session may be gone at exit
            if self.root.startswith("file:"):
                import shutil

                shutil.rmtree(self.root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
