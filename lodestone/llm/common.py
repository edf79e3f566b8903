"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = r"[ \t\n\x0B\f\r]+"

_OWN: dict[str, str] = {}
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set a session in one process gets a fresh one, any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-lodestone-')}"
        found = _OWN[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


#: Rows of whole texts that go to Python at once; the ten thousand that Spark sends suit numbers.
TEXTS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, label: str, batch: int | None = None, release: bool = False) -> DataFrame:
    """df, written to the shared folder and read back: later plans start from the files, also after a lost executor.

    While it is written, batch rows go to Python at once; the session's setting is put back. With release, what the plan has shuffled is freed now: Spark
    deletes it when the driver collects its garbage, which a driver with little to do puts off.
    """
    path, conf = fresh_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(_BATCH)
    if batch:
        conf.set(_BATCH, str(batch))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch:
            conf.set(_BATCH, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    if release:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these; no plan that is still to run may read them."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: Column) -> Column:
    """128 bits of a text's SHA-256: what stands for a text wherever it is only told from others. A null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def word_array(text: Column) -> Column:
    """The words of a text, as an array; none for a null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

