"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: What separates words, as a Java or Python character class and as a pattern of words.
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
#: Where stored() put the frames that it returned.
_PLACES: dict[int, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder;
    executors on other machines could not see one, so there the setting must be given."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and a lost
    executor costs only the tasks that it had, not the steps before."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/folioscope/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    _PLACES[id(out)] = (weakref.ref(out), at)
    return out


def released(*frames: DataFrame) -> None:
    """Deletes the files of frames that stored() returned; for those that nothing reads any more."""
    for df in frames:
        ref, at = _PLACES.pop(id(df), (None, None))
        if ref and ref() is df:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df as a side that is broadcast if it has `rows` rows at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def as_text(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes together, one row at least."""
    size = batch.column(column).cast(pa.binary())
    ends, start, total = [len(x) if (x := v.as_buffer()) is not None else 0 for v in size], 0, 0
    for i, n in enumerate(ends):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(ends) > start:
        yield batch.slice(start)
