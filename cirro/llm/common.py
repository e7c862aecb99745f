"""Helpers that the corpus operators share: shared storage, names, hashes and words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words: U+0020 and U+0009 to U+000D, as bytes.split() has it.
SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _LOCAL:
        _LOCAL["own"] = "file://" + tempfile.mkdtemp(prefix="cirro-shared-")
    return _LOCAL["own"]


_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    if not _WRITTEN:
        atexit.register(_remove)
    path = f"{shared_dir(spark).rstrip('/')}/cirro-{uuid.uuid4().hex}-{name}"
    _WRITTEN.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _WRITTEN:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Freed memory goes back to the system, so that a Python worker that waits for its next task doesn't hold what the last one had; without malloc_trim only Arrow's does."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(taken: Iterable[str], name: str) -> str:
    """name, or name with underscores, that no column in taken has (case aside)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learn_part(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 4; 2 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(int(doc_id)).encode()) % 4 == 2


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


_A_TO_Z = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(data: bytes) -> bytes:
    """A-Z lower-cased, every other byte as it is."""
    return data.translate(_A_TO_Z)
