"""What the corpus operators share: tables, the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pandas._libs.hashing import hash_object_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z become a-z, every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z become a-z and every ASCII byte but 0-9 and letters becomes a blank.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(LOWER)


#: Long texts don't fill a worker: a batch ends at this size too.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Texts go to Python in batches of 2,000 rows or 4 MB, what comes first, unless the session sets its own sizes."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and the master is local (tests) a temporary folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and rereads it: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def blank_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() splits at just these six."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of 0-9, a-z and all non-ASCII characters as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


KEY = "waymark-16-bytes"


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit SipHash of each word."""
    held = np.empty(len(words), object)
    held[:] = words
    return hash_object_array(held, KEY, "utf-8")


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; the argument may be sorted in place."""
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def texts(batch) -> list[str | None]:
    """Values of a pandas text column, missing ones as None."""
    return [x if isinstance(x, str) else None for x in batch]


def narrow(values: np.ndarray) -> bytes:
    """Bytes of whole numbers in the narrowest of 16, 32 and 64 bits that holds them all."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype(next(t for t in ("<i2", "<i4", "<i8") if low >= np.iinfo(t).min and high <= np.iinfo(t).max)).tobytes()


def widened(raw: bytes, size: int) -> np.ndarray:
    """The `size` numbers that narrow() wrote."""
    return np.frombuffer(raw, f"<i{len(raw) // size}")


def vector_rows(counts: np.ndarray, segments: int, compressor) -> list[bytes]:
    """A vector of whole numbers cut into equal segments, each packed; empty segments give b''."""
    return [compressor.compress(narrow(part)) if part.any() else b"" for part in np.split(counts, segments)]


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on and share an executor's limit."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def summed_segments(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Sums packed segments (blobs of vector_rows) by keys, in 64 bits.

    The blobs of a key are reduced in two steps: salted first, so that no task gets a share that grows with all partitions.
    """
    import pandas as pd
    import zstandard

    schema = ", ".join(f"{k} int" for k in keys) + ", blob binary"

    def grouped(frame, by):
        def add(key, pdf):
            total, un = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
            for blob in pdf["blob"]:
                total += widened(un.decompress(blob), size)
            return pd.DataFrame({**{k: [int(v)] for k, v in zip(keys, key)}, "blob": [zstandard.ZstdCompressor(3).compress(narrow(total))]})

        return frame.groupBy(*by).applyInPandas(add, schema)

    salted = df.where(F.length("blob") > 0).select(*keys, "blob", F.pmod(F.spark_partition_id(), F.lit(16)).alias("salt"))
    return grouped(grouped(salted, [*keys, "salt"]), keys)


def segment_of(blob: bytes, size: int) -> np.ndarray:
    """The numbers of a blob that summed_segments gives."""
    import zstandard

    return widened(zstandard.ZstdDecompressor().decompress(blob), size)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread_join(rows: DataFrame, known: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """rows joined with known, which has one row for each key and, in column `count`, how many of the `total` rows have it.

    Keys with more than total / share rows, fewer than `share` of them, are broadcast, so that their rows stay where they are;
    the rest meets in an exchange in which no key has a larger part.
    """
    if total <= 5000:
        return rows.join(known.drop(count), key)
    limit = max(1000, total // share)
    heavy, light = known.where(F.col(count) > limit).drop(count), known.where(F.col(count) <= limit).drop(count)
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))
