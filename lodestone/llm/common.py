"""What the corpus operators share: the shared folder, written intermediates, reading of texts."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine, driver or worker; a path stays."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (a local session) a temporary folder is made and kept in
    the session for later calls."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, found[len("file://") :], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor costs a reread, not a
    recomputation. ``drop`` removes one as soon as nothing reads it any more; what a returned
    DataFrame still reads stays, in one folder for each application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self.at: dict[int, str] = {}
        self.n = 0

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def write(self, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
        path = self.path(tag)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``write`` that no later job reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Number of partitions for an exchange that an operator deals out itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a record batch that goes to a worker: rows of long texts or large sets come in few.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in bounded memory: record batches hold about ``BATCH_BYTES`` and not ten
    thousand rows of any size (the session's setting is lowered to that, never raised), and
    workers, which Spark keeps for later tasks, give freed memory back at the end of each."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return df.mapInArrow(task, schema)


def text_bytes(df: DataFrame, text: str = "text"):
    """The text as UTF-8 bytes, null as none, for workers that read it as Arrow binary."""
    return F.coalesce(df[text], F.lit("")).cast("binary")
