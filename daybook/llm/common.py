"""What the operators share: table access, ids and shared folders."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that go to a Python worker at once: a batch and what is made of it stay small beside an executor's memory.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in this session; texts make the usual 10,000 rows far too large. Spark reads the bounds when a
    plan runs, which is after an operator returns it, so they stay; they change no result, and tighter ones are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names: extra columns can't clash with what it adds."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Without a name there is one only where there is
    but one machine, in local mode; elsewhere this raises, as executors would write where others can't read."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or f"file://{tempfile.gettempdir()}/daybook-shared").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here and outlives lost executors. Shuffle files of
    the job go as soon as the table is there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read again."""
    for table_ in tables:
        jvm = table_.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table_.stored_at)
        path.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def summed(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, parts: int = 16, kind: str = "<i8", add=np.add) -> np.ndarray:
    """The sum over all partitions of what `count` makes of each: `size` whole numbers, whatever the size of the input.
    kind and add: another type of numbers, and another way to add them.

    Each partition sends its counts compressed; they are added part by part on the executors, and only sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [zlib.compress(x.astype(kind).tobytes(), 1) for x in np.array_split(count(batches), parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(counts, pa.binary())], ["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(x), kind)
                sums[part] = add(sums[part], own) if part in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    added = rows.mapInArrow(run, "part int, counts binary").repartition(parts, "part").mapInArrow(total, "part int, counts binary")
    out = [np.zeros(len(x), kind) for x in np.array_split(np.zeros(size, np.int8), parts)]
    for r in added.collect():
        out[r.part] = add(out[r.part], np.frombuffer(r.counts, kind))
    return np.concatenate(out)
