"""Helpers shared by the training-data operators: document frames, Arrow maps and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The ASCII white space that ends a word in every contract; bytes.split() splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def doc_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with the text as UTF-8 bytes and null as empty.

    Only these two columns go on, so whatever else the table holds cannot clash with an operator's own names.
    """
    tune(docs.sparkSession)
    return docs.select(
        quoted(id_col).cast("long").alias("doc_id"),
        F.coalesce(quoted(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, in rows and in bytes: a batch of long documents must fit a Python worker.

    These two settings of the session stay, since plans read them when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def arrow_map(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """One task's rows through ``rows(batches) -> iterator of lists of tuples``, typed as ``schema``."""
    spark_schema = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = to_arrow_schema(spark_schema)
        for out in rows(batches):
            columns = list(zip(*out)) if out else [[] for _ in typed]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, typed)], schema=typed)

    return df.mapInArrow(run, spark_schema)


def per_row(df: DataFrame, fn: Callable[..., tuple | list[tuple]], schema: str, many: bool = False) -> DataFrame:
    """``fn(*row)`` gives one output row, or with ``many`` a list of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            if many:
                out: list[tuple] = []
                for row in zip(*columns):
                    out.extend(fn(*row))
                    if len(out) >= 50_000:
                        yield out
                        out = []
                if out:
                    yield out
            else:
                yield [fn(*row) for row in zip(*columns)]

    return arrow_map(df, rows, schema)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on ``names``: a row with a null key still meets its own decisions."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset and all runs in one process (tests)."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    if not getattr(spark.sparkContext, "_tessera_scratch", None):
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
        spark.sparkContext._tessera_scratch = path
    return spark.sparkContext._tessera_scratch


def splits(df: DataFrame) -> int:
    """In how many parts Spark reads ``df``: a measure of its size that costs no job."""
    return df.rdd.getNumPartitions()


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and lost executors cost no recomputation.

    The files go when the application ends; ``files`` is how many there are at most.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if files is not None:
        df = df.coalesce(files)
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more.

    Shuffles of the jobs that wrote and read them are garbage then too. Spark deletes their files when the driver's JVM
    collects its garbage, which a small heap may do too seldom for the executors' disks, so it is asked to.
    """
    spark = None
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if spark is not None:
        spark._jvm.System.gc()


#: UTF-8 continuation bytes: a text has as many code points as it has other bytes.
_CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUATION))
