"""What several operators of this subpackage share: cutting lineage, the word rule, fitting on a bounded sample."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The word rule of the contracts: everything between ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Where that is unset, a folder beside the session's warehouse, which executors share as well.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lithic-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What fit makes of a bounded sample, worked out on an executor: the driver gets the model only.

    sample must end in orderBy().limit(), which brings its rows together, in order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        rows = pa.Table.from_batches(kept) if kept else schema.empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(schema.empty_table())


def drop(df: DataFrame) -> None:
    """Remove what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores before it as no column of the input has."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def buckets_for(rows: int, per_bucket: int = 200_000) -> int:
    """How many parts one key's rows are dealt to, so that a part stays near per_bucket rows at any size."""
    n = 256
    while n * per_bucket < rows:
        n *= 2
    return n
