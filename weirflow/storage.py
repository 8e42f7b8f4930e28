"""Intermediate tables in the folder that driver and executors share.

Iterative jobs and tables that are read more than once are written as Parquet
below ``spark.checkpoint.dir``: that cuts lineage, survives the loss of an
executor, and is smaller than a serialised RDD checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh temporary one only where none is set (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weirflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch between the JVM and a Python worker while a scratch table is written; each side holds a few at once.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds Arrow batches by BATCH_BYTES for the jobs started inside, where the session allows more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation, by way of Arrow.

    ``createDataFrame`` on a list passes it through Python workers, for which each executor keeps a second daemon.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields), kind)


class Scratch:
    """Tables of one job: ``save`` writes and rereads, ``drop`` deletes those no longer needed, ``close`` all of them."""

    _open: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        Scratch._open.append(self.base)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weirflow_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_weirflow_path", None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        """Deletes the folder of all tables: call it once no result that reads them is needed."""
        _delete(self.spark, self.base)
        if self.base in Scratch._open:
            Scratch._open.remove(self.base)


@contextmanager
def released(spark: SparkSession, *keep: Scratch) -> Iterator[None]:
    """Deletes the scratch folders opened inside, but for those of ``keep``: for a step that ends by storing its result."""
    before = set(Scratch._open)
    try:
        yield
    finally:
        for base in [b for b in Scratch._open if b not in before and b not in {s.base for s in keep}]:
            _delete(spark, base)
            Scratch._open.remove(base)
