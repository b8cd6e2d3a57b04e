"""Shared tables, row keys and byte tables of the operators in this folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import shared_dir

#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Whether Spark deletes the shuffle files of a query at its end, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage.

    All tables of a run lie in one folder, named by its application id; what is left can go after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; only for tables that no later plan reads."""
    path, spark = df._stored_at, df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def with_row(df: DataFrame, row: str = "_row") -> DataFrame:
    """A key for each input row. It follows file splits, so a recomputed scan gives the same keys."""
    return df.withColumn(row, F.monotonically_increasing_id())


def blocks(rows: DataFrame, keys: list[str], item: str, size: int, crossed: bool) -> DataFrame:
    """``rows`` of groups (equal ``keys``) with more than ``size`` items, dealt into blocks: with ``x`` and ``y`` both the
    row's block ``own``, or, if ``crossed``, a copy for each pair (x, y) of blocks that has it. Every two items of
    a group then meet in some pair, and no pair has many more than twice ``size``."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > size)
    count = F.ceil(F.col("n") / size).cast("int")
    own = rows.join(many, keys).withColumn("blocks", count).withColumn("own", F.pmod(F.xxhash64(item, *keys), F.col("blocks")).cast("int"))
    if not crossed:
        return own.withColumns({"x": F.col("own"), "y": F.col("own")}).drop("n", "blocks")
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("n", "blocks", "other")


def text_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each value (None for null), without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 4 << 20):
    """``batch`` in parts of ``rows`` at most, and of ``size`` bytes of text unless a row alone has more."""
    import numpy as np
    import pyarrow.compute as pc

    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(total), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(max(int(np.searchsorted(ends, before + size, "right")), start + 1), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def list_array(lengths, values: pa.Array) -> pa.ListArray:
    """A list column from the lengths of its lists and all their values."""
    import numpy as np

    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def groups(batches, key: str):
    """Tables of consecutive rows with one value of ``key``, from batches sorted by it."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(keys)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts, stops):
            if b < len(keys):
                yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
                held = []
            else:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
