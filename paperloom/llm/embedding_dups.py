"""Near-duplicate vectors by random-hyperplane sign hashing and exact cosine verification.

Equal vectors of one label collapse to one class before any search. Each class gets one
signature for each table, and classes of one label that share a signature are compared in
double precision. A pair counts in the first table where it meets only, so link counts are
right without any list of pairs: a bucket gives counts and a spanning forest. Buckets beyond
``BLOCK`` classes are dealt into blocks, and each pair of blocks is compared in a group of its
own. The bits of a signature follow the number of classes, and the number of tables follows
from the bits and the recall wanted at the threshold itself; closer pairs are found more often.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, link with nothing; vectors of different lengths never link; repeated
rows are vectors like any other; a null id is never the smallest id of a component; further
columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import groups, stored
from paperloom.llm.components import components, spanning

SEED, RECALL, BUCKET, BLOCK = 20240229, 0.998, 32, 2048


def tables_for(count: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a signature and number of tables for ``count`` vectors."""
    bits = min(40, max(6, math.ceil(math.log2(max(2, count / BUCKET)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


@lru_cache(maxsize=4)
def planes(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, tables * bits))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One integer for each row and table."""
    signs = (x @ planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def matrix(column) -> np.ndarray:
    """A list column whose lists are equally long, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def compare(x, ids, weight, side, number, threshold, bits, tables):
    """Of one bucket: weighted counts of the links first met in table ``number``, and spanning links.

    ``side`` tells the blocks of a large bucket apart; with two of them only pairs across count.
    """
    norm = np.sqrt((x * x).sum(axis=1))
    sigs, everyone = None, np.arange(len(x))
    across = side.min() != side.max()

    def near(i, j):
        hit = x[i] @ x[j].T >= threshold * (norm[i][:, None] * norm[j][None, :])
        return hit & (side[i][:, None] != side[j][None, :]) if across else hit

    total, some = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    for at in range(0, len(x), 256):
        own = everyone[at : at + 256]
        hit = near(own, everyone)
        hit[np.arange(len(own)), own] = False
        i, j = np.nonzero(hit)
        some[own[hit.any(axis=1)]] = True
        if sigs is None and len(i):
            sigs = signatures(x, bits, tables)
        for cut in range(0, len(i), 1 << 17):
            p, q = own[i[cut : cut + (1 << 17)]], j[cut : cut + (1 << 17)]
            first = (sigs[p] == sigs[q]).argmax(axis=1) == number
            total += np.bincount(p[first], weight[q[first]], len(x)).astype(np.int64)
    linked = np.flatnonzero(some)
    pairs = np.array(spanning(len(linked), lambda i, j: near(linked[i], linked[j])), np.int64).reshape(-1, 2)
    counted = np.flatnonzero(total)
    return ids[counted], total[counted], ids[linked[pairs[:, 0]]], ids[linked[pairs[:, 1]]]


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """``id, n_links, component_id, kept`` for each row of ``vectors``."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("x"), F.col(label).alias("y"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    usable = F.col("y").isNotNull() & finite & F.exists("x", lambda v: v != 0)
    equal = rows.filter(usable).groupBy("y", "x").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = stored(equal.withColumn("c", F.monotonically_increasing_id()), "classes")
    bits, tables = tables_for(classes.count(), threshold)

    def sign(batches):
        for batch in batches:
            sizes = np.array(batch.column("size").to_pylist(), np.int64)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                sigs = signatures(matrix(part.column("x")), bits, tables)
                numbers = pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part)))
                again = pa.array(np.repeat(np.arange(len(part)), tables))
                yield pa.RecordBatch.from_arrays([part.column("c").take(again), part.column("y").take(again), part.column("size").take(again), numbers, pa.array(sigs.ravel())], names=["c", "y", "size", "t", "sig"])

    signed = classes.select("c", F.col("y").cast("string").alias("y"), F.size("x").alias("size"), "x").mapInArrow(sign, "c long, y string, size int, t int, sig long")
    bucket = F.xxhash64("y", "size", "t", "sig")
    met = stored(signed.select("c", "t", bucket.alias("bucket")), "signatures")
    sizes = met.groupBy("bucket").agg(F.count("*").alias("in_bucket")).filter("in_bucket > 1")
    blocks = F.ceil(F.col("in_bucket") / BLOCK).cast("int")
    dealt = met.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = dealt.select("c", "t", "bucket", "side", other)
    key = F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))
    carried = paired.select("c", "t", "side", key.alias("key")).join(classes.select("c", "n", "x", F.col("y").cast("string").alias("y")), "c")

    def link(batches):
        for table in groups(batches, "key"):
            if table.num_rows < 2:
                continue
            # A key is a hash: what shares it by chance only is told apart here.
            kinds = list(zip(table.column("t").to_pylist(), table.column("y").to_pylist(), pa.compute.list_value_length(table.column("x")).to_pylist()))
            for kind in dict.fromkeys(kinds):
                part = table if kinds.count(kind) == len(kinds) else table.filter(pa.array([k == kind for k in kinds]))
                who, count, a, b = compare(matrix(part.column("x")), part.column("c").to_numpy(), part.column("n").to_numpy(), part.column("side").to_numpy(), kind[0], threshold, bits, tables)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((who, a))), pa.array(np.concatenate((np.full(len(who), -1), b)).astype(np.int64)), pa.array(np.concatenate((count, np.zeros(len(a), np.int64))))], names=["a", "b", "n"])

    found = stored(carried.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long, n long"), "vector-links")
    counts = found.filter("b < 0").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"))
    joined = components(found.filter("b >= 0"))
    nodes = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    of = nodes.join(classes.select(F.col("c").alias("node"), "least"), "node")
    group = of.groupBy("component").agg(F.min("least").alias("group_least"))
    labels = of.join(group, "component").select(F.col("node").alias("c"), "group_least")
    known = classes.join(counts, "c", "left").join(labels, "c", "left")
    known = known.select("y", "x", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("group_least", "least").alias("component_id"))
    out = rows.join(known, ["y", "x"], "left")
    out = out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False)))
