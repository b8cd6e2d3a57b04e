"""SimHash near-duplicate groups, found with vantage-point trees over the fingerprints.

A fingerprint is made from the XXH64 (seed 42) of all word shingles, repeats included; a bit is
set if it is set in over half of them. Equal fingerprints collapse to one before any search.

Of two fingerprints within three bits, one half differs in one bit at most. So there are two
vantage-point trees, one for each half, built on the driver from a bounded sample of distinct
fingerprints, that deal them into shards by the Hamming distance of that half: at each node the
inner branch also takes what lies within the half's radius beyond the boundary, and the outer
branch what lies outside. By the triangle inequality every linked pair shares a shard of one tree
at least. (One tree on all 64 bits is right, too, but its overlap grows as the input to the power
1.6; on halves it is 1.2.) Shards are searched on their own, by smaller trees of the same kind and
exact 64-bit distances in the last cells; a shard that stays large is searched a pair of blocks at
a time, in as many tasks. A shard gives a spanning forest of its links only, and
the groups are the connected components over all shards.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; repeated rows each come out; a null id is never the
smallest id of a group; an empty table gives an empty result. ``fingerprints`` passes further columns
through, ``near_duplicates`` returns its own three only. The shingles of a very long text are hashed
65,536 at a time; the text and its list of words are held whole.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import LOWER, blocks, slices, stored, text_bytes
from paperloom.llm.components import components, spanning

SEED = 42
#: Distinct fingerprints that a shard should hold, and the bounds of the driver's sample.
SHARD, SAMPLE_EACH, SAMPLE_MOST = 1500, 48, 200_000
#: Fingerprints that one task searches at once.
CROWD = 16_384
#: The parts of a fingerprint, each with a tree of its own.
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0] + [e + 1 for e in ends[: len(words) - shingle]]
    count, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):  # so many shingles at once that long texts need little memory
        part = zip(starts[at : at + (1 << 16)], ends[at + shingle - 1 : at + shingle - 1 + (1 << 16)])
        hashes = np.fromiter([digest(line[a:b], SEED) for a, b in part], np.uint64)
        ones += np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with a bigint column ``fp``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("fp")
    schema = T.StructType(docs.schema.fields + [T.StructField("fp", T.LongType())])
    names = to_arrow_schema(schema).names

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = [signed(fingerprint(x, shingle)) for x in text_bytes(part.column(text))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps, pa.int64())], names=names)

    return docs.mapInArrow(run, schema)


def _halves(x: np.ndarray, vantage: np.uint64, radius: int):
    """The boundary that keeps the larger branch smallest, and that branch's size."""
    counts = np.bincount(np.bitwise_count(x ^ vantage), minlength=65).cumsum()
    inner = counts[np.minimum(np.arange(65) + radius, 64)]
    larger = np.maximum(inner, len(x) - counts)
    mu = int(larger.argmin())
    return mu, int(larger[mu])


def _choose(x: np.ndarray, radius: int, tries: int, seed: int):
    """Of a few members as vantage points, the one that divides best; None if none helps."""
    rng = np.random.default_rng(seed)
    options = [(*_halves(x, v, radius), v) for v in x[rng.integers(0, len(x), tries)]]
    mu, size, vantage = min(options, key=lambda o: o[1])
    return (vantage, mu) if size < 0.9 * len(x) else None


def plant(sample: np.ndarray, stands_for: float, shard: int, radius: int) -> list:
    """The tree as rows (vantage, boundary, inner, outer); a leaf is (None, number)."""
    tree, leaves = [], 0
    todo = [(sample, None, 0, 0)]
    while todo:
        x, above, side, depth = todo.pop()
        at = len(tree)
        split = None
        if len(x) > 16 and len(x) * stands_for > shard and depth < 60:
            split = _choose(x, radius, 8, at)
        if above is not None:
            tree[above][2 + side] = at
        if split is None:
            tree.append([None, leaves, 0, 0])
            leaves += 1
            continue
        tree.append([split[0], split[1], 0, 0])
        far = np.bitwise_count(x ^ split[0])
        todo += [(x[far <= split[1] + radius], at, 0, depth + 1), (x[far > split[1]], at, 1, depth + 1)]
    return tree


def route(tree: list, x: np.ndarray, radius: int):
    """(leaf number, indices) for every shard that ``x`` reaches."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        vantage, mu, inner, outer = tree[at]
        if vantage is None:
            yield mu, own
            continue
        far = np.bitwise_count(x[own] ^ vantage)
        for branch, mine in ((inner, own[far <= mu + radius]), (outer, own[far > mu])):
            if len(mine):
                todo.append((branch, mine))


def shard_links(x: np.ndarray, radius: int, half: np.uint64, cell: int = 256) -> list[tuple[int, int]]:
    """Spanning links of one shard, by a tree on ``half`` down to cells and exact distances there."""
    links, todo, part, within = [], [np.arange(len(x))], x & half, radius // len(HALVES)
    while todo:
        own = todo.pop()
        split = _choose(part[own], within, 4, len(own)) if len(own) > cell else None
        if split:
            far = np.bitwise_count(part[own] ^ split[0])
            todo += [own[far <= split[1] + within], own[far > split[1]]]
            continue
        y = x[own]
        near = lambda i, j, y=y: np.bitwise_count(y[i][:, None] ^ y[j][None, :]) <= radius
        everyone = np.arange(len(y))
        linked = [np.flatnonzero(near(everyone[at : at + 128], everyone).sum(axis=1) > 1) + at for at in range(0, len(y), 128)]
        some = np.concatenate(linked) if linked else everyone
        links += [(int(own[some[a]]), int(own[some[b]])) for a, b in spanning(len(some), lambda i, j: near(some[i], some[j]))]
    return links


def fingerprint_links(distinct: DataFrame, count: int, radius: int = 3) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect what is within ``radius`` bits."""
    want = min(SAMPLE_MOST, max(4096, SAMPLE_EACH * (count // SHARD)))
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(want).toPandas()
    sample = rows["fp"].to_numpy(np.int64).view(np.uint64)
    within = radius // len(HALVES)
    trees = [plant(sample & half, count / max(1, len(sample)), SHARD, within) for half in HALVES]

    def deal(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (tree, half) in enumerate(zip(trees, HALVES)):
                for leaf, own in route(tree, x & half, within):
                    shard = np.full(len(own), leaf * len(HALVES) + number, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(x[own].view(np.int64))], names=["shard", "fp"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        x = table.column("fp").to_numpy().view(np.uint64)
        pairs = np.array(shard_links(x, radius, HALVES[key[0].as_py() % len(HALVES)]), np.int64).reshape(-1, 2)
        ends = x.view(np.int64)
        return pa.table({"a": ends[pairs[:, 0]], "b": ends[pairs[:, 1]]})

    dealt = stored(distinct.select("fp").mapInArrow(deal, "shard int, fp long"), "shards")
    # Shards that no vantage point divides (near copies in great number) are searched a pair of blocks at a time.
    crowded = dealt.groupBy("shard").count().filter(F.col("count") > CROWD).select("shard")
    whole = dealt.join(crowded, "shard", "left_anti").withColumns({"x": F.lit(0), "y": F.lit(0)})
    parts = whole.unionByName(blocks(dealt, ["shard"], "fp", CROWD, True).drop("own"))
    return parts.groupBy("shard", "x", "y").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``id, fp, component_id`` for each row; the component's id is the smallest id in it."""
    made = stored(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", shingle).select("id", "fp"), "fingerprints")
    distinct = stored(made.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    count = distinct.count()
    joined = components(fingerprint_links(distinct, count, radius))
    nodes = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    of = nodes.join(distinct.select(F.col("fp").alias("node"), "least"), "node")
    least = of.groupBy("component").agg(F.min("least").alias("group_least"))
    linked = of.join(least, "component").select(F.col("node").alias("fp"), "group_least")
    label = distinct.join(linked, "fp", "left").filter("n > 1 OR group_least IS NOT NULL").select("fp", F.coalesce("group_least", "least").alias("component_id"))
    out = made.join(label, "fp", "left")
    return out.select(F.col("id").alias(id), "fp", F.coalesce("component_id", "id").alias("component_id"))
