"""Connected components of a link table, without gathering links or nodes on the driver.

Each partition first shrinks its own links to a spanning forest. Then large-star and small-star
rounds alternate until the links form stars around the smallest node, or until so few are left that one
forest holds them (``HELD``): then that forest is the answer, and no round reads all links again. Minima are
aggregated before the shuffle; the joins that hand them back are plain equi-joins, whose hot keys adaptive
execution can split. Every round is written to the shared folder, so no lineage piles up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import dropped, stored


class Forest:
    """Union-find whose roots are the smallest nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, way = self.up, []
        while (y := up.get(x, x)) != x:
            way.append(x)
            x = y
        for y in way:
            up[y] = x
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


#: Links that a task holds at once, 8 MB of ids; what it has beyond that goes out as a further forest.
HELD = 500_000


def _forests(batches):
    forest = Forest()

    def out():
        nodes = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(x, y)
        if len(forest.up) >= HELD:
            yield out()
            forest = Forest()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every linked node that isn't its component's smallest node.

    ``links`` has two bigint columns ``a`` and ``b``. Null ends and self-links don't count;
    repeated links and either direction are fine; an empty table gives an empty result.
    """
    pairs = stored(links.select("a", "b").filter("a <> b"), "pairs")  # so that no task runs the links' Python beside this one
    now = stored(pairs.mapInArrow(_forests, "a long, b long").distinct(), "links")
    dropped(pairs)

    def sign(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()

    before = sign(now)
    while before["n"] > HELD:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        dropped(now)
        now, sign_now = after, sign(after)
        if sign_now == before:
            break
        before = sign_now
    if 0 < before["n"] <= HELD:
        whole = stored(now.coalesce(1).mapInArrow(_forests, "a long, b long"), "links")
        dropped(now)
        now = whole
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def spanning(count: int, near) -> list[tuple[int, int]]:
    """Links of a spanning forest over ``count`` points that are few enough to hold.

    ``near(i, others)`` tells which of the points ``others`` (an index array) are linked with
    the points ``i`` (an index array), as a matrix. Each point is expanded once against those
    not yet reached, so a dense group gives one link less than it has points.
    """
    left, links = np.arange(count), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:256], front[256:]
            hit = near(now, left)
            reached = hit.any(axis=0)
            if reached.any():
                new = left[reached]
                links += zip(now[hit[:, reached].argmax(axis=0)].tolist(), new.tolist())
                front, left = np.concatenate((front, new)), left[~reached]
    return links
