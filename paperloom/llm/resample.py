"""Importance resampling of documents towards a target: hashed word runs, Gumbel scores, merged runs.

Texts are lower-cased (A-Z only) and cut into words of digits, letters and non-ASCII characters. The
features of a text are all runs of 1 to ``longest`` consecutive words, repeats counted, each in the bucket
crc32 modulo ``buckets``. A bucket's gain is the floored logarithm (times 1000) of its smoothed share in the
target over that in the documents; both shares come from all rows. A document's weight is the sum of its
features' gains, its score the weight plus Gumbel noise keyed by its id, so that the best scores are a
draw without replacement by weight.

Counts are arrays of ``buckets`` numbers a task, summed by bucket; the driver gets these sums only and
sends back as many gains. Scored rows are written once, each partition sorted: these files are the runs.
Splitters, from a sample of about ``SAMPLE`` keys a range, cut the order into ranges, at most ``RANGES``; they
balance the work and decide no row. Each run goes to the ranges as chunks of ``CHUNK`` rows at most, and
exact counts of the ranges give each one's first rank and the one in which the draw ends. Later ranges
are not merged. A range's task reads its chunks by their first keys and holds those only that reach over the
place of the merge, in a tournament tree; it stops at the exact count. A hot key is no burden: equal
scores are told apart by id and row.

Defined cases: a null or wordless text has no features, weight 0 and is not eligible; a null id has the noise of an empty one and
comes after others of its score; repeated rows tie, are each scored and drawn for themselves and take different ranks;
an empty target or an empty document table is counted as it is; a very long text is read in pieces of
``PIECE`` bytes; of the input's columns named as new ones the new ones stay.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.llm.common import list_array, slices, stored, text_bytes, with_row
from paperloom.llm.decontaminate import NORMAL

PIECE, CHUNK = 1 << 20, 1024
#: Longest feature in bytes that is hashed with all others.
SHORT = 64
#: Most ranges, rows of a range (while there are fewer), sampled keys of a range.
RANGES, ROWS, SAMPLE = 4096, 10_000, 64
MEASURES = ("n_features", "weight", "score", "rank")


def crc_table() -> np.ndarray:
    """CRC-32 of each byte: eight steps of the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def crc32(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start : start + size]``, a byte of all strings at a time, the longest one by one."""
    raw, out = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint32)
    order = np.argsort(-sizes.astype(np.int32), kind="stable")
    far = int(np.count_nonzero(sizes > SHORT))
    for k in order[:far].tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]])
    order = order[far:]
    at, left = starts[order], sizes[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    longer = len(order) - np.cumsum(np.bincount(left, minlength=SHORT + 1))  # strings of more than k bytes come first
    for k in range(int(left[0]) if len(left) else 0):
        n = int(longer[k])
        own = crc[:n]
        crc[:n] = CRC[(own ^ raw[at[:n] + k]) & 0xFF] ^ (own >> np.uint32(8))
    out[order] = ~crc
    return out


def lines(texts: list, longest: int):
    """(buffer, numbers of texts, carried words): texts in normal form, one a line, about ``PIECE`` bytes a buffer.

    A longer text makes several lines; each repeats the last ``longest - 1`` words before it.
    """
    held, who, carried, total = [], [], [], 0
    for number, text in enumerate(texts):
        data, at, before = (text or b"").translate(NORMAL), 0, b""
        while at < len(data):
            stop = at + PIECE
            if stop < len(data) and (stop := data.find(b" ", stop)) < 0:
                stop = len(data)
            words = data[at:stop].split()
            line = b" ".join([before, *words] if before else words)
            if total and total + len(line) > PIECE:
                yield b"\n".join(held) + b"\n", np.array(who), np.array(carried)
                held, who, carried, total = [], [], [], 0
            held.append(line), who.append(number), carried.append(before.count(b" ") + bool(before))
            total += len(line) + 1
            if stop < len(data) and longest > 1:
                before = b" ".join(line.rsplit(b" ", longest - 1)[-(longest - 1) :])
            at = stop
    if held:
        yield b"\n".join(held) + b"\n", np.array(who), np.array(carried)


def features(texts: list, longest: int, buckets: int):
    """(number of the text, words or 0, bucket) of the runs of all texts, as arrays; a run counts where it ends,
    and ``words`` is 1 for a run of one word."""
    for data, who, carried in lines(texts, longest):
        body = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero((body == 32) | (body == 10))
        starts = np.concatenate(([0], ends[:-1] + 1))
        full = ends > starts  # an empty line has no word
        line = np.cumsum(body[ends] == 10) - (body[ends] == 10)
        starts, ends, line = starts[full], ends[full], line[full]
        if not len(starts):
            continue
        place = np.arange(len(line)) - np.searchsorted(line, line)
        for n in range(1, min(longest, len(line)) + 1):
            first, last = slice(0, len(line) - n + 1), slice(n - 1, None)
            own = (line[first] == line[last]) & (place[last] >= carried[line[last]])
            a, b, of = starts[first][own], ends[last][own], line[first][own]
            yield who[of], n == 1, (crc32(data, a, b - a) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(rows: DataFrame, text: str, buckets: int, longest: int) -> np.ndarray:
    """How many features of all rows each bucket has."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, _, own in features(text_bytes(part.column(0)), longest, buckets):
                    total += np.bincount(own, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])

    summed = rows.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # a row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, id: str) -> int:
    """floor(1000 times a Gumbel variate), keyed by seed and id."""
    h = int(hashlib.sha256(f"{seed}:{id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, id: str, text: str, gain: np.ndarray, longest: int, least: int, seed: int) -> DataFrame:
    """``id, _row, n_features, weight, score, eligible`` of each row."""
    kind, shared, buckets = rows.schema[id].dataType, rows.sparkSession.sparkContext.broadcast(gain), len(gain)
    schema = T.StructType([T.StructField("id", kind), T.StructField("_row", T.LongType()), *(T.StructField(n, T.LongType()) for n in MEASURES[:3]), T.StructField("eligible", T.BooleanType())])

    def run(batches):
        gain = shared.value
        for batch in batches:
            for part in slices(batch):
                n, measures = part.num_rows, np.zeros((part.num_rows, 3), np.int64)
                for who, words, own in features(text_bytes(part.column("text")), longest, buckets):
                    each = np.bincount(who, minlength=n)
                    measures[:, 0] += each * words
                    measures[:, 1] += each
                    measures[:, 2] += np.bincount(who, weights=gain[own], minlength=n).astype(np.int64)  # whole numbers below 2^53
                drawn = np.array([noise(seed, x or "") for x in part.column("key").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("_row"), pa.array(measures[:, 1]), pa.array(measures[:, 2]), pa.array(measures[:, 2] + drawn), pa.array(measures[:, 0] >= least)],
                    names=[f.name for f in schema.fields],
                )

    return rows.select(F.col(id).alias("id"), "_row", F.col(id).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def key_list(batch) -> list[tuple]:
    """The place of each row in the order: best score first, then smaller id (null last), then row."""
    columns = (batch.column(n).to_pylist() for n in ("score", "id", "_row"))
    return [(-s, i is None, 0 if i is None else i, r) for s, i, r in zip(*columns)]


def chunks(runs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Sorted rows as chunks (``range``, first key, ``n``, lists of the rows' columns) of one run and range each."""
    names = ["id", "_row", *MEASURES[:3]]
    kinds = [runs.schema[n].dataType for n in names]
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("first_score", T.LongType()), T.StructField("first_id", kinds[0]), T.StructField("first_row", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(f"{n}s", T.ArrayType(k)) for n, k in zip(names, kinds))])
    shared = runs.sparkSession.sparkContext.broadcast(splitters)  # RANGES at most

    def run(batches):
        bounds = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = key_list(batch)
            at, starts, sizes, ranges = 0, [], [], []
            while at < len(keys):
                own = bisect_left(bounds, keys[at])
                stop, end = at + 1, bounds[own] if own < len(bounds) else None
                while stop < len(keys) and stop - at < CHUNK and keys[stop] > keys[stop - 1] and (end is None or keys[stop] <= end):
                    stop += 1
                starts.append(at), sizes.append(stop - at), ranges.append(own)
                at = stop
            first = pa.array(starts)
            heads = [pc.take(batch.column(n), first) for n in ("score", "id", "_row")]
            lists = [list_array(sizes, batch.column(n)) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *heads, pa.array(sizes, pa.int64()), *lists], names=[f.name for f in schema.fields])

    return runs.select(*names).mapInArrow(run, schema)


class Tournament:
    """A tree of matches over slots, each with a key or none: the least key wins; slots are added as needed."""

    def __init__(self):
        self.size, self.nodes, self.free = 1, [None, None], [0]

    def _play(self, at: int) -> None:
        nodes = self.nodes
        while at > 1:
            at >>= 1
            a, b = nodes[2 * at], nodes[2 * at + 1]
            nodes[at] = b if a is None or (b is not None and b < a) else a

    def enter(self, key: tuple) -> int:
        if not self.free:
            leaves = self.nodes[self.size :]
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.size *= 2
            self.nodes = [None] * self.size + leaves + [None] * len(leaves)
            for at in range(self.size - 1, 0, -1):
                a, b = self.nodes[2 * at], self.nodes[2 * at + 1]
                self.nodes[at] = b if a is None or (b is not None and b < a) else a
        slot = self.free.pop()
        self.set(slot, key)
        return slot

    def set(self, slot: int, key: tuple | None) -> None:
        self.nodes[self.size + slot] = None if key is None else (key, slot)
        self._play(self.size + slot)
        if key is None:
            self.free.append(slot)

    def best(self):
        return self.nodes[1]

    def second(self):
        """The best of those that lost to the winner itself."""
        at, out = self.size + self.nodes[1][1], None
        while at > 1:
            other = self.nodes[at ^ 1]
            if other is not None and (out is None or other < out):
                out = other
            at >>= 1
        return out


def merged(parts, most: int | None):
    """(part, start, stop) in the order of all rows' keys, ``most`` rows if given, then what is left.

    ``parts``: (keys, payload) of sorted stretches, by first key. Only stretches that reach over the place
    of the merge are held. The rest, without an order, comes as (payload, start, stop, False).
    """
    tree, held, parts = Tournament(), {}, iter(parts)
    coming = next(parts, None)
    while coming is not None or held:
        if most == 0:
            for keys, payload, at in held.values():
                yield payload, at, len(keys), False
            while coming is not None:
                yield coming[1], 0, len(coming[0]), False
                coming = next(parts, None)
            return
        best = tree.best()
        while coming is not None and (best is None or coming[0][0] < best[0]):
            slot = tree.enter(coming[0][0])
            held[slot] = (*coming, 0)
            coming, best = next(parts, None), tree.best()
        (_, slot), other = best, tree.second()
        keys, payload, at = held[slot]
        bound = other[0] if other is not None else None
        if coming is not None and (bound is None or coming[0][0] < bound):
            bound = coming[0][0]
        stop = len(keys) if bound is None else max(at + 1, bisect_left(keys, bound, at))
        if most is not None:
            stop = min(stop, at + most)
            most -= stop - at
        yield payload, at, stop, True
        if stop < len(keys):
            held[slot] = (keys, payload, stop)
            tree.set(slot, keys[stop])
        else:
            del held[slot]
            tree.set(slot, None)


def ranked(rows: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = 10_000, longest: int = 1, least: int = 20, share: tuple[int, int] = (10, 100), seed: int = 2024) -> DataFrame:
    """``id, n_features, weight, score, rank, _row`` of all rows (which have a key ``_row``); ``rank`` is null for rows not drawn.

    Drawn are floor(share[0] * N / share[1]) of the N rows with ``least`` words or more.
    """
    gain = gains(bucket_counts(rows, text, buckets, longest), bucket_counts(target, text, buckets, longest))
    best = [F.desc("eligible"), F.desc("score"), F.col("id").asc_nulls_last(), F.col("_row")]
    runs = stored(scored(rows, id, text, gain, longest, least, seed).sortWithinPartitions(*best), "runs")
    eligible = runs.filter("eligible")
    count = eligible.count()
    parts = max(1, min(RANGES, count // ROWS))
    draw = F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, parts * SAMPLE / max(1, count)) * (1 << 40))
    sample = sorted(key_list(eligible.filter(draw).select("score", "id", "_row").toArrow())) if parts > 1 else []  # about RANGES * SAMPLE keys at most
    splitters = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    cut = stored(chunks(eligible, splitters), "chunks")
    sizes = {r["range"]: r["n"] for r in cut.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row a range
    quota, last, offsets, at = share[0] * count // share[1], -1, {}, 0
    for k in sorted(sizes):
        if at < quota:
            offsets[k], last = at, k
        at += sizes[k]
    lists = ["ids", "_rows", *(f"{n}s" for n in MEASURES[:3])]
    kind = runs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("_row", T.LongType()), *(T.StructField(n, T.LongType()) for n in MEASURES)])
    arrow = [to_arrow_type(kind), *[pa.int64()] * 4]

    def merge(batches):
        """Ranges one after the other; each chunk is read when the merge gets to its first key."""
        ready = iter(_stretches(batches, arrow, lists))
        coming = next(ready, None)
        while coming is not None:
            own = coming[0]

            def of_range():
                nonlocal coming
                while coming is not None and coming[0] == own:
                    now, coming = coming, next(ready, None)
                    yield now[1:]

            rank, out = offsets[own], []
            for payload, a, b, drawn in merged(of_range(), quota - rank if own == last else None):
                columns = [x.slice(a, b - a) for x in payload]
                places = pa.array(np.arange(rank + 1, rank + 1 + b - a)) if drawn else pa.nulls(b - a, pa.int64())
                rank += b - a if drawn else 0
                out.append(pa.RecordBatch.from_arrays([*columns, places], names=schema.names))
                if len(out) == CHUNK:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out = []
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    first = ["range", F.desc("first_score"), F.col("first_id").asc_nulls_last(), "first_row"]
    near = cut.filter(F.col("range") <= last).repartition(max(1, last + 1), "range").sortWithinPartitions(*first).select("range", *lists).mapInArrow(merge, schema)
    far = cut.filter(F.col("range") > last).select(F.explode(F.arrays_zip(*lists)).alias("r")).selectExpr("r.ids AS id", "r._rows AS _row", "r.n_featuress AS n_features", "r.weights AS weight", "r.scores AS score", "cast(NULL AS bigint) AS rank")
    rest = runs.filter("NOT eligible").selectExpr("id", "_row", "n_features", "weight", "score", "cast(NULL AS bigint) AS rank")
    return near.unionByName(far).unionByName(rest).withColumnRenamed("id", id)


def _stretches(batches, arrow: list, lists: list[str]):
    """(range, keys, columns) of each chunk row."""
    for batch in batches:
        for i in range(batch.num_rows):
            columns = [batch.column(n)[i].values.cast(kind) for n, kind in zip(lists, arrow)]
            named = pa.RecordBatch.from_arrays(columns, names=["id", "_row", *MEASURES[:3]])
            yield batch.column("range")[i].as_py(), key_list(named), columns


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_features, weight, score, rank``; a scan or another input that gives the same rows each time it is read."""
    rows = with_row(docs.drop(*[m for m in MEASURES if m not in (id, text)]))
    return rows.join(ranked(rows, target, id, text, **options).drop(id), "_row").drop("_row")
