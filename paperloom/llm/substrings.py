"""Exact removal of long repeated substrings with suffix arrays over windows that could repeat.

A window is ``length`` consecutive bytes of a text. Every byte that is covered by a window whose
bytes also start anywhere else, in another text or in the same one, is removed.

1. Of the ``ANCHOR``-byte strings in a window the one of least hash (the first, if tied) is its
   anchor. It depends on the window's bytes only, so equal windows have equal anchors at equal
   places. Neighbouring windows mostly share theirs: a run of windows with one anchor is one row
   (hash of the anchor, hash of the bytes that the run covers). Runs of an anchor seen once are
   unique; runs of equal bytes repeat as a whole.
2. Runs that share an anchor, but not all bytes, are cut into runs of ``STEP`` windows at places
   fixed to the anchor. What all windows of such a place share is its core. Where at least two
   texts share a core, only the few bytes beside it tell the windows apart.
3. Runs that share a core meet in one task as short strings (bytes before, core, bytes after), and
   a suffix array over these strings, many cores at a time, shows the windows that repeat. Cores
   with more than ``CROWD`` different strings, which no task should hold, are settled by counting
   each of their windows.

Hashes that decide are 128 bits wide. Texts beyond ``CHUNK`` bytes are read in chunks of windows,
which gives the same windows. Counts are aggregated before each shuffle, and hot keys meet in plain
equi-joins only, which adaptive execution can split.

Defined cases: a null text is an empty one; texts shorter than a window keep all bytes; repeated
rows are copies of each other; rows are told apart by id and text, null ids included; further
columns don't matter; an empty table gives an empty one.

What the suffix array does not decide: windows whose anchor is unique (they can't repeat), runs of
equal bytes (they repeat as a whole, found by their hashes), and cores of more than ``CROWD``
different strings (counted window by window). All other windows are decided by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import dropped, list_array, slices, stored
from paperloom.llm.suffix_array import suffix_array

LENGTH, ANCHOR, STEP, CROWD, CHUNK = 400, 128, 16, 20_000, 1 << 20
#: Symbols that one suffix array takes.
SYMBOLS = 150_000

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(1 << (n - 1).bit_length(), b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive bytes."""
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = np.concatenate((x, np.full(-n % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(data: bytes, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor place, first and last window of each run of windows."""
    hashes = rolling(np.frombuffer(data, np.uint8), anchor)
    mixed = hashes * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    keys = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_min(keys, length - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate(([0], cuts))
    return hashes[at[first]], at[first], first, np.concatenate((cuts, [len(at)])) - 1


def halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def text_runs(text: bytes, length: int, anchor: int, chunk: int):
    """Rows (anchor hash, digest, anchor place, first window, last window, times) of one text.

    Runs of equal bytes within the text come once, with their number. The windows of those are
    returned apart as (first, last), for they repeat for sure.
    """
    found, digests = [], []
    for start in range(0, len(text) - length + 1, chunk):
        data = text[start : start + chunk + length - 1]
        h, at, first, last = runs(data, length, anchor)
        for a, i, j in zip(at.tolist(), first.tolist(), last.tolist()):
            digests.append(xxhash.xxh3_128_digest(data[i : j + length], a - i))
        found.append((h, at + start, first + start, last + start))
    h, at, first, last = (np.concatenate(c) for c in zip(*found))
    one, two = halves(b"".join(digests))
    order = np.lexsort((first, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    keep, again = order[new], np.repeat(times > 1, times)
    sure = np.sort(order[again])
    return (h[keep].view(np.int64), one[keep], two[keep], at[keep], first[keep], last[keep], np.minimum(times, 2)), (first[sure], last[sure])


def pieces(text: bytes, at: int, first: int, last: int, length: int, step: int):
    """(core digest, bytes before, bytes after, first window, last window) for each place of a run."""
    for place in range((first - at) // step, (last - at) // step + 1):
        low, high = at + place * step, at + (place + 1) * step - 1
        core = text[high : low + length]
        i, j = max(first, low), min(last, high)
        yield xxhash.xxh3_128_digest(core, place & 0xFFFF), text[i:high], text[low + length : j + length], i, j


def repeated_windows(strings: list[tuple[object, bytes, bytes, int]], step: int) -> list[list[int]]:
    """For each (core, before, after, windows) the numbers of its windows that repeat in another.

    Strings of one core are compared; all their windows hold the core, and besides ``step - 1`` of
    the bytes around it.
    """
    line: list[int] = []
    owner: list[tuple[int, int] | None] = []
    cores: dict = {}
    for k, (core, before, after, windows) in enumerate(strings):
        symbol = cores.setdefault(core, 257 + len(cores))
        start = len(line)
        line += [c + 1 for c in before]
        line.append(symbol)
        line += [c + 1 for c in after]
        line.append(0)
        owner += [(k, w) for w in range(windows)] + [None] * (len(line) - start - windows)
    order = [i for i in suffix_array(line) if owner[i] is not None]
    out: list[list[int]] = [[] for _ in strings]
    if len(order) < 2:
        return out
    # Neighbours repeat each other if their first symbols, as many as a window has, agree.
    places, symbols = np.array(order), np.array(line)
    same = (symbols[places[:-1, None] + np.arange(step)] == symbols[places[1:, None] + np.arange(step)]).all(axis=1)
    for i in places[np.concatenate((same, [False])) | np.concatenate(([False], same))].tolist():
        k, w = owner[i]
        out[k].append(w)
    return out


def remove(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[bytes, np.ndarray]:
    """What stays of ``text`` without the windows ``first`` to ``last``, and the removed spans."""
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), edges.reshape(-1, 2)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, step: int = STEP, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, spans, kept`` for each row; spans are in bytes."""
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).withColumn("th", F.xxhash64("text"))

    def anchors(batches):
        for batch in batches:
            for part in slices(batch, 64):
                out, who, sure, sure_who = [], [], [], []
                for k, x in enumerate(part.column("text").to_pylist()):
                    if len(x) >= length:
                        cols, (i, j) = text_runs(x, length, anchor, chunk)
                        out.append(cols)
                        who.append(np.full(len(cols[0]), k))
                        sure.append((i, j))
                        sure_who.append(np.full(len(i), k))
                if not out:
                    continue
                h, one, two, at, first, last, n = (np.concatenate(c) for c in zip(*out))
                i, j = (np.concatenate(c) for c in zip(*sure))
                own = pa.array(np.concatenate(who + sure_who))
                gap = np.zeros(len(i), np.int64)
                both = lambda a, b, t=pa.int64(): pa.array(np.concatenate((a, b)), t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(own), part.column("th").take(own), both(h, gap), both(one, gap), both(two, gap), both(at, gap), both(first, i), both(last, j), both(n, gap)],
                    names=["id", "th", "h", "s1", "s2", "at", "i", "j", "n"],
                )

    found = stored(rows.mapInArrow(anchors, f"id {kind}, th long, h long, s1 long, s2 long, at long, i long, j long, n long"), "anchors")
    often = found.filter("n > 0").groupBy("h").agg(F.sum("n").alias("all")).filter("all > 1").select("h")
    runs_ = stored(found.filter("n > 0").join(often, "h", "left_semi"), "runs")
    sure = stored(found.filter("n = 0").select("id", "th", "i", "j"), "sure-runs")
    dropped(found)
    distinct = runs_.groupBy("h", "s1", "s2").agg(F.sum("n").alias("n"), F.min(F.struct("id", "th", "at", "i", "j")).alias("run"))
    distinct = stored(distinct, "distinct-runs")
    mixed = distinct.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h")
    asked = distinct.join(mixed, "h", "left_semi").select("run.*", (F.col("n") == 1).alias("open"))
    asked = asked.groupBy("id", "th").agg(F.collect_list(F.struct("at", "i", "j", "open")).alias("asked"))  # the runs of one text
    cut = rows.alias("d").join(asked.hint("shuffle_hash").alias("a"), F.col("d.id").eqNullSafe(F.col("a.id")) & (F.col("d.th") == F.col("a.th"))).select("d.id", "d.th", "d.text", "a.asked")

    def split(batches):
        for batch in batches:
            for part in slices(batch, 64):
                who, digests, cols = [], [], ([], [], [], [], [])
                for k, (x, wanted) in enumerate(zip(part.column("text").to_pylist(), part.column("asked").to_pylist())):
                    for run in wanted:
                        for digest, before, after, i, j in pieces(x, run["at"], run["i"], run["j"], length, step):
                            who.append(k)
                            digests.append(digest)
                            for c, v in zip(cols, (before, after, i, j, run["open"])):
                                c.append(v)
                one, two = halves(b"".join(digests))
                own = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(own), part.column("th").take(own), pa.array(one), pa.array(two), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())],
                    names=["id", "th", "c1", "c2", "before", "after", "i", "j", "open"],
                )

    small = stored(cut.mapInArrow(split, f"id {kind}, th long, c1 long, c2 long, before binary, after binary, i long, j long, open boolean"), "pieces")
    cores = small.groupBy("c1", "c2").agg(F.count("*").alias("strings"), F.max("open").alias("any_open")).filter("strings > 1 AND any_open")
    met = small.join(cores, ["c1", "c2"])

    def settle(batches):
        held, total, last = [], 0, None

        def flush():
            shown = repeated_windows([((r["c1"], r["c2"]), r["before"], r["after"], r["j"] - r["i"] + 1) for r in held], step)
            cols = ([], [], [], [])
            for r, windows in zip(held, shown):
                if r["open"] and windows:
                    at = np.sort(windows)
                    cuts = np.flatnonzero(np.diff(at) > 1)
                    for first, last in zip(at[np.append(0, cuts + 1)].tolist(), at[np.append(cuts, -1)].tolist()):
                        for c, v in zip(cols, (r["id"], r["th"], r["i"] + first, r["i"] + last)):
                            c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["id", "th", "i", "j"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for r in batch.to_pylist():
                core = (r["c1"], r["c2"])
                if core != last and total >= SYMBOLS:
                    yield flush()
                    held, total = [], 0
                last = core
                held.append(r)
                total += len(r["before"]) + len(r["after"]) + 2
        if held:
            yield flush()

    few = met.filter(F.col("strings") <= crowd).repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    by_array = few.select("id", "th", "c1", "c2", "before", "after", "i", "j", "open").mapInArrow(settle, f"id {kind}, th long, i long, j long")
    # Of crowded cores, windows are counted one by one: w bytes of "before" from its end, the rest from "after".
    one_by_one = met.filter(F.col("strings") > crowd).select("id", "th", "c1", "c2", "before", "after", "open", F.explode(F.sequence("i", "j")).alias("w"), "i")
    lead = F.length("before") - (F.col("w") - F.col("i"))
    window = one_by_one.select("id", "th", "c1", "c2", "w", "open", F.expr("substring(before, cast(w - i as int) + 1)").alias("x"), F.substring("after", F.lit(1), (F.lit(step - 1) - lead).cast("int")).alias("y"))
    seen = window.groupBy("c1", "c2", "x", "y").agg(F.count("*").alias("n")).filter("n > 1")
    by_count = window.filter("open").join(seen, ["c1", "c2", "x", "y"], "left_semi").select("id", "th", F.col("w").alias("i"), F.col("w").alias("j"))

    whole = runs_.join(distinct.filter("n > 1").select("h", "s1", "s2"), ["h", "s1", "s2"], "left_semi").select("id", "th", "i", "j")
    gone = whole.unionByName(sure).unionByName(by_array).unionByName(by_count)
    per_row = gone.groupBy("id", "th").agg(F.collect_set(F.struct("i", "j")).alias("gone"))  # the windows of one text, once however often it is repeated
    todo = rows.alias("d").join(per_row.hint("shuffle_hash").alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.th") == F.col("g.th")), "left").select("d.id", "d.text", "g.gone")

    def finish(batches):
        for batch in batches:
            for part in slices(batch, 64):
                sizes, removed, kept, spans, counts = [], [], [], [], []
                gone = part.column("gone")
                starts, stops = gone.offsets.to_numpy()[:-1], gone.offsets.to_numpy()[1:]
                first, last = (gone.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for k, x in enumerate(part.column("text").to_pylist()):
                    a, b = (starts[k], stops[k]) if gone[k].is_valid else (0, 0)
                    rest, cuts = remove(x, first[a:b], last[a:b], length) if b > a else (x, np.empty((0, 2), np.int64))
                    sizes.append(len(x))
                    removed.append(len(x) - len(rest))
                    kept.append(rest)
                    spans.append(cuts)
                    counts.append(len(cuts))
                flat = np.concatenate(spans).astype(np.int64) if spans else np.empty((0, 2), np.int64)
                where = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), list_array(counts, where), pa.array(kept, pa.binary())],
                    names=[id, "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    return todo.mapInArrow(finish, f"`{id}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
