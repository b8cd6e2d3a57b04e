"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one line kept a group.

A line's normal form is its words of ASCII digits, lower-cased letters and non-ASCII characters.
Lines of equal normal form are one distinct line. Distinct lines of at least ``FUZZY_WORDS`` words
also link if their SimHashes (words weighted by their length) differ in at most ``radius`` bits and
the edit similarity of their normal forms (one less the distance by the longer length) is at least
``similarity``. Of each connected group of lines one occurrence stays: the first by document id,
text hash and place. All others are cut from their documents.

Of ``m`` blocks of the hash, ``m - radius`` agree if at most ``radius`` bits differ; each choice of
so many blocks is one key. ``m`` follows the number of distinct lines, so that a key's value stays
rare.

Three bits are few: one changed word of ten flips about nine. With ``bands``, lines also link that
differ in up to ``WIDE`` bits (short lines: ``WIDER``), if the edit similarity is high enough. Such pairs are found by further
keys, one a band, each of the ``ROWS`` words of a line that come first in as many orders by hash
(MinHash): of two lines that share most words, some band agrees.

Keys travel without texts first. A task reads its keys in order and passes on the lines that have a
partner by hash and length; texts are fetched for those only. Pairs are then verified many at once,
and none whose lines are known to be connected. Buckets of more than ``HASHES`` lines (keys) or
``TEXTS`` lines (texts) are dealt into blocks, and every pair of blocks is a group of its own, so no
task holds a whole bucket. Pairs of different text blocks come last and without the lines that the
links within blocks have already brought together, so near copies in great number don't meet in pairs.

Defined cases: lines without words are never cut; a null text stays null and has no lines; a text
whose lines are all cut is the empty text; rows with a null id come last in the order; rows
of equal id and text are one document, and stay or go alike; further columns pass through, but
columns of the new names are replaced; an empty table gives an empty one. Very long texts are read in
pieces of about a megabyte; a line is held whole, with about 20 bytes for each of its bytes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import blocks, dropped, slices, stored, text_bytes
from paperloom.llm.components import Forest, components
from paperloom.llm.decontaminate import NORMAL
from paperloom.llm.edit import Form, told, within
from paperloom.llm.words import Profiles, pieces, sketches

FUZZY_WORDS, RADIUS, SIMILARITY, RARE = 5, 3, 0.8, 64
#: With so many bands, at least 0.9 of the pairs of the edit similarity are found (measured in README.md).
BANDS, ROWS = 10, 4
#: Bits that may differ in a band: in lines of SHORT characters or more, and in shorter ones, where each word weighs more.
WIDE, WIDER, SHORT = 17, 25, 100
#: Lines of one key that meet at once: by their hashes, and by their texts.
HASHES, TEXTS = 8192, 2048
#: Groups whose pairs are looked at side by side, and pairs of a larger group that are looked at together.
FEW, PAIRS = 64, 1 << 17
#: Distances that are taken before it is looked up again which pairs still need one.
DISTANCES = 2048
#: Lengths are told apart by the power of 1.05 that they reach; the last bits of a line's number.
CLASS_BITS, CLASS_STEP = 8, 1.05


def masks(count: int, radius: int = RADIUS) -> list[int]:
    """The bits of each key for ``count`` distinct lines."""
    blocks = radius + 1
    while 64 * (blocks - radius) / blocks < np.log2(max(1, count / RARE)) and blocks < 2 * radius + 2:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def marked(docs: DataFrame, id: str, text: str, bands: int = 0) -> DataFrame:
    """Each line with its text's key (id and a hash), its place and what ``sketches`` has of it, bands as bytes."""
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                texts = text_bytes(part.column("text"))
                counts = np.array([0 if x is None else x.count(b"\n") + 1 for x in texts])
                if not counts.any():
                    continue
                found = [sketches(p, bands, ROWS) for p in pieces(texts)]
                flat = lambda name, kind: pa.array(np.concatenate([x[name] for x in found]).view(kind))
                own, line = pa.array(np.repeat(np.arange(len(counts)), counts)), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                cols = [pa.array(line.astype(np.int32)), flat("h1", np.int64), flat("h2", np.int64), flat("sim", np.int64), flat("words", np.int32), flat("chars", np.int32)]
                if bands:
                    keys = b"".join(x["bands"].tobytes() for x in found)
                    cols.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * bands), len(line), [None, pa.py_buffer(keys)]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("id").take(own), part.column("th").take(own), *cols], names=["id", "th", "line", *LINE, *(["bands"] if bands else [])])

    return rows.mapInArrow(run, f"id {kind}, th long, line int, h1 long, h2 long, sim long, words int, chars int" + (", bands binary" if bands else ""))


LINE = ["h1", "h2", "sim", "words", "chars"]


def _meets(d: np.ndarray, sims: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the lines ``i`` and ``j`` are two that hashes and lengths allow to link; ``most`` has no bound (64) for bands."""
    a, b = _class(d[i]), _class(d[j])
    wide = np.where(np.minimum(a, b) < int(np.log(SHORT) / np.log(CLASS_STEP)), WIDER, WIDE)
    far = np.bitwise_count((sims[i] ^ sims[j]).view(np.uint64))
    return (d[i] != d[j]) & (far <= np.minimum(wide, most[i])) & (np.abs(a - b) <= _CLASSES)


#: Classes of length that lines of the edit similarity are apart at most.
_CLASSES = int(np.ceil(np.log(1 / SIMILARITY) / np.log(CLASS_STEP)))


def _class(d: np.ndarray) -> np.ndarray:
    return d & ((1 << CLASS_BITS) - 1)


def _shifts(key: np.ndarray, size: np.ndarray | None = None):
    """Index pairs of equal ``key`` (sorted), those of neighbours first: with those, all pairs of each group.

    With classes of length, sorted within each key, only the pairs whose classes are near: the others can't link."""
    i = np.flatnonzero(key[:-1] == key[1:])
    shift = 1
    while len(i):
        if size is not None:
            i = i[size[i + shift] - size[i] <= _CLASSES]
        yield i, i + shift
        shift += 1
        i = i[i + shift < len(key)]
        i = i[key[i] == key[i + shift]]


def _pairs(key: np.ndarray):
    """As ``_shifts`` for groups of up to ``FEW`` members; a larger group's members come a few at a time, with all after them."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    for i, j in _shifts(key[few]):
        yield few[i], few[j]
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        at, step = 0, 1
        while at < size - 1:
            step = min(step, size - 1 - at)
            i = np.repeat(np.arange(at, at + step), np.arange(size - 1 - at, size - 1 - at - step, -1))
            j = np.concatenate([np.arange(k + 1, size) for k in range(at, at + step)])
            yield start + i, start + j
            at, step = at + step, min(2 * step, max(1, PAIRS // size))


def _runs(batches, names: list[str], rows: int):
    """Tables of whole groups (equal in the columns ``names``), of few more than ``rows`` rows unless a group alone has more."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        change = np.zeros(table.num_rows - 1, bool)
        for name in names:
            x = table.column(name).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            at = int(cuts[-1]) + 1
            yield table.slice(0, at)
            table = table.slice(at)
        held, count = table.to_batches(), table.num_rows
    if count:
        yield pa.Table.from_batches(held)


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY, bands: int = 0) -> DataFrame:
    """``docs`` with its repeated lines cut, and ``n_lines``, ``n_cut`` and ``cut_lines`` (their places, from 0)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("n_lines", "n_cut", "cut_lines")
    base = stored(marked(docs, id, text, bands), "marked")
    by_line = [*LINE, *(["bands"] if bands else [])]
    lines = base.filter("words > 0")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "line")
    same = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"), *(F.first(n).alias(n) for n in by_line[2:]))
    length = F.floor(F.log(F.col("chars").cast("double")) / F.lit(np.log(CLASS_STEP))).cast("long")
    number = F.shiftleft(F.monotonically_increasing_id(), CLASS_BITS) + F.least(length, F.lit((1 << CLASS_BITS) - 1))
    distinct = stored(same.withColumn("d", number), "lines")

    bits = masks(distinct.count(), radius)
    # A key is a hash of a choice of blocks and their bits, or of a band; its last bits number the choice.
    key = lambda t, c: F.xxhash64(F.lit(t), c).bitwiseAND(F.lit(~127)).bitwiseOR(F.lit(t))
    assert len(bits) + bands <= 128
    keys = [key(t, F.col("sim").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(bits)] + [key(len(bits) + t, F.substring("bands", 4 * t + 1, 4)) for t in range(bands)]
    keyed = distinct.filter(F.col("words") >= FUZZY_WORDS).select("d", "sim", F.explode(F.array(*keys)).alias("key"))
    bounds = np.array([radius] * len(bits) + [64] * (128 - len(bits)))

    def hint(batches):
        """Lines with a partner; those of keys with more than HASHES lines are marked and left to blocks."""
        for table in _runs(batches, ["key"], 100_000):
            key, d, sims = (table.column(n).to_numpy() for n in ("key", "d", "sim"))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            crowd = np.repeat(sizes > HASHES, sizes)
            few = np.flatnonzero(~crowd & np.repeat(sizes > 1, sizes))
            few = few[np.lexsort((_class(d[few]), key[few]))]
            k, n, s, most = key[few], d[few], sims[few], bounds[key[few] & 127]
            found = np.zeros(len(few), bool)
            for i, j in _shifts(k, _class(n)):
                new = ~(found[i] & found[j])
                i, j = i[new], j[new]
                hit = _meets(n, s, i, j, most)
                found[i[hit]] = found[j[hit]] = True
            out = np.sort(np.concatenate((few[found], np.flatnonzero(crowd))))
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(d[out]), pa.array(sims[out]), pa.array(crowd[out])], names=["key", "d", "sim", "crowd"])

    def hint_blocks(batches):
        for table in _runs(batches, ["key", "x", "y"], 2 * HASHES):
            key, x, y, own, d, sims = (table.column(n).to_numpy() for n in ("key", "x", "y", "own", "d", "sim"))
            group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            order = np.lexsort((_class(d), group))
            key, x, y, own, d, sims, group = (c[order] for c in (key, x, y, own, d, sims, group))
            meet, most = np.zeros(len(key), bool), bounds[key & 127]
            for i, j in _shifts(group, _class(d)):
                new = ~(meet[i] & meet[j])
                i, j = i[new], j[new]
                hit = _meets(d, sims, i, j, most) & ((own[i] != own[j]) | (x[i] == y[i]))
                meet[i[hit]] = meet[j[hit]] = True
            out = np.flatnonzero(meet)
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(d[out]), pa.array(sims[out])], names=["key", "d", "sim"])

    met = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(hint, "key long, d long, sim long, crowd boolean"), "met")
    hinted = met.filter("NOT crowd").drop("crowd")
    if met.filter("crowd").limit(1).count():
        crowds = blocks(met.filter("crowd").drop("crowd"), ["key"], "d", HASHES, True)
        by_block = crowds.select("key", "x", "y", "own", "d", "sim").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        hinted = stored(hinted.unionByName(by_block.mapInArrow(hint_blocks, "key long, d long, sim long").distinct()), "hinted")

    texts_of = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).alias("x")
    known = F.col("bands") if bands else F.lit(b"").alias("bands")
    wanted = hinted.select("d").distinct().join(distinct.select("d", "first", known), "d")
    wanted = wanted.select("d", "first.id", "first.th", "first.line", "bands")
    asked = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("d", "line", "bands")).alias("asked"))  # lines of one text
    met_texts = texts_of.join(asked.hint("shuffle_hash").alias("q"), F.col("x.id").eqNullSafe(F.col("q.id")) & (F.col("x.th") == F.col("q.th")))
    cut_up = met_texts.select(F.split("text", "\n", -1).alias("all"), F.explode("asked").alias("q"))
    texts = cut_up.select("q.d", "q.bands", F.element_at("all", F.col("q.line") + 1).alias("line"))
    if base.filter("line = 0").groupBy("id", "th").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["d"])  # repeated rows have one key
    texts = stored(texts, "texts")

    blocks_of = np.array(bits, np.uint64)

    def verify(batches):
        """A spanning forest of the links of each group (key and two blocks; of different ones, pairs across only).

        Of the keys that a pair shares and that allow it, the first one's group looks at it.
        """
        for table in _runs(batches, ["key", "x", "y"], 20_000):
            key, x, y, own, d, sims, group_of = (table.column(n).to_numpy() for n in ("key", "x", "y", "own", "d", "sim", "c"))
            sims, number = sims.view(np.uint64), key & 127
            least = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.uint32).reshape(len(d), bands)
            line = table.column("line").combine_chunks()
            profiles, forms = Profiles(line), {}

            def form(k: int) -> Form:
                if k not in forms:
                    forms[k] = Form(b" ".join(line[k].as_py().encode().translate(NORMAL).split()).decode())
                return forms[k]

            group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            nodes, node = np.unique(group_of, return_inverse=True)
            up, most, links, open_pairs = np.arange(len(nodes)), bounds[number], [], []

            def join(i, j):
                """Links of the pairs, as far as they bring something together."""
                nonlocal up
                forest = Forest()
                for a, b in zip(i, j):
                    if forest.join(int(up[node[a]]), int(up[node[b]])):
                        links.append((d[a], d[b]))
                if forest.up:
                    move = np.arange(len(nodes))
                    for a in list(forest.up):
                        move[a] = forest.root(a)
                    up = move[up]

            for i, j in _pairs(group):
                apart = up[node[i]] != up[node[j]]
                i, j = i[apart], j[apart]
                hit = _meets(d, sims, i, j, most) & ((own[i] != own[j]) | (x[i] == y[i]))
                i, j = i[hit], j[hit]
                differ = sims[i] ^ sims[j]
                by_bits = ((differ[:, None] & blocks_of) == 0) & (np.bitwise_count(differ) <= radius)[:, None]
                shared = np.concatenate((by_bits, least[i] == least[j]), axis=1)
                here = shared[np.arange(len(i)), number[i]] & (shared.argmax(axis=1) == number[i])
                i, j = i[here], j[here]
                may = profiles.may(i, j, similarity)
                i, j = i[may], j[may]
                while len(i):  # a line meets one other at a time, and none that it has come together with by then
                    _, one = np.unique(j, return_index=True)
                    pairs = list(zip(i[one].tolist(), j[one].tolist()))
                    known = [told(form(a), form(b), similarity) for a, b in pairs]
                    open_pairs += [p for p, good in zip(pairs, known) if good is None]
                    join([a for (a, _), good in zip(pairs, known) if good], [b for (_, b), good in zip(pairs, known) if good])
                    rest = np.ones(len(i), bool)
                    rest[one] = False
                    rest &= up[node[i]] != up[node[j]]
                    i, j = i[rest], j[rest]
            # Only now the pairs that need their distance, for by now others have brought most of them together.
            while open_pairs:
                left = np.array(open_pairs)
                left = left[up[node[left[:, 0]]] != up[node[left[:, 1]]]]
                now, open_pairs = left[:DISTANCES].tolist(), left[DISTANCES:].tolist()
                good = within([(form(a), form(b)) for a, b in now], similarity)
                join([p[0] for p, g in zip(now, good) if g], [p[1] for p, g in zip(now, good) if g])
            ends = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    columns = ["key", "x", "y", "own", "d", "sim", "c", "line", "bands"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # for its time, not its bytes
    check = lambda rows: rows.join(texts, "d").select(*columns).repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(verify, "a long, b long")
    many = hinted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TEXTS)
    alone = hinted.join(many, "key", "left_anti").withColumns({"x": F.lit(0), "y": F.lit(0), "own": F.lit(0)})
    inside = alone.unionByName(blocks(hinted, ["key"], "d", TEXTS, False).select("key", "d", "sim", "x", "y", "own")).withColumn("c", F.col("d"))
    links = stored(check(inside), "links-within")
    joined = components(links)
    if many.limit(1).count():
        # Lines of a crowded key that are in different components, one and all; those that are together need no look.
        named = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "d")
        rest = hinted.join(many.select("key"), "key", "left_semi").join(named, "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component")
        several = rest.groupBy("key").agg((F.min("c") != F.max("c")).alias("open")).filter("open").select("key")
        across = blocks(rest.join(several, "key", "left_semi"), ["key"], "d", TEXTS, True).filter("x <> y")
        joined = components(links.unionByName(check(across)))
    for table in (met, texts, links):
        dropped(table)
    nodes = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    of = nodes.join(distinct.select(F.col("d").alias("node"), "first"), "node")
    chosen = of.groupBy("component").agg(F.min("first").alias("group_first"))
    linked = of.join(chosen, "component").select(F.col("node").alias("d"), "group_first")
    stays = distinct.join(linked, "d", "left").filter("n > 1 OR group_first IS NOT NULL").select("h1", "h2", F.coalesce("group_first", "first").alias("stay"))
    cut = lines.join(stays, ["h1", "h2"]).filter("NOT (stay.id <=> id AND stay.th = th AND stay.line = line)")
    cuts = cut.groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("cut_lines"))  # places in one text
    of_row = F.col(f"o.{id}").eqNullSafe(F.col("c.id")) & (F.xxhash64(f"o.{text}") == F.col("c.th"))
    out = docs.alias("o").join(cuts.hint("shuffle_hash").alias("c"), of_row, "left").select("o.*", F.coalesce("c.cut_lines", F.array().cast("array<int>")).alias("cut_lines"))
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string("n_lines long, n_cut long, cut_lines array<int>").fields)
    names, at = to_arrow_schema(schema).names, docs.columns.index(text)

    def finish(batches):
        for batch in batches:
            for part in slices(batch):
                new, n_lines, n_cut = [], [], []
                for x, cut in zip(text_bytes(part.column(text)), part.column("cut_lines").to_pylist()):
                    n_lines.append(0 if x is None else x.count(b"\n") + 1)
                    n_cut.append(len(cut))
                    if cut:
                        gone = set(cut)
                        x = b"\n".join(y for k, y in enumerate(x.split(b"\n")) if k not in gone)
                    new.append(x)
                columns = list(part.columns)
                columns[at] = pa.array(new, pa.binary()).cast(pa.string())
                columns[-1:] = [pa.array(n_lines, pa.int64()), pa.array(n_cut, pa.int64()), columns[-1]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return out.mapInArrow(finish, schema)
