"""Benchmark decontamination with one Aho-Corasick automaton over normalised item windows.

Texts and items are lower-cased (A-Z only) and cut into words of digits, letters and any
non-ASCII character. A window is ``size`` consecutive words of an item, or the whole item if it
has fewer; items without words have none. All windows go into one automaton, and each text is
scanned once. Hits map back to words and to character offsets of the original text.

Defined cases: a null text has no words; an empty items table leaves all rows clean; an item
with a null id counts as the item with the empty id; repeated items count once; further columns
of the input pass through; repeated rows each keep their own result. A very long text is held
whole with its list of words, as one row of its own part.

The items travel to the executors. Their size is measured first: beyond ``block_bytes`` they are
dealt into blocks by a hash of the id, each block is scanned on its own and the hits are merged
by row, so that no broadcast outgrows the bound.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import LOWER, list_array, slices, stored, text_bytes, with_row

#: Separators (all ASCII but digits and letters) become spaces; A-Z become a-z. Lengths stay.
NORMAL = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER
)
_automata: dict[str, tuple] = {}


def item_words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(NORMAL).split()


def build(items: list[tuple[str, bytes | None]], size: int) -> tuple:
    """The automaton over all windows, and for each of its numbers the words and the items."""
    windows: dict[str, list] = {}
    for item, text in items:
        words = item_words(text)
        n = min(size, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            key = " " + b" ".join(words[at : at + n]).decode("latin-1") + " "
            windows.setdefault(key, [n, set()])[1].add(item)
    automaton = ahocorasick.Automaton()
    for number, key in enumerate(windows):
        automaton.add_word(key, number)
    if windows:
        automaton.make_automaton()
    return automaton if windows else None, list(windows.values())


def scan(text: bytes | None, automaton, windows: list) -> tuple[int, np.ndarray, set]:
    """Number of words, numbers of the hit words, items hit."""
    words = item_words(text)
    none = np.empty(0, np.int64)
    if automaton is None or not words:
        return len(words), none, set()
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = list(automaton.iter(line))
    if not found:
        return len(words), none, set()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1)  # where the space after each word is
    ends = np.searchsorted(stops, np.array([at for at, _ in found])) + 1
    sizes = np.array([windows[k][0] for _, k in found])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, ends - sizes, 1)
    np.add.at(change, ends, -1)
    return len(words), np.flatnonzero(np.cumsum(change[:-1]) > 0), set().union(*(windows[k][1] for _, k in found))


def original_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans, in the text as it is, of the runs of the words numbered ``hit``."""
    if not len(hit):
        return []
    cuts = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.append(0, cuts + 1)], hit[np.append(cuts, -1)]
    spaced = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20  # as long as the text
    turns = np.flatnonzero(np.diff(np.concatenate(([0], spaced, [0]))))
    out = []
    for a, b in zip(turns[0::2][first].tolist(), turns[1::2][last].tolist()):
        start = len(text[:a].decode("utf-8", "replace"))
        out.append((start, start + len(text[a:b].decode("utf-8", "replace"))))
    return out


def _span_array(spans: list[list[tuple[int, int]]]) -> pa.ListArray:
    pairs = np.array([p for s in spans for p in s], np.int32).reshape(-1, 2)
    return list_array([len(s) for s in spans], pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["start", "end"]))


def _scanner(shared, size: int, key: str, text_at: str, schema: pa.Schema):
    def run(batches):
        if key not in _automata:
            _automata.clear()
            _automata[key] = build(shared.value, size)
        automaton, windows = _automata[key]
        for batch in batches:
            for part in slices(batch):
                n_words, hit, items, n_items, spans = [], [], [], [], []
                for text in text_bytes(part.column(text_at)):
                    n, at, ids = scan(text, automaton, windows)
                    n_words.append(n)
                    hit.append(at)
                    items.extend(sorted(ids))
                    n_items.append(len(ids))
                    spans.append(original_spans(text, at))
                words = np.concatenate(hit).astype(np.int32) if hit else np.empty(0, np.int32)
                new = [pa.array(n_words, pa.int64()), list_array([len(x) for x in hit], pa.array(words)), list_array(n_items, pa.array(items, pa.string())), _span_array(spans)]
                kept = [part.column(x) for x in schema.names[: -len(new)]]
                yield pa.RecordBatch.from_arrays(kept + new, names=schema.names)

    return run


ADDED = "n_words long, hit_words array<int>, item_ids array<string>, spans array<struct<start:int,end:int>>"


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    share: int = 20,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``item_ids``, ``spans`` and ``contaminated``.

    ``spans`` are character offsets in the original text. A row is contaminated if any word is
    hit and ``share * n_hit >= n_words``. Columns of these names in ``docs`` are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    source = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("binary").alias("words")
    ).filter(F.col("words").isNotNull())
    total = source.agg(F.sum(F.length("words") + F.length("item")).alias("n")).first()["n"] or 0
    blocks = -(-int(total) // block_bytes) or 1
    own = ("n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated", "hit_words")
    base = docs.drop(*own)

    def hits(df: DataFrame, block: int) -> DataFrame:
        part = source.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = [(r["item"], bytes(r["words"])) for r in part.collect()]  # about block_bytes, by the count above
        schema = T.StructType(df.schema.fields + T._parse_datatype_string(ADDED).fields)
        shared = spark.sparkContext.broadcast(rows)
        return df.mapInArrow(_scanner(shared, size, f"{shared._jbroadcast.id()}-{spark.sparkContext.applicationId}", text, to_arrow_schema(schema)), schema)

    if blocks == 1:
        out = hits(base, 0)
    else:
        row = "_row"
        while row in base.columns:
            row += "_"
        base = stored(with_row(base, row), "rows")  # each block reads the same keys, whatever its splits
        few = base.select(row, text)
        each = [hits(few, b).drop(text) for b in range(blocks)]
        joined = each[0]
        for more in each[1:]:
            joined = joined.unionByName(more)
        flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  one list for each block
        merged = joined.groupBy(row).agg(F.max("n_words").alias("n_words"), flat("hit_words").alias("hit_words"), flat("item_ids").alias("item_ids"))
        both = base.join(merged, row).drop(row)
        schema = T.StructType(both.schema.fields + T._parse_datatype_string("spans array<struct<start:int,end:int>>").fields)
        names = to_arrow_schema(schema).names

        def locate(batches):
            for batch in batches:
                for part in slices(batch):
                    hit = [np.array(x, np.int64) for x in part.column("hit_words").to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns, _span_array([original_spans(t, h) for t, h in zip(text_bytes(part.column(text)), hit)])], names=names)

        out = both.mapInArrow(locate, schema)
    out = out.withColumns({"n_hit": F.size("hit_words").cast("long"), "n_items": F.size("item_ids").cast("long")})
    rule = (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", rule).drop("hit_words")
