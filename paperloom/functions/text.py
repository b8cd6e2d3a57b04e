"""Column expressions over page text: trimming, tokens, sentences, page ids, titles, prefixes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Korean particles taken off a token, longest first.
PARTICLES = ("에서는", "으로는", "에서", "으로", "에는", "부터", "까지", "처럼", "보다", "와", "과", "의", "은", "는", "이", "가", "을", "를", "에", "로", "도", "만")

# Fixed value: the sentence of an answer that found nothing.
ABSTAIN = "문서에서 찾을 수 없습니다"
# Fixed value: what marks a text as cut.
CUT_MARK = " …(생략)"
# Fixed value: the line between a page's text and its tables.
TABLE_MARK = "[표 구조]"

HANGUL = "가-힣"
PAGE_ID = "^([^\n]*)_([0-9]+)$"
PARTICLE_END = f"^([{HANGUL}]{{2,}}?)(?:{'|'.join(PARTICLES)})$"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(column: str) -> Column:
    """Search tokens: runs of digits, Latin letters and Hangul of the lower-cased text.

    A number with a Hangul unit gives itself and its digits. A longer Hangul run also gives its form
    without the longest particle, if two characters are left.
    """
    runs = f"regexp_extract_all(lower({column}), '([0-9a-z{HANGUL}]+)', 1)"
    parts = f"regexp_extract_all(r, '([0-9]+|[a-z]+|[{HANGUL}]+)', 1)"
    stem = f"regexp_extract(t, {_quoted(PARTICLE_END)}, 1)"
    split = f"flatten(transform({parts}, t -> CASE WHEN length(t) > 2 AND {stem} <> '' THEN array(t, {stem}) ELSE array(t) END))"
    unit = f"r RLIKE '^[0-9]+[{HANGUL}]+$'"
    whole = f"flatten(transform({runs}, r -> CASE WHEN {unit} THEN array(r, regexp_extract(r, '^([0-9]+)', 1)) ELSE {split} END))"
    # Without Hangul there is nothing to look into, so one call does.
    plain = f"regexp_extract_all(lower({column}), '([0-9]+|[a-z]+)', 1)"
    return F.coalesce(F.expr(f"CASE WHEN {column} RLIKE '[{HANGUL}]' THEN {whole} ELSE {plain} END"), F.array().cast("array<string>"))


#: ASCII letters in lower case and digits; a space for every other byte.
_PLAIN = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: First bytes of Hangul, and the other characters whose lower case has an ASCII letter (U+0130, U+212A).
_LOOK = re.compile(rb"[\xea-\xed]|\xc4\xb0|\xe2\x84\xaa")
_KINDS = re.compile(r"[0-9]+|[a-z]+")
_RUNS, _PARTS, _UNIT, _STEM = (re.compile(x) for x in (f"[0-9a-z{HANGUL}]+", f"[0-9]+|[a-z]+|[{HANGUL}]+", f"([0-9]+)[{HANGUL}]+", PARTICLE_END))


def _listed(raw: bytes) -> list[str]:
    """The ``tokens`` of one text."""
    out: list[str] = []
    for r in _RUNS.findall(raw.decode("utf-8", "replace").lower()):
        if unit := _UNIT.fullmatch(r):
            out += r, unit[1]
            continue
        for t in _PARTS.findall(r):
            out.append(t)
            if len(t) > 2 and (stem := _STEM.match(t)):
                out.append(stem[1])
    return out


def count_tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """How often UTF-8 texts have each of their ``tokens``: distinct words, and by row the entries' rows, words' places and counts.

    For many texts within a task: all are lower-cased and split at once, those with Hangul one by one.
    """
    look = [i for i, x in enumerate(texts) if not x.isascii() and _LOOK.search(x)]
    few = [_listed(texts[i]) for i in look]
    plain = list(texts)
    for i in look:
        plain[i] = b""
    at = np.concatenate(([0], np.cumsum([len(x) for x in plain]))).astype(np.int64)
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(plain), [None, pa.py_buffer(at), pa.py_buffer(b"".join(plain).translate(_PLAIN))]))
    coded = pa.concat_arrays([split.flatten().cast(pa.string()), pa.array([t for x in few for t in x], pa.string())]).dictionary_encode()
    row = np.concatenate((np.repeat(np.arange(len(plain)), pc.list_value_length(split).to_numpy()), np.repeat(np.array(look, np.int64), [len(x) for x in few])))
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    pure = pc.or_(pc.ascii_is_alpha(words), pc.ascii_is_decimal(words)).to_numpy(zero_copy_only=False)
    parts = {i: _KINDS.findall(w) for i in np.flatnonzero(~pure).tolist() if (w := words[i].as_py()).isascii()}  # none of an empty word
    if parts:
        whole = np.ones(len(words), bool)
        whole[list(parts)] = False
        more = pa.array([t for x in parts.values() for t in x], pa.string()).dictionary_encode()
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[list(parts)] = [len(x) for x in parts.values()]
        begin[list(parts)] = np.cumsum(size[list(parts)]) - size[list(parts)]
        cut, cut_row = codes[~whole[codes]], row[~whole[codes]]
        each = size[cut]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[cut], each)
        both = pa.concat_arrays([words, more.dictionary]).dictionary_encode()
        place = both.indices.to_numpy().astype(np.int64)
        codes, row = codes[whole[codes]], row[whole[codes]]
        codes = place[np.concatenate((codes, len(words) + more.indices.to_numpy().astype(np.int64)[inner]))]
        row, words = np.concatenate((row, np.repeat(cut_row, each))), both.dictionary
    key, n = np.unique(row * max(1, len(words)) + codes, return_counts=True)
    return words, key // max(1, len(words)), (key % max(1, len(words))).astype(np.int32), n


def lines(c: Column, most: int = -1) -> Column:
    """The lines of a text; with ``most``, the last of so many is the rest of the text."""
    return F.split(c, r"\R", most)


def doc_key(page_id: Column) -> Column:
    """The part of a page id before its number; null if it has none."""
    return F.when(page_id.rlike(PAGE_ID), F.regexp_extract(page_id, PAGE_ID, 1))


def page_no(page_id: Column) -> Column:
    """The number of a page id; null if it has none. A number of more than 38 digits is null, too (see ``page_order``)."""
    return F.when(page_id.rlike(PAGE_ID), F.regexp_extract(page_id, PAGE_ID, 2).try_cast("decimal(38,0)"))


def page_order(page_id: Column) -> Column:
    """Orders as the numbers of page ids do, whatever their size: digits without leading zeros, shorter ones first."""
    digits = F.regexp_replace(F.regexp_extract(page_id, PAGE_ID, 2), "^0+(?=.)", "")
    return F.struct(F.length(digits).alias("n"), digits.alias("digits"))


def title(page_id: Column) -> Column:
    """File name without the page number, 80 characters at most."""
    return F.substring(F.element_at(F.split(F.regexp_replace(page_id, r"_[0-9]+$", ""), "/"), -1), 1, 80)


def receipt(page_id: Column) -> Column:
    """The 14-digit number of a filing in its page id; null if there is none."""
    return F.nullif(F.regexp_extract(page_id, r"^dart/.+?_[0-9]{4}_([0-9]{14})_", 1), F.lit(""))


def prefix(page_id: Column, report: Column) -> Column:
    """What a page's document is called: ``[company] report`` of a filing, else the title."""
    company = F.nullif(F.regexp_extract(page_id, r"(\[[^\]]+\])", 1), F.lit(""))
    filing = F.nullif(F.concat_ws(" ", company, F.nullif(report, F.lit(""))), F.lit(""))
    return F.when(page_id.startswith("dart/"), F.coalesce(filing, title(page_id))).otherwise(title(page_id))


def safe_name(page_id: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(page_id, r"[^\p{L}\p{N}]", "_"), 1, 150), F.lit(".png"))


def with_tables(raw: Column, tables: Column) -> Column:
    return F.when(F.coalesce(tables, F.lit("")) == "", raw).otherwise(F.concat(raw, F.lit(f"\n\n{TABLE_MARK}\n"), tables))


def first_line(c: Column) -> Column:
    return lines(strip(c))[0]


def sentences(c: Column) -> Column:
    """Pieces that end after a full stop, question or exclamation mark, or line break; spaces after it go."""
    return F.split(c, r"(?<=[.!?\n])\s*")


def without_abstention(answer: Column, least: int = 40, phrase: str = ABSTAIN) -> Column:
    """An answer without the sentences that claim to have found nothing, if enough of it is left."""
    kept = strip(F.array_join(F.filter(sentences(answer), lambda s: ~s.contains(phrase)), ""))
    return F.when(answer.contains(phrase) & (F.length(kept) >= least), kept).otherwise(answer)


def degenerate(c: Column) -> Column:
    """Whether an output of eight characters or more is two characters or mostly one, repeated."""
    s = strip(c)
    kinds = F.array_distinct(F.filter(F.split(s, ""), lambda x: x != ""))
    top = F.array_max(F.transform(kinds, lambda k: F.length(s) - F.length(F.replace(s, k, F.lit("")))))
    return F.when(F.length(s) < 8, F.lit(False)).otherwise((F.size(kinds) <= 2) | (top / F.length(s) > 0.8))


def result_url(image_path: Column, root: str = "/pages/") -> Column:
    """Where the image of a result is served; null without one."""
    return F.when(F.coalesce(image_path, F.lit("")) != "", F.concat(F.lit(root), F.element_at(F.split(image_path, "/"), -1)))


def fitted(width: Column, height: Column, longest: int = 1280) -> Column:
    """The size of an image whose longer side has ``longest`` pixels at most, sides of at least one pixel."""
    scale = F.lit(float(longest)) / F.greatest(width, height)
    side = lambda x: F.when(F.greatest(width, height) <= longest, x.cast("long")).otherwise(F.greatest(F.bround(x * scale).cast("long"), F.lit(1)))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def encoded(content: Column) -> Column:
    """Base64 of an image, on one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def looks_like_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")
