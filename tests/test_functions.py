import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import sections as S
from paperloom.functions import text as X


def column(spark, values, *exprs, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in df.select("i", *exprs).orderBy("i").collect()]


def plain_tokens(text):
    out = []
    for run in re.findall("[0-9a-z가-힣]+", text.lower()):
        if re.fullmatch("[0-9]+[가-힣]+", run):
            out += [run, re.match("[0-9]+", run)[0]]
            continue
        for t in re.findall("[0-9]+|[a-z]+|[가-힣]+", run):
            out.append(t)
            ends = [p for p in X.PARTICLES if t.endswith(p) and len(t) - len(p) >= 2]
            if len(t) > 2 and t[0] >= "가" and ends:
                out.append(t[: -len(max(ends, key=len))])
    return out


def test_tokens(spark):
    values = ["2023년", "삼성전자는 성장", "나는", "abc12한국에서는x", "café noir", "", None, "서울에서 부산까지"]
    got = column(spark, values, X.tokens("x"))
    assert got[:5] == [["2023년", "2023"], ["삼성전자는", "삼성전자", "성장"], ["나는"], plain_tokens(values[3]), ["caf", "noir"]]
    assert got[5] == [] and got[6] == [] and got[7] == ["서울에서", "서울", "부산까지", "부산"]


def test_tokens_on_random_strings(spark):
    import random

    rng = random.Random(1)
    values = ["".join(rng.choice("가나다은는에서부터으로12a b.é") for _ in range(rng.randrange(30))) for _ in range(800)]
    assert column(spark, values, X.tokens("x")) == [plain_tokens(v) for v in values]


def test_strip_and_ids(spark):
    assert column(spark, ["　a ", " \n", "b"], X.strip(F.col("x"))) == ["a", "", "b"]
    got = column(spark, ["a/b_211", "no_suffix", "a_b_c_7", "x y+z_3", "plain"], X.doc_key(F.col("x")), X.page_no(F.col("x")))
    assert got == [("a/b", 211), (None, None), ("a_b_c", 7), ("x y+z", 3), (None, None)]
    assert column(spark, ["p/q/" + "t" * 90 + "_12"], X.title(F.col("x"))) == ["t" * 80]
    assert column(spark, ["가/b c_1"], X.safe_name(F.col("x"))) == ["가_b_c_1.png"]


def test_prefixes(spark):
    ids = ["pub/report_3", "dart/Corp_2023_20230307000001_[Corp]x_1", "dart/Corp_2023_20230307000002_[Corp]x_1", "dart/plain_1"]
    df = spark.createDataFrame([(i, "Annual (2022.12)" if k == 1 else None) for k, i in enumerate(ids)], "id string, report string")
    rows = df.select("id", X.prefix(F.col("id"), F.col("report")).alias("p"), X.receipt(F.col("id")).alias("r")).collect()
    assert [r.p for r in rows] == ["report", "[Corp] Annual (2022.12)", "[Corp]", "plain"]
    assert rows[1].r == "20230307000001" and rows[3].r is None


LONG = "x" * 219


@pytest.mark.parametrize(
    "text, route, want",
    [
        ("연구 보고서 표지", "image", True), ("PART 3\n<그림 1> 흐름", "image", False), ("a | b\n| 1 | 2 |", "image", False), ("총 30명을 조사", "image", False),
        ("1. 개요\n2. 범위\n3. 방법\n" + "y" * 300, "image", True), (LONG, "image", True), (LONG + "x", "image", False), ("a..... 1\nb..... 2", "text", False),
        ("a..... 1\nb..... 2\nc..... 3", "text", True), (" \n　", "text", True), ("제 2 장 서론 " + "z" * 300, "image", True), ("short", "text", False), ("표지", "image_overflow", False),
    ],
)
def test_no_content(spark, text, route, want):
    assert column(spark, [text], S.no_content(F.col("x"), F.lit(route))) == [want]


def test_section_title(spark):
    texts = ["제 1 장 서론\n본문", "a\nb\n\nIV. 결론", "a\nb\nc\nd\n제 1 장", "## 3. 방법", "PART 2 " + "t" * 80, "nothing", ""]
    assert column(spark, texts, S.section_title(F.col("x"))) == ["제 1 장 서론", "IV. 결론", None, "3. 방법", ("PART 2 " + "t" * 80)[:60], None, None]


def test_abstention(spark):
    body = "The report says that emissions fell by a third. "
    values = [body + "\n" + X.ABSTAIN, body + X.ABSTAIN + ".", X.ABSTAIN + ".", "Short. " + X.ABSTAIN, body]
    assert column(spark, values, X.without_abstention(F.col("x"))) == [body.strip(), body.strip(), values[2], values[3], body]


def test_degenerate(spark):
    values = ["@" * 31, "abababab", "A plain sentence here.", "@" * 7, "a" * 40 + "bcd", ""]
    assert column(spark, values, X.degenerate(F.col("x"))) == [True, True, False, False, True, False]


def test_tables_and_lines(spark):
    assert column(spark, ["| a |", "", None], X.with_tables(F.lit("raw"), F.col("x"))) == [f"raw\n\n{X.TABLE_MARK}\n| a |", "raw", "raw"]
    assert column(spark, ["\n what?\nmore"], X.first_line(F.col("x"))) == ["what?"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ab.!?\n ", max_size=20), min_size=1, max_size=30))
def test_sentences(values):
    from paperloom.session import local_session

    spark = local_session()
    got = column(spark, values, X.sentences(F.col("x")))
    assert ["".join(p) for p in got] == ["".join(re.split(r"(?<=[.!?\n])\s*", v)) for v in values]
