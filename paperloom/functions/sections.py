"""Column predicates for pages without content and for section titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import lines, strip

# Signals in page text, as Java patterns with Unicode classes.
DOT_LEADER = r"(?U)\.{5,}\s*\d+"
DATA_SIGNAL = r"(?U)<그림|<표|표\s*:|\d{1,3}(?:[,.]\d+)*\s*(?:%|원|건|명|㎥|억|만|점|개|톤|kg|km|억원|만원)"
TABLE_ROW = r"\|[^\n]*\|[^\n]*\|"
DIVIDER_SIGNAL = r"(?imuU)PART\s*\d+|^\s*제\s*\d+\s*[장부편]|^\s*[IVXLCM]{1,4}\s*[.\)]|다른\s*내용이\s*없습니다|표지(?:입니다|로 보입니다|를 나타)|cover page"
NUMBERED_ITEM = r"(?U)^(?:#+\s*)?-?\s*\d+\.\s+\S"
SECTION_MARK = r"(?U)^(?:제\s*\d+\s*[장절편부]|[IVXLCM]{1,4}\s*[.\)]|\d{1,2}\.\s*[가-힣A-Za-z]|PART\s*\d+)"
# The same in a line that isn't stripped: a mark ends in what is no space.
MARKED_LINE = r"(?U)^\s*#*\s*" + SECTION_MARK.removeprefix("(?U)^")


def no_content(text: Column, route: Column) -> Column:
    """Whether a page is a cover, divider or table of contents. The first rule that applies decides."""
    stripped = strip(text)
    filled = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    numbered = F.size(F.filter(filled, lambda x: x.rlike(NUMBERED_ITEM)))
    return (
        F.when(F.coalesce(stripped, F.lit("")) == "", True)
        .when(F.regexp_count(text, F.lit(DOT_LEADER)) >= 3, True)
        .when(F.coalesce(route, F.lit("")) != "image", False)
        .when(text.rlike(DATA_SIGNAL), False)
        .when(text.rlike(TABLE_ROW), False)
        .when(text.rlike(DIVIDER_SIGNAL), True)
        .when((numbered >= 2) & (F.size(filled) <= 20), True)
        .otherwise(F.length(stripped) < 220)
    )


def section_title(text: Column) -> Column:
    """The first of a page's first four lines that starts a section, 60 characters at most; else null."""
    clean = lambda x: strip(F.regexp_replace(strip(x), "^#+", ""))
    hits = F.filter(F.slice(lines(text, 5), 1, 4), lambda x: x.rlike(MARKED_LINE))  # only what starts a section is cleaned, lines may be long
    return F.substring(clean(F.get(hits, 0)), 1, 60)
