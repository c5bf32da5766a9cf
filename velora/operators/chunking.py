"""Split a paged text into chunks for retrieval."""

from __future__ import annotations

import re
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from velora.functions.text import SPACE, strip
from velora.functions.vector import let
from velora.operators.corpus import numbered

#: Line patterns of the paged source, on lines without white space at their ends.
BOOK_TITLE = r"^(한국수어|문법)$"
CHAPTER = rf"^제[{SPACE}]*(\d+)[{SPACE}]*장[{SPACE}]*-[{SPACE}]*(\d+)$"
PAGE_NUMBER = r"^\d{1,3}$"
FOOTNOTE = rf"^\d{{1,3}}\)[{SPACE}]"
DOTS = r"[·]{3,}"
SECTION = r"^\s*(\d+(?:\.\d+)*\.?)\s+(\S.*)$"
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=다\.)\s*")
#: Weight of header lines that are looked at, lines of a footer, lines a section's name may follow in, its longest.
HEADER_WEIGHT, FOOTER_LINES, NAME_WITHIN, NAME_LONGEST = 6, 4, 3, 20
MIN_CHARS, MAX_CHARS, SHORTEST_CHUNK, SHORTEST_PAGE, FIRST_PAGE = 200, 600, 80, 40, 14


def clean_page(page: Column) -> Column:
    """struct(text, chapter, section) of one page: header lines, page numbers, footnotes and dotted lines go.

    Lines are sorted into classes first; the header is then the longest run of blank, title and chapter lines before which the weights of
    titles (1) and chapters (2) stay below HEADER_WEIGHT, and everything else follows from places in that run.
    """
    lines = F.transform(F.split(page, "\n", -1), strip)
    weigh = lambda s: F.when(s == "", 0).when(s.rlike(BOOK_TITLE), 1).when(s.rlike(CHAPTER), 2)  # noqa: E731  null: no line of a header

    def header(own: Column) -> Column:
        """How many lines the header has."""
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("weight"), F.lit(True).alias("goes_on"))

        def step(run: Column, w: Column) -> Column:
            goes_on = run.goes_on & w.isNotNull() & (run.weight < HEADER_WEIGHT)
            return F.struct((run.n + F.when(goes_on, 1).otherwise(0)).alias("n"), (run.weight + F.when(goes_on, w).otherwise(0)).alias("weight"), goes_on.alias("goes_on"))

        return F.aggregate(F.transform(own, weigh), begin, step, lambda run: run.n)

    def name_after(own: Column, k: Column) -> Column:
        """Where the name of the section stands that chapter line k announces; null if there is none."""
        follow = F.filter(F.sequence(k + 1, k + NAME_WITHIN), lambda j: F.coalesce(F.get(own, j), F.lit("")) != "")
        near = lambda j: F.get(own, j)
        return let(F.get(follow, F.lit(0)), lambda j: F.when((F.char_length(near(j)) <= NAME_LONGEST) & ~F.endswith(near(j), F.lit(".")), j))

    def parts(own: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), own.head - 1), lambda k: F.get(own.lines, k).rlike(CHAPTER))
        chapters = F.when(own.head > 0, F.transform(places, lambda k: F.struct(k.alias("at"), name_after(own.lines, k).alias("name")))).otherwise(F.array().cast("array<struct<at:int,name:int>>"))
        first_full = F.filter(F.sequence(F.lit(1), F.least(F.lit(FOOTER_LINES), F.size(own.lines))), lambda k: F.element_at(own.lines, -k) != "")
        foot = let(F.get(first_full, F.lit(0)), lambda k: F.when(F.element_at(own.lines, -k).rlike(PAGE_NUMBER), k).otherwise(0))
        return F.struct(own.lines.alias("lines"), own.head.alias("head"), chapters.alias("chapters"), F.coalesce(foot, F.lit(0)).alias("foot"))

    def cut(own: Column) -> Column:
        last = F.try_element_at(own.chapters, F.lit(-1))
        top = F.when(last.at == own.head - 1, F.coalesce(last["name"] + 1, own.head)).otherwise(own.head)  # the name ends a header that its chapter ends
        body = F.slice(own.lines, top + 1, F.greatest(F.size(own.lines) - own.foot - top, F.lit(0)))
        body = F.filter(F.transform(body, lambda s: F.regexp_replace(s, r"[ \t]+", " ")), lambda s: ~(s.rlike(PAGE_NUMBER) | s.rlike(FOOTNOTE) | s.rlike(DOTS)))
        text = strip(F.regexp_replace(F.array_join(body, "\n"), r"\n{3,}", "\n\n"))
        chapter = F.concat(F.lit("제"), F.regexp_extract(F.get(own.lines, last.at), CHAPTER, 1), F.lit("장"))
        named = F.try_element_at(F.filter(own.chapters, lambda c: c["name"].isNotNull()), F.lit(-1))
        return F.struct(text.alias("text"), F.coalesce(chapter, F.lit("")).alias("chapter"), F.coalesce(F.get(own.lines, named["name"]), F.lit("")).alias("section"))

    whole = let(F.coalesce(lines, F.array(F.lit(""))), lambda own: F.struct(own.alias("lines"), header(own).alias("head")))
    return let(let(whole, parts), cut)


def breaks(units: list[tuple[bool, int]], least: int, most: int) -> list[int]:
    """Places where a new chunk begins. units: (is it a whole paragraph, its length), of a sentence (is it its paragraph's first, its length)."""
    out, held = [], 0  # held: characters of the open chunk; 0: none is open
    for k, (kind, n) in enumerate(units):
        if kind == FIRST_SENTENCE:
            apart = True
        elif kind == SENTENCE:
            apart = held + n > most and held >= least
        else:
            apart = held + n + 1 > most
        joined = held + 1 + n if held and not apart else n
        if not held or apart:
            out.append(k)
        held = 0 if kind == PARAGRAPH and not apart and joined >= least else joined
    return out


#: Kinds of units.
PARAGRAPH, FIRST_SENTENCE, SENTENCE = range(3)


def merged(paragraphs: list[str], least: int = MIN_CHARS, most: int = MAX_CHARS) -> list[str]:
    """Short paragraphs joined by lines, long ones cut at sentence ends and joined by spaces. most is no hard limit: a paragraph without a sentence end stays whole.

    Break places are a fold over the lengths alone; the texts are put together once these are known.
    """
    units: list[tuple[int, str]] = []
    for p in paragraphs:
        p = p.strip()
        if len(p) <= most:
            units += [(PARAGRAPH, p)] if p else []
        else:
            sentences = [s for s in SENTENCE_END.split(p) if s and s.strip()]
            units += [(SENTENCE if k else FIRST_SENTENCE, s) for k, s in enumerate(sentences)]
    at = breaks([(kind, len(s)) for kind, s in units], least, most)
    glue = {PARAGRAPH: "\n", FIRST_SENTENCE: "", SENTENCE: " "}
    return ["".join((glue[kind] if k else "") + s for k, (kind, s) in enumerate(units[lo:hi])).strip() for lo, hi in pairwise([*at, len(units)])]


@F.pandas_udf(ArrayType(StringType()))
def merge_paragraphs(paragraphs: pd.Series) -> pd.Series:
    return paragraphs.map(lambda p: [] if p is None else merged(list(p)))


def pages_of(df: DataFrame, text: str = "value") -> DataFrame:
    """One row a page (page counted from 0) of texts with form feeds."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\f", -1)).alias("page", "raw"))


def chunks(pages: DataFrame, doc: str, first_page: int = FIRST_PAGE) -> DataFrame:
    """(doc, chunk, chapter, section, heading, page, text, n_chars), chunk counted from 0 in the order of documents, pages and paragraphs.

    pages: (doc, page from 0, raw). Chapter, section and heading carry on from page to page of a document.
    """
    p = pages.where(F.col("page") >= first_page).withColumn("c", clean_page(F.col("raw"))).select(doc, "page", "c.*")
    so_far = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.filter(F.split("text", "\n"), lambda x: x.rlike(SECTION) & (F.char_length(x) < 40))
    long = F.char_length("text") >= SHORTEST_PAGE
    for c in ("chapter", "section"):
        p = p.withColumn(c, F.coalesce(F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(so_far), F.lit("")))
    p = p.withColumn("heading", F.coalesce(F.last(F.when(long & (F.size(heads) > 0), F.element_at(heads, -1)), ignorenulls=True).over(so_far), F.lit(""))).where(long)
    body = F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(SECTION) & (F.char_length(x) < 40)))
    out = p.select(doc, "chapter", "section", F.trim("heading").alias("heading"), (F.col("page") + 1).alias("page"), F.posexplode(merge_paragraphs(body)).alias("k", "text")).where(F.char_length("text") >= SHORTEST_CHUNK)
    return numbered(out.withColumn("n_chars", F.char_length("text")), [doc, "page", "k"], "chunk", "g%05d").drop("k")
