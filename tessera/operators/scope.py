"""Scope: the list of coverages, extracted from proposal text and used as a gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class Rules:
    """A rule set of the extractor. Fixed values."""

    triggers: tuple = ("순번", "담보명", "보장명", "가입담보")
    indicators: tuple = ("보험료", "가입금액", "납기")
    window: int = 59
    terminators: tuple = ("보장보험료", "합계", "※")
    skipped: tuple = ("(기본)", "기본계약")
    name_columns: tuple = ("담보명", "보장명")
    header_rows: int = 2
    excluded: tuple = ("합계", "보험료", "광화문", "준법감시", "설계번호", "피보험자", "구분", "담 보", "담보 명", "가입금액", "☞", "※", "▶")
    headerless: bool = False
    amount: str = field(default=r"\s+\d+[만천백억,원]+")


PLAIN = Rules()
HARDENED = Rules(
    triggers=(*PLAIN.triggers, "보장내용", "특약명"),
    indicators=(*PLAIN.indicators, "만기"),
    window=79,
    terminators=("보장보험료", "합계", "총액", "계", "주계약", "※", "▶", "☞"),
    skipped=(*PLAIN.skipped, "주계약"),
    name_columns=("담보명", "보장명", "특약명", "보장내용"),
    header_rows=3,
    excluded=(*PLAIN.excluded, "계약자", "납입", "발행일"),
    headerless=True,
)
ENOUGH = 30  # names that a proposal must give


def page_lines(pages: DataFrame, by: list[str], column: str = "text") -> DataFrame:
    """``by`` with ``i`` (from 0) and ``line``."""
    return pages.select(*by, F.posexplode(text.lines_of(F.col(column))).alias("i", "line"))


def window_lines(pages: DataFrame, by: list[str], rules: Rules = PLAIN, column: str = "text") -> DataFrame:
    """``by, header, i, line``: the lines below a header line, up to ``rules.window`` of them or the first blank or terminating line.

    A header holds a trigger and an indicator. The window is cut from the
    page's own line array, so no join of lines with lines is needed.
    """
    lines = text.lines_of(F.col(column))
    pages = pages.select(*by, lines.alias("lines"))
    is_header = lambda line: text.any_of(line, rules.triggers) & text.any_of(line, rules.indicators)
    stops = lambda line: (text.stripped(line) == "") | text.any_of(line, rules.terminators)
    headers = pages.select("*", F.posexplode("lines").alias("header", "head")).where(is_header(F.col("head")))
    below = F.slice("lines", F.col("header") + 2, F.lit(rules.window))
    flags = F.transform("below", stops)
    headers = headers.withColumn("below", below).withColumn("stop", F.array_position(flags, True))
    used = F.when(F.col("stop") > 0, F.slice("below", F.lit(1), (F.col("stop") - 1).cast("int"))).otherwise(F.col("below"))
    return headers.select(*by, "header", F.posexplode(used).alias("k", "line")).select(*by, "header", (F.col("header") + 1 + F.col("k")).alias("i"), "line")


def numbered_name(line: Column, amount: str = PLAIN.amount) -> Column:
    """The name in a numbered row: ``3. name 1,000만원`` before ``3 name ...``; null without either."""
    line = text.stripped(line)
    dotted = F.regexp_extract(line, r"^(\d+)\.\s*(.+)", 2)
    spaced = F.regexp_extract(line, r"^(\d+)\s+(.+)", 2)
    first = F.split(text.stripped(spaced), r"(?U)\s+", 2)[0]
    return F.coalesce(F.nullif(text.stripped(F.split(dotted, amount, 2)[0]), F.lit("")), F.nullif(first, F.lit("")))


def is_name(name: Column, rules: Rules = PLAIN) -> Column:
    return (F.length(name) >= 3) & ~name.rlike(r"^[\d,]") & ~name.isin(*rules.skipped)


def ordered_distinct(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def names_in_text(pages: DataFrame, by: list[str], rules: Rules = PLAIN) -> DataFrame:
    """``by, i, name`` of the numbered rows below headers."""
    rows = window_lines(pages, by, rules).select(*by, "i", numbered_name(F.col("line"), rules.amount).alias("name"))
    return rows.where(F.col("name").isNotNull() & is_name(F.col("name"), rules))


def names_in_tables(tables: DataFrame, by: list[str], rules: Rules = PLAIN) -> DataFrame:
    """``by, i, name`` from tables (``cells array<array<string>>``).

    A table counts with three rows or more whose first rows speak of coverages
    and of premiums; the column is the first whose header names coverages. With
    the hardened rules a table without header counts by the shape of its first row.
    """
    cells = F.col("cells")
    head = F.slice(cells, 1, rules.header_rows)
    joined = text.without_space(F.array_join(F.flatten(head), ""))
    named = lambda cell: text.any_of(F.coalesce(cell, F.lit("")), rules.name_columns)
    columns = F.transform(head, lambda row: F.array_position(F.transform(row, named), True))
    column = F.coalesce(F.get(F.filter(columns, lambda p: p > 0), F.lit(0)), F.lit(0))
    found = (F.size(cells) >= 3) & (F.contains(joined, F.lit("담보")) | F.contains(joined, F.lit("보장"))) & F.contains(joined, F.lit("보험료")) & (column > 0)
    first = F.get(cells, F.lit(0))
    bare = (F.size(first) >= 4) & (F.size(cells) > 3) & (F.length(F.get(first, F.lit(0))) > 5) & F.contains(F.get(first, F.lit(1)), F.lit("납")) & F.get(first, F.lit(3)).rlike(r"^\d")
    start = F.when(found, F.lit(2))
    if rules.headerless:
        start = F.coalesce(start, F.when(bare, F.lit(0)))
    rows = tables.select(*by, cells, F.when(found, column).otherwise(F.lit(1)).alias("col"), start.alias("start")).where("start is not null")
    rows = rows.select(*by, "col", F.posexplode(F.slice("cells", F.col("start") + 1, F.size("cells"))).alias("i", "row"))
    name = text.stripped(F.get("row", (F.col("col") - 1).cast("int")))
    rows = rows.select(*by, "i", name.alias("name")).where((F.length("name") >= 3) & ~F.col("name").rlike(r"^[\d,]"))
    return rows.where(~text.any_of(F.col("name"), rules.excluded))


def declared_count(pages: DataFrame, by: list[str], page: str = "page", most: int = 10) -> DataFrame:
    """``by, declared``: the number of coverages that the first pages state, by the first pattern on the first page that has one."""
    t = F.col("text")
    one = F.nullif(F.regexp_extract(t, r"총\s*(\d+)\s*개", 1), F.lit("")).cast("int")

    def two(pattern: str) -> Column:
        a, b = (F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).cast("int") for g in (1, 2))
        return a + b

    value = F.coalesce(one, two(r"(?s)기본계약\s*(\d+)\s*개.*?특약\s*(\d+)\s*개"), two(r"대상계약\s*(\d+)\s*개\s*(\d+)\s*개"))
    found = pages.where(F.col(page) <= most).select(*by, F.col(page).alias("page"), value.alias("declared")).where("declared is not null")
    return found.groupBy(*by).agg(F.min_by("declared", "page").alias("declared"))


def with_hardening(plain: DataFrame, hardened: DataFrame, by: list[str], enough: int = ENOUGH) -> DataFrame:
    """For each of ``by`` the plain names, or the hardened ones where the plain are fewer than ``enough``; ``quality`` says OK or FAIL."""
    count = plain.groupBy(*by).agg(F.count("*").alias("n_plain"))
    keys = plain.select(*by).union(hardened.select(*by)).distinct().join(count, by, "left").select(*by, (F.coalesce("n_plain", F.lit(0)) >= enough).alias("ok"))
    out = plain.join(keys.where("ok"), by, "left_semi").unionByName(hardened.join(keys.where("not ok"), by, "left_semi"))
    quality = out.groupBy(*by).agg(F.when(F.count("*") >= enough, "OK").otherwise("FAIL").alias("quality"))
    return out.join(quality, by)


# The gate.


def in_scope(rows: DataFrame, scope: DataFrame, name: str = "name", scope_name: str = "name") -> DataFrame:
    """Rows whose stripped name is in the scope."""
    keys = scope.select(text.stripped(F.col(scope_name)).alias("__key")).where("__key <> ''").distinct()
    return rows.join(keys, text.stripped(F.col(name)) == F.col("__key"), "left_semi")


def out_of_scope(rows: DataFrame, scope: DataFrame, name: str = "name", scope_name: str = "name") -> DataFrame:
    keys = scope.select(text.stripped(F.col(scope_name)).alias("__key")).where("__key <> ''").distinct()
    return rows.join(keys, text.stripped(F.col(name)) == F.col("__key"), "left_anti")


def validate(rows: DataFrame, scope: DataFrame, name: str = "name", raise_error: bool = True) -> bool:
    """Whether every name is in scope; raises ValueError with one offender otherwise, if asked to."""
    bad = out_of_scope(rows, scope, name).select(name).first()
    if bad and raise_error:
        raise ValueError(f"not in scope: {bad[0]}")
    return bad is None


def scope_info(scope: DataFrame, name: str = "name") -> dict:
    keys = scope.select(text.stripped(F.col(name)).alias("name")).where("name <> ''").distinct()
    return {"count": keys.count(), "names": keys}
