"""String rules as Column functions. Each is one or two built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that a normalized form keeps.
NAME_CHARS = "가-힣a-zA-Z0-9"
SEARCH_CHARS = "가-힣a-zA-Z0-9()"
ANY_LETTERS = r"\p{L}0-9"  # for texts in other languages
# Suffixes of names, longest first; words that are no search tokens.
SUFFIXES = ("보장특약", "담보", "특약", "보장")
EACH_SUFFIX = ("담보", "보장", "특약", "갱신형", "비갱신형")
STOP_WORDS = ("비", "형", "담보", "보장", "특약", "갱신", "무배당", "갱신형", "비갱신형")


def normalized(c: Column, keep: str = NAME_CHARS) -> Column:
    """Lower case of the characters in ``keep`` alone."""
    return F.lower(F.regexp_replace(c, f"[^{keep}]", ""))


def mapping_form(c: Column) -> Column:
    return normalized(c, NAME_CHARS)


def search_form(c: Column, keep: str = SEARCH_CHARS) -> Column:
    return normalized(c, keep)


def search_lines(c: Column, keep: str = SEARCH_CHARS) -> Column:
    """The search form of every line of a text, lines kept apart."""
    return F.lower(F.regexp_replace(c, f"[^{keep}\\n]", ""))


def without_space(c: Column) -> Column:
    """Unicode white space removed (plain ``\\s`` misses the wide and the no-break space)."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def without_suffix(c: Column, suffixes=SUFFIXES) -> Column:
    """One suffix removed, the first of ``suffixes`` that fits; null if none does."""
    out = F.lit(None).cast("string")
    for s in reversed(suffixes):
        out = F.when(c.endswith(s), F.substring(c, F.lit(1), F.length(c) - len(s))).otherwise(out)
    return out


def each_suffix_removed(c: Column, suffixes=EACH_SUFFIX) -> list[Column]:
    return [F.when(c.endswith(s), F.substring(c, F.lit(1), F.length(c) - len(s))) for s in suffixes]


def without_bracket_groups(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)", "")


def without_bracket_chars(c: Column) -> Column:
    return F.regexp_replace(c, "[()]", "")


def core_tokens(c: Column, token: str = "[가-힣]{2,}", stop=STOP_WORDS) -> Column:
    """Tokens outside brackets that are no stop words, in order, repeats kept."""
    found = F.regexp_extract_all(without_bracket_chars(without_bracket_groups(c)), F.lit(token), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def token_label(tokens: Column) -> Column:
    return F.concat(F.lit("token_and("), F.array_join(F.slice(tokens, 1, 2), ","), F.lit(")"))


def tokens_in(line: Column, tokens: Column) -> Column:
    """How many of the tokens occur in the raw line."""
    return F.size(F.filter(tokens, lambda t: F.contains(line, t)))


def any_of(c: Column, words) -> Column:
    """Whether one of the words occurs, as text."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def around(lines: Column, i: Column, k: int | Column, limit: int | None = None) -> Column:
    """Lines i-k..i+k (from 0) joined and stripped; at most ``limit`` code points."""
    k = F.lit(k) if isinstance(k, int) else k
    first = F.greatest(i - k, F.lit(0))
    last = F.least(i + k + 1, F.size(lines))
    out = stripped(F.array_join(F.slice(lines, (first + 1).cast("int"), (last - first).cast("int")), "\n"))
    return F.substring(out, 1, limit) if limit else out


def preview(c: Column, n: int = 100, always: bool = False) -> Column:
    """First ``n`` code points and dots: always, or only for a longer text."""
    short = F.concat(F.substring(c, 1, n), F.lit("..."))
    return short if always else F.when(F.length(c) > n, short).otherwise(c)


def reference(doc_type: Column, page: Column) -> Column:
    return F.concat(doc_type, F.lit(" p."), page.cast("string"))


def joined_or_dash(values: Column, separator: str = ", ") -> Column:
    return F.coalesce(F.nullif(F.array_join(values, separator), F.lit("")), F.lit("-"))


def distinct_in_order(values: Column) -> Column:
    """First-seen distinct values without nulls."""
    return F.array_distinct(F.array_compact(values))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
