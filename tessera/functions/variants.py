"""Query variants of a name: rules in order, each applied to the original name, then distinct and cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Fixed values: (when the name contains, replace, by), in the order of emission.
BRIDGES = [
    ("유사암(4대)", [("유사암(4대)", "4대유사암")]),
    ("유사암(8대)", [("유사암(8대)", "8대유사암")]),
    ("유사암(4대)", [("유사암(4대)", "유사암")]),
    ("유사암(8대)", [("유사암(8대)", "유사암")]),
    ("4대유사암", [("4대유사암", "유사암(4대)"), ("4대유사암", "유사암")]),
    ("8대유사암", [("8대유사암", "유사암(8대)"), ("8대유사암", "유사암")]),
    ("통합암(4대유사암제외)", [("통합암(4대유사암제외)", "통합암"), ("통합암(4대유사암제외)", "4대유사암제외"), ("통합암(4대유사암제외)", "유사암제외")]),
    ("4대유사암제외", [("4대유사암제외", "유사암제외"), ("4대유사암제외", "유사암")]),
    ("4대특정암", [("4대특정암", "특정암")]),
]
# Long and short forms; the long one is tried first.
PAIRS = [("치료비", "치료"), ("입원일당", "입원"), ("수술비", "수술"), ("항암치료", "항암"), ("표적항암", "표적"), ("재진단암", "재진단")]


def swapped(c: Column, long: str, short: str) -> Column:
    return F.when(F.contains(c, F.lit(long)), F.replace(c, F.lit(long), F.lit(short))).when(F.contains(c, F.lit(short)), F.replace(c, F.lit(short), F.lit(long)))


def first_distinct(values: list[Column], limit: int) -> Column:
    return F.slice(text.distinct_in_order(F.array(*values)), 1, limit)


def short_rules(c: Column, limit: int = 4, suffixes=text.SUFFIXES, pair=("진단비", "진단")) -> Column:
    """The name, the name without its suffix, the swapped form, the name with single spaces."""
    return first_distinct([c, text.without_suffix(c, suffixes), swapped(c, *pair), text.collapsed(c)], limit)


def long_rules(c: Column, limit: int = 6) -> Column:
    """The long rule list; the cut comes last, so late rules often give nothing."""
    out = [c, text.without_suffix(c), swapped(c, "진단비", "진단")]
    for needle, changes in BRIDGES:
        out += [F.when(F.contains(c, F.lit(needle)), F.replace(c, F.lit(a), F.lit(b))) for a, b in changes]
    out += [swapped(c, *pair) for pair in PAIRS]
    brackets = F.contains(c, F.lit("(")) & F.contains(c, F.lit(")"))
    out += [F.when(brackets, text.without_bracket_groups(c)), F.when(brackets, text.without_bracket_chars(c))]
    return first_distinct(out + text.each_suffix_removed(c), limit)


RULES = {"short": short_rules, "long": long_rules}


def keywords(canonical: Column, raw: Column, matched: Column, rules: Column | None = None) -> Column:
    """What is searched for: [canonical, raw] of a matched name, else [raw]; with the variants of the named rule set, distinct over both."""
    base = F.when(matched & (F.coalesce(canonical, F.lit("")) != ""), F.array(canonical, raw)).otherwise(F.array(raw))
    out = text.distinct_in_order(base) if rules is not None else base

    def with_rule(rule) -> Column:
        return F.array_distinct(F.flatten(F.transform(base, lambda c: rule(c))))

    if rules is not None:
        for name, rule in RULES.items():
            out = F.when(rules == name, with_rule(rule)).otherwise(out)
    return out


RULE = "rule_set string, ord int, kind string, words array<string>, put string"


def rule_rows(name: str) -> list[tuple]:
    """The rows of a rule set: ``variant_rule(rule_set, ord, kind, words, put)``.

    Kinds: ``name``; ``suffix`` (the first of ``words`` that fits is cut off);
    ``cut`` (the one word, if the name ends in it); ``swap`` (word and ``put``
    change places); ``replace`` (a name with the first word: the last word by ``put``); ``spaces``; ``no_groups`` and ``no_brackets`` (of
    names with brackets); ``limit`` (``put`` variants at most).
    """
    if name == "short":
        rules = [("name", [], None), ("suffix", list(text.SUFFIXES), None), ("swap", ["진단비"], "진단"), ("spaces", [], None), ("limit", [], "4")]
    else:
        rules = [("name", [], None), ("suffix", list(text.SUFFIXES), None), ("swap", ["진단비"], "진단")]
        rules += [("replace", [needle, a], b) for needle, changes in BRIDGES for a, b in changes]
        rules += [("swap", [a], b) for a, b in PAIRS] + [("no_groups", [], None), ("no_brackets", [], None)]
        rules += [("cut", [s], None) for s in text.EACH_SUFFIX] + [("limit", [], "6")]
    return [(name, i, *rule) for i, rule in enumerate(rules)]


def rule_arrays(rules: DataFrame) -> DataFrame:
    """``rule_set, rules``: the rules of a set in order, one row for each set."""
    return rules.groupBy("rule_set").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "words", "put"))).alias("rules"))


def by_rules(name: Column, rules: Column) -> Column:
    """The variants of a name by an array of rules: each applied to the name itself, then distinct and cut. Without rules the name alone."""
    first = lambda r: F.get(r["words"], F.lit(0))
    less = lambda s: F.substring(name, F.lit(1), F.length(name) - F.length(s))
    brackets = F.contains(name, F.lit("(")) & F.contains(name, F.lit(")"))

    def applied(r: Column) -> Column:
        fits = F.get(F.filter(r["words"], lambda s: F.endswith(name, s)), F.lit(0))
        kind = r["kind"]
        return (
            F.when(kind == "name", name)
            .when(kind.isin("suffix", "cut"), F.when(fits.isNotNull(), less(fits)))
            .when(kind == "swap", F.when(F.contains(name, first(r)), F.replace(name, first(r), r["put"])).when(F.contains(name, r["put"]), F.replace(name, r["put"], first(r))))
            .when(kind == "replace", F.when(F.contains(name, first(r)), F.replace(name, F.element_at(r["words"], -1), r["put"])))
            .when(kind == "spaces", text.collapsed(name))
            .when((kind == "no_groups") & brackets, text.without_bracket_groups(name))
            .when((kind == "no_brackets") & brackets, text.without_bracket_chars(name))
        )

    limit = F.coalesce(F.array_max(F.transform(F.filter(rules, lambda r: r["kind"] == "limit"), lambda r: r["put"].cast("int"))), F.lit(1 << 30))
    found = F.slice(text.distinct_in_order(F.transform(F.filter(rules, lambda r: r["kind"] != "limit"), applied)), 1, limit)
    return F.coalesce(found, F.array(name))


def keywords_by_rules(canonical: Column, raw: Column, matched: Column, rules: Column) -> Column:
    """As ``keywords``, with the rules of a table: those of the row's set, null for none (the base names as they are)."""
    base = F.when(matched & (F.coalesce(canonical, F.lit("")) != ""), F.array(canonical, raw)).otherwise(F.array(raw))
    return F.when(rules.isNull(), base).otherwise(F.array_distinct(F.flatten(F.transform(text.distinct_in_order(base), lambda c: by_rules(c, rules)))))
