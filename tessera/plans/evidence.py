"""Queries on evidence: search, ranking, cards, slots.

Binding: documents are pages (insurer = lang, document type by the source's
number, page = doc_id); words 6 to 13 of a benchmark text are a coverage's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cards, search, slots, triage
from ..sources.files import html_text as tags_removed
from .names import table

TYPES = search.TYPES
BY = ["insurer", "name"]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3
    doc_type = F.element_at(F.array(*map(F.lit, TYPES)), kind + 1)
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("insurer"), doc_type.alias("doc_type"), F.lit("documents").alias("file_path"), F.col("doc_id").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``insurer, name, item_id, phrase, keywords``: every phrase is looked for in every language; keywords are the phrase and its last five words."""
    words = F.split("text", " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words, 6, 8), " ").alias("phrase"), F.array_join(F.slice(words, 9, 5), " ").alias("tail"))
    langs = F.explode(F.array(*map(F.lit, ("de", "en", "es", "fr"))))
    return items.select(langs.alias("insurer"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), "item_id", "phrase", F.array("phrase", "tail").alias("keywords"))


def hits(spark: SparkSession, sf_dir: str, method: str | None = None) -> DataFrame:
    keywords = search.keyword_rows(phrases(spark, sf_dir), BY, text.ANY_LETTERS)
    return search.line_hits(pages(spark, sf_dir), keywords, ["insurer"], text.ANY_LETTERS, method)


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_hits(hits(spark, sf_dir), BY)


FORM = "lower(regexp_replace({}, '[^\\p{{L}}0-9]', '', 'g'))"
BASE_SQL = rf"""
items AS (SELECT item_id, 'item' || item_id AS name, array_to_string(string_split(text, ' ')[6:13], ' ') AS phrase, array_to_string(string_split(text, ' ')[9:13], ' ') AS tail FROM benchmark),
kw AS (SELECT name, kw_pos, keyword, {FORM.format('keyword')} AS form FROM (SELECT name, 0 AS kw_pos, phrase AS keyword FROM items UNION ALL SELECT name, 1, tail FROM items)),
ls AS (SELECT lang AS insurer, ['약관', '사업방법서', '상품요약서'][CAST(regexp_extract(source, '[0-9]+') AS INT) % 3 + 1] AS doc_type, doc_id AS page, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT insurer, doc_type, page, lines, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line FROM ls),
n AS (SELECT *, {FORM.format('line')} AS norm FROM l),
hit AS (SELECT insurer, name, doc_type, page, kw_pos, keyword, line_no, lines FROM n JOIN kw ON form <> '' AND contains(norm, form)),
top AS (SELECT *, row_number() OVER (PARTITION BY insurer, name, doc_type ORDER BY page, kw_pos, line_no) AS rank FROM hit QUALIFY rank <= 3),
snip AS (SELECT * EXCLUDE (lines), left(trim(array_to_string(lines[greatest(line_no - 2, 0) + 1 : least(line_no + 3, len(lines))], chr(10)), ' ' || chr(10) || chr(9) || chr(13)), 500) AS snippet FROM top)"""


def evidence_hits_top3(spark, sf_dir):
    return top(spark, sf_dir).select("insurer", "name", "doc_type", F.col("rank").cast("long").alias("rank"), F.col("page").cast("long").alias("page"), F.col("kw_pos").cast("long").alias("kw_pos"), F.col("line_no").cast("long").alias("line_no"))


def evidence_hits_by_grams(spark, sf_dir):
    """The same hits by the join on grams, for keyword sets too large to send; all of them, unranked."""
    return hits(spark, sf_dir, "grams").groupBy("insurer", "name", "doc_type").agg(F.count("*").alias("n_hits"), F.min("page").cast("long").alias("first_page"))


def evidence_snippet(spark, sf_dir):
    rows = top(spark, sf_dir)
    return rows.select("insurer", "name", "doc_type", F.col("rank").cast("long").alias("rank"), "snippet")


def hits_by_doc_type(spark, sf_dir):
    """A row for every phrase and language, also where nothing is found."""
    counts = search.counts_by_type(top(spark, sf_dir), BY)
    rows = phrases(spark, sf_dir).select(*BY).join(counts, BY, "left").na.fill(0, list(TYPES))
    return rows.select(*BY, F.col(f"`{TYPES[0]}`").alias("policy"), F.col(f"`{TYPES[1]}`").alias("method"), F.col(f"`{TYPES[2]}`").alias("summary"), search.policy_only().alias("policy_only"))


def token_and_fallback(spark, sf_dir):
    """Phrases that are found nowhere, searched by two tokens of six letters or more in a line."""
    missing = phrases(spark, sf_dir).join(top(spark, sf_dir).select(*BY).distinct(), BY, "left_anti")
    rows = search.top_hits(search.token_hits(pages(spark, sf_dir), missing, BY, ["insurer"], "phrase", r"[\p{L}]{6,}", ()), BY)
    return rows.select("insurer", "name", "doc_type", F.col("rank").cast("long").alias("rank"), F.col("page").cast("long").alias("page"), F.col("line_no").cast("long").alias("line_no"), "keyword")


def best_line_score(spark, sf_dir):
    rows = search.best_line(pages(spark, sf_dir), ["insurer", "doc_type"], ("th", "re", "an"), (",",), 4)
    return rows.select("insurer", "doc_type", F.col("page").cast("long").alias("page"), F.col("line_no").cast("long").alias("line_no"), F.col("score").cast("long").alias("score"))


def with_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ord", F.col("page").cast("long") * 1_000_000 + F.col("kw_pos") * 100_000 + F.col("line_no")).withColumnRenamed("keyword", "match_keyword")


def card_dedup(spark, sf_dir):
    rows = cards.first_of_equal(with_order(top(spark, sf_dir)), BY)
    return rows.select(*BY, "doc_type", F.col("page").cast("long").alias("page"), F.col("line_no").cast("long").alias("line_no"), F.col("kw_pos").cast("long").alias("kw_pos"))


def card_diverse3(spark, sf_dir):
    rows = cards.diverse(cards.first_of_equal(with_order(top(spark, sf_dir)), BY), BY)
    return rows.select(*BY, F.col("pick").cast("long").alias("pick"), "doc_type", F.col("page").cast("long").alias("page"), "snippet")


DEDUP_SQL = f"{BASE_SQL}, dedup AS (SELECT * FROM snip QUALIFY row_number() OVER (PARTITION BY insurer, name, doc_type, page, snippet ORDER BY kw_pos, line_no) = 1)"
DIVERSE_SQL = f"""{DEDUP_SQL},
idx AS (SELECT *, CASE doc_type WHEN '약관' THEN 0 WHEN '사업방법서' THEN 1 ELSE 2 END AS t, row_number() OVER (PARTITION BY insurer, name, doc_type ORDER BY page, snippet) AS r FROM dedup),
pick AS (SELECT *, row_number() OVER (PARTITION BY insurer, name ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, t, page, snippet) AS pick FROM idx QUALIFY pick <= 3)"""


def evidence_refs(spark, sf_dir):
    refs = slots.evidence_refs(top(spark, sf_dir), BY)
    return refs.select(*BY, F.array_join("refs", "; ").alias("refs"))


TALK = [("numbers", r"\d+", 1), ("questions", r"\?|what|how", 1), ("names", r"[a-z]{12,}", 2)]


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("ord"), F.col("role").alias("doc_type"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("snippet"))


def slot_extract(spark, sf_dir):
    rows = slots.slot_lines(turns(spark, sf_dir), ["conv_id"], TALK)
    return rows.select("conv_id", "ord", "slot", F.col("line_no").cast("long").alias("line_no"), "ref", F.length("context").cast("long").alias("n_chars"))


def slot_status(spark, sf_dir):
    rows = slots.profiles(turns(spark, sf_dir), ["conv_id"], TALK)
    return rows.select("conv_id", "slot", "status", "reason", F.size("refs").cast("long").alias("n_refs"), F.length("text").cast("long").alias("n_chars"))


def slot_unknowns(spark, sf_dir):
    return slots.unknown_counts(slots.profiles(turns(spark, sf_dir), ["conv_id"], TALK))


def slot_pivot(spark, sf_dir):
    rows = slots.profiles(turns(spark, sf_dir).withColumnRenamed("role", "insurer"), ["conv_id", "insurer"], TALK)
    counts = rows.groupBy("slot").pivot("insurer", ["assistant", "system", "user"]).agg(F.count_if(F.col("status") == "found"))
    return counts.na.fill(0)


def triage_flags(spark, sf_dir):
    rows = phrases(spark, sf_dir).select("insurer", F.col("phrase").alias("name"), F.element_at("keywords", 2).alias("canonical")).where("name <> ''")
    out = triage.flags(rows, pages(spark, sf_dir), ["insurer"], text.ANY_LETTERS)
    return out.select("insurer", "name", "raw_present", "canonical_present", F.col("page").cast("long").alias("page"))


def triage_snippets(spark, sf_dir):
    """Four names for each benchmark text (the last five of its words 6 to 13; with a suffix; with the longer term; with brackets) and their first lines by flag; one syllable of all texts stands for the term."""
    term = lambda c: F.replace(c, F.lit("the"), F.lit("진단"))
    p = term(F.element_at("keywords", 2))
    made = F.array(p, F.concat(p, F.lit(" 보장특약")), F.replace(p, F.lit("진단"), F.lit("진단비")), F.concat(p, F.lit(" (갱신형)")))
    rows = phrases(spark, sf_dir).select("insurer", F.explode(F.array_distinct(made)).alias("name"), term(F.col("phrase")).alias("canonical")).where("canonical <> ''").distinct()
    out = triage.snippets(rows, pages(spark, sf_dir).withColumn("text", term(F.col("text"))), ["insurer"], text.ANY_LETTERS)
    return out.select("insurer", "name", *[F.coalesce(F.col(f"{k}_snippet"), F.lit("-")).alias(k) for k in triage.FLAGS])


def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tags_removed(F.col("html")).alias("plain"))


def line_statistics(spark, sf_dir):
    lines = text.lines_of(F.col("text"))
    return pages(spark, sf_dir).groupBy("insurer", "doc_type").agg(F.count("*").alias("pages"), F.sum(F.size(lines)).alias("lines"), F.sum(F.length("text")).alias("chars"))


SLOT_SQL = """
t AS (SELECT conv_id, role, turn AS ord, role || ' p.' || turn AS ref, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
l AS (SELECT conv_id, role, ord, ref, lines, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line FROM t),
r AS (SELECT * FROM (VALUES ('numbers', '(?i)\\d+', 1), ('questions', '(?i)\\?|what|how', 1), ('names', '(?i)[a-z]{12,}', 2)) r(slot, pattern, k)),
h AS (SELECT conv_id, role, ord, slot, line_no, ref, trim(array_to_string(lines[greatest(line_no - k, 0) + 1 : least(line_no + k + 1, len(lines))], chr(10)), ' ' || chr(10) || chr(9) || chr(13)) AS context FROM l, r WHERE regexp_matches(line, pattern))""".replace("\\\\", "\\")

QUERIES = {f.__name__: f for f in (evidence_hits_top3, evidence_hits_by_grams, evidence_snippet, hits_by_doc_type, token_and_fallback, best_line_score, card_dedup, card_diverse3, evidence_refs, slot_extract, slot_status, slot_unknowns, slot_pivot, triage_flags, triage_snippets, html_text, line_statistics)}
ORACLE_SQL = {
    "evidence_hits_top3": f"WITH {BASE_SQL} SELECT insurer, name, doc_type, rank, page, kw_pos, line_no FROM top",
    "evidence_hits_by_grams": f"WITH {BASE_SQL} SELECT insurer, name, doc_type, count(*) AS n_hits, min(page) AS first_page FROM hit GROUP BY ALL",
    "evidence_snippet": f"WITH {BASE_SQL} SELECT insurer, name, doc_type, rank, snippet FROM snip",
    "hits_by_doc_type": f"""WITH {BASE_SQL}, c AS (SELECT insurer, name, count(*) FILTER (doc_type = '약관') AS policy, count(*) FILTER (doc_type = '사업방법서') AS method, count(*) FILTER (doc_type = '상품요약서') AS summary FROM top GROUP BY ALL)
        SELECT g.insurer, items.name, coalesce(policy, 0) AS policy, coalesce(method, 0) AS method, coalesce(summary, 0) AS summary, coalesce(policy, 0) >= 1 AND coalesce(method, 0) = 0 AND coalesce(summary, 0) = 0 AS policy_only
        FROM items CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr')) g(insurer) LEFT JOIN c ON c.insurer = g.insurer AND c.name = items.name""",
    "token_and_fallback": rf"""WITH {BASE_SQL}, m AS (SELECT g.insurer, items.name, regexp_extract_all(regexp_replace(regexp_replace(phrase, '\([^)]*\)', '', 'g'), '[()]', '', 'g'), '[\p{{L}}]{{6,}}') AS tokens FROM items CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr')) g(insurer)
            WHERE (g.insurer, items.name) NOT IN (SELECT (insurer, name) FROM top)),
        f AS (SELECT l.insurer, m.name, doc_type, page, line_no, 'token_and(' || array_to_string(tokens[1:2], ',') || ')' AS keyword FROM m JOIN l ON l.insurer = m.insurer WHERE len(tokens) >= 2 AND len(list_filter(tokens, lambda x: contains(l.line, x))) >= 2)
        SELECT insurer, name, doc_type, row_number() OVER (PARTITION BY insurer, name, doc_type ORDER BY page, line_no) AS rank, page, line_no, keyword FROM f QUALIFY rank <= 3""",
    "best_line_score": f"""WITH {BASE_SQL}, s AS (SELECT insurer, doc_type, page, line_no, 3 + contains(line, ',')::INT AS score FROM l WHERE contains(line, 'th') AND contains(line, 're') AND contains(line, 'an'))
        SELECT insurer, doc_type, page, line_no, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY insurer, doc_type ORDER BY score DESC, page, line_no) = 1""",
    "card_dedup": f"WITH {DEDUP_SQL} SELECT insurer, name, doc_type, page, line_no, kw_pos FROM dedup",
    "card_diverse3": f"WITH {DIVERSE_SQL} SELECT insurer, name, pick, doc_type, page, snippet FROM pick",
    "evidence_refs": f"WITH {BASE_SQL} SELECT insurer, name, string_agg(ref, '; ' ORDER BY ref) AS refs FROM (SELECT DISTINCT insurer, name, doc_type || ' p.' || page AS ref FROM top) GROUP BY ALL",
    "slot_extract": f"WITH {SLOT_SQL} SELECT conv_id, ord, slot, line_no, ref, length(context) AS n_chars FROM h",
    "slot_status": f"""WITH {SLOT_SQL}, c AS (SELECT conv_id, slot, context, min((ord, line_no)) AS o FROM h GROUP BY ALL),
        x AS (SELECT conv_id, slot, string_agg(context, ' | ' ORDER BY o) AS text FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, slot ORDER BY o) <= 3) GROUP BY ALL),
        f AS (SELECT conv_id, slot, count(DISTINCT ref) AS n_refs FROM h GROUP BY ALL)
        SELECT k.conv_id, r.slot, CASE WHEN n_refs IS NULL THEN 'unknown' ELSE 'found' END AS status, CASE WHEN n_refs IS NULL THEN 'no evidence lines matched regex' END AS reason, coalesce(n_refs, 0) AS n_refs, length(text) AS n_chars
        FROM (SELECT DISTINCT conv_id FROM conversations) k CROSS JOIN r LEFT JOIN f ON f.conv_id = k.conv_id AND f.slot = r.slot LEFT JOIN x ON x.conv_id = k.conv_id AND x.slot = r.slot""",
    "slot_unknowns": f"""WITH {SLOT_SQL}, f AS (SELECT DISTINCT conv_id, slot FROM h)
        SELECT r.slot, count(*) AS insurers, count(*) FILTER (f.conv_id IS NULL) AS unknown FROM (SELECT DISTINCT conv_id FROM conversations) k CROSS JOIN r LEFT JOIN f ON f.conv_id = k.conv_id AND f.slot = r.slot GROUP BY r.slot""",
    "slot_pivot": f"""WITH {SLOT_SQL}, f AS (SELECT DISTINCT conv_id, role, slot FROM h)
        SELECT r.slot, count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system, count(*) FILTER (role = 'user') AS user FROM r LEFT JOIN f ON f.slot = r.slot GROUP BY r.slot""",
    "triage_flags": f"""WITH {BASE_SQL}, c AS (SELECT g.insurer, phrase, tail, {FORM.format('phrase')} AS a, {FORM.format('tail')} AS b FROM items CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr')) g(insurer) WHERE phrase <> ''),
        f AS (SELECT c.insurer, phrase, bool_or(a <> '' AND contains(norm, a)) AS ra, bool_or(b <> '' AND contains(norm, b)) AS rb, min(page) AS page FROM c JOIN n ON n.insurer = c.insurer AND (a <> '' AND contains(norm, a) OR b <> '' AND contains(norm, b)) GROUP BY ALL)
        SELECT DISTINCT c.insurer, c.phrase AS name, coalesce(ra, false) AS raw_present, coalesce(rb, false) AS canonical_present, page FROM c LEFT JOIN f ON f.insurer = c.insurer AND f.phrase = c.phrase""",
    "triage_snippets": rf"""WITH {BASE_SQL}, p AS (SELECT DISTINCT insurer, page, line_no, replace(line, 'the', '진단') AS line, lower(regexp_replace(replace(line, 'the', '진단'), '[^\p{{L}}0-9]', '', 'g')) AS norm FROM l),
        i AS (SELECT replace(phrase, 'the', '진단') AS canonical, replace(tail, 'the', '진단') AS t FROM items WHERE phrase <> ''),
        c AS (SELECT DISTINCT name, canonical FROM (SELECT t AS name, canonical FROM i UNION ALL SELECT t || ' 보장특약', canonical FROM i UNION ALL SELECT replace(t, '진단', '진단비'), canonical FROM i UNION ALL SELECT t || ' (갱신형)', canonical FROM i)),
        k AS (SELECT name, canonical, unnest(['raw_present', 'canonical_present', 'suffix_gap', 'term_gap', 'bracket_gap']) AS kind,
            unnest([name, canonical, CASE WHEN name LIKE '%보장특약' THEN left(name, length(name) - 4) END, CASE WHEN contains(name, '진단비') THEN replace(name, '진단비', '진단') WHEN contains(name, '진단') THEN replace(name, '진단', '진단비') END,
            CASE WHEN contains(name, '(') THEN regexp_replace(name, '\([^)]*\)', '', 'g') END]) AS value FROM c),
        w AS (SELECT name, kind, lower(regexp_replace(value, '[^\p{{L}}0-9]', '', 'g')) AS form FROM k WHERE value IS NOT NULL),
        h AS (SELECT insurer, name, kind, arg_min(trim(line, ' ' || chr(9) || chr(13)), (page, line_no)) AS snippet FROM p JOIN w ON form <> '' AND contains(norm, form) GROUP BY ALL),
        a AS (SELECT insurer, name, max(snippet) FILTER (kind = 'raw_present') AS raw_present, max(snippet) FILTER (kind = 'canonical_present') AS canonical_present, max(snippet) FILTER (kind = 'suffix_gap') AS suffix_gap, max(snippet) FILTER (kind = 'term_gap') AS term_gap, max(snippet) FILTER (kind = 'bracket_gap') AS bracket_gap FROM h GROUP BY ALL)
        SELECT g.insurer, c.name, coalesce(left(raw_present, 500), '-') AS raw_present, coalesce(left(canonical_present, 500), '-') AS canonical_present, coalesce(left(suffix_gap, 500), '-') AS suffix_gap, coalesce(left(term_gap, 500), '-') AS term_gap, coalesce(left(bracket_gap, 500), '-') AS bracket_gap
        FROM c CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr')) g(insurer) LEFT JOIN a ON a.insurer = g.insurer AND a.name = c.name""",
    "html_text": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS plain FROM pages",
    "line_statistics": f"WITH {BASE_SQL} SELECT insurer, doc_type, count(*) AS pages, sum(len(lines))::BIGINT AS lines, sum(length(array_to_string(lines, chr(10))))::BIGINT AS chars FROM ls GROUP BY ALL",
}
