"""Evidence search: keywords in page lines, ranked per document type, with line context.

Pages stay whole until a keyword is known to be on them: one pass over the search
form of a page (lines kept apart) gives the keywords' forms that it holds, and
only those are joined with keywords, by equality; only pages that match are
opened into lines. So the work is that of the pages, not of pages times keywords.
A snippet is a slice of the page's own line array.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import sizes, text

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

# Document types in order of priority, the type that is counted under another one, and limits.
POLICY, METHOD, SUMMARY, LEAFLET = "약관", "사업방법서", "상품요약서", "상품설명서"
TYPES = (POLICY, METHOD, SUMMARY)
PER_TYPE, CONTEXT, SNIPPET = 3, 2, 500
GRAM = 8  # characters: shorter forms are their own gram; a longer one's gram is its beginning, the greatest power of two of characters
GRAM_BITS = (22, 27)  # the filter of grams that pages get has 2**22 to 2**27 bits (16 MB); between, 64 to 128 for each gram, of which two are set
GRAM_BLOCK = 1 << 20  # characters that are hashed at once
KEYED_BYTES = 32 << 20  # keywords with grams that are broadcast, at most
GRAM_PLACES = ArrayType(StructType([StructField("size", IntegerType()), StructField("gram", LongType()), StructField("line_no", IntegerType()), StructField("pieces", ArrayType(StringType()))]))
PAGE = ["insurer", "doc_type", "file_path", "page"]


def type_priority(doc_type: Column) -> Column:
    return F.when(doc_type == POLICY, 1).when(doc_type == METHOD, 2).when(doc_type.isin(SUMMARY, LEAFLET), 3).otherwise(999)


def counted_type(doc_type: Column) -> Column:
    return F.when(doc_type == LEAFLET, SUMMARY).otherwise(doc_type)


def keyword_rows(coverages: DataFrame, by: list[str], keep: str = text.SEARCH_CHARS) -> DataFrame:
    """``by, kw_pos, keyword, form`` of the keyword arrays. A keyword without a search form would match every line; it is left out."""
    rows = coverages.select(*by, F.posexplode("keywords").alias("kw_pos", "keyword"))
    return rows.withColumn("form", text.search_form(F.col("keyword"), keep)).where("form <> ''")


SLICE = 64  # rows that a task holds as Python strings at once


def slices(batches):
    """Arrow batches in parts of at most SLICE rows: a batch of long texts is never all strings, or copied, at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def with_found(frame: DataFrame, column: str, values: list[str], name: str) -> DataFrame:
    """``frame`` with ``name``, the distinct ``values`` (counted ones) that occur in the text column; rows without any are left out.

    One pass over each text by an automaton of all values.
    """
    shared = frame.sparkSession.sparkContext.broadcast(values)
    at = frame.columns.index(column)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for value in shared.value:
            automaton.add_word(value, value)
        automaton.make_automaton()
        for batch in slices(batches):
            found = [sorted({value for _, value in automaton.iter(text)}) if text else [] for text in batch.column(at).to_pylist()] if len(automaton) else [[]] * batch.num_rows
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, name])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField(name, ArrayType(StringType()))]))


def with_places(frame: DataFrame, column: str, values: list[str], name: str) -> DataFrame:
    """``frame`` with ``name``, the distinct (``form``, ``line_no``) at which the ``values`` occur in the text column; rows without any are left out.

    One pass over each text by an automaton of all values; lines are found in the list of the text's line ends.
    """
    shared = frame.sparkSession.sparkContext.broadcast(values)
    at = frame.columns.index(column)
    kind = pa.list_(pa.struct([("form", pa.string()), ("line_no", pa.int32())]))

    def run(batches):
        import bisect

        import ahocorasick

        automaton = ahocorasick.Automaton()
        for value in shared.value:
            automaton.add_word(value, value)
        automaton.make_automaton()

        def places(text):
            met = list(automaton.iter(text)) if text and len(automaton) else []
            ends = [i for i, c in enumerate(text) if c == "\n"] if met else []
            return [{"form": form, "line_no": line} for form, line in sorted({(form, bisect.bisect_left(ends, last)) for last, form in met})]

        for batch in slices(batches):
            found = [places(text) for text in batch.column(at).to_pylist()]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    field = StructType([StructField("form", StringType()), StructField("line_no", IntegerType())])
    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField(name, ArrayType(field))]))


def gram_size(length: int) -> int:
    return length if length < GRAM else 1 << (length.bit_length() - 1)


def gram_hashes(string: str, lengths: list[int]):
    """For each of the ascending ``lengths`` the 64-bit hashes of all windows of so many characters, by their start. A window is two of a power of two, which may overlap."""

    def mixed(a, b):
        out = a * np.uint64(0x9E3779B97F4A7C15)
        out += b
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out

    hashes, width = np.frombuffer(string.encode("utf-32-le"), "<u4").astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1
    for length in lengths:
        while 2 * width <= length:
            hashes, width = mixed(hashes[:-width], hashes[width:]), 2 * width
        more = length - width
        yield length, mixed(hashes[:-more], hashes[more:]) if more else hashes


def gram_places(texts: list[str], lengths: list[int], bits: np.ndarray) -> list[list[dict]]:
    """For each text its places: a line and a gram that the filter lets pass, with what stands there, as far as a form of that gram may reach."""
    joined = "\n".join(texts)
    blocks = range(0, len(joined), GRAM_BLOCK)
    breaks = [np.flatnonzero(np.frombuffer(joined[at : at + GRAM_BLOCK].encode("utf-32-le"), "<u4") == 10) + at for at in blocks]
    ends = np.concatenate([*breaks, [len(joined)]]).astype(np.int64)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    first = np.searchsorted(ends, starts)  # the line in which a text begins
    bound = (len(bits) * 8).bit_length() - 1
    shift, low = np.uint64(64 - bound), np.uint64((1 << bound) - 1)

    def holds(slots):
        return np.flatnonzero(bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1)

    met: list[dict] = [{} for _ in texts]
    for at in blocks:
        for length, hashes in gram_hashes(joined[at : at + GRAM_BLOCK + lengths[-1] - 1], lengths):
            hashes = hashes[:GRAM_BLOCK]
            passed = holds(hashes >> shift)
            passed = passed[holds(hashes[passed] & low)]
            place = passed + at
            line = np.searchsorted(ends, place)
            inside = place + length <= ends[line]  # a gram never spans lines, since forms hold no line break
            passed, place, line = passed[inside], place[inside], line[inside]
            stop = np.minimum(place + (length if length < GRAM else 2 * length - 1), ends[line])
            number = np.searchsorted(starts, place, "right") - 1
            for i, row, gram, begin, end in zip(number.tolist(), (line - first[number]).tolist(), hashes[passed].view(np.int64).tolist(), place.tolist(), stop.tolist()):
                met[i].setdefault((row, length, gram), set()).add(joined[begin:end])
    return [[{"size": length, "gram": gram, "line_no": row, "pieces": sorted(pieces)} for (row, length, gram), pieces in sorted(found.items())] for found in met]


def with_gram(keywords: DataFrame) -> DataFrame:
    """``keywords`` with ``size`` and ``gram``, the length and the hash of the beginning by which a form is looked for."""
    at = keywords.columns.index("form")

    def run(batches):
        for batch in slices(batches):
            forms = batch.column(at).to_pylist()
            lengths = [gram_size(len(form)) for form in forms]
            grams = [next(gram_hashes(form[:n], [n]))[1].view(np.int64)[0] for form, n in zip(forms, lengths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int32()), pa.array(grams, pa.int64())], names=[*batch.schema.names, "size", "gram"])

    return keywords.where("form <> ''").mapInArrow(run, StructType([*keywords.schema.fields, StructField("size", IntegerType()), StructField("gram", LongType())]))


def with_gram_places(frame: DataFrame, column: str, keyed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``frame`` with ``name``, the places of its text column at which a form of ``keyed`` (with grams) may begin, and ``keyed``, for a join on size and gram.

    Pages get a bitmap of the grams (a Bloom filter), not the grams. What it lacks is
    no keyword's gram, so only the rest becomes rows; what it holds by chance finds
    no keyword in the join. Rows without places are left out.
    """
    known = keyed.agg(F.count("*").alias("n"), F.sum(F.octet_length("form")).alias("bytes"), F.sort_array(F.collect_set("size")).alias("lengths")).first()
    if not known.n:
        return frame.limit(0).withColumn(name, F.lit(None).cast(GRAM_PLACES)), keyed
    bound = min(max(GRAM_BITS[0], (64 * known.n).bit_length()), GRAM_BITS[1])
    slots = F.array(F.shiftrightunsigned("gram", 64 - bound), F.col("gram").bitwiseAND(F.lit((1 << bound) - 1)))
    slot = F.col("slot") + 1  # Spark's bitmaps count from 1
    rows = keyed.select(F.explode(slots).alias("slot")).groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bits = np.zeros(1 << (bound - 3), np.uint8)
    for row in rows:
        bits[(row.b - 1) << 12 : row.b << 12] = np.frombuffer(row.bits, np.uint8)
    shared, lengths, at = frame.sparkSession.sparkContext.broadcast(bits), list(known.lengths), frame.columns.index(column)
    kind = pa.list_(pa.struct([("size", pa.int32()), ("gram", pa.int64()), ("line_no", pa.int32()), ("pieces", pa.list_(pa.string()))]))

    def run(batches):
        for batch in slices(batches):
            found = gram_places([text or "" for text in batch.column(at).to_pylist()], lengths, shared.value)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    few = known.n <= sizes.BROADCAST_ROWS and known.bytes <= KEYED_BYTES
    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField(name, GRAM_PLACES)])), F.broadcast(keyed) if few else keyed


def begins(places: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """Places joined with the keywords that stand there: one row for each line and keyword, since a form has one gram."""
    rows = places.join(keyed, [*on, "size", "gram"])
    return rows.where(F.exists("pieces", lambda piece: F.startswith(piece, F.col("form")))).drop("size", "gram", "pieces")


def line_hits(pages: DataFrame, keywords: DataFrame, on: list[str], keep: str = text.SEARCH_CHARS, method: str | None = None, context: int = CONTEXT) -> DataFrame:
    """A row for each keyword and line that contains it: the page's columns, the keyword's, ``line_no`` (from 0) and ``snippet``.

    The one pass over a page gives the lines too, and snippets are cut before
    anything is joined, so no page's text is copied for its keywords. The distinct
    forms of keywords, where counted as few, are sent to the pages (``with_places``).
    Too many to send, or too long, they are met by hashes of their beginnings
    (``with_gram_places``) and then compared. Both ways give the same rows.
    """
    pages = pages.select(*PAGE, "text", text.search_lines(F.col("text"), keep).alias("forms"))
    lines = text.lines_of(F.col("text"))
    forms = None if method == "grams" else sizes.strings(keywords, "form")
    if forms is not None:
        met, fields = with_places(pages, "forms", forms, "places"), ["form", "line_no"]
    else:
        met, keyed = with_gram_places(pages, "forms", with_gram(keywords), "places")
        fields = ["size", "gram", "line_no", "pieces"]
    met = met.select(*PAGE, lines.alias("lines"), "places")
    cut = F.transform("places", lambda p: F.struct(*[p[f].alias(f) for f in fields], text.around(F.col("lines"), p["line_no"], context, SNIPPET).alias("snippet")))
    met = met.select(*PAGE, F.explode(cut).alias("p")).select(*PAGE, "p.*")
    rows = met.join(sizes.small(keywords), [*on, "form"]) if forms is not None else begins(met, keyed, on)
    return rows.select(*PAGE, *[c for c in keywords.columns if c not in PAGE], "line_no", "snippet")


def top_hits(hits: DataFrame, by: list[str], k: int = PER_TYPE) -> DataFrame:
    """The first ``k`` hits of each of ``by`` and document type, in the order of file, page, keyword and line; ``rank`` from 1. Hits are not made distinct first."""
    order = Window.partitionBy(*by, "doc_type").orderBy("file_path", "page", "kw_pos", "line_no")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def token_hits(pages: DataFrame, coverages: DataFrame, by: list[str], on: list[str], name: str = "name", token: str = "[가-힣]{2,}", stop=text.STOP_WORDS) -> DataFrame:
    """Fallback hits: lines that hold two core tokens at least of a name with two at least; the keyword is ``token_and(a,b)``."""
    names = coverages.withColumn("tokens", text.core_tokens(F.col(name), token, stop)).where(F.size("tokens") >= 2)
    names = sizes.known(names.select(*by, "tokens", text.token_label(F.col("tokens")).alias("keyword")))
    pages, each = pages.select(*PAGE, "text"), names.select("*", F.posexplode("tokens").alias("i", "token"))
    values = sizes.strings(each, "token")
    if values is not None:
        held = F.transform("tokens", lambda t: F.array_contains("found", t))
        opened = with_found(pages, "text", values, "found").withColumn("token", F.explode("found"))
        # A name meets a page under the first of its tokens that the page holds.
        pairs = opened.join(sizes.small(each), [*on, "token"]).where((F.array_position(held, True) == F.col("i") + 1) & (F.size(F.filter(held, lambda x: x)) >= 2))
        pairs = pairs.select(*PAGE, "text", *[c for c in names.columns if c not in on])
    else:
        places, keyed = with_gram_places(pages, "text", with_gram(each.select(*by, "i", F.col("token").alias("form"))), "places")
        met = begins(places.select(*PAGE, F.inline("places")), keyed, on).select(*PAGE, *[c for c in by if c not in PAGE], "i").distinct()
        met = met.groupBy(*PAGE, *[c for c in by if c not in on]).agg(F.count("*").alias("n")).where("n >= 2").drop("n")
        pairs = pages.join(met, PAGE).join(names, by).select(*PAGE, "text", *[c for c in names.columns if c not in on])
    numbers = F.filter(F.transform(text.lines_of(F.col("text")), lambda line, i: F.when(text.tokens_in(line, F.col("tokens")) >= 2, i)), lambda i: i.isNotNull())
    rows = pairs.withColumn("line_no", F.explode(numbers)).withColumn("snippet", text.around(text.lines_of(F.col("text")), F.col("line_no"), CONTEXT, SNIPPET))
    return rows.withColumn("kw_pos", F.lit(0)).drop("text", "tokens")


def best_line(pages: DataFrame, by: list[str], required: tuple, bonus: tuple, context: int = 4) -> DataFrame:
    """For each of ``by`` the first line of the highest score: a point for each required word, all of which must occur, and one for a bonus word."""
    lines = pages.select(*by, "file_path", "page", "text", F.posexplode(text.lines_of(F.col("text"))).alias("line_no", "line"))
    has_all = F.lit(True)
    for word in required:
        has_all &= F.contains("line", F.lit(word))
    lines = lines.where(has_all).withColumn("score", F.lit(len(required)) + text.any_of(F.col("line"), bonus).cast("int"))
    lines = lines.withColumn("snippet", text.around(text.lines_of(F.col("text")), F.col("line_no"), context, SNIPPET))
    best = F.min_by(F.struct("file_path", "page", "line_no", "score", "snippet"), F.struct(-F.col("score"), "file_path", "page", "line_no"))
    return lines.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def counts_by_type(hits: DataFrame, by: list[str], types=TYPES) -> DataFrame:
    """``by`` and a column for each type with its hits; a leaflet counts as a summary, other types count nowhere."""
    out = hits.withColumn("__type", counted_type(F.col("doc_type")))
    return out.groupBy(*by).agg(*[F.count_if(F.col("__type") == t).alias(t) for t in types])


def policy_only(types=TYPES) -> Column:
    return (F.col(f"`{types[0]}`") >= 1) & (F.col(f"`{types[1]}`") == 0) & (F.col(f"`{types[2]}`") == 0)


def packs(coverages: DataFrame, pages: DataFrame, fallback: DataFrame | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """Evidence packs of coverages (``insurer, name, canonical, coverage_code, mapping_status, keywords, ord``).

    ``fallback`` lists the insurers that search by tokens where nothing was
    found. ``definitions`` are rules (insurer, coverage_code, doc_type) for which
    a definition line is looked for where that type had no hit. Result:
    ``evidences`` in the order type, rank, then fallback, then definition;
    ``hits_by_doc_type``; ``flags`` (fallback once for each type).
    """
    by = ["insurer", "name"]
    found = top_hits(line_hits(pages, keyword_rows(coverages, by), ["insurer"]), by).withColumn("branch", F.lit(0))
    columns = [*by, "branch", "doc_type", "file_path", "page", "keyword", "rank", "snippet"]
    found = found.select(*columns)
    if fallback is not None:
        empty = coverages.join(fallback.select("insurer"), "insurer", "left_semi").join(found.select(*by).distinct(), by, "left_anti")
        more = top_hits(token_hits(pages, empty, by, ["insurer"]), by).withColumn("branch", F.lit(1))
        found = found.unionByName(more.select(*columns))
    if definitions is not None:
        wanted = coverages.join(definitions, ["insurer", "coverage_code"]).select(*by, "doc_type")
        wanted = wanted.join(found.select(*by, "doc_type").distinct(), [*by, "doc_type"], "left_anti")
        lines = best_line(pages.join(definitions.select("insurer", "doc_type").distinct(), ["insurer", "doc_type"], "left_semi"), ["insurer", "doc_type"], ("암진단비", "유사암", "제외"), ("보험금", "지급"))
        hit = wanted.join(lines, ["insurer", "doc_type"]).withColumn("branch", F.lit(2)).withColumn("keyword", F.lit("kb_bm_definition_hit")).withColumn("rank", F.lit(1))
        found = found.unionByName(hit.select(*columns))
    order = F.struct("branch", type_priority(F.col("doc_type")).alias("p"), "doc_type", "rank")
    evidence = F.struct("doc_type", "file_path", "page", "snippet", F.col("keyword").alias("match_keyword"))
    # At most a few rows of each type and branch for a coverage.
    grouped = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), evidence.alias("e")))).alias("all"), *[F.count_if(counted_type(F.col("doc_type")) == t).alias(t) for t in TYPES], F.array_sort(F.collect_set(F.when(F.col("branch") == 1, F.col("doc_type")))).alias("fell"), F.max(F.col("branch") == 2).alias("defined"))
    out = coverages.join(grouped, by, "left").na.fill(0, list(TYPES))
    flags = F.concat(F.when(policy_only(), F.array(F.lit("policy_only"))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("fell", lambda _: F.lit("fallback_token_and")), F.array().cast("array<string>")), F.when(F.col("defined"), F.array(F.lit("kb_bm_definition_hit"))).otherwise(F.array().cast("array<string>")))
    counts = F.map_from_arrays(F.array(*map(F.lit, TYPES)), F.array(*[F.col(t).cast("long") for t in TYPES]))
    empty_list = F.expr("cast(array() as array<struct<doc_type:string,file_path:string,page:int,snippet:string,match_keyword:string>>)")
    evidences = F.coalesce(F.transform("all", lambda x: x["e"]), empty_list)
    return out.select(*coverages.columns, evidences.alias("evidences"), counts.alias("hits_by_doc_type"), flags.alias("flags"), (F.col("mapping_status") == "unmatched").alias("needs_alias_review"))


def top_hits_text() -> Column:
    """The first three evidences of a pack row, each with its reference."""
    first = F.transform(F.slice("evidences", 1, 3), lambda e: F.concat(text.reference(e["doc_type"], e["page"]), F.lit(": "), text.preview(e["snippet"], 100, always=True)))
    return F.array_join(first, " | ")


def unmatched_review(pack: DataFrame) -> DataFrame:
    """Unmatched coverages with their first hits, for a person to look at; no code is ever suggested."""
    return pack.where("mapping_status = 'unmatched'").select(F.col("name").alias("coverage_name_raw"), top_hits_text().alias("top_hits"), F.lit("").alias("suggested_canonical_code"))
