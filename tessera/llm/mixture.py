"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target in words (water-filling under a cap of twice its
size). What the target holds of whole copies of the source is certain. The rest
is a sample of unequal probabilities: a document's inclusion probability is in
proportion to its size class (``size_class``), such that the expected words are
the rest. Classes whose probability would reach 1 are certain too. The others
are ranked by random odds divided by inclusion odds, and are taken in that order
until the words taken come nearest the rest.

The order is never sorted as a whole: the quotient, mapped onto 36 bits, is
counted in 512 bins a source, the bin in which the target falls is counted
again in 512 bins, and so on; only documents that share all but the last level
are put in order. So a source with a third of all rows is summed map-side, and
no task holds it. A source has at most 480 size classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import bounded, saved

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = "mix"
LEVEL_BITS, LEVELS = 9, 4
BITS = LEVEL_BITS * LEVELS
WORD = r"[^\x20\x09-\x0D]+"
NEW = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(key: Column, seed: str) -> Column:
    """A number of 48 random bits from the MD5 of a key, half a step inside (0, 1)."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), key).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def size_class(size: Column) -> Column:
    """The size with all but its four leading bits cleared: eight classes for each doubling."""
    low = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``c_source, z, p, certain, rest``: the inclusion probability of each source and size class, and the source's words that are left to the sample.

    From the largest class down, a class is certain if with its like and all
    smaller ones sampled in proportion to z it would have a probability of 1 or more.
    """
    per = sizes.where("size > 0").groupBy("source", size_class(F.col("size")).alias("z")).agg(F.sum("size").alias("words"))
    per = per.join(bounded(plan.select("p_source", "rest")), same("source", "p_source"))
    down = Window.partitionBy("source").orderBy(F.col("z").desc())
    load = F.col("z").cast("decimal(19,0)") * F.col("words").cast("decimal(19,0)")
    left = F.col("rest") - F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    below = F.sum(load).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    per = per.withColumn("left", left).withColumn("below", below).withColumn("certain", F.col("left") * F.col("z") >= F.col("below"))
    whole = Window.partitionBy("source")
    factor = F.max(F.when(~F.col("certain"), F.struct("z", (F.col("left") / F.col("below")).alias("c")))).over(whole)["c"]
    sure = F.coalesce(F.sum(F.when(F.col("certain"), F.col("words"))).over(whole), F.lit(0)).cast("double")
    p = F.when(F.col("certain"), F.lit(1.0)).otherwise(F.col("z") * factor)
    return per.select(F.col("source").alias("c_source"), "z", p.alias("p"), "certain", (F.col("rest") - sure).alias("rest"))


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source with ``source_size`` and ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all words; a target stops at ``most`` times its source's size
    and what it would have had beyond that goes to the others by weight, until
    none is above. In the order of cap / weight the capped sources come first,
    so the level of the rest follows from running sums. There is a row for a
    source, not for a document, so the single window partition stays small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))).withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    # The level if the sources before this one are capped; capped sources are a prefix of this order.
    per = per.withColumn("capped", F.col("cap") * F.col("rest") < (F.col("total") - F.col("before")) * F.col("weight"))
    first_free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), "total", "before", "rest"))).over(everything)
    per = per.withColumn("free", first_free)
    level = (F.col("free.total") - F.col("free.before")) * F.col("weight") / F.col("free.rest")
    return per.select("source", "source_size", F.when(F.col("capped") | F.col("free").isNull(), F.col("cap")).otherwise(level).alias("target"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def rank_bits() -> Column:
    """The quotient q of random odds and inclusion odds as q / (1 + q), in whole steps of its bits."""
    u, p = F.col("u"), F.col("p")
    odds = u * (F.lit(1.0) - p)
    total = odds + (F.lit(1.0) - u) * p
    return F.least(F.floor(odds / total * F.lit(float(1 << BITS))), F.lit((1 << BITS) - 1)).cast("long")


def prefix(bits: Column, level: int) -> Column:
    return F.shiftright(bits, BITS - LEVEL_BITS * level)


def refine(keyed: DataFrame, cut: DataFrame, level: int) -> DataFrame:
    """For each source the bin of the next level in which its words reach the rest, and the words before that bin."""
    cut = bounded(saved(cut.withColumnRenamed("source", "c_source")))
    inside = keyed.join(cut, same("source", "c_source") & (prefix(F.col("bits"), level) == F.col("prefix")))
    bins = inside.groupBy("source", prefix(F.col("bits"), level + 1).alias("bin"), "before", "rest").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    bins = bins.withColumn("upto", upto).where(F.col("upto") >= F.col("rest"))
    return bins.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("b")).select("source", F.col("b.bin").alias("prefix"), "b.before", "b.rest")


def mix(docs: DataFrame, *, share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with ``size, source_size, target, copies, taken``.

    ``taken`` is ``copies * size``. A source's words come within one document
    of its target; no row has more than ``most`` copies. Random numbers come
    from the key, so reruns agree; repeated rows of one key and size stand or
    fall together. A text that is null or empty has size 0; a null source is a
    source of its own; a source without words has target 0 and takes nothing.
    Columns of ``docs`` with the names of the result are replaced. An empty
    table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    of_source, of_key, of_size = F.col(source).cast("string").alias("source"), F.coalesce(F.col(key).cast("string"), F.lit("")), word_count(F.col(text).cast("string")).alias("size")
    sizes = saved(docs.select(of_source, unit(of_key, seed).alias("u"), of_size))
    plan = source_targets(sizes, share, weights, most)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = saved(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "p_source"))
    known = bounded(plan.drop("rest"))
    classes = saved(inclusion(sizes, plan))
    chances = bounded(classes.select("c_source", F.col("z").alias("c_z"), "p", "certain"))
    in_class = same("source", "c_source") & (size_class(F.col("size")) == F.col("c_z"))
    keyed = saved(sizes.where("size > 0").join(chances, in_class).where(~F.col("certain")).select("source", "size", rank_bits().alias("bits")))

    cut = classes.where(~F.col("certain")).groupBy(F.col("c_source").alias("source")).agg(F.first("rest").alias("rest"))
    cut = cut.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), "rest")
    for level in range(LEVELS):
        cut = refine(keyed, cut, level)
    # Documents of the last bin are taken while that brings the words nearer the rest.
    cut = saved(cut.withColumnRenamed("source", "c_source"))
    last = keyed.join(bounded(cut), same("source", "c_source") & (prefix(F.col("bits"), LEVELS) == F.col("prefix")))
    last = last.groupBy("source", "bits", "size", "before", "rest").agg(F.sum("size").alias("words"))
    last = last.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bits", "size")))
    nearer = last.where(F.abs(F.col("upto") - F.col("rest")) < F.abs(F.col("upto") - F.col("words") - F.col("rest")))
    ends = nearer.groupBy("source").agg(F.max(F.struct("bits", "size")).alias("end")).withColumnRenamed("source", "e_source")
    cut = saved(cut.join(ends, same("c_source", "e_source"), "left").select(F.col("c_source").alias("t_source"), "prefix", F.col("end.bits").alias("end_bits"), F.col("end.size").alias("end_size")))

    rows = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in keep], of_source, unit(of_key, seed).alias("u"), of_size)
    out = rows.join(known, same("source", "p_source")).join(chances, in_class, "left").join(bounded(cut), same("source", "t_source"), "left").withColumn("bits", rank_bits())
    bits = F.col("bits")
    inside = (prefix(bits, LEVELS) < F.col("prefix")) | (prefix(bits, LEVELS) == F.col("prefix")) & ((bits < F.col("end_bits")) | (bits == F.col("end_bits")) & (F.col("size") <= F.col("end_size")))
    more = F.col("certain") | F.coalesce(inside, F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select(*[F.col(f"`k_{c}`").alias(c) for c in keep], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]).drop("copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0.0::DOUBLE) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0.0::DOUBLE) AS rest_weight,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * rest_weight < (total - before) * weight AS capped FROM o),
f AS (SELECT arg_min(before, n) AS before, arg_min(rest_weight, n) AS rest_weight FROM c WHERE NOT capped),
t AS (SELECT source, source_size, CASE WHEN capped OR f.before IS NULL THEN cap ELSE (total - f.before) * weight / f.rest_weight END AS target FROM c, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM q),
z AS (SELECT d.source, ((d.size >> (greatest(length(to_binary(d.size)) - 4, 0))::BIGINT) << (greatest(length(to_binary(d.size)) - 4, 0))::BIGINT)::BIGINT AS z, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
b AS (SELECT z.source, z.z, z.words, r.rest, r.rest - coalesce(sum(z.words) OVER (PARTITION BY z.source ORDER BY z.z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_over,
    (sum(z.z::HUGEINT * z.words) OVER (PARTITION BY z.source ORDER BY z.z DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS below FROM z JOIN r ON z.source IS NOT DISTINCT FROM r.source),
e AS (SELECT *, left_over * z >= below AS certain FROM b),
c2 AS (SELECT source, arg_max(left_over / below, z) FILTER (NOT certain) AS c, coalesce(sum(words) FILTER (certain), 0)::DOUBLE AS sure FROM e GROUP BY source),
p AS (SELECT e.source, e.z, e.certain, CASE WHEN e.certain THEN 1.0::DOUBLE ELSE e.z * c2.c END AS p, e.rest - c2.sure AS rest FROM e JOIN c2 ON e.source IS NOT DISTINCT FROM c2.source),
k AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole, p.rest, p.certain,
    least(floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * 68719476736.0::DOUBLE), 68719476735)::BIGINT AS bits
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.size > 0 AND p.z = ((d.size >> (greatest(length(to_binary(d.size)) - 4, 0))::BIGINT) << (greatest(length(to_binary(d.size)) - 4, 0))::BIGINT)::BIGINT),
g AS (SELECT source, bits, size, rest, sum(size) AS words FROM k WHERE size > 0 AND NOT certain GROUP BY ALL),
h AS (SELECT source, bits, size, abs(upto - rest) < abs(upto - words - rest) AS inside FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bits, size) AS upto FROM g))
SELECT k.doc_id, k.size, k.source_size, k.target, CASE WHEN k.size > 0 THEN (whole::BIGINT + (certain OR coalesce(inside, false))::BIGINT) * k.size ELSE 0 END::BIGINT AS taken
FROM k LEFT JOIN h ON k.source IS NOT DISTINCT FROM h.source AND k.bits = h.bits AND k.size = h.size
"""
