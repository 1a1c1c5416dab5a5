"""Merkle manifest of a table: leaf hashes, a tree for each group, a root over the groups, and proofs by coordinates.

A leaf is the hash of a row's canonical fields. The leaves of a group (here: a
language) stand in the order of their keys; every ``ARITY`` consecutive nodes
become their hash until one is left, the group's subroot. The subroots, in the
order of the groups, are the leaves of the tree on top, which ends in the root.

The node table is materialised level by level, one row for each run of
consecutive nodes: ``tree, level, run, digests``. A proof asks for coordinates:
from a leaf's index and the size of its group follow the run and the own place
at every level. The leaves of one run share all coordinates above it, so each
run of leaves explodes them once, joins the node table, orders what it gets by
step and hands it to its leaves, which concatenate their siblings and fold.

At scale only keys and hashes are shuffled, never texts. The levels near the
root, which every proof needs, are broadcast up to ``FEW_RUNS`` rows of at most
600 bytes; a run of the levels below is asked for by at most one in
``FEW_RUNS`` / ``ARITY`` of the runs of leaves, so no key is hot. A group with a third of
all rows is many runs. Rows that repeat key and content are neighbours; which
of them stands first does not show.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import bounded, join_keyed, saved

BITS = 3
ARITY = 1 << BITS
FEW_RUNS = 8192
PART_ROWS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = -1  # the number of the tree over the subroots


def canonical(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value (integers decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*(canonical(v) for v in values)), 256)


def group_key(group: Column) -> Column:
    """A string that sorts as the group does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(frame: DataFrame, order: list, rows: int) -> DataFrame:
    """``frame`` with ``place``, the rank of each row in ``order``, from 0.

    Ranges of the order are sorted by tasks of their own and written; the rows
    before a range come from a window over one row for each range. Rows that
    are equal in ``order`` are spread over several ranges.
    """
    parts = max(min(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows // 1000), -(-rows // PART_ROWS))
    spread = frame.repartitionByRange(parts, *order, F.rand(11)).sortWithinPartitions(*order)
    spread = saved(spread.withColumn("__row", F.monotonically_increasing_id()))
    spread = spread.withColumn("__part", F.shiftright("__row", 33))
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = saved(sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__ahead")))
    place = F.col("__ahead") + F.col("__row") - F.shiftleft("__part", 33)
    return spread.join(bounded(ahead), "__part").withColumn("place", place).drop("__part", "__row", "__ahead")


class Manifest(NamedTuple):
    """``leaves``: a row for each run of leaves, ``tree, run, n, members`` (``members``: place in the tree, ``leaf`` and
    what was carried); ``levels``: the node table, ``(level, top, frame, rows)`` for each level; ``trees``: their number;
    ``root``: None for an empty table."""

    leaves: DataFrame
    levels: list[tuple[int, bool, DataFrame, int]]
    trees: int
    root: str | None


def run_levels(nodes: DataFrame, most: int, top: bool, first: int) -> tuple[list[tuple[int, bool, DataFrame, int]], list[DataFrame]]:
    """The node table's levels from ``first`` on, and the nodes that end a tree. ``nodes``: ``tree, pos, n, hash``, at most ``most`` to a tree."""
    levels, ends, level = [], [nodes.where("n = 1")], first
    while most > 1:
        runs = nodes.where("n > 1").groupBy("tree", "n", F.shiftright("pos", BITS).alias("run"))
        runs = saved(runs.agg(F.array_sort(F.collect_list(F.struct("pos", "hash")))["hash"].alias("digests")))
        levels.append((level, top, runs, runs.count()))
        nodes = parents(runs)
        ends.append(nodes.where("n = 1"))
        most, level = -(-most // ARITY), level + 1
    return levels, ends


def parents(runs: DataFrame) -> DataFrame:
    size = F.floor((F.col("n") + (ARITY - 1)) / ARITY).cast("long")
    return runs.select("tree", F.col("run").alias("pos"), size.alias("n"), F.sha2(F.array_join("digests", ""), 256).alias("hash"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def manifest(rows: DataFrame, *, group: str, order: list[str], leaf: str, carry: list[str]) -> Manifest:
    """The manifest of ``rows``: a tree for each ``group`` (null is one), leaves by ``order`` (nulls first), then by hash.

    ``rows`` is read once. ``carry`` names further small columns that stay with the leaves.
    """
    total = rows.count()
    keyed = rows.select(group_key(F.col(group)).alias("group"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(leaf).alias("leaf"), F.struct(*carry).alias("carried"))
    leaves = numbered(keyed, [F.col("group"), *[F.col(f"o{k}").asc_nulls_first() for k in range(len(order))], F.col("leaf")], total)
    groups = saved(leaves.groupBy("group").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    trees, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    groups = numbered(groups, [F.col("group")], trees).withColumnRenamed("place", "tree")
    leaves = join_keyed(leaves.select("group", "place", "leaf", "carried"), groups, ["group"], "n", total)
    pos = F.col("place") - F.col("first")
    members = F.array_sort(F.collect_list(F.struct(pos.alias("pos"), "leaf", "carried"))).alias("members")
    leaves = saved(leaves.groupBy("tree", "n", F.shiftright(pos, BITS).alias("run")).agg(members))
    bottom = leaves.where("n > 1").select("tree", "n", "run", F.col("members")["leaf"].alias("digests"))
    lone = leaves.where("n = 1").select("tree", F.col("run").alias("pos"), "n", F.col("members")[0]["leaf"].alias("hash"))
    levels, ends = run_levels(parents(bottom), -(-most // ARITY), False, 1)
    subroots = saved(union([lone, *ends]).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "hash"))
    over, ends = run_levels(subroots, trees, True, 0)
    root = union(ends).first()
    return Manifest(leaves, levels + over, trees, root and root["hash"])


def node_table(made: Manifest) -> DataFrame:
    """``tree, level, run, digests`` of all levels above the leaves' own runs; the top tree's number is TOP."""
    return union([frame.select("tree", F.lit(level).alias("level"), "run", "digests") for level, _, frame, _ in made.levels])


def coordinates(made: Manifest) -> DataFrame:
    """For each run of leaves, what its proofs need above it: ``tree, run, step, of, level, at, own`` (run and own place there)."""
    lower = max([level for level, top, *_ in made.levels if not top], default=0)
    upper = max([level + 1 for level, top, *_ in made.levels if top], default=0)
    steps = F.concat(
        F.expr(f"transform(filter(sequence(0, {lower}), l -> l > 0 and n > shiftleft(1L, {BITS} * l)), l -> struct(l as step, tree as of, l as level, shiftright(run, {BITS} * l) as at, cast(shiftright(run, {BITS} * (l - 1)) & {ARITY - 1} as int) as own))"),
        F.expr(f"transform(filter(sequence(0, {upper}), l -> l < {upper}), l -> struct(l + {lower + 1} as step, {TOP}L as of, l as level, shiftright(tree, {BITS} * (l + 1)) as at, cast(shiftright(tree, {BITS} * l) & {ARITY - 1} as int) as own))"),
    )
    return made.leaves.select("tree", "run", F.explode(steps).alias("s")).select("tree", "run", "s.*")


def proofs(made: Manifest) -> DataFrame:
    """``carried, leaf, steps`` for each leaf: ``steps`` in order from the leaf to the root, ``own`` place and ``digests`` of each run; ``subroot`` too."""
    asked = coordinates(made)
    few = [x for x in made.levels if x[3] <= FEW_RUNS]
    many = [x for x in made.levels if x[3] > FEW_RUNS]
    found = []
    for some, small in ((few, True), (many, False)):
        if not some:
            continue
        nodes = node_table(made._replace(levels=some)).withColumnsRenamed({"tree": "of", "run": "at"})
        mine = F.lit(False)
        for level, top, *_ in some:
            mine = mine | ((F.col("level") == level) & ((F.col("of") == TOP) if top else (F.col("of") != TOP)))
        found.append(asked.where(mine).join(F.broadcast(nodes) if small else nodes, ["of", "level", "at"]))
    own = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("step"), (F.col("m.pos") % ARITY).cast("int").alias("own"), F.col("digests"))))
    none = F.expr("cast(array() as array<struct<step: int, own: int, digests: array<string>>>)")
    leaves = made.leaves.withColumn("digests", F.col("members")["leaf"])
    if found:
        paths = union([f.select("tree", "run", F.struct("step", "own", "digests").alias("s"), F.when((F.col("of") == TOP) & (F.col("level") == 0), F.col("digests")[F.col("own")]).alias("subroot")) for f in found])
        paths = paths.groupBy("tree", "run").agg(F.array_sort(F.collect_list("s")).alias("path"), F.max("subroot").alias("subroot"))
        leaves = leaves.join(paths, ["tree", "run"], "left")
    else:
        leaves = leaves.select("*", F.lit(None).cast("string").alias("subroot"), none.alias("path"))
    leaves = leaves.select("tree", "n", "digests", "subroot", "path", F.explode("members").alias("m"))
    steps = F.concat(F.coalesce(own, none), F.coalesce("path", none))
    return leaves.select("tree", "m.carried", "m.leaf", steps.alias("steps"), F.coalesce("subroot", F.lit(made.root)).alias("subroot"))


def siblings_hash(steps: str) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return F.expr(f"sha2(array_join(flatten(transform({steps}, s -> concat(slice(s.digests, 1, s.own), slice(s.digests, s.own + 2, {ARITY})))), ''), 256)")


def folded(leaf: str, steps: str) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.expr(f"aggregate({steps}, {leaf}, (h, s) -> sha2(concat(array_join(slice(s.digests, 1, s.own), ''), h, array_join(slice(s.digests, s.own + 2, {ARITY}), '')), 256))")


def verified(made: Manifest, claimed: str) -> DataFrame:
    """All proofs, applied to the carried hash ``claimed`` (null: the leaf itself): ``carried, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    out = proofs(made).withColumn("start", F.coalesce(F.col("carried")[claimed], F.col("leaf")))
    out = out.select("carried", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), siblings_hash("steps").alias("proof_sha256"), folded("start", "steps").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A null field is ``-``; a null language is a group, the first; null keys
    come first in their group and are not tampered with. Rows of one key stand
    in the order of their hashes, and each is proved. A single leaf is its
    group's subroot and a single subroot the root, with empty proofs. Tampering
    that changes nothing (no A-Z, null text) verifies. An empty table gives no
    rows. Further columns are not looked at.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    text = F.col("text").cast("string")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    before = [F.col(c) for c in fields]
    rows = docs.select("doc_id", "lang", leaf_hash(*before, text).alias("leaf"), F.when(tampered, leaf_hash(*before, F.translate(text, UPPER, LOWER))).alias("claimed"))
    made = manifest(rows, group="lang", order=["doc_id"], leaf="leaf", carry=["doc_id", "claimed"])
    return verified(made, "claimed").select(F.col("carried.doc_id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS b))),
coded AS (
    SELECT doc_id, lang, text,
        CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) END
        || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
        || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR) END AS head,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM documents, crc_table),
hashed AS (
    SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        CASE WHEN crc % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}') END) END AS claimed
    FROM coded),
leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY coalesce('=' || lang, '')) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
nodes AS (
    SELECT tree, 0 AS level, pos, leaf AS hash, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subroots AS (SELECT tree, hash FROM nodes WHERE n = 1),
top AS (
    SELECT 0 AS level, tree AS pos, hash, (SELECT count(*) FROM subroots) AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
steps AS (
    SELECT l.tree, l.pos, k.level AS step, list(k.hash ORDER BY k.pos) AS digests, (l.pos // (8 ** k.level)::BIGINT) % 8 AS own
    FROM leaves l JOIN nodes k ON k.tree = l.tree AND k.n > 1 AND k.pos // 8 = l.pos // (8 ** (k.level + 1))::BIGINT GROUP BY l.tree, l.pos, k.level
    UNION ALL
    SELECT l.tree, l.pos, 100 + k.level, list(k.hash ORDER BY k.pos), (l.tree // (8 ** k.level)::BIGINT) % 8
    FROM leaves l JOIN top k ON k.n > 1 AND k.pos // 8 = l.tree // (8 ** (k.level + 1))::BIGINT GROUP BY l.tree, l.pos, k.level),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS k, array_to_string(digests[1:own], '') AS before, array_to_string(digests[own + 2:8], '') AS after FROM steps),
proofs AS (SELECT tree, pos, count(*) AS steps, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM ordered GROUP BY tree, pos),
fold AS (
    SELECT tree, pos, 0::BIGINT AS k, coalesce(claimed, leaf) AS hash FROM leaves
    UNION ALL
    SELECT f.tree, f.pos, f.k + 1, sha256(o.before || f.hash || o.after) FROM fold f JOIN ordered o ON o.tree = f.tree AND o.pos = f.pos AND o.k = f.k + 1)
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = r.hash AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN (SELECT hash FROM top WHERE n = 1) r ON true
LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
JOIN fold f ON f.tree = l.tree AND f.pos = l.pos AND f.k = coalesce(p.steps, 0)
"""
