"""Near-duplicate vectors by range search on a robust-pruned flat graph.

1. Vectors of a label that are equal or positive multiples are one node with a count.
2. A label's nodes are one shard. A shard of more than two blocks of BLOCK nodes is split by
   k-means centroids, fitted on a bounded sample (about ``SAMPLE`` of its nodes);
   its nodes join the new shards of their OVERLAP nearest centroids, and so on
   until no shard is larger. Of all new shards of a level a node keeps the COPIES
   nearest, so neither its copies nor its work multiply with the levels.
   A shard that LEVELS splits leave larger is dealt out as pairs of blocks, so
   a task never holds more than two.
3. In each shard a graph is built: nearest nodes and a few others, thinned by
   robust pruning. The adjacency lists of all shards are united by node.
4. In each shard all its nodes are queries on the united graph: greedy search
   from the shard's medoid and the query's own node, which goes on from every
   node within the range. Cosines are computed in double precision, so what is
   found is verified. A few queries of each shard are audited against all its
   nodes; a miss widens the beam, and at last the shard is compared whole.
5. The search goes on beyond the query's own shards: a node of its beam lies in other
   shards too, and the query enters the VISITS best of these there, as one row a visit, and
   walks on from that node. So pairs that share no shard are met as well. A shard with
   many visitors is searched in parts of about VISITORS.
6. A pair that several shards hold counts in the one of the smallest number, a pair that shares
   none in the first visit that can meet it, so counts are sums; only a spanning link for
   each node leaves a shard, never its pairs. Pairs that neither way meets are not found;
   ``audit`` measures how many those are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .tables import join_keyed, saved

COSINE = 0.93
SAMPLE, PER_CLUSTER, CLUSTERS, OVERLAP, BLOCK, LEVELS = 8192, 64, 256, 3, 512, 6
NEAREST, OTHERS, DEGREE, ALPHA = 40, 6, 24, 1.2
BEAM, SLACK, AUDIT = 16, 0.12, 32
COPIES, VISITS, VISITORS = 6, 4, 1024
GROUP_BYTES = 16 << 20  # of the vectors that are assigned to centroids in one group
SENT_BYTES = 32 << 20  # of the queries of an audit that are sent to the tasks at a time


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as an array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(vector: str) -> Column:
    """The vector divided by its largest component, so no square overflows or vanishes and multiples of it are equal; null if that is zero or there is none."""
    top = F.nullif(F.array_max(F.transform(vector, F.abs)), F.lit(0.0))
    # Over an array of one, so that the largest is found once and not for each component.
    return F.when(top.isNotNull(), F.element_at(F.transform(F.array(top), lambda t: F.transform(vector, lambda x: x / t)), 1))


def nodes_of(rows: DataFrame) -> DataFrame:
    """``grp`` (label and dimension), ``id`` (smallest vec_id), ``copies``, the unit vector ``v`` and the vector ``raw`` it comes from, of each distinct vector that can be linked; vectors that are equal when ``scaled`` are one."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine)
    rows = rows.withColumn("v", scaled("v")).where("v is not null")
    nodes = rows.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("norm", norm)
    return nodes.select(F.concat_ws(":", F.col("label").cast("string"), F.size("v")).alias("grp"), "id", "copies", F.transform("v", lambda x: x / F.col("norm")).alias("v"), "label", F.col("v").alias("raw"))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors, seeded by far points."""
    chosen, best = [0], x @ x[0]
    while len(chosen) < k:
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        for j in range(k):
            s = x[own == j].sum(0)
            n = np.linalg.norm(s)
            if n > 0:
                c[j] = s / n
    return c


def fit(members: DataFrame) -> DataFrame:
    """``grp, shard, cluster, c``: centroids of each shard of ``members`` (with its size ``n``), from about SAMPLE of its nodes."""
    sample = members.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.col("n") < F.lit(SAMPLE << 20))
    schema = pa.schema([("grp", pa.string()), ("shard", pa.int64()), ("cluster", pa.int32()), ("c", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = as_matrix(table.column("v"))
        k = min(len(x), CLUSTERS, -(-table.column("n")[0].as_py() // PER_CLUSTER))
        grp, shard = (table.column(c)[0].as_py() for c in ("grp", "shard"))
        return pa.table({"grp": [grp] * k, "shard": [shard] * k, "cluster": list(range(k)), "c": kmeans(x, k).tolist()}, schema=schema)

    return sample.select("grp", "shard", "id", "n", "v").groupBy("grp", "shard").applyInArrow(run, "grp string, shard long, cluster int, c array<double>")


def assigned(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """``grp, shard, id, copies, v``: the members of each shard in the new shards of their OVERLAP nearest centroids, of which a node keeps the COPIES nearest. A group holds GROUP_BYTES of vectors and the centroids of one shard."""
    names = ["grp", "id", "copies", "v", "near"]
    near_type = pa.list_(pa.struct([("far", pa.float64()), ("shard", pa.int64())]))

    def run(rows: pa.Table, centroids: pa.Table) -> pa.Table:
        centroids = centroids.sort_by("cluster")
        score = as_matrix(rows.column("v")) @ as_matrix(centroids.column("c")).T
        order = np.argsort(-score, 1, kind="stable")[:, :OVERLAP]
        far, shards = -np.take_along_axis(score, order, 1), rows.column("shard").to_numpy()[:, None] * CLUSTERS + order + 1
        inner = pa.StructArray.from_arrays([pa.array(far.reshape(-1)), pa.array(shards.reshape(-1).astype(np.int64))], names=["far", "shard"])
        near = pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1, dtype=np.int32) * order.shape[1]), inner)
        kinds = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), near_type
        return pa.table([c.cast(kind) for c, kind in zip([*(rows.column(c) for c in names[:-1]), near], kinds)], names=names)

    blocks = F.ceil(F.col("n") * F.col("bytes") / GROUP_BYTES)
    rows = members.withColumn("bytes", 8 * F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), blocks))
    parts = rows.select(F.col("grp").alias("g"), F.col("shard").alias("s"), F.col("block").alias("b")).distinct()
    copies = parts.join(centroids, (F.col("g") == F.col("grp")) & (F.col("s") == F.col("shard"))).select("g", "s", "b", "cluster", "c")
    near = rows.select("grp", "shard", "id", "copies", "v", "block").groupBy("grp", "shard", "block").cogroup(copies.groupBy("g", "s", "b")).applyInArrow(run, "grp string, id long, copies long, v array<double>, near array<struct<far:double,shard:long>>")
    # A node came with at most COPIES rows, so a group here is at most COPIES * OVERLAP places.
    near = near.groupBy("grp", "id").agg(F.first("copies").alias("copies"), F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, COPIES).alias("near"))
    return near.withColumn("near", F.explode("near")).select("grp", F.col("near.shard").alias("shard"), "id", "copies", "v")


def shards_of(nodes: DataFrame) -> DataFrame:
    """``grp, shard, id, copies, v, shards`` (all of the node's shards): a row for each node and shard."""
    members = nodes.select("grp", F.lit(0).cast("long").alias("shard"), "id", "copies", "v")
    done = []
    for _ in range(LEVELS):
        sizes = saved(members.groupBy("grp", "shard").agg(F.count("*").alias("n")))
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
        if (most or 0) <= 2 * BLOCK:
            break
        sized = saved(join_keyed(members, sizes, ["grp", "shard"], "n", total))
        done.append(sized.where(F.col("n") <= 2 * BLOCK).drop("n"))
        large = sized.where(F.col("n") > 2 * BLOCK)
        members = saved(assigned(large, saved(fit(large))))
    if not done:
        return members.withColumn("shards", F.array("shard"))
    for more in done:
        members = members.unionByName(more)
    members = saved(members)
    all_of = members.groupBy("grp", "id").agg(F.collect_list("shard").alias("shards"))
    return members.join(all_of, ["grp", "id"])


def units(rows: DataFrame) -> DataFrame:
    """A row for each node and unit of work it is in: ``lo, hi`` (blocks), ``mine`` (the node's block) and ``shards_of``'s columns; a shard of up to two blocks is one unit."""
    sizes = rows.groupBy("grp", "shard").agg(F.count("*").alias("size"))
    sizes = saved(sizes.withColumn("blocks", F.when(F.col("size") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")))
    rows = join_keyed(rows, sizes, ["grp", "shard"], "size", sizes.agg(F.sum("size")).first()[0] or 0).drop("size")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other", "blocks")


def build(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbour lists of unit vectors."""
    n = len(x)
    random = np.random.default_rng(n)
    out = []
    k = min(NEAREST, n - 1)
    for a in range(0, n, 256):
        mine = np.arange(a, min(n, a + 256))
        score = x[mine] @ x.T
        score[np.arange(len(mine)), mine] = -2
        near = np.argpartition(-score, k - 1, 1)[:, :k] if k else np.zeros((len(mine), 0), np.int64)
        pool = np.concatenate([near, random.integers(0, n, (len(mine), OTHERS))], 1)
        d = 1 - np.take_along_axis(score, pool, 1)
        order = np.argsort(d, 1, kind="stable")
        pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
        between = 1 - np.einsum("nid,njd->nij", x[pool], x[pool])
        alive = pool != mine[:, None]
        taken = np.zeros_like(alive)
        for j in range(pool.shape[1]):
            take = alive[:, j] & (taken.sum(1) < DEGREE)
            taken[take, j] = True
            # What lies nearer to the node taken than to this one goes by way of it.
            alive[take] &= ~(ALPHA * between[take, j] <= d[take])
            alive[:, j] = False
        out += [np.unique(p[t]) for p, t in zip(pool, taken)]
    return out


def graph(members: DataFrame) -> DataFrame:
    """``id, near``: the united adjacency lists."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        lists = build(as_matrix(table.column("v")))
        return pa.table({"id": ids, "near": [ids[i].tolist() for i in lists]}, schema=pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64()))]))

    lists = members.select("grp", "shard", "lo", "hi", "id", "v").groupBy("grp", "shard", "lo", "hi").applyInArrow(run, "id long, near array<long>")
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def padded(ids: np.ndarray, column: pa.ChunkedArray) -> np.ndarray:
    """For each row the places in ``ids`` (ascending) of the ids of its list that are there, padded with -1."""
    lists = column.combine_chunks()
    sizes = np.array([len(x or ()) for x in lists.to_pylist()], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    here = ids[at] == flat
    return ragged(row[here], at[here], len(sizes))


def ragged(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The values of each of ``n`` rows (``row`` ascending) as a matrix padded with -1."""
    sizes = np.bincount(row, minlength=n)
    out = np.full((n, max(1, int(sizes.max(initial=0)))), -1, np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = value
    return out


def range_search(x: np.ndarray, near: np.ndarray, beam: int, queries: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
    """Cosines of the pairs (query, node) that the search meets, -2 elsewhere; without ``queries`` all rows are queries that start at themselves. ``near`` is padded with -1."""
    n = len(x)
    if queries is None:
        queries, starts = x, np.arange(n)
    m = len(queries)
    score, seen, done = np.full((m, n), -2.0), np.zeros((m, n), bool), np.zeros((m, n), bool)
    medoid = int(np.argmax(x @ x.sum(0)))
    score[:, medoid], seen[:, medoid] = queries @ x[medoid], True
    score[np.arange(m), starts], seen[np.arange(m), starts] = np.einsum("ij,ij->i", queries, x[starts]), True
    while True:
        edge = np.partition(score, n - min(beam, n), 1)[:, n - min(beam, n)]
        go = seen & ~done & ((score >= COSINE - SLACK) | (score >= edge[:, None]))
        if not go.any():
            return score
        done |= go
        q, u = np.nonzero(go)
        fresh = np.zeros((m, n), bool)
        for a in range(0, len(q), 1 << 16):
            nodes = near[u[a : a + (1 << 16)]]
            asked = np.repeat(q[a : a + (1 << 16)], nodes.shape[1])
            nodes = nodes.reshape(-1)
            fresh[asked[nodes >= 0], nodes[nodes >= 0]] = True
        fresh &= ~seen
        seen |= fresh
        q, v = np.nonzero(fresh)
        for a in range(0, len(q), 1 << 15):
            i, j = q[a : a + (1 << 15)], v[a : a + (1 << 15)]
            score[i, j] = np.einsum("ij,ij->i", queries[i], x[j])


def searched(x: np.ndarray, near: np.ndarray, queries: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
    """Cosines as ``range_search`` gives them; audited, and searched more widely where the audit finds a missing link."""
    asked, beam = x if queries is None else queries, BEAM
    audit = np.random.default_rng(1).permutation(len(asked))[:AUDIT]
    truth = asked[audit] @ x.T >= COSINE
    for _ in range(3):
        score = range_search(x, near, beam, queries, starts)
        if not (truth & (score[audit] < COSINE)).any():
            return score
        beam *= 4
    return asked @ x.T


def onward(score: np.ndarray, shards: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``query, shard, entry, score`` of the VISITS best shards that each query can enter from its beam: those of the beam's nodes in which the query itself is not. ``shards`` is padded with -1."""
    n = len(score)
    top = np.argpartition(-score, min(BEAM, n - 1), 1)[:, :BEAM]
    out = []
    for a in range(0, n, 256):
        mine = top[a : a + 256]
        to = shards[mine]  # query, node of the beam, shard
        known = np.take_along_axis(score[a : a + 256], mine, 1)
        fine = (to >= 0) & (known > -2)[:, :, None]
        for own in shards[a : a + 256].T:
            fine &= to != own[:, None, None]
        q, b, s = np.nonzero(fine)
        shard, gain, entry = to[q, b, s], known[q, b], mine[q, b]
        order = np.lexsort((entry, -gain, shard, q))
        q, shard, gain, entry = (c[order] for c in (q, shard, gain, entry))
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (shard[1:] != shard[:-1])
        q, shard, gain, entry = (c[first] for c in (q, shard, gain, entry))
        order = np.lexsort((shard, -gain, q))
        q, shard, gain, entry = (c[order] for c in (q, shard, gain, entry))
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < VISITS
        out.append((q[keep] + a, shard[keep], entry[keep], gain[keep]))
    return [np.concatenate(c) for c in zip(*out)]


def wide(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of shards as a matrix, padded with -1."""
    lists = column.combine_chunks()
    sizes = np.array([len(x or ()) for x in lists.to_pylist()], np.int64)
    return ragged(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(sizes))


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that each row of ``x`` shares with the row of ``y`` (both padded with -1); the largest long if none."""
    none = np.iinfo(np.int64).max
    out = np.full(len(x), none)
    for column in y.T:
        out = np.minimum(out, np.where((x == column[:, None]) & (x >= 0), x, none).min(1, initial=none))
    return out


def owned(pairs: tuple[np.ndarray, np.ndarray], shards: np.ndarray, shard: int) -> np.ndarray:
    """Which of the pairs (i, j) have no shard in common that has a smaller number than this one."""
    i, j = pairs
    return np.concatenate([np.zeros(0, bool), *(common(shards[i[a : a + (1 << 15)]], shards[j[a : a + (1 << 15)]]) >= shard for a in range(0, len(i), 1 << 15))])


def links(members: DataFrame) -> DataFrame:
    """``id, n, root, visits``: for each node of a unit the copies of linked nodes that count here, the smallest node that it is joined with, and where its search goes on."""
    visit = pa.struct([("shard", pa.int64()), ("score", pa.float64()), ("entry", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("visits", pa.list_(visit))])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, copies, mine = (table.column(c).to_numpy() for c in ("id", "copies", "mine"))
        shard, lo, hi = (table.column(c)[0].as_py() for c in ("shard", "lo", "hi"))
        n, shards = len(ids), wide(table.column("shards"))
        score = searched(as_matrix(table.column("v")), padded(ids, table.column("near")))
        score[np.arange(n), np.arange(n)] = -2.0
        found = score >= COSINE
        found |= found.T
        i, j = np.nonzero(np.triu(found))
        count = owned((i, j), shards, shard)
        if lo != hi:
            count &= mine[i] != mine[j]
        i, j = i[count], j[count]
        counts = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root = np.arange(n)
        while True:  # smallest index reachable; found is symmetric
            low = np.minimum(root, np.where(found, root[None, :], n).min(1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        q, to, entry, gain = onward(score, shards)
        inner = pa.StructArray.from_arrays([pa.array(to), pa.array(gain), pa.array(ids[entry])], fields=list(visit))
        visits = pa.ListArray.from_arrays(pa.array(np.searchsorted(q, np.arange(n + 1)).astype(np.int32)), inner)
        return pa.table([pa.array(ids), pa.array(counts.astype(np.int64)), pa.array(ids[root]), visits], schema=schema)

    rows = members.select("grp", "shard", "lo", "hi", "id", "copies", "v", "shards", "mine", "near")
    return rows.groupBy("grp", "shard", "lo", "hi").applyInArrow(run, "id long, n long, root long, visits array<struct<shard:long,score:double,entry:long>>")


def visited(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """``id, n, root`` as ``links``, for pairs that share no shard: the nodes of ``chosen`` (``id, visits``) go into the shards that they visit."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def run(own: pa.Table, guests: pa.Table) -> pa.Table:
        if not own.num_rows or not guests.num_rows:
            return schema.empty_table()
        own, guests = own.sort_by("id"), guests.sort_by("id")
        ids, asked = own.column("id").to_numpy(), guests.column("id").to_numpy()
        x, q, shard = as_matrix(own.column("v")), as_matrix(guests.column("v")), own.column("shard")[0].as_py()
        start = np.minimum(np.searchsorted(ids, guests.column("entry").to_numpy()), len(ids) - 1)  # in another block than the entry: some node
        found = searched(x, padded(ids, own.column("near")), q, start) >= COSINE
        i, j = np.nonzero(found)
        homes, to, their_homes, their_to = (wide(t.column(c)) for t in (guests, own) for c in ("shards", "to"))
        count, none = np.zeros(len(i), bool), np.iinfo(np.int64).max
        for a in range(0, len(i), 1 << 15):
            g, m = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            apart, first = common(homes[g], their_homes[m]) == none, common(to[g], their_homes[m]) == shard
            # Where each of the two visits the other, the visits of the smaller node count.
            count[a : a + (1 << 15)] = apart & first & ((asked[g] < ids[m]) | (common(their_to[m], homes[g]) == none))
        copies, guests_copies = own.column("copies").to_numpy(), guests.column("copies").to_numpy()
        here, there = np.bincount(j[count], guests_copies[i[count]], len(ids)), np.bincount(i[count], copies[j[count]], len(asked))
        root, guests_root = ids.copy(), asked.copy()
        while True:  # smallest node reachable by the links found
            low = np.minimum(guests_root, np.where(found, root[None, :], none).min(1))
            back = np.minimum(root, np.where(found, low[:, None], none).min(0))
            if (low == guests_root).all() and (back == root).all():
                break
            root, guests_root = back, low
        met, guests_met = found.any(0), found.any(1)
        columns = [(ids[met], asked[guests_met]), (here[met], there[guests_met]), (root[met], guests_root[guests_met])]
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], schema=schema)

    names = ["grp", "shard", "lo", "part", "id", "copies", "v", "shards", "to"]
    own = members.where("lo = hi").join(chosen.select("id", F.col("visits.shard").alias("to")), "id", "left")
    at_home = own.where(F.col("shard") == F.col("shards")[0]).select("grp", "id", "copies", "v", "shards", "to")
    guests = saved(at_home.join(chosen, "id").withColumn("visit", F.explode("visits")).select("grp", "id", "copies", "v", "shards", "to", "visit.shard", "visit.entry"))
    counts = guests.groupBy("grp", "shard").agg(F.count("*").alias("guests"))
    blocks = members.where("lo = hi").groupBy("grp", "shard").agg(F.collect_set("lo").alias("los"))
    keyed = saved(blocks.join(counts, ["grp", "shard"]).withColumn("parts", F.ceil(F.col("guests") / VISITORS).cast("int")))
    total = keyed.agg(F.sum("guests")).first()[0] or 0
    guests = join_keyed(guests, keyed, ["grp", "shard"], "guests", total)
    guests = guests.withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int")).withColumn("lo", F.explode("los"))
    own = own.join(keyed.select("grp", "shard", "parts"), ["grp", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["grp", "shard", "lo", "part"]
    return own.select(*names, "near").groupBy(*key).cogroup(guests.select(*names, "entry").groupBy(*key)).applyInArrow(run, "id long, n long, root long")


def renamed(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))


def linked(nodes: DataFrame) -> DataFrame:
    """``id, n, root`` of the nodes: what each finds in its own shards and in those that it visits."""
    members = saved(units(saved(shards_of(nodes))))
    members = saved(members.join(graph(members), "id", "left"))
    found = saved(links(members))
    visits = found.select("id", F.explode("visits").alias("w")).groupBy("id", "w.shard").agg(F.max(F.struct("w.score", "w.entry")).alias("best"))
    # A node's shards are few, and each gives at most VISITS.
    best = F.sort_array(F.collect_list(F.struct("best.score", "shard", "best.entry")), asc=False)
    chosen = saved(visits.groupBy("id").agg(F.slice(best, 1, VISITS).alias("visits")))
    found = found.drop("visits")
    return found.unionByName(saved(visited(members, chosen))) if chosen.limit(1).count() else found


def audit(rows: DataFrame, *, queries: int = AUDIT, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``grp, queries, pairs, found``: for each label and dimension, the links of up to ``queries`` fixed nodes in all its vectors, and how many of them ``duplicates`` finds.

    Unlike the audit of a shard, this sees pairs that share no shard and that no visit meets. The queries
    go out in blocks of at most SENT_BYTES; no task holds more than a batch of
    nodes beside them.
    """
    nodes = saved(nodes_of(renamed(rows, key, vector, label).where("vec_id is not null")))
    found = linked(nodes).groupBy("id").agg(F.sum("n").alias("found"))
    order = Window.partitionBy("grp").orderBy(F.xxhash64("id", F.lit(7)), "id")
    chosen = saved(nodes.withColumn("k", F.row_number().over(order)).where(F.col("k") <= queries).select("grp", "id", "v"))
    spark, parts, block = rows.sparkSession, [], []

    def part(block: list) -> DataFrame:
        mine: dict[str, list] = {}
        for row in block:
            mine.setdefault(row.grp, []).append(row)
        shared = spark.sparkContext.broadcast({g: (np.array([r.id for r in own]), np.array([r.v for r in own])) for g, own in mine.items()})

        def run(batches):
            for batch in batches:
                groups, ids, copies = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for g in dict.fromkeys(groups.tolist()):
                    at = np.flatnonzero(groups == g)
                    asked, x = shared.value[g]
                    near = (x @ as_matrix(batch.column(3).take(pa.array(at))).T >= COSINE) & (asked[:, None] != ids[at][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(near @ copies[at])], names=["id", "pairs"])

        return nodes.where(F.col("grp").isin(list(mine))).select("grp", "id", "copies", "v").mapInArrow(run, "id long, pairs long").groupBy("id").agg(F.sum("pairs").alias("pairs"))

    size = 0
    for row in chosen.orderBy("grp", "id").toLocalIterator():
        block.append(row)
        size += 8 * len(row.v)
        if size >= SENT_BYTES:
            parts.append(part(block))
            block, size = [], 0
    truth = part(block)
    for more in parts:
        truth = truth.union(more)
    per = chosen.select("grp", "id").join(truth, "id").join(found, "id", "left")
    return per.groupBy("grp").agg(F.count("*").alias("queries"), F.sum("pairs").alias("pairs"), F.sum(F.coalesce("found", F.lit(0))).cast("long").alias("found"))


def duplicates(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Rows are compared when their labels are equal and not null (and their
    vectors are of one length) and linked at a cosine of 0.93 or more. Vectors
    that are null, empty, zero, or hold null or non-finite components are
    linked with nothing; neither are rows with a null key. Repeated rows and
    equal vectors are linked with each other. Other columns are not read; an
    empty table gives an empty result.
    """
    named = renamed(rows, key, vector, label)
    nodes = saved(nodes_of(named.where("vec_id is not null")))
    found = linked(nodes)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = nodes.join(counts, "id").join(joined.withColumnRenamed("node", "id"), "id", "left")
    per = per.select("label", "raw", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = named.withColumn("raw", scaled("v")).join(per, ["label", "raw"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE d AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
v AS (SELECT * FROM d WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) n USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a) c USING (vec_id)
"""
