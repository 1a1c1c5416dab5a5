"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is the sequence of its words: runs of letters, lower-cased; a run of
more than ``LONGEST`` letters counts as several. A model predicts each letter,
and the end of the word, from up to ``ORDER - 1`` letters before it in the word.
Since a word's probability depends on nothing outside it, words are what
is counted: all words of all learnt documents, by language, as plain rows with
map-side sums. The n-grams come from the distinct words by DataFrame
operations: counts at the highest order, numbers of different predecessors
below, one discount for each language and order, and every stored
probability already interpolated with its shorter n-grams.

The model goes to the tasks as sorted arrays of n-gram hashes, one for each
order, beside a row of log-probabilities (and of back-off weights) by
language. That holds up to ``MODEL_BYTES``; a larger model stays a table, and
the distinct n-grams of the corpus are joined with it (``scores_by_joins``). The
way does not change a prediction; sums differ in the last digits only.

The language is the one of the lowest cross-entropy for each predicted
character. ``score`` is the probability that this is right, a logistic curve
over the evidence (number of characters times the distance of the second
language). The curve, and the cross-entropy above which a text is taken for
none of the languages (``rejected``: its score is at most 0.5), are calibrated
on documents that a second model, counted without them, has not seen:
all learnt ones whose crc32 of doc_id modulo 4 is ``FOLD``.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import bounded, join_keyed, saved
from .textblocks import Powers, Words, append, blocks, byte_values, give_back, mix

ORDER = 5
LONGEST = 64
HELD_OUT, FOLD = 2, 3
MODEL_BYTES = 48 << 20
TOKENS_KEPT = 1 << 18  # tokens that a task keeps: beyond, a counting task hands them on and a scoring task forgets
WIDTH = 4.0  # standard deviations above the mean cross-entropy at which a text is rejected
UNKNOWN = "und"


def fold_of(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 4; -1 for a null doc_id, which is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1))


def token_bytes() -> np.ndarray:
    """Bytes that may belong to a letter: ASCII letters and all that is not ASCII."""
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def letters(token: str) -> list[str]:
    """The lower-case words of a token: runs of letters and of the marks on them, in pieces of at most LONGEST."""
    token = token.lower()
    if token.isalpha():
        runs = [token]
    else:
        inside = lambda c: c.isalpha() or unicodedata.category(c)[0] == "M"
        runs = ["".join(run) for good, run in itertools.groupby(token, inside) if good]
        runs = [run for run in runs if any(map(str.isalpha, run))]
    return [run[k : k + LONGEST] for run in runs for k in range(0, len(run), LONGEST)]


class Tokens:
    """The distinct tokens of a block of texts."""

    def __init__(self) -> None:
        self.powers, self.values, self.table = Powers(), byte_values(True), token_bytes()

    def __call__(self, column: pa.Array):
        """For each block: first and end row, the tokens' bounds by row, and their hashes, with a function from places to strings."""
        for lo, hi, data, offsets in blocks(column):
            words = Words(data, offsets, self.table, self.values, self.powers)
            yield lo, hi, words, lambda at, data=data, words=words: [bytes(data[a:b]).decode() for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]


class Seen:
    """The tokens that a task has met: sorted hashes, and the place of each one's values in the order of arrival."""

    def __init__(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def places_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each of the distinct ``hashes``, and which of them are new: these get the next places."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        places = np.empty(len(hashes), np.int64)
        places[known] = self.places[at[known]]
        places[new] = len(self.hashes) + np.arange(len(new))
        both = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(both, kind="stable")
        self.hashes, self.places = both[order], np.concatenate([self.places, places[new]])[order]
        return places, new


def word_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", apart: str = "apart") -> DataFrame:
    """``lang, word, n, n_apart``: how often each word stands in the texts of a language, and in those marked ``apart``."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(apart).alias("apart")).where("lang is not null and text is not null")

    def count(batches):
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("n_apart", pa.int64())])

        def out():
            kept: dict = {}
            for (lang, token), n, apart in zip(met, *counts.tolist()):
                for word in letters(token):
                    cell = kept.setdefault((lang, word), [0, 0])
                    cell[0] += n + apart
                    cell[1] += apart
            both = np.array(list(kept.values()), np.int64).reshape(len(kept), 2)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

        tokens, seen, met, counts = Tokens(), Seen(), [], np.zeros((2, 0), np.int64)
        numbers: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            codes = np.array([numbers.setdefault(x, len(numbers)) for x in names], np.uint64)[langs.indices.to_numpy(zero_copy_only=False)]
            known = list(numbers)
            marks = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, words, strings in tokens(batch.column(0)):
                mine = words.rows()
                keys = mix(words.hashes + codes[lo:hi][mine] * np.uint64(0x9E3779B97F4A7C15))
                keys, where, back = np.unique(keys, return_index=True, return_inverse=True)
                places, new = seen.places_of(keys)
                met += zip([known[c] for c in codes[lo:hi][mine[where[new]]].tolist()], strings(where[new]))
                counts = np.concatenate([counts, np.zeros((2, len(new)), np.int64)], axis=1)
                for mark in (0, 1):
                    counts[mark, places] += np.bincount(back[marks[lo:hi][mine] == mark], minlength=len(keys))
                if len(met) > TOKENS_KEPT:
                    yield out()
                    seen, met, counts = Seen(), [], np.zeros((2, 0), np.int64)
        if met:
            yield out()
        del seen, met, counts
        give_back()

    found = rows.mapInArrow(count, "lang string, word string, n long, n_apart long")
    return saved(found.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("n_apart").alias("n_apart")))


def grams_of(word: str) -> str:
    """SQL for the n-grams of the highest order that predict a word's letters and its end; blanks stand before and after it."""
    return f"transform(sequence(1, length({word}) + 1), i -> substring(concat('{' ' * (ORDER - 1)}', {word}, ' '), i, {ORDER}))"


def model_of(words: DataFrame, count: str) -> DataFrame:
    """The models of all languages of ``words``, by interpolated Kneser-Ney: ``kind, lang, k, gram, value``.

    ``p``: the logarithm of an n-gram's probability. ``b``: that of the weight
    a context leaves to shorter n-grams; of the empty context: of the
    probability of a letter that the language does not know.
    """
    top = words.where(F.col(count) > 0).select("lang", F.explode(F.expr(grams_of("word"))).alias("gram"), F.col(count).alias("c"))
    top = saved(top.groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    # An n-gram of a lower order counts with the number of its different predecessors.
    suffixes = F.expr(f"transform(sequence(2, {ORDER}), k -> struct(k as k, right(gram, k) as gram))")
    longer = top.select("lang", F.explode(suffixes).alias("s")).select("lang", "s.*").distinct()
    lower = longer.groupBy("lang", (F.col("k") - 1).alias("k"), F.expr("right(gram, k - 1)").alias("gram")).agg(F.count("*").alias("c"))
    grams = saved(top.select("lang", F.lit(ORDER).alias("k"), "gram", "c").unionByName(lower).withColumn("context", F.expr("left(gram, k - 1)")))
    contexts = grams.groupBy("lang", "k", "context").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
    once, twice = F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))
    discounts = grams.groupBy("lang", "k").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("d"))
    contexts = saved(contexts.join(bounded(saved(discounts)), ["lang", "k"]).select("lang", "k", "context", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("left")))
    alphabet = grams.where("k = 1").select("gram").distinct().count() + 1
    shares = saved(grams.join(contexts, ["lang", "k", "context"]).select("lang", "k", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "left"))
    # Each n-gram meets its own suffixes; from the shortest on, each one's share is added to what it leaves to the shorter.
    wanted = shares.select("lang", "k", "gram", F.explode(F.expr("transform(sequence(1, k), j -> struct(j as j, right(gram, j) as suffix))")).alias("s")).select("lang", "k", "gram", "s.*")
    parts = wanted.join(shares.select("lang", F.col("k").alias("j"), F.col("gram").alias("suffix"), "own", "left"), ["lang", "j", "suffix"])
    parts = parts.groupBy("lang", "k", "gram").agg(F.array_sort(F.collect_list(F.struct("j", "own", "left"))).alias("parts"))
    value = F.expr(f"ln(aggregate(parts, {1 / alphabet}D, (p, s) -> s.own + s.left * p))")
    seen = parts.select(F.lit("p").alias("kind"), "lang", "k", "gram", value.alias("value"))
    unknown = F.when(F.col("k") == 1, F.log("left") - math.log(alphabet)).otherwise(F.log("left"))
    return saved(seen.unionByName(contexts.select(F.lit("b").alias("kind"), "lang", "k", F.col("context").alias("gram"), unknown.alias("value"))))


MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """By order (1 to ORDER) and place, the hash of the characters that end there; wrong where characters of another word are among them."""
    values = mix(codes.astype(np.uint64) + np.uint64(1))
    out = np.zeros((ORDER + 1, len(codes)), np.uint64)
    for k in range(1, ORDER + 1):
        out[k] = out[k - 1]
        out[k, k - 1 :] += values[: len(values) - k + 1] * MULTIPLIERS[k - 1]
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Model:
    """Sorted arrays of n-gram hashes by kind and order, each with a row of values by language."""

    def __init__(self, table: pa.Table, langs: list[str]) -> None:
        self.langs = langs
        number = {lang: i for i, lang in enumerate(langs)}
        self.tables = {}
        kinds, orders, of = (table.column(c).to_numpy() for c in ("kind", "k", "lang"))
        grams, values = table.column("gram").to_pylist(), table.column("value").to_numpy()
        of = np.array([number[x] for x in of], np.int64)
        for kind, k in itertools.product("pb", range(1, ORDER + 1)):
            rows = np.flatnonzero((kinds == kind) & (orders == k))
            size = k if kind == "p" else k - 1
            codes = codes_of("".join(grams[i] for i in rows.tolist()))
            hashes = gram_hashes(codes)[size, size - 1 :: size] if size else np.zeros(len(rows), np.uint64)
            keys, where = np.unique(hashes, return_inverse=True)
            cells = np.full((len(keys) + 1, len(langs)), np.nan if kind == "p" else 0.0, np.float32)
            cells[where, of[rows]] = values[rows]
            self.tables[kind, k] = keys, cells

    def find(self, kind: str, k: int, hashes: np.ndarray) -> np.ndarray:
        keys, cells = self.tables[kind, k]
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        if len(keys):
            at[keys[at] != hashes] = len(keys)
        return cells[at]

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        codes = codes_of("".join([" " * (ORDER - 1) + w + " " for w in words]))
        lengths = np.array([len(w) + ORDER for w in words])
        ends = np.cumsum(lengths)
        predicted = np.ones(len(codes), bool)
        predicted[((ends - lengths)[:, None] + np.arange(ORDER - 1)).ravel()] = False
        at = np.flatnonzero(predicted)
        hashes = gram_hashes(codes)
        _, where, back = np.unique(hashes[ORDER, at], return_index=True, return_inverse=True)
        at, out = at[where], None
        for k in range(1, ORDER + 1):
            seen = self.find("p", k, hashes[k, at])
            left = self.find("b", k, hashes[k - 1, at - 1])
            out = np.where(np.isnan(seen), left if out is None else left + out, seen)
        first = np.concatenate([[0], np.cumsum(lengths - ORDER + 1)[:-1]])
        return np.add.reduceat(out.astype(np.float64)[back], first)


def loaded(model: DataFrame, langs: list[str]) -> Model | None:
    """The model as arrays, or None if it is too large to be sent."""
    if model.count() * (8 + 4 * len(langs)) > MODEL_BYTES:
        return None
    return Model(model.toArrow(), langs)


def cross_entropies(docs: DataFrame, model: Model, *, text: str, keep: list[str]) -> DataFrame:
    """``docs`` with ``__n`` (predicted characters) and ``__lp`` (log-probability of the text by language)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # at most MODEL_BYTES, as plain arrays

    def make():
        tokens, model = Tokens(), Model.__new__(Model)
        vars(model).update(shared.value)
        seen, kept = Seen(), np.zeros((0, len(model.langs) + 1))

        def priced(strings):
            """Log-probability of each token by language, and its number of predicted characters."""
            runs = [letters(t) for t in strings]
            flat = [w for r in runs for w in r]
            out = np.zeros((len(runs), len(model.langs) + 1))
            cells = np.column_stack([model.words(flat), np.array([len(w) + 1 for w in flat], float)])
            np.add.at(out, np.repeat(np.arange(len(runs)), [len(r) for r in runs]), cells)
            return out

        def work(column):
            nonlocal seen, kept
            sizes, sums = [], []
            for lo, hi, words, strings in tokens(column):
                if len(kept) > TOKENS_KEPT:
                    seen, kept = Seen(), kept[:0]
                hashes, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                places, new = seen.places_of(hashes)
                kept = np.concatenate([kept, priced(strings(where[new]))])
                total = np.zeros((len(back) + 1, kept.shape[1]))
                np.cumsum(kept[places[back]], axis=0, out=total[1:])
                total = total[words.bounds[1:]] - total[words.bounds[:-1]]
                sizes.append(np.rint(total[:, -1]).astype(np.int64))
                sums.append(total[:, :-1])
            n, sums = np.concatenate(sizes or [np.zeros(0, np.int64)]), np.concatenate(sums or [np.zeros((0, len(model.langs)))])
            offsets = np.arange(len(n) + 1, dtype=np.int32) * len(model.langs)
            return [pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))]

        return work

    return append(docs, text, keep, make, "__n long, __lp array<double>")


def scores_by_joins(docs: DataFrame, model: DataFrame, langs: list[str], *, text: str, keep: list[str]) -> DataFrame:
    """As ``cross_entropies``, for a model that stays a table.

    The distinct words of the corpus open into distinct n-grams; these meet
    the model order by order, the words their n-grams, the documents their
    words. Hot n-grams and words are broadcast (``join_keyed``).
    """
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()))

    def count(batches):
        tokens = Tokens()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, words, strings in tokens(batch.column(1)):
                mine = words.rows()
                _, where, counts = np.unique(mix(words.hashes + mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                kept: dict = {}
                for row, token, n in zip(ids[lo:hi][mine[where]].tolist(), strings(where), counts.tolist()):
                    for word in letters(token):
                        kept[row, word] = kept.get((row, word), 0) + n
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.string()), pa.array(list(kept.values()), pa.int64())], names=["__row", "word", "n"])
        give_back()

    stands = saved(rows.select("__row", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(count, "__row long, word string, n long"))
    words = saved(stands.groupBy("word").agg(F.count("*").alias("rows")))
    opened = saved(words.select("word", F.explode(F.expr(grams_of("word"))).alias("gram")))
    grams = saved(opened.groupBy("gram").agg(F.count("*").alias("places")))
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    cells = model.groupBy("kind", "k", "gram").agg(F.map_from_entries(F.collect_list(F.struct(number[F.col("lang")], "value"))).alias("m"))
    cells = cells.select("kind", "k", "gram", F.expr(f"transform(sequence(0, {len(langs) - 1}), l -> m[l])").alias("v"))
    asked = grams.select("gram", F.explode(F.expr(f"transform(sequence(1, {ORDER}), k -> struct(k as k, right(gram, k) as p, left(right(gram, k), k - 1) as b))")).alias("s")).select("gram", "s.*")
    steps = asked.join(cells.where("kind = 'p'").select("k", F.col("gram").alias("p"), F.col("v").alias("seen")), ["k", "p"], "left")
    steps = steps.join(cells.where("kind = 'b'").select("k", F.col("gram").alias("b"), F.col("v").alias("left")), ["k", "b"], "left")
    steps = steps.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "seen", "left"))).alias("s"))
    value = f"transform(sequence(0, {len(langs) - 1}), l -> aggregate(s, 0D, (x, t) -> coalesce(t.seen[l], coalesce(t.left[l], 0D) + x)))"
    priced = saved(steps.select("gram", F.expr(value).alias("lp")).join(grams, "gram"))
    total = opened.count()
    sums = [F.sum(F.col("lp")[i]).alias(f"l{i}") for i in range(len(langs))]
    lps = F.array(*[f"l{i}" for i in range(len(langs))]).alias("lp")
    of_word = join_keyed(opened, priced, ["gram"], "places", total).groupBy("word").agg(F.count("*").alias("size"), *sums).select("word", "size", lps)
    of_word = saved(of_word.join(words, "word"))
    sums = [F.sum(F.col("n") * F.col("lp")[i]).alias(f"l{i}") for i in range(len(langs))]
    of_row = join_keyed(stands, of_word, ["word"], "rows", stands.count()).groupBy("__row").agg(F.sum(F.col("n") * F.col("size")).alias("__n"), *sums).select("__row", "__n", lps.alias("__lp"))
    return rows.join(of_row, "__row", "left").select(*keep, F.coalesce("__n", F.lit(0)).alias("__n"), "__lp")


def ranked(scored: DataFrame, langs: list[str]) -> DataFrame:
    """``scored`` with ``__best`` (number of the language), ``__ce`` (its cross-entropy) and ``__far`` (how far the text's evidence puts the second)."""
    order = F.expr("array_sort(transform(__lp, (x, i) -> struct(-x as cost, i as i)))")
    near = F.when(F.col("__n") > 0, order)
    out = scored.withColumn("__order", near)
    second = F.coalesce(F.get("__order", F.lit(1))["cost"] - F.get("__order", F.lit(0))["cost"], F.lit(float(LONGEST)))
    return out.select(*[c for c in scored.columns if c != "__lp"], F.get("__order", F.lit(0))["i"].alias("__best"), (F.get("__order", F.lit(0))["cost"] / F.col("__n")).alias("__ce"), F.log1p(second).alias("__far"))


class Calibration(NamedTuple):
    """``slope`` and ``base`` of the logistic curve; by language the cross-entropy above which a text is rejected."""

    slope: float
    base: float
    ceilings: list[float]


def calibrated(judged: DataFrame, langs: list[str]) -> Calibration:
    """From all rows with the true language ``lang`` and ``__best, __ce, __far``. Without rows: the plain evidence, no ceiling.

    Means and deviations are sums by language, each Newton step of the curve one sum over the table; only sums come to the driver.
    """
    ceilings = [math.inf] * len(langs)
    right = F.get(F.array(*map(F.lit, langs)), F.col("__best")) == F.col("lang")
    rows = saved(judged.where("__best is not null").select("__best", "__ce", "__far", right.alias("right")))
    good = F.when(F.col("right"), F.col("__ce"))
    sums = rows.groupBy("__best").agg(F.count("*").alias("all"), F.count(good).alias("n"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std")).collect()  # a row for each language
    if not sums:
        return Calibration(1.0, 0.0, ceilings)
    for r in sums:
        if r["n"] > 1:
            ceilings[r["__best"]] = float(r["mean"] + WIDTH * r["std"])
    n_right = sum(r["n"] for r in sums)
    n_wrong = sum(r["all"] for r in sums) - n_right
    # Smoothed targets and a weak pull to (1, 0) keep the curve finite where all are right.
    target = F.when(F.col("right"), (n_right + 1) / (n_right + 2)).otherwise(1 / (n_wrong + 2))
    far, w = F.col("__far"), np.array([1.0, 0.0])
    for _ in range(50):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), far * float(w[0]) + float(w[1])))
        step = rows.select("__far", target.alias("t"), (1 / (1 + F.exp(-z))).alias("p")).withColumn("v", F.expr("p * (1 - p)")).withColumn("e", F.expr("p - t"))
        e1, e0, v2, v1, v0 = step.agg(F.sum(F.col("e") * far), F.sum("e"), F.sum(F.col("v") * far * far), F.sum(F.col("v") * far), F.sum("v")).first()
        slope = np.array([e1, e0]) + 0.1 * (w - [1.0, 0.0])
        new = w - np.linalg.solve(np.array([[v2, v1], [v1, v0]]) + 0.1 * np.eye(2), slope)
        new = np.clip(new, [0.0, -20.0], [20.0, 20.0])  # more evidence never lowers the score
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return Calibration(float(w[0]), float(w[1]), ceilings)


def learnt(docs: DataFrame) -> tuple[DataFrame | None, list[str], Calibration]:
    """The model, its languages and the calibration, from the rows of ``docs`` that have a language and are not held out."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), fold_of(F.col("doc_id")).alias("fold")).where((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull())
    words = word_counts(rows.withColumn("apart", F.col("fold") == FOLD))
    langs = [r.lang for r in words.select("lang").distinct().orderBy("lang").collect()]  # the classes
    if not langs:
        return None, [], Calibration(1.0, 0.0, [])
    model = model_of(words, "n")
    seen = words.select("lang", (F.col("n") - F.col("n_apart")).alias("n"), "word").where("n > 0")
    if not seen.limit(1).count():
        return model, langs, Calibration(1.0, 0.0, [math.inf] * len(langs))
    asked = rows.where((F.col("fold") == FOLD) & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    return model, langs, calibrated(ranked(scored(asked, model_of(seen, "n"), langs, text="text", keep=["lang"]), langs), langs)


def scored(docs: DataFrame, model: DataFrame, langs: list[str], *, text: str, keep: list[str]) -> DataFrame:
    sent = loaded(model, langs)
    if sent is None:
        return scores_by_joins(docs, model, langs, text=text, keep=keep)
    return cross_entropies(docs, sent, text=text, keep=keep)


def identify(docs: DataFrame, model: DataFrame | None, langs: list[str], calibration: Calibration, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    A text that is null or has no letter is ``und``, with score 0 and rejected; so is every
    text where nothing was learnt. Of languages at one cross-entropy the first by name wins.
    """
    if not langs:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    out = ranked(scored(docs, model, langs, text=text, keep=keep), langs)
    none = F.col("__best").isNull()
    ceiling = F.get(F.array(*[F.lit(float(c)) for c in calibration.ceilings]), F.col("__best"))
    rejected = F.coalesce(F.col("__ce") > ceiling, F.lit(True))
    sure = 1 / (1 + F.exp(-(F.lit(calibration.slope) * F.col("__far") + F.lit(calibration.base))))
    score = F.when(none, 0.0).when(rejected, F.least(sure, F.lit(0.5))).otherwise(sure)
    name = F.when(none, UNKNOWN).otherwise(F.get(F.array(*[F.lit(lang) for lang in langs]), F.col("__best")))
    return out.select(*keep, name.alias("lang_pred"), score.alias("score"), F.col("__ce").alias("cross_entropy"), rejected.alias("rejected"))


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected`` for each row of ``docs``, learnt from its rows that are not held out.

    Null languages are not learnt; a null doc_id is learnt from. Repeated rows
    count as often as they stand. An empty table gives no rows; further columns are not looked at.
    """
    model, langs, calibration = learnt(docs)
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, langs, calibration, keep=["doc_id"])
    return out.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
