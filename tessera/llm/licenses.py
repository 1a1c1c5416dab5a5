"""License scan: matching statistics of documents against a generalised suffix automaton of licence words.

The automaton is built over the words of all templates (whole licence texts, a
few thousand words, fixed), base phrases included. A document's words are numbered by the template
vocabulary; only runs of neighbouring words that also stand side by side in a
template are streamed through the automaton, since any match of two words or
more lies in such a run. At each word the automaton knows the longest suffix
that stands in a template. Phrase occurrences are read off exactly; long
matches of one template are chained in template order into covered spans. A
string that stands several times in a template may be chained at any of its places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .textblocks import Member, Powers, Words, append, blocks, byte_values, letter_words

# Phrases with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEMPLATES = [(label, " ".join(WORD.findall(text.translate(FOLD)))) for label, text in TEXTS]
LONG, GAP, COVER = 6, 8, 10  # words of a long match, words between chained matches, words that a chain must cover to give its label
FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,covered:long,coverage:double>>"


class Automaton:
    """Generalised suffix automaton; each state keeps all places (text, last word) where its strings end."""

    def __init__(self, texts: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            state = 0
            for word in text:
                state = self.extend(state, word)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for number, text in enumerate(texts):
            state = 0
            for place, word in enumerate(text):
                state = at = self.next[state][word]
                while at:
                    self.ends[at].append((number, place))
                    at = self.link[at]

    def add(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def split(self, parent: int, word: int) -> int:
        """The state of the string of ``parent`` and ``word``, made separate where it is shorter than the state reached."""
        target = self.next[parent][word]
        if self.length[target] == self.length[parent] + 1:
            return target
        clone = self.add(self.length[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while parent >= 0 and self.next[parent].get(word) == target:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self.split(last, word)
        state = self.add(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        self.link[state] = 0 if last < 0 else self.split(last, word)
        return state

    def stream(self, words: list[int]):
        """The state and the length of the longest match that ends at each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                length = 0
            yield state, length


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES) -> None:
        self.powers, self.values, self.table = Powers(), byte_values(True), letter_words()
        texts = [p.split() for p, _ in phrases] + [t.split() for _, t in templates]
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.sizes, self.phrases = [len(t) for t in texts], len(phrases)
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        coded = [[number[w] for w in t] for t in texts]
        self.automaton = Automaton(coded)
        column = pa.array([" ".join(vocabulary)])
        _, _, data, offsets = next(blocks(column))
        hashes = Words(data, offsets, self.table, self.values, self.powers).hashes
        order = np.argsort(hashes)
        self.vocabulary, self.numbers = Member(hashes), order
        self.side = np.zeros((len(vocabulary), len(vocabulary)), bool)
        for t in coded:
            self.side[t[:-1], t[1:]] = True
        # For each state, the phrases that its strings end with.
        self.closed = [[p for p in range(self.phrases) if self.ends_phrase(state, p)] for state in range(len(self.automaton.next))]

    def ends_phrase(self, state: int, phrase: int) -> bool:
        while state > 0:
            if self.automaton.length[state] == self.sizes[phrase] and (phrase, self.sizes[phrase] - 1) in self.automaton.ends[state]:
                return True
            state = self.automaton.link[state]
        return False

    def __call__(self, column: pa.Array):
        for lo, hi, data, offsets in blocks(column):
            words = Words(data, offsets, self.table, self.values, self.powers)
            at = self.vocabulary.find(words.hashes)
            code = self.numbers[np.searchsorted(self.vocabulary.table, words.hashes[at])]
            rows = np.searchsorted(words.bounds, at, "right") - 1
            beside = np.zeros(len(at) + 1, bool)
            beside[1:-1] = (at[1:] == at[:-1] + 1) & (rows[1:] == rows[:-1]) & self.side[code[:-1], code[1:]] if len(at) > 1 else False
            in_run = beside[:-1] | beside[1:]
            begins = np.flatnonzero(in_run & ~beside[:-1])
            ends = np.flatnonzero(in_run & ~beside[1:]) + 1
            found: dict[int, tuple[list, list]] = {}
            for a, b in zip(begins.tolist(), ends.tolist()):
                row = int(rows[a])
                hits, matches = found.setdefault(row, ([], []))
                self.run(code[a:b].tolist(), int(at[a] - words.bounds[row]), hits, matches)
            for row in range(hi - lo):
                yield int(words.bounds[row + 1] - words.bounds[row]), *found.get(row, ((), ()))

    def run(self, codes: list[int], first: int, hits: list, matches: list) -> None:
        """Phrase places to ``hits``; maximal matches of LONG words or more, as (first word, words, places in templates), to ``matches``."""
        before = None
        for i, (state, length) in enumerate(self.automaton.stream(codes)):
            for p in self.closed[state]:
                if self.sizes[p] <= length:
                    hits.append((first + i - self.sizes[p] + 1, p))
            if before and before[1] >= LONG and length <= before[1]:
                self.keep(first + i - 1, before, matches)
            before = state, length
        if before and before[1] >= LONG:
            self.keep(first + len(codes) - 1, before, matches)

    def keep(self, last: int, match: tuple[int, int], matches: list) -> None:
        state, length = match
        matches.append((last - length + 1, length, [(t, end - length + 1) for t, end in self.automaton.ends[state] if t >= self.phrases]))

    def chains(self, matches: list) -> list[dict]:
        """Spans of one template: matches in its order, at most GAP words apart in the text and in the template, the best ones that do not overlap in the text."""
        out = []
        for t in sorted({t for _, _, places in matches for t, _ in places}):
            links: list[list] = []  # end in the text, end in the template, words covered up to here, first word, whether it goes on
            for first, n, places in matches:
                back = [k for k in range(max(0, len(links) - 64), len(links)) if 0 <= first - links[k][0] <= GAP]
                for place in (p for number, p in places if number == t):
                    before = max((k for k in back if 0 <= place - links[k][1] <= GAP), key=lambda k: links[k][2], default=None)
                    covered, start = (0, first) if before is None else links[before][2:4]
                    if before is not None:
                        links[before][4] = True
                    links.append([first + n, place + n, covered + n, start, False])
            taken: list[tuple[int, int]] = []
            for end, _, covered, start, _ in sorted((x for x in links if not x[4]), key=lambda x: (-x[2], x[3])):
                if covered >= min(COVER, self.sizes[t]) and all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    out.append({"label": self.labels[t], "first_word": start, "n_words": end - start, "covered": covered, "coverage": covered / self.sizes[t]})
        return sorted(out, key=lambda s: (s["first_word"], -s["covered"], s["label"]))


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with phrase places, labels, score and covered template spans.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` come from the
    base phrases alone. ``labels`` adds the templates of which a chain covers
    COVER words. ``score`` is 1 - (1 - b)(1 - c), where c is the best chain's
    share of its template and b is a half with a base phrase; c and b are 0 without. A null or empty text has no words, no
    places (nulls) and empty labels. Repeated rows are scanned alike; columns
    of ``docs`` with the names of the result are replaced.
    """

    def make():
        scanner = Scanner()

        def work(column):
            out: list[list] = [[] for _ in range(8)]
            for n, hits, matches in scanner(column):
                spans = scanner.chains(matches) if matches else []
                base = {scanner.labels[p] for _, p in hits}
                places = [place for place, _ in hits]
                row = n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s["label"] for s in spans})), 1 - (0.5 if base else 1.0) * (1 - min(1.0, max((s["coverage"] for s in spans), default=0.0))), spans
                for to, x in zip(out, row):
                    to.append(x)
            span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())]))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span
            return [pa.array(x, kind) for x, kind in zip(out, kinds)]

        return work

    return append(docs, text, docs.columns if keep is None else keep, make, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, keep=["doc_id"]).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.col("score"))
