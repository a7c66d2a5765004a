"""License scans with a generalised suffix automaton of template words.

The automaton knows every run of words of every template. A file's words are
streamed through it and give matching statistics: the longest run that ends at
each word and occurs in some template. Phrases are read off the automaton's
states; long maximal matches are chained per template, in order in the file and
in the template, into covered spans.
"""

from __future__ import annotations

import pkgutil
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.llm.textbytes import ALNUM, hashed_words

#: Phrases that decide a label by themselves.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


def _templates() -> tuple[tuple[str, str], ...]:
    """Labels and texts of ``data/licences.txt``."""
    blocks = pkgutil.get_data(__package__, "data/licences.txt").decode().split("\n== ")[1:]
    return tuple((label.strip(), text.strip()) for label, _, text in (x.partition("\n") for x in blocks))


#: Whole texts of short licences, and the notices that longer ones ask files to carry.
TEMPLATES = _templates()

#: Shortest match that a chain may hold, the widest gap in it (words, in file and template), and the share of a template that gives its label.
LEAST_MATCH, GAP, COVER = 4, 8, 0.75


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.at: list[dict[int, list[int]]] = [{}]  # of each state that a match can end in: sequence -> where its occurrences there end
        for k, sequence in enumerate(sequences):
            last = 0
            for i, x in enumerate(sequence):
                last = self._extend(last, x)
                v = last
                while v > 0 and self.length[v] >= LEAST_MATCH:
                    self.at[v].setdefault(k, []).append(i)
                    v = self.link[v]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.at.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        """A state for the shorter runs of ``q``, those that ``p`` reaches by ``x``."""
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        if self.length[c] >= LEAST_MATCH:
            self.at[c] = {k: list(ends) for k, ends in self.at[q].items()}
        self.link[q] = c
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, x: int) -> int:
        if (q := self.next[last].get(x)) is not None:  # known from another sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, x)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word the state and the length of the longest run that ends there."""
        state, n = 0, 0
        for x in words:
            while state and x not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (to := self.next[state].get(x)) is not None:
                state, n = to, n + 1
            yield state, n


def _numbered(texts: tuple[str, ...]) -> tuple[np.ndarray, list[list[int]]]:
    """Sorted hashes of the words of all texts, and each text as numbers: a word's place among them."""
    hashes = [x[3] for x in hashed_words(pa.array(texts), ALNUM, lower=True)]
    counts = np.concatenate([x[2] for x in hashed_words(pa.array(texts), ALNUM, lower=True)])
    every = np.concatenate(hashes)
    known = np.unique(every)
    numbers = np.searchsorted(known, every)
    return known, [x.tolist() for x in np.split(numbers, np.cumsum(counts)[:-1])]


class Cover:
    """Intervals, asked whether one of them holds another; a tree of the farthest ends by first word."""

    def __init__(self, firsts):
        self.firsts = sorted(set(firsts))
        self.far = [-1] * (len(self.firsts) + 1)

    def holds(self, first: int, last: int) -> bool:
        i = bisect_right(self.firsts, first)
        while i:
            if self.far[i] >= last:
                return True
            i -= i & -i
        return False

    def add(self, first: int, last: int) -> None:
        i = bisect_right(self.firsts, first)
        while i < len(self.far):
            self.far[i] = max(self.far[i], last)
            i += i & -i


def outermost(chains: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Chains (first, last, words), better ones first, without those inside a better one; in the order of their places."""
    kept, out = Cover(x[0] for x in chains), []
    for x in chains:
        if not kept.holds(x[0], x[1]):
            kept.add(x[0], x[1])
            out.append(x)
    return sorted(out)


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = tuple(t for _, t in templates) + tuple(p for _, p in phrases)
        self.known, sequences = _numbered(texts)
        self.labels = [label for label, _ in templates]
        self.sizes = [len(s) for s in sequences[: len(templates)]]
        self.automaton = a = Automaton(sequences)
        # phrases that end in each state: those of its suffix chain that are short enough
        own: dict[int, list[int]] = defaultdict(list)
        self.phrase_labels = [label for label, _ in phrases]
        self.phrase_sizes = []
        rare = set()
        for k, s in enumerate(sequences[len(templates) :]):
            self.phrase_sizes.append(len(s))
            rare.add(s[-1])
            state = 0
            for x in s:
                state = a.next[state][x]
            own[state].append(k)
        self.ending: list[tuple[int, ...]] = []
        for v in range(len(a.next)):
            found, u = [], v
            while u > 0:
                found += own.get(u, [])
                u = a.link[u]
            self.ending.append(tuple(found))
        self.last_words = np.array(sorted(rare))
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no template has."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        may = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.known, hashes[may])
        at[at == len(self.known)] = 0
        out[may] = np.where(self.known[at] == hashes[may], at, -1)
        return out

    def runs(self, numbers: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of known words inside rows that can hold a phrase or a long match; elsewhere the statistics are below both."""
        known = numbers >= 0
        opens = known.copy()
        opens[1:] &= ~known[:-1]
        firsts = bounds[:-1][bounds[:-1] < len(known)]
        opens[firsts] = known[firsts]
        closes = known.copy()
        closes[:-1] &= ~known[1:]
        lasts = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        closes[lasts] = known[lasts]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        marked = np.concatenate([[0], np.cumsum(np.isin(numbers, self.last_words))])
        want = (e - s >= LEAST_MATCH) | (marked[e] > marked[s])
        return zip(s[want].tolist(), e[want].tolist())

    def scan(self, words: list[int], offset: int, places: list, matches: list) -> None:
        """Adds places (phrase, first word) and maximal matches (end in file, length, state) of one run."""
        held = None
        for i, (state, n) in enumerate(self.automaton.stream(words)):
            for k in self.ending[state]:
                if n >= self.phrase_sizes[k]:
                    places.append((k, offset + i + 1 - self.phrase_sizes[k]))
            if held and n <= held[1] and held[1] >= LEAST_MATCH:
                matches.append((offset + i - 1, held[1], held[0]))
            held = (state, n)
        if held and held[1] >= LEAST_MATCH:
            matches.append((offset + len(words) - 1, held[1], held[0]))

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains as (template, first word, last word, share of the template), the best chain of each place.

        A match stands at every place that its run has in a template. Each extends the chain that covers most with it, of all whose ends are within ``GAP``.
        """
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, n, state in matches:
            for k, ends in self.automaton.at[state].items():
                if k < len(self.labels):
                    by[k] += [(end + 1 - n, at + 1 - n, n) for at in ends]
        out = []
        for k, found in by.items():
            found.sort()
            covered, before, near = [], [], []  # words of the best chain to each match, the match before it, matches that may be extended
            for m, (first, at, n) in enumerate(found):
                near = [c for c in near if first - found[c][0] - found[c][2] <= GAP]
                best, link = n, -1
                for c in near:
                    last, reached = found[c][0] + found[c][2], found[c][1] + found[c][2]
                    over = max(0, last - first, reached - at)
                    if n > over and at - reached <= GAP and covered[c] + n - over > best:
                        best, link = covered[c] + n - over, c
                covered.append(best)
                before.append(link)
                near.append(m)
            taken: set[int] = set()
            chains: list[tuple[int, int, int]] = []  # first, last, words covered
            for m in sorted(range(len(found)), key=lambda m: (-covered[m], m)):
                if m in taken:
                    continue
                c = first = m
                while c >= 0 and c not in taken:
                    taken.add(c)
                    first, c = c, before[c]
                chains.append((found[first][0], found[m][0] + found[m][2] - 1, covered[m] - (covered[c] if c >= 0 else 0)))
            # a weaker chain inside a better one is the same place again
            out += [(k, a, b, words) for a, b, words in outermost(chains)]
        # wording that licences share belongs to the one that a place holds most of
        wide = [x for x in sorted(out, key=lambda x: -x[3]) if x[3] >= COVER * self.sizes[x[0]]]
        kept = Cover(x[1] for x in out)
        inside = set()
        for words, group in groupby(wide, key=lambda x: x[3]):
            same = list(group)
            inside.update(x for x in same if kept.holds(x[1], x[2]))
            for x in same:
                kept.add(x[1], x[2])
        return [(k, a, b, min(1.0, words / self.sizes[k])) for k, a, b, words in out if (k, a, b, words) not in inside]


@lru_cache(maxsize=2)
def _scanner(phrases, templates) -> Scanner:
    return Scanner(phrases, templates)


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])
SCHEMA = "n_words long, places array<struct<label: string, word: bigint>>, spans array<struct<label: string, first_word: bigint, last_word: bigint, coverage: double>>"


def _scanned(phrases, templates):
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(phrases, templates)
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            places: list[list] = [[] for _ in range(batch.num_rows)]
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j, counts, hashes in hashed_words(batch.column(1), ALNUM, lower=True):
                n[i:j] = counts
                bounds = np.concatenate([[0], np.cumsum(counts)])
                numbers = scanner.numbers(hashes)
                matches: dict[int, list] = defaultdict(list)
                for s, e in scanner.runs(numbers, bounds):
                    row = int(np.searchsorted(bounds, s, side="right")) - 1
                    found: list[tuple[int, int]] = []
                    scanner.scan(numbers[s:e].tolist(), s - int(bounds[row]), found, matches[row])
                    places[i + row] += [{"label": scanner.phrase_labels[k], "word": w} for k, w in found]
                for row, found in matches.items():
                    spans[i + row] = [{"label": scanner.labels[k], "first_word": a, "last_word": b, "coverage": c} for k, a, b, c in scanner.spans(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(places, place_type), pa.array(spans, pa.list_(SPAN))], ["doc_id", "n_words", "places", "spans"])

    return run


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``docs (doc_id, text, ...)`` to ``(doc_id, n_words, places, spans)``, one row per input row.

    ``places`` are all places of phrases (label, first word), ``spans`` the chains
    of long matches of templates (label, first and last word, share of the template
    covered). Null and empty texts have none of either. Whole texts are streamed;
    repeated rows have equal results; further columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scanned(tuple(phrases), tuple(templates)), f"doc_id {kind}, {SCHEMA}")


def labelled(found: DataFrame, cover: float = COVER) -> DataFrame:
    """The digest of ``scan``: counts, first and last place, labels of phrases, all labels, and the largest share covered (1 where a phrase stands)."""
    texts = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.transform("places", lambda p: p["label"])
    wide = F.transform(F.filter("spans", lambda s: s["coverage"] >= cover), lambda s: s["label"])
    at = F.transform("places", lambda p: p["word"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), texts(base).alias("base_labels"), texts(F.concat(base, wide)).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))
