"""Order-preserving packing of token streams by dynamic programming.

Each task packs its own rows in their order, so no shuffle is needed. Texts are
cut into chunks of white space and what follows it: the tokenizer never joins
tokens across such a cut, so each distinct chunk is tokenised once and its ids
are looked up after that. Strings of the tokenizer's special tokens are chunks of
their own and become these tokens, as in a plain call. The token stream of a task is then packed in runs of
about ``RUN`` tokens: allowed cuts are ends of documents and sentences (in longer
sentences also every 256 tokens), and the program chooses windows of at most
``window`` tokens that minimise padding, the cost of a sequence and penalties for
cutting documents and sentences. The last, unfinished window of a run opens the
next, so runs leave no seam.

Transitions: with f the least cost up to a cut and p its position, a padded
window that ends at q costs f + p + (window - q) and so needs the least f + p of
the cuts within reach, kept in a monotone queue; windows of a power of two are not
padded and are looked up directly.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.llm.textbytes import GROUP_BYTES, column_bytes, groups, span_hashes

WINDOW = 1024
RUN = 1 << 17
SEQUENCE_COST, DOCUMENT_CUT, SENTENCE_CUT, STEP = 16, 4, 64, 256
END = 0
#: Chunks and ids that a worker's cache holds: 32 MB.
SLOTS = 1 << 20
POOL = 4_000_000


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokenizer:
    """Ids of texts, exactly as the tokenizer gives them for each whole text.

    The cache is a direct-mapped table of ``SLOTS`` chunk hashes; a chunk that
    meets a taken slot replaces what was there, so memory stays fixed.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(x.lstrip or x.rstrip or x.single_word or re.search(r"\s", x.content) for x in added):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        longest = sorted((x.content.encode() for x in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.forget()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token[-1] in ".!?Ċ"  # the last is how byte-level vocabularies write a line feed
        self.ends[END] = False
        self.bytes = np.zeros(len(self.ends), dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # byte-level: a character is a byte

    def forget(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.at = np.zeros(SLOTS, dtype=np.int32)
        self.size = np.zeros(SLOTS, dtype=np.int32)
        self.pool = np.zeros(POOL, dtype=np.int32)
        self.used = 0

    def _fresh(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, each one's number of ids, and where they stand.

        Chunks that open with white space and end in a solid character are
        tokenised side by side in one string; where one ends follows from the
        tokens' bytes. The others go one by one.
        """
        data = buf.tobytes()
        solid = _solid(buf)
        side = (buf[s] <= 0x20) & solid[e - 1]
        pieces = [data[a:b].decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist())]
        lens = np.zeros(len(s), dtype=np.int32)
        kept: list[np.ndarray | None] = [None] * len(s)
        for k, x in zip(np.flatnonzero(~side).tolist(), self.tokenizer.encode_batch_fast([pieces[k] for k in np.flatnonzero(~side)], add_special_tokens=False)):
            kept[k] = np.array(x.ids, dtype=np.int32)
            lens[k] = len(kept[k])
        joined = np.flatnonzero(side)
        for at in range(0, len(joined), 2048):
            rows = joined[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([pieces[k] for k in rows])], add_special_tokens=False)[0].ids, dtype=np.int32)
            stops = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(e[rows] - s[rows])) + 1
            lens[rows] = np.diff(stops, prepend=0)
            kept[rows[0]] = ids
        # side-by-side chunks come first in the pool, then the others
        order = np.concatenate([joined, np.flatnonzero(~side)])
        flat = [x for k in order.tolist() if (x := kept[k]) is not None]
        where = np.zeros(len(s), dtype=np.int64)
        where[order] = np.cumsum(lens[order], dtype=np.int64) - lens[order]
        return np.concatenate(flat), lens, where

    def _added_spans(self, buf: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where strings of added tokens stand within rows: the tokenizer takes them out before it splits the rest."""
        if self.added is None:
            return
        data, at = buf.tobytes(), 0
        while m := self.added.search(data, at):
            end = int(ends[np.searchsorted(ends, m.start(), side="right")])  # of its row
            if m.end() > end:
                m = self.added.search(data, m.start(), end)  # a shorter one may fit
            if m:
                yield m.span()
            at = m.end() if m else end

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows ``buf[starts[i]:ends[i]]`` in order, and each row's number of ids."""
        if not len(buf):
            return np.zeros(0, dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
        cut = chunk_starts(buf)
        cut[starts[ends > starts]] = True
        for a, b in self._added_spans(buf, ends):
            cut[a] = True
            if b < len(buf):
                cut[b] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(buf))
        h = span_hashes(buf, s, e)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = (self.keys[slot] == h) & (self.size[slot] > 0)
        at, size = self.at[slot], self.size[slot]
        pool = self.pool
        if not hit.all():
            miss = np.flatnonzero(~hit)
            fresh, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[first]
            ids, lens, where = self._fresh(buf, s[first], e[first])
            if self.used + len(ids) <= POOL:
                base = self.used
                pool[base : base + len(ids)] = ids
                self.used += len(ids)
                to = (fresh & np.uint64(SLOTS - 1)).astype(np.int64)
                last = np.unique(to[::-1], return_index=True)[1]
                keep = len(to) - 1 - last  # one chunk a slot
                self.keys[to[keep]], self.at[to[keep]], self.size[to[keep]] = fresh[keep], base + where[keep], lens[keep]
            else:  # this call's chunks stand behind the pool; the next call starts an empty cache
                base = len(pool)
                pool = np.concatenate([pool, ids])
                self.forget()
            at, size = at.copy(), size.copy()
            at[miss], size[miss] = base + where[back], lens[back]
        total = np.cumsum(size, dtype=np.int64)
        n = int(total[-1])
        out = pool[np.repeat(at - (total - size), size) + np.arange(n)]
        row = np.concatenate([[0], total])[np.searchsorted(s, np.append(starts, len(buf)))]
        return out, np.diff(row)


def _solid(buf: np.ndarray) -> np.ndarray:
    """Flags last bytes of characters that are surely not white space."""
    solid = (buf > 0x20) & (buf < 0x7F)
    solid[1:] |= (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)  # first byte of a two-byte letter
    return solid


def chunk_starts(buf: np.ndarray) -> np.ndarray:
    """Flags bytes that open a chunk: a space or line feed after a character that is surely not white space.

    The tokenizer's pattern lets only a token's first character be white space
    unless the whole token is, and it decides on a run of white space by the run
    and the character after it, which a chunk holds together.
    """
    space = (buf == 0x20) | (buf == 0x0A)
    cut = np.zeros(len(buf), dtype=bool)
    cut[1:] = space[1:] & _solid(buf)[:-1]
    cut[0] = True
    return cut


def cuts(lengths: np.ndarray, sentence_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts and their penalties in a run; ``lengths`` of its documents, positions after sentence ends."""
    doc = np.cumsum(lengths)
    grid = np.arange(0, total + STEP, STEP)
    cost = {"doc": 0, "sentence": DOCUMENT_CUT, "grid": DOCUMENT_CUT + SENTENCE_CUT}
    marks = np.unique(np.concatenate([[0], doc, sentence_ends, [total]]))
    marks = marks[marks <= total]
    far = np.flatnonzero(np.diff(marks) > STEP)
    if len(far):
        extra = np.concatenate([grid[np.searchsorted(grid, marks[k], "right") : np.searchsorted(grid, marks[k + 1])] for k in far])
        at = np.union1d(marks, extra)
    else:
        at = marks
    penalty = np.full(len(at), cost["grid"])
    penalty[np.isin(at, sentence_ends)] = cost["sentence"]
    penalty[np.isin(at, doc)] = cost["doc"]
    penalty[0] = 0
    return at, penalty


def best_windows(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices into ``at`` of the chosen cuts, first and last included. Neighbouring cuts are at most ``window`` apart."""
    n = len(at)
    ends, starts = [], []  # windows of a power of two
    for k in range(window.bit_length()):
        i = np.searchsorted(at, at - (1 << k))
        j = np.flatnonzero((at >= 1 << k) & (at[i] == at - (1 << k)))
        ends.append(j)
        starts.append(i[j])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    bounds = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    exact = starts[order].tolist()
    p, c = at.tolist(), (penalty + SEQUENCE_COST).tolist()
    f, back = [0] * n, [0] * n
    reach: deque[tuple[int, int]] = deque()  # (f + p, cut), rising
    pop, popleft, push = reach.pop, reach.popleft, reach.append
    low = bounds[1]
    for j in range(1, n):
        i = j - 1
        g = f[i] + p[i]
        while reach and reach[-1][0] >= g:
            pop()
        push((g, i))
        q = p[j]
        least = q - window
        while p[reach[0][1]] < least:
            popleft()
        best, i = reach[0]
        best -= least
        high = bounds[j + 1]
        while low < high:
            k = exact[low]
            if f[k] < best:
                best, i = f[k], k
            low += 1
        f[j], back[j] = best + c[j], i
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class Packer:
    """Packs one task's documents; ``task`` makes sequence ids unique."""

    def __init__(self, ends: np.ndarray, window: int, task: int):
        self.ends, self.window, self.next = ends, window, task << 33
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # id, start of what is held, length held, all tokens
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), RUN):  # a document of any length is fed in runs
            part = ids[at : at + RUN]
            self.ids.append(part)
            self.docs.append((doc_id, at, len(part), len(ids)))
            self.held += len(part)
            if self.held >= RUN:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        total = len(ids)
        lengths = np.array([d[2] for d in self.docs])
        stops = np.cumsum(lengths)
        # a part that is not the end of its document does not end there
        whole = np.array([d[1] + d[2] == d[3] for d in self.docs])
        at, penalty = cuts(lengths, np.flatnonzero(self.ends[ids]) + 1, total)
        penalty[np.isin(at, stops[~whole])] = DOCUMENT_CUT + SENTENCE_CUT
        chosen = at[best_windows(at, penalty, self.window)]
        if not last:
            chosen = chosen[:-1]
        upto = int(chosen[-1]) if len(chosen) > 1 else 0
        if upto:
            firsts = stops - lengths
            cut = np.union1d(chosen, np.append(firsts[firsts < upto], upto))
            owner = np.searchsorted(stops, cut[:-1], side="right")
            sequence = np.searchsorted(chosen, cut[:-1], side="right") - 1
            raw = ids[:upto].astype("<u4").tobytes()
            for a, b, k, s in zip(cut[:-1].tolist(), cut[1:].tolist(), owner.tolist(), sequence.tolist()):
                doc_id, first, _, tokens = self.docs[k]
                yield doc_id, first + a - int(firsts[k]), b - a, zlib.crc32(raw[4 * a : 4 * b]), tokens, self.next + s, a - int(chosen[s])
            self.next += len(chosen) - 1
        if upto < total:
            k = int(np.searchsorted(stops, upto, side="right"))
            doc_id, first, n, tokens = self.docs[k]
            skip = upto - int(stops[k] - lengths[k])
            self.docs = [(doc_id, first + skip, n - skip, tokens), *self.docs[k + 1 :]]
            self.ids, self.held = [ids[upto:]], total - upto
        else:
            self.docs, self.ids, self.held = [], [], 0


@lru_cache(maxsize=1)
def _tokenizer(file: str) -> ChunkTokenizer:
    return ChunkTokenizer(file)


def documents_ids(tokenizer: ChunkTokenizer, column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's ids and the end id; long texts are tokenised in parts of whole chunks."""
    data, starts, ends = column_bytes(column)
    for i, j in groups(starts, ends):
        low, high = int(starts[i]), int(ends[j - 1])
        if high - low <= 2 * GROUP_BYTES:
            ids, counts = tokenizer.encode(data[low:high], starts[i:j] - low, ends[i:j] - low)
            at = np.concatenate([[0], np.cumsum(counts)])
            for k in range(j - i):
                yield np.append(ids[at[k] : at[k + 1]], np.int32(END))
        else:
            text = data[low:high]
            opens = np.append(np.flatnonzero(chunk_starts(text)), len(text))
            parts, a = [], 0
            while a < len(text):
                b = int(opens[max(np.searchsorted(opens, a + GROUP_BYTES, "right") - 1, np.searchsorted(opens, a, "right"))])
                parts.append(tokenizer.encode(text[a:b], np.array([0]), np.array([b - a]))[0])
                a = b
            yield np.append(np.concatenate(parts), np.int32(END))


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _packed(file: str, window: int):
    def run(batches):
        from pyspark import TaskContext

        tokenizer = _tokenizer(file)
        packer = Packer(tokenizer.ends, window, TaskContext.get().partitionId())
        rows: list[tuple] = []

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], FIELDS)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), documents_ids(tokenizer, batch.column(1))):
                rows += packer.add(doc_id, ids)
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
        rows += packer.flush(True)
        if rows:
            yield table(rows)

    return run


def pack(docs: DataFrame, file: str | None = None, window: int = WINDOW) -> DataFrame:
    """``docs (doc_id, text, ...)`` to one row per piece: ``FIELDS``.

    A null or empty text is the end id alone. Rows keep their order within a task;
    repeated rows and rows of one doc_id are packed each for itself; a null doc_id
    stays null in its pieces. Sequence ids hold the task in their upper bits. An
    empty table gives no pieces. Further columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_packed(file or tokenizer_file(), window), ", ".join(f"{x} long" for x in FIELDS))
