"""Quality classifier by co-training.

Two views of a document, its text and its page metadata, have a classifier each:
naive Bayes evidence, averaged over what the view holds, under a small calibrated
logistic model. In every round each view labels the documents of the whole corpus
of which it is confident, and these teach the other view. A view is confident of a
kind if it says so with ``SURE`` and its own evidence, without the kinds' shares,
speaks for it by ``CONFIDENT``; one that only knows the shares never is. The
calibrated views are then combined on labelled rows that neither was taught with, and
every document is scored. ``Model.exchanged`` counts the labels that were handed over.

Labels come from a bounded sample (``LABELLED`` documents and ``ENTRIES`` bucket
counts, half of them of either kind at most, chosen by a hash of the id), whose
features, not texts, go to the driver. Of rows of one id the text of the least hash
teaches. The kinds' shares among all labels are put back into the calibration.
Everything else runs over all rows: labelled documents outside the sample count as
unlabelled, and of confident ones distributed counts by bucket reach the driver.
"""

from __future__ import annotations

import logging
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.llm.textbytes import SPACED, hashed_words
from terratess.staging import release, stage

log = logging.getLogger(__name__)

LABELLED = 4000
#: Bucket counts of the sample that the driver holds; a document has at most WORDS + TAILS.
ENTRIES = 4_000_000
ROUNDS = 3
#: Labelled documents of either kind without which nothing is learned: two teach, one calibrates.
LEAST = 3
#: A view's probability of a kind were both equally common, and as common as they are, from which on it hands a label over.
CONFIDENT, SURE = 0.9, 0.9
#: Documents score at least this to be kept.
KEEP = 0.5
WORDS, TAILS = 1 << 13, 1 << 11
SHAPES = 6
META = 1 << 13
LOWEST = 1e-6
#: Buckets of both views; counts have two places more, for the documents that text and metadata hand over.
_ALL = WORDS + TAILS + META


def _shapes(first, last, before, size, hashes, counts) -> np.ndarray:
    """Per row: shares of words that are capital throughout their ends, end in a symbol, are single marks; repetition, mean length, log size."""
    upper = lambda b: (b >= 0x41) & (b <= 0x5A)
    symbol = ((last < 0x30) & (last != 0x2E) & (last != 0x2C)) | (last == 0x7C)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros((len(counts), SHAPES))
    sums = [np.concatenate([[0], np.cumsum(x, dtype=np.float64)]) for x in (upper(first) & upper(before), symbol, size == 1, size)]
    n = np.maximum(counts, 1)
    for k, s in enumerate(sums[:3]):
        out[:, k] = (s[ends] - s[starts]) / n
    out[:, 4] = (sums[3][ends] - sums[3][starts]) / n / 10
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    distinct = np.bincount(_distinct_rows(hashes, row), minlength=len(counts)) if len(hashes) else np.zeros(len(counts))
    out[:, 3] = distinct / n
    out[:, 5] = np.log1p(counts) / 10
    return out


def _distinct_rows(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The row of each distinct (row, word)."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new].astype(np.int64)


def _features(column: pa.Array) -> Iterator[tuple]:
    """Yields (first row, last row + 1, words of each row, word buckets, tail buckets, shapes)."""
    for i, j, counts, h, (first, last, before, size) in hashed_words(column, SPACED, spans=True):
        words = (h >> np.uint64(20)).astype(np.int64) & (WORDS - 1)
        tails = (last.astype(np.int64) * 31 + before.astype(np.int64) * 1021 + np.minimum(size, 2) * 7919) & (TAILS - 1)
        yield i, j, counts, words, tails, _shapes(first, last, before, size, h, counts)


_SAMPLED = "id long, y int, digest long, meta array<int>, buckets array<smallint>, counts array<int>, shapes array<double>"


def _sampled(batches) -> Iterator[pa.RecordBatch]:
    """Per document (id, text, y, digest, meta) the counts of its buckets and its shapes."""
    for batch in batches:
        buckets, counted, shapes = [], [], []
        for i, j, counts, words, tails, shape in _features(batch.column(1)):
            at = 0
            for k in range(j - i):
                n = int(counts[k])
                b, c = np.unique(np.concatenate([words[at : at + n], tails[at : at + n] + WORDS]), return_counts=True)
                buckets.append(b.astype(np.int16))
                counted.append(c.astype(np.int32))
                shapes.append(shape[k])
                at += n
        yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(c) for c in ("y", "digest", "meta")), pa.array(buckets, pa.list_(pa.int16())), pa.array(counted, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64()))], ["id", "y", "digest", "meta", "buckets", "counts", "shapes"])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, LOWEST, 1 - LOWEST)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a small logistic model, bias last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(columns: np.ndarray, counts: np.ndarray, rows: np.ndarray, y: np.ndarray, size: int, more: np.ndarray) -> np.ndarray:
    """Log odds of each feature in good against bad rows, smoothed; ``more`` holds the pseudo-labelled counts of (bad, good) and weighs no more than the labels of its kind."""
    kinds = []
    for k in (0, 1):
        own = np.bincount(columns, weights=counts * (y[rows] == k), minlength=size)
        kinds.append(own + more[k] * min(1.0, own.sum() / max(more[k].sum(), 1.0)) + 0.5)
    bad, good = kinds
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


@dataclass(frozen=True)
class Model:
    """What scoring needs: bounded arrays, whatever the corpus."""

    words: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    meta_fit: np.ndarray
    joint: np.ndarray
    #: Of each round the documents that (text, metadata) called (bad, good) for the other view.
    exchanged: tuple = ()


class _View:
    """Sparse rows of one view with optional dense columns."""

    def __init__(self, columns, counts, rows, n, size, dense):
        self.columns, self.counts, self.rows, self.n, self.size, self.dense = columns, counts, rows, n, size, dense
        self.total = np.maximum(np.bincount(rows, weights=counts, minlength=n), 1)

    def fit(self, y: np.ndarray, taught: np.ndarray, measured: np.ndarray, shift: float, more: np.ndarray):
        """``taught`` rows give the evidence, ``measured`` rows (labels too) the calibration, ``shift`` the log odds that the sample took from it, ``more`` the evidence of pseudo-labels."""
        use = taught[self.rows]
        self.weights = _evidence(self.columns[use], self.counts[use], self.rows[use], y, self.size, more)
        x = self.matrix()
        self.w = _logistic(x[measured], y[measured])
        self.w[-1] += shift
        return _sigmoid(np.column_stack([x, np.ones(self.n)]) @ self.w)

    def matrix(self) -> np.ndarray:
        mean = np.bincount(self.rows, weights=self.weights[self.columns] * self.counts, minlength=self.n) / self.total
        return np.column_stack([mean, self.dense])


def meta_buckets(lang, source, n_chars) -> list:
    """Bucket columns of the metadata view: each field, finer sizes and pairs of fields; nulls are values of their own."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit("\0null"))
    at = lambda name, *c: F.pmod(F.xxhash64(F.lit(name), *map(word, c)), F.lit(META)).cast("int")
    size = F.log2(F.greatest(n_chars, F.lit(0)) + 1)
    wide = F.floor(size)
    return [at("lang", lang), at("source", source), at("size", wide), at("finer", F.floor(4 * size)), at("lang, source", lang, source), at("source, size", source, wide), at("lang, size", lang, wide)]


def _prepared(docs: DataFrame) -> DataFrame:
    meta = F.array(*meta_buckets(F.col("lang"), F.col("source"), F.col("n_chars")))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), meta.alias("meta"))


def _chosen(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows: of each bucket of the id's hash the least."""
    h = F.xxhash64("id", F.lit(seed))
    best = ids.groupBy(F.pmod(h, F.lit(most)).alias("k")).agg(F.min(F.struct(h.alias("h"), *ids.columns)).alias("x"))
    return best.select(*[F.col(f"x.{c}").alias(c) for c in ids.columns])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT, entries: int = ENTRIES) -> Model | None:
    """Fits the views; none, with a warning, if fewer than ``LEAST`` labelled documents of either kind were found.

    ``labels (doc_id, quality)``: repeated labels of a document vote (ties: good); null ids and labels are ignored.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    prepared = _prepared(docs)
    known = stage(known.join(prepared.select("id"), "id", "left_semi"), "labels")
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # of two kinds
    if min(total.get(0, 0), total.get(1, 0)) < LEAST:
        warnings.warn(f"labelled documents by quality: {total}; without {LEAST} of either nothing is learned and all documents are kept", stacklevel=2)
        release(known)
        return None
    kinds = [known.where(F.col("y") == k) for k in (0, 1)]
    bad, good = (kind if total[k] <= labelled // 2 else _chosen(kind, labelled // 2, 1) for k, kind in enumerate(kinds))
    wanted = F.broadcast(bad.unionByName(good))  # at most `labelled` rows
    rows = prepared.join(wanted, "id").select("id", "text", "y", F.xxhash64("text").alias("digest"), "meta")
    features = stage(rows.mapInArrow(_sampled, _SAMPLED), "features")
    release(known)
    # one text of each id, and as many ids as the bound on entries allows
    one = features.groupBy("id").agg(F.min(F.struct("digest", F.size("buckets").alias("n"), "y")).alias("x")).select("id", "x.*", F.xxhash64("id", F.lit(1)).alias("h")).collect()
    held, taken = {0: 0, 1: 0}, []
    for r in sorted(one, key=lambda r: (r["h"], r["id"])):
        held[r["y"]] += r["n"]
        if held[r["y"]] <= entries // 2 or sum(t["y"] == r["y"] for t in taken) < LEAST:
            taken.append(r)
    picked = F.broadcast(features.sparkSession.createDataFrame([(r["id"], r["digest"]) for r in taken], "id long, digest long"))
    table = features.join(picked, ["id", "digest"], "left_semi").dropDuplicates(["id"]).toArrow()
    release(features)
    table = table.take(np.argsort(np.asarray(table["id"]), kind="stable"))
    ids = np.asarray(table["id"])
    n = len(ids)
    y = np.asarray(table["y"]).astype(np.int64)
    flat = lambda c: np.asarray(table[c].combine_chunks().flatten())
    size = np.array([len(x) for x in table["buckets"]])
    text = _View(flat("buckets").astype(np.int64), flat("counts").astype(np.float64), np.repeat(np.arange(n), size), n, WORDS + TAILS, flat("shapes").reshape(n, SHAPES))
    columns = flat("meta").reshape(n, -1)
    meta = _View(columns.ravel(), np.ones(columns.size), np.repeat(np.arange(n), columns.shape[1]), n, META, np.zeros((n, 0)))
    measured = np.zeros(n, dtype=bool)
    for k in (0, 1):
        measured[np.flatnonzero(y == k)[1::2]] = True
    # odds of the kinds among all labels against those among the measured rows
    shift = float(np.log(total[1] / total[0]) - np.log((y[measured] == 1).sum() / (y[measured] == 0).sum()))
    past: list[tuple] = []
    exchanged = []
    more = np.zeros((2, _ALL))
    p_text = p_meta = np.zeros(0)
    bounds = sure(total[1] / (total[0] + total[1]), confident)
    for turn in range(rounds + 1):
        p_text = text.fit(y, ~measured, measured, shift, more[:, : WORDS + TAILS])
        p_meta = meta.fit(y, ~measured, measured, shift, more[:, WORDS + TAILS :])
        if turn < rounds:
            past.append((text.weights, text.w, meta.weights, meta.w))
            more, handed = _pseudo(prepared, past, ids, bounds)
            exchanged.append(handed)
            log.info("round %d: %s", turn, handed)
    joint = _logistic(np.column_stack([_logit(p_text), _logit(p_meta)])[measured], y[measured], ridge=0.1)
    joint[-1] += shift
    return Model(text.weights, text.w, meta.weights, meta.w, joint, tuple(exchanged))


def sure(good: float, confident: float = CONFIDENT) -> tuple[float, float]:
    """The probabilities of good at or below which a view hands over bad, and from which on it hands over good, where ``good`` is the share of good ones."""
    lift, base = float(_logit(np.array(confident))), float(_logit(np.array(good)))
    enough = float(_logit(np.array(SURE)))
    return float(_sigmoid(np.array(min(base - lift, -enough)))), float(_sigmoid(np.array(max(base + lift, enough))))


def _text_view(weights: np.ndarray, fit: np.ndarray, counts, words, tails, shapes) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(weights[words] + weights[WORDS + tails])])
    ends = np.cumsum(counts)
    mean = (total[ends] - total[ends - counts]) / np.maximum(2 * counts, 1)
    return _sigmoid(np.column_stack([mean, shapes, np.ones(len(counts))]) @ fit)


def _meta_view(weights: np.ndarray, fit: np.ndarray, meta: np.ndarray) -> np.ndarray:
    return _sigmoid(np.column_stack([weights[meta].mean(axis=1), np.ones(len(meta))]) @ fit)


def _taught(past: list[tuple], sampled: np.ndarray, bounds: tuple[float, float]):
    """Per bucket the counts in documents that the other view is confident of; a later round's word goes before an earlier one's."""
    low, high = bounds

    def label(found: list[np.ndarray], out: np.ndarray) -> np.ndarray:
        for p in found:
            out[p >= high] = 1
            out[p <= low] = 0
        return out

    def run(batches) -> Iterator[pa.RecordBatch]:
        more = np.zeros((2, _ALL + 2), dtype=np.int64)
        known = pa.array(sampled, pa.int64())
        for batch in batches:
            free = ~np.asarray(pc.is_in(batch.column(0), value_set=known))
            meta = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            by_meta = label([_meta_view(w, fit, meta) for _, _, w, fit in past], np.full(batch.num_rows, -1))
            by_text = np.full(batch.num_rows, -1)
            by_meta[~free] = -1
            for i, j, counts, words, tails, shapes in _features(batch.column(1)):
                by_text[i:j] = label([_text_view(w, fit, counts, words, tails, shapes) for w, fit, _, _ in past], by_text[i:j])
                kind = np.repeat(by_meta[i:j], counts)
                for k in (0, 1):
                    use = kind == k
                    more[k, :WORDS] += np.bincount(words[use], minlength=WORDS)
                    more[k, WORDS : WORDS + TAILS] += np.bincount(tails[use], minlength=TAILS)
            by_text[~free] = -1
            for k in (0, 1):
                more[k, WORDS + TAILS : _ALL] += np.bincount(meta[by_text == k].ravel(), minlength=META)
                more[k, _ALL :] += [(by_text == k).sum(), (by_meta == k).sum()]
        at = np.flatnonzero(more.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(more[0, at]), pa.array(more[1, at])], ["bucket", "bad", "good"])

    return run


def _pseudo(prepared: DataFrame, past: list[tuple], sampled: np.ndarray, bounds: tuple[float, float]) -> tuple[np.ndarray, dict]:
    """Counts (bad, good) of the text's and the metadata's buckets over all documents outside the sample, and how many documents each view handed over; a row per bucket reaches the driver."""
    counts = prepared.mapInArrow(_taught(past, sampled, bounds), "bucket int, bad long, good long")
    found = counts.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    more = np.zeros((2, _ALL + 2))
    for k, kind in enumerate(("bad", "good")):
        more[k, np.asarray(found["bucket"], dtype=np.int64)] = np.asarray(found[kind])
    handed = {view: tuple(more[:, _ALL + v].astype(int).tolist()) for v, view in enumerate(("text", "metadata"))}
    return more[:, :_ALL], handed


def _scored(model: Model):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p_text = np.zeros(batch.num_rows)
            empty = np.ones(batch.num_rows, dtype=bool)
            for i, j, counts, words, tails, shapes in _features(batch.column(1)):
                p_text[i:j] = _text_view(model.words, model.text, counts, words, tails, shapes)
                empty[i:j] = counts == 0
            meta = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            p_meta = _meta_view(model.meta, model.meta_fit, meta)
            score = _sigmoid(np.column_stack([_logit(p_text), _logit(p_meta), np.ones(len(meta))]) @ model.joint)
            score[empty] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.round(x, 9)) for x in (p_text, p_meta, score)]], ["doc_id", "p_text", "p_meta", "score"])

    return run


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """``docs (doc_id, text, lang, source, n_chars, ...)`` to ``(doc_id, p_text, p_meta, score, kept)``, one row per input row.

    Texts without words (null and empty too) score 0 and are not kept; null
    metadata are values of their own. Without a model (too few labels) the views
    and the score are null and all are kept. Whole texts count; repeated rows score
    alike; an empty table gives an empty result.
    """
    if model is None:
        null = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), null.alias("p_text"), null.alias("p_meta"), null.alias("score"), F.lit(True).alias("kept"))
    out = _prepared(docs).mapInArrow(_scored(model), "doc_id long, p_text double, p_meta double, score double")
    return out.withColumn("kept", F.col("score") >= keep)


def classify(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    return score(docs, train(docs, labels, **bounds))


def filter_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **bounds) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep``, columns as they are; without a model all."""
    model = train(docs, labels, **bounds)
    if model is None:
        return docs

    text = docs.columns.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        views = _scored(model)
        for batch in batches:
            last = batch.num_columns - 1
            found = next(views(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(text), batch.column(last)], ["id", "text", "meta"])])))
            yield batch.select(list(range(last))).filter(pa.array(np.asarray(found.column(3)) >= keep))

    meta = F.array(*meta_buckets(F.col("lang"), F.col("source"), F.col("n_chars")))
    return docs.select(*docs.columns, meta.alias("_view_meta")).mapInArrow(run, docs.schema)
