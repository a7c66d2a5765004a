"""Exact top-k by inner product with MaxScore.

A component is a term; a row stands in the postings of the components that are not
zero in it, with the component as signed weight. Rows are dealt to shards once and
never copied; queries travel to every shard and stream past it.

In a shard the terms of a query are split by their score bounds. The bound of a set
of terms is the smaller of the sum of their largest contributions and the product
of the query's and the longest row's length in them. Terms, least first, are
non-essential as long as their bound stays below the k-th best score so far: a row
outside all essential postings cannot enter the list. Essential postings are
traversed, then the other terms are probed, largest first and in steps, for rows whose
score plus the bound of what is left is competitive. The k-th best score starts at
that of a bounded sample of rows, which is scored before. Lists of shards are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratess.staging import stage

SCALE = 64
K = 20
#: Rows of a shard at most, and bytes of its matrix; rows below which more shards don't pay.
SHARD_ROWS, SHARD_BYTES, LEAST_ROWS = 131072, 1 << 26, 4096
#: Rows that are traversed together, terms that are probed together.
STEP, PROBE = 4096, 8
#: Rows of the sample that gives first thresholds, and its bytes.
SEED_ROWS, SEED_BYTES = 4096, 1 << 23
#: A posting list that holds more than this share of the rows is kept as a column.
DENSE = 0.25

_KINDS = ((np.int8, 1), (np.int16, 2), (np.int32, 4), (np.float64, 8))
_NONE = np.iinfo(np.int64).min
_VECTOR = "vec_id long, width int, item int, terms binary"


def _terms(scale: int):
    """Rows that take part; components in the shortest type that holds them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            values = lists.flatten()
            gone = np.asarray(values.is_null()) if values.null_count else np.zeros(len(values), dtype=bool)
            x = np.floor(scale * np.asarray(values.fill_null(0) if values.null_count else values, dtype=np.float64))
            gone |= ~np.isfinite(x)
            at = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
            null = np.asarray(lists.is_null()) | np.asarray(ids.is_null())
            keep, terms, widths, items = [], [], [], []
            for row in range(batch.num_rows):
                a, b = int(at[row]), int(at[row + 1])
                if null[row] or gone[a:b].any():
                    continue
                most = float(np.abs(x[a:b]).max()) if b > a else 0.0
                kind, item = next(((t, n) for t, n in _KINDS[:3] if most <= np.iinfo(t).max), _KINDS[3])
                keep.append(row)
                terms.append(x[a:b].astype(kind).tobytes())
                widths.append(b - a)
                items.append(item)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(widths, pa.int32()), pa.array(items, pa.int32()), pa.array(terms, pa.binary())], ["vec_id", "width", "item", "terms"])

    return run


def _matrix(terms: list[bytes], items: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(terms), width))
    for kind, n in _KINDS:
        rows = np.flatnonzero(items == n)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(terms[r] for r in rows), dtype=kind).reshape(len(rows), width)
    return out


def _kind(queries: np.ndarray, rows: np.ndarray):
    """The fastest type in which all partial sums are exact."""
    if not queries.size or not rows.size:
        return np.float64
    most = float((np.abs(queries).max(axis=0) * np.abs(rows).max(axis=0)).sum())
    if most < 1 << 24:
        return np.float32
    if most < 1 << 53:
        return np.float64
    if most < 1 << 62:
        return np.int64
    raise OverflowError("scores of these vectors may not fit 64 bits")


class Shard:
    """Postings of a shard's rows and MaxScore over them. ``ids`` must rise.

    ``touched`` counts traversed postings, ``probed`` the components read beyond them.
    """

    def __init__(self, rows: np.ndarray, uids: np.ndarray, ids: np.ndarray):
        self.rows, self.uids, self.ids = rows, uids, ids
        self.touched = self.probed = 0
        self.high, self.low = (rows.max(axis=0), rows.min(axis=0)) if len(rows) else (np.zeros(rows.shape[1]),) * 2
        self.steps: dict = {}

    def _blocks(self, kind) -> list:
        """Per step of rows: its first row, matrix, lengths, columns of dense terms (else rows and weights), and lengths of posting lists."""
        if kind not in self.steps:
            made = []
            for at in range(0, len(self.rows), STEP):
                x = self.rows[at : at + STEP]
                held = (x != 0).sum(axis=0)
                sparse = {int(j): (r := np.flatnonzero(x[:, j]), x[r, j].astype(kind)) for j in np.flatnonzero(held <= DENSE * len(x))}
                # a little longer than exact, for rounding
                made.append((at, x.astype(kind), np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9) + 1e-9, np.ascontiguousarray(x.T.astype(kind)), sparse, held))
            self.steps = {kind: made}
        return self.steps[kind]

    def search(self, query: np.ndarray, own: int, k: int, least: int = _NONE, kind=None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of at most k rows other than ``own``, best first, ties by id; rows that score under ``least`` may miss."""
        kind = kind or _kind(query[None, :], self.rows)
        best, best_ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        bounds = np.maximum(0, np.maximum(query * self.high, query * self.low))
        order = np.argsort(bounds, kind="stable")  # least first
        order = order[query[order] != 0]
        q, weight = query[order].astype(kind), np.abs(query[order])
        sums = np.concatenate([[0.0], np.cumsum(bounds[order])]) * (1 + 1e-9)
        lengths = np.sqrt(np.concatenate([[0.0], np.cumsum(weight * weight)])) * (1 + 1e-9)
        need = least
        for at, x, norms, columns, sparse, held in self._blocks(kind):
            reach = np.minimum(sums, lengths * norms.max())
            free = max(int(np.searchsorted(reach, need)) - 1, 0) if need > 0 else 0  # order[:free] can't reach it
            score = np.zeros(len(x), dtype=kind)
            essential = order[free:]
            thin = [j in sparse for j in essential.tolist()] if sparse else None
            if thin and any(thin):
                thin = np.array(thin)
                for j, w in zip(essential[thin].tolist(), q[free:][thin]):
                    r, v = sparse[j]
                    score[r] += w * v
                score += q[free:][~thin] @ columns[essential[~thin]]
            else:
                score += q[free:] @ columns[essential]
            self.touched += int(held[essential].sum())
            # an integer score that still can enter; the smaller bound of what is left decides
            rows = np.flatnonzero(score + np.minimum(sums[free], lengths[free] * norms) >= need) if need != _NONE else np.arange(len(x))
            score = score[rows]
            while free and len(rows):
                to = max(free - PROBE, 0)
                score = score + x[rows[:, None], order[to:free]] @ q[to:free]
                self.probed += len(rows) * (free - to)
                free = to
                keep = score + np.minimum(sums[free], lengths[free] * norms[rows]) >= need
                rows, score = rows[keep], score[keep]
            rest = self.uids[at + rows] != own
            if rest.any():
                s, i = np.concatenate([best, score[rest].astype(np.int64)]), np.concatenate([best_ids, self.ids[at + rows[rest]]])
                top = np.lexsort((i, -s))[:k]
                best, best_ids = s[top], i[top]
                if len(best) == k:  # later rows have larger ids and lose ties
                    need = max(need, int(best[-1]) + 1)
        return best, best_ids


def _seeded(sample: dict[int, Shard], k: int):
    """Queries with the k-th best score among the sample, a lower bound of their k-th best of all."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, width, item = (np.asarray(batch.column(c)) for c in ("uid", "width", "item"))
            terms = batch.column("terms").to_pylist()
            least = np.full(len(uid), _NONE)
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                shard = sample.get(w)
                if shard is None or len(shard.ids) <= k:
                    continue
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512]
                    m = _matrix([terms[r] for r in some], item[some], w)
                    kind = _kind(m, shard.rows)
                    score = m.astype(kind) @ shard.rows.T.astype(kind)
                    # one more, as the query's own row may be among them
                    least[some] = np.partition(score, len(shard.ids) - k - 1, axis=1)[:, len(shard.ids) - k - 1].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], [*batch.schema.names, "least"])

    return run


def _searched(k: int):
    """Streams batches sorted by (shard, width, asked, vec_id): a shard's rows, then its queries."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            shards, widths, asked, items, uids, ids, least = (np.asarray(batch.column(c)) for c in ("shard", "width", "asked", "item", "uid", "vec_id", "least"))
            terms = batch.column("terms")
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(widths) != 0) | (np.diff(asked) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if (at := (int(shards[a]), int(widths[a]))) != now:
                    now, held, shard = at, [], None
                values = terms.slice(a, b - a).to_pylist()
                if not asked[a]:
                    held.append((values, items[a:b], uids[a:b], ids[a:b]))
                    continue
                if shard is None and held:
                    shard = Shard(_matrix([t for h in held for t in h[0]], np.concatenate([h[1] for h in held]), now[1]), *(np.concatenate([h[c] for h in held]) for c in (2, 3)))
                    held = []
                if shard is None:
                    continue
                asking = _matrix(values, items[a:b], now[1])
                kind = _kind(asking, shard.rows)
                out: list = []
                for n in range(b - a):
                    scores, found = shard.search(asking[n], uids[a + n], k, int(least[a + n]), kind)
                    out.append((np.full(len(found), uids[a + n]), np.full(len(found), ids[a + n]), found, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["uid", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Callable, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vectors (vec_id, embedding, ...)`` to ``(query_id, rank, vec_id, score)``.

    ``is_query`` is a predicate on ``vec_id``. Candidates are all rows but the query's
    own that have its width; another row of the query's vec_id is a candidate. Ties go
    to the smaller vec_id. Null ids, null vectors and vectors with a null or
    non-finite component take no part. Empty vectors score 0 among themselves. Each
    of repeated rows counts, as a candidate and as a query. Scores are exact; vectors
    so large that a score may not fit 62 bits raise an error. Further columns are not
    read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stage(slim.mapInArrow(_terms(scale), _VECTOR).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("width"), F.lit(1)).alias("width")).first()
    n, width = size["n"], max(size["width"], 1)
    most = max(min(shard_rows, SHARD_BYTES // (4 * width)), 1)
    shards = max(-(-n // most), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism), 1)
    drawn = rows.orderBy(F.xxhash64("uid")).limit(max(min(SEED_ROWS, SEED_BYTES // (8 * width)), 1)).collect()
    sample = {w: Shard(_matrix([bytes(r["terms"]) for r in own], np.array([r["item"] for r in own]), w), np.array([r["uid"] for r in own]), np.array([r["vec_id"] for r in own])) for w in {r["width"] for r in drawn} for own in [[r for r in drawn if r["width"] == w]]}

    asked = rows.where(is_query(F.col("vec_id"))).mapInArrow(_seeded(sample, k), f"{_VECTOR}, uid long, least long")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asked", F.lit(1))
    dealt = rows.withColumn("least", F.lit(_NONE)).withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).withColumn("asked", F.lit(0))
    both = dealt.unionByName(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "width", "asked", "vec_id")
    found = both.mapInArrow(_searched(k), "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
