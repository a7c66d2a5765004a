"""MinHash near-duplicates with sequential Bayesian verification.

1. A text becomes the set of 64-bit hashes of its distinct five-word shingles, a
   128-bit digest of that set and a signature of 128 minima. Texts of one digest
   form a class, and only the class with its smallest id goes on, so a group of
   copies of any size costs one row.
2. Bands of four minima form buckets. In each bucket a hash chooses a centre;
   members meet the centre, not each other. A pair's minima are compared batch by
   batch, and it is dropped once the posterior probability of a similarity of
   at least the threshold falls below ``miss``. Survivors are confirmed on whole sets.
3. Buckets that hold several components meet in further rounds of stars: one new
   centre from the bucket's largest component and one from outside it, each compared
   with the members of other components. A round costs at most two rows a member.
4. What is left is compared without stars: each member outside its bucket's largest
   component with all members of other components. Pairs are never rows: members
   meet in blocks, first by minima, which marks the members of competitive pairs, then
   these on their whole sets. A member has one row for each block of its bucket's other
   side, which is one row up to ``BLOCK`` members. A pair is met in its first common
   band only, and what leaves a block is at most one link for each of its members.

With 32 bands of 4, a pair at exactly 0.75 shares no band with probability 5e-6,
and eight batches at ``miss`` = 1e-6 add at most 8e-6.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.operators.components import components
from terratess.llm.textbytes import SPACED, hashed_words, mix
from terratess.staging import release, stage

WIDTH = 5
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
BATCH = 16
THRESHOLD_PERCENT = 75
MISS = 1e-6
#: Members, and shingles, of one side of a block.
BLOCK, BLOCK_SHINGLES = 8192, 1 << 20
#: Comparisons a bucket member that are left to blocks; above, rounds of stars go on as long as each saves a quarter.
LEFT = 64

log = logging.getLogger(__name__)

_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, minima array<int>"
_U = np.uint64
_MIX = mix(np.arange(1, WIDTH + 1, dtype=_U) * _U(0x2545F4914F6CDD1D)) | _U(1)
_PERMUTATIONS = mix(np.arange(1, MINIMA + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (row, sorted distinct shingle hashes); a text of one to four words is one shingle, without words none."""
    for i, j, counts, h in hashed_words(column, SPACED, lower=True):
        long = np.zeros(0, dtype=_U)
        if len(h) >= WIDTH:
            long = h[: len(h) - WIDTH + 1] * _MIX[0]
            for k in range(1, WIDTH):
                long += h[k : len(h) - WIDTH + 1 + k] * _MIX[k]
            long = mix(long)
        at = 0
        for row, n in zip(range(i, j), counts.tolist()):
            if n >= WIDTH:
                yield row, np.unique(long[at : at + n - WIDTH + 1])
            elif n:
                few = np.array([n], dtype=_U)
                for x in h[at : at + n]:
                    few = mix(few * _MIX[0] + x)
                yield row, few
            else:
                yield row, np.zeros(0, dtype=_U)
            at += n


def minima(shingles: np.ndarray) -> np.ndarray:
    """128 minima of 32 bits."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=_U)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * _PERMUTATIONS[None, :]).min(axis=0), out=low)
    return (low >> _U(32)).astype(np.uint32)


def _signed(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        n = np.zeros(len(ids), dtype=np.int64)
        digest = np.zeros((len(ids), 2), dtype=np.int64)
        sign = np.zeros((len(ids), MINIMA), dtype=np.int32)
        for row, s in shingle_sets(texts):
            n[row] = len(s)
            if len(s):
                digest[row] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                sign[row] = minima(s).view(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * MINIMA, MINIMA, dtype=np.int32)), pa.array(sign.ravel()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists], ["doc_id", "n_shingles", "d1", "d2", "minima"])


def _sets(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, out = batch.column(0), [], []
        size = 0
        for row, s in shingle_sets(batch.column(1)):
            if len(s):
                rows.append(row)
                out.append(s.tobytes())
                size += 8 * len(s)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(out, pa.binary())], ["id", "shingles"])
                rows, out, size = [], [], 0
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], ["id", "shingles"])


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float) -> np.ndarray:
    """For each number of compared minima (a multiple of the batch), the fewest matches that are not pruned.

    After m matches in n the similarity has the posterior Beta(m + 1, n - m + 1);
    P(similarity >= t) is the chance of at most m successes in n + 1 trials at t.
    """
    t = percent / 100
    out = []
    for n in range(BATCH, MINIMA + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return np.array(out)


def competitive(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the rows of two signature tables that survive all batches."""
    alive = np.arange(len(x))
    hits = np.zeros(len(x), dtype=np.int64)
    for k, bound in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        hits = hits + (x[alive, at] == y[alive, at]).sum(axis=1)
        keep = hits >= bound
        alive, hits = alive[keep], hits[keep]
    return alive


def _lists(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), MINIMA)


def _pruned(least):
    def run(batches):
        for batch in batches:
            keep = competitive(_lists(batch.column(2)), _lists(batch.column(3)), least) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough: 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            keep = [similar(*(np.frombuffer(c.as_buffer(), dtype=_U) for c in pair), percent) for pair in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long")


def _sorted_groups(batches, keys: int) -> Iterator[pa.Table]:
    """Groups of equal leading columns from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(c)) for c in range(keys)], axis=1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            now = tuple(k[s].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(group: pa.Table, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of one block, the competitive pairs (places in it) of a left and a right member that have different labels and meet in no earlier band."""
    node, label, left, open_ = (np.asarray(group.column(c)) for c in ("node", "label", "left", "open"))
    band = group.column("band")[0].as_py()
    m = np.asarray(group.column("minima").combine_chunks().flatten()).reshape(len(label), MINIMA)
    right = np.flatnonzero(left == 0)
    first = np.ascontiguousarray(m[right, :BATCH])
    for x in np.flatnonzero(left == 1).tolist():
        # two open members meet once
        near = (first == m[x, :BATCH]).sum(axis=1) >= least[0]
        near &= (label[right] != label[x]) & ((open_[right] == 0) | (node[right] > node[x]))
        others = right[near]
        if len(others):
            others = others[competitive(np.broadcast_to(m[x], (len(others), MINIMA)), m[others], least)]
        if len(others) and band:
            early = (m[others, : band * ROWS] == m[x, : band * ROWS]).reshape(len(others), band, ROWS).all(axis=2).any(axis=1)
            others = others[~early]
        if len(others):
            yield x, others


def _busy(least):
    """Of each block, the members of its open pairs."""

    def run(batches):
        for group in _sorted_groups(batches, 3):
            mark = np.zeros(len(group), dtype=bool)
            for x, others in _open_pairs(group, least):
                mark[x] = mark[others] = True
            yield pa.RecordBatch.from_arrays([group.column(c).combine_chunks().filter(pa.array(mark)) for c in ("bucket", "node", "left")], ["bucket", "node", "left"])

    return run


def _across(least, percent):
    """Of each block, links that join its members' labels; pairs that earlier links join are not compared."""

    def run(batches):
        for group in _sorted_groups(batches, 3):
            node, label = (np.asarray(group.column(c)) for c in ("node", "label"))
            sets = group.column("shingles").combine_chunks()
            values = [np.frombuffer(x.as_buffer(), dtype=_U) for x in sets]
            sizes = np.array([len(v) for v in values])
            up = {x: x for x in label.tolist()}

            def root(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            out: list[tuple[int, int]] = []
            for x, others in _open_pairs(group, least):
                fits = 100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])
                for y in others[fits].tolist():
                    p, q = root(int(label[x])), root(int(label[y]))
                    if p != q and similar(values[x], values[y], percent):
                        up[max(p, q)] = min(p, q)
                        out.append((int(node[x]), int(node[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _mixed(buckets: DataFrame, label: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets that hold several components, with their ``label``; and of these buckets the members ``n``, the largest component ``most``, its members ``held``, and a centre in and out of it."""
    named = buckets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    draw = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), F.col("node").alias("centre")))["centre"]
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), draw.alias("centre"))
    parts = stage(parts.join(parts.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "bucket"), "parts")
    most = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label", "centre")).alias("most"))
    most = most.select("bucket", "n", F.col("most")["label"].alias("most"), F.col("most")["n"].alias("held"), F.col("most")["centre"].alias("inner"))
    out = parts.join(most.select("bucket", "most"), "bucket").where("label <> most").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("centre", F.lit(turn)).alias("h"), F.col("centre"), F.col("label"))).alias("out"))
    tops = stage(most.join(out, "bucket").select("bucket", "n", "most", "held", "inner", F.col("out")["centre"].alias("outer"), F.col("out")["label"].alias("outer_label")), "tops")
    release(parts)
    return named.join(tops.select("bucket", "most"), "bucket"), tops


def _in_blocks(members: DataFrame, most: int, weight) -> DataFrame:
    """Members dealt to blocks (bucket, i, j) in which each left member meets each right member once. A side of a bucket has as many blocks as its members, or their ``weight``, need."""
    count = lambda side: F.greatest(F.ceil(F.count(F.when(F.col("left") == side, 1)) / most), F.ceil(F.sum(F.when(F.col("left") == side, weight)) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sides = members.groupBy("bucket").agg(count(1).alias("lefts"), count(0).alias("rights"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("left") == 1, F.col("lefts")).otherwise(F.col("rights"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("left") == 1, F.col("rights")).otherwise(F.col("lefts")) - 1))
    dealt = members.join(sides, "bucket").withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("i", F.when(F.col("left") == 1, F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("left") == 1, F.col("other")).otherwise(F.col("own")))
    return dealt.select("bucket", "i", "j", *[c for c in members.columns if c != "bucket"])


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, miss: float = MISS, block: int = BLOCK, left: int = LEFT) -> DataFrame:
    """``docs (doc_id, text, ...)`` to ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Only these two columns are read, so further columns of any name are harmless.
    Null and empty texts, and texts without words, have no shingles and are alone.
    Rows of one doc_id are one document: a link of either holds for both. A null
    doc_id is linked with nothing: its component is null and it is kept. An empty
    table gives an empty result. ``block`` and ``left`` (see ``BLOCK``, ``LEFT``)
    move work between rounds and blocks and never change the result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return of_unique_ids(docs, percent, miss, block, left)
    # each text of an id is a document by itself at first, then the id holds its texts together
    hashed = docs.withColumn("words", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = hashed.where("doc_id is not null").dropDuplicates(["doc_id", "words"])
    numbered = stage(rows.withColumn("place", F.monotonically_increasing_id()), "numbered")
    found = stage(of_unique_ids(numbered.select(F.col("place").alias("doc_id"), "text"), percent, miss, block, left).withColumnRenamed("doc_id", "place"), "found")
    known = numbered.select("place", "doc_id", "words").join(found.drop("kept"), "place")
    least = known.where("n_shingles > 0").groupBy("doc_id").agg(F.min("place").alias("b"))
    links = known.where("n_shingles > 0").join(least, "doc_id").select(F.col("place").alias("a"), "b").unionByName(found.select(F.col("place").alias("a"), F.col("component_id").alias("b")))
    label = components(links).withColumnRenamed("node", "place")
    known = stage(known.join(label, "place", "left").withColumn("label", F.coalesce("label", "place")), "known")
    release(found)
    named = known.drop("component_id").join(known.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select(F.col("doc_id").alias("own_id"), F.col("words").alias("own_words"), "n_shingles", "component_id")
    out = hashed.join(named, (F.col("doc_id") == F.col("own_id")) & (F.col("words") == F.col("own_words"))).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = docs.where("doc_id is null").mapInArrow(_signed, _SIGNED).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def of_unique_ids(docs: DataFrame, percent: int = THRESHOLD_PERCENT, miss: float = MISS, block: int = BLOCK, left: int = LEFT) -> DataFrame:
    """``near_duplicates`` of a table (doc_id, text) that repeats no doc_id but null."""
    least = least_matches(percent, miss)
    signed = stage(docs.mapInArrow(_signed, _SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    minimas = stage(full.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "minima"), "minima")
    slim = stage(signed.select("doc_id", "n_shingles", "d1", "d2"), "slim")
    release(signed)

    key = lambda b: F.xxhash64(b, *[F.get("minima", b * ROWS + k) for k in range(ROWS)])
    members = minimas.select("node", "n_shingles", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("band", "bucket"))
    rank = F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("centre"))
    centres = stage(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(rank)["centre"].alias("centre")).where("n > 1").drop("n"), "centres")
    buckets = stage(members.join(centres, "bucket"), "buckets")
    release(centres)

    signs = minimas.select("node", "minima")
    m = lambda name: signs.select(F.col("node").alias(name), F.col("minima").alias(f"m{name}"))
    wanted = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = stage(docs.where("doc_id is not null").join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, shingles binary"), "sets")

    def met(pairs: DataFrame) -> DataFrame:
        """Confirmed links of candidate pairs (a, b)."""
        close = stage(pairs.distinct().join(m("a"), "a").join(m("b"), "b").select("a", "b", "ma", "mb").mapInArrow(_pruned(least), "a long, b long").distinct(), "stars")
        links = stage(_links(close, sets, percent).distinct(), "confirmed")
        release(close)
        return links

    def merged(label: DataFrame, links: DataFrame) -> DataFrame:
        found = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))
        out = stage(found, "label")
        release(label, links)
        return out

    links = met(buckets.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    label = stage(components(links), "label")
    release(links)
    homes = buckets.select("bucket", "node", "band", "n_shingles")
    turn, before = 0, None
    while True:
        open_, tops = _mixed(homes, label, turn)
        size = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * (F.col("n") - F.col("held"))), F.lit(0)).alias("work")).first()
        log.info("round %d: %d members of open buckets, %d comparisons left", turn, size["n"], size["work"])
        if size["work"] <= left * size["n"] or before is not None and size["work"] > 0.75 * before:
            break
        both = open_.join(tops.drop("most"), "bucket")
        inner = both.where("label <> most").select(F.col("node").alias("a"), F.col("inner").alias("b"))
        outer = both.where("label <> outer_label").select(F.col("node").alias("a"), F.col("outer").alias("b"))
        label = merged(label, met(inner.unionByName(outer)))
        release(tops)
        turn, before = turn + 1, size["work"]

    if size["n"]:
        sided = open_.withColumn("open", (F.col("label") != F.col("most")).cast("int")).drop("most")
        sided = stage(sided.withColumn("left", F.lit(0)).unionByName(sided.where("open = 1").withColumn("left", F.lit(1))), "sided")
        keys = ["bucket", "i", "j"]
        together = lambda x: x.select(*keys, "band", "left", "open", "node", "label", *x.columns[x.columns.index("minima") :]).repartition(*keys).sortWithinPartitions(*keys)
        light = _in_blocks(sided, block, F.lit(0)).join(signs, "node")
        busy = stage(together(light).mapInArrow(_busy(least), "bucket long, node long, left int").distinct(), "busy")
        close = stage(sided.join(busy, ["bucket", "node", "left"]), "close")
        whole = _in_blocks(close, block, F.col("n_shingles")).join(signs, "node").join(sets.withColumnRenamed("id", "node"), "node")
        more = stage(together(whole).mapInArrow(_across(least, percent), "a long, b long").distinct(), "later")
        release(sided, busy, close)
        if not more.isEmpty():
            label = merged(label, more)
    release(tops, buckets, minimas, sets)

    homes = stage(classes.join(label, "node", "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("label", "node").alias("home")), "homes")
    release(classes, label)
    some = slim.where("n_shingles > 0 and doc_id is not null").join(homes, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("doc_id", "n_shingles", F.col("home").alias("component_id"))
    none = slim.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
