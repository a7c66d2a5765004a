"""Mixing sources to target weights, with DataFrame functions only.

1. Words are summed per source; each source's target and so its repetition rate
   follow from its weight.
2. A document is emitted floor(rate) times plus one copy drawn by a seeded hash of
   its id and text with the fraction as probability. Each source draws by that one of
   ``SEEDS`` seeds whose outcome over all its documents comes nearest to its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terratess.operators.numbering import numbered
from terratess.staging import release, stage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: Each takes 13 hexadecimal digits of a document's digest from another place.
SEEDS = 16
#: A table of sources is broadcast up to so many rows, else joined by shuffle, where hot sources are split.
BROADCAST_SOURCES = 20_000

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sizes (source, source_size)``, one row per source, to the same with ``target``; a staged table.

    Sources in code point order, null last, have the weights in turn and share the
    sum of all sizes. A target stops at ``most`` times its source's size and the
    excess goes to the others by weight: the level at which they share rises with
    every pass of sums over the sources until no further one stops.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    x = stage(placed.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * most).alias("cap")), "weighed")
    release(placed)
    total = x.agg(F.sum("source_size")).first()[0] or 0
    stopped, level = -1, 0.0
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight") if stopped >= 0 else F.lit(False)
        held = x.agg(F.count(F.when(capped, 1)).alias("n"), F.sum(F.when(capped, F.col("cap"))).alias("cap"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if held["n"] == stopped or not held["weight"]:
            break
        stopped, level = held["n"], float(total - (held["cap"] or 0)) / float(held["weight"])
    return x.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def digest(doc_id: str, text: str, seed: str = SEED) -> Column:
    """32 hexadecimal digits of a row's id and text."""
    words = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), words).cast("binary"))


def chance(digits: Column, seed: Column) -> Column:
    """A number in [0, 1) from 52 bits of a digest, for a seed from 0 on."""
    return F.conv(digits.substr(seed + F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED, prefix: str = "mix_") -> DataFrame:
    """``docs (doc_id, text, source, ...)`` with ``mix_size, mix_source_size, mix_target, mix_copies`` added.

    A null text has size 0; a null source is a source of its own. Rows of one doc_id
    and null ids draw by their texts; rows equal in both draw alike, so reruns agree.
    Sources without words have target 0 and their documents no copies. Existing
    columns of the added names are replaced (another ``prefix`` keeps them); an
    empty table stays empty.
    """
    size, source, total, target, copies, drawn, digits = (f"{prefix}{c}" for c in ("size", "source", "source_size", "target", "copies", "seed", "digest"))
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stage(docs.select(F.col("source").alias(source), words.alias(size), digest("doc_id", "text", seed).alias(digits)), "sizes")
    aims = targets(sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), weights, most)
    per = aims.select(F.col("source").alias(source), F.col("source_size").alias(total), F.col("target").alias(target))
    few = per.count() <= BROADCAST_SOURCES
    hinted = lambda x: F.broadcast(x) if few else x
    rate = F.coalesce(F.try_divide(target, total), F.lit(0.0))
    fraction = rate - F.floor(rate)

    own = sizes.withColumnRenamed(source, f"_{source}").join(hinted(per), F.col(f"_{source}").eqNullSafe(F.col(source)))
    extra = [F.sum(F.when(chance(F.col(digits), F.lit(k)) < fraction, F.col(size)).otherwise(0)).alias(f"_{k}") for k in range(SEEDS)]
    sums = own.groupBy(source, total, target).agg(*extra)
    missed = F.array(*[F.struct(F.abs((F.floor(rate) * F.col(total) + F.col(f"_{k}")).cast("double") - F.col(target)).alias("far"), F.lit(k).alias("k")) for k in range(SEEDS)])
    per = stage(sums.select(source, total, target, F.array_min(missed)["k"].alias(drawn)), "sources")
    release(sizes)

    given = docs.drop(size, source, total, target, copies, drawn, digits).withColumn(size, words)
    out = given.join(hinted(per), F.col("source").eqNullSafe(F.col(source))).drop(source)
    one = (chance(digest("doc_id", "text", seed), F.col(drawn)) < fraction).cast("long")
    return out.withColumn(copies, (F.floor(rate) + one).cast("long")).drop(drawn)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents, each as often as its copies; the columns of ``docs``, whatever their names."""
    prefix = "mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    copies = f"{prefix}copies"
    rated = rates(docs, weights, most, seed, prefix)
    return rated.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
