"""Adjacency of a mesh and orderings of its triangles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.operators.numbering import numbered, running
from terratess.staging import release, stage


def sides(elem: DataFrame) -> DataFrame:
    """``(tri, slot, a, b)``: the edge opposite each vertex, its ends in order."""
    each = F.array(*[F.struct(F.lit(k).alias("slot"), F.least(f"v{(k + 1) % 3}", f"v{(k + 2) % 3}").alias("a"), F.greatest(f"v{(k + 1) % 3}", f"v{(k + 2) % 3}").alias("b")) for k in range(3)])
    return elem.select("tri", F.inline(each))


def neighbours(elem: DataFrame) -> DataFrame:
    """``(tri, n0, n1, n2)``: across the edge opposite each vertex, -1 at the outline.

    An edge has one or two triangles, so one aggregation by edge replaces a self
    join; an edge with more is an error.
    """
    shared = sides(elem).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("tri", "slot"))).alias("t"))
    fault = F.raise_error(F.lit("an edge has more than two triangles"))
    shared = shared.withColumn("t", F.when(F.size("t") <= 2, F.col("t")).otherwise(fault.cast(shared.schema["t"].dataType)))
    pairs = F.transform("t", lambda x, i: F.struct(x["tri"].alias("tri"), x["slot"].alias("slot"), F.coalesce(F.get("t", 1 - i)["tri"], F.lit(-1)).alias("n")))
    flat = shared.select(F.inline(pairs))
    return flat.groupBy("tri").agg(*[F.max(F.when(F.col("slot") == k, F.col("n"))).alias(f"n{k}") for k in range(3)])


def edges(neigh: DataFrame) -> DataFrame:
    """Directed adjacency ``(i, j)``, missing neighbours dropped."""
    return neigh.select(F.col("tri").alias("i"), F.explode(F.array("n0", "n1", "n2")).alias("j")).where("j <> -1")


def adjacency(neigh: DataFrame) -> DataFrame:
    """The matrix as ``(i, j, value)``; values alternate 1 and 2 over entries in order of i, then slot.

    An entry's number follows from running counts over ranges of triangles.
    """
    rows = neigh.select("tri", F.filter(F.array("n0", "n1", "n2"), lambda x: x != -1).alias("js"))
    return running(rows, [F.col("tri").asc()], F.size("js"), "before").select(F.col("tri").alias("i"), "before", F.posexplode("js").alias("k", "j")).select("i", "j", ((F.col("before") + F.col("k")) % 2 + 1).cast("int").alias("value"))


def bandwidth(pairs: DataFrame) -> DataFrame:
    """The largest column less its row, at least 0."""
    return pairs.agg(F.coalesce(F.greatest(F.lit(0), F.max(F.col("j") - F.col("i"))), F.lit(0)).cast("long").alias("bandwidth"))


def density(pairs: DataFrame, n: DataFrame) -> DataFrame:
    """Entries and their share of the matrix; ``n`` has a row per triangle."""
    return pairs.agg(F.count("*").alias("nnz")).crossJoin(n.agg(F.count("*").alias("n"))).select("nnz", F.try_divide(F.col("nnz").cast("double"), F.col("n").cast("double") * F.col("n")).alias("density"))


def permuted(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Relabels both ends by ``order (tri, position)``."""
    p = lambda c: order.select(F.col("tri").alias(c), F.col("position").alias(f"_{c}"))
    return pairs.join(p("i"), "i").join(p("j"), "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"))


def relabelled(elem: DataFrame, neigh: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and neighbours with triangles renumbered."""
    new = order.select("tri", F.col("position").cast("int").alias("_new"))
    e = elem.join(new, "tri").select(F.col("_new").alias("tri"), "v0", "v1", "v2")
    n = neigh.join(new, "tri").select(F.col("_new").alias("tri"), "n0", "n1", "n2")
    for k in range(3):
        to = order.select(F.col("tri").alias(f"n{k}"), F.col("position").cast("int").alias("_to"))
        n = n.join(to, f"n{k}", "left").withColumn(f"n{k}", F.coalesce("_to", F.lit(-1))).drop("_to")
    return e, n.select("tri", "n0", "n1", "n2")


def partition_by_position(centres: DataFrame, parts: int) -> DataFrame:
    """``(tri, part)`` by recursive bisection of centres ``(tri, x, y)``: halves along alternating axes, or the larger share if odd.

    At each level triangles are numbered over ranges of (half, coordinate, id), so
    no task holds a half. Ties break by id, so parts differ by at most one
    triangle per level.
    """
    if parts <= 1:
        raise ValueError("a partition needs at least two parts")
    out = centres.withColumns({"first": F.lit(0), "many": F.lit(parts)})
    level = 0
    left = parts
    while left > 1:
        placed = numbered(out, [F.col("first").asc(), F.col("x" if level % 2 == 0 else "y").asc(), F.col("tri").asc()], "_place")
        halves = placed.groupBy("first").agg(F.min("_place").alias("_from"), F.count("*").alias("_n"))  # a row a part
        low = F.floor(F.col("many") / 2).cast("int")
        cut = F.floor(F.col("_n") * F.floor(F.col("many") / 2) / F.col("many"))
        out = placed.join(F.broadcast(halves), "first").withColumn("_low", (F.col("many") > 1) & (F.col("_place") - F.col("_from") < cut))
        out = out.drop("_place", "_from", "_n").withColumns({"first": F.when((F.col("many") > 1) & ~F.col("_low"), F.col("first") + low).otherwise(F.col("first")), "many": F.when(F.col("many") <= 1, F.col("many")).when(F.col("_low"), low).otherwise(F.col("many") - low)}).drop("_low")
        left, level = -(-left // 2), level + 1
    return out.select("tri", F.col("first").alias("part"))


def edge_cut(pairs: DataFrame, parts: DataFrame) -> int:
    """Links between triangles of different parts; ``pairs`` holds each twice."""
    p = lambda c: parts.select(F.col("tri").alias(c), F.col("part").alias(f"_{c}"))
    return pairs.where("i < j").join(p("i"), "i").join(p("j"), "j").where("_i <> _j").count()


def partition_by_graph(parts: DataFrame, neigh: DataFrame, sweeps: int = 8) -> DataFrame:
    """``parts (tri, part)`` with triangles exchanged between parts so that fewer links are cut; sizes stay.

    In a sweep each triangle with more neighbours in another part than in its own asks
    to go there; of two parts as many go either way, those that gain most first.
    Sweeps end when the cut no longer falls, and the best partition stays. A sweep is
    one pass of joins; ranks within a pair of parts come from ranges, not from one task.
    """
    pairs = stage(edges(neigh), "links")
    best = stage(parts.select("tri", "part"), "parts")
    cut = edge_cut(pairs, best)
    for turn in range(sweeps):
        near = pairs.join(best.select(F.col("tri").alias("j"), F.col("part").alias("there")), "j").groupBy("i", "there").agg(F.count("*").alias("n"))
        own = near.join(best.select(F.col("tri").alias("i"), "part"), "i")
        home = own.groupBy("i", "part").agg(F.sum(F.when(F.col("there") == F.col("part"), F.col("n")).otherwise(0)).alias("held"), F.max(F.when(F.col("there") != F.col("part"), F.struct("n", (-F.col("there")).alias("minus")))).alias("away"))
        # only every other triangle, by turns, so that neighbours don't change places together
        wish = home.where((F.col("away")["n"] > F.col("held")) & (F.xxhash64("i", F.lit(turn)) % 2 == 0)).select(F.col("i").alias("tri"), "part", (-F.col("away")["minus"]).alias("to"), (F.col("away")["n"] - F.col("held")).alias("gain"))
        placed = numbered(wish, [F.col("part").asc(), F.col("to").asc(), F.desc("gain"), F.col("tri").asc()], "place")
        flows = placed.groupBy("part", "to").agg(F.min("place").alias("first"), F.count("*").alias("n"))  # a row a pair of parts
        back = flows.select(F.col("part").alias("to"), F.col("to").alias("part"), F.col("n").alias("back"))
        allowed = F.broadcast(flows.join(back, ["part", "to"]).select("part", "to", "first", F.least("n", "back").alias("many")))
        goes = placed.join(allowed, ["part", "to"]).where(F.col("place") - F.col("first") < F.col("many")).select("tri", F.col("to").alias("_to"))
        fresh = stage(best.join(goes, "tri", "left").select("tri", F.coalesce("_to", "part").alias("part")), "parts")
        now = edge_cut(pairs, fresh)
        if now >= cut:
            release(fresh)
            if turn % 2:  # both halves of the triangles have had a turn
                break
            continue
        release(best)
        best, cut = fresh, now
    release(pairs)
    return best


def partition_order(parts: DataFrame) -> DataFrame:
    """``(tri, part, position)``: by part, then id."""
    return numbered(parts.select("tri", "part"), [F.col("part").asc(), F.col("tri").asc()], "position")


def partition_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("local_size"))


def cuthill_mckee(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Reverse Cuthill-McKee: the triangle at each position. Components start at a node of least degree; ties by id."""
    order = np.argsort(i, kind="stable")
    to = j[order]
    at = np.searchsorted(i[order], np.arange(n + 1))
    degree = np.diff(at)
    seen = np.zeros(n, dtype=bool)
    out: list[int] = []
    for start in np.lexsort((np.arange(n), degree)).tolist():
        if seen[start]:
            continue
        seen[start] = True
        out.append(start)
        k = len(out) - 1
        while k < len(out):
            u = out[k]
            near = np.unique(to[at[u] : at[u + 1]])
            near = near[~seen[near]]
            near = near[np.lexsort((near, degree[near]))]
            seen[near] = True
            out += near.tolist()
            k += 1
    return np.array(out[::-1], dtype=np.int64)


def rcm_order(neigh: DataFrame) -> DataFrame:
    """``(tri, position)`` by reverse Cuthill-McKee.

    The ordering is one sequential walk of the graph; it runs in a single task over
    16 bytes per link, so it suits meshes that one worker holds. Larger ones are
    partitioned first (``partition_order``).
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(group["i"].unique())
        links = group[group["j"] >= 0]
        order = cuthill_mckee(np.searchsorted(ids, links["i"]), np.searchsorted(ids, links["j"]), len(ids))
        return pd.DataFrame({"tri": ids[order].astype("int32"), "position": np.arange(len(ids))})

    every = edges(neigh).unionByName(neigh.select(F.col("tri").alias("i"), F.lit(-1).alias("j")))
    return every.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(run, "tri int, position long")


def dissection_order(centres: DataFrame, levels: int = 3) -> DataFrame:
    """``(tri, position)``: recursive bisection to ``2 ** levels`` parts, in the order of parts, then ids."""
    return partition_order(partition_by_position(centres, 2**levels)).select("tri", "position")


def permutation_report(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Bandwidth before and after."""
    before = bandwidth(pairs).select(F.lit("before").alias("when"), "bandwidth")
    return before.unionByName(bandwidth(permuted(pairs, order)).select(F.lit("after").alias("when"), "bandwidth"))
