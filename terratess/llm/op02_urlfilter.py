"""URL filters on a sorted digest array.

Rules and block lists are keys ``host/path``: each key's 64-bit xxhash stands in
one sorted array, its full string beside it. Lists are tables of any source: Spark
removes repeated keys, sorts them by digest and encodes them; the driver only passes
the encoded chunks on to files in the shared folder, chunk by chunk. Spark hands
every executor a copy, which its workers memory-map. A url is looked up by
vectorised binary search under every suffix of its host and every prefix of its path
that has the length of some key's path; a hit counts only if the stored string is
equal, so colliding digests do no harm.
"""

from __future__ import annotations

import os
import pkgutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.staging import SharedFile, release, stage

#: Hosts that the method itself blocks where no rule decides; all their subdomains too.
BLOCKED_HOSTS = tuple(x for x in pkgutil.get_data(__package__, "data/blocked_hosts.txt").decode().split("\n") if x and x[0] != "#")
#: Most bytes of a list's files, as every executor gets a copy.
MOST_BYTES = 4 << 30
CHUNK = 1 << 14
#: The seed of Spark's own xxhash64 function.
SEED = 42

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest_of(key: str) -> int:
    """What Spark's xxhash64 gives for the string."""
    n = xxhash.xxh64_intdigest(key, seed=SEED)
    return n - (1 << 64) if n >> 63 else n


def entries(rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """``rules (verdict, host, path)`` and ``blocked (host)`` as (kind, verdict, key, depth), each kind's key once; of equal rules block wins. Rows with nulls and empty paths are left out."""
    own = rules.select(F.lit("r").alias("kind"), F.substring("verdict", 1, 1).alias("verdict"), F.concat("host", "path").alias("key"), F.length("path").alias("depth"))
    method = blocked.select(F.lit("m").alias("kind"), F.lit("b").alias("verdict"), F.concat("host", F.lit("/")).alias("key"), F.lit(1).alias("depth"))
    return own.unionByName(method).where("verdict is not null and key is not null and depth > 0").groupBy("kind", "key").agg(F.max("verdict").alias("verdict"), F.max("depth").alias("depth"))


def _encoded(batches) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, line) as chunks of (digests, lengths, bytes)."""
    for batch in batches:
        lines = batch.column(1).cast(pa.binary())
        sizes = np.array([len(x) for x in lines.to_pylist()], dtype="<i8")
        out = (np.asarray(batch.column(0)).astype("<i8").tobytes(), sizes.tobytes(), b"".join(lines.to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in out], ["keys", "sizes", "text"])


@dataclass(frozen=True)
class Published:
    """Names of the files that every executor has, and the lengths of paths by kind."""

    name: str
    depths: tuple[tuple[str, int], ...]


def publish(spark: SparkSession, rules: DataFrame, blocked: DataFrame) -> Published:
    """Sorts and encodes the lists, writes them to the shared folder and has Spark copy them to every executor."""
    held = stage(entries(rules, blocked).withColumn("line", F.concat("kind", "verdict", "key")).withColumn("digest", F.xxhash64(F.concat("kind", "key"))), "entries")
    shapes = held.groupBy("kind", "depth").agg(F.sum(F.octet_length("line") + 16).alias("size")).collect()  # a row for each length of a path
    if sum(r["size"] for r in shapes) > MOST_BYTES:
        raise ValueError("the lists are too large to copy to every executor")
    chunks = held.orderBy("digest", "line").select("digest", "line").mapInArrow(_encoded, "keys binary, sizes binary, text binary")
    chunks = stage(chunks.withColumn("place", F.monotonically_increasing_id()), "chunks")
    name = f"digests-{uuid.uuid4().hex}"
    keys, at, text = files = [SharedFile(spark, f"lists/{name}.{kind}") for kind in ("keys", "at", "text")]
    end = 0
    at.write(np.zeros(1, dtype="<i8").tobytes())
    for r in chunks.orderBy("place").toLocalIterator():  # the driver holds a partition of chunks at a time
        keys.write(bytes(r["keys"]))
        text.write(bytes(r["text"]))
        ends = end + np.cumsum(np.frombuffer(r["sizes"], dtype="<i8"))
        at.write(ends.astype("<i8").tobytes())
        end = int(ends[-1]) if len(ends) else end
    for f in files:
        f.close()
        spark.sparkContext.addFile(f.path)
    release(held, chunks)
    return Published(name, tuple(sorted((r["kind"], r["depth"]) for r in shapes)))


class DigestArray:
    """Memory-mapped files of sorted digests, where each string starts, and the strings (kind, verdict, key)."""

    def __init__(self, keys: str, at: str, text: str, depths: Iterable[tuple[str, int]] = ()):
        self.depths = list(depths)
        mapped = lambda path, kind: np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kind)
        self.keys, self.at, self.text = mapped(keys, "<i8"), mapped(at, "<i8"), mapped(text, np.uint8)

    def find(self, keys: list[str]) -> list[str | None]:
        """For ``kind + key`` its verdict, or none."""
        if not keys or not len(self.keys):
            return [None] * len(keys)
        digests = np.fromiter(map(digest_of, keys), dtype=np.int64, count=len(keys))
        at = np.searchsorted(self.keys, digests)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == digests[hit]
        out: list[str | None] = [None] * len(keys)
        for i in np.flatnonzero(hit).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:  # colliding digests stand side by side
                s = self.text[self.at[k] : self.at[k + 1]].tobytes().decode()
                if s[0] + s[2:] == keys[i]:
                    out[i] = s[1]
                    break
                k += 1
        return out


@lru_cache(maxsize=4)
def _mapped(published: Published) -> DigestArray:
    return DigestArray(*(SparkFiles.get(f"{published.name}.{kind}") for kind in ("keys", "at", "text")), published.depths)


def judge(array: DigestArray, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
    """For each url the deciding rule (else none) and the verdict."""
    keys, spans = [], []
    for host, path in zip(hosts, paths):
        begin = len(keys)
        if host:
            labels = host.split(".")
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for kind, n in array.depths:
                    if kind == "m":
                        keys.append(f"m{suffix}/")
                    elif len(path) >= n:
                        keys.append(f"r{suffix}{path[:n]}")
        spans.append((begin, len(keys)))
    found = array.find(keys)
    rules: list[str | None] = []
    verdicts = []
    for begin, end in spans:
        best, verdict, own = None, "allow", "allow"
        for k in range(begin, end):
            if found[k] is None:
                continue
            if keys[k][0] == "m":
                own = "block"
            elif best is None or (len(keys[k]), keys[k]) > (len(best), best):
                best, verdict = keys[k], "allow" if found[k] == "a" else "block"
        rules.append(best[1:] if best else None)
        verdicts.append(verdict if best else own)
    return rules, verdicts


def _judged(published: Published):
    def run(batches) -> Iterator[pa.RecordBatch]:
        array = _mapped(published)
        for batch in batches:
            for part in range(0, max(batch.num_rows, 1), CHUNK):
                b = batch.slice(part, CHUNK)
                rules, verdicts = judge(array, b.column(1).to_pylist(), b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[Rule], blocked: DataFrame | Iterable[str] = BLOCKED_HOSTS) -> DataFrame:
    """``pages (page_id, url, ...)`` to ``(page_id, host, path, rule, verdict)``, one row per input row.

    The longest matching rule (characters of host and path, then its text) decides;
    without one the method blocks the hosts of ``blocked`` and their subdomains
    and allows the rest. Lists are tables, ``rules (verdict, host, path)`` and
    ``blocked (host)``, or small collections; of equal rules block wins. A null url,
    or one without ``://``, has empty host and path and is allowed. A rule path must
    not be empty. Repeated rows are judged alike; further columns are not read; an
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in blocked], "host string")
    published = publish(spark, rules, blocked)
    kind = pages.schema["page_id"].dataType.simpleString()
    url = F.col("url").cast("string")
    slim = pages.select(F.col("page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return slim.mapInArrow(_judged(published), f"page_id {kind}, host string, path string, rule string, verdict string")
