"""Language identification by compression.

Each language has a raw-content zstandard dictionary of excerpts of its training
texts. A text is compressed, piece by piece, with every dictionary; the language
of the smallest total wins, and a narrow margin is flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training bound: so many excerpts of so many characters each for a language, chosen by a hash of the id.
EXCERPTS, EXCERPT_CHARS = 96, 1024
#: Most languages that can be learned; more is an error, not a silent cut.
MOST_LANGUAGES = 200
#: Texts are compressed in pieces of so many bytes; each piece starts from the dictionary alone, so long texts don't teach the compressor.
PIECE = 4096
#: Effort (zstandard level) for texts of under ``SHORT`` bytes, where single bytes decide, and for longer ones.
SHORT, SHORT_LEVEL, LEVEL = 1000, 12, 6
#: The runner-up must be larger by this share of the smallest size.
MARGIN = 0.01
UNKNOWN = "und"


def letters(column):
    """Lower-cased runs of letters, separated by single spaces; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\p{L}]+", " "))


def learn(docs: DataFrame, excerpts: int = EXCERPTS) -> dict[str, bytes]:
    """Dictionaries from ``docs (doc_id, text, lang)``: per language at most ``excerpts`` texts' first ``EXCERPT_CHARS`` letters.

    One text for each (language, bucket of the id's hash): the least hash wins, so
    the choice is independent of partitioning and the aggregate's state is bounded.
    Rows with a null text or language teach nothing; repeated rows change nothing.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").where("text is not null and lang is not null")
    h = F.xxhash64(F.coalesce("doc_id", F.lit("")), "lang")
    known = docs.select("lang", F.pmod(h, F.lit(excerpts)).alias("bucket"), F.struct(h.alias("h"), F.substring(letters(F.col("text")), 1, EXCERPT_CHARS).alias("excerpt")).alias("x"))
    rows = known.groupBy("lang", "bucket").agg(F.min("x")["excerpt"].alias("excerpt")).limit((MOST_LANGUAGES + 1) * excerpts).collect()
    by: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["bucket"], r["excerpt"]))
    if len(by) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {lang: " ".join(x for _, x in sorted(found)).encode() for lang, found in sorted(by.items())}


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def sizes(model: tuple[tuple[str, bytes], ...], text: bytes) -> list[int]:
    """Compressed size of the whole text by each dictionary."""
    compressors = _compressors(model, SHORT_LEVEL if len(text) < SHORT else LEVEL)
    out = [0] * len(compressors)
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        for k, c in enumerate(compressors):
            out[k] += len(c.compress(piece))
    return out


def _classified(model: tuple[tuple[str, bytes], ...], margin: float):
    names = [lang for lang, _ in model]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column(1):
                text = text.as_buffer().to_pybytes()
                if not text.strip() or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                size = np.array(sizes(model, text))
                best = int(size.argmin())  # ties: the first by name
                lead = (float(np.delete(size, best).min()) / float(size[best]) - 1) if len(size) > 1 else 1.0
                langs.append(names[best])
                scores.append(min(1.0, lead))
                rejected.append(lead < margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "best", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs (doc_id, text, ...)`` to ``(doc_id, best, score, rejected, lang)``, one row per input row.

    ``best`` is the language of the smallest compressed size (ties: the first
    name), ``score`` the runner-up's excess as a share of it (at most 1),
    ``rejected`` whether that is under ``margin``; ``lang`` is ``best``, or ``und``
    where rejected. Null and empty texts, texts without a letter, and all texts if
    nothing was learned: ``und``, score 0, rejected. Whole texts are read, in
    pieces; only these two columns are, so others of any name are harmless.
    """
    slim = docs.select(F.col("doc_id").alias("doc_id"), letters(F.col("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = slim.mapInArrow(_classified(tuple(model.items()), margin), f"doc_id {kind}, best string, score double, rejected boolean")
    return out.withColumn("lang", F.when(F.col("rejected"), F.lit(UNKNOWN)).otherwise(F.col("best")))
