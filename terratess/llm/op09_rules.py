"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: What is taken off either end of a word before it is looked up among the stop words.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stop words in a hundred words, at least.
LEAST_STOP = 3

#: Frequent function words of four languages, lower case.
STOP_WORDS = ("the of and to in is that it for with as was on are by this from at have not "
              "der die das und ist nicht ein eine mit von zu den sich des auf für im dem auch als "
              "le la les de et des un une est que dans pour qui sur pas au avec par en du "
              "el los las que y del se por con para una su al lo como más o este sí").split()  # fmt: skip


def stop_forms() -> list[str]:
    """Stop words as they are written: small, with a capital, in capitals."""
    return list(dict.fromkeys(form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())))


@dataclass(frozen=True)
class Rule:
    """A text passes if ``100 * value`` is at least ``least`` and at most ``most`` times ``per`` (columns of statistics)."""

    name: str
    value: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


BASE = (Rule("words", "n_words", least=50 * 100), Rule("repeated_words", "n_repeat_words", "n_words", most=50))

#: The method's own thresholds.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=2500),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("stop_words", "n_stop_words", "n_words", least=LEAST_STOP),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=40),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared by 64-bit hashes: within one text of a million words two
    differing windows collide with a probability under 3e-8. Sorted hashes show
    whether any repeats, and only then windows are sorted with their places; the
    words covered are counted in order of place.
    """
    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        at = let(placed, lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["to"], i)).alias("n"), (i + 3).alias("to")), lambda a: a["n"])

    repeats = lambda s: F.exists(F.transform(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False))), lambda y: y)
    return let(hashes, lambda h: F.when(let(F.sort_array(h), repeats), covered(h)).otherwise(F.lit(0)))


def statistics(text: Column) -> Column:
    """A struct of the statistics that rules may name; null counts as empty."""

    def of(pair: Column) -> Column:
        t, words = pair["t"], pair["words"]
        lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
        by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        # most are bare, and a look at the set is cheaper than taking marks off
        stop = F.filter(words, lambda w: F.when(w.isin(stop_forms()), True).otherwise(F.btrim(w, F.lit(MARKS)).isin(stop_forms())))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            by_line.alias("by_line"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(stop).cast("long").alias("n_stop_words"),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.struct(t.alias("t"), words_of(t).alias("words")), of))


def passes(rule: Rule) -> Column:
    value, per = F.col(rule.value) * 100, F.col(rule.per) if rule.per else F.lit(1)
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (value >= per * rule.least)
    if rule.most is not None:
        ok = ok & (value <= per * rule.most)
    return ok


def measure(docs: DataFrame) -> DataFrame:
    s = docs.select(F.col("doc_id").alias("doc_id"), statistics(F.col("text").cast("string")).alias("s"))
    return s.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")], F.col("s.by_line.n").cast("long").alias("n_lines"), F.col("s.by_line.dup").cast("long").alias("n_dup_lines"))


def judge(docs: DataFrame, base=BASE, rules=RULES) -> DataFrame:
    """``docs (doc_id, text, ...)`` to statistics, ``base_failed``, ``failed`` (names of failed rules) and ``kept``.

    One row per input row, repeated rows alike. Null and empty texts have no words
    and fail the base. Whole texts count. Further columns are not read; an empty
    table gives an empty result.
    """
    every = [*base, *rules]
    out = measure(docs).withColumn("failed", F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in every]), lambda x: x.isNotNull()))
    out = out.withColumn("base_failed", F.arrays_overlap("failed", F.array(*[F.lit(r.name) for r in base])))
    return out.withColumn("kept", F.size("failed") == 0)
