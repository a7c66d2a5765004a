"""Secret scans with SQL functions only.

Candidates are long tokens that hold a digit, values assigned to a secret word (in
quotes or not), signed web tokens and private key blocks. Length, character transitions, dictionary
coverage, path context and neighbouring words are measured by built-in functions, and
a random forest, trained from labelled findings, removes false positives. The
forest is compiled into one SQL expression, so scanning is a projection: no
shuffle, no user function.
"""

from __future__ import annotations

import pkgutil
import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.staging import release, stage

TREES, DEPTH, SEED = 25, 8, 7
ACCEPT = 0.5
MARK = "[SECRET]"
#: Neighbouring words are those in so many characters on either side.
NEAR = 64
#: Lines that are made of each labelled format.
VARIANTS = 40

#: Words that name a secret, and what may stand between such a word and its value.
NAMED = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credentials?)[A-Za-z0-9_-]{0,16}[\"'`]?[ \t]{0,2}[:=]{1,2}>?[ \t]{0,2}[\"'`]?"
#: Any value after an assignment to a secret word; the cheap look back comes first.
ASSIGNED = rf"(?<=[:=>\"'` \t])(?<=[:=>][ \t]{{0,2}}[\"'`]?)(?<={NAMED})[^\s\"'`,;(){{}}<>\[\]$&]{{5,}}+(?<![.,:!?])"
#: The same in quotes, which may hold spaces.
QUOTED = rf"(?<=[\"'`])(?<=[:=>][ \t]{{0,2}}[\"'`])(?<={NAMED})[^\"'`\n\r]{{6,}}+(?=[\"'`])"
#: Starts of tokens are found by what precedes them, so a long token is read once, not from each of its characters.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:\.[A-Za-z0-9+/_-]{16,}+){0,2}={0,2}"
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\\-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
CANDIDATE = f"{BLOCK}|{QUOTED}|{ASSIGNED}|{TOKEN}"

#: Words that credentials rarely hold.
DICTIONARY = "example sample test dummy placeholder change replace your insert here none null secret password passwd token key access default user admin demo fake value string public version license page file image index main home data info name lorem ipsum abcdef qwerty xxxx aaaa 0000 1234 4321 required optional undefined please enter must should with from that this have will word number field input output table column size count type class object method function return primary foreign customer order product session cookie header request response server client config setting option parameter argument build release update static assets module package library local path route http https html json true false next parse list array request process factory service model view element".split()
SECRET_WORDS = r"(token|secret|key|passw|passwd|password|passphrase|pwd|pass|auth|bearer|credential|apikey|private)[a-z_]{0,8}[^a-z0-9]{0,6}$"
HARMLESS_WORDS = r"(commit|sha|sha1|sha256|sha512|md5|checksum|hash|rev|revision|uuid|id|digest|etag|blob|tree|version|order|invoice|isbn|serial|public|primary|foreign|fingerprint|integrity|base64|request|trace|merge|in|see|rsa)[^a-z0-9]{0,6}$"
ISSUERS = r"^(AKIA|ASIA|AIza|gh[opsu]_|github_pat_|glpat-|xox[abeoprs]-|[rs]k_live_|sk-|npm_|pypi-|shpat_|dop_v1_|hf_|SG\\.|eyJ|-----BEGIN)"

FEATURES = {
    "length": "length(c)",
    "digits": "regexp_count(c, '[0-9]') / length(c)",
    "capitals": "regexp_count(c, '[A-Z]') / length(c)",
    "marks": "regexp_count(c, '[^A-Za-z0-9]') / length(c)",
    "spaces": "regexp_count(c, ' ') / length(c)",
    "class_changes": "regexp_count(c, '(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])') / length(c)",
    "syllables": "regexp_count(lower(c), '[bcdfghjklmnpqrstvwxyz][aeiou]') / length(c)",
    "rare_pairs": "regexp_count(lower(c), '[bcdfghjkmpqtvwxz](?=[bcdfgjkmpqvwxz])') / length(c)",
    "hex": "if(regexp_like(c, '^([0-9a-f]+|[0-9A-F]+)$'), 1.0, 0.0)",
    "plain": "if(regexp_like(c, '^[A-Za-z]+$'), 1.0, 0.0)",
    "grouped": "if(regexp_like(c, '^[0-9a-fA-F]+(-[0-9a-fA-F]+){2,4}$'), 1.0, 0.0)",
    "distinct": "size(array_distinct(split(c, '')))",
    "repeats": "regexp_count(c, '(.)(?=\\\\1)') / length(c)",
    "separators": "regexp_count(c, '[-_/+.]') / length(c)",
    "dictionary": "1 - length(regexp_replace(lower(c), '{words}', '')) / length(c)",
    "issuer": "if(regexp_like(c, '{issuers}'), 1.0, 0.0)",
    "path": "if(regexp_like(b, '(://|[/\\\\\\\\.])[^ ]{0,40}$') or regexp_like(a, '^[./][a-z]'), 1.0, 0.0)",
    "secret_word": "if(regexp_like(lower(b), '{secret}'), 1.0, 0.0)",
    "harmless_word": "if(regexp_like(lower(b), '{harmless}'), 1.0, 0.0)",
    "quoted": "if(regexp_like(b, '[\"\\'`]$') and regexp_like(a, '^[\"\\'`]'), 1.0, 0.0)",
    "assigned": "if(regexp_like(b, '[:=]\\\\s?[\"\\'`]?$'), 1.0, 0.0)",
    "called": "if(regexp_like(a, '^[(\\\\[.{<]'), 1.0, 0.0)",
    "goes_on": "if(regexp_like(a, '^[,.:;!?]* [A-Za-z]'), 1.0, 0.0)",
}


def feature_sql() -> list[str]:
    """Expressions over a candidate ``c``, the text before it ``b`` and after it ``a``."""
    put = {"{words}": "|".join(sorted(dict.fromkeys(DICTIONARY), key=lambda w: (-len(w), w))), "{secret}": SECRET_WORDS, "{harmless}": HARMLESS_WORDS, "{issuers}": ISSUERS}
    out = []
    for x in FEATURES.values():
        for name, value in put.items():
            x = x.replace(name, value)
        out.append(f"cast({x} as double)")
    return out


def _filled(part: str, r: random.Random) -> str:
    """A format with its classes, lengths and words drawn."""

    def drawn(m: re.Match) -> str:
        if m[0] == "<word>":
            return r.choice(DICTIONARY) if r.random() < 0.5 else "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 3)))
        letters = "".join("".join(map(chr, range(ord(x[0]), ord(x[-1]) + 1))) for x in re.findall(r".-.|.", m[1]))
        n = r.randint(int(m[2]), int(m[3] or m[2])) if m[2] else 1
        return "".join(r.choice(letters) for _ in range(n))

    return re.sub(r"<word>|\[([^\]]+)\](?:\{(\d+)(?:,(\d+))?\})?", drawn, part).replace("\\n", "\n")


def example_findings(spark: SparkSession, variants: int = VARIANTS, seed: int = SEED) -> DataFrame:
    """Labelled findings ``(format, variant, text, start, length)`` from the formats of ``data/findings.txt``: in each text the secret's place, null if it has none."""
    lines = [x for x in pkgutil.get_data(__package__, "data/findings.txt").decode().splitlines() if x and x[0] != "#"]
    r, rows = random.Random(seed), []
    noise = lambda n: " ".join(_filled("<word>", r) for _ in range(r.randint(0, n)))
    for number, line in enumerate(lines):
        before, _, rest = line.partition("«")
        secret, _, after = rest.partition("»")
        for v in range(variants):
            head = noise(6)
            if head:
                head += r.choice([" ", "\n", ". ", "; "])
            tail = r.choice(["", "\n" + noise(4), " " + noise(4), "\n"])
            head, kept = head + _filled(before, r), _filled(secret, r)
            text = head + kept + _filled(after, r) + tail
            rows.append((number, v, text, len(head) if secret else None, len(kept) if secret else None))
    return spark.createDataFrame(rows, "format int, variant int, text string, start int, length int")


def _tree_sql(text: str) -> str:
    """A CASE expression of one tree's printed rules over an array ``f``."""
    lines = [x for x in text.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]

    def build(at: int) -> tuple[str, int]:
        line = lines[at].strip()
        if line.startswith("Predict"):
            return line.split(":")[1].strip(), at + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes, at = build(at + 1)
        no, at = build(at + 1)  # the line at `at` is the Else
        return (yes, at) if yes == no else (f"if(f[{m[1]}] <= {float(m[2])!r}D, {yes}, {no})", at)

    return build(0)[0]


def measured(findings: DataFrame) -> DataFrame:
    """The candidates of ``findings (text, start, length, ...)``: further columns, ``features`` as an array, ``label`` 1.0 for those that share characters with the text's secret."""
    others = [c for c in findings.columns if c not in ("text", "start", "length")]
    entry = "named_struct('at', at[i], 'n', length(x.c[i]), 'f', f)"
    each = "transform(x.c, (c, i) -> " + _let("{before}", "b", _let("{after}", "a", _let("array({features})", "f", entry))) + ")"
    each = each.replace("{before}", _BEFORE).replace("{after}", _AFTER).replace("{features}", ", ".join(feature_sql()))
    table = findings.select(*others, "start", "length", F.explode(F.expr(_let(_found(), "x", _let(_PLACES, "at", each)))).alias("e"))
    meets = F.coalesce((F.col("e.at") < F.col("start") + F.col("length")) & (F.col("start") < F.col("e.at") + F.col("e.n")), F.lit(False))
    return table.select(*others, F.col("e.f").alias("features"), meets.cast("double").alias("label"))


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A random forest from ``findings (text, start, length, ...)``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    # measured once, in one order: draws don't depend on the cluster
    table = stage(measured(findings).select("features", "label").repartition(1).sortWithinPartitions("features", "label"), "findings")
    rows = table.select(array_to_vector("features").alias("features"), "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(rows)
    release(table)
    return model


def compiled(model) -> str:
    """A forest as SQL over an array of features ``f``: the share of trees that say secret."""
    votes = [_tree_sql(t.toDebugString) for t in model.trees]
    return f"({' + '.join(votes)}) / {len(votes)}D"


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """The SQL of a forest fitted to ``findings``; these are bounded, as a person has labelled them."""
    return compiled(fit(findings, trees, depth, seed))


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _found() -> str:
    """Candidates ``c`` of a text and the gaps ``g`` before, between and behind them."""
    candidate = CANDIDATE.replace("\\", "\\\\").replace("'", "\\'")
    return _let(f"regexp_extract_all(text, '{candidate}', 0)", "every", f"named_struct('c', every, 'g', if(size(every) = 0, array(text), split(text, '{candidate}')))")


#: Neighbouring text of candidate i, which may be part of the candidates beside it.
_BEFORE = f"if(i = 0 or length(x.g[i]) >= {NEAR}, right(x.g[i], {NEAR}), right(concat(right(x.c[i - 1], {NEAR}), x.g[i]), {NEAR}))"
_AFTER = f"if(i + 1 >= size(x.c) or length(x.g[i + 1]) >= {NEAR}, left(x.g[i + 1], {NEAR}), left(concat(x.g[i + 1], left(x.c[i + 1], {NEAR})), {NEAR}))"

# places of candidates: sums over blocks of about the root of their number, then within blocks, as appending to an array copies it
_RUNNING = "aggregate({values}, named_struct('at', {first}, 'out', cast(array() as array<int>)), (s, v) -> named_struct('at', s.at + v, 'out', array_append(s.out, s.at)), s -> s.out)"
_SUMS = "transform(blocks, y -> aggregate(y, 0, (s, v) -> s + v))"
_STARTS = "flatten(transform(blocks, (y, k) -> " + _RUNNING.format(values="y", first="offsets[k]") + "))"
_PLACES = (
    "if(size(x.c) = 0, cast(array() as array<int>), "
    + _let(
        "cast(ceil(sqrt(size(x.c))) as int)",
        "w",
        _let(
            "transform(sequence(0, cast(ceil(size(x.c) / w) as int) - 1), k -> transform(slice(x.c, k * w + 1, w), (c, j) -> length(x.g[k * w + j]) + length(c)))",
            "blocks",
            _let(_RUNNING.format(values=_SUMS, first="0"), "offsets", _let(_STARTS, "starts", "transform(starts, (q, i) -> q + length(x.g[i]))")),
        ),
    )
    + ")"
)


def scan(docs: DataFrame, forest: str, accept: float = ACCEPT, prefix: str = "") -> DataFrame:
    """``docs`` with ``secrets`` and ``clean_text`` added (existing columns of these names are replaced; a ``prefix`` keeps them).

    ``secrets`` holds every candidate in order as (start in characters, length,
    score, accepted); ``clean_text`` is the text with accepted ones replaced by
    ``MARK``. A null text has null for both; an empty one no candidates. Whole
    texts and candidates of any length are scanned; repeated rows have equal results;
    an empty table stays empty.
    """
    f = _let(f"array({', '.join(feature_sql())})", "f", forest)
    scored = "transform(x.c, (c, i) -> " + _let(_BEFORE, "b", _let(_AFTER, "a", f)) + ")"
    entries = f"transform(p, (q, i) -> named_struct('start', at[i], 'length', length(x.c[i]), 'score', q, 'accepted', q >= {accept}D))"
    entries = _let(_PLACES, "at", entries)
    clean = f"if(exists(p, q -> q >= {accept}D), array_join(transform(x.g, (g, i) -> concat(g, if(i < size(p), if(p[i] >= {accept}D, '{MARK}', x.c[i]), ''))), ''), text)"
    both = _let(_found(), "x", _let(scored, "p", f"named_struct('secrets', {entries}, 'clean_text', {clean})"))
    found, secrets, clean_text = (f"{prefix}{c}" for c in ("found", "secrets", "clean_text"))
    out = docs.drop(secrets, clean_text).withColumn(found, F.expr(f"if(text is null, null, {both})"))
    return out.withColumns({secrets: F.col(found)["secrets"], clean_text: F.col(found)["clean_text"]}).drop(found)


def redact(docs: DataFrame, forest: str, accept: float = ACCEPT) -> DataFrame:
    """The rows and columns of ``docs`` with secrets replaced in ``text``; ``n_chars`` follows where the text changed."""
    prefix = "scan_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = scan(docs, forest, accept, prefix)
    clean = F.col(f"{prefix}clean_text")
    put = {"text": clean}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(clean != F.col("text"), F.length(clean).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(put).select(*docs.columns)
