"""URL filters, exact search, queries against SQL, the pipeline."""

import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from terratess.llm import op02_urlfilter, op06_topk
from terratess.llm.op02_urlfilter import DigestArray, Rule

SF = Path("/root/testdata/sf0.001")
LABELLED = Path("/root/testdata/sf0.01")  # enough labels for the classifier


def verdict(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([k for c in "?#" if (k := rest.find(c)) >= 0], default=len(rest))]
    under = lambda h: host == h or host.endswith("." + h)
    hits = [r for r in rules if under(r.host) and path.startswith(r.path)]
    best = max(hits, key=lambda r: (len(r.host + r.path), r.host + r.path), default=None)
    own = "block" if any(under(h) for h in blocked) else "allow"
    return host, path, best and best.host + best.path, best.verdict if best else own


def test_urls_equal_brute_force(spark):
    r = random.Random(1)
    hosts = ["net", "example.net", "a.example.net", "example.com", "x.org", "org", "bad.site", "WWW.Bad.Site", "site"]
    paths = ["", "/", "/en/", "/en/x", "/de/a", "/fr", "/fr/b?x=/en/", "#top", "?q", "/en"]
    urls = [None, "", "no scheme", "://", "a://", "http:///x", "http://example.net://b/en/"] + [f"{r.choice(['http', 'ftp'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    rules = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("allow", "site", "/e")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in op02_urlfilter.filter_urls(pages, rules, ["bad.site"]).collect()}
    assert found == {i: verdict(u, rules, ["bad.site"]) for i, u in enumerate(urls)}
    assert op02_urlfilter.filter_urls(pages.limit(0), rules).count() == 0
    assert {x.verdict for x in op02_urlfilter.filter_urls(pages, [], []).collect()} == {"allow"}


def test_lists_are_tables_of_any_size(spark):
    """Thousands of keys sorted and encoded by Spark, repeated and null ones among them."""
    r = random.Random(4)
    rows = [(r.choice(["allow", "block"]), f"h{r.randrange(3000)}.org", r.choice(["/", "/a/", "/a/b", "/\u00e9"])) for _ in range(6000)] + [(None, "x.org", "/"), ("block", None, "/"), ("block", "y.org", "")]
    rules = spark.createDataFrame(rows, "verdict string, host string, path string").repartition(7)
    blocked = spark.createDataFrame([(f"b{k}.net",) for k in range(4000)] * 2 + [(None,)], "host string").repartition(5)
    pages = [(i, f"http://{r.choice(['', 'w.'])}{r.choice('hb')}{r.randrange(4500)}.{r.choice(['org', 'net'])}{r.choice(['', '/', '/a/', '/a/b/c', '/\u00e9x'])}") for i in range(3000)]
    known = {}
    for v, h, p in rows:
        if v and h and p:
            known[h, p] = max(v, known.get((h, p), "allow"))
    by_host = {}
    for (h, p), v in known.items():
        by_host.setdefault(h, []).append(Rule(v, h, p))
    own = {f"b{k}.net" for k in range(4000)}
    found = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in op02_urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules, blocked).collect()}
    for i, u in pages:
        host = verdict(u, [], [])[0]
        name = host.removeprefix("w.")
        assert found[i] == verdict(u, by_host.get(name, []), [name] if name in own else [])


def test_digests_are_those_of_spark(spark):
    keys = ["", "a", "rnet/", "m\u00e9\U0001f600.org/", "x" * 100]
    found = spark.createDataFrame([(k,) for k in keys], "k string").select("k", F.xxhash64("k").alias("d")).collect()
    assert {x.k: x.d for x in found} == {k: op02_urlfilter.digest_of(k) for k in keys}


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(op02_urlfilter, "digest_of", lambda s: 7)
    lines = [b"rba.net/", b"rab.net/", b"rbc.net/"]
    parts = (np.full(3, 7, dtype="<i8").tobytes(), np.cumsum([0, *map(len, lines)]).astype("<i8").tobytes(), b"".join(lines))
    for name, content in zip("kat", parts):
        (tmp_path / name).write_bytes(content)
    array = DigestArray(*(str(tmp_path / name) for name in "kat"))
    assert array.find(["rb.net/", "ra.net/", "rx.net/", "rc.net/"]) == ["a", "b", None, "b"]


def brute_topk(rows, k):
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for row, (q, v) in enumerate(ok):
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(ok) if other != row and len(v) == len(w)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return Counter(out)


@pytest.mark.parametrize("dense", [True, False])
def test_topk_equals_brute_force(spark, dense):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) if dense or r.random() < 0.2 else 0.0 for _ in range(16)]) for i in range(600)]
    rows += [(700, None), (720, [1.0, None] * 8), (740, [float("nan")] * 16), (760, [float("inf")] + [0.0] * 15), (780, []), (781, []), (800, [0.5] * 3), (801, [0.25] * 3), (None, [0.1] * 16)]
    rows += [(i + 2000, rows[0][1]) for i in range(60)] + [(20, rows[20][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(x.vec_id, x.embedding) for x in table.collect()]
    found = op06_topk.search(table.withColumn("score", F.lit(1)), lambda v: v % 20 == 0, k=7, shard_rows=100).collect()
    assert Counter((x.query_id, x.rank, x.vec_id, x.score) for x in found) == brute_topk(exact, 7)
    assert op06_topk.search(table.limit(0), lambda v: v % 20 == 0).count() == 0


def test_topk_of_large_components_is_exact(spark):
    """Products beyond 2**24 and 2**53 leave the faster types; what may not fit 62 bits is an error."""
    r = random.Random(7)
    for size in (100.0, 1e5, 1e7):
        rows = [(i, [float(r.randint(-1000, 1000)) * size / 1000 for _ in range(5)]) for i in range(120)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = op06_topk.search(table, lambda v: v % 20 == 0, k=9).collect()
        assert Counter((x.query_id, x.rank, x.vec_id, x.score) for x in found) == brute_topk(rows, 9)
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="62 bits|64 bits"):
        op06_topk.search(huge, lambda v: v % 20 == 0).collect()


@pytest.mark.parametrize("share", [1.0, 0.1])
def test_topk_leaves_postings_untouched(share):
    r = np.random.default_rng(3)
    x = np.floor(64 * r.normal(0, 0.125, (20_000, 64))) * (r.random((20_000, 64)) < share)
    shard = op06_topk.Shard(x, np.arange(len(x)), np.arange(len(x)))
    for row in range(0, 400, 20):
        score, ids = shard.search(x[row], row, 20)
        full = (x @ x[row]).astype(np.int64)
        full[row] = -(2**62)
        top = np.lexsort((np.arange(len(x)), -full))[:20]
        assert (ids == top).all() and (score == full[top]).all()
    postings = sum(int((x[:, x[row] != 0] != 0).sum()) for row in range(0, 400, 20))
    assert shard.touched < 0.75 * postings and shard.touched + shard.probed < 0.95 * 20 * x.size


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1.0, abs(a)))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_url_filters", "op3_mixing", "op6_exact_topk", "op9_quality_rules"])
def test_queries_equal_sql(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, str(SF)).toArrow()
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.column_names)
    key = lambda row: [(v is not None, v if v is not None else 0) for v in row]
    got = sorted(([row[c] for c in sorted(names)] for row in found.to_pylist()), key=key)
    expected = sorted(([dict(zip(names, row))[c] for c in sorted(names)] for row in cursor.fetchall()), key=key)
    assert len(got) == len(expected) and all(close(a, b) for x, y in zip(got, expected) for a, b in zip(x, y))


@pytest.mark.skipif(not LABELLED.exists(), reason="no test tables")
def test_pipeline_stages_follow_from_one_another(spark, tmp_path):
    from terratess.llm import op05_packing, op07_secrets, op08_minhash

    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "deduplicated", "without_secrets", "mixed", "packed"]
    docs = spark.read.parquet(str(LABELLED / "documents.parquet"))
    schema, kept = docs.schema, [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, kept[-1], str(LABELLED)).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert kept[-1].columns == schema.names
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in kept]
    assert ids[0] > ids[1] >= ids[2] == ids[3] >= ids[4] == ids[5]
    assert ids[2] == {r.doc_id for r in op08_minhash.near_duplicates(kept[1]).where("kept").collect()}
    clean = {r.doc_id: r for r in kept[3].collect()}
    forest = op07_secrets.train(op07_secrets.example_findings(spark))
    for r in op07_secrets.scan(kept[2], forest).collect():
        assert clean[r.doc_id].text == r.clean_text and clean[r.doc_id].n_chars == (len(r.clean_text) if r.clean_text != r.text else r.n_chars)
    pieces = kept[5].groupBy("doc_id").agg(F.sum("length").alias("n"), (F.sum(F.when(F.col("start") == 0, F.col("doc_tokens")))).alias("all")).collect()
    assert all(r.n == r["all"] for r in pieces) and len(op05_packing.FIELDS) == 7
    assert corpus_pipeline.run(spark, str(LABELLED)).count() > 0


def test_one_row_of_each_id_stays(spark, tmp_path):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text), (3, "other words stand here in this row"), (None, text), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone_id", F.lit(7))
    left = corpus_pipeline.deduplicated(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "None"]


def test_other_texts_of_an_id_stay(spark):
    """A row goes for its own text only, not for that of a namesake."""
    texts = {c: " ".join(f"{c}{k}" for k in range(40)) for c in "abcde"}
    near = texts["d"].replace("d39", "other")
    rows = [(1, "a"), (5, "a"), (5, "b"), (5, "c"), (5, "c"), (6, "c"), (7, "d"), (8, "e")]
    docs = spark.createDataFrame([(i, texts[c]) for i, c in rows] + [(7, near), (8, near)], "doc_id long, text string")
    left = corpus_pipeline.deduplicated(spark, docs, "").collect()
    found = sorted((r.doc_id, "d" if r.text == near else r.text[0]) for r in left)
    assert found == [(1, "a"), (5, "b"), (5, "c"), (7, "d"), (8, "e")]
