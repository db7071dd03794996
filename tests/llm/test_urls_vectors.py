"""URL cascade and near vectors against plain versions; SQL twins and the pipeline."""

from __future__ import annotations

import math
import random

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
import pytest
from check import compare, oracle
from messy import corpus, edge_cases, frame
from pyspark.sql import functions as F

from shoalspark.llm import near_vectors, url_cascade
from shoalspark.llm.queries import QUERIES, URL_RULES
from shoalspark.llm.oracle import ORACLE
from shoalspark.shipping import ship_package

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain_verdict(url):
    head, sep, tail = (url or "").partition("://")
    if not sep:
        return "", "", None, "allow"
    end = min([tail.find(c) for c in "/?#" if c in tail] or [len(tail)])
    host = "".join(c.lower() if c.isascii() else c for c in tail[:end])
    path = tail[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_verdicts(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme/net/", "http://", "http://net", "http://net/", "http://NET/x", "x://a.b.example.NET/en/q?z", "http://example.net/en", "ftp://example.com/de/?q",
            "http://notexample.com/de/", "http://sub.example.com/de/#f", "http://ÄX.org/fr/", "http://org?/fr/", "a://b://net/", "http://.net/", "http://net./", "http://x.net:80/", "http://a.org/fr/\n/x"]
    for _ in range(400):
        host = ".".join(rng.choice(["a", "example", "net", "com", "org", "WWW"]) for _ in range(rng.randrange(1, 4)))
        urls.append(f"http://{host}{rng.choice(['', '/', '/en/', '/de/', '/fr/', '/en', '/fr/x?y', '#z'])}")
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge_urls(pages, spark.sql(f"SELECT * FROM {URL_RULES}")).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls)}
    rules = spark.sql(f"SELECT * FROM {URL_RULES}")
    assert url_cascade.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_cascade.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe_and_has_levels(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(key) % 10 = 0").unionByName(spark.sql("SELECT 'absent' AS key"))
    c = url_cascade.Cascade(listed, universe, bits=3, hashes=2)
    wrong = universe.withColumn("said", c.contains(F.col("key"))).where("said <> (crc32(key) % 10 = 0)")
    assert wrong.count() == 0 and len(c.levels) > 3
    with pytest.raises(ValueError):
        url_cascade.Cascade(listed, universe, max_keys=10)


def plain_links(rows, cosine):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            ok[i] = a / np.linalg.norm(a)
    ids = [i for i, _ in rows]
    links = {i: {j for j in ok if j != i and i in ok and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine} for i in ids}
    low = {i: i for i in ids}
    for _ in ids:
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in ids}
        if new == low:
            break
        low = new
    return {i: (len(links[i]), low[i], low[i] == i) for i in ids}


def test_near_vectors(spark):
    ship_package(spark)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 8))):
            rows.append(centre + rng.standard_normal(32) * rng.choice([0.1, 0.16, 0.2, 0.25]))
    rows += [rows[0], rows[0] * 3.0, -rows[1]]
    group = rng.standard_normal(32)
    rows += [group + rng.standard_normal(32) * 0.12 for _ in range(640)]
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    table += [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [1.0, None]), (9004, [float("nan")] * 32), (9005, [float("inf"), 1.0]), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [1e-200, 2e-200])]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in table], "vec_id bigint, embedding array<double>, label int, node string, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    want = plain_links(table, 0.95)
    assert set(got) == set(want)
    links = sum(n for n, _, _ in want.values())
    assert sum(n for n, _, _ in got.values()) >= 0.999 * links and all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.99 and got[9007][:2] == (2, 9006)
    twice = near_vectors.near_vectors(df.unionByName(df).withColumn("vec_id", F.when(F.col("vec_id") != 3, F.col("vec_id"))))
    assert twice.count() == 2 * len(table) and near_vectors.near_vectors(df.limit(0)).count() == 0


def test_recall_parameters():
    t, tables, width = near_vectors.layout(1_000_000, 0.95, 1e-4)
    near = near_vectors.same_cell(4.0)
    assert (1 - near ** t) ** tables <= 1e-4 and t > near_vectors.layout(10_000, 0.95, 1e-4)[0]
    p = math.erf(2 / math.sqrt(2))
    need = near_vectors.least_collisions(1e-6)[-1]
    assert sum(math.comb(64, k) * p ** k * (1 - p) ** (64 - k) for k in range(need)) <= 1e-6


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twins(spark, name):
    rows, verdict = compare(spark, oracle("/root/testdata/sf0.001"), name, "/root/testdata/sf0.001")
    assert verdict == "ok" and rows > 0


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(frame(spark, corpus(20, 40) + edge_cases(), clash=False))
    docs = docs.withColumn("node", F.lit("x"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(step(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "node"]
        assert 0 < docs.count() <= before * (2 if name == "mixing" else 1)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 100
