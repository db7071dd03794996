"""Sharding and mixing against sequential versions."""

from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from messy import corpus, edge_cases, frame
from pyspark.sql import functions as F

import corpus_pipeline
from shoalspark.llm import mixing, sharding


def test_every_row_is_placed_and_counts_are_even(spark):
    rows = corpus() + edge_cases()
    got = sharding.assign_shards(frame(spark, rows), 8).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (1001, 1002)} == {(1, 0)}


def test_placement_is_the_sequential_ring(spark):
    rows = corpus(2, 300)
    docs = frame(spark, rows)
    points = sharding.ring_points(spark, 5, 8)
    keyed = sharding.keyed_rows(docs, "doc_id", "text", points, len(rows)).orderBy(*sharding.ORDER).collect()
    around, load, want = sharding.clockwise(points, 5), [0] * 5, {}
    for r in keyed:
        s = next(s for s in around[r.arc] if load[s] < 60)
        want[r.doc_id] = (s, load[s])
        load[s] += 1
    got = sharding.assign_shards(docs, 5, vnodes=8).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_arc_search(spark):
    points = sharding.ring_points(spark, 3, 7)
    values = [-(1 << 63), points[0][0], points[4][0], points[4][0] + 1, points[-1][0], points[-1][0] + 1, (1 << 63) - 1]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select(sharding.arc_of(F.col("v"), points).alias("a")).collect()
    want = [sum(p < v for p, _ in points) % len(points) for v in values]
    assert [r.a for r in got] == want


def test_one_more_shard_moves_few_rows_and_slack_moves_fewer(spark):
    docs = frame(spark, corpus(3, 900), clash=False)
    moved = {}
    for slack in (0.0, 0.25):
        a, b = ({r.doc_id: r.shard for r in sharding.assign_shards(docs, n, slack=slack).collect()} for n in (8, 9))
        moved[slack] = sum(a[k] != b[k] for k in a) / len(a)
        assert slack == 0 or max(Counter(a.values()).values()) <= 900 / 8 * 1.25 + 1
    assert moved[0.25] < moved[0.0] < 0.6  # dealing by modulo moves 8 of 9


def test_repeated_rows_and_null_ids_overflow(spark):
    got = sharding.assign_shards(frame(spark, [(7, "same", "en", "a", 4)] * 50 + [(None, f"t{i}", None, None, 1) for i in range(50)]), 4).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [25] * 4


def test_empty(spark):
    assert sharding.assign_shards(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0


def poured(sizes: dict, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def test_targets_and_taken(spark):
    rows = corpus(4, 200) + edge_cases()
    got = mixing.mix(frame(spark, rows), shard_rows=16).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 2 * r.size and r.size == next(len((x[1] or "").encode().split()) for x in rows if x[0] == r.doc_id and len((x[1] or "").encode().split()) == r.size)
    want, taken = poured(sizes), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=2)
    again = mixing.mix(frame(spark, rows[::-1]), shard_rows=16).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_apportionment_is_the_highest_quotients(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 23.0, "f": 1000.5}
    for seats in (0, 1, 7, 100, 1001):
        df = spark.createDataFrame([(k, w, seats, 10_000) for k, w in weights.items()], "k string, w double, seats bigint, cap bigint")
        got = {r.k: r.quota for r in mixing.apportion(df, [], "w", "seats", "cap", [F.col("k")]).collect()}
        quotients = sorted(((-Fraction(w) / (2 * i + 1), k, i) for k, w in weights.items() if w for i in range(seats)))[:seats]
        want = Counter(k for _, k, _ in quotients)
        assert got == {k: want[k] for k in weights}


def test_repeats_follow_the_mix(spark):
    docs = frame(spark, corpus(5, 90) + edge_cases())
    mixed = mixing.mix(docs)
    out = mixing.repeated(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixed.collect():
        if r.size:
            want[r.doc_id] += min(2, int(r.taken / r.size + 0.5))
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert all(got[k] >= n for k, n in want.items()) and set(got) == {k for k, n in want.items() if n}


def words_by_source(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += len((r.text or "").encode().split())
    return out


def plain_copies(taken):
    """Copies by (id, source, h) from the rows of ``taken_words`` one after another."""
    out, owed = Counter(), defaultdict(float)
    order = sorted((r for r in taken if r.size), key=lambda r: (-(r.size.bit_length()), r.h, r.doc_id is not None, r.doc_id or 0, r.size, r.taken))
    for r in order:
        n, rest = divmod(r.taken, r.size)
        if rest:
            at = (r.source, r.shard)
            owed[at] += rest
            if owed[at] >= r.u * r.size:
                n, owed[at] = n + 1, owed[at] - r.size
        out[r.doc_id, r.source, r.h, r.size] += n
    return +out


def with_u(taken, seed=17):
    u = (F.pmod(F.xxhash64(F.lit(seed + 3), "h"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    return taken.withColumn("u", u).collect()


def test_pipeline_mixing_keeps_the_words_of_every_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    got = words_by_source(corpus_pipeline.mix(spark, docs, "/root/testdata/sf0.01").collect())
    for source, words in target.items():
        assert got[source] == pytest.approx(words, rel=0.05), source


def test_pipeline_mixing_is_the_plain_version(spark):
    rows = corpus(6, 300) + edge_cases() + [(7, "same words here", "en", "a", 3)] * 5 + [(None, f"null {i} " * (i + 1), "en", None, 9) for i in range(20)]
    docs = frame(spark, rows)
    out = corpus_pipeline.mix(spark, docs, "")
    assert out.columns == docs.columns
    want = plain_copies(with_u(mixing.taken_words(docs)))
    keys = mixing.row_key(17, "doc_id", "text", "source")
    got = Counter((r.doc_id, r.source, r.h, r.size) for r in out.select(*keys).collect())
    assert got == want
    most = Counter((r.doc_id, r.source, r.h, r.size) for r in docs.select(*keys).collect())
    assert all(n <= 2 * most[k] for k, n in got.items())
    again = Counter((r.doc_id, r.source, r.h, r.size) for r in corpus_pipeline.mix(spark, frame(spark, rows[::-1]), "").select(*keys).collect())
    assert again == got
