"""Text operators against plain Python versions."""

from __future__ import annotations

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from messy import corpus, edge_cases, frame, words
from pyspark.sql import functions as F

from shoalspark.llm import jaccard_join, language, line_dedup, phrases, quality, templates
from shoalspark.shipping import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


LAST = (1 << 63) - 1


def ident(d):
    return LAST if d is None else d


def plain_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    where = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                where[key(line)].add(ident(d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(where[key(x)]) < 2 or min(where[key(x)]) == ident(d)]
        out.append((d, len(lines), len(lines) - len(keep), digest("\n".join(keep))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits, mb", [(8, 128), (1, 0.0001)])
def test_line_dedup(spark, bits, mb):
    rows = corpus(6) + edge_cases() + [(2000, "Éa line that repeats\nA LINE THAT REPEATS\n\n", None, None, 1), (2001, "ninechars\nninechars", None, None, 1), (2002, "ninechars\nÄÄÄÄÄÄÄÄÄÄ", None, None, 1), (2003, "ÄÄÄÄÄÄÄÄÄÄ", None, None, 1)]
    out = line_dedup.dedup_lines(frame(spark, rows), bits_per_line=bits, filter_mb=mb)
    got = [(r.doc_id, r.n_lines, r.n_dropped, digest(r.text)) for r in out.collect()]
    assert sorted(got, key=repr) == plain_lines(rows)


def plain_repeats(rows, width):
    first, split = {}, []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        split.append((ident(d), d, w))
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            first[k] = min(first.get(k, LAST + 1), ident(d))
    out = []
    for i, d, w in split:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s:s + width])] < i:
                gone.update(range(s, s + width))
        out.append((d, len(w), len(gone), digest(b" ".join(x for k, x in enumerate(w) if k not in gone).decode())))
    return sorted(out, key=repr)


def test_passages_of_repetitive_texts():
    """Against all windows listed, over texts of few words; one word repeated takes time linear in its number."""
    rng = random.Random(3)
    for _ in range(600):
        width, words = rng.choice([5, 6, 9, 10]), [b"a", b"b", b"c", b"dd"][:rng.choice([1, 2, 3, 4])]
        holder = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            holder = (holder[:7] or [b"a"]) * rng.randint(1, 8)
        at = rng.randint(0, len(holder))
        doc = [rng.choice([*words, b"z"]) for _ in range(rng.randint(0, 20))] + holder[at:at + rng.randint(0, 30)]
        windows = {tuple(holder[i:i + width]) for i in range(len(holder) - width + 1)}
        want = [False] * len(doc)
        for i in range(len(doc) - width + 1):
            if tuple(doc[i:i + width]) in windows:
                want[i:i + width] = [True] * width
        passages = phrases.Passages(width)
        passages.add(holder)
        assert passages.covered(doc).tolist() == want
    start, passages = time.perf_counter(), phrases.Passages(50)
    passages.add([b"w"] * 64_000)
    assert passages.covered([b"w"] * 64_000).all() and time.perf_counter() - start < 2


@pytest.mark.parametrize("seed, limit", [(7, 200_000), (8, 3)])
def test_repeated_phrases(spark, seed, limit):
    rng = random.Random(seed)
    passage, period = words(rng, 90), words(rng, 7) * 30
    rows = corpus(seed, 90) + edge_cases()
    for i in range(40):
        a, b = rng.randrange(0, 20), rng.randrange(60, 90)
        w = words(rng, rng.randrange(0, 60)) + passage[a:b] + words(rng, rng.randrange(0, 60)) + (period[rng.randrange(7):] if i % 8 == 0 else [])
        rows.append((3000 + i, " ".join(w), None, None, 0))
    rows += [(3100, " ".join(passage[:50]), None, None, 0), (3101, " ".join(passage[:49]), None, None, 0), (3102, " ".join(passage[:50]) + " " + " ".join(passage[:50]), None, None, 0)]
    out = phrases.remove_repeats(frame(spark, rows), part_docs=8, broadcast_rows=limit)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, digest(r.text)) for r in out.collect()], key=repr)
    assert got == plain_repeats(rows, 50)


def plain_groups(rows, t=0.8):
    sets = [jaccard_join.shingles((x[1] or "").encode().split()) for x in rows]
    key = [" ".join((x[1] or "").encode().split().__repr__()) for x in rows]
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    group, cls = defaultdict(lambda: LAST), defaultdict(lambda: LAST)
    for i in range(n):
        group[find(i)] = min(group[find(i)], ident(rows[i][0]))
        cls[key[i]] = min(cls[key[i]], ident(rows[i][0]))
    out = [(rows[i][0], cls[key[i]] if sets[i] else ident(rows[i][0]), links[i], group[find(i)]) for i in range(n)]
    return sorted([tuple(None if x == LAST else x for x in r) for r in out], key=repr)


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = words(rng, 150)
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        out.append((5000 + i, " ".join(w), None, None, 0))
    return out


def test_jaccard_groups(spark):
    rows = corpus(9, 120) + edge_cases() + near_copies(10, 60, 6)
    out = jaccard_join.jaccard_groups(frame(spark, rows))
    got = sorted([(r.doc_id, r.class_id, r.n_links, r.group_id) for r in out.collect()], key=repr)
    assert got == plain_groups(rows)
    one = jaccard_join.one_of_each(frame(spark, rows), out)
    assert one.columns == frame(spark, rows).columns
    kept = [r.doc_id for r in one.collect()]
    assert sorted(x for x in kept if x is not None) == sorted({g if g is not None else -1 for *_, g in got} - {-1})


def test_jaccard_group_larger_than_a_chunk(spark):
    rows = near_copies(11, 700, 4)
    out = jaccard_join.jaccard_groups(frame(spark, rows))
    assert sorted([(r.doc_id, r.class_id, r.n_links, r.group_id) for r in out.collect()], key=repr) == plain_groups(rows)


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_matches(0.8, 1e-5)
    rng = np.random.default_rng(0)
    r = 0.8 + 0.2 / 256
    lost = 0
    for _ in range(4000):
        same = np.cumsum(rng.random(jaccard_join.HASHES) < r)
        lost += any(same[n - 1] < least[n] for n in range(20, 121, 20))
    assert lost <= 4 and least[120] > 60


def test_language_on_held_out_rows_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and np.mean([r.lang_pred == r.lang for r in out]) > 0.98
    by = {r.lang: r.text for r in docs.orderBy("n_chars").where("n_chars > 1500").collect()}
    mixed = [(1, by["en"][:1500] + "\n" + by["fr"][:1400], None, None, 0), (2, by["de"], None, None, 0)] + edge_cases()
    got = {r.doc_id: r for r in language.identify(frame(spark, mixed), train=docs).where("doc_id is not null").collect()}
    assert set(got[1].shares) == {"en", "fr"} and 0.3 < got[1].shares["fr"] < 0.7 and set(got[2].shares) == {"de"}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1001, 1002, 1003, 1004))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1005].lang_pred != "und"
    assert language.identify(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in language.identify(frame(spark, mixed).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    whole = language.in_a_language(frame(spark, mixed))
    assert whole.columns == frame(spark, mixed).columns and 2 in {r.doc_id for r in whole.collect()}


def test_quality_on_held_out_rows_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge_quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").toPandas()
    rank = out["score"].rank()
    good = out["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and out["score"].between(0, 1).all()
    rows = frame(spark, edge_cases() + corpus(12, 30))
    none = spark.createDataFrame([(1001, None, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.judge_quality(rows, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    assert all(r.score > 0.9 for r in quality.judge_quality(rows, ones).collect())
    assert quality.judge_quality(frame(spark, []), labels).count() == 0


ITEM = ("A train leaves the old station with Anna on board at 10:30 and travels 45 km in 3 hours before it meets Anna again; "
        "how fast does it travel on average during the whole trip?")


def test_templates(spark):
    rng = random.Random(13)
    pad = " ".join(words(rng, 40))
    other = ITEM.replace("Anna", "Boris").replace("45 km", "61 miles").replace("10:30", "7:15").replace(" 3 ", " 8 ")
    rows = [(1, f"{pad}\n{ITEM}\n{pad}", None, None, 0), (2, f"{pad}. {other} {pad}", None, None, 0),
            (3, f"{pad}. {ITEM.replace('Anna', 'Boris', 1)} {pad}", None, None, 0), (4, pad, None, None, 0),
            (5, f"{pad}\n{' '.join(ITEM.split()[:12])}\n{pad}", None, None, 0), (1, "another text of the same id", None, None, 0)]
    bench = spark.createDataFrame([(70, ITEM), (71, None), (72, "Too short."), (73, ""), (None, " ".join(words(rng, 20)))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in templates.leaks(frame(spark, rows + edge_cases()), bench.withColumn("size", F.lit(1))).collect()}
    assert got == {(1, 70): "verbatim", (2, 70): "reparameterised"}
    clean = templates.without_leaks(frame(spark, rows), templates.leaks(frame(spark, rows), bench))
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    assert templates.leaks(frame(spark, []), bench).count() == 0 == templates.leaks(frame(spark, rows), bench.limit(0)).count()


def test_templates_find_planted_items(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: " ".join(r.text.split()) for r in bench.collect()}
    whole = {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if t in " ".join(d.text.split())}
    got = {(r.doc_id, r.item_id) for r in templates.leaks(docs, bench).collect()}
    assert whole and whole <= got and len(got) <= len(whole) + 5


def test_templates_judge_texts_without_an_id_one_by_one(spark):
    rng = random.Random(14)
    pad = " ".join(words(rng, 6))
    numbered = [" ".join(f"word {rng.randrange(1000)} then Name{rng.randrange(50)}" for _ in range(30)) for _ in range(20)]
    half = len(ITEM.split()) // 2
    first, second = " ".join(ITEM.split()[:half + 2]), " ".join(ITEM.split()[half - 2:])
    other = ITEM.replace("Anna", "Boris").replace("45 km", "61 miles").replace("10:30", "7:15").replace(" 3 ", " 8 ")
    bench = spark.createDataFrame([(70, ITEM)], "item_id bigint, text string")
    for key in (None, 9):
        texts = [f"{pad} {ITEM}", f"{pad} {other}", *numbered]
        rows = [(key, t, None, None, 0) for t in texts] + [(3, pad, None, None, 0)]
        found = templates.leaks(frame(spark, rows), bench)
        assert sorted((r.doc_id, r.item_id, r.kind) for r in found.collect()) == [(key, 70, "reparameterised"), (key, 70, "verbatim")]
        assert [(r.doc_id, r.item_id, r.kind) for r in templates.by_document(found).collect()] == [(key, 70, "verbatim")]
        left = sorted(r.text for r in templates.without_leaks(frame(spark, rows), found).collect())
        assert left == sorted([pad, *numbered] if key is None else [pad])
        # no text holds the item by itself
        assert templates.leaks(frame(spark, [(key, first, None, None, 0), (key, second, None, None, 0)]), bench).count() == 0
