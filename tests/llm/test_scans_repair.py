"""Licence scans, collocations and conversation repair against plain Python versions."""

from __future__ import annotations

import functools
import hashlib
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from messy import CLASH, corpus, edge_cases, frame, words
from pyspark.sql import functions as F

from shoalspark import staging
from shoalspark.llm import collocations, conversations, language, licences
from shoalspark.llm.scan import slices
from shoalspark.shipping import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def lower(text):
    return (text or "").encode().lower().decode()


# --- licence scans

NOTICES = ["All rights reserved.", "licensed under CC BY-NC 4.0", "ALL RIGHTS reserved all rights reserved", "GNU General Public License, version 3",
           "Released, under the MIT license", "license mit the under released", "Licensed below the Apache License, Version 2.0",
           "Permission is hereby granted, free of charge, to any person obtaining a copy of that software and all documentation files",
           "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files",
           "Redistribution and use in source and binary forms", "under the General Public", "Éall rights reserved", "cc by"]


def plain_licences(rows, share):
    out = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        base, labels, best = [], set(), 0.0
        for m in licences.templates():
            v = [x.decode() for x in m.words]
            for s in range(-len(v), len(w)):
                held = {q for q, x in enumerate(v) if 0 <= s + q < len(w) and w[s + q] == x}
                if held >= set(m.must) and len(held) >= (1 if m.base else share) * len(v) - 1e-9:
                    labels.add((m.label, m.base))
                    best = max(best, len(held) / len(v))
                    base += [s] * m.base
        out.append((d, len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({x for x, b in labels if b})),
                    ",".join(sorted({x for x, _ in labels})), best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.8, 0.5])
def test_licences(spark, share):
    rng = random.Random(4)
    rows = corpus(4, 20) + edge_cases() + [(3000 + i, " ".join(words(rng, i % 3)) + " " + n + ("!" if i % 2 else ""), None, None, 1) for i, n in enumerate(NOTICES * 2)]
    rows += [(4000 + i, NOTICES[0], "en", "hot", 1) for i in range(40)] + [(5000, "cut off: copyright", None, None, 1), (5001, "under the apache license version 2 0", None, None, 1)]
    out = licences.scan_licences(frame(spark, rows), share=share)
    got = sorted([tuple(r)[:8] for r in out.collect()], key=repr)
    assert got == plain_licences(rows, share)
    spans = out.where("doc_id = 5001").first().spans
    assert [(s.label, s.start, s.n_held) for s in spans] == [("apache-2.0", -1, 7)]
    assert licences.scan_licences(frame(spark, [])).count() == 0


def test_long_texts_are_read_in_parts():
    text = b" ".join(b"all rights reserved %d" % i for i in range(300))
    parts = list(slices(text, 50))
    assert b"".join(parts) == text and max(map(len, parts)) < 70 and not any(p[-1:] != b" " and p[:0] for p in parts)
    assert b"".join(slices(b"x" * 500, 50)) == b"x" * 500
    n, at, codes = licences.licence_words(b"reserved " * (1 << 18), licences.vocabulary(licences.templates()))
    assert n == len(at) == 1 << 18 and len(set(codes)) == 1


def test_unknown_phrase_is_an_error():
    with pytest.raises(ValueError):
        licences.template("x", "some words", ["other"])


# --- collocations


def plain_collocations(rows, longest, least, top, share):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[s:s + k]) for s in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def prose(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["Of", "the", "in", "a b", "naïve", "x", "new", "york", "city", "<b>", "1"]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n", "\t", " "]) for _ in range(rng.randrange(0, 60))]
        rows.append((i, " ".join(w) + " new york city" * rng.randrange(3), rng.choice(["en", "de", None, "zz"]) if i % 3 else "en", "s", 1))
    return rows


@pytest.mark.parametrize("longest, least, top, shard", [(3, 10, 2000, 2_000_000), (4, 3, 50, 400)])
def test_collocations(spark, longest, least, top, shard):
    rows = prose(longest + top) + edge_cases() + [(9000, "x x x x x x x x x x x x x", "one", "s", 1)]
    out = collocations.mine(frame(spark, rows), longest=longest, least=least, top=top, shard=shard)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_collocations(rows, longest, least, top, 50)


def test_collocations_of_nothing(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, edge_cases()[:4])).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 3 * 10**15
    score = spark.sql(f"SELECT (cast(1000000 as decimal(38,0)) * cast({a}L as decimal(38,0)) * cast({a - 1}L as decimal(38,0))) div "
                      f"(cast({a}L as decimal(38,0)) * cast({a + 7}L as decimal(38,0))) AS s").first().s
    assert score == 1000000 * a * (a - 1) // (a * (a + 7))


@pytest.mark.parametrize("seed", range(6))
def test_trie_holds_its_paths_only(seed):
    rng = np.random.default_rng(seed)
    symbols = 40
    paths = np.unique(rng.integers(1, symbols + 1, (1 + 300 * seed, 3)) ** (1 + seed % 2) % symbols + 1, axis=0)
    trie = collocations.Trie(paths, symbols + 1)
    every = np.stack(np.meshgrid(*[np.arange(1, symbols + 2)] * 3, indexing="ij"), -1).reshape(-1, 3)
    state = np.zeros(len(every), np.int64)
    for k in range(3):
        state = trie.step(state, every[:, k])
    held = every[state >= 0]
    assert (held == paths).all() and (trie.phrase[state[state >= 0]] == np.arange(len(paths))).all()


@pytest.mark.parametrize("same", [False, True])
def test_words_are_found_whatever_their_hashes(monkeypatch, same):
    rng = random.Random(31)
    every = sorted({bytes(rng.choices(b"abcxyz\xc3\xa9", k=rng.randrange(1, 9))) for _ in range(3000)} | {b"q" * 70000})
    if same:
        monkeypatch.setattr(collocations, "hashes", lambda words, made=collocations.hashes: made(words) % np.uint64(7))
    held = collocations.Vocabulary(pa.array(every[::2], pa.binary()))
    asked = [b"", *rng.sample(every, 400), b"", every[-1]]
    got = held.find(pa.array([b"left out", *asked], pa.binary()).slice(1))
    kept = held.words.to_pylist()
    assert [kept[i] if i >= 0 else None for i in got] == [w if w in set(every[::2]) else None for w in asked]
    none = collocations.Vocabulary(pa.array([], pa.binary()))
    assert len(none) == 0 and none.find(pa.array([b"a", b""], pa.binary())).tolist() == [-1, -1]


def test_memory_of_a_pass_over_many_candidates():
    n, vocabulary = 200_000, 20_000
    pairs = np.unique(np.random.default_rng(32).integers(0, vocabulary, (n, 2)), axis=0)
    n = len(pairs)
    phrases = [f"w{a} w{b}".encode() for a, b in pairs]
    part = pa.table({"number": np.arange(n) * 3, "lang": ["en"] * n, "phrase": pa.array(phrases, pa.binary())})

    def texts(of):
        return collocations.encoded([pa.RecordBatch.from_pydict({"lang": ["en"], "text": pa.array([b". ".join(of)])})])

    tracemalloc.start()
    try:
        held = collocations.Candidates(part.to_batches(10_000), 2)
        assert tracemalloc.get_traced_memory()[1] < 160 * n
        shared = SimpleNamespace(value=held)
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        few = [b for b in collocations.passed(shared, True, False, True, 10)(texts(phrases[:1000]))]
        assert tracemalloc.get_traced_memory()[1] - before < 20 * n
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in few) == 1000
    counts, most = Counter(), 0
    for batch in collocations.passed(shared, True, True, True, 10)(texts(phrases + phrases[::5])):
        most = max(most, batch.num_rows)
        counts.update(dict(zip(batch.column("number").to_pylist(), batch.column("n").to_pylist())))
    del counts[None]  # surveyed phrases
    assert counts == {3 * i: 1 + (i % 5 == 0) for i in range(n)} and most <= 1 << 16


def test_staged_texts_lie_in_small_blocks(spark):
    rng = random.Random(33)
    docs = spark.createDataFrame([(rng.randbytes(1 << 20).hex(), "en") for _ in range(12)], "text string, lang string").coalesce(1)
    made = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "stage", lambda df, made=made, **options: made.append(staging.stage(df, **options)) or made[-1])
        assert collocations.phrase_counts(docs, longest=1)[0].collect()[0].n == 12
    blocks = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in made[0].inputFiles()]
    assert sum(b.num_rows for b in blocks) == 12 == made[0].count()
    assert max(b.row_group(i).total_byte_size for b in blocks for i in range(b.num_row_groups)) < 16 << 20
    with collocations.few_rows(spark):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1"


# --- conversations


def plain_audit(symbols):
    """Cheapest edits, least by ASCII, of (must go, initial, truncated) rows by trying all."""
    after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    @functools.cache
    def best(i, state, added):
        found = [(0, "")] if i == len(symbols) and state in (0, 3) else []
        if i < len(symbols):
            gone, initial, extra = symbols[i]
            tries = [(4, "D", state)]
            if not gone:
                tries += [(extra, "K", after[initial][state])] if state in after.get(initial, ()) else []
                tries += [(3 + extra, "R", after[r][state]) for r in "ua" if state in after[r]]
            found += [(c + best(i + 1, to, 0)[0], e + best(i + 1, to, 0)[1]) for c, e, to in tries]
        if added < 3:
            found += [(3 + best(i, after[r][state], added + 1)[0], "I" + best(i, after[r][state], added + 1)[1]) for r in "ua" if state in after[r]]
        return min(found, default=(10**9, ""))
    return best(0, 0, 0)


def plain_repair(rows, damage=True):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        groups[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, g in groups.items():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in g:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain_audit(tuple((f in ("blank", "duplicate"), r[:1], 3 * (f == "truncated")) for (_, r, _), f in zip(g, faults)))
        lines, i = [], 0
        for e in audit:
            following = "assistant" if lines and lines[-1][0] == "u" else "user"
            if e == "I":
                lines.append(following + ":")
                continue
            if e != "D":
                lines.append((g[i][1] if e == "K" else following) + ":" + g[i][2])
            i += 1
        turns = [t for t, *_ in g if t is not None]
        roles = [r[:1] for _, r, _ in g]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


KIND = "conv_id bigint, turn bigint, role string, text string"


def talks(seed, n=40, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            text = rng.choice(["", " \t", None, "Yes.", "No", "Why?", f"Text {rng.randrange(30)}!", "Ünïcödé。 ", "ends here. \n", "x "])
            rows.append((c + (1 << 60) if c % 17 else None, None if rng.random() < 0.1 else t // (1 + c % 2), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    return rows


@pytest.mark.parametrize("seed, most_rows, most_bytes", [(3, 3, 1 << 23), (4, 4096, 12)])
def test_conversation_repair(spark, seed, most_rows, most_bytes):
    rows = talks(seed) + [(500, 3, "user", "Again.")] * 25 + [(501, t, "user", "Hot.") for t in range(40)] + [(502, t, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(203)]
    rows += [(503, 1, "system", "Alone."), (504, 1, "user", "y. " * 50_000)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", *[f"'x' AS `{c}`" for c in [*CLASH, "conv", "piece", "place", "edits"]])
    fixed = conversations.repair(df, damage=True, most_rows=most_rows, most_bytes=most_bytes)
    got = {r.conv_id: tuple(r) for r in conversations.summary(fixed).collect()}
    want = {r[0]: r for r in plain_repair(rows)}
    assert set(want) <= set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        assert row == want.get(conv, (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))
    # the rows themselves give the digests
    lines = defaultdict(list)
    for r in conversations.repaired_rows(fixed).orderBy("conv", "piece", "place", "nth").collect():
        lines[r.conv].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == row[-1] for c, row in got.items())
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines[c])) for c in got)


def test_undamaged_and_empty(spark):
    rows = talks(9, 20)
    got = sorted(map(tuple, conversations.summary(conversations.repair(spark.createDataFrame(rows, KIND))).collect()), key=repr)
    assert got == plain_repair(rows, damage=False)
    assert conversations.summary(conversations.repair(spark.createDataFrame([], KIND), damage=True)).count() == 0


def test_blocks_equal_single_steps():
    rng = random.Random(3)
    t = conversations.tables()
    for n in range(60):
        s = np.array([rng.randrange(9) for _ in range(n % 11)], np.int64)
        vector, total = 0, 0
        for x in s[::-1]:
            total, vector = total + t.one_cost[vector, x], t.one[vector, x]
        at, cost = conversations.boundaries(s, 0)
        before, totals, states = conversations.piece_map(s)
        assert (at[0], cost) == (vector, total) == (before[0], totals[0])
        for v in range(len(t.vectors)):
            assert [conversations.trace(s, v, k)[1] for k in range(4)] == states[4 * v:4 * v + 4]


def test_a_text_in_five_of_seven_languages():
    """No number of languages is cut off before the penalised choice."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(400, 0.05), 7).T + 1e-6
    p /= p.sum(axis=0)
    n = np.round(20_000 * p[:, [0, 1, 3, 4, 6]].mean(axis=1)).astype(np.float32)
    seen = np.flatnonzero(n)
    top, share = language.mixture(p[seen].astype(np.float32), n[seen], np.array([0]), rounds=6)
    assert sorted(top[0][share[0] > 0]) == [0, 1, 3, 4, 6] and np.allclose(share[0][share[0] > 0], 0.2, atol=0.02)
