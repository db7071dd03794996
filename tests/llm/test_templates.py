"""Template decontamination against a plain version that compares every document with every item."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
import regex
from messy import edge_cases, frame

from shoalspark.llm import templates
from shoalspark.shipping import ship_package

TOKEN = regex.compile(r"(?<![.!?:;\s])[ \t]+(?P<name>\p{Lu}[\p{L}\p{M}'-]*)|(?P<num>\p{Nd}+(?:[.,:/]\p{Nd}+)*)|(?P<word>[\p{L}\p{M}]+)|(?P<sign>%|°C|°F|€|\$|£)")
UNITS = {u.lower() for u in templates.UNITS}


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def plain_tokens(text):
    """(template word, value) pairs, units told from words by what stands before them."""
    out, at, number_end = [], 0, -1
    while m := TOKEN.search(text, at):
        gap, at = text[number_end:m.start()] if number_end >= 0 else None, m.end()
        if m["num"]:
            out.append(("<num>", m["num"]))
            number_end = m.end()
            continue
        lead = m[0][:len(m[0]) - len(m[0].lstrip(" \t"))]
        body = m[0].lstrip(" \t")
        near = gap is not None and gap + lead in ("", " ")
        whole = body.lower() in UNITS and not (at < len(text) and regex.match(r"[\p{L}\p{M}]", text[at])) and not regex.search(r"['-]", body)
        if near and (m["sign"] or gap + lead == "" or whole):
            out.append(("<unit>", "th" if gap + lead == "" and body.lower() in ("st", "nd", "rd", "th") else body.lower()))
            if gap + lead == "" and not m["sign"]:
                out[-2] = ("<num>", out[-2][1] + out[-1][1])
        elif m["name"]:
            out.append(("<name>", body.lower()))
        elif m["word"]:
            out.append((body.lower(), body.lower()))
        number_end = -1
    return out


def plain_leaks(rows, items, width=5, share=0.8, literal=2):
    found = set()
    for item, text in items:
        q = plain_tokens(text or "")
        own = [i for i in range(len(q) - width + 1) if sum(not w.startswith("<") for w, _ in q[i:i + width]) >= literal]
        for doc, body in rows:
            d = plain_tokens(body or "")
            if not own:
                k = min(width, len(q))
                hits = {i for i in range(len(q) - k + 1) for j in range(len(d) - k + 1) if q[i:i + k] == d[j:j + k]}
                if k >= 2 and hits and len(hits) >= share * (len(q) - k + 1):
                    found.add((doc, item, "verbatim"))
                continue
            runs = defaultdict(set)
            for i in own:
                for j in range(len(d) - width + 1):
                    if all(a[0] == b[0] for a, b in zip(q[i:i + width], d[j:j + width])):
                        runs[j - i].add(i)
            good, other = set(), False
            for shift, ats in runs.items():
                image, differs = defaultdict(set), False
                for p in range(min(ats), max(ats) + width):
                    if q[p][0].startswith("<") and 0 <= p + shift < len(d) and d[p + shift][0] == q[p][0]:
                        image[q[p]].add(d[p + shift][1])
                        differs |= q[p] != d[p + shift]
                if all(len(v) == 1 for v in image.values()):
                    good |= ats
                    other |= differs
            if good and len(good) >= share * len(own):
                found.add((doc, item, "reparameterised" if other else "verbatim"))
    return found


CASES = [("Take the 2nd of 2 boxes that holds 3 pens and count them all.", "Take the 4th of 7 boxes that holds 9 pens and count them all.", "reparameterised"),
         ("the boat leaves at 4pm with 4 men and 7 dogs aboard", "the boat leaves at 5pm with 6 men and 8 dogs aboard", "reparameterised"),
         ("the boat leaves at 3pm with 4 men and 7 dogs aboard", "the boat leaves at 5pm with 6 men and 8 dogs aboard", "reparameterised"),
         ("how fast does Anna run 5 km in the 1990s", "how fast does Bob-Lee run 12 miles in the 2010s", "reparameterised"),
         ("name the four seasons", "Please name the four seasons now", "verbatim"), ("12 13 14 15 16 17", "so 12 13 14 15 16 17 it is", "verbatim"),
         ("12 13 14 15 16 17", "so 12 13 14 15 16 18 19 it is 12", None), ("yes", "yes yes", None), ("what is 3D printing good for", "what is 3D printing good for?", "verbatim"),
         ("name the four seasons", "name the five seasons", None), ("add 3 kg of salt to 3 l of water", "add 5 g of salt to 6 l of water", None),
         ("add 3 kg of salt to 3 l of water", "add 5 g of salt to 5 ml of water", "reparameterised")]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_plain_version_says_what_it_should(case):
    item, text, kind = CASES[case]
    got = {k for _, _, k in plain_leaks([(1, text)], [(1, item)])}
    assert got == ({kind} if kind else set())


def test_against_plain_version(spark):
    rng = random.Random(12)
    slots = [lambda: str(rng.randrange(2, 40)), lambda: f"{rng.randrange(2, 30)}{rng.choice(['st', 'th', 'pm', 'D', 's'])}", lambda: f"{rng.randrange(9)} {rng.choice(['km', 'kg', 'Miles', '%'])}",
             lambda: rng.choice(["Anna", "Bob", "Zoë", "O'Neil"]), lambda: f"{rng.randrange(9)}.{rng.randrange(9)}"]
    own = [f"{a}{b}" for a in ("pa", "ro", "ti", "lu") for b in ("ne", "sk", "mo")]

    def sentence(shape):
        return " ".join(slots[x]() if isinstance(x, int) else x for x in shape)
    shapes = [[rng.choice([rng.randrange(5), *rng.sample(own, 3)]) for _ in range(rng.randrange(1, 16))] for _ in range(25)]
    items = [(i, sentence(s)) for i, s in enumerate(shapes)] + [(100 + i, c[0]) for i, c in enumerate(CASES)] + [(200, None), (201, "")]
    rows = [(i, f"{' '.join(rng.sample(own, 3))}. {sentence(s) if i % 2 else items[i][1]} {' '.join(rng.sample(own, 2))}") for i, s in enumerate(shapes)]
    rows += [(100 + i, c[1]) for i, c in enumerate(CASES)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = templates.leaks(frame(spark, [(d, t, "en", "s", 1) for d, t in rows]), bench)
    got = {(r.doc_id, r.item_id, r.kind) for r in templates.by_document(found).collect()}
    assert got == plain_leaks(rows, items) and {k for *_, k in got} == {"verbatim", "reparameterised"}
    assert {r.item_id for r in templates.unmatchable(bench).collect()} == {i for i, t in items if len(plain_tokens(t or "")) < 2}
    assert templates.leaks(frame(spark, edge_cases()), bench).count() == 0


def test_long_texts(spark):
    text = "pens 3 " * 60_000 + "which of the 4 boxes holds 3 pens today " + "Bob " * 60_000
    bench = spark.createDataFrame([(1, "which of the 7 boxes holds 5 pens today")], "item_id bigint, text string")
    assert [(r.doc_id, r.kind) for r in templates.leaks(frame(spark, [(5, text, None, None, 1)]), bench).collect()] == [(5, "reparameterised")]


def test_slots_make_rows_of_placeholders_only(spark):
    text = "On the 4th Anna ran 12 km, 3.5 of them with Bob"
    df = templates.slots(spark.createDataFrame([(1, text), (2, "no slot in here")], "item bigint, text string"), "item")
    want = {(1, i, w, v) for i, (w, v) in enumerate(plain_tokens(text)) if w.startswith("<")}
    assert {tuple(r) for r in df.collect()} == want
    made, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        made += [node.metrics().apply("numOutputRows").value()] if node.nodeName() == "Generate" else []
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert made == [len(want)]


def test_texts_without_slots_to_compare_are_not_tokenised_again(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "the quick fox leaps over every lazy dog"), (2, "add 3 kg of salt to 3 l of water")], "item_id bigint, text string")
    docs = [(i, "see the quick fox leaps over every lazy dog at 5 pm", "en", "s", 1) for i in range(5)] + [(9, "add 5 g of salt to 5 ml of water", "en", "s", 1)]
    given, plain = {}, templates.slots

    def noted(rows, *key):
        given[key] = given.get(key, 0) + rows.count()
        return plain(rows, *key)
    monkeypatch.setattr(templates, "slots", noted)
    found = {(r.doc_id, r.item_id, r.kind) for r in templates.leaks(frame(spark, docs), bench).collect()}
    assert found == {(i, 1, "verbatim") for i in range(5)} | {(9, 2, "reparameterised")}
    assert given == {("item",): 2, ("doc", "th"): 1}
