"""Licence texts and notices by a positional index of rare words.

Templates are short licence sentences with mandatory key phrases. Every word of theirs has postings (template,
position). A first pass counts in how many documents each of these words stands. In the second pass a file's licence
words are looked up from the highest IDF down: the places of a template's rarest mandatory word propose where the
template may begin, the places of the next ones, moved back by their own positions, are intersected with these. Where
all mandatory words agree, the key phrases stand in full, and the share of all template words in place is counted.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.scan import slices

# fixed values: phrases and labels of the contract, all of whose words are mandatory
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# fixed values: label, sentence of a published licence or notice, mandatory key phrases in it
SENTENCES = [
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("apache-2.0", "spdx license identifier apache 2 0", ["identifier apache 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ["source and binary forms", "following conditions"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc-by-nd", "cc by nd", ["cc by nd"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ["with or without fee"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ["free of charge", "obtaining a copy"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied",
     ["without warranty of any kind"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered", "public domain"]),
]
#: A-Z lower-cased, bytes that are in no word made spaces
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    must: tuple[int, ...]  # positions of the mandatory words
    base: bool


def template(label: str, sentence: str, phrases: list[str], base: bool = False) -> Template:
    words = sentence.split()
    must: set[int] = set()
    for phrase in phrases:
        part = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(part)] == part]
        if not at:
            raise ValueError(f"{phrase!r} is not in the sentence of {label}")
        must.update(i + k for i in at for k in range(len(part)))
    return Template(label, tuple(w.encode() for w in words), tuple(sorted(must)), base)


def templates(sentences=SENTENCES, base=BASE) -> list[Template]:
    return [template(label, phrase, [phrase], True) for phrase, label in base] + [template(*s) for s in sentences]


def vocabulary(known: list[Template]) -> dict[bytes, int]:
    """Number of every template word, from 1."""
    return {w: i + 1 for i, w in enumerate(sorted({w for t in known for w in t.words}))}


def licence_words(data: bytes, vocab: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words of a text, and places and numbers of those that a template holds."""
    n, places, codes = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for part in slices(data.translate(_WORDS)):
        words = part.split()
        code = np.fromiter(map(vocab.get, words, repeat(0)), np.int32, len(words))
        hit = np.flatnonzero(code)
        places.append(hit + n), codes.append(code[hit])
        n += len(words)
    return n, np.concatenate(places), np.concatenate(codes)


def document_counts(vocab: dict[bytes, int]):
    def run(batches):
        total = np.zeros(len(vocab) + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total[np.unique(licence_words(text.as_py() or b"", vocab)[2])] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["code", "n"])
    return run


class Index:
    """Postings of the template words, each template filed under its rarest mandatory word."""

    def __init__(self, known: list[Template], vocab: dict[bytes, int], documents: dict[int, int], share: float):
        self.vocab, self.rank = vocab, {c: (documents.get(c, 0), c) for c in vocab.values()}  # low count: high IDF
        self.filed: dict[int, list] = defaultdict(list)
        for t in known:
            codes = [vocab[w] for w in t.words]
            rarest = sorted(t.must, key=lambda q: self.rank[codes[q]])
            least = len(codes) if t.base else int(np.ceil(share * len(codes) - 1e-9))
            self.filed[codes[rarest[0]]].append((t, codes, rarest, least))

    def find(self, places: np.ndarray, codes: np.ndarray):
        """(template, beginnings, words in place at each) of the templates that a file holds."""
        order = np.argsort(codes, kind="stable")
        there, first = np.unique(codes[order], return_index=True)
        where = dict(zip(there.tolist(), np.split(places[order], first[1:])))
        for code in sorted(where.keys() & self.filed.keys(), key=self.rank.__getitem__):
            for t, words, rarest, least in self.filed[code]:
                starts = where[code] - rarest[0]
                for q in rarest[1:]:
                    if not len(starts) or words[q] not in where:
                        starts = starts[:0]
                        break
                    starts = starts[np.isin(starts, where[words[q]] - q)]
                if len(starts):
                    held = sum(np.isin(starts, where[w] - q).astype(np.int64) for q, w in enumerate(words) if w in where)
                    if (good := held >= least).any():
                        yield t, starts[good], held[good]


def scanned(index: Index):
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                n, places, codes = licence_words(text.as_py() or b"", index.vocab)
                found = list(index.find(places, codes)) if len(codes) else []
                base = np.concatenate([s for t, s, _ in found if t.base] or [np.zeros(0, np.int64)])
                out.append((n, len(base), int(base.min()) if len(base) else None, int(base.max()) if len(base) else None,
                            ",".join(sorted({t.label for t, *_ in found if t.base})), ",".join(sorted({t.label for t, *_ in found})),
                            max((int(h.max()) / len(t.words) for t, _, h in found), default=0.0),
                            [{"label": t.label, "start": int(s), "n_words": len(t.words), "n_held": int(k)}
                             for t, at, held in found for s, k in zip(at, held)]))
            columns = [batch.column("row"), *(pa.array(v, k) for v, k in zip(zip(*out), _KINDS))] if out else \
                [batch.column("row"), *(pa.array([], k) for k in _KINDS)]
            yield pa.RecordBatch.from_arrays(columns, ["row", *_COLUMNS])
    return run


_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int32()), ("n_held", pa.int32())])
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]
_RESULT = ("row struct<id:{}>, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
           "score double, spans array<struct<label:string,start:bigint,n_words:int,n_held:int>>")


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None,
                  share: float = 0.8) -> DataFrame:
    """Licence notices in every row of ``docs``.

    A template is found where all words of its mandatory phrases stand in place and at least ``share`` of all
    its words; base templates need all. Returns doc_id, n_words, n_base (places of base templates), first_word, last_word
    (smallest and largest beginning of these, words from 0; else null), base_labels and labels (distinct, sorted,
    comma-joined), score (largest share of a found template's words in place, 0 without one) and spans (label,
    first word, words of the template and words in place of every place). Beginnings before the text (a template cut
    off at its front) are negative. A null text is an empty one: no words, empty labels, score 0. Words of equal IDF are
    ordered by themselves, which changes the search and not the result. Repeated rows are scanned alike, an empty table
    gives no rows, other columns are ignored. Very long texts are read in parts; a text needs about its size besides.
    """
    known = templates() if known is None else known
    vocab = vocabulary(known)
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).cast("binary").alias("text"))
    # one number for each word of the templates
    counted = rows.select("text").mapInArrow(document_counts(vocab), "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    index = Index(known, vocab, {r.code: r.n for r in counted.collect()}, share)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(scanned(index), _RESULT.format(kind)).select(F.col("row.id").alias("doc_id"), *_COLUMNS)
