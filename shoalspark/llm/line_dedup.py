"""Line dedup with two Bloom filters, for line hashes seen once and seen at least twice.

Tasks set bits for the lines of their documents. Where partial filters meet, a bit both have in their "once"
filter goes to the "twice" filter, so a line found in two documents always has all its bits there. Only lines
that the "twice" filter suspects are shuffled, with their text, for exact confirmation; a wrong suspicion
costs one shuffled line and changes nothing. The filter is sized from the number of lines up to ``filter_mb``.
Beyond that bound more lines are suspected and the cost tends to one plain shuffle of all lines.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.staging import stage

SPACE = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 20
FLUSH = 1 << 20


def line_keys(text: str | None) -> list[bytes]:
    """Key of every line: ASCII space stripped, A-Z lower-cased."""
    return [line.strip(SPACE) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions per hash, from its lower and upper half; ``bits`` is a power of two up to 2^32."""
    mask = np.uint64(bits - 1)
    return np.concatenate([hashes & mask, (hashes >> np.uint64(32)) & mask])


def segments(once: np.ndarray, twice: np.ndarray, bits: int):
    """(segment, once, twice) compressed bitmaps of the touched segments."""
    size = min(SEGMENT, bits)
    p1, p2 = positions(once, bits), positions(twice, bits)
    for seg in np.unique(p1 // np.uint64(size)):
        maps = []
        for p in (p1, p2):
            own = p[p // np.uint64(size) == seg] if bits > size else p
            flags = np.zeros(size, np.uint8)
            flags[(own % np.uint64(size)).astype(np.int64)] = 1
            maps.append(zlib.compress(np.packbits(flags).tobytes(), 1))
        yield int(seg), maps[0], maps[1]


def partial_filters(bits: int, least: int):
    def run(batches):
        hashes: list[int] = []

        def flush():
            values, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
            return pd.DataFrame(segments(values, values[counts > 1], bits), columns=["segment", "once", "twice"])

        for pdf in batches:
            for text in pdf["text"]:
                own = {xxhash.xxh3_64_intdigest(k) for k in line_keys(text) if long_enough(k, least)}
                hashes.extend(own)
                if len(hashes) >= FLUSH:
                    yield flush()
                    hashes.clear()
        if hashes:
            yield flush()
    return run


def merged_filters(batches):
    maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        for seg, once, twice in zip(pdf["segment"], pdf["once"], pdf["twice"]):
            a = np.frombuffer(zlib.decompress(once), np.uint8)
            b = np.frombuffer(zlib.decompress(twice), np.uint8)
            if seg in maps:
                o, t = maps[seg]
                t |= b | (o & a)
                o |= a
            else:
                maps[seg] = (a.copy(), b.copy())
    rows = [(seg, zlib.compress(t.tobytes(), 1)) for seg, (_, t) in maps.items()]
    yield pd.DataFrame(rows, columns=["segment", "twice"])


def suspected_lines(filter_bits, bits: int, least: int):
    def run(batches):
        flags = np.frombuffer(filter_bits.value, np.uint8)
        for pdf in batches:
            out = []
            for doc, th, text in zip(pdf["doc"], pdf["th"], pdf["text"]):
                where: dict[bytes, list[int]] = {}
                for i, k in enumerate(line_keys(text)):
                    if long_enough(k, least):
                        where.setdefault(k, []).append(i)
                if not where:
                    continue
                keys = list(where)
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                p = positions(h, bits).astype(np.int64)
                hit = (flags[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
                for j in np.flatnonzero(hit[:len(h)] & hit[len(h):]):
                    out.append((doc, th, keys[j], where[keys[j]]))
            yield pd.DataFrame(out, columns=["doc", "th", "key", "lines"])
    return run


def without_lines(batches):
    for pdf in batches:
        kept, n = [], []
        for text, drop in zip(pdf["text"], pdf["drop"]):
            lines = (text or "").split("\n")
            n.append(len(lines))
            if drop is not None and len(drop):
                gone = set(drop)
                lines = [x for i, x in enumerate(lines) if i not in gone]
            kept.append("\n".join(lines))
        yield pd.DataFrame({"doc": pdf["doc"], "text": kept, "n_lines": n,
                            "n_dropped": [0 if d is None else len(d) for d in pdf["drop"]]})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10,
                bits_per_line: int = 8, filter_mb: int = 128) -> DataFrame:
    """Keep repeated lines only in the smallest document that holds them.

    A line's key is the line stripped of ASCII space, A-Z lower-cased. A key of at least ``least`` code points
    found in two or more documents loses all its lines except those in the smallest id; inside that document
    all copies stay. Returns doc_id, text (kept lines), n_lines (before) and n_dropped for every row. A null
    or empty text is one empty line. Rows that share an id are one document with several texts; the null id is
    such a document and orders last. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.coalesce(F.col(id_col), last).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
                       F.col(text_col).alias("text"))
    newline = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    lines = rows.agg(F.sum(newline)).first()[0] or 1
    bits = 1 << max(10, int(lines * bits_per_line - 1).bit_length())
    bits = min(bits, 1 << (int(filter_mb * 8 * (1 << 20))).bit_length() - 1, 1 << 32)

    partial = rows.select("text").mapInPandas(partial_filters(bits, least), "segment int, once binary, twice binary")
    merged = partial.repartition(max(1, bits // SEGMENT), "segment").mapInPandas(merged_filters, "segment int, twice binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    size = min(SEGMENT, bits) // 8
    for r in merged.toLocalIterator():  # bounded by filter_mb
        bitmap[r.segment * size:(r.segment + 1) * size] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    suspects = stage(rows.mapInPandas(suspected_lines(shared, bits, least), "doc bigint, th bigint, key binary, lines array<int>"))
    # staged, so that either side of the join has an exchange of its own and a very common line can be split
    repeated = stage(suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                     .where("first <> last").select("key", "first"))
    drops = suspects.join(repeated, "key").where("doc > first") \
        .groupBy("doc", "th").agg(F.flatten(F.collect_set("lines")).alias("drop"))
    judged = rows.join(drops, ["doc", "th"], "left").select("doc", "text", "drop")
    kept = judged.mapInPandas(without_lines, "doc bigint, text string, n_lines bigint, n_dropped bigint")
    return kept.select(F.when(F.col("doc") != last, F.col("doc")).alias("doc_id"), "text", "n_lines", "n_dropped")
