"""Benchmark decontamination on canonical templates.

Numbers, names and units become typed placeholders, so an item with other parameters keeps its template. Windows
of five template words are hashed and joined with the windows of the benchmark; a document leaks an item if it
holds at least 0.8 of its windows on alignments whose slots are filled consistently: one value of the item
always becomes the same value in the document. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.staging import small_side, stage

WIDTH = 5
#: a capitalised word that does not begin a sentence or line
NAME = r"(?<![.!?:;\s])[ \t]+\p{Lu}[\p{L}\p{M}'-]*"
NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
# fixed values: units that may follow a number, and endings of ordinals
UNITS = ["km", "m", "cm", "mm", "kg", "g", "mg", "t", "l", "ml", "s", "ms", "min", "h", "mph", "kmh", "hz", "khz", "w", "kw",
         "v", "a", "j", "kj", "pa", "c", "f", "k", "mb", "gb", "tb", "usd", "eur", "miles", "meters", "metres", "hours",
         "minutes", "seconds", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent"]
ORDINAL = ["st", "nd", "rd", "th"]
#: behind a digit: letters without a blank (4th, 5pm, 3D, 1990s), or a unit after one blank at most
SUFFIX = r"(?<=\p{Nd})([\p{L}\p{M}]+)"
UNIT = rf"(?<=\p{{Nd}})[ ]?(%|°C|°F|€|\$|£|(?i:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{M}}]))"
MARK, JOIN = "\u0001", "\u0002"
TOKEN = rf"{NAME}|{NUMBER}(?:{JOIN}\S+)?|{MARK}\S+|[\p{{L}}\p{{M}}]+"
PLACEHOLDERS = ["<name>", "<num>", "<unit>"]


def tokens(text: Column) -> Column:
    """Names (with the blank before them), numbers, units (behind a mark) and words of a text in order.

    A number with letters right behind it keeps these in its value, and they are a unit of their own besides.
    """
    marked = F.regexp_replace(F.regexp_replace(text, SUFFIX, f"{JOIN}$1 {MARK}$1 "), UNIT, f" {MARK}$1 ")
    return F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))


def _first(token: Column) -> Column:
    return F.left(token, F.lit(1))


def template_word(token: Column) -> Column:
    """Placeholder or lower-cased word of a token."""
    c = _first(token)
    return F.when(c.between("a", "z"), F.lower(token)).when(c.isin(" ", "\t"), "<name>").when(c == MARK, "<unit>") \
        .when(token.rlike(r"^\p{Nd}"), "<num>").otherwise(F.lower(token))


def slot_value(token: Column) -> Column:
    """What stands in the token's slot; endings of ordinals are one value."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(token, r"^[ \t]+", "")), rf"([{MARK}{JOIN}])(?:{'|'.join(ORDINAL)})$", "$1th")
    return F.regexp_replace(bare, rf"[{MARK}{JOIN}]", "")


def template_words(text: Column) -> Column:
    """Words and placeholders in order, punctuation left out."""
    return F.transform(tokens(text), template_word)


def literal_words(text: Column) -> Column:
    """The same with the values in their slots."""
    return F.transform(tokens(text), lambda t: F.concat(template_word(t), F.lit(" "), slot_value(t)))


def windows(words: str, width: int = WIDTH) -> Column:
    """Hash of every window of ``width`` words of an array column."""
    w = F.col(words)

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    last = F.size(w) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), hashed))


def text_hash(text_col: str) -> Column:
    """Tells texts apart that share an id or have none."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def slots(rows: DataFrame, *key: str) -> DataFrame:
    """(key, position, kind, value) of every placeholder of the texts in ``rows`` (key, text); other words make no rows."""
    listed = F.transform(tokens(F.col("text")), lambda t, i: F.struct(i.alias("position"), template_word(t).alias("kind"), t.alias("token")))
    placed = rows.select(*key, F.inline(F.filter(listed, lambda s: s["kind"].isin(PLACEHOLDERS))))
    return placed.select(*key, "position", "kind", slot_value(F.col("token")).alias("value"))


def benchmark_windows(benchmark: DataFrame, width: int, literal: int) -> DataFrame:
    """(item, at, hash, size) of the windows of every item that hold at least ``literal`` words of their own."""
    rows = benchmark.select("item", template_words(F.coalesce("text", F.lit(""))).alias("words"))
    own = F.size(F.filter(F.slice("words", F.col("at") + 1, width), lambda x: ~x.isin(PLACEHOLDERS)))
    per = rows.select("item", "words", F.posexplode(windows("words", width)).alias("at", "hash")).where(own >= literal)
    sizes = per.groupBy("item").agg(F.count("*").alias("size"))
    return per.select("item", "at", "hash").join(sizes, "item")


def literal_hits(docs: DataFrame, items: DataFrame, width: int, share: float) -> DataFrame:
    """(doc, th, item, n, size) for items (item, text) compared with their values, as they stand.

    Items shorter than ``width`` are one window of their own length, at least two words.
    """
    listed = items.select("item", literal_words(F.coalesce("text", F.lit(""))).alias("words"))
    found = None
    for k in range(2, width + 1):
        size = F.size("words")
        wanted = listed.where(size >= k if k == width else size == k).select("item", F.posexplode(windows("words", k)).alias("at", "hash"))
        wanted = small_side(wanted.join(wanted.groupBy("item").agg(F.count("*").alias("size")), "item"))
        if wanted.isEmpty():  # no text is read for lengths that no item has
            continue
        seen = docs.where("text is not null").select("doc", "th", literal_words(F.col("text")).alias("words")) \
            .select("doc", "th", F.explode(windows("words", k)).alias("hash"))
        hits = seen.join(wanted, "hash").groupBy("doc", "th", "item", "size").agg(F.count_distinct("at").alias("n"))
        hits = hits.where(F.col("n") >= F.lit(share) * F.col("size")).select("doc", "th", "item", "n", "size")
        found = hits if found is None else found.unionByName(hits)
    return found


def unmatchable(benchmark: DataFrame, item_text_col: str = "text") -> DataFrame:
    """Items that cannot be searched for: those of fewer than two words, numbers or names."""
    return benchmark.where(F.size(tokens(F.coalesce(F.col(item_text_col), F.lit("")))) < 2)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", width: int = WIDTH, share: float = 0.8, literal: int = 2) -> DataFrame:
    """Documents that hold benchmark items, verbatim or with other parameters.

    Returns one row per (text, item) found: doc_id, text_hash, item_id, n_windows (windows of the item found on
    consistent alignments), n_item_windows and kind (``verbatim`` if all slots of those alignments have the item's
    values, else ``reparameterised``). Items without a window of ``literal`` words of their own, among them those shorter than
    ``width``, are found as they stand only, by windows that hold the values; items of less than two words
    (``unmatchable`` lists them), null and empty texts match nothing. Very long texts are tokenised once and windowed in
    place, which takes time and memory in proportion to them; a value never parts from its slot, as both come from
    one token. Every text is judged by itself, also if rows share an id or have none, and reported under its id;
    ``by_document`` folds texts of one id. Items that share an id are one item. Repeated rows change nothing, an empty
    table gives no rows, other columns are ignored.
    """
    last = F.lit((1 << 63) - 1)
    items = stage(benchmark.select(F.coalesce(F.col(item_col), last).alias("item"), F.col(item_text_col).alias("text")).distinct())
    wanted = small_side(benchmark_windows(items, width, literal).select("item", "at", "hash", "size"))
    rows = docs.select(F.coalesce(F.col(id_col), last).alias("doc"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    seen = rows.where("text is not null").select("doc", "th", template_words(F.col("text")).alias("words")) \
        .select("doc", "th", F.posexplode(windows("words", width)).alias("position", "hash"))
    hits = seen.join(wanted, "hash").select("doc", "th", "item", "at", "size", (F.col("position") - F.col("at")).alias("shift"))
    runs = stage(hits.groupBy("doc", "th", "item", "shift", "size").agg(F.collect_set("at").alias("at")))

    def covered(aligned: DataFrame) -> DataFrame:
        return aligned.select("doc", "th", "item", "size", F.explode("at").alias("at")).groupBy("doc", "th", "item", "size") \
            .agg(F.count_distinct("at").alias("n")).where(F.col("n") >= F.lit(share) * F.col("size"))

    likely = stage(covered(runs).select("doc", "th", "item"))
    aligned = runs.join(likely, ["doc", "th", "item"]).select("doc", "th", "item", "shift", "size", "at", F.array_min("at").alias("low"),
                                                             (F.array_max("at") + width - 1).alias("high"))
    here = slots(items.where("text is not null"), "item").select("item", F.col("position").alias("q"), "kind", F.col("value").alias("from"))
    asked = stage(aligned.join(here, "item").where("q between low and high")
                  .select("doc", "th", "item", "shift", "kind", "from", (F.col("q") + F.col("shift")).alias("p")))
    # texts that hold only items without slots are not tokenised again
    texts = rows.join(asked.select("doc", "th").distinct(), ["doc", "th"], "left_semi")
    there = slots(texts.where("text is not null"), "doc", "th") \
        .select("doc", "th", F.col("position").alias("p"), "kind", F.col("value").alias("to"))
    pairs = asked.join(there, ["doc", "th", "p", "kind"]).select("doc", "th", "item", "shift", "kind", "from", "to").distinct()
    filled = pairs.groupBy("doc", "th", "item", "shift", "kind", "from") \
        .agg(F.count("*").alias("values"), F.max(F.col("from") != F.col("to")).alias("other"))
    judged = filled.groupBy("doc", "th", "item", "shift").agg(F.max("values").alias("values"), F.max("other").alias("other"))
    consistent = aligned.join(judged, ["doc", "th", "item", "shift"], "left").where("values is null or values = 1")
    kinds = consistent.groupBy("doc", "th", "item").agg(F.max(F.coalesce("other", F.lit(False))).alias("other"))
    found = covered(consistent).join(kinds, ["doc", "th", "item"]).select("doc", "th", "item", "n", "size", "other")
    plain = literal_hits(rows, items.join(wanted.select("item").distinct(), "item", "left_anti"), width, share)
    if plain is not None:
        found = found.unionByName(plain.withColumn("other", F.lit(False)))
    return found.select(F.when(F.col("doc") != last, F.col("doc")).alias("doc_id"), F.col("th").alias("text_hash"),
                        F.when(F.col("item") != last, F.col("item")).alias("item_id"),
                        F.col("n").alias("n_windows"), F.col("size").alias("n_item_windows"),
                        F.when(F.col("other"), "reparameterised").otherwise("verbatim").alias("kind"))


def by_document(found: DataFrame) -> DataFrame:
    """``leaks`` with one row per (doc_id, item_id): that of the text with the most windows, verbatim first among equals."""
    best = F.max(F.struct("n_windows", "n_item_windows", "kind")).alias("best")  # verbatim is the larger word
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in ``found`` (from ``leaks``).

    Rows that share an id are one document and go together; rows without an id are told apart by their texts.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.when(F.col(id_col).isNull(), text_hash(text_col)).alias("__th"), F.struct("*").alias("__row"))
    bad = found.select(F.col("doc_id").alias("__bad"), F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("__bad_th")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__bad")) & F.col("__th").eqNullSafe(F.col("__bad_th"))
    return rows.join(bad, same, "left_anti").select("__row.*")
