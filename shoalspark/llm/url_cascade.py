"""URL lists as a cascade of Bloom filters, exact for every key the corpus can ask about.

A url asks about the keys that could equal a listed rule: the last labels of its host with a prefix of its
path, one key for each shape (labels, path length) that occurs in the list. The first filter encodes the
listed keys; the second the keys of the whole corpus that pass the first by mistake; the third the listed
keys that pass the second, and so on until a level makes no mistake. Asking the levels in turn is then exact
for all keys of the corpus and needs no join. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Host after the first ``://``, ASCII letters lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """Path after the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_key(host_col: str = "host", path_col: str = "path") -> Column:
    return F.concat(F.col(host_col), F.col(path_col))


class Cascade:
    """Exact membership in ``listed`` for the keys of ``universe`` (frames with one column ``key``).

    The bitmap of a level grows with the keys it encodes; beyond ``max_keys`` listed keys building stops with
    an error, which bounds what a task holds in memory. A key outside the universe may get a wrong answer.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, bits: int = 8, hashes: int = 3, max_keys: int = 4_000_000):
        self.hashes = hashes
        self.levels: list[tuple[Column, int]] = []
        inside = stage(listed.select("key").where("key is not null").distinct())
        outside = universe.select("key").where("key is not null").distinct()
        n = inside.count()
        if n > max_keys:
            raise ValueError(f"{n} listed keys; the cascade is made for at most {max_keys}")
        encode, against, first = inside, outside, True
        while n:
            self.levels.append(self._level(encode, n, bits))
            wrong = against.where(self._holds(F.col("key"), len(self.levels) - 1))
            if first:
                wrong = wrong.join(inside, "key", "left_anti")  # building only: keys that pass, against the list
                first = False
            wrong = stage(wrong)
            encode, against = wrong, encode
            n = wrong.count()

    def _position(self, key: Column, level: int, i: int, m: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(m).cast("bigint"))

    def _level(self, keys: DataFrame, n: int, bits: int) -> tuple[Column, int]:
        m = 64 * (1 + n * bits // 64)
        level = len(self.levels)
        at = keys.select(F.explode(F.array(*[self._position(F.col("key"), level, i, m) for i in range(self.hashes)])).alias("p"))
        words = at.groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        filled = keys.sparkSession.range(m // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left") \
            .select("w", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
        # one row whose array has m / 64 words, m bounded through max_keys
        packed = stage(filled).agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("a"))
        bitmap = stage(packed.select(F.transform("a", lambda x: x["bits"]).alias("bitmap")))
        return bitmap.scalar(), m

    def _holds(self, key: Column, level: int) -> Column:
        bitmap, m = self.levels[level]
        tests = []
        for i in range(self.hashes):
            p = self._position(key, level, i, m)
            tests.append(F.getbit(F.get(bitmap, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def contains(self, key: Column) -> Column:
        """Whether ``key`` is listed; null is not."""
        answer = F.lit(False)
        for level in reversed(range(len(self.levels))):
            answer = F.coalesce(self._holds(key, level), F.lit(False)) & ~answer
        return answer


def candidates(host_col: str, path_col: str, shapes: list[tuple[int, int]]) -> list[Column]:
    """The keys a url asks about, null where host or path are too short for the shape."""
    h, p, out = F.col(host_col), F.col(path_col), []
    labels = F.size(F.split(h, r"\."))
    for n, length in shapes:
        fits = (h != "") & (labels >= n) & (F.char_length(p) >= length)
        out.append(F.when(fits, F.concat(F.substring_index(h, ".", -n), F.substring(p, 1, length))))
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               bits: int = 8, hashes: int = 3) -> DataFrame:
    """Verdict of every url under ``rules`` (host, path, verdict: block or allow).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, at
    equal length the longer host. A url without a fitting rule is allowed. Returns page_id, host, path, rule
    and verdict for every row; a null url or one without ``://`` has empty host and path and no rule. Repeated
    rows are judged alike, an empty table gives no rows, other columns are ignored.
    """
    rules = stage(rules.select(rule_key().alias("key"), F.col("verdict"), F.size(F.split("host", r"\.")).alias("labels"),
                               F.char_length("path").alias("length")))
    shapes = [(r.labels, r.length) for r in rules.select("labels", "length").distinct().orderBy("labels", "length").collect()]
    urls = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    if not shapes:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    asked = candidates("host", "path", shapes)
    universe = urls.select(F.explode(F.array_compact(F.array(*asked))).alias("key")).distinct()
    listed = Cascade(rules, universe, bits, hashes)
    blocked = Cascade(rules.where("verdict = 'block'"), rules, bits, hashes)
    fits = [F.when(listed.contains(k), F.struct(F.char_length(k).alias("n"), F.char_length(F.substring_index(k, "/", 1)).alias("h"), k.alias("key")))
            for k in asked]
    best = F.greatest(*fits) if len(fits) > 1 else fits[0]
    found = urls.withColumn("rule", best["key"])
    return found.withColumn("verdict", F.when(F.col("rule").isNotNull() & blocked.contains(F.col("rule")), "block").otherwise("allow"))
