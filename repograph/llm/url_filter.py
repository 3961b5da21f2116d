"""URL rules looked up in Bloom filter cascades.

A rule is a host and a path prefix with a verdict.  A url yields a few candidate keys: the host
suffixes and path prefixes whose shape (number of labels, length of path) some rule has.  Each verdict
has a cascade over its listed keys: level 1 encodes the keys, level 2 those candidate keys of the
whole corpus that level 1 lets pass wrongly, level 3 the listed keys that level 2 lets pass, and so
on until no key passes wrongly.  For every key of the corpus the first level that refuses it then
says exactly whether it is listed, so urls are judged without a join or a shuffle.

A cascade's size follows the number of listed keys: level 1 is sized so that about as many keys pass
wrongly as are listed, and each further level halves them.  Its bytes are checked against ``max_filter_bytes``.

Nulls and urls without ``://`` have an empty host and path; no rule fits them and the verdict is the
cascade's for an unlisted key, ``allow``.  An empty table gives an empty result, repeated rows are
each judged, and only the id and url columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.tables import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = 64


@dataclass
class Cascade:
    """Levels of (bits, hashes, words); ``words`` is a table of one row, an array of 64-bit words."""

    levels: list[tuple[int, int, DataFrame]] = field(default_factory=list)

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""

        verdict = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            verdict = F.when(_passes(self.levels[number - 1], number, key), verdict).otherwise(
                F.lit(number % 2 == 0))
        return verdict


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""

    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """The key of a url for each shape of rules; null where the url is too short."""

    labels = F.split(host, r"\.", -1)
    return [
        F.when((F.size(labels) >= n) & (F.length(path) >= length), F.concat(
            F.substring_index(host, ".", -n), F.substring(path, 1, length)))
        for n, length in shapes
    ]


def _position(key: Column, level: int, number: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(number)), F.lit(bits))


def _bit(position: Column) -> Column:
    # Java shifts by the lowest six bits of the distance.
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


def _words(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    positions = F.array(*[_position(F.col("key"), level, i, bits) for i in range(hashes)])
    set_words = (
        keys.select(F.explode(positions).alias("position"))
        .groupBy((F.col("position") / 64).cast("long").alias("word"))
        .agg(F.bit_or(_bit(F.col("position"))).alias("bits"))
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")))
    return store(set_words.select(F.transform(
        F.sequence(F.lit(0), F.lit(bits // 64 - 1)),
        lambda i: F.coalesce(F.element_at("words", i.cast("long")), F.lit(0).cast("long"))).alias("words")))


def _passes(level: tuple[int, int, DataFrame], number: int, key: Column) -> Column:
    bits, hashes, words = level
    # One value per query: Spark evaluates the scalar subquery once and sends it to the tasks.
    array = words.scalar()
    tests = [
        F.get(array, (p / 64).cast("int")).bitwiseAND(_bit(p)) != 0
        for p in (_position(key, number, i, bits) for i in range(hashes))
    ]
    passed = tests[0]
    for test in tests[1:]:
        passed = passed & test
    return passed


def build_cascade(
    listed: DataFrame, universe: DataFrame, universe_size: int, max_filter_bytes: int
) -> Cascade:
    """Cascade of ``listed`` (key) that is exact on ``universe`` (key, repeats allowed)."""

    cascade = Cascade()
    included, included_size = listed, listed.count()
    excluded, spent = universe, 0
    share = included_size / (math.sqrt(2) * max(universe_size, 1))
    while included_size:
        level = len(cascade.levels) + 1
        if level > LEVELS:
            raise ValueError("the cascade does not end; keys collide in all hashes")
        hashes = max(1, round(math.log2(1 / min(0.5, share)))) if level == 1 else 1
        bits = 64 * max(1, math.ceil(included_size * hashes / math.log(2) / 64))
        spent += bits // 8
        if spent > max_filter_bytes:
            raise ValueError(f"the filters need over {max_filter_bytes} bytes; raise max_filter_bytes")
        cascade.levels.append((bits, hashes, _words(included, level, bits, hashes)))
        wrong = excluded.where(_passes(cascade.levels[-1], level, F.col("key"))).distinct()
        if level == 1:
            wrong = wrong.join(listed, "key", "left_anti")
        wrong = store(wrong)
        included, excluded = wrong, included
        included_size = wrong.count()
    return cascade


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
    max_filter_bytes: int = 64 << 20,
) -> DataFrame:
    """Judge every url by the longest rule that fits.

    ``rules`` has ``verdict`` (allow or block), ``host`` and ``path``; a rule listed under both
    verdicts is refused.  Returns the id, host, path, rule (null if none fits) and verdict.
    """

    named = store(rules.select("verdict", "host", "path", F.concat("host", "path").alias("key")).distinct())
    if named.groupBy("key").agg(F.count_distinct("verdict").alias("n")).where("n > 1").head(1):
        raise ValueError("a rule is listed with two verdicts")
    shapes = sorted(
        (r["n"], r["length"]) for r in named.select(
            F.size(F.split("host", r"\.", -1)).alias("n"), F.length("path").alias("length")).distinct().collect())
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select(
        "id", host.alias("host"), path.alias("path"))
    keys = {f"key_{i}": k for i, k in enumerate(candidate_keys(F.col("host"), F.col("path"), shapes))}
    keyed = store(urls.withColumns(keys))
    universe = keyed.select(F.explode(F.array(F.lit(None).cast("string"), *keys)).alias("key")).where(
        "key IS NOT NULL")
    size = universe.agg(F.approx_count_distinct("key")).head()[0]
    cascades = {
        verdict: build_cascade(
            named.where(F.col("verdict") == verdict).select("key"), universe, size, max_filter_bytes)
        for verdict in ("allow", "block")
    }
    judged = [
        F.struct(
            F.length(k).alias("length"), F.col(k).alias("key"),
            F.when(cascades["block"].lists(F.col(k)), "block")
            .when(cascades["allow"].lists(F.col(k)), "allow").alias("verdict"))
        for k in keys
    ]
    none = F.struct(F.lit(-1).alias("length"), F.lit(None).cast("string").alias("key"),
                    F.lit(None).cast("string").alias("verdict"))
    # The longest listed key; unlisted ones count as none.
    best = F.array_max(F.array(none, *[F.when(j["verdict"].isNotNull(), j).otherwise(none) for j in judged]))
    return keyed.select(
        F.col("id").alias(id_column), "host", "path", best["key"].alias("rule"),
        F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"))
