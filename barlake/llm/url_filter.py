"""URL filters: host and path rules, then a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .shared import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the contract: rule text (host, then path) and its verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Names whose domains are listed by default, under each of the suffixes.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_SUFFIXES = ("example.com", "example.net", "example.org")

HASHES = 5
BITS_PER_KEY = 12
#: Bytes of a cascade's first level at most. Longer lists are dealt by hash to several cascades, applied one by one.
LEVEL_BYTES = 2 << 20


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; empty for null and for a url without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        on_host, on_path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == on_host) | host.endswith("." + on_host)) & path.startswith(on_path)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def domains_of(host: Column) -> Column:
    """The host and every domain above it, as an array; empty for an empty host."""
    labels = F.split(host, r"\.")
    upper = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(host != "", upper).otherwise(F.array().cast("array<string>"))


def _group(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("group")), F.lit(groups))


@dataclass
class BloomCascade:
    """Levels alternate: level 0 encodes the listed keys, level 1 the other keys of the universe that pass level 0,
    level 2 the listed keys that pass level 1, and so on until nothing passes wrongly. Exact for keys of the universe.
    A level is a literal of 12 / 7 bytes to 24 / 7 bytes a key.
    """

    levels: list[tuple[int, bytes]] = field(default_factory=list)

    @classmethod
    def fit(cls, listed: DataFrame, universe: DataFrame) -> BloomCascade:
        """listed, universe: one string column `key` each, without nulls or repeats. Level bits grow with the keys."""
        out = cls()
        wrong, other = listed, universe.join(listed, "key", "left_anti")
        while True:
            level = len(out.levels)
            n = wrong.count()
            if not n:
                return out
            bits = bloom.size_for(n, BITS_PER_KEY, 1 << 62)
            out.levels.append((bits, bloom.build(wrong.select("key"), level, bits, HASHES)))
            passed = other.where(out._passes(F.col("key"), level))
            wrong, other = passed, wrong

    def _passes(self, key: Column, level: int) -> Column:
        bits, held = self.levels[level]
        return bloom.holds(held, key, level, bits, HASHES)

    def listed(self, key: Column) -> Column:
        """True for listed keys, false for all others of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _within(cascade: BloomCascade, groups: int, k: int):
    return lambda key: (_group(key, groups) == k) & cascade.listed(key)


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{n}.{s}",) for n in LISTED_NAMES for s in LISTED_SUFFIXES], "key string")


def judge(pages: DataFrame, listed: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    The longest rule that fits decides. Otherwise a url is blocked when its host or a domain above it is listed, by
    the cascade over every domain that occurs in pages. Null urls and urls without :// have an empty host and path,
    fit no rule and are allowed. Repeated rows each give their row; an empty table gives none; other columns are not
    read. An empty list blocks nothing. A list of any length is met by cascades and never by a join: what one of
    LEVEL_BYTES does not hold is dealt by hash to more, and the narrow rows pass them one after the other.
    """
    base = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    listed = (default_list(pages.sparkSession) if listed is None else listed).select("key").where("key is not null").distinct()
    domains = domains_of(F.col("host"))
    universe = materialize(base.select("host").distinct().select(F.explode(domains).alias("key")).distinct(), "domains")
    listed = materialize(listed.join(universe, "key", "left_semi"), "listed")
    groups = -(-2 * BITS_PER_KEY * listed.count() // (8 * LEVEL_BYTES)) or 1
    out, hit = base, F.lit(False)
    for k in range(groups):
        own = _group(F.col("key"), groups) == k
        cascade = BloomCascade.fit(listed.where(own), universe.where(own))
        now = F.exists(domains, _within(cascade, groups, k))
        if k + 1 < groups:
            out = materialize(out.withColumn("_hit", hit | now), "hits")
            hit = F.col("_hit")
        else:
            hit = hit | now
    rule, says = first_rule(F.col("host"), F.col("path"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(hit, "block").otherwise("allow")).alias("verdict"))
