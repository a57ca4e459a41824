"""URL rules decided by a Bloom filter cascade, with DataFrame functions alone.

A rule is a (host, path, verdict); it fits its host and all subdomains where the
url's path starts with the rule's. A url's candidate keys are its host's
suffixes joined to its path's prefixes of the lengths that rules have. The keys
of all urls are the complete universe, so a cascade can be exact over it: level
1 encodes the listed keys, level 2 the universe's keys that level 1 wrongly
takes, level 3 the listed keys that level 2 wrongly takes, and so on until no
key is wrong. A lookup walks the levels; there is no join, in the build neither:
one aggregate over urls' keys and listed keys marks the listed ones.

Level 1 is sized from the universe's size so that it lets through about as many
keys as are listed; the cascade holds some log2(universe / listed) + 4 bits a
listed key. A list of more than MOST_KEYS is split by a hash of its keys into
several cascades. Nothing but a level's words reaches the driver.

Null urls, urls without "://" and empty ones have an empty host and path and
meet no rule; very long urls are judged whole. Repeated rows give repeated
results; an empty table or an empty list gives a cascade without levels. Extra
columns are left out unless kept; one kept under a result's name is refused.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import durable

ALLOW, BLOCK = "allow", "block"
#: Most listed keys of one cascade: its levels then take a few MB; more keys make more cascades.
MOST_KEYS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Every host suffix with every path prefix a rule could have, the longest key first, at equal length the longer host."""
    labels = max((h.count(".") + 1 for h, _, _ in rules), default=0)
    lengths = sorted({len(p) for _, p, _ in rules})
    parts = F.split(host, r"\.")
    n = F.size(parts)
    from_ = F.greatest(F.lit(1), n - labels + 1)
    suffixes = F.transform(F.sequence(from_, n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths])) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct((-F.length(h) - F.length(p)).alias("n"), (-F.length(h)).alias("h"), F.concat(h, p).alias("k")))))
    return F.transform(F.array_sort(keys), lambda x: x["k"])


def _places(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing: the bits of a key in a level."""
    a = F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(bits))
    b = F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(bits))
    return [F.pmod(a + i * b, F.lit(bits)) for i in range(hashes)]


class Level:
    """One Bloom filter, as 32-bit words."""

    def __init__(self, seed: int, bits: int, hashes: int, words: list[int]):
        self.seed, self.bits, self.hashes, self.words = seed, bits, hashes, words

    @classmethod
    def build(cls, keys: DataFrame, n: int, share: float, seed: int) -> Level:
        """keys (key): n distinct ones; share: of other keys to let through, about."""
        hashes = max(1, round(-math.log2(share)))
        bits = max(64, math.ceil(n * hashes / math.log(2)))
        placed = keys.select(F.explode(F.array(*_places(F.col("key"), seed, bits, hashes))).alias("p"))
        rows = placed.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("v")).collect()
        words = [0] * (bits // 32 + 1)
        for w, v in rows:
            words[w] = v
        return cls(seed, bits, hashes, words)

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        hit = lambda p: F.expr("true") & (F.getbit(F.get(words, F.shiftright(p, 5).cast("int")), p.bitwiseAND(31).cast("int")) == 1)
        out = F.lit(True)
        for p in _places(key, self.seed, self.bits, self.hashes):
            out = out & hit(p)
        return out


class Cascade:
    """Exact membership in a list, for every key of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: list[str], universe: DataFrame, n_universe: int | None = None) -> Cascade:
        """universe (key): all keys that will ever be looked up, repeats allowed; n_universe: how many, if known."""
        if not listed:
            return cls([])
        return cls.of(marked([(k, BLOCK) for k in sorted(set(listed))], universe), F.col("verdict").isNotNull(), n_universe)

    @classmethod
    def of(cls, known: DataFrame, listed: Column, n_universe: int | None = None, most_levels: int = 64) -> Cascade:
        """known (key, verdict), durable and distinct; listed: which of its keys are."""
        taken, others = known.where(F.coalesce(listed, F.lit(False))).select("key"), known.where(~F.coalesce(listed, F.lit(False))).select("key")
        n_taken, n_universe = taken.count(), n_universe or known.count()
        levels: list[Level] = []
        while n_taken:
            if len(levels) == most_levels:
                raise RuntimeError("the cascade did not end")
            share = 0.5 if levels else min(0.5, max(1e-12, n_taken / max(1, n_universe)))
            levels.append(Level.build(taken, n_taken, share, len(levels)))
            wrong = durable(others.where(levels[-1].holds(F.col("key"))))
            taken, others, n_taken = wrong, taken, wrong.count()
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """Odd depth of the first level that refuses a key means it isn't listed: found by walking from the last level."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            out = F.when(self.levels[depth - 1].holds(key), out).otherwise(F.lit(depth % 2 == 0))
        return out


class Cascades:
    """A list of any length: a cascade for each part of its keys by hash."""

    def __init__(self, known: DataFrame, listed: Column):
        n = known.where(listed).count()
        self.parts = max(1, -(-n // MOST_KEYS))
        part = self._part(F.col("key"))
        self.cascades = [Cascade.of(known if self.parts == 1 else durable(known.where(part == i)), listed) for i in range(self.parts)]

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.parts))

    def holds(self, key: Column) -> Column:
        out = self.cascades[0].holds(key)
        for i in range(1, self.parts):
            out = F.when(self._part(key) == i, self.cascades[i].holds(key)).otherwise(out)
        return out


def marked(listed: list[tuple[str, str]], universe: DataFrame) -> DataFrame:
    """(key, verdict), durable: each distinct key of the universe and of the list, with its verdict if listed."""
    inside = universe.sparkSession.createDataFrame(listed, "key string, verdict string")
    return durable(universe.select("key", F.lit(None).cast("string").alias("verdict")).unionByName(inside).groupBy("key").agg(F.max("verdict").alias("verdict")))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(kept columns, host, path, rule, verdict): the longest rule that fits a url decides; without one it is allowed."""
    by_key: dict[str, str] = {}
    for h, p, verdict in rules:
        if by_key.setdefault(h + p, verdict) != verdict:
            raise ValueError(f"two verdicts for {h + p}")
    if clash := set(keep) & {"host", "path", "rule", "verdict"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    hosts = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = hosts.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), rules))
    known = marked(sorted(by_key.items()), keyed.select(F.explode("__keys").alias("key")))
    found = {v: Cascades(known, F.coalesce(F.col("verdict") == v, F.lit(False))) for v in (ALLOW, BLOCK)}
    fits = F.filter("__keys", lambda k: found[ALLOW].holds(k) | found[BLOCK].holds(k))
    ruled = keyed.select(*keep, "host", "path", F.get(fits, 0).alias("rule"))
    verdict = F.when(F.col("rule").isNull(), ALLOW).when(found[BLOCK].holds(F.col("rule")), BLOCK).otherwise(ALLOW)
    return ruled.select(*keep, "host", "path", "rule", verdict.alias("verdict"))


#: The rules of the registered query.
RULES = [("com", "/en/", BLOCK), ("example.com", "/en/7", ALLOW), ("net", "/de/", ALLOW), ("example.net", "/de/8", BLOCK), ("org", "/es/", BLOCK)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(v, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM u
"""
