"""Rules on hosts and paths, judged by a cascade of Bloom filters over the corpus's complete key universe.

A url's keys are the suffixes of its host joined to the prefixes of its path, at the sizes some rule has.  Level 0 of a
cascade encodes the listed keys.  Level 1 encodes those keys of the universe that level 0 takes for listed and are not,
level 2 the listed keys that level 1 takes for false, and so on, until a level makes no mistake.  A key of the universe
is listed exactly if the first level that denies it has an odd number (counted from 0) or, if none denies it, if the
number of levels is odd.  Filters are folded into literals, so judging needs no join; all of it is DataFrame functions.

Null urls, and urls without ``://``, have an empty host and path, fit no rule and get the default verdict.  Repeated
pages get repeated rows.  An empty table gives an empty result.  Columns other than page_id and url play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the production query (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
MAX_FILTER_BITS = 1 << 27  # 16 MB: largest filter that may be folded into a plan


@dataclass(frozen=True)
class Level:
    """One Bloom filter: the number of bits, of hash functions, a seed, and the 64-bit words."""

    bits: int
    hashes: int
    seed: int
    words: str

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        tests = [
            F.getbit(F.element_at(words, (p / 64).cast("int") + 1), p.cast("int") % 64) == 1
            for p in _positions(key, self.bits, self.hashes, self.seed)
        ]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    per_key = max(1.0, math.log2(1 / rate)) / math.log(2)
    bits = max(64, 64 * math.ceil(n * per_key / 64))
    if bits > MAX_FILTER_BITS:
        raise ValueError(f"a filter of {bits} bits is over the bound of {MAX_FILTER_BITS}; split the list by a hash of the key")
    hashes = max(1, round(math.log2(1 / rate)))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p"))
    rows = (
        spots.groupBy((F.col("p") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("w"))
        .collect()  # bounded: a row per word of a filter within MAX_FILTER_BITS
    )
    words = ["0"] * (bits // 64)
    for row in rows:
        words[row["word"]] = str(row["w"])
    return Level(bits, hashes, seed, ",".join(words))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell the listed keys from all other keys of the universe; both frames have distinct ``key`` values."""
    n, total = listed.count(), universe.count()
    if not n:
        return []
    first_rate = min(0.5, max(1e-9, n * math.sqrt(0.5) / max(1, total)))
    levels = [_level(listed, n, first_rate, 0)]
    inside = listed
    false = checkpoint(universe.where(levels[0].holds(F.col("key"))).join(listed, "key", "left_anti"))
    left = false.count()
    while left:
        levels.append(_level(false, left, 0.5, len(levels)))
        inside, false = false, checkpoint(inside.where(levels[-1].holds(F.col("key"))))
        left = false.count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The keys of a url at the host sizes (labels) and path sizes (characters) that rules have."""
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    keys = [
        F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k in labels
        for n in lengths
    ]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _fitting(levels: list[Level], verdict: str) -> Column:
    """The keys of a url that are listed under a verdict, each with its length in front."""
    fits = F.filter("keys", lambda k: member(levels, k))
    return F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), F.lit(verdict).alias("v"), k.alias("k")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule that fits a page's url, else the default.

    Two rules of one length: the one that blocks wins.  ``rules`` is a bounded list that travels with the plan.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), rules) if rules else F.array().cast("array<string>"))
    universe = checkpoint(parts.select(F.explode("keys").alias("key")).distinct())
    found = {}
    for verdict in ("allow", "block"):
        listed = [h + p for h, p, v in dict.fromkeys(rules) if v == verdict]
        keys = spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(set(listed))))).alias("key")) if listed else None
        levels = build_cascade(keys, universe) if listed else []
        found[verdict] = _fitting(levels, verdict)
    best = F.array_max(F.concat(found["allow"], found["block"]))
    judged = parts.select("page_id", "host", "path", best.alias("best"))
    return judged.select(
        "page_id", "host", "path", F.col("best.k").alias("rule"), F.coalesce(F.col("best.v"), F.lit(default)).alias("verdict")
    )


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged AS (
  SELECT page_id, host, path,
         (SELECT max(struct_pack(n := length(h || p), v := v, k := h || p)) FROM rules
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM parts
)
SELECT page_id, host, path, best.k AS rule, coalesce(best.v, 'allow') AS verdict FROM judged
"""
