"""URL filter: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

All of it is column expressions, aggregates and joins. The list becomes a table of 256-bit
Bloom blocks (four longs, two bits in each); a URL touches one block only. URLs that pass the
filter go to an exact hash join with the list, which removes the false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: (action, host, path): fixed values of the query's contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Site labels whose pages make up the query's list: fixed values.
LISTED_SITES = ["spam-farm", "cheap-pills", "free-bets", "ads-track", "casino-win", "adult-x"]

_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"
_WORDS = 4
#: A filter of up to so many blocks (40 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 200_000


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2))


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and port, path without closing slashes; scheme, query and fragment dropped."""
    return F.concat(
        F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":[0-9]*$", ""),
        F.regexp_replace(path, r"/+$", ""),
    )


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, both null if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each word of its block."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda s: F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    return [
        F.call_function("shiftleft", one, bit(12 * w)).bitwiseOR(F.call_function("shiftleft", one, bit(12 * w + 6)))
        for w in range(_WORDS)
    ]


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as a table: one row for each block that has a bit set."""
    masked = listed.select(
        F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks)).alias("b"),
        *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))],
    )
    return masked.groupBy("b").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(_WORDS)])


def in_list(df: DataFrame, key: str, listed: DataFrame, out: str, keys_per_block: int = 16) -> DataFrame:
    """``df`` with a boolean column ``out``: is ``key`` in ``listed`` (one column of that name)?

    Only keys that pass the Bloom filter take part in the exact join; the rest never shuffles
    when the filter is small enough to broadcast. Null keys and an empty list give false.
    """
    listed = listed.select(F.col(key).alias("listed_key")).where(F.col("listed_key").isNotNull()).distinct()
    n_blocks = max(1, math.ceil(listed.count() / keys_per_block))
    blocks = bloom_blocks(listed, "listed_key", n_blocks)
    blocks = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks
    kept = df.columns
    names = {n: fresh(df, n) for n in ["b", "listed_key", *[f"w{i}" for i in range(_WORDS)]]}
    for old, new in names.items():
        blocks = blocks.withColumnRenamed(old, new)
    tested = df.withColumn(names["b"], F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks))).join(blocks, names["b"], "left")
    passes = F.col(key).isNotNull()
    for i, m in enumerate(_masks(F.col(key))):
        passes &= F.coalesce(F.col(names[f"w{i}"]).bitwiseAND(m) == m, F.lit(False))
    exact = listed.withColumnRenamed("listed_key", names["listed_key"]).hint("shuffle_hash")
    hits = (
        tested.where(passes)
        .select(*kept)
        .join(exact, F.col(key) == F.col(names["listed_key"]), "left")
        .select(*kept, F.col(names["listed_key"]).isNotNull().alias(out))
    )
    return tested.where(~passes).select(*kept, F.lit(False).alias(out)).unionByName(hits)


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict for each row of ``pages``: page_id, host, path, rule, verdict, canonical, listed.

    ``listed`` has one column ``canonical``. The longest fitting rule decides; without a rule a
    listed URL is blocked and any other allowed. Null and broken URLs have empty host and path,
    fit no rule and are allowed. Repeated rows are each judged; extra columns are not carried.
    """
    base = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    base = base.withColumn("canonical", F.nullif(canonical(F.col("host"), F.col("path")), F.lit("")))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    found = in_list(base, "canonical", listed.select("canonical"), "listed")
    return found.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical", "listed",
    )


def listed_on_sites(pages: DataFrame, sites=LISTED_SITES, url: str = "url") -> DataFrame:
    """The list as Spark derives it from ``pages``: canonical URLs of pages on the given sites."""
    host = url_host(F.col(url))
    on = F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(s) for s in sites]))
    return pages.where(on).select(canonical(host, url_path(F.col(url))).alias("canonical")).distinct()
