"""URL filters: longest rule by host and path, then a blocked Bloom filter before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, store

#: 64-bit blocks of the filter, at most: about 16 MB as a table.
MAX_BLOCKS = 1 << 20
HASHES = 6


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without ``index.html`` and closing slashes; no scheme, query or fragment. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?\z", "/"), r"/+\z", "")
    return F.when(host != "", F.concat(host, path))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null where none does.

    ``rules`` maps ``host/path`` to a verdict. A rule fits its host and all subdomains if the
    path starts with the rule's. Ties in length go to the first in alphabetical order.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """The word of a key: up to ``HASHES`` of 64 bits, six bits of a second hash for each."""
    second = F.xxhash64(F.lit(17), key)
    word = F.lit(0).cast("long")
    for k in range(HASHES):
        spot = F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), spot))
    return word


def bloom_filter(listed: DataFrame, key_col: str, bits_per_key: int = 12) -> tuple[DataFrame, int]:
    """A blocked Bloom filter as a table ``(block, word)`` with at most ``MAX_BLOCKS`` rows, and its number of blocks.

    All bits of a key are in one 64-bit word. The number of blocks follows the number of
    keys up to the bound; a list beyond it makes more false hits, never wrong results.
    """
    n = listed.count()
    blocks = min(MAX_BLOCKS, 1 << max(6, (n * bits_per_key // 64).bit_length()))
    key = F.col(key_col)
    words = listed.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_bits(key)).alias("word"))
    return store(words, "bloom"), blocks


def listed_hits(urls: DataFrame, listed: DataFrame, url_col: str, key_col: str = "url_key") -> DataFrame:
    """``urls`` with ``listed``: whether the canonical URL is in the list.

    The filter, of bounded size, is broadcast and decides where rows are read; only possible
    hits go on to an exact hash join with the list. Null and hostless URLs are never listed.
    """
    flag, key, maybe = fresh(urls, "listed"), fresh(urls, "url_key_here"), fresh(urls, "maybe")
    keys = listed.select(F.col(key_col).alias("list_key")).where("list_key is not null").distinct()
    table, blocks = bloom_filter(keys, "list_key")
    words = table.select(F.col("block").alias("filter_block"), F.col("word").alias("filter_word"))
    keyed = urls.withColumn(key, canonical(F.col(url_col)))
    need = _bits(F.col(key))
    probed = keyed.join(F.broadcast(words), _block(F.col(key), blocks) == words["filter_block"], "left").select(
        *[keyed[c] for c in keyed.columns],
        (F.col(key).isNotNull() & words["filter_word"].isNotNull() & (words["filter_word"].bitwiseAND(need) == need)).alias(maybe),
    )
    probed = probed.withColumn(maybe, F.coalesce(F.col(maybe), F.lit(False)))
    passed = probed.where(~F.col(maybe)).withColumn(flag, F.lit(False))
    possible = probed.where(F.col(maybe))
    marked = keys.withColumn("list_hit", F.lit(True))
    exact = possible.join(marked, possible[key] == marked["list_key"], "left").select(
        *[possible[c] for c in possible.columns], marked["list_hit"].isNotNull().alias(flag)
    )
    return passed.unionByName(exact).drop(key, maybe)


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str], url_col: str = "url", key_col: str = "url_key") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``).

    A fitting rule decides; a URL without one is blocked if it is listed. URLs that are null
    or have no ``://`` have an empty host and path, no rule, and are allowed. Names that
    ``pages`` has already are made free by leading underscores. Repeated rows stay; an empty
    list blocks nothing and an empty table stays empty.
    """
    flag, host, path = fresh(pages, "listed"), fresh(pages, "host"), fresh(pages, "path")
    placed = listed_hits(pages, listed, url_col, key_col).withColumn(host, host_of(F.col(url_col))).withColumn(path, path_of(F.col(url_col)))
    rule, verdict = fitting_rule(F.col(host), F.col(path), rules)
    own = F.when(F.col(flag), F.lit("block")).otherwise(F.lit("allow"))
    return placed.withColumn(fresh(pages, "rule"), rule).withColumn(fresh(pages, "verdict"), F.coalesce(verdict, own)).drop(flag)
