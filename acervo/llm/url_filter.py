"""URL filter: a blocked Bloom filter in front of an exact hash join.

``listed`` holds canonical entries ``(host, path, verdict)``.  An entry fits its
host and every subdomain when the url's path starts with the entry's path; the
longest fitting entry (host + path, then host) gives the verdict.

Method: each distinct (host, path) of the input is expanded to the canonical
keys that could be listed (host suffixes x path prefixes of lengths that occur
in the list).  A key is hashed to one 256-bit block of the Bloom filter and
tested against its bits there; what passes goes to an exact hash join with the
list, which removes false positives.  All of it is DataFrame operations.  The
filter is broadcast only while it has at most ``broadcast_blocks`` blocks (32
bytes each), the list only while it has at most ``broadcast_entries`` entries;
beyond that both joins shuffle.

Verdicts go back to the rows by (host, path).  Pairs that stand on more than a
``HOT``-th of all rows (fewer than ``HOT`` pairs, so they fit a broadcast) meet
their rows where those are; only the other rows are shuffled, and of them no
key has more than that share.

Defined cases: a null url, or one without ``://``, has empty host and path and
fits nothing; an empty list leaves every url to ``default``; null or empty hosts
and null verdicts in the list are ignored, a null path there counts as empty,
repeated entries count once (for contradicting verdicts ``block`` wins).  Rows of
the input are never merged: repeated urls and ids keep all their rows, and all
other columns pass through (work columns take names that ``pages`` does not
have).  Very long urls are judged whole; an empty table gives an empty result.
Results are named by ``host_col``, ``path_col``, ``rule_col`` and ``verdict_col``
and replace columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import cut, unused

BITS_PER_KEY = 16
BLOCK_BITS = 256
PROBES = 8
HOT = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    """``PROBES`` positions in 0..255, eight bits of a second hash each."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as rows ``(block, w0..w3)``: one 256-bit block as four longs."""
    bits = keys.select(_block(F.col(key), n_blocks).alias("block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    word = lambda w: F.bit_or(F.when(F.expr(f"bit div 64 = {w}"), F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long")))
    return bits.groupBy("block").agg(*[word(w).alias(f"w{w}") for w in range(BLOCK_BITS // 64)])


def _passes(key: Column) -> Column:
    test = F.lit(True)
    for bit in _bits(key):
        word = F.element_at(F.array("w0", "w1", "w2", "w3"), (F.shiftright(bit, 6) + 1).cast("int"))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
        test = test & (word.bitwiseAND(mask) != 0)
    return test


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    url: str = "url",
    default: str = "allow",
    host_col: str = "host",
    path_col: str = "path",
    rule_col: str = "rule",
    verdict_col: str = "verdict",
    broadcast_entries: int = 100_000,
    broadcast_blocks: int = 100_000,
) -> DataFrame:
    """``pages`` with host, path, the longest fitting rule (or null) and its verdict (else ``default``)."""
    entries = (
        listed.where("host <> '' AND verdict IS NOT NULL")
        .select(F.translate("host", UPPER, LOWER).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"), "verdict")
        .groupBy("_host", "_path")
        .agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("_verdict"))
        .withColumn("_key", F.concat("_host", F.lit("\n"), "_path"))
    )
    results = (host_col, path_col, rule_col, verdict_col)
    work, key, won = unused([*pages.columns, *results], "work", "key", "won")
    others = [F.col(f"`{c}`") for c in pages.columns if c not in results]
    parts = F.struct(host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"))
    rows = pages.select(*others, parts.alias(work))

    def judged(some: DataFrame, best: Column) -> DataFrame:
        return some.select(*others, F.col(work)["h"].alias(host_col), F.col(work)["p"].alias(path_col), best["rule"].alias(rule_col), F.coalesce(best["verdict"], F.lit(default)).alias(verdict_col))

    total = entries.agg(F.count("*"), F.collect_set(F.length("_path"))).first()
    n, lengths = total[0], sorted(total[1])
    if not n:
        return judged(rows, F.lit(None).cast("struct<rule: string, verdict: string>"))
    n_blocks = max(1, math.ceil(n * BITS_PER_KEY / BLOCK_BITS))
    blocks = bloom_blocks(entries, "_key", n_blocks)
    if n_blocks <= broadcast_blocks:
        blocks = F.broadcast(blocks)
    exact = entries.select("_key", "_host", "_path", "_verdict")
    if n <= broadcast_entries:
        exact = F.broadcast(exact)

    seen = cut(rows.groupBy(F.col(work)["h"].alias("_h"), F.col(work)["p"].alias("_p")).agg(F.count("*").alias("_n")), "urls")
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(F.split("_h", r"\."), i, 1_000_000), "."))
    prefixes = F.array_distinct(F.array(*[F.when(F.length("_p") >= k, F.substring("_p", 1, k)) for k in lengths]))
    possible = (
        seen.select("_h", "_p", F.explode(suffixes).alias("_s"), prefixes.alias("_t"))
        .select("_h", "_p", "_s", F.explode("_t").alias("_t"))
        .where("_t IS NOT NULL")
        .select("_h", "_p", F.concat("_s", F.lit("\n"), "_t").alias("_key"))
        .withColumn("block", _block(F.col("_key"), n_blocks))
        .join(blocks, "block")
        .where(_passes(F.col("_key")))
        .select("_h", "_p", "_key")
    )
    best = (
        possible.join(exact, "_key")
        .select("_h", "_p", F.struct((F.length("_host") + F.length("_path")).alias("n"), F.length("_host").alias("m"), F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict")).alias("_b"))
        .groupBy("_h", "_p")
        .agg(F.max("_b").alias("_b"))
    )
    # rows meet verdicts: hot pairs by a broadcast of fewer than HOT rows, the others by their key
    most = (seen.agg(F.sum("_n")).first()[0] or 0) / HOT
    pair = F.struct(F.col("_h").alias("h"), F.col("_p").alias("p")).alias(key)
    hot = F.broadcast(seen.where(F.col("_n") > most).join(best, ["_h", "_p"], "left").select(pair, F.col("_b").alias(won)))
    rest = best.select(pair, F.col("_b").alias(won))
    meet = F.col(work) == F.col(key)
    often = judged(rows.join(hot, meet), F.col(won))
    seldom = judged(rows.join(hot.select(key), meet, "left_anti").join(rest, meet, "left"), F.col(won))
    return often.unionByName(seldom)
