"""An inverted index of word prefixes: which texts hold a word that starts with a token.

A text is a spaced key (words of capitals and digits, one space between).  Each of its
distinct words is posted under its first 1, 2, ... ``LONGEST`` characters; a posting
of ``LONGEST`` characters carries the word itself, shorter ones need not.  So a
token of up to ``LONGEST`` characters is one exact key, and a longer one is the key
of its first ``LONGEST`` characters with a test on the word.  Keys are dealt to
buckets by CRC-32, which the driver computes as Spark does, so a lookup reads the
buckets of its tokens and no others.

Changes are postings too: ``live`` false takes a posting back, and of equal postings
the one with the highest ``seq`` counts.  A change of some texts adds the postings
that differ and leaves all others alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.operators.search import MOST_TOKENS
from acervo.session import counted_join, cut, partitions

LONGEST = 4
POSTING = "key string, word string, id long, live boolean, seq long"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")


def token_bucket(token: str, buckets: int) -> int:
    """Bucket of a query's token, on the driver."""
    return zlib.crc32(token[:LONGEST].encode()) % buckets


def postings(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """``key, word, id``: one row for each distinct key of a text (and word, where the key is of full length).

    Texts are dealt by id before they are split, so only they are shuffled: equal
    postings are of one id and meet where it is.
    """
    word = F.explode(F.array_distinct(F.split(F.coalesce(F.col("t"), F.lit("")), " ")))
    dealt = texts.select(F.col(id_).alias("id"), F.col(text).alias("t")).repartition(partitions(texts.sparkSession), "id")
    words = dealt.select("id", word.alias("w")).where("w <> ''")
    keys = F.transform(F.sequence(F.lit(1), F.least(F.length("w"), F.lit(LONGEST))), lambda n: F.struct(F.substring("w", F.lit(1), n).alias("key"), F.when(n == LONGEST, F.col("w")).otherwise(F.lit("")).alias("word")))
    return words.select("id", F.explode(keys).alias("k")).select("k.key", "k.word", "id").distinct()


def changes(before: DataFrame, after: DataFrame, id_: str, text: str, seq: int) -> DataFrame:
    """Postings to add when ``before`` becomes ``after``: only texts that differ are split into words."""
    b, a = (df.select(F.col(id_).alias("id"), F.col(text).alias(t)) for df, t in ((before, "old"), (after, "new")))
    moved = b.join(a, "id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    sides = [postings(moved, "id", t).withColumn("live", F.lit(t == "new")) for t in ("old", "new")]
    both = sides[0].unionByName(sides[1]).groupBy("key", "word", "id").agg(F.count("*").alias("n"), F.bool_or("live").alias("live"))
    return both.where("n = 1").select("key", "word", "id", "live", F.lit(seq).cast("long").alias("seq"))


def current(index: DataFrame) -> DataFrame:
    """The postings that count, of an index with its changes."""
    newest = index.groupBy("key", "word", "id").agg(F.max_by("live", "seq").alias("live"))
    return newest.where("live").drop("live")


def found(index: DataFrame, token: str) -> DataFrame:
    """Ids with a word that starts with ``token``; ``index`` holds at least its bucket."""
    own = index.where(F.col("key") == token[:LONGEST])
    if len(token) > LONGEST:
        own = own.where(F.col("word").startswith(token))
    return current(own).select("id").distinct()


def tokens_of(query_key: str) -> list[str]:
    """The tokens that count: the first eight, of which those that start another one say nothing new."""
    first = dict.fromkeys(query_key.split()[:MOST_TOKENS])
    return [t for t in first if not any(o != t and o.startswith(t) for o in first)]


FEW = 200_000


def intersected(lists: Sequence[DataFrame]) -> tuple[DataFrame, int]:
    """Ids in all lists and the length of the shortest: the lists are counted together, then met shortest first.

    A shortest list of up to ``FEW`` ids goes to the longer ones, which stay where
    they are; longer ones are hashed.
    """
    tagged = None
    for i, ids in enumerate(lists):
        ids = ids.withColumn("list", F.lit(i))
        tagged = ids if tagged is None else tagged.unionByName(ids)
    held = cut(tagged, "lists")
    size = {r["list"]: r["count"] for r in held.groupBy("list").count().collect()}
    order = sorted(range(len(lists)), key=lambda i: size.get(i, 0))
    least = size.get(order[0], 0)
    out = held.where(F.col("list") == order[0]).select("id")
    for i in order[1:]:
        longer = held.where(F.col("list") == i).select("id")
        out = longer.join(F.broadcast(out), "id", "left_semi") if least <= FEW else out.join(longer, "id", "left_semi")
    return out, least


#: Rows of a class that meet in one group of a join: so many ids and so many queries.
IDS, ASKERS = 16_384, 1_024


def answers(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, id`` for many queries ``(query, token)`` at once: texts that hold a word for every token."""
    return expanded(*matches(index, queries))


def matches(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(query, class)`` and ``(class, id)``, both written: queries of equal tokens are a class, which is answered once.

    Postings of the tokens' keys go to their ids and become the tokens that a text
    holds.  A text meets the classes whose rarest token it holds (hot tokens by a
    broadcast of those classes) and is tested for their others where it is, so no
    list of ids is shuffled for a query.  Tokens hold no space.
    """
    spark = index.sparkSession
    asked = cut(queries.where("token <> ''").groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("asked")), "asked")
    per = asked.groupBy("asked").agg(F.min("query").alias("class"), F.count("*").alias("n"))
    members = cut(counted_join(asked, per, ["asked"], "n", asked.count()).select("query", "class"), "members")
    classes = cut(per.select("class", F.split("asked", " ").alias("wanted")), "classes")
    tokens = cut(classes.select(F.explode("wanted").alias("token")).distinct().withColumn("key", F.substring("token", 1, LONGEST)), "tokens")
    if tokens.count() <= FEW:
        met = index.join(F.broadcast(tokens), "key")
    else:
        per_key = index.groupBy("key").agg(F.count("*").alias("n"))
        met = counted_join(index, tokens.join(per_key, "key"), ["key"], "n", index.count())
    fits = (F.length("token") <= LONGEST) | F.col("word").startswith(F.col("token"))
    own = met.where(fits).select("id", "token", "word", "live", "seq").repartition(partitions(spark), "id")
    live = own.groupBy("id", "token", "word").agg(F.max_by("live", "seq").alias("live")).where("live")
    held = cut(live.groupBy("id").agg(F.collect_set("token").alias("tokens")), "held")
    length = cut(held.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("length")), "lengths")
    sized = classes.select("class", "wanted", F.explode("wanted").alias("token")).join(length, "token", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    rarest = sized.groupBy("class").agg(F.first("wanted").alias("wanted"), F.min_by("token", F.struct("length", "token")).alias("rarest"), F.min("length").alias("length")).where("length > 0")
    total = length.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    texts = held.select("id", "tokens", F.explode("tokens").alias("rarest"))
    whole = F.forall("wanted", lambda t: F.array_contains("tokens", t))
    return members, cut(counted_join(texts, rarest, ["rarest"], "length", total).where(whole).select("class", "id"), "matches")


def expanded(members: DataFrame, matched: DataFrame) -> DataFrame:
    """Every query of ``members`` (``query, class`` and more) with every id of its class in ``matched`` (``class, id`` and more).

    A class is dealt as blocks of about ``IDS`` ids by ``ASKERS`` queries; an id goes
    once to each block of queries and a query once to each block of ids, so the pairs
    are made where they are wanted, many tasks to a class, and are never shuffled.
    """
    per = members.groupBy("class").agg(F.count("*").alias("askers")).join(matched.groupBy("class").agg(F.count("*").alias("ids")), "class")
    per = cut(per, "classes")
    askers, ids = per.agg(F.coalesce(F.sum("askers"), F.lit(0)), F.coalesce(F.sum("ids"), F.lit(0))).first()
    rows, columns = F.ceil(F.col("ids") / IDS), F.ceil(F.col("askers") / ASKERS)
    block = lambda c, n: F.pmod(F.xxhash64(c), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = counted_join(matched, per, ["class"], "ids", ids).withColumns({"at_row": block("id", rows), "at_column": each(columns)}).drop("ids", "askers")
    right = counted_join(members, per, ["class"], "askers", askers).withColumns({"at_column": block("query", columns), "at_row": each(rows)}).drop("ids", "askers")
    return left.join(right.hint("merge"), ["class", "at_row", "at_column"]).select("query", "id", *[c for c in members.columns + matched.columns if c not in ("query", "id", "class")])
