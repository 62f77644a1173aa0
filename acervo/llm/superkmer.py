"""Substring dedup by super-k-mer partitioning over words.

A window is ``WINDOW`` consecutive words of one document.  Every word covered by
a window whose word sequence also starts earlier (smaller id, or same document
and earlier start) is removed; windows are judged on the input.

1. Every ``SEED`` consecutive words have a hash; the smallest hash in a window is
   its minimiser.  Consecutive windows with one minimiser travel together, as
   one packed string of their words, to the minimiser's bucket.
2. Seeds that are very frequent would draw many windows to one bucket.  A first
   pass counts minimisers: each task keeps a summary of ``4 * HOT`` counters
   (Misra-Gries: no count is short by more than a ``4 * HOT``-th of the task's
   super-k-mers), and summaries are added up.  All minimisers with more than
   ``1 / HOT`` of all super-k-mers, and at most ``2 * HOT``, so that they fit a
   broadcast, are ordered after all other seeds, in all later tasks alike.  A
   window all of whose seeds are frequent lies inside one frequent passage.
3. Within a block of whole documents only the first occurrence of each window is
   sent on; the block's other occurrences are repeats whatever else exists.  So a
   passage in any number of documents reaches its bucket once for each block.
4. A bucket unpacks its strings, numbers their words exactly (dictionary), sorts
   windows by hash, then id and start, and compares the words of windows of equal
   hash one by one before it calls them equal.  All but the first are repeats.
5. Repeats return as ranges of words and meet the texts by id.

Buckets are many times the partitions, and so many that one holds ``BUCKET_WINDOWS``
windows on average whatever the size of the input; one bucket at a time is unpacked.

Defined cases: null, empty and wordless texts have no words; rows that repeat an
id have no order between them, so their texts, sorted and made distinct, count
as one document after another under that id and each row returns the result of
its own text; a null id comes before all others.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.llm.bpe import batches_of
from acervo.llm.common import bounded_batches, cut, partitions
from acervo.llm.features import Words
from acervo.llm.textkit import mix, ngrams, ranges, span_hash

WINDOW = 20
SEED = 4
HOT = 1 << 16
LEAST_HOT = 64  # super-k-mers that no small table calls frequent
LATE = np.uint64(1) << np.uint64(63)
BLOCK_BYTES = 3 << 20
BUCKETS_A_PARTITION, BUCKET_WINDOWS = 8, 1 << 18


def word_hashes(w: Words) -> np.ndarray:
    """Content hashes of all words of a batch, in order."""
    if not len(w.size):
        return np.zeros(0, np.uint64)
    out = np.empty(len(w.size), np.uint64)
    at, n = 0, len(w.size)
    while at < n:
        to = max(at + 1, int(np.searchsorted(w.at, w.at[at] + (1 << 20), side="right")) - 1)
        base = w.at[at]
        out[at:to] = span_hash(w.buf[base : w.at[to]], w.at[at:to] - base, w.at[at + 1 : to + 1] - base)
        at = to
    return out[w.index]


def minimisers(hashes: np.ndarray, bounds: np.ndarray, hot: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, their minimisers and their own hashes."""
    grams, at = ngrams(hashes, bounds, window)
    if not len(at):
        return at, grams, grams
    seeds, place = ngrams(hashes, bounds, seed)
    rank = seeds >> np.uint64(1)
    if len(hot):
        found = np.minimum(np.searchsorted(hot, rank), len(hot) - 1)
        rank = np.where(hot[found] == rank, rank | LATE, rank)
    dense = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
    dense[place] = rank
    wide, have = dense, 1
    need = window - seed + 1
    while have < need:  # running minimum over `need` seeds by doubling
        step = min(have, need - have)
        wide = np.minimum(wide[: len(wide) - step], wide[step:])
        have += step
    return at, wide[at], grams


def runs_of(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds ``[a, b)`` in ``at`` of consecutive windows with one key."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero((np.diff(at) != 1) | (key[1:] != key[:-1])) + 1
    a = np.concatenate(([0], new))
    return a, np.append(new, len(at))


def same_windows(words: np.ndarray, a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether windows starting at words ``a`` and ``b`` hold the same words (exact numbers of words)."""
    same = np.ones(len(a), bool)
    for j in range(window):
        same &= words[a + j] == words[b + j]
    return same


def repeats(words: np.ndarray, at: np.ndarray, grams: np.ndarray, order_a: np.ndarray, order_b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For windows (first word, hash, two ordering numbers): True where an equal window comes before."""
    n = len(at)
    again = np.zeros(n, bool)
    if n < 2:
        return again
    order = np.lexsort((order_b, order_a, grams))
    sorted_grams = grams[order]
    new = np.concatenate(([True], sorted_grams[1:] != sorted_grams[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    follow = np.flatnonzero(~new)
    same = same_windows(words, at[order[follow]], at[order[head[follow]]], window)
    again[order[follow[same]]] = True
    for g in np.unique(sorted_grams[follow[~same]]).tolist():  # two sequences with one hash: compare them as they are
        seen = set()
        for i in order[sorted_grams == np.uint64(g)].tolist():
            own = words[at[i] : at[i] + window].tobytes()
            again[i] = own in seen
            seen.add(own)
    return again


def _pack(columns: list[np.ndarray], text: bytes) -> bytes:
    data = b"".join(c.astype("<i8").tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(len(columns[0]).to_bytes(8, "little") + data + text)


def _unpack(blob: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return [np.frombuffer(raw, "<i8", n, 8 + 8 * n * c) for c in range(columns)], raw[8 + 8 * n * columns :]


def merge_ranges(starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Ascending window starts of one document -> disjoint word ranges."""
    gap = np.flatnonzero(np.diff(starts) > window) + 1
    return starts[np.concatenate(([0], gap))], starts[np.append(gap, len(starts)) - 1] + window


def _found(doc: np.ndarray, start: np.ndarray, window: int) -> tuple[list[int], list[bytes]]:
    """Repeated windows ``(document, start)`` -> one packed list of word ranges for each document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    ids, out = [], []
    for a, b in zip(np.concatenate(([0], cuts)), np.append(cuts, len(doc)), strict=True) if len(doc) else ():
        lo, hi = merge_ranges(start[a:b], window)
        ids.append(int(doc[a]))
        out.append(np.stack([lo, hi]).astype("<i8").tobytes())
    return ids, out


class Summary:
    """Counts of the most frequent numbers of a stream, in bounded memory."""

    def __init__(self, most: int):
        self.most, self.value, self.count, self.total = most, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, keys: np.ndarray) -> None:
        self.total += len(keys)
        value, times = np.unique(keys, return_counts=True)
        every, where = np.unique(np.concatenate((self.value, value)), return_inverse=True)
        count = np.bincount(where, np.concatenate((self.count, times)), len(every)).astype(np.int64)
        if len(every) > self.most:
            count -= np.partition(count, len(count) - self.most - 1)[len(count) - self.most - 1]
            every, count = every[count > 0], count[count > 0]
        self.value, self.count = every, count


def _hot_counter(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent minimisers of a task's super-k-mers with their number; null: all super-k-mers, and all windows."""
        seen, windows = Summary(4 * HOT), 0
        for whole in batches:
            for batch in batches_of(whole, "text", BLOCK_BYTES):
                w = Words(batch.column("text"))
                at, key, _ = minimisers(word_hashes(w), w.bounds, np.zeros(0, np.uint64), window, seed)
                a, _b = runs_of(at, key)
                seen.add(key[a])
                windows += len(at)
        often = seen.count > max(1, seen.total // (4 * HOT))
        value, times = seen.value[often], seen.count[often]
        yield pa.RecordBatch.from_arrays([pa.array([None, *value.view(np.int64).tolist()], pa.int64()), pa.array([seen.total, *times.tolist()], pa.int64()), pa.array([windows, *[0] * len(value)], pa.int64())], ["key", "n", "windows"])

    return run


def frequent_seeds(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, int]:
    """Minimisers with more than a ``HOT``-th of all super-k-mers (and some with more than half of that), ascending; and the number of windows."""
    counted = docs.mapInArrow(_hot_counter(window, seed), "key long, n long, windows long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))
    counted = cut(counted, "seeds")
    total, windows = (x or 0 for x in counted.where("key IS NULL").agg(F.sum("n"), F.sum("windows")).first())
    rows = counted.where("key IS NOT NULL").where(F.col("n") > max(LEAST_HOT, total // (2 * HOT))).collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64)), windows


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of ``n`` partitions that Spark's hash deals to it: buckets in turn then fill them alike."""
    found = spark.range(30 * n + 100).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    keys = np.arange(n, dtype=np.int64)
    for r in found:
        keys[r.p] = r.id
    return keys


def _send(hot: np.ndarray, buckets: int, window: int, seed: int, deal: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``(task, bucket, doc, data)``: packed super-k-mers (doc null) and ranges already known to repeat."""
        for whole in batches:
            for batch in batches_of(whole, "text", BLOCK_BYTES):
                ids = batch.column("ord").to_numpy(zero_copy_only=False).astype(np.int64)
                w = Words(batch.column("text"))
                at, key, grams = minimisers(word_hashes(w), w.bounds, hot, window, seed)
                if not len(at):
                    continue
                row = w.docs()[at]
                doc, start = ids[row], at - w.bounds[row]
                again = repeats(w.index, at, grams, doc, start, window)
                known, ranges_of = _found(doc[again], start[again], window)
                keep = np.flatnonzero(~again)
                at, key, doc, start = at[keep], key[keep], doc[keep], start[keep]
                a, b = runs_of(at, key)
                bucket = (mix(key[a]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                a, b, bucket = a[order], b[order], bucket[order]
                n_words = b - a + window - 1
                words = w.distinct.take(pa.array(w.index[ranges(at[a], n_words)]))
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                first = np.concatenate(([0], cuts)) if len(a) else np.zeros(0, np.int64)
                ends = np.concatenate(([0], np.cumsum(n_words)))
                per_bucket = pa.LargeListArray.from_arrays(pa.array(ends[np.append(first, len(a))]), words.cast(pa.large_string()))
                texts = pc.binary_join(per_bucket, pa.scalar(" ", pa.large_string()))
                blobs = [_pack([doc[a[i:j]], start[a[i:j]], n_words[i:j]], t.encode()) for i, j, t in zip(first.tolist(), np.append(first[1:], len(a)).tolist(), texts.to_pylist(), strict=True)]
                spots = np.array([*bucket[first].tolist(), *[int(k) % buckets for k in known]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(deal[spots % len(deal)]), pa.array(spots), pa.array([*[None] * len(blobs), *known], pa.int64()), pa.array([*blobs, *ranges_of], pa.binary())], ["task", "bucket", "doc", "data"])

    return run


def _judge(window: int):
    def bucket_repeats(blobs: list[bytes]) -> tuple[list[int], list[bytes]]:
        parts = [_unpack(b, 3) for b in blobs]
        doc, start, n_words = (np.concatenate([p[0][c] for p in parts]) for c in range(3))
        flat = pc.ascii_split_whitespace(pa.array([p[1].decode() for p in parts], pa.large_string())).flatten()
        coded = flat.dictionary_encode()
        numbers = coded.indices.to_numpy()
        base = np.concatenate(([0], np.cumsum(n_words)))
        hashes = mix(np.arange(1, len(coded.dictionary) + 1, dtype=np.uint64))[numbers]
        grams, at = ngrams(hashes, base, window)
        run = np.searchsorted(base, at, side="right") - 1
        own_doc, own_start = doc[run], start[run] + (at - base[run])
        again = repeats(numbers, at, grams, own_doc, own_start, window)
        return _found(own_doc[again], own_start[again], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket; ranges that are known pass through."""
        now, blobs = None, []
        for batch in batches:
            ids, data = [], []
            for bucket, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc", "data")), strict=True):
                if doc is not None:
                    ids.append(doc)
                    data.append(raw)
                    continue
                if bucket != now:
                    if blobs:
                        more = bucket_repeats(blobs)
                        ids += more[0]
                        data += more[1]
                    now, blobs = bucket, []
                blobs.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["doc", "data"])
        if blobs:
            ids, data = bucket_repeats(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["doc", "data"])

    return run


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", BLOCK_BYTES):
                w = Words(batch.column("text"))
                gone = np.zeros(len(w.index) + 1, np.int32)
                for i, packed in enumerate(batch.column("ranges").to_pylist()):
                    for raw in packed or ():
                        lo, hi = np.frombuffer(raw, "<i8").reshape(2, -1) + w.bounds[i]
                        np.add.at(gone, lo, 1)
                        np.add.at(gone, hi, -1)
                kept = np.cumsum(gone[:-1]) == 0
                bounds = np.concatenate(([0], np.cumsum(kept)))[w.bounds]
                words = w.distinct.cast(pa.large_string()).take(pa.array(w.index[kept]))
                text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), words), pa.scalar(" ", pa.large_string()))
                digest = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text.to_pylist()], pa.string())
                columns = [batch.column("doc_id"), pa.array(w.count), pa.array(w.count - np.diff(bounds)), digest]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, text.cast(pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text`` if wanted) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    plain = rows.where("doc_id IS NOT NULL AND doc_id > -9223372036854775808").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    unique = plain.n == plain.d and plain.n == rows.count()
    if unique:  # the id itself orders the documents
        texts = rows.select("doc_id", F.col("doc_id").alias("ord"), "text")
        source = texts.select("ord", "text")
    else:  # null and repeated ids: number the distinct (id, text) rows in order
        texts, source = number_rows(rows)
    n = partitions(bounded_batches(docs.sparkSession))
    frequent, windows = frequent_seeds(source, window, seed)
    hot = docs.sparkSession.sparkContext.broadcast(frequent)
    buckets = max(n * BUCKETS_A_PARTITION, windows // BUCKET_WINDOWS)
    deal = even_keys(docs.sparkSession, n)
    sent = source.mapInArrow(_send(hot.value, buckets, window, seed, deal), "task long, bucket long, doc long, data binary")
    judged = sent.repartition(n, "task").sortWithinPartitions("bucket").mapInArrow(_judge(window), "doc long, data binary")
    marked = judged.groupBy("doc").agg(F.collect_list("data").alias("ranges"))
    met = texts.join(marked, texts["ord"] == marked["doc"], "left").select("doc_id", "text", "ranges")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return met.select(F.col("doc_id").cast(kind), "text", "ranges").mapInArrow(_remove(with_text), schema)


def number_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, ord, text`` with ``ord`` the place in order of id (null first) and text; equal rows share it.

    Beside it ``ord, text`` with one row for each ``ord``: equal rows are one document.
    """
    distinct = rows.select("doc_id", "text").distinct()
    n = partitions(rows.sparkSession)
    dealt = cut(distinct.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()), "numbered")
    size = dealt.groupBy("part").agg(F.count("*").alias("size")).withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))
    numbered = dealt.withColumn("at", inner).join(F.broadcast(size.select("part", "before")), "part").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), (F.col("before") + F.col("at")).alias("ord"))
    texts = rows.join(numbered, rows["doc_id"].eqNullSafe(F.col("_id")) & rows["text"].eqNullSafe(F.col("_text"))).select("doc_id", "ord", "text")
    return texts, numbered.select("ord", F.col("_text").alias("text"))
