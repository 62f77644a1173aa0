"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lower-cased, so case
and punctuation do not matter.  A document is compared with a benchmark item
only if they share a seed of ``SEED`` tokens (or all tokens of a shorter item).
Around the shared seeds, greedy string tiling marks the longest common runs that
do not overlap, again and again, down to the seed's length; runs are found by
running Karp-Rabin: rolling hashes of the current search length over unmarked
tokens, hits verified token by token and extended.  Tiles may come in any order,
so reordered passages are caught.  The share of the item's tokens under tiles is
its coverage; a document with a coverage of at least ``COVERAGE`` is a leak.

The benchmark is the stated query set: it is cut into blocks of at most
``BLOCK_BYTES`` of text, and every document meets every block.  ``BLOCKS`` blocks
are broadcast at a time, a proven bound, and their index is built once in a
worker; a larger benchmark takes several passes, each of which writes the results
so far to the shared folder.  Nothing is shuffled.  Tiling looks only at the
stretches of a document within an item's length of a seed, so its work follows
the number of hits, not the length of the document.

A seed that many items share makes a document meet all of them; most of these
need no tiling: tiles cover only tokens under shared seeds, so the tokens of the
item under its shared seeds bound its coverage.  Items are tried by that bound,
the largest first, and one whose bound is below both the threshold and the best
coverage so far is settled.

Defined cases: null, empty and tokenless texts and items match nothing; null
item ids are ignored; repeated items count once; of equal coverages the smallest
item id is reported as the best, and ``items`` holds all at or above the
threshold; every row is judged by its own text, so repeated ids keep their rows;
documents and items of any length are compared whole.  Empty tables: no document
gives no row, no item leaves every document clean.  Only id and text are read of
both tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from acervo.llm.bpe import batches_of
from acervo.llm.common import bounded_batches, cut, numbered_columns
from acervo.llm.textkit import LOWER, blocks, mix, ngrams, ranges, shingles, span_hash, text_buffer, words

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES, BLOCKS = 8 << 20, 4

_TOKEN = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        _TOKEN[_b] = 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with everything but tokens blanked, and offsets."""
    buf, offsets = text_buffer(texts)
    return _TOKEN[buf], offsets


class Seeds:
    """Items of one benchmark block: token hashes by item, and a sorted index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        buf, offsets = tokens(pa.array(texts, pa.large_string()))
        starts, ends, first = words(buf, offsets)
        hashes = span_hash(buf, starts, ends)
        self.items = [hashes[a:b] for a, b in zip(first, first[1:], strict=False)]
        grams, bounds = shingles(buf, offsets, SEED)
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner = grams[order], owner[order]
        self.spot = (np.arange(len(grams)) - np.repeat(bounds[:-1], np.diff(bounds)))[order]  # first token of the seed in its item
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(grams >> np.uint64(44)).astype(np.int64)] = True
        self.short = sorted({len(x) for x in self.items if 0 < len(x) < SEED})
        self.short_of: dict[tuple, list[int]] = {}
        for i, x in enumerate(self.items):
            if 0 < len(x) < SEED:
                self.short_of.setdefault(tuple(x.tolist()), []).append(i)

    def hits(self, grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, place, spot)`` of all shared seeds: where they stand in the block's tokens and in the item's."""
        some = np.flatnonzero(self.sieve[(grams >> np.uint64(44)).astype(np.int64)])
        g, place = grams[some], at[some]
        lo, hi = np.searchsorted(self.grams, g, "left"), np.searchsorted(self.grams, g, "right")
        found = ranges(lo, hi - lo)
        return self.owner[found], np.repeat(place, hi - lo), self.spot[found]

    def short_hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(item, place)`` of whole items of fewer than ``SEED`` tokens."""
        for size in self.short:
            known = np.unique(np.array([k[0] for k in self.short_of if len(k) == size], np.uint64))
            doc_end = np.repeat(first[1:], np.diff(first))
            for p in np.flatnonzero(np.isin(hashes, known) & (np.arange(len(hashes)) + size <= doc_end)).tolist():
                for i in self.short_of.get(tuple(hashes[p : p + size].tolist()), ()):
                    yield i, p


_POWER = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def rolling(x: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``s`` tokens (mod 2**64), by running sums."""
    n = len(x)
    if n < s:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _POWER))), dtype=np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(x) * up[:n], dtype=np.uint64)))
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - s, _BACK))), dtype=np.uint64)
    return (total[s:] - total[:-s]) * down


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of token arrays: tiles ``(start in item, start in doc, length)``, none overlapping."""
    free_a, free_b = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    s = min(len(item), len(doc))
    if s < least:
        return tiles
    s = max(least, s // 2)
    while True:
        found = _matches(item, doc, free_a, free_b, s)
        longest = max((m[2] for m in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        queue = [(-n, a, b) for a, b, n in found]
        heapify(queue)
        while queue:  # the longest first; of one that is partly covered, the open runs wait their turn
            n, a, b = heappop(queue)
            taken = np.flatnonzero(~(free_a[a : a - n] & free_b[b : b - n]))
            if not len(taken):
                free_a[a : a - n] = free_b[b : b - n] = False
                tiles.append((a, b, -n))
                continue
            ends = np.concatenate(([-1], taken, [-n]))
            for k in np.flatnonzero(np.diff(ends) > s).tolist():
                at = int(ends[k]) + 1
                heappush(queue, (at - int(ends[k + 1]), a + at, b + at))
        if s == least:
            return tiles
        s = max(least, s // 2)


def _matches(item: np.ndarray, doc: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``s`` unmarked tokens."""
    ha, hb = rolling(item, s), rolling(doc, s)
    clear = lambda free: np.convolve(free, np.ones(s, int), "valid") == s
    pa_, pb = np.flatnonzero(clear(free_a)), np.flatnonzero(clear(free_b))
    table: dict[int, list[int]] = {}
    for i in pa_.tolist():
        table.setdefault(int(ha[i]), []).append(i)
    out = []
    for j in pb[np.isin(hb[pb], ha[pa_])].tolist():
        for i in table.get(int(hb[j]), ()):
            if i and j and free_a[i - 1] and free_b[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # the run began earlier
            n = _run(item, doc, free_a, free_b, i, j)
            if n >= s:
                out.append((i, j, n))
    return out


def _run(item: np.ndarray, doc: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, i: int, j: int) -> int:
    """Length of the common unmarked run that starts at ``i`` and ``j``."""
    n, most, step = 0, min(len(item) - i, len(doc) - j), 64
    while n < most:
        a, b = slice(i + n, min(i + n + step, i + most)), slice(j + n, min(j + n + step, j + most))
        ends = np.flatnonzero((item[a] != doc[b]) | ~free_a[a] | ~free_b[b])
        if len(ends):
            return n + int(ends[0])
        n, step = a.stop - i, step * 4
    return n


def coverage(item: np.ndarray, doc: np.ndarray, places: np.ndarray) -> float:
    """Share of the item's tokens under tiles, looking within its length of the seeds at ``places``."""
    n, reach = len(item), len(item)
    pieces, at = [], -1
    for p in np.unique(places).tolist():
        lo, hi = max(at, p - reach, 0), min(len(doc), p + reach + SEED)
        if hi <= at:
            continue
        if lo > at:
            pieces.append(np.array([len(pieces)], np.uint64))  # a token no item has: stretches do not join
        pieces.append(doc[lo:hi])
        at = hi
    return sum(t[2] for t in tile(item, np.concatenate(pieces), min(SEED, n))) / n if pieces else 0.0


_ITEMS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))
RESULT = "struct<item_id: bigint, coverage: double, items: array<struct<item_id: bigint, coverage: double>>>"


class Verdict:
    """What is known of a document: its best item and all at or above the threshold."""

    def __init__(self, item: int | None = None, share: float = 0.0, held: list[dict] | None = None):
        self.item, self.share, self.held = item, share, {h["item_id"]: h["coverage"] for h in held or ()}

    def settled(self, item: int, bound: float, least: float) -> bool:
        """Whether an item whose coverage is at most ``bound`` cannot change this."""
        return bound < least and (bound < self.share or bound == self.share and self.item is not None and self.item <= item)

    def add(self, item: int, share: float, least: float) -> None:
        if share > self.share or share == self.share and share > 0 and item < self.item:
            self.item, self.share = item, share
        if share > 0 and share >= least:
            self.held[item] = max(share, self.held.get(item, 0.0))

    def items(self) -> list[dict]:
        return [{"item_id": i, "coverage": c} for i, c in sorted(self.held.items(), key=lambda x: (-x[1], x[0]))]


def judge(texts: pa.Array, verdicts: list[Verdict], seeds: list[Seeds], least: float) -> None:
    """Bring the verdicts of texts up to date with the items of ``seeds``."""
    buf, offsets = tokens(texts)
    for lo, hi in blocks(offsets):
        for own in seeds:
            _block(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], verdicts[lo:hi], own, least)


def _block(buf: np.ndarray, offsets: np.ndarray, verdicts: list[Verdict], seeds: Seeds, least: float) -> None:
    starts, ends, first = words(buf, offsets)
    hashes = span_hash(buf, starts, ends)
    item, place, spot = seeds.hits(*ngrams(hashes, first, SEED))
    if seeds.short and len(hashes):
        extra = list(seeds.short_hits(hashes, first))
        item = np.concatenate((item, np.array([i for i, _ in extra], np.int64)))
        place = np.concatenate((place, np.array([p for _, p in extra], np.int64)))
        spot = np.concatenate((spot, np.zeros(len(extra), np.int64)))
    if not len(item):
        return
    doc = np.searchsorted(first, place, side="right") - 1
    order = np.lexsort((spot, item, doc))
    doc, item, place, spot = doc[order], item[order], place[order], spot[order]
    new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0)))
    cuts = np.append(np.flatnonzero(new), len(doc))
    size = np.array([len(x) for x in seeds.items], np.int64)[item]
    # tokens of the item under its shared seeds: each seed adds what lies behind the one before it
    reach = np.minimum(spot + SEED, size)
    before = np.where(new, 0, np.concatenate(([0], reach[:-1])))
    under = np.add.reduceat(reach - np.maximum(spot, before), cuts[:-1])
    bound = under / size[cuts[:-1]]
    for k in np.lexsort((item[cuts[:-1]], -bound, doc[cuts[:-1]])).tolist():
        a, b = cuts[k], cuts[k + 1]
        d, i = int(doc[a]), int(item[a])
        if not verdicts[d].settled(seeds.ids[i], float(bound[k]), least):
            verdicts[d].add(seeds.ids[i], coverage(seeds.items[i], hashes[first[d] : first[d + 1]], place[a:b] - first[d]), least)


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of at most ``most`` bytes of text (one item at least), one at a time on the driver."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        own = len(r.t.encode())
        if ids and size + own > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += own
    if ids:
        yield ids, texts


def _pass(docs: DataFrame, text: str, shared: list, least: float, column: str, keep: list[str]) -> DataFrame:
    """``docs`` with ``column``, the verdict on ``text`` so far; of the other columns only ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [Seeds(*b.value) for b in shared]
        for whole in batches:
            for batch in batches_of(whole, text):
                known = batch.column(column).to_pylist() if column in batch.schema.names else [None] * batch.num_rows
                verdicts = [Verdict(*(v["item_id"], v["coverage"], v["items"])) if v else Verdict() for v in known]
                judge(batch.column(text), verdicts, seeds, least)
                found = pa.StructArray.from_arrays([pa.array([v.item for v in verdicts], pa.int64()), pa.array([v.share for v in verdicts], pa.float64()), pa.array([v.items() for v in verdicts], _ITEMS)], ["item_id", "coverage", "items"])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], [*keep, column])

    return docs.mapInArrow(run, StructType([*[docs.schema[c] for c in keep], StructField(column, _parse_datatype_string(RESULT))]))


def judged(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, least: float, column: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` and ``column``, a struct of item_id, coverage and items, for every row."""
    context, queue = bounded_batches(docs.sparkSession).sparkContext, benchmark_blocks(benchmark, item_id, item_text)
    columns = list(dict.fromkeys([*keep, text]))
    at, held, more = docs.select(*[F.col(f"`{c}`") for c in columns]), list(islice(queue, BLOCKS)), True
    while more:
        shared = [context.broadcast(b) for b in held]
        held = list(islice(queue, BLOCKS))
        more = bool(held)
        at = _pass(at, text, shared, least, column, columns if more else keep)
        if more:
            at = cut(at, "benchmark")
            for b in shared:
                b.unpersist()
    return at


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, coverage, leaked, items`` for every row: the item covered most (null if none shares a seed).

    ``items`` lists every item covered by ``least`` or more, the best first.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    v = F.col("verdict")
    return judged(plain, benchmark, "text", item_id, item_text, least, "verdict", ["doc_id"]).select("doc_id", v["item_id"].alias("item_id"), v["coverage"].alias("coverage"), (v["coverage"] >= least).alias("leaked"), v["items"].alias("items"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not leaks."""
    plain, column = numbered_columns(docs, text)
    found = judged(plain, benchmark, column, item_id, item_text, least, "verdict", plain.columns)
    return found.where(~(F.col("verdict")["coverage"] >= least)).drop("verdict").toDF(*docs.columns)
