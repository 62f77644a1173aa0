"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set holds the distinct 5-word shingles of its lower-cased words; a
document of one to four words has its whole word sequence as the only shingle.

1. *Signature*: ``SLOTS`` minimum hashes, each cut to ``BITS`` bits.  Documents
   with equal sets form one class (grouped by 128 bits of the set and its size),
   so exact copies are never paired with each other.
2. *Multi-index*: the signature is split into ``CHUNKS`` chunks of ``WIDTH``
   slots.  If two signatures differ in at most ``CHUNKS * (ERRORS + 1) - 1``
   slots, some chunk differs in at most ``ERRORS`` slots (pigeonhole), so all
   choices of ``ERRORS`` slots to ignore are enumerated for each chunk and the
   remaining slots become a key.  Every pair of signatures within that distance
   shares a key: with the figures below, any pair that differs in at most 17 of
   36 slots.  A pair at similarity 0.75 exactly differs in 9 on average and
   shares no key with probability 6e-6; a more similar one less.
3. *Clusters*: the smallest class of a key is its hub.  Members of a key meet at
   its hub, which bounds rows by (class, key) pairs; all pairs of one key meet
   at one hub.  A hub of more than ``BLOCK`` members or ``BLOCK_SHINGLES``
   shingles is cut into blocks: first every block meets the hub itself, so each
   text travels once, whatever the size of the cluster; only members that are not
   linked to their hub then meet the blocks of all its members, in different
   tasks (members linked to the hub are already in one component).  Texts are
   fetched by a broadcast of the memberships while those are at most
   ``BROADCAST_ROWS`` (counted), else by a shuffled join.
4. *Confirmation*: in each block the full sets are intersected through an
   inverted index of shingles, exactly ``100 * intersection >= 75 * union``.
   Only a spanning forest of the confirmed links leaves the task.
5. Components of the links give each document its smallest reachable id.

Shingles are compared by 64-bit hashes of their words.

Defined cases: null, empty and wordless texts have the empty set and link with
nothing; a null id is returned with a null component and is not kept; rows that
repeat an id are one node of the graph with the links of all their texts, each
row returned with its own set size; only id and text are read, so other columns
cannot clash; an empty table gives an empty result.  Ids are integers (others
fail in the cast).  A text of any length is one member: a block holds at least one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.bpe import batches_of
from acervo.llm.common import bounded_batches, connected_components, cut, partitions, sized_broadcast
from acervo.llm.textkit import LOWER, blocks, mix, ranges, shingles, text_buffer

SHINGLE = 5
CHUNKS, WIDTH, ERRORS, BITS = 9, 4, 1, 16
SLOTS = CHUNKS * WIDTH
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
BROADCAST_ROWS = 500_000
PERCENT = 75

_rng = np.random.Generator(np.random.PCG64(977))
_SCALE = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_KEEP = [np.array(k) for k in combinations(range(WIDTH), WIDTH - ERRORS)]
_SALT = mix(np.arange(1, CHUNKS * len(_KEEP) + 1, dtype=np.uint64)).reshape(CHUNKS, len(_KEEP))


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = text_buffer(texts)
    return LOWER[buf], offsets


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``n x SLOTS`` minimum hashes cut to ``BITS`` bits; rows of empty sets are zero."""
    n = len(bounds) - 1
    out = np.zeros((n, SLOTS), np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        low, high, at = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32), bounds[full]
        for i in range(SLOTS):
            least = np.minimum.reduceat(low * _SCALE[i] + high, at).astype(np.uint64)
            out[full, i] = (mix(least + np.uint64(i << 32)) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """``n x (CHUNKS * choices)`` keys: each chunk without each choice of ``ERRORS`` slots."""
    parts = signature.reshape(len(signature), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(signature), CHUNKS, len(_KEEP)), np.uint64)
    for k, keep in enumerate(_KEEP):
        packed = np.zeros((len(signature), CHUNKS), np.uint64)
        for slot in keep:
            packed = packed << np.uint64(BITS) | parts[:, :, slot]
        out[:, :, k] = mix(packed ^ _SALT[:, k])
    return out.reshape(len(signature), -1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in batches_of(whole, "text"):
            buf, offsets = lowered(batch.column("text"))
            n_sets, sums, sigs = [], [], []
            for lo, hi in blocks(offsets):
                grams, bounds = shingles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SHINGLE)
                sigs.append(signatures(grams, bounds))
                for a, b in zip(bounds, bounds[1:], strict=False):
                    own = np.unique(grams[a:b])
                    n_sets.append(len(own))
                    sums.append((own.sum(dtype=np.uint64), mix(own ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)))
            both = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            raw = np.concatenate(sigs) if sigs else np.zeros((0, SLOTS), np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_sets, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([r.tobytes() for r in raw], pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of classes: ``(key, member)``."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            part = batch.slice(lo, 20_000)
            raw = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
            keys = keys_of(raw)
            member = np.repeat(part.column("member").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(member)], ["key", "member"])


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of texts."""
    buf, offsets = lowered(pa.array(texts, pa.large_string()))
    out = []
    for lo, hi in blocks(offsets):
        grams, bounds = shingles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SHINGLE)
        out += [np.unique(grams[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


class Index:
    """Which of some sets hold a shingle, for intersections of one set with all of them."""

    def __init__(self, sets: list[np.ndarray], some: np.ndarray):
        self.n, self.some = len(sets), some
        own = [sets[i] for i in some.tolist()]
        flat, owner = np.concatenate(own) if own else np.zeros(0, np.uint64), np.repeat(some, [len(x) for x in own])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def common(self, own: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        return np.bincount(self.owner[ranges(lo, hi - lo)], minlength=self.n)


def forest_among(members: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``members``: a search from each that no earlier one has reached.

    Sets already reached leave the index each time they are half of it, so near
    copies of one text cost one pass and not a pass for each.
    """
    sets, sizes = [s for _, s in members], np.array([len(s) for _, s in members], np.int64)
    open_ = np.ones(len(sets), bool)
    index, left, edges = Index(sets, np.arange(len(sets))), len(sets), []
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start] = False
        left -= 1
        reached = [start]
        while reached and left:
            i = reached.pop()
            if 2 * left < len(index.some):
                index = Index(sets, np.flatnonzero(open_))
            common = index.common(sets[i])
            for j in np.flatnonzero(open_ & (100 * common >= percent * (sizes[i] + sizes - common))).tolist():
                open_[j] = False
                left -= 1
                reached.append(j)
                edges.append((members[i][0], members[j][0]))
    return edges


def forest_between(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right``."""
    sizes = np.array([len(s) for _, s in left], np.int64)
    index = Index([s for _, s in left], np.arange(len(left)))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for name, own in right:
        common = index.common(own)
        for i in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common)).tolist():
            a, b = root(name), root(left[i][0])
            if a != b:
                parent[a] = b
                edges.append((name, left[i][0]))
    return edges


ALL, HUB = 0, 1  # what a block meets: itself, or its hub; larger numbers: open members


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (hub, block, other): edges ``(null, a, b)``, and ``(hub, a, null)`` for members not linked to it."""
        now, sides = None, ([], [])

        def flush() -> pa.RecordBatch:
            left, right = (list(zip((m for m, _ in side), sets_of([t for _, t in side]), strict=True)) for side in sides)
            hubs = []
            if now[2] == ALL:
                edges = forest_among(left, percent)
            else:
                edges = forest_between(left, right, percent) if left and right else []
            if now[2] == HUB:
                hubs = sorted({m for m, _ in left} - {m for e in edges for m in e} - {now[0]})
            rows = [(None, a, b) for a, b in edges if a != b] + [(now[0], m, None) for m in hubs]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["hub", "a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hub", "block", "other", "side", "member", "text")]
            for hub, block, other, side, member, text in zip(*columns, strict=True):
                if (hub, block, other) != now:
                    if now is not None:
                        yield flush()
                    now, sides = (hub, block, other), ([], [])
                sides[side].append((member, text))
        if now is not None:
            yield flush()

    return run


def _met(tasks: DataFrame, texts: DataFrame, percent: int, label: str) -> DataFrame:
    """The confirmed links of tasks ``(hub, block, other, side, member)``."""
    n = partitions(texts.sparkSession)
    tasks = cut(tasks, "tasks")
    filled = texts.join(sized_broadcast(tasks, tasks.count(), BROADCAST_ROWS), "member").select("hub", "block", "other", "side", "member", "text")
    where = ["hub", "block", "other"]
    return cut(filled.repartition(n, *where).sortWithinPartitions(*where).mapInArrow(_confirm(percent), "hub long, a long, b long"), label)


def _blocks_of(members: DataFrame, weights: DataFrame, name: str, least: int) -> DataFrame:
    """``hub, name``: blocks of each hub's ``members (hub, member)``, for hubs of ``least`` blocks or more.

    Such hubs are few (one for ``BLOCK`` memberships at most), so the table is
    broadcast while it is counted to be small: a large hub's members stay where they are.
    """
    size = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    counted = cut(members.join(weights, "member").groupBy("hub").agg(size.alias(name)).where(F.col(name) >= least), "hubs")
    return sized_broadcast(counted, counted.count(), BROADCAST_ROWS)


def confirmed_links(members: DataFrame, classes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(a, b)``: links that join all members linked in their clusters ``(hub, member)``."""
    weights = classes.groupBy("member").agg(F.sum("n_shingles").alias("n_shingles"))  # a repeated id stands for several classes
    large = _blocks_of(members, weights, "n_blocks", 2)
    big = members.join(large, "hub").withColumn("own", F.pmod(F.xxhash64("member"), F.col("n_blocks")).cast("int"))
    whole = members.join(large, "hub", "left_anti").select("hub", F.lit(0).alias("block"), F.lit(ALL).alias("other"), F.lit(0).alias("side"), "member")
    own = big.select("hub", F.col("own").alias("block"), F.lit(HUB).alias("other"), F.lit(0).alias("side"), "member")
    hubs = large.select("hub", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(HUB).alias("other"), F.lit(1).alias("side"), F.col("hub").alias("member"))
    first = _met(whole.unionByName(own).unionByName(hubs), texts, percent, "links")

    open_ = first.where("b IS NULL").select("hub", F.col("a").alias("member"))
    if open_.isEmpty():
        return first.select("a", "b")
    counted = _blocks_of(open_, weights, "n_open", 1)
    left = big.join(counted, "hub").select("hub", F.col("own").alias("block"), F.explode(F.sequence(F.lit(2), F.col("n_open") + 1)).alias("other"), F.lit(0).alias("side"), "member")
    spread = open_.join(counted, "hub").join(large, "hub")
    right = spread.select("hub", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), (F.pmod(F.xxhash64(F.lit("open"), "member"), F.col("n_open")) + 2).cast("int").alias("other"), F.lit(1).alias("side"), "member")
    second = _met(left.unionByName(right), texts, percent, "more-links")
    return first.where("b IS NOT NULL").select("a", "b").unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = cut(rows.mapInArrow(_sketch, "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "sketch")
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("member"), F.min("sig").alias("sig")), "classes")

    keys = classes.select("member", "sig").mapInArrow(_spread, "key long, member long")
    hubs = keys.groupBy("key").agg(F.min("member").alias("hub"), F.max("member").alias("top")).where("hub < top").select("key", "hub")
    members = cut(keys.join(hubs, "key").select("hub", "member").distinct(), "members")
    texts = rows.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "member")
    parts = connected_components(confirmed_links(members, classes, texts, percent))

    rep = classes.select("n_shingles", "h1", "h2", F.col("member").alias("node"))
    where = ["n_shingles", "h1", "h2"]
    found = sketch.select("doc_id", *where).join(rep, where, "left").join(parts, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
