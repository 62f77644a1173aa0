"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The most frequent pre-tokens of the corpus (counted over all documents) are
compiled, in sorted order, into the minimal acyclic automaton of the word list:
equal suffixes share states.  Every arc carries a count, and the counts along a
word add up to the word's number, which addresses its token ids - the output of
the transducer.  States are laid out as a double array in one flat file that
Spark ships to each machine once and every worker memory-maps.  A batch's distinct pieces walk the automaton together
(one numpy step per byte position).  Pieces outside the lexicon are merged
exactly, all at once, by merge rank; so the lexicon's size changes speed only,
never a result.

Decoding joins the tokens of the ids by one space, which is what a tokenizer
file without a decoder does.

Defined cases: a null text counts as empty and gives no ids, the empty id string
and the empty decoded text; every row is encoded on its own, whatever its id;
other columns are not touched (:func:`bpe_encode` returns only the columns it
names); texts of any length are encoded whole.  An empty table gives an empty
result.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.bpe import SUFFIX, Pretokenizer, WordEncoder, batches_of
from acervo.llm.common import bounded_batches, cut, strongest
from acervo.llm.textkit import ranges

LEXICON_WORDS = 1 << 17
BLOCK_BYTES = 4 << 20  # of text that is encoded at a time
LONG = 96  # pieces of more bytes are merged one by one with a heap
NONE = np.int64(1) << 40
_SHIPPED: dict[str, set[str]] = {}


class Merges:
    """The merge table of a BPE file, and exact merging of pieces."""

    def __init__(self, spec: dict, letters: str):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        keys = a << 32 | b
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + SUFFIX] for c in letters], np.int64)
        self._map: dict | None = None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def merge(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and bounds of pieces given as byte spans."""
        n = len(starts)
        counts = np.zeros(n, np.int64)
        order = np.argsort(sizes, kind="stable")
        got: list[tuple[np.ndarray, np.ndarray]] = []
        at = int(np.searchsorted(sizes[order], 1))
        while at < n:
            size = int(sizes[order[at]])
            if size > LONG:
                for i in order[at:]:
                    ids = self._one(buf[starts[i] : starts[i] + sizes[i]])
                    counts[i] = len(ids)
                    got.append((np.array([i]), ids[None, :]))
                break
            to = min(int(np.searchsorted(sizes[order], size, side="right")), at + (1 << 21) // size + 1)
            rows = order[at:to]
            symbols, lengths = self._many(buf[starts[rows][:, None] + np.arange(size)])
            counts[rows] = lengths
            got.append((rows, symbols))
            at = to
        bounds = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(int(bounds[-1]), np.uint32)
        for rows, symbols in got:
            long = counts[rows]
            out[ranges(bounds[rows], long)] = symbols[np.arange(symbols.shape[1]) < long[:, None]]
        return out, bounds

    def _many(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equal length: merge the leftmost pair of lowest rank in every row until none is left."""
        n, size = raw.shape
        symbols = self.inner[raw]
        symbols[:, -1] = self.final[raw[:, -1]]
        lengths = np.full(n, size, np.int64)
        if size == 1:
            return symbols, lengths
        rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
        out, live = symbols.copy(), np.arange(n)
        while len(live):
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(live)), at]
            on = low < NONE
            if not on.all():
                out[live[~on], : symbols.shape[1]] = symbols[~on]
                live, symbols, rank, at, low = live[on], symbols[on], rank[on], at[on], low[on]
                if not len(live):
                    break
            me = np.arange(len(live))
            symbols[me, at] = self.made[low]
            width = symbols.shape[1]
            column = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, column + (column > at[:, None]), axis=1)  # the right half goes
            lengths[live] -= 1
            if width == 2:
                out[live, :1] = symbols
                break
            column = np.arange(width - 2)
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), axis=1)
            left = at > 0
            rank[me[left], at[left] - 1] = self.ranks(symbols[me[left], at[left] - 1], symbols[me[left], at[left]])
            right = at < width - 2
            rank[me[right], at[right]] = self.ranks(symbols[me[right], at[right]], symbols[me[right], at[right] + 1])
        return out, lengths

    def _one(self, raw: np.ndarray) -> np.ndarray:
        """A long piece: linked list and heap, O(n log n)."""
        if self._map is None:
            self._map = {int(k): int(r) for k, r in zip(self.keys, self.rank, strict=True)}
        sym = self.inner[raw].tolist()
        sym[-1] = int(self.final[raw[-1]])
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self._map.get(sym[i] << 32 | sym[after[i]]) if after[i] < n else None
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r2 := rank(k)) is not None:
                    heapq.heappush(heap, (r2, k, sym[k], sym[after[k]]))
        return np.array([s for s in sym if s >= 0], np.int64)


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """States (arc byte -> state) and final flags of the minimal acyclic automaton of sorted distinct words.

    Words are added in order; when a word leaves the path of the one before it,
    the left-behind states are frozen from the end, each replaced by an equal
    state if there is one.  State 0 is the start.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    free: list[int] = []
    path = [0]
    last = b""

    def freeze(down: int) -> None:
        while len(path) > down + 1:
            state = path.pop()
            shape = (final[state], tuple(arcs[state].items()))
            same = known.setdefault(shape, state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same
                free.append(state)

    for word in words:
        shared = 0
        while shared < len(last) and shared < len(word) and word[shared] == last[shared]:
            shared += 1
        freeze(shared)
        for byte in word[shared:]:
            if free:
                state = free.pop()
                arcs[state], final[state] = {}, False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    freeze(0)
    return arcs, final


def compile_lexicon(words: list[bytes], merges: Merges) -> bytes:
    """One flat file: header, base, check, output, final, id bounds, ids (int32 arrays)."""
    words = sorted(set(words) - {b""})
    arcs, final = minimal_automaton(words)
    below: dict[int, int] = {}
    stack = [0]
    while stack:  # words reachable from each state
        s = stack[-1]
        todo = [t for t in arcs[s].values() if t not in below]
        if todo:
            stack += todo
        else:
            below[s] = final[s] + sum(below[t] for t in arcs[s].values())
            stack.pop()
    reached = sorted(below, key=lambda s: (s != 0, -len(arcs[s])))
    base: dict[int, int] = {}
    used = bytearray(b"\1") + bytearray(len(words) * 2 + 4096)
    output: dict[int, int] = {}
    low = front = 257
    slots: dict[int, list[tuple[int, int]]] = {}
    for s in reached:
        if not arcs[s]:
            base[s] = 0
            continue
        labels = sorted(arcs[s])
        if len(labels) == 1:
            while used[low]:
                low += 1
            at = low - labels[0]
        else:
            at = front
        began = at
        while any(used[at + c] for c in labels):
            at += 1
            if at + 260 >= len(used):
                used.extend(bytes(len(used)))
        if len(labels) > 1 and at - began > 64:  # the front is crowded: later states begin behind it
            front = at - 32
        base[s] = at
        count = int(final[s])
        slots[s] = []
        for c in labels:
            used[at + c] = 1
            slots[s].append((at + c, arcs[s][c]))
            output[at + c] = count
            count += below[arcs[s][c]]
    # a state may be entered from several arcs: each arc's slot holds its target state's number
    number = {s: i for i, s in enumerate(reached)}
    size = max((slot for pairs in slots.values() for slot, _ in pairs), default=0) + 257
    owner, target, out = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    for s, pairs in slots.items():
        for slot, t in pairs:
            owner[slot], target[slot], out[slot] = number[s], number[t], output[slot]
    bases = np.array([base[s] for s in reached], np.int32)
    finals = np.array([final[s] for s in reached], np.int32)
    raw = b"".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids, bounds = merges.merge(np.frombuffer(raw, np.uint8), np.cumsum(sizes) - sizes, sizes)
    head = np.array([len(reached), size, len(words), len(ids), max(map(len, words), default=0)], np.int32)
    return b"".join(x.astype("<i4").tobytes() for x in (head, bases, finals, owner, target, out, bounds, ids))


class Lexicon:
    """A compiled lexicon over any buffer, in particular a memory map."""

    def __init__(self, data):
        flat = np.frombuffer(data, "<i4")
        states, size, words, n_ids, self.longest = flat[:5].tolist()
        cuts = np.cumsum([5, states, states, size, size, size, words + 1, n_ids])
        self.base, self.final, self.owner, self.target, self.out, self.bounds, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """Map the file: workers of one machine share its pages."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word numbers of byte spans, -1 for those outside the lexicon."""
        n = len(starts)
        number = np.full(n, -1, np.int64)
        live = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for step in range(self.longest):
            if not len(live):
                break
            slot = self.base[state].astype(np.int64) + buf[starts[live] + step]
            ok = self.owner[slot] == state
            live, slot, total = live[ok], slot[ok], total[ok]
            state, total = self.target[slot].astype(np.int64), total + self.out[slot]
            ended = sizes[live] == step + 1
            hit = ended & (self.final[state] == 1)
            number[live[hit]] = total[hit]
            live, state, total = live[~ended], state[~ended], total[~ended]
        return number


class TransducerEncoder(WordEncoder):
    """Ids of pieces from the lexicon, the others by exact merging."""

    def __init__(self, path: str, lexicon: str):
        super().__init__(path)
        self.merges = Merges(self.pre.spec, self.pre.letters)
        self.lexicon = Lexicon.mapped(lexicon)

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        from acervo.llm.textkit import text_buffer

        buf, offsets = text_buffer(pieces)
        starts, sizes = offsets[:-1], np.diff(offsets)
        number = self.lexicon.find(buf, starts, sizes)
        new = np.flatnonzero(number < 0)
        merged, at = self.merges.merge(buf, starts[new], sizes[new])
        known = np.flatnonzero(number >= 0)
        word = number[known]
        begin = np.empty(len(starts), np.int64)
        count = np.empty(len(starts), np.int64)
        begin[known], count[known] = self.lexicon.bounds[word], np.diff(self.lexicon.bounds)[word]
        begin[new], count[new] = at[:-1] + len(self.lexicon.ids), np.diff(at)
        pool = np.concatenate((self.lexicon.ids.astype(np.uint32), merged))
        return pool[ranges(begin, count)], np.concatenate(([0], np.cumsum(count)))


def frequent_words(docs: DataFrame, tokenizer: str, text: str = "text", words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent pre-tokens of all documents; at most ``words`` of them reach the driver.

    Blocks are counted where they are read and only pieces that a block holds
    more than once are sent on, so rare words never travel.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = Pretokenizer(tokenizer)
        for whole in batches:
            for batch in batches_of(whole, "text", BLOCK_BYTES):
                flat = pc.ascii_split_whitespace(batch.column("text").fill_null("")).flatten().dictionary_encode()
                times = np.bincount(flat.indices.to_numpy(), minlength=len(flat.dictionary))
                pieces, bounds, _, _ = pre.split(flat.dictionary.to_pylist())
                if not len(pieces):
                    continue
                coded = pieces.dictionary_encode()
                totals = np.bincount(coded.indices.to_numpy(), weights=np.repeat(times, np.diff(bounds)), minlength=len(coded.dictionary)).astype(np.int64)
                often = np.flatnonzero(totals > 1)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(often)), pa.array(totals[often])], ["word", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    totals = cut(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    return sorted(r.word.encode() for r in strongest(totals, "n", "word", words).select("word").collect())


def build_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    return compile_lexicon(frequent_words(docs, tokenizer, text, words), Merges(spec, Pretokenizer(tokenizer).letters))


def ship(spark: SparkSession, data: bytes) -> str:
    """Send a file to every machine, once each; the name under which tasks find it.

    Spark fetches it from the driver for each executor, also for one that joins later.
    """
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}"
    folder = tempfile.mkdtemp(prefix="acervo-")
    path = os.path.join(folder, name)
    try:
        with open(path, "wb") as f:
            f.write(data)
        if name not in _SHIPPED.setdefault(spark.sparkContext.applicationId, set()):
            spark.sparkContext.addFile(path)
            _SHIPPED[spark.sparkContext.applicationId].add(name)
            atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves it until then
            folder = None
    finally:
        if folder:
            shutil.rmtree(folder)
    return name


def bpe_encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and ``token_ids`` or ``decoded`` if named in ``also``.

    ``ids_sha256`` digests the decimal ids joined by one space, ``decoded_sha256``
    the decoded text.
    """
    spark = bounded_batches(docs.sparkSession)
    lexicon = ship(spark, build_lexicon(docs, tokenizer, text, words))  # bounded by ``words``
    kind = docs.schema[doc_id].dataType.simpleString()
    kinds = {"token_ids": "array<int>", "decoded": "string"}
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {kinds[c]}" for c in also)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TransducerEncoder(tokenizer, SparkFiles.get(lexicon))
        size = coder.pre.tokenizer.get_vocab_size()
        decimals = pa.array([str(i) for i in range(size)])
        tokens = pa.array([coder.pre.tokenizer.id_to_token(i) or "" for i in range(size)])
        for whole in batches:
            for batch in batches_of(whole, "text", BLOCK_BYTES):
                coded = coder.encode(batch.column("text"))
                columns = [batch.column("doc_id"), pa.array(np.diff(coded.token_bounds)), _digests(coded.joined(decimals)), _digests(coded.joined(tokens))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                for c in also:
                    columns.append(coded.joined(tokens).cast(pa.string()) if c == "decoded" else pa.ListArray.from_arrays(pa.array(coded.token_bounds.astype(np.int32)), pa.array(coded.flat().astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [*names, *also])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema)


def _digests(texts: pa.Array) -> pa.Array:
    from acervo.llm.textkit import text_buffer

    buf, offsets = text_buffer(texts)
    at = offsets.tolist()
    return pa.array([hashlib.sha256(buf[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())
