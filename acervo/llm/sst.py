"""Token-id output as sorted-string-table shards, and their reader.

File layout (little endian unless said otherwise)::

    data blocks | Bloom filter | block index | footer

* A key is the signed 64-bit document id as eight big-endian bytes with the sign
  bit flipped, so byte order is numeric order.
* A data block holds entries ``varint shared, varint unshared, varint length,
  key suffix, value``: each key keeps only what differs from the key before it;
  every ``RESTART`` entries a whole key starts a run, and the block ends with
  the runs' offsets (u32 each) and their number.  Blocks are zstd frames.
* A value is the document's ids as unsigned integers of the footer's width (2
  bytes while the vocabulary fits, else 4).
* The block index is sparse: first key, offset, length and crc32 of each block.
* The Bloom filter has ``BLOOM_BITS`` bits a key and ``BLOOM_PROBES`` probes.
* The footer has a fixed size: offsets and lengths of filter and index, numbers
  of entries and ids, width, format version and magic.

A lookup asks the filter, bisects the index, reads one block and bisects its
runs.  :func:`write_shards` deals documents by ranges of the id, so the shards
in order hold all keys in order.  A shard is written under a name of its own by
each task attempt and counts only through the manifest row that the successful
attempt returns, so lost executors and repeated tasks leave no wrong shard.

Defined cases: a null text counts as empty (only the end id); rows with a null
id have no key and are left out; rows of the same id follow each other in order
of their texts and are all kept (a lookup returns the first); texts of any length
are encoded whole, one block of at most 24 MB or one text at a time; an empty table
gives no shard.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.bpe import LibraryEncoder, batches_of
from acervo.llm.common import cut, fresh_path, partitions

BLOCK_BYTES = 64 << 10
SHARD_BYTES = 256 << 20  # of text to a shard, about
RESTART = 16
BLOOM_BITS, BLOOM_PROBES = 10, 7
FOOTER = struct.Struct("<QQQQQQBB6x")
MAGIC = b"ACVSST01"
ENTRY = struct.Struct("<8sQII")

MANIFEST = "shard int, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int) -> bytes:
    return ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Bit positions (keys x probes) by double hashing of the 64-bit ids."""
    from acervo.llm.textkit import mix

    a = mix(keys.astype(np.uint64))
    b = mix(a ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(n_bits)


class Writer:
    """Writes one shard to a binary stream; keys must come in ascending order."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.ids: list[int] = []
        self.n_tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._begin()

    def _begin(self) -> None:
        self.block, self.runs, self.n, self.first, self.last = bytearray(), [], 0, b"", b""

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.n % RESTART == 0:
            self.runs.append(len(self.block))
        else:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(8 - shared) + _varint(len(value)) + key[shared:] + value
        self.first = self.first or key
        self.last = key
        self.n += 1
        self.ids.append(doc_id)
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.sink.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.n:
            data = self.pack.compress(bytes(self.block) + np.array([*self.runs, len(self.runs)], "<u4").tobytes())
            at, size = self._put(data)
            self.index.append((self.first, at, size, zlib.crc32(data)))
            self._begin()

    def close(self) -> None:
        self._flush()
        n_bits = max(64, len(self.ids) * BLOOM_BITS)
        bits = np.zeros((n_bits + 7) // 8 * 8, bool)
        if self.ids:
            bits[_probes(np.array(self.ids, np.int64), n_bits).ravel().astype(np.int64)] = True
        bloom = self._put(struct.pack("<Q", n_bits) + np.packbits(bits, bitorder="little").tobytes())
        index = self._put(b"".join(ENTRY.pack(*e) for e in self.index))
        self._put(FOOTER.pack(*bloom, *index, len(self.ids), self.n_tokens, self.width, 1) + MAGIC)


class Table:
    """A shard for reading: point lookups and ordered scans over a random-access file."""

    def __init__(self, source):
        self.source = source
        tail = FOOTER.size + len(MAGIC)
        raw = self._read(source.size() - tail, tail)
        if raw[FOOTER.size :] != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom_at, self.bloom_size, index_at, index_size, self.n_docs, self.n_tokens, self.width, _ = FOOTER.unpack(raw[: FOOTER.size])
        self.index = list(ENTRY.iter_unpack(self._read(index_at, index_size)))
        self.firsts = [e[0] for e in self.index]
        self.bloom: tuple[int, np.ndarray] | None = None

    def _read(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at) if size else b""

    def _block(self, i: int) -> tuple[bytes, np.ndarray]:
        _, at, size, crc = self.index[i]
        data = self._read(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int.from_bytes(raw[-4:], "little")
        return raw[: len(raw) - 4 * n - 4], np.frombuffer(raw[len(raw) - 4 * n - 4 : -4], "<u4")

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def may_have(self, doc_id: int) -> bool:
        if self.bloom is None:
            raw = self._read(self.bloom_at, self.bloom_size)
            self.bloom = struct.unpack("<Q", raw[:8])[0], np.frombuffer(raw[8:], np.uint8)
        n_bits, bits = self.bloom
        at = _probes(np.array([doc_id], np.int64), n_bits)[0].astype(np.int64)
        return bool(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all())

    def get(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document, or None."""
        if not self.n_docs or not self.may_have(doc_id):
            return None
        key = key_of(doc_id)
        for i in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            data, runs = self._block(i)
            lo, hi = 0, len(runs) - 1  # the last run whose first key is below the wanted one, or the first run
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if next(self._entries(data, int(runs[mid])))[0] < key else (lo, mid - 1)
            for found, ids in self._entries(data, int(runs[lo])):
                if found == key:
                    return ids
                if found > key:
                    break
        return None

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._entries(self._block(i)[0], 0):
                yield id_of(key), ids


def open_shard(uri: str) -> Table:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return Table(store.open_input_file(path))


def write_shards(docs: DataFrame, directory: str, tokenizer: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode whole texts and write them as shards; returns the manifest (one row a shard, in key order).

    Without ``shards`` there are as many as the texts ask for, ``SHARD_BYTES`` of text to
    each, and the session's shuffle partitions at least; a shard's documents stream
    through its task a batch at a time, texts of any length whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = LibraryEncoder(tokenizer)
        width = 2 if encoder.pre.tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        end = np.array([] if end_id is None else [end_id], np.uint32)
        writer = sink = None
        for whole in batches:
            for batch in batches_of(whole, "text", 24 << 20):
                if not batch.num_rows:
                    continue
                if writer is None:
                    store, base = fs.FileSystem.from_uri(directory)
                    store.create_dir(base, recursive=True)
                    shard = TaskContext.get().partitionId()
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.sst"
                    sink = store.open_output_stream(f"{base}/{name}")
                    writer = Writer(sink, width)
                coded = encoder.encode(batch.column("text"))
                flat, at = coded.flat(), coded.token_bounds.tolist()
                for i, key in enumerate(batch.column("doc_id").to_pylist()):
                    writer.add(key, np.concatenate((flat[at[i] : at[i + 1]], end)))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{directory}/{name}", "first_id": writer.ids[0], "last_id": writer.ids[-1], "n_docs": len(writer.ids), "n_tokens": writer.n_tokens, "n_bytes": writer.at}], schema=_MANIFEST)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    n = shards
    if not n:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(dealt.mapInArrow(write, MANIFEST), "manifest")


_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids`` if wanted) of every document.

    ``start`` counts the ids of all documents before; the offsets of the shards
    are a running sum over the manifest, which has one row a file.
    """
    offset = manifest.select("path", "n_docs", (F.sum("n_tokens").over(Window.orderBy("first_id", "shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["start"], []
                for key, ids in open_shard(row["path"]).scan():
                    wide = ids.astype("<u4")
                    out.append((key, start, len(ids), zlib.crc32(wide.tobytes())) + ((wide.astype(np.int32),) if with_ids else ()))
                    start += len(ids)
                    if len(out) >= 4096:
                        yield _rows(out, with_ids)
                        out = []
                if out:
                    yield _rows(out, with_ids)

    n = max(partitions(manifest.sparkSession), manifest.count())  # a file to a task
    return offset.repartition(n, "path").mapInArrow(read, schema)


def _rows(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in cols[4]]))).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(cols[4]), pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def token_shards(docs: DataFrame, tokenizer: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text", directory: str | None = None) -> DataFrame:
    """Write ``docs`` as shards (below the shared folder unless named) and read them back."""
    directory = directory or fresh_path(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, directory, tokenizer, end_id, doc_id, text))
