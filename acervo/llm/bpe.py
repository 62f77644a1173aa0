"""Word-level access to a byte-level BPE tokenizer file of the ``tokenizers`` library.

White space always separates tokens of such a tokenizer, so a text's ids are the
ids of its ASCII-white-space-separated words in order.  A batch is therefore
factorised once (Arrow dictionary), each distinct word is encoded once, and ids
are gathered back by numpy.  Distinct words of plain characters (ASCII and
Latin-1 letters, for which normalisation is lower-casing and the split pattern
needs no Unicode tables) take a short path; any other word goes through the
library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import ctypes
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from acervo.llm.textkit import ranges

#: Fixed values of the word-end BPE file this module reads: its normaliser and split pattern.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"

_ODD = re.compile("[^\x21-\x7eÀ-ÖØ-öø-ÿ]|<\\|")
_PLAIN = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+")


_LIBC = ctypes.CDLL(None)


def byte_letters() -> str:
    """The letter that stands for each byte value: printable ones themselves, the others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in kept else chr(next(spare)) for b in range(256))


class Pretokenizer:
    """Distinct words -> pre-tokens (lower-cased pieces of words), with the file checked to be of this kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        kinds = [n["type"] for n in self.spec["normalizer"]["normalizers"]]
        pattern = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if kinds != NORMALIZERS or pattern != SPLIT or self.spec["model"]["end_of_word_suffix"] != SUFFIX:
            raise ValueError(f"{path} is not a word-end BPE tokenizer of the known kind")
        self.letters = byte_letters()
        self.bytes_of = {c: bytes([i]) for i, c in enumerate(self.letters)}
        self.special = {a["content"]: a["id"] for a in self.spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def odd(self, word: str) -> list[bytes | int]:
        """Pre-tokens (UTF-8) and special ids of any word, by the library's normaliser and pre-tokeniser."""
        out: list[bytes | int] = []
        for piece in self._special.split(word) if self._special else [word]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece)):
                    out.append(b"".join(map(self.bytes_of.__getitem__, letters)))
        return out

    def split(self, words: list[str]) -> tuple[pa.Array, np.ndarray, list[int], list[list[bytes | int]]]:
        """``(pre-tokens, bounds, odd, odd_pieces)``: flat pre-tokens of the plain words in order, with
        ``len(words) + 1`` bounds (odd words empty), and the positions and pieces of the odd words."""
        odd_at = [i for i, w in enumerate(words) if _ODD.search(w)]
        pieces = [self.odd(words[i]) for i in odd_at]
        if odd_at:
            words = list(words)
            for i in odd_at:
                words[i] = ""
        flat = _PLAIN.findall("\n".join(words).lower()) if words else []
        flat.append("\n")
        found = pa.array(flat, pa.string())
        ends = np.flatnonzero(pc.equal(found, "\n").to_numpy(zero_copy_only=False))
        keep = np.ones(len(flat), bool)
        keep[ends] = False
        bounds = np.concatenate(([0], ends - np.arange(len(ends)))) if words else np.zeros(1, np.int64)
        return found.filter(pa.array(keep)), bounds, odd_at, pieces


class WordEncoder:
    """Base of encoders: subclasses give ids of distinct pre-tokens in :meth:`ids_of`."""

    def __init__(self, path: str):
        self.pre = Pretokenizer(path)

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ``n + 1`` bounds of distinct pre-tokens (string array)."""
        raise NotImplementedError

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and bounds of distinct words."""
        flat, bounds, odd_at, odd_pieces = self.pre.split(words.to_pylist())
        extra = sorted({p.decode() for pieces in odd_pieces for p in pieces if isinstance(p, bytes)})
        coded = pa.concat_arrays([flat, pa.array(extra, pa.string())]).dictionary_encode()
        index = coded.indices.to_numpy()
        ids, at = self.ids_of(coded.dictionary)
        size = np.diff(at)
        index, extra_index = index[: len(flat)], dict(zip(extra, index[len(flat) :].tolist(), strict=True))
        out = ids[ranges(at[index], size[index])]
        total = np.concatenate(([0], np.cumsum(size[index])))
        ends = total[bounds]
        if not odd_at:
            return out, ends
        parts, counts, last = [], np.diff(ends), 0
        for i, pieces in zip(odd_at, odd_pieces, strict=True):
            own = [np.array([p], np.uint32) if isinstance(p, int) else ids[at[k := extra_index[p.decode()]] : at[k + 1]] for p in pieces]
            parts += [out[last : ends[i]], *own]
            counts[i], last = sum(map(len, own)), ends[i]
        parts.append(out[last:])
        return np.concatenate(parts).astype(np.uint32), np.concatenate(([0], np.cumsum(counts)))

    def encode(self, texts: pa.Array) -> Encoded:
        """Whole texts (null: empty)."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        bounds = bounds - bounds[0]
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        if not full.all():
            bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        ids, at = self.encode_words(coded.dictionary)
        return Encoded(coded.indices.to_numpy(), bounds, ids, at)


class Encoded:
    """Words of texts as indices of distinct words, and the ids of those."""

    def __init__(self, index: np.ndarray, bounds: np.ndarray, ids: np.ndarray, at: np.ndarray):
        self.index, self.bounds, self.ids, self.at = index, bounds, ids, at
        self.size = np.diff(at)
        self.token_bounds = np.concatenate(([0], np.cumsum(self.size[index])))[bounds]

    def flat(self) -> np.ndarray:
        """All ids of all texts; text ``i`` has those from ``token_bounds[i]`` to ``token_bounds[i + 1]``."""
        return self.ids[ranges(self.at[self.index], self.size[self.index])]

    def joined(self, of_ids: pa.Array) -> pa.Array:
        """For each text the strings of its tokens (``of_ids``: by id) joined by one space."""
        offsets = pa.array(self.at.astype(np.int32))
        per_word = pc.binary_join(pa.ListArray.from_arrays(offsets, of_ids.take(pa.array(self.ids))), " ")
        index, bounds = self.index, self.bounds
        if (self.size == 0).any():
            full = self.size[index] > 0
            bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
            index = index[full]
        words = per_word.cast(pa.large_string()).take(pa.array(index))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), words), pa.scalar(" ", pa.large_string()))


class LibraryEncoder(WordEncoder):
    """Ids of pre-tokens by the library's BPE model; a bounded memo spares repeated pieces."""

    def __init__(self, path: str, memo: int = 300_000):
        super().__init__(path)
        self.model, self.memo, self.most = self.pre.tokenizer.model, {}, memo
        self.table = dict(enumerate(self.pre.letters))

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        memo, tokenize, table = self.memo, self.model.tokenize, self.table
        found = []
        for piece in pieces.to_pylist():
            ids = memo.get(piece)
            if ids is None:
                letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(table)
                ids = np.array([t.id for t in tokenize(letters)], "<u4").tobytes()
                if len(memo) >= self.most:
                    memo.clear()
                memo[piece] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), "<u4"), np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)))


def batches_of(batch: pa.RecordBatch, column: str, most: int = 6 << 20):
    """Slices of a batch with about ``most`` bytes in a string column, one row at least."""
    from acervo.llm.textkit import blocks, text_buffer

    _, offsets = text_buffer(batch.column(column))
    for lo, hi in blocks(offsets, most):
        yield batch.slice(lo, hi - lo)
        given_back()


def given_back() -> None:
    """Return free memory to the system: a worker, which lives on after its task, shares its executor's with the JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # of glibc
        _LIBC.malloc_trim(0)
