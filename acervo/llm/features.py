"""Dense per-document features of whole texts, computed a batch at a time.

Words are factorised once; what depends on a word alone is computed for the
distinct words and summed over documents by prefix sums.  Labels, language,
source and id play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from acervo.llm.textkit import text_buffer

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = np.zeros(256, bool)
MARK[33:127] = True
MARK &= ~LETTER & ~DIGIT


class Words:
    """The words of a batch: ``index`` into ``distinct``, ``bounds`` by document."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds, flat = bounds - bounds[0], lists.flatten()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        if not full.all():
            bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.index, self.distinct, self.bounds = coded.indices.to_numpy(), coded.dictionary, bounds
        self.count = np.diff(bounds)
        self.buf, self.at = text_buffer(self.distinct)
        self.size = np.diff(self.at)
        self.text_buf, self.text_at = text_buffer(texts)

    def of_class(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a class in each distinct word."""
        total = np.concatenate(([0], np.cumsum(table[self.buf])))
        return total[self.at[1:]] - total[self.at[:-1]]

    def by_doc(self, of_word: np.ndarray) -> np.ndarray:
        """Sum over each document of a value of its distinct words' occurrences."""
        return self.sum_by_doc(np.asarray(of_word, np.float64)[self.index])

    def sum_by_doc(self, of_occurrence: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(of_occurrence, dtype=np.float64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


QUALITY = [
    "log_words", "mean_word_bytes", "upper_share", "digit_share", "mark_share", "words_without_letters",
    "words_ending_in_marks", "capital_words", "distinct_share", "repeats_next", "top_word_share", "words_a_line", "wordless_bytes",
]


def quality_features(texts: pa.Array) -> np.ndarray:
    """One row of :data:`QUALITY` for each text; all zero for a text without words."""
    w = Words(texts)
    n = w.count.astype(np.float64)
    letters, upper, digits, marks = (w.of_class(t) for t in (LETTER, UPPER, DIGIT, MARK))
    size = w.by_doc(w.size)
    last = w.buf[np.maximum(w.at[1:] - 1, 0)] if len(w.size) else np.zeros(0, np.uint8)
    before = w.buf[np.maximum(w.at[1:] - 2, 0)] if len(w.size) else np.zeros(0, np.uint8)
    doc = w.docs()
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    if len(doc):
        key = np.sort(doc * len(w.distinct) + w.index)
        runs = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        owner = key[runs] // len(w.distinct)
        distinct += np.bincount(owner, minlength=len(n))
        np.maximum.at(top, owner, np.diff(np.append(runs, len(key))))
    same = np.zeros(len(doc))
    same[1:] = (w.index[1:] == w.index[:-1]) & (doc[1:] == doc[:-1])
    breaks = np.concatenate(([0], np.cumsum(w.text_buf == 10)))
    lines = breaks[w.text_at[1:]] - breaks[w.text_at[:-1]] + 1
    total = np.diff(w.text_at).astype(np.float64)
    return np.stack([
        np.log1p(n), share(size, n), share(w.by_doc(upper), w.by_doc(letters)), share(w.by_doc(digits), size), share(w.by_doc(marks), size), share(w.by_doc(letters == 0), n),
        share(w.by_doc((w.size > 2) & MARK[last] & MARK[before]), n), share(w.by_doc((upper > 1) & (upper == letters)), n), share(distinct, n), share(w.sum_by_doc(same), n), share(top, n), np.log1p(share(n, lines)), share(total - size, total),
    ], axis=1)


#: Second-person words of the languages at hand, and the usual look-alikes of letters.
SECOND_PERSON = "you your yours u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split()
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
EDGE_MARKS = ".,;:!?\"'()[]{}<>|*#%&$-_~/\\"
STEMS = range(4, 8)
NEAR = 5

TOXICITY = ["hit_share", "stem_share", "hits", "distinct_hits", "top_weight", "hits_near_second_person", "second_person_share", "upper_share", "capital_words", "shout_marks", "mark_share", "obfuscated_share", "log_words"]


def terms(word: str) -> list[str]:
    """What the lexicon can hold of a word: itself (``=word``) and its stems (``stem*``), in lower case without edge marks."""
    bare = word.lower().strip(EDGE_MARKS)
    if not bare:
        return []
    if not bare.isalpha():
        plain = bare.translate(LOOKALIKES).replace("*", "").replace(".", "").replace("-", "").replace("_", "")
        if plain.isalpha():
            bare = plain
    return ["=" + bare, *[bare[:k] + "*" for k in STEMS if len(bare) > k]]


def toxicity_features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """One row of :data:`TOXICITY` for each text."""
    w = Words(texts)
    n = w.count.astype(np.float64)
    letters, upper, digits, marks = (w.of_class(t) for t in (LETTER, UPPER, DIGIT, MARK))
    weight, exact, person, odd = (np.zeros(len(w.distinct)) for _ in range(4))
    second = set(SECOND_PERSON)
    for i, word in enumerate(w.distinct.to_pylist()):
        own = terms(word)
        if not own:
            continue
        if own[0] in lexicon:
            exact[i] = weight[i] = lexicon[own[0]]
        for t in own[1:]:
            if t in lexicon:
                weight[i] = max(weight[i], lexicon[t])
        if own[0][1:] in second:
            person[i] = 1
        bare = word.strip(EDGE_MARKS)
        odd[i] = not bare.isalpha() and any(c in "0134571357@$!*" for c in bare) and any(c.isalpha() for c in bare)
    hit = weight > 0
    occurs, pronoun = hit[w.index], np.concatenate(([0], np.cumsum(person[w.index])))
    at = np.flatnonzero(occurs)
    doc = w.docs()
    lo, hi = np.maximum(at - NEAR, w.bounds[:-1][doc[at]]), np.minimum(at + NEAR + 1, w.bounds[1:][doc[at]])
    near = np.zeros(len(occurs))
    near[at] = pronoun[hi] > pronoun[lo]
    size = w.by_doc(w.size)
    top, distinct = np.zeros(len(n)), np.zeros(len(n))
    np.maximum.at(top, doc[at], weight[w.index[at]])
    if len(at):
        distinct += np.bincount(np.unique(doc[at] * len(w.distinct) + w.index[at]) // len(w.distinct), minlength=len(n))
    shout = np.zeros(256, bool)
    shout[[33, 63]] = True
    return np.stack([
        share(w.by_doc(exact > 0), n), share(w.by_doc(hit), n), np.log1p(w.by_doc(hit)), np.log1p(distinct), top, share(w.sum_by_doc(near), n), share(w.by_doc(person), n), share(w.by_doc(upper), w.by_doc(letters)),
        share(w.by_doc((upper > 1) & (upper == letters)), n), share(w.by_doc(w.of_class(shout)), n), share(w.by_doc(marks), size), share(w.by_doc(odd), n), np.log1p(n),
    ], axis=1)
