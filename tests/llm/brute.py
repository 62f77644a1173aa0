"""Plain per-row versions of the operators, for tests on small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def bpe_rows(docs, path):
    t = library(path)
    out = set()
    for doc_id, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.add((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def shard_rows(docs, path):
    t = library(path)
    out, start = set(), 0
    for doc_id, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.add((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


def shingle_set(text, k=5):
    w = (text or "").translate(LOWER).encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_rows(docs, percent=75):
    sets = {d: shingle_set(t) for d, t in docs}
    holders: dict = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    edges, seen = [], set()
    for d, s in sets.items():
        common: dict = {}
        for g in s:
            for other in holders[g]:
                if other < d:
                    common[other] = common.get(other, 0) + 1
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                edges.append((d, other))
    comp = components(sets, edges)
    return {(d, len(s), comp[d], comp[d] == d) for d, s in sets.items()}


def repeat_rows(docs, k=20):
    """Words removed where a window of k words started earlier."""
    seen, out = set(), set()
    for d, t in sorted(docs):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g in seen:
                gone[i : i + k] = [True] * k
            seen.add(g)
        kept = b" ".join(x for x, no in zip(w, gone) if not no)
        out.add((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def vector_rows(rows, least=0.98):
    vec = {}
    for v, e, label in rows:
        x = None
        if e is not None and label is not None and all(c is not None for c in e):
            x = np.array(e, np.float64)
            n = np.sqrt((x * x).sum())
            x = x / n if len(x) and np.isfinite(x).all() and n > 0 else None
        vec[v] = (label, x)
    links, edges = dict.fromkeys(vec, 0), []
    names = [v for v in vec if vec[v][1] is not None]
    for label, size in {(vec[v][0], len(vec[v][1])) for v in names}:
        own = [v for v in names if (vec[v][0], len(vec[v][1])) == (label, size)]
        m = np.stack([vec[v][1] for v in own])
        a, b = np.nonzero(np.triu(m @ m.T >= least, 1))
        for i, j in zip(a.tolist(), b.tolist()):
            links[own[i]] += 1
            links[own[j]] += 1
            edges.append((own[i], own[j]))
    comp = components(vec, edges)
    return {(v, links[v], comp[v], comp[v] == v) for v in vec}


def tiles(item, doc, least):
    """Greedy string tiling, one tile at a time: the longest common run of unmarked tokens, the first of equal ones."""
    free_a, free_b, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        run = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
        for i in range(len(item) - 1, -1, -1):
            for j in range(len(doc) - 1, -1, -1):
                if free_a[i] and free_b[j] and item[i] == doc[j]:
                    run[i][j] = run[i + 1][j + 1] + 1
                    best = min(best, (-run[i][j], i, j))
        n = -best[0]
        if n < least or not n:
            return out
        _, i, j = best
        out.append((i, j, n))
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


def token_list(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leak_rows(docs, items, least=0.5, seed=5):
    """``(doc_id, best item, coverage, items)`` of every document."""
    out = []
    for d, text in docs:
        doc, shares = token_list(text), {}
        for i, t in items:
            item = token_list(t)
            if i is None or not item:
                continue
            share = sum(n for _, _, n in tiles(item, doc, min(seed, len(item)))) / len(item)
            if share:
                shares[i] = max(share, shares.get(i, 0))
        best = min(shares.items(), key=lambda x: (-x[1], x[0]), default=(None, 0.0))
        out.append((d, best[0], round(best[1], 9), tuple(sorted(i for i, c in shares.items() if c >= least))))
    return out


SPACES = " \t\n\x0b\x0c\r"


def word_list(text):
    return [w for w in re.split(f"[{SPACES}]+", text or "") if w]


def _letters(raw):
    return sum(b >= 128 or chr(b).isalpha() for b in raw)


def _marks(raw):
    return sum(33 <= b < 127 and not chr(b).isalnum() for b in raw)


def _upper(raw):
    return sum(65 <= b <= 90 for b in raw)


def quality_row(text):
    """The quality features of one text, in plain Python."""
    own = [w.encode() for w in word_list(text)]
    n, size, total = len(own), sum(map(len, own)), len((text or "").encode())
    part = lambda a, b: a / b if b else 0.0
    times = Counter(own)
    is_mark = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    return [
        math.log1p(n), part(size, n), part(sum(map(_upper, own)), sum(map(_letters, own))), part(sum(48 <= b <= 57 for w in own for b in w), size), part(sum(map(_marks, own)), size),
        part(sum(not _letters(w) for w in own), n), part(sum(len(w) > 2 and is_mark(w[-1]) and is_mark(w[-2]) for w in own), n), part(sum(_upper(w) > 1 and _upper(w) == _letters(w) for w in own), n),
        part(len(times), n), part(sum(a == b for a, b in zip(own, own[1:])), n), part(max(times.values(), default=0), n), math.log1p(n / ((text or "").count("\n") + 1)), part(total - size, total),
    ]


def quality_score(model, text):
    """A fitted additive model applied to one text: table entries, one after another."""
    x = quality_row(text)
    bin_of = lambda edges, v: sum(v > e for e in edges)
    z = model.intercept + sum(t[bin_of(e, v)] for t, e, v in zip(model.tables, model.edges, x))
    z += sum(grid[bin_of(model.coarse[a], x[a]), bin_of(model.coarse[b], x[b])] for a, b, grid in model.pairs)
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def toxicity_row(text, lexicon):
    """The toxicity features of one text, in plain Python."""
    from acervo.llm.features import EDGE_MARKS, LOOKALIKES, SECOND_PERSON

    rows = []
    for word in word_list(text):
        raw, bare = word.encode(), word.lower().strip(EDGE_MARKS)
        if bare and not bare.isalpha():
            plain = "".join(c for c in bare.translate(LOOKALIKES) if c not in "*.-_")
            bare = plain if plain.isalpha() else bare
        exact = lexicon.get("=" + bare, 0.0) if bare else 0.0
        stems = [lexicon.get(bare[:k] + "*", 0.0) for k in range(4, 8) if len(bare) > k]
        edge = word.strip(EDGE_MARKS)
        odd = bool(bare) and not edge.isalpha() and any(c in "0134571357@$!*" for c in edge) and any(c.isalpha() for c in edge)
        rows.append((raw, exact, max([exact, *stems]), bare in SECOND_PERSON, odd, word))
    n, size = len(rows), sum(len(r[0]) for r in rows)
    part = lambda a, b: a / b if b else 0.0
    hits = [i for i, r in enumerate(rows) if r[2] > 0]
    near = sum(any(r[3] for r in rows[max(0, i - 5) : i + 6]) for i in hits)
    return [
        part(sum(r[1] > 0 for r in rows), n), part(len(hits), n), math.log1p(len(hits)), math.log1p(len({rows[i][5] for i in hits})), max((rows[i][2] for i in hits), default=0.0), part(near, n),
        part(sum(r[3] for r in rows), n), part(sum(_upper(r[0]) for r in rows), sum(_letters(r[0]) for r in rows)), part(sum(_upper(r[0]) > 1 and _upper(r[0]) == _letters(r[0]) for r in rows), n),
        part(sum(r[0].count(b"!") + r[0].count(b"?") for r in rows), n), part(sum(_marks(r[0]) for r in rows), size), part(sum(r[4] for r in rows), n), math.log1p(n),
    ]


def toxicity_score(model, text):
    """A fitted tree model applied to one text: every tree walked from its root, then the calibration's line."""
    x = toxicity_row(text, model.lexicon)
    binned = [sum(v > e for e in edges) for v, edges in zip(x, model.edges)]
    z = model.base
    for tree in model.trees:
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if binned[tree.feature[node]] <= tree.cut[node] else tree.right[node]
        z += tree.value[node]
    xs, ys = model.knots
    if not len(xs):
        return 1 / (1 + math.exp(-max(-40, min(40, z))))
    if z <= xs[0]:
        return ys[0]
    for a, b, lo, hi in zip(xs, xs[1:], ys, ys[1:]):
        if z < b:
            return lo + (hi - lo) * (z - a) / (b - a)
    return ys[-1]
