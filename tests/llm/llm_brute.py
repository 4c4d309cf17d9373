"""Plain versions of the training-data operators, in Python objects, for small inputs."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from tokenizers import Tokenizer

import public_tokenizers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def winnowing(docs, items):
    """By doc_id: n_words, n_hit, items."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= {str(x) for x in windows[g] if x is not None}
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def components(vertices, links):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {v: root(v) for v in vertices}


def shingles(text, k):
    w = blank_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(docs, k):
    """By doc_id: n_shingles, component_id. Ids are distinct and not null."""
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (x := len(sets[a] & sets[b])) and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x)]
    root = components(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def token_rows(docs, end=2):
    """(doc_id, start, n_tokens, crc32) in ascending order of id and text."""
    tok, start, out = tokenizer(), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def language_model(docs, held, mus):
    """(n_tokens, n_known, N, base, score) of each text, and a function that gives P(token | history)."""
    texts = [[*blank_words(t), None] for t in docs]
    counts = Counter()
    for x, h in zip(texts, held):
        if not h:
            for k in range(1, len(mus) + 2):
                padded = x if k == 1 else [None, *x]
                counts.update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
    singles = {g: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(singles.values()), len(singles)

    def p(word, history):
        if not history:
            return (singles.get((word,), 0) + 0.1) / (n + 0.1 * (v + 1))
        mu, lower = mus[len(history) - 1], p(word, history[1:])
        return (counts[(*history, word)] + mu * lower) / (counts[history] + mu)

    out = []
    for x in texts:
        base = sum(math.log10(p(w, ())) for w in x)
        own = sum(math.log10(p(w, tuple([None, *x[:i]][-len(mus) :]))) for i, w in enumerate(x))
        out.append((len(x), sum(singles.get((w,), 0) > 0 for w in x), n, base, own))
    return out, p


def mixing(rows):
    """By doc_id: size, source_size, target, taken. rows: (doc_id, text, source)."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d, _, x in rows if x == s) for s in sources}
    weight = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(sources)}
    target, free, rest = {}, set(sources), Fraction(sum(total.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(3 * total[s])
            rest -= target[s]
        free -= over
    out = {}
    for d, _, s in rows:
        rate = float(target[s]) / total[s] if total[s] else 0.0
        draw = int(hashlib.md5(f"mix-1:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        out[d] = (size[d], total[s], float(target[s]), size[d] * (math.floor(rate) + (draw < rate - math.floor(rate))))
    return out


def ngrams(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in text or "")
    out = Counter()
    for word in letters.split(" "):
        if word:
            w = [0, *map(ord, word), 0]
            out.update((1, 0, 0, x) for x in w[1:-1])
            out.update((2, 0, *x) for x in zip(w, w[1:]))
            out.update((3, *x) for x in zip(w, w[1:], w[2:]))
    return out


def ranked(counts, top=300):
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])}


def languages(texts, training, top=300):
    """(language, score) of each text. training: (text, lang)."""
    sums = {}
    for text, lang in training:
        if text is not None and lang is not None:
            sums.setdefault(lang, Counter()).update(ngrams(text))
    known = {k: ranked(v, top) for k, v in sorted(sums.items()) if v}
    out = []
    for text in texts:
        own = ranked(ngrams(text), top)
        if not own or not known:
            out.append(("und", 0.0))
            continue
        far = {k: sum(abs(p[g] - r) if g in p else top for g, r in own.items()) for k, p in known.items()}
        best = min(far, key=far.get)
        out.append((best, 1 - far[best] / (len(own) * top)))
    return out
