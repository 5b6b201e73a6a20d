"""Plain single-machine versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(_LOW) if lower else text)


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def near_duplicates(rows):
    """rows: (doc_id, text). Multiset of (doc_id, n_shingles, component_id, n_links)."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    ids = {}
    for k, (doc_id, _) in enumerate(rows):
        r = root(k)
        if doc_id is not None:
            ids[r] = min(ids.get(r, doc_id), doc_id)
    return [(d, len(sets[k]), ids.get(root(k)), links[k]) for k, (d, _) in enumerate(rows)]


def remove_repeats(rows, length=100):
    """rows: (doc_id, text). Multiset of (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, _tie(rows[k][1])))
    seen, out = set(), []
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            else:
                seen.add(w)
        rest = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((rows[k][0], len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def _tie(text):
    return text or ""  # tests do not give one id to different texts that share passages


def token_files(rows, encode):
    """rows: (doc_id, text). (doc_id, start, n_tokens, ids_crc32) in ascending id order, null first."""
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text or "") + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def text_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    hit = set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit.update(range(i, i + 8))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def score(rows, modulus=10, add=0.1, discount=0.75, least=1):
    """rows: (doc_id, text). (doc_id, held_out, n_tokens, n_known, N, base, score)."""
    end, start = ("end",), ("start",)
    texts = [[*words(t), end] for _, t in rows]
    train = [fold(d, modulus) != 0 for d, _ in rows]
    one, two, context = Counter(), Counter(), Counter()
    for t, used in zip(texts, train):
        if used:
            one.update(t)
            two.update(zip([start, *t], t))
            context.update([start, *t[:-1]])
    n, v = sum(one.values()), len(one)
    kept = {k: c for k, c in two.items() if c >= least}
    mass = Counter()
    for (h, _), c in kept.items():
        mass[h] += c - discount

    def p1(w):
        return (one[w] + add) / (n + add * (v + 1))

    out = []
    for (d, _), t, used in zip(rows, texts, train):
        base = sum(math.log10(p1(w)) for w in t)
        total = 0.0
        for h, w in zip([start, *t], t):
            back = 1 - mass[h] / context[h] if context[h] else 1.0
            p = back * p1(w)
            if (h, w) in kept:
                p += (kept[h, w] - discount) / context[h]
            total += math.log10(p)
        out.append((d, not used, len(t), sum(one[w] > 0 for w in t), n, base, total))
    return out
