"""The results by plain Python, as the contracts state them."""

import collections
import hashlib
import re

SPACES = "[^\x20\x09-\x0d]+"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def substrings(rows, window=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                cover[p : p + window] = b"\1" * window
            else:
                seen.add(w)
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out[doc] = (len(data), sum(cover), spans, sha(bytes(x for x, c in zip(data, cover) if not c)))
    return out


def windows(rows, window=50):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ws = re.findall(SPACES, text or "")
        cover = [0] * len(ws)
        for p in range(len(ws) - window + 1):
            if seen.setdefault(tuple(ws[p : p + window]), doc) < doc:
                cover[p : p + window] = [1] * window
        out[doc] = (len(ws), sum(cover), sha(" ".join(x for x, c in zip(ws, cover) if not c)))
    return out


def near(rows, words=3, percent=85):
    sets = {}
    for doc, text in rows:
        w = re.findall(SPACES, fold(text))
        sets[doc] = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def contaminated(rows, items, window=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    owners = collections.defaultdict(set)
    for item, text in items:
        w = word.findall(fold(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            owners[tuple(w[i : i + n])].add(str(item))
    out = {}
    for doc, text in rows:
        w = word.findall(fold(text))
        cover, found = [0] * len(w), set()
        for n in {len(k) for k in owners}:
            for p in range(len(w) - n + 1):
                if mine := owners.get(tuple(w[p : p + n])):
                    cover[p : p + n] = [1] * n
                    found |= mine
        out[doc] = (len(w), sum(cover), len(found), sha(",".join(sorted(found))), sum(cover) > 0)
    return out


def edited(rows):
    """Number of code points, and digest of the text with its last quarter replaced by the beginning of the next one."""
    rows = [(d, t or "") for d, t in sorted(rows, key=lambda r: r[0])]
    return {d: (len(t), sha(t[: len(t) - len(t) // 4] + u[: len(t) // 4])) for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1])}


def collocations(rows, least, longest=5, top=2000):
    """rows (text, lang) to (lang, rank, phrase, a, l, r, n, score)."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", fold(text)):
            words = re.findall("[^\x20\t]+", piece)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = [p for p, c in f.items() if len(p) > 1 and c >= least]
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p in good:
            if any(len(q) > len(p) and 100 * f[q] >= 100 * f[p] and inside(p, q) for q in good):
                continue
            score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out
