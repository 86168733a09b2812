"""Plain versions of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def base_rules(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(*(w[i:] for i in range(5))))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def spans_sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        t += x
    return t % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    out = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def secrets(text):
    text = text or ""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.A) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def shingle_set(text, k):
    w = words(text, lower=True)
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, k, percent):
    """{row: (n_shingles, component)} for (doc_id, text) rows."""
    sets = [shingle_set(t, k) for _, t in docs]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        c = Counter()
        for g in s:
            c.update(by[g])
        for j, n in c.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), (low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(docs)]


def dedup_lines(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = defaultdict(set)
    for d, t in docs:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    found[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < min_chars or len(found[key(x)]) < min_docs or max(found[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def decontaminate(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for name, t in items:
        w = split(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(name)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if names := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= names
        found = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
