"""Plain versions of the operators, row by row, that the tests compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def words(text):
    return WORD.findall(text or "")


def secrets(text):
    """n_assign, n_access, n_hex, base_sha256."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*[sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(joined.encode()).hexdigest())


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, x in enumerate(windows) if x in often for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    n, repeat = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(docs):
    """doc_id -> (n_shingles, component) from all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    shared = Counter()
    for ids in holders.values():
        if len(ids) > 1:
            for i, a in enumerate(ids):
                for b in ids[i + 1 :]:
                    shared[min(a, b), max(a, b)] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def targets(sizes):
    """source -> target, by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    most = {s: 2 * sizes[s] for s in names}
    got = dict.fromkeys(names, 0.0)
    left, free = 1.5 * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            got[s] += left * weight[s] / total
        left = sum(max(0.0, got[s] - most[s]) for s in free)
        for s in list(free):
            if got[s] >= most[s]:
                got[s] = most[s]
                free.discard(s)
    return got


def nearest(vectors, queries, k=20):
    """query -> [(id, score)] by every inner product in double precision."""
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for q in queries:
        scores = (matrix * np.asarray(vectors[q], dtype=np.float64)).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def padding(lengths, k):
    """The least padded size with k upper bounds, by trying all."""
    from itertools import combinations

    kinds = sorted(set(lengths))
    return min(sum(next(b for b in (*c, kinds[-1]) if b >= x) for x in lengths) for c in combinations(kinds[:-1], min(k, len(kinds)) - 1))


LABEL = r"[A-Za-z0-9-]+"
ENTITIES = [
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@{LABEL}(?:\.{LABEL})*\.[A-Za-z]{{2,}}(?![A-Za-z])"),
    ("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"),
    ("ssn", r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])"),
    ("card", r"(?<![A-Za-z0-9_.+-])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![A-Za-z0-9_-])|[0-9]{13,19}(?![A-Za-z0-9_-]))"),
    ("ip", r"(?<![A-Za-z0-9_.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![A-Za-z0-9_]|\.[0-9])"),
    ("phone", r"(?<![A-Za-z0-9_.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![A-Za-z0-9_-])|(?<![A-Za-z0-9_])\+[0-9]{8,15}(?![A-Za-z0-9_])"),
]


def canonical(kind, hit):
    if kind == "email":
        return hit.lower()
    return hit if kind == "ip" else hit.replace(" ", "") if kind == "iban" else "".join(c for c in hit if c in "0123456789")


def entities(text):
    """(start, end, kind, canonical form) of all but names: at each place the first kind that matches, leftmost, without overlaps."""
    out, at = [], 0
    while at < len(text):
        for kind, pattern in ENTITIES:
            m = regex.compile(pattern).match(text, at)
            if m:
                out.append((at, m.end(), kind, canonical(kind, m[0])))
                at = m.end()
                break
        else:
            at += 1
    return out


def license_shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in text.encode()).split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]


def contained(text, template):
    """The share of a template's shingles that a text has anywhere."""
    own = set(license_shingles(template))
    return len(own & set(license_shingles(text))) / len(own)


def licenses(rows, templates):
    """(id, name) where some place of a template's length has three quarters of its shingles."""
    out = set()
    for name, template in templates.items():
        own = license_shingles(template)
        different = set(own)
        for i, text in rows:
            s = license_shingles(text)
            if any(4 * len(different & set(s[k : k + len(own)])) >= 3 * len(different) for k in range(max(1, len(s) - len(own) + 1))):
                out.add((i, name))
    return out


def evidence_counts(text):
    """The nine numbers of a text that the site classifier is fitted on."""
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    plain = sum(map(len, w))
    share = lambda chars: sum(c in chars for c in text) / max(plain, 1)
    return [
        np.log1p(len(w)), plain / max(len(w), 1), len(set(w)) / max(len(w), 1), (len(lines) - len(set(lines))) / max(len(lines), 1),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#*$%&|<>{}[]~^_=+\\@"), share("!?"), share(".,;:"),
    ]


def site_posteriors(rows, least=1e-4):
    """(host, path, evidence) rows to their (host quality, path quality, quality), group by group."""
    mean = np.mean([p for _, _, p in rows])

    def grouped(by):
        out = {}
        for r in rows:
            out.setdefault(by(r), []).append(r[2])
        return out

    def kappa(groups, parent):
        n, g = sum(map(len, groups.values())), len(groups)
        within = max(sum(len(x) * np.var(x) for x in groups.values()), 0) / max(n - g, 1)
        around = sum(len(x) * (np.mean(x) - parent[k]) ** 2 for k, x in groups.items())
        size = max(n - sum(len(x) ** 2 for x in groups.values()) / n, 1e-9)
        return max(within / max((around - (g - 1) * within) / size, 1e-6), 1.0)

    shrunk = lambda groups, parent, k: {key: (sum(x) + k * parent[key]) / (len(x) + k) for key, x in groups.items()}
    hosts = grouped(lambda r: r[0])
    top = dict.fromkeys(hosts, mean)
    host = shrunk(hosts, top, kappa(hosts, top))
    paths = grouped(lambda r: r[:2])
    parent = {k: host[k[0]] for k in paths}
    k = kappa(paths, parent)
    path = shrunk(paths, parent, k)
    odds = lambda x: (y := min(max(x, least), 1 - least)) / (1 - y)
    out = []
    for h, t, p in rows:
        others = (sum(paths[h, t]) - p + k * host[h]) / (len(paths[h, t]) - 1 + k)
        post = odds(p) * odds(others) / odds(mean)
        out.append((host[h], path[h, t], post / (1 + post)))
    return out
