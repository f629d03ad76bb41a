"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def components(docs, size=5, percent=80):
    sets = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(ASCII_LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            index[s].append(i)
    common = Counter((a, b) for v in index.values() for a in v for b in v if a < b)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality(text):
    w = WORD.findall(text or "")
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def line_dedup(docs, min_chars=20, min_docs=3):
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOW)
    holders = defaultdict(set)
    for i, text in docs:
        if i is not None:
            for l in (text or "").split("\n"):
                holders[key(l)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [l for l in lines if i is None or not (len(key(l)) >= min_chars and len(holders[key(l)]) >= min_docs and max(holders[key(l)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def _luhn(digits):
    return sum(d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def pii_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    found.sort()
    return [f"{k}:{s}:{e}" for s, _, k, e in found]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
