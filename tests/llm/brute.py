"""Plain versions of what the operators compute, for small tables."""

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_duplicates(rows, percent=75):
    """rows: (id, text) with distinct ids; {id: (set size, component, kept)}."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    both = Counter()
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def quality(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    cover = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def crc_mod(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
