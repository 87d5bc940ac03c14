"""Brute-force versions that the operators are compared with."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def near_classes(rows, similar=0.8):
    """{doc_id: least doc_id of its class} from (doc_id, text)."""
    bags = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            holders[s].append(i)
    seen = set()
    for held in holders.values():
        for x in held:
            for y in held:
                if x < y and (x, y) not in seen:
                    seen.add((x, y))
                    a, b = bags[x], bags[y]
                    if sum((a & b).values()) >= similar * sum((a | b).values()):
                        p, q = sorted((find(x), find(y)))
                        parent[q] = p
    return {i: find(i) for i in bags}


def without_repeats(rows, length=200):
    """{doc_id: (bytes, removed, spans, kept)} from (doc_id, text): all strings in one table."""
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[s:s + length] for b in raw.values() for s in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone, reach = bytearray(len(b)), 0
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                for x in range(max(s, reach), s + length):
                    gone[x] = 1
                reach = s + length
        spans = sum(g and (x == 0 or not gone[x - 1]) for x, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out
