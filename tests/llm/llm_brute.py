"""Brute-force versions of operators."""

import collections

from ternweave.llm import common


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j - 1] + (a != b), row[j] + 1, now[j - 1] + 1))
        row = now
    return min(row)


def bag(text):
    w = common.words(text)
    return collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter({("\0", text or ""): 1})


def brute_classes(rows):
    bags = {i: bag(t) for i, t in rows}
    holds, parent = collections.defaultdict(list), {i: i for i in bags}
    for i, b in bags.items():
        for s in b:
            holds[s].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for ids in holds.values() for a in ids for b in ids if a < b}:
        if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total() - 1e-9:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in bags}
