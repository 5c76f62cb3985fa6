"""Brute-force versions of the operators, for the tests."""

import itertools

from glyphmill.llm import common


def wording(t: str) -> set:
    """Word pairs of a levelled text, and three characters in scripts without spaces."""
    out, words = set(), t.split()
    for i, w in enumerate(words):
        if "\u3040" <= w[0] <= "\u30ff" or "\u3400" <= w[0] <= "\u9fff" or "\u0e00" <= w[0] <= "\u0e7f":
            out.update(w[j : j + 3] for j in range(max(1, len(w) - 2)))
        else:
            out.add((w, words[i + 1] if i + 1 < len(words) else ""))
    return out


class Sets:
    """Union-find over any keys; the smallest member stands for a set."""

    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, x, y):
        a, b = sorted((self.root(x), self.root(y)))
        self.parent[b] = a


def groups_of(texts: list[str], least: float) -> list[int]:
    """Smallest member of each text's group by wording alone."""
    words, sets = [wording(common.levelled(t)) for t in texts], Sets()
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(words[i] & words[j]) >= least * len(words[i] | words[j]):
            sets.join(i, j)
    return [sets.root(i) for i in range(len(texts))]


def repeats(log: list[tuple], blocks: list[set], like) -> set[tuple]:
    """(ingest_seq, kind) of log rows (ingest_seq, identity, fingerprint, text, rank), fed in blocks of ranks; like(a, b) links two levelled texts."""
    sets, out, seen = Sets(), set(), []
    first = lambda rows, key: {k: min(r[4] for r in rows if key(r) == k) for k in {key(r) for r in rows} if k is not None}
    long = lambda r: r[3] is not None and len(r[3]) >= 24
    texts: list[str] = []
    for block in blocks:
        now = [r for r in log if r[4] in block]
        seen += now
        for t in sorted({common.levelled(r[3]) for r in now if long(r)} - set(texts)):
            for u in texts:
                if like(t, u):
                    sets.join(t, u)
            texts.append(t)
            sets.root(t)
        root = lambda r: sets.root(common.levelled(r[3])) if long(r) else None
        firsts = first(seen, lambda r: r[1]), first(seen, lambda r: r[2]), first(seen, root)
        for r in now:
            keys = r[1], r[2] if long(r) else None, root(r)
            hit = [k for k, of, name in zip(keys, firsts, "ien") if k is not None and of[k] < r[4]]
            kinds = [n for k, of, n in zip(keys, firsts, ("identity", "exact", "near")) if k is not None and of[k] < r[4]]
            if hit:
                out.add((r[0], kinds[0]))
    return out
