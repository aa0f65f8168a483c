"""Plain versions of the operators, one text at a time, that results are compared with."""

import hashlib
import itertools
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(_LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def similar(docs, percent=80):
    """[(id, text)] to {place: (set size, smallest place reachable)}."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(docs))}


def contamination(text, items, size=13):
    """(n_words, n_hit, sorted item names) of one text."""
    w = words(text, ALNUM)
    hit, names = set(), set()
    for item, body in items:
        v = words(body, ALNUM)
        n = min(size, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[a : a + n]:
                    hit.update(range(p, p + n))
                    names.add(str(item))
    return len(w), len(hit), sorted(names)


def line_dedup(docs, min_words=20):
    """[(id, text)] to the texts left: a line goes if it lies in a run of ``min_words`` words that occurs earlier.

    The shortest such runs, from every line forwards and backwards, cover the longer ones.
    """
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, hashlib.md5((docs[k][1] or "").encode()).hexdigest()))
    lines = {}
    for k in order:
        rows = [(n, line.split()) for n, line in enumerate(docs[k][1].encode().split(b"\n"))] if docs[k][1] is not None else []
        lines[k] = [(n, hashlib.md5(b" ".join(w)).digest(), len(w)) for n, w in rows if w]
    seen, gone, done = set(), {}, {}
    for k in order:
        if docs[k] in done:
            gone[k] = done[docs[k]]  # rows that repeat an id and a text are one document
            continue
        gone[k] = done[docs[k]] = set()
        own = lines[k]
        ends = set()
        for p in range(len(own)):
            ends.add((p, next((e for e in range(p + 1, len(own) + 1) if sum(x[2] for x in own[p:e]) >= min_words), None)))
            ends.add((next((s for s in range(p, -1, -1) if sum(x[2] for x in own[s : p + 1]) >= min_words), None), p + 1))
        for s, e in sorted(x for x in ends if None not in x):
            run = tuple(x[1] for x in own[s:e])
            if run in seen:
                gone[k].update(x[0] for x in own[s:e])
            seen.add(run)
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) for k, (_, t) in enumerate(docs)]


def mixed(docs, key):
    """[(id, text, source)] to [(size, target, taken)]; ``key`` is hashed for the seeded order."""
    sizes = [len(SPACED.findall(t or "")) for _, t, _ in docs]
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, d in zip(sizes, docs, strict=True) if d[2] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    capped = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        share = sum(weight[s] for s in sources if s not in capped) or 1
        over = {s for s in sources if s not in capped and rest * weight[s] > 3 * total[s] * share}
        if not over:
            break
        capped |= over
    out = [None] * len(docs)
    for s in sources:
        target = float(3 * total[s]) if s in capped else float(rest * weight[s]) / float(share)
        flow = min(int(target + 0.5), 3 * total[s])
        own = sorted((k for k in range(len(docs)) if docs[k][2] == s), key=lambda k: (hashlib.md5(f"mix-1|{key(docs[k])}".encode()).hexdigest(), sizes[k]))
        copies, left = divmod(flow, total[s]) if total[s] else (0, 0)
        for k in own:
            extra = max(0, min(sizes[k], left))
            left -= extra
            out[k] = (sizes[k], target, copies * sizes[k] + extra)
    return out
