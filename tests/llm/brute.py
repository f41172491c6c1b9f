"""Plain versions of the operators, for comparison."""

import hashlib
import re
from collections import defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """Least id reachable, for each position; linked(i, j) on positions."""
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def simhash(rows):
    fps = [fingerprint(t) for _, t in rows]
    comp = components([i for i, _ in rows], lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    return sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp))


def line_key(line):
    return lower(line.strip(SPACE))


def repeated_keys(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(line_key(line)) >= 20:
                holders[line_key(line)].add(i)
    return {k: max(v) for k, v in holders.items() if len(v) >= 3}


def without_lines(rows):
    gone = repeated_keys(rows)
    return [(i, "\n".join(x for x in (t or "").split("\n") if i is None or line_key(x) not in gone or gone[line_key(x)] == i)) for i, t in rows]


def lines(rows):
    out, gone = [], repeated_keys(rows)
    for (i, t), (_, kept) in zip(rows, without_lines(rows)):
        n = (t or "").split("\n")
        dropped = sum(1 for x in n if i is not None and line_key(x) in gone and gone[line_key(x)] != i)
        out.append((i, len(n), dropped, sha(kept)))
    return out


def windows(rows, size):
    """(n_words, removed word positions) per row."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, w, gone))
    return out
