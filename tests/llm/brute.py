"""Plain versions of the operators, one document after the other, for small inputs."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    n = min(k, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def components(rows, k, percent):
    """(id, text) rows to (id, set size, least id in the component); links of rows by whole comparison."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def line_dedup(rows, percent):
    """(id, text) rows in the operator's order to (id, lines, removed, text)."""
    seen, out = [], []
    for d, t in rows:
        kept, n, gone = [], 0, 0
        for line in (t.split("\n") if t is not None else []):
            s = frozenset(words(line))
            if s:
                n += 1
                if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                    gone += 1
                else:
                    kept.append(line)
                seen.append(s)
            else:
                kept.append(line)
        out.append((d, n, gone, "\n".join(kept) if t is not None else None))
    return out


def token_digests(rows, tokenizer, end):
    """(id, text) rows to (id, start, tokens, crc32), in ascending order of ids, null first."""
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out
