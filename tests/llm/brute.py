"""Plain single-process versions of the operators' contracts."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return {(i, max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def secrets(text):
    name = "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in "PASSWORD".lower())
    low = lambda w: "".join(f"[{x.upper()}{x}]" for x in w)
    assign = rf"({low('password')}|{low('passwd')}|{low('secret')}|{low('token')}|{low('api')}_?{low('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    del name
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def repeated_bytes(rows, size=100):
    """Rows of distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        drop = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            if s in seen:
                drop[k : k + size] = True
            seen.add(s)
        edges = np.diff(np.concatenate(([0], drop.astype(int), [0])))
        out[i] = (len(b), int(drop.sum()), int((edges == 1).sum()), sha(bytes(np.frombuffer(b, np.uint8)[~drop])))
    return out


def repeated_words(rows, n=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(t or "")
        drop = [False] * len(w)
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            if s in seen:
                drop[k : k + n] = [True] * n
            seen.add(s)
        out[i] = (len(w), sum(drop), sha(" ".join(x for x, d in zip(w, drop) if not d)))
    return out


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def jaccard(rows, n=4, num=85, den=100):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    r = roots(len(rows), pairs)
    return sorted(((i, len(s), rows[r[k]][0]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def chat(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r[:2]) + ((r[2] or ""), (r[3] or ""))):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
