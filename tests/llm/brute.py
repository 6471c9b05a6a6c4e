"""Plain versions of the contracts, for small inputs."""

import collections
import hashlib
import re

BLANK = "\x20\x09-\x0D"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def contamination(texts, items, size=13):
    """(words, hit words, sorted items) per text; items: (id, text)."""
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    owners = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            owners.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {len(p) for p in owners}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k:k + n])) in owners:
                    hit |= set(range(k, k + n))
                    found |= owners[p]
        out.append((len(w), len(hit), sorted(found)))
    return out


def base_spans(t):
    """(start, kind, end) of the base secrets, sorted."""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k)
                   for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def measures(t):
    """words, word characters, symbols, repeated lines, words in repeated 5-word windows."""
    t = t or ""
    w = re.findall(f"[^{BLANK}]+", t)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, cover = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(f"[^{BLANK}]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def shingles(t, n=5):
    w = re.findall(f"[^{BLANK}]+", low(t))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(rows):
    """id -> (shingles, smallest id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    having = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        common = collections.Counter(j for x in sets[i] for j in having[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (len(s), top(i)) for i, s in sets.items()}


def substrings_removed(rows, n=100):
    """id -> (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - n + 1):
            x = data[p:p + n]
            if x in seen:
                cover[p:p + n] = b"\x01" * n
            seen.add(x)
        rest = bytes(c for c, f in zip(data, cover) if not f)
        spans = sum(1 for k in range(len(cover)) if cover[k] and not (k and cover[k - 1]))
        out[i] = (len(data), sum(cover), spans, hashlib.sha256(rest).hexdigest())
    return out
