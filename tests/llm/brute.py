"""Plain versions of what the operators do, without arrays, sharding or Spark."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def raw(text):
    return (text or "").encode("utf-8", "surrogatepass")


def words(text):
    return WORD.findall(raw(text))


def fingerprint(text, width):
    w = [x.lower() for x in words(text)]
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if hashes else 0


def shingles(text, width=5):
    w = [x.lower() for x in words(text)]
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(items, linked):
    """Least member of each item's class, under the transitive closure of linked pairs."""
    up = {x: x for x in items}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    items = sorted(up)
    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def repeats(texts, width):
    """For each text the kept bytes, removed bytes and spans, by a table of all strings of so many bytes."""
    texts = [raw(t) for t in texts]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((kept, sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out


def base_traits(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    hit = {j for i, t in enumerate(triples) if often[t] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Target of each source: shares by weight, stopped at most times the size, the excess shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: most * sizes[s] for s in over}


def boilerplate(rows, ratio, least):
    """Texts of (source, text) rows without lines that over ratio of the source's pages, and at least so many, contain."""
    key = lambda line: re.sub(r"[\x09-\x0D]", " ", line).strip(" ")
    pages, found = Counter(s for s, _ in rows), defaultdict(int)
    for s, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""} if t is not None else ():
            found[s, k] += 1
    bad = {x for x, n in found.items() if n >= least and n > ratio * pages[x[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, key(x)) not in bad) for s, t in rows]
