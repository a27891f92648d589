"""Plain-Python versions of what the operators compute."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(k))))


def classes(docs, k, num, den):
    """docs: {id: text} -> {id: smallest linked id}"""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    root = {d: d for d in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def kept_lines(docs):
    """docs: {id: text} -> {id: (n_lines, n_dropped, kept text)}"""
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOWER)

    holders = collections.defaultdict(set)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and d < max(holders[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def exact(docs):
    """docs: {id: text} -> {id: (keep, size, sha)}"""
    groups = collections.defaultdict(list)
    for d, t in docs.items():
        groups[sha(BLANK.sub("", t or ""))].append((-len(t or ""), d))
    return {d: (min(g)[1], len(g), s) for s, g in groups.items() for _, d in g}
