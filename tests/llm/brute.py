"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = SPACE_WORD.findall(lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def near(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) per (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    part = components(len(rows), links)
    least = {}
    for p, (d, _) in zip(part, rows):
        if d is not None:
            least[p] = min(d, least.get(p, d))
    return [(d, len(s), least.get(p), d == least.get(p)) for (d, _), s, p in zip(rows, sets, part)]


def repeated_bytes(rows, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per (doc_id, text)."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), int(spans), hashlib.sha256(rest).hexdigest()))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licenses(text, rules):
    """(n_words, n_base, first_word, last_word, base_labels, labels)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    norm = " ".join(words)
    hits = sorted({(m.start(), -m.end(), priority, label) for priority, label, keyword, pattern in rules if keyword in norm
                   for m in re.finditer(pattern, norm)})
    kept, reach = [], -1
    for s, e, priority, label in hits:
        if -e > reach:
            kept.append((s, -e, priority, label))
            reach = -e
    own = {x[3] for i, x in enumerate(kept) if not (
        (i and kept[i - 1][1] > x[0] and kept[i - 1][2] < x[2]) or (i + 1 < len(kept) and kept[i + 1][0] < x[1] and kept[i + 1][2] < x[2]))}
    base = {x[1] for x in places}
    at = [x[0] for x in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own))


def shares(sizes, weights=(5, 2, 1)):
    """Target per source from its size; sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        share = {s: (goal - sum(fixed.values())) * weight[s] / total for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return {**share, **fixed}
        fixed.update({s: 2.0 * sizes[s] for s in over})
        if len(fixed) == len(order):
            return fixed
