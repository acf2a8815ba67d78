"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def near_classes(rows):
    """(doc_id, n_shingles, component_id) for (doc_id, text) rows with distinct ids or equal rows."""
    sets = []
    for _, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        for s in own:
            holders[s].append(i)
    both = Counter((b, a) for own in holders.values() for a in own for b in own if b < a)
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    classes = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            classes[find(i)].append(k)
    return sorted(
        ((k, len(sets[i]), min(classes[find(i)]) if k is not None else None) for i, (k, _) in enumerate(rows)), key=repr
    )


def cut_passages(rows, window=20):
    """(doc_id, n_words, n_removed, kept text) for (doc_id, text) rows."""
    low = float("-inf")
    first = {}
    for k, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            place = (low if k is None else k, i)
            first[tuple(w[i : i + window])] = min(first.get(tuple(w[i : i + window]), place), place)
    out = []
    for k, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if (low if k is None else k, i) > first[tuple(w[i : i + window])]:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def spans(text):
    """(n_assign, n_access, n_hex, listing) of the base kinds."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    kinds = (("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    found = [
        (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
        for rank, (kind, pattern, group, least) in enumerate(kinds)
        for m in pattern.finditer(text or "")
        if len(m.group(group)) >= least
    ]
    counts = Counter(r for _, r, _ in found)
    return counts[0], counts[1], counts[2], ",".join(x for *_, x in sorted(found))


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)
