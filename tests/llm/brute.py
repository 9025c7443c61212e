"""Plain Python versions of what the queries must return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(_LOWER)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rule_signals(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] >= 2:
            hit |= {i, i + 1, i + 2}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


def contamination(texts, items, window=10):
    """Rows (n_words, n_hit, n_items, items_sha256, contaminated) of the texts."""
    known = {}
    for name, text in items:
        words = ALNUM.findall(lower(text))
        size = min(window, len(words))
        if size:
            for i in range(len(words) - size + 1):
                known.setdefault(tuple(words[i : i + size]), set()).add(name)
    sizes = {len(k) for k in known}
    out = []
    for text in texts:
        words, hit, names = ALNUM.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                found = known.get(tuple(words[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    names |= found
        names.discard(None)
        out.append((len(words), len(hit), len(names), sha(",".join(sorted(map(str, names)))), bool(hit)))
    return out


def shingles(text):
    words = SPACED.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(ids, sets, share=75):
    """Smallest id each id reaches over links of sets that are similar enough; quadratic."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = list(zip(ids, sets))
    for a, (i, x) in enumerate(rows):
        for j, y in rows[a + 1 :]:
            if x and y and 100 * len(x & y) >= share * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in ids}


def repeats(texts, size=200):
    """Per text the mask of bytes that a string of ``size`` bytes, found elsewhere too, covers."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    masks = []
    for r in raws:
        mask = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                mask[i : i + size] = b"\x01" * size
        masks.append((r, mask))
    return masks


def repeat_rows(texts, size=200):
    out = []
    for raw, mask in repeats(texts, size):
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        out.append((len(raw), sum(mask), spans, sha(bytes(b for b, m in zip(raw, mask) if not m))))
    return out


_SECRETS = [
    ("assign", re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def secrets(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(_SECRETS):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(found)]
