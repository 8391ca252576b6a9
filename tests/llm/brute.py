"""Plain-loop versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\f\r"


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def drop_lines(docs: list[tuple], min_chars: int = 10) -> list[tuple]:
    """(id, kept text) in the order of the input."""
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            holders[line.strip(WHITE).translate(LOW)].add(doc_id)
    out = []
    for doc_id, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            key = line.strip(WHITE).translate(LOW)
            if len(key) < min_chars or len(holders[key]) < 2 or doc_id == min(holders[key]):
                kept.append(line)
        out.append((doc_id, "\n".join(kept)))
    return out


def near_classes(docs: list[tuple], threshold: float = 0.8, n: int = 5) -> dict:
    """id -> (class id, links); ids must be unique."""
    sets = {}
    for doc_id, text in docs:
        w = words(text)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets[doc_id] = grams
    holders = defaultdict(list)
    for doc_id, grams in sets.items():
        for g in grams:
            holders[g].append(doc_id)
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    links = Counter()
    for doc_id, grams in sets.items():
        common = Counter(e for g in grams for e in holders[g] if e != doc_id)
        for e, k in common.items():
            if k >= threshold * (len(grams) + len(sets[e]) - k) - 1e-9:
                links[doc_id] += 1
                a, b = find(doc_id), find(e)
                top[max(a, b)] = min(a, b)
    return {d: (find(d), links[d]) for d in sets}


def contaminated(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """id -> (words, hit words, item ids)."""
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item_id)
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                if key in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        out[doc_id] = (len(w), len(hit), found)
    return out


def repeated_bytes(docs: list[tuple], length: int) -> list[tuple]:
    """(id, bytes, removed, runs, kept bytes) in the order of the input."""
    texts = [(doc_id, (text or "").encode()) for doc_id, text in docs]
    counts = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _fits(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        back = [int(d) for d in reversed(digits)]
        return 12 <= len(digits) <= 19 and sum(d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(back)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def personal(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats."""
    return sorted(
        (m.start(), k, m.end())
        for k, (kind, regex) in enumerate(KINDS.items())
        for m in re.finditer(regex, text or "")
        if _fits(kind, m.group())
    )
