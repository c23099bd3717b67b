"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(fold(text or ""))


def repeats(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, spans, sha256 of the rest) by comparing all windows."""
    texts = [(name, (text or "").encode()) for name, text in rows]
    seen = collections.Counter(data[p : p + length] for _, data in texts for p in range(len(data) - length + 1))
    out = []
    for name, data in texts:
        spans: list[list[int]] = []
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        edges = [0, *itertools.chain(*spans), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append((name, tuple(map(tuple, spans)), hashlib.sha256(kept).hexdigest()))
    return out


def weighted_sets(texts: list[str], width: int = 5) -> list[dict]:
    """tf * idf of the shingles of each text."""
    counts = []
    for text in texts:
        own = words(text)
        counts.append(collections.Counter(tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1))) if own else {})
    found = collections.Counter(shingle for one in counts for shingle in one)
    scale = math.log(1 + max(1, len(texts)))
    return [{s: n * (1 + math.log((1 + len(texts)) / found[s]) / scale) for s, n in one.items()} for one in counts]


def weighted_jaccard(a: dict, b: dict) -> float:
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def components(count: int, links) -> list[int]:
    parent = list(range(count))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(count)]


def contamination(documents: list[tuple], items: list[tuple], width: int) -> dict:
    """doc_id -> (words, hit words, items)."""
    windows = collections.defaultdict(set)
    for name, text in items:
        own = words(text)
        for k in range(max(1, len(own) - width + 1) if own else 0):
            windows[tuple(own[k : k + width])].add(str(name))
    sizes = {len(window) for window in windows}
    out = {}
    for name, text in documents:
        own, hit, met = words(text), set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                if found := windows.get(tuple(own[k : k + size])):
                    hit.update(range(k, k + size))
                    met |= found
        out[name] = (len(own), len(hit), sorted(met))
    return out


def collocations(rows: list[tuple], least: int, best: int = 2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from dictionaries of all phrases."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(text or "")):
            parts = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(parts)
            for size in (1, 2, 3):
                counts[lang].update(tuple(parts[at : at + size]) for at in range(len(parts) - size + 1))
    out = []
    for lang, count in counts.items():
        candidates = {phrase: a for phrase, a in count.items() if len(phrase) > 1 and a >= least}
        inside = {part for phrase, a in candidates.items() if len(phrase) == 3 for part in (phrase[:2], phrase[1:]) if 100 * a >= 50 * count[part]}
        scored = []
        for phrase, a in candidates.items():
            if phrase not in inside:
                sides = [(count[phrase[:k]], count[phrase[k:]]) for k in range(1, len(phrase))]
                score, left, right = min(((10**6 * a * a // (x * y), x, y) for x, y in sides), key=lambda one: one[0])
                scored.append((-score, -a, " ".join(phrase).encode(), left, right))
        ordered = sorted(scored)[:best]
        out += [(lang, rank, phrase.decode(), -a, left, right, totals[lang], -score) for rank, (score, a, phrase, left, right) in enumerate(ordered, 1)]
    return sorted(out)
