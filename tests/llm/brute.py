"""Plain, slow versions of the operators, to hold results against."""

import hashlib
import re
from collections import Counter, defaultdict

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(number):
    worth = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(w - 9 if w > 9 else w for w in worth) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            number = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def bench_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def decontaminated(docs, items, size=10):
    """doc texts and (item_id, text) pairs: (n_words, n_hit, n_items, sha256) for each text."""
    by = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        if words and item is not None:
            for i in range(max(1, len(words) - size + 1)):
                by[tuple(words[i : i + size])].add(str(item))
    lengths = {len(w) for w in by}
    out = []
    for text in docs:
        words = bench_words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                ids = by.get(tuple(words[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def shingles(text, size=5):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else Counter()


def weighted_jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def classes(rows, threshold=0.8):
    """{id: least id of its class} for (id, text) rows, by all pairs that share a shingle."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(i, j):
        i, j = sorted((find(i), find(j)))
        root[j] = i

    first = {}
    for i, t in rows:
        if t is not None:
            unite(i, first.setdefault(t, i))
    bags = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            holders[s].append(i)
    seen = set()
    for ids in holders.values():
        for x in range(len(ids)):
            for y in range(x):
                pair = (ids[y], ids[x])
                if pair not in seen:
                    seen.add(pair)
                    if weighted_jaccard(bags[pair[0]], bags[pair[1]]) >= threshold:
                        unite(*pair)
    return {i: find(i) for i, _ in rows}
