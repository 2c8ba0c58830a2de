"""Added personal data against a plain version of the bootstrapping."""

import math
import re
from collections import defaultdict

import regex

from goldweave.llm import pii
from tests.llm import brute

_OPEN, _CLOSED = "(\\[{<\"'`“„‘«", ")\\]}>\"'`”“’»,;"


def contexts(text, start, stop):
    before = re.sub(f"[{_OPEN}]{{1,4}}\\Z", "", text[max(0, start - 64) : start].lower())
    after = text[stop : stop + 64].lower()
    one, two, closed = r"[^\s]{1,30}\s{1,3}", r"\s{1,3}([^\s]{1,30})", f"^[{_CLOSED}]{{0,4}}"
    found = {
        "2": re.search(rf"((?:{one}){{2}}|[^\s]{{3,30}}[=:])\Z", before, re.ASCII),
        "1": re.search(rf"({one})\Z", before, re.ASCII),
        "label": re.search(r"([^\s:=]{2,30}\s{0,2}[:=])\s{0,3}\Z", before, re.ASCII),
        "next": re.search(closed + two, after, re.ASCII),
        "next 2": re.search(closed + r"(\s{1,3}[^\s]{1,30}\s{1,3}[^\s]{1,30})", after, re.ASCII),
    }
    return [f"{k}|" + re.sub("[0-9]", "0", re.sub(r"\s+", " ", m[1], flags=re.ASCII)) for k, m in found.items() if m and m[1]]


def form(surface):
    if re.fullmatch(r"[0-9\x20().+-]+", surface) and 7 <= len(re.sub("[^0-9]", "", surface)) <= 19:
        return "digits"
    return "email" if re.search(r"@|[\x20\[({<](?i:at)[\x20\])}>]", surface) else None


def fits(shape, kind):
    return shape is None or (kind == "email" if shape == "email" else kind in ("card", "phone", "ip"))


def bootstrapped(rows, rounds=3, least=3, confidence=0.8):
    """{id: spans} for (id, text) rows."""
    base = {i: brute.base_spans(t) for i, t in rows}
    each = []  # id, kind, form, start, stop, surface, contexts
    for i, t in rows:
        loose = [(None, m.start(), m.end()) for m in regex.finditer(pii.LOOSE, t) if not any(a < m.end() and m.start() < b for _, a, b in base[i])]
        for kind, a, b in base[i] + loose:
            held = contexts(t, a, b)
            if held:
                each.append((i, kind, form(t[a:b]), a, b, t[a:b].lower(), held))
    edges = {}
    for _, kind, shape, _, _, surface, held in each:
        for c in held:
            edges[c, surface] = (kind or edges.get((c, surface), (None,))[0], shape)
    places = {(surface, tuple(held)) for _, kind, _, _, _, surface, held in each if kind is None}
    believed, accepted = {}, {}
    while True:
        known = {e: (kind, 1.0) if kind else believed.get(e[1], (None, 0.0)) for e, (kind, _) in edges.items()}
        seeds = defaultdict(int)
        for (c, _), (kind, _) in known.items():
            seeds[c, kind] += kind is not None
        graph = [(c, s, of) for (c, of), n in seeds.items() if of and n >= least for (d, s), (kind, shape) in edges.items() if d == c and (kind or fits(shape, of))]
        belief, patterns = {}, {}
        for _ in range(rounds):
            trust = defaultdict(list)
            for c, s, of in graph:
                kind, sure = known[c, s]
                trust[c, of].append(sure if kind == of else 0.0 if kind else belief.get((s, of), 0.0))
            patterns = {p: sum(x) / (len(x) + 0.5) for p, x in trust.items() if sum(x) / (len(x) + 0.5) >= 0.5}
            doubts = defaultdict(dict)
            for s, held in places:
                for of in {of for c, of in patterns if c in held}:
                    best = max((patterns[c, of], c) for c in held if (c, of) in patterns)
                    doubts[s, of][best] = math.log(max(1 - best[0], 1e-6))
            belief = {k: 1 - math.exp(sum(d.values())) for k, d in doubts.items()}
        for c in {c for (c, _), x in patterns.items() if x >= confidence}:
            accepted.setdefault(c, max((x, of) for (d, of), x in patterns.items() if d == c and x >= confidence))
        now = {}
        for (c, s), (kind, shape) in edges.items():
            if kind is None and c in accepted and fits(shape, accepted[c][1]):
                now[s] = max(now.get(s, (0.0, "")), accepted[c])
        before, believed = len(believed), {s: (of, x) for s, (x, of) in now.items()}
        if len(believed) == before:
            break
    out = {i: set(s) for i, s in base.items()}
    for i, kind, shape, a, b, _, held in each:
        fit = [accepted[c] for c in held if c in accepted and fits(shape, accepted[c][1])]
        if kind is None and fit:
            out[i].add((max(fit)[1], a, b))
    return {i: sorted(s, key=lambda x: (pii.KINDS.index(x[0]), x[1])) for i, s in out.items()}


def test_added_spans_equal_the_plain_version(spark):
    rows = [(i, f"please call me at +1 743 555 {1000 + i} today or mail kim{'abcdefghijklmnopqrst'[i]}@corp.com now") for i in range(20)]
    rows += [(100 + i, f"w{i}x. Phone: +1 743 556-{1000 + i} and host 10.0.{i}.7 is up") for i in range(12)]
    rows += [(200, "you can call me at 555-743-9911 today"), (201, "Phone: (555) 743-9922 now"), (202, "or mail lee at corp dot com now"), (203, "and host 10-0-77-7x1 is down"), (204, "it was made in 1999-12-31 by them")]
    rows += [(300 + i, f"Phone: 743-111-{2000 + i} q{i}a") for i in range(8)] + [(400 + i, f"zz{i}b handset 743-111-{2000 + i}") for i in range(8)]
    rows += [(500, "some handset 743-111-7777"), (501, "some handset 743-111-7777 and Phone: none"), (502, "nothing"), (503, "")]
    rows += [(600 + i, f"order {n} from 4111 1111 1111 {n}") for i, n in enumerate(["1111", "1129", "1137"])] + [(610, "order 9 from 4111 1111 1111 1112")]
    want = bootstrapped(rows)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert sum(len(want[i]) for i in (200, 201, 202, 500)) >= 4 and want[204] == [] and want[502] == []
