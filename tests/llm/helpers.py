"""Plain versions of the contracts' definitions, for comparison on small tables."""

import re
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def space_words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def near_groups(rows, k, percent):
    """doc_id -> (set size, component) by comparing every pair."""
    sets = {}
    for d, t in rows:
        w = space_words(t)
        sets[d] = {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = components(ids, links)
    return {d: (len(sets[d]), group[d]) for d in ids}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines_left(rows, min_words=5, near_words=8):
    """doc_id -> text without the lines that stand earlier, equal or one word edit off."""
    seen, out = [], {}
    for d, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            w = space_words(line)
            hit = len(w) >= min_words and any(w == s or (min(len(w), len(s)) >= near_words and abs(len(w) - len(s)) <= 1 and edits(w, s) <= 1) for s in seen)
            if not hit:
                keep.append(line)
            if len(w) >= min_words:
                seen.append(w)
        out[d] = "\n".join(keep)
    return out


def passages(rows, items, window=10):
    """doc_id -> (words, hit words, ids of items found)."""
    pats = defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            pats[tuple(w[k: k + window])].add(str(i))
    out = {}
    for d, t in rows:
        w, hit, ids = alnum_words(t), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                p = tuple(w[k: k + n])
                if p in pats:
                    hit |= set(range(k, k + n))
                    ids |= pats[p]
        out[d] = (len(w), len(hit), ",".join(sorted(ids)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def seeds(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")),
                    "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def quality_counts(text):
    w = space_words(text, lower=False)
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k: k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)
