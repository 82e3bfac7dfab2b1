"""Small tables with the awkward cases, and plain statements of what the operators return."""

from __future__ import annotations

import hashlib
import itertools
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, raw int, key string"


def table(spark, rows):
    """Documents (doc_id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, None) for i, t, s in rows], SCHEMA)


def essay(k, n=60):
    return " ".join(f"w{k}x{i * 7 % 53}" for i in range(n))


def awkward():
    long_text = " ".join(f"long{i}" for i in range(30_000))
    near = essay(3).split()
    return [
        (1, essay(1), "a"), (2, essay(1).replace(" ", "\t\n", 3), "a"), (3, essay(2), None), (4, None, "b"), (5, "", "b"), (6, "   \n", None),
        (7, " ".join(near), "c"), (8, " ".join([*near[:59], "other"]), "c"), (9, " ".join(["first", *near[1:]]), "a"), (10, "Two words", "a"), (11, "two WORDS", "a"),
        (12, long_text, "b"), (13, long_text + " end", "b"), (14, "intro words here " + essay(2)[:200] + " outro", "c"), (14, "intro words here " + essay(2)[:200] + " outro", "c"),
        (None, essay(1), "a"), (None, "nobody knows this one", None), (20, "\u00e9t\u00e9 \u00a0 na\u00efve \U0001f600 " + essay(4), "a"),
    ]


def exact(rows):
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def windows_removed(rows, n=13):
    words = [WORDS.findall(t or "") for _, t, _ in rows]
    order = [2**63 - 1 if i is None else i for i, _, _ in rows]
    first: dict[tuple, int] = {}
    for w, i in zip(words, order):
        for p in range(len(w) - n + 1):
            first[tuple(w[p : p + n])] = min(i, first.get(tuple(w[p : p + n]), i))
    out = []
    for (i, _, _), w, place in zip(rows, words, order):
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < place:
                gone.update(range(p, p + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(rows, n, percent):
    """(doc_id, set size, component, links) by comparing all pairs; for rows with ids, none repeated."""
    sets = [shingles(t, n) for _, t, _ in rows]
    comp, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}
    for (a, x), (b, y) in itertools.combinations(zip([r[0] for r in rows], sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            links[a] += 1
            links[b] += 1
            low, high = sorted((comp[a], comp[b]))
            comp = {k: low if v == high else v for k, v in comp.items()}
    return [(i, len(s), comp[i], links[i]) for (i, _, _), s in zip(rows, sets)]


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
