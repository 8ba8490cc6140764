"""Small documents with everything that may be odd, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept boolean"


def made(seed: int, n: int = 60) -> list[tuple]:
    """Rows of SCHEMA; the last two columns' names clash with results."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "re", "Én", "on") for b in ("a", "e", "ou") for c in ("", "s", "ñ", "!!", ".", "ing,")]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 260))] for _ in range(6)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2:
            w = list(rng.choice(base))
        elif kind < 0.5:
            w = list(rng.choice(base))
            for _ in range(rng.randint(1, 9)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 49, 50, 51, 200]))]
        if rng.random() < 0.25:
            at = rng.randint(0, len(w))
            w[at:at] = passage[: rng.choice([12, 49, 50, 70])]
        if rng.random() < 0.15:
            w += ["###", "$$", "|"] * 20
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\n", "\t", "\x0b"]) for x in w)
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), len(text), 7, True))
    return [*rows, (n, None, "en", "a", None, 7, None), (n + 1, "", "en", "a", 0, 7, None), (n + 2, " \n\t ", "en", "b", 4, 7, None), (None, rows[3][1], "en", "a", 1, 7, None), rows[3], (n + 3, "x" * 5000 + " " + "word " * 4000, "en", "a", 1, 7, True), (n + 4, rows[3][1], "fr", "b", 1, 7, True), (2, rows[7][1], "fr", "b", 1, 7, True), (None, "of its own and of no other", "fr", "b", 1, 7, True)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = words(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k=4, percent=80):
    """Per row (by place): size and component, by comparing all pairs."""
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and sets[j] and 100 * same >= percent * (len(a) + len(sets[j]) - same) or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def repeats(rows, length=50):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - length + 1):
            if r[0] is not None:
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if r[0] is not None and first[tuple(w[i : i + length])] < r[0]:
                gone[i : i + length] = [True] * length
        out.append((w, gone))
    return out


def hits(rows, items, n=10):
    """Per row: words, hit places, items."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = []
    for item, text in items:
        w = cut(text)
        windows += [(item, w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)] if w else []
    out = []
    for r in rows:
        w, places, found = cut(r[1]), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    places |= set(range(i, i + len(x)))
                    found |= set() if item is None else {str(item)}
        out.append((len(w), places, found))
    return out


def measures(t):
    w = words(t)
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def near(rows, items, n=10, slop=3):
    """Per (id, item): the windows of which an occurrence of the first word has all words within slop of their places."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = Counter()
    for key, text in {(r[0], r[1]) for r in rows}:
        w = cut(text)
        for item, t in items:
            x = cut(t)
            many = 0
            for first in range(max(len(x) - n, 0) + 1) if x else ():
                win = x[first : first + n]
                many += any(w[c] == win[0] and all(win[k] in w[max(c + k - slop, 0) : max(c + k + slop + 1, 0)] for k in range(len(win))) for c in range(len(w)))
            if many:
                out[(key, None if item is None else str(item), many)] += 1
    return out
