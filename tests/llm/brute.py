"""Plain versions of the operators, for small inputs, and awkward documents for all of them."""

import hashlib
import re

WHITE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with columns whose names operators use themselves.
CLASHING = SCHEMA + ", d long, k long, digest string, node long, words array<string>, score double, kept boolean, h long, _tl_id long"


def fold(text):
    return (text or "").encode().lower().decode()


def words(text):
    return [w for w in re.split(WHITE, text or "") if w]


def awkward():
    """Nulls, empty and white texts, repeated rows, ties, surrogate pairs, a very long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    texts = [None, "", " \n\t", "one", "a b c d e f", "a b c d e f", "A B  c\td e f", "é😀 ñ " * 30, "x" * 5000, long, long, "line\nline\n\nline two is here for everyone to see\nline two is here for everyone to sea"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "a b c d e f", None, None, 1), (None, None, None, None, None)]


def frames(spark):
    rows = awkward()
    extra = (5, 6, "x", 7, ["w"], 0.5, False, 8, 9)
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(*r, *extra) for r in rows], CLASHING), spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = words(fold(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(docs, n, percent=80):
    """doc_id to the smallest doc_id reachable; docs are (id, text) with distinct ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def removals(docs, window):
    """(id, words, removed, digest) of each document."""
    seen = {}
    for _, text in docs:
        w = words(text)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, text in docs:
        w = words(text)
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(following[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


def line_summaries(docs, threshold=2, min_chars=20):
    """(id, lines, links, removed, digest) of each document; docs are (id, text) with distinct ids."""
    tidy = {i: [(at, line) for at, x in enumerate((t or "").split("\n")) if (line := re.sub(WHITE, " ", x).strip(" "))] for i, t in docs}
    names = sorted({line for lines in tidy.values() for _, line in lines})
    root, degree = {x: x for x in names}, dict.fromkeys(names, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(names):
        for b in names[:n]:
            if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold:
                degree[a], degree[b] = degree[a] + 1, degree[b] + 1
                root[find(a)] = find(b)
    head = {}
    for i, lines in tidy.items():
        for at, line in lines:
            place = (2**63 if i is None else i, at)
            head[find(line)] = min(head.get(find(line), place), place)
    out = []
    for i, lines in tidy.items():
        kept = [line for at, line in lines if head[find(line)] == (2**63 if i is None else i, at)]
        digest = hashlib.sha256(",".join(hashlib.md5(x.encode()).hexdigest() for x in kept).encode()).hexdigest()
        out.append((i, len(lines), sum(degree[line] for _, line in lines), len(lines) - len(kept), digest))
    return out
