"""Conversation repair, SimHash groups and Merkle manifests against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash

from tests.llm import brute
from textloom.llm import merkle, repair, simhash

CONVERSATION = "conv_id long, turn long, role string, text string"
RIGHT = re.compile(r"(s?(ua)+)?")


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def faults(rows):
    """blank, duplicate, truncated or none of each row (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, most_inserts=2):
    """(cost, audit, turns) of the cheapest edits, out of all."""
    found = []
    wrong = faults(rows)
    gap = [list(x) for n in range(most_inserts + 1) for x in itertools.product(("user", "assistant"), repeat=n)]
    each = []
    for (_, role, text), w in zip(rows, wrong, strict=True):
        more = 5 if w == "truncated" else 0
        options = [(2, "D", None)]
        if w not in ("blank", "duplicate"):
            options += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        each.append(options)
    for inserts in itertools.product(gap, repeat=len(rows) + 1):
        for edits in itertools.product(*each):
            cost, audit, turns = 0, "", []
            for n, roles in enumerate(inserts):
                cost, audit = cost + 5 * len(roles), audit + "I" * len(roles)
                turns += [(r, "") for r in roles]
                if n < len(edits):
                    cost, audit = cost + edits[n][0], audit + edits[n][1]
                    turns += [edits[n][2]] if edits[n][2] else []
            if RIGHT.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
                found.append((cost, audit, turns))
    return min(found, key=lambda x: x[:2])


def table(rows):
    """The least (cost, audit) by a table over rows and states, and the turns that are left."""
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    following = {"": "u", "s": "u", "a": "u", "u": "a"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                to = following[state]
                new = (cost + 5, audit + "I", (*turns, ("user" if to == "u" else "assistant", "")))
                best[to] = min(best.get(to, new), new)
        return best

    for (_, role, text), w in zip(rows, faults(rows), strict=True):
        new = {}
        for state, (cost, audit, turns) in inserted(best).items():
            steps = [(state, 2, "D", ())]
            if w not in ("blank", "duplicate"):
                more = 5 if w == "truncated" else 0
                if (state, role[:1]) in kept:
                    steps.append((kept[state, role[:1]], more, "K", ((role, text),)))
                to = following[state]
                steps.append((to, 1 + more, "R", (("user" if to == "u" else "assistant", text),)))
            for to, more, letter, turn in steps:
                made = (cost + more, audit + letter, turns + turn)
                new[to] = min(new.get(to, made), made)
        best = new
    final = inserted(best)
    return min(final[s] for s in ("", "a") if s in final)


def repaired(rows, solve=table):
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, digest); rows are not damaged any more."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers = [r[0] for r in mine if r[0] is not None]
        wrong = faults(mine)
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, turns = solve(mine)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *(wrong.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return out


def dialogues(seed, n, length):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "u", "sys"]
    texts = ["Hi.", "Well, no", "What?", "", " \t\n", "Go!  ", "é…", "Yes.\x0b", "One", "Two."]
    for conv in range(n):
        for turn in range(r.randrange(length + 1)):
            at = r.choice([turn, turn, turn, turn + 2, None])
            yield conv, at, r.choice(roles[: r.choice([2, 3, 7])]), r.choice(texts) if r.random() < 0.7 else f"{r.randrange(100)}."


def summaries(found):
    return {x.conv_id: tuple(x)[1:] for x in found.conversations.collect()}


def test_search_equals_all_edits(spark):
    rows = list(dialogues(1, 400, 3))
    every = repaired(rows, exhaustive)
    assert repaired(rows) == every
    assert summaries(repair.repair(spark.createDataFrame(rows, CONVERSATION))) == every


@pytest.mark.parametrize("long_turns", [repair.LONG_TURNS, 5, 0])
def test_repair_with_and_without_segments(spark, monkeypatch, long_turns):
    """Conversations of any length, by the search at once and cut into segments of two turns."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", 1)
    rows = [*dialogues(2, 120, 12), *((500, i // 3, *x[2:]) for i, x in enumerate(dialogues(3, 40, 8)))]
    rows += [(600, 1, "user", "Same."), (600, 1, "user", "Same."), (600, 1, "user", "Same."), (None, None, "user", "No id."), (None, 2, "assistant", "None at all.")]
    found = repair.repair(spark.createDataFrame(rows, CONVERSATION).repartition(3), long_turns=long_turns)
    want = repaired(rows)
    assert summaries(found) == want
    turns = {}
    for t in sorted(found.turns.collect(), key=lambda t: t.seq):
        turns.setdefault(t.conv_id, []).append(t)
    for conv, (*_, audit, digest) in want.items():
        mine = turns.get(conv, [])
        assert [t.seq for t in mine] == list(range(len(mine)))
        assert "".join(t.edit for t in mine) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == digest


def test_a_long_search_is_quick(spark):
    turns = [repair.Turn(random.Random(n).choice("suat-"), n % 17 == 3, n % 5 == 1) for n in range(1024)]
    for goal in (None, *repair.STATES):
        repair.cheapest(turns, repair.START, goal)


def test_repair_of_damaged_and_odd_tables(spark, tmp_path):
    rows = [*dialogues(4, 300, 6), (None, None, None, None), (7, None, None, "x"), (8, 1, "user", "long. " * 200_000)]
    clash = "cid long, seg long, times long, pos long, n int, long_id long, fault string"
    for name, data, extra in (("plain", rows, ""), ("clashing", [(*x, 1, 2, 3, 4, 5, 6, "x") for x in rows], ", " + clash), ("empty", [], "")):
        spark.createDataFrame(data, CONVERSATION + extra).write.parquet(f"file://{tmp_path}/{name}/conversations.parquet")
    got = {name: {x.conv_id: tuple(x)[1:] for x in repair.query(spark, f"file://{tmp_path}/{name}").collect()} for name in ("plain", "clashing", "empty")}
    gone = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    assert got["plain"] == got["clashing"] == gone | repaired(after_damage(rows))
    assert got["empty"] == {} and any(v[-1] == hashlib.sha256(b"").hexdigest() for v in got["plain"].values())


def plain_fingerprint(text):
    w = brute.words(brute.fold(text))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fingerprints):
    """Each distinct fingerprint's root, the least that can be reached by steps of two bits."""
    root = {f: f for f in fingerprints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {f: find(f) for f in root}


def test_fingerprints_of_blocks():
    for _, text, *_ in brute.awkward():
        for block in (1, 7, 1 << 20):
            if block > 1 or len(text or "") < 10_000:
                assert simhash.fingerprint(text, block=block) == plain_fingerprint(text)


def test_simhash_groups_equal_brute_force(spark, tmp_path):
    r = random.Random(5)
    texts = []
    for _ in range(60):
        base = [f"W{r.randrange(50)}" for _ in range(r.choice([1, 2, 3, 40, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(6)):
            texts.append(r.choice([" ", "\n"]).join(x if r.random() > 0.01 else "other" for x in base).lower())
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(1000 + (x[0] or 0), *x[1:]) for x in brute.awkward()] + [(None, texts[0], "en", "s", 1), (None, "nothing else is like this one", "en", "s", 1)]
    fps = [plain_fingerprint(x[1]) for x in rows]
    roots = linked(set(fps))
    assert len(set(fps)) > len(set(roots.values()))
    least = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = sorted((str(x[0]), f"{f:016x}", str(least.get(roots[f]))) for x, f in zip(rows, fps, strict=True))
    extra = (5, 6, 7, 8)
    schema = brute.SCHEMA + ", fp long, variant long, copies long, root long"
    spark.createDataFrame([(*x, *extra) for x in rows], schema).repartition(3).write.parquet(f"file://{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], brute.SCHEMA).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    got = sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in simhash.query(spark, f"file://{tmp_path}/a").collect())
    assert got == want
    assert simhash.query(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_all_links_of_planted_fingerprints(spark, radius):
    r = random.Random(radius)
    fps = {r.getrandbits(64) for _ in range(40)}
    fps |= {f ^ sum({1 << r.randrange(64) for _ in range(r.randrange(1, 5))}) for f in list(fps) for _ in range(4)}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {(x.a % (1 << 64), x.b % (1 << 64), x.distance) for x in simhash.links(nodes, radius).collect()}
    signed = sorted(fps, key=lambda f: f - (1 << 64) if f >> 63 else f)
    assert got == {(a, b, (a ^ b).bit_count()) for a, b in itertools.combinations(signed, 2) if (a ^ b).bit_count() <= radius}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, path_of):
    """The last node, and the siblings of one on the way there, in order."""
    siblings = []
    while len(nodes) > 1:
        run = path_of // 8
        siblings.append([x for n, x in enumerate(nodes[run * 8 : run * 8 + 8]) if n != path_of % 8])
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        path_of = run
    return nodes[0], [x for level in siblings for x in level]


def plain_manifest(rows):
    by = {}
    for i, text, lang, source, n in rows:
        low = text if text is None else text.encode().lower().decode()
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        own = said(i, source, lang, n, text)
        by.setdefault(lang, []).append((i is not None, i or 0, own, said(i, source, lang, n, low) if hit else own, i))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {lang: sorted(by[lang]) for lang in order}
    subroots = {lang: climb([x[2] for x in leaves[lang]], 0)[0] for lang in order}
    out = []
    for place, lang in enumerate(order):
        for at, (_, _, own, other, i) in enumerate(leaves[lang]):
            _, low = climb([x[2] for x in leaves[lang]], at)
            root, high = climb(list(subroots.values()), place)
            # The tree with the leaf's replacement, grown anew.
            changed, _ = climb([other if n == at else x[2] for n, x in enumerate(leaves[lang])], 0)
            folded, _ = climb([changed if x == lang else subroots[x] for x in order], 0)
            out.append((i, own, subroots[lang], root, H(*low, *high), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_a_tree_grown_anew(spark, levels):
    r = random.Random(6)
    rows = [(i * 3, f"Text {i} é" if i % 7 else None, r.choice(["en"] * 8 + ["de", None, "é", ""]), "s" if i % 5 else None, i) for i in range(200)]
    rows += [(9000 + i, "One", f"lang{i}", "s", 1) for i in range(70)] + brute.awkward()[:9] + [(None, "x", "en", "s", 1)] * 2 + [rows[0]] * 3
    df = spark.createDataFrame(rows, brute.SCHEMA).repartition(5)
    manifest = merkle.build(merkle.tampered(df), merkle.Shape(8, levels))
    got = sorted(map(tuple, merkle.folded(manifest).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_odd_tables(spark, tmp_path):
    extra = "tree string, idx long, size long, grp long, digest string, other string, key long, nodes string, salt long"
    rows = brute.awkward()
    for name, data, more in (("plain", rows, ""), ("clashing", [(*x, "t", 1, 2, 3, "d", "o", 4, "n", 5) for x in rows], ", " + extra), ("one", rows[3:4], ""), ("none", [], "")):
        spark.createDataFrame(data, brute.SCHEMA + more).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
    got = {n: sorted(map(tuple, merkle.query(spark, f"file://{tmp_path}/{n}").collect()), key=str) for n in ("plain", "clashing", "one", "none")}
    assert got["plain"] == got["clashing"] == plain_manifest(rows)
    assert got["one"] == plain_manifest(rows[3:4]) and got["one"][0][1] == got["one"][0][3]
    assert got["none"] == []
