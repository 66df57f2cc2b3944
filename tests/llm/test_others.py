import gzip
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.test_rows import _shuffle_records
from textloom.llm import counts, decontam, exact, lines, neardup, packing, pii, toxicity, warc
from textloom.storage import new_path

public = pytest.importorskip("public_tokenizers")


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("run", [packing.production, pii.summaries, lambda d: decontam.contamination(d, d.sparkSession.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).drop("d", "k")])
def test_awkward_documents(spark, run):
    plain, clashing, empty = brute.frames(spark)
    one = lambda df: sorted(map(repr, run(df.coalesce(1)).collect()))
    assert one(plain) == one(clashing)
    assert len({r.doc_id for r in run(plain).collect()}) == 13
    assert run(empty).count() == 0


def test_packing_round_trip(spark):
    """Every id of every document lies in exactly one piece, and windows are full or powers of two."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = [(i, t) for i, (_, t, *_) in enumerate(brute.awkward())] + [(100, "see <|endoftext|> here")]
    pieces = packing.production(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    ids = {i: [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 0] for i, t in docs}
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for i, found in by_doc.items():
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    for found in by_window.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == found[0].window <= 1024 and at & (at - 1) == 0
    groups = {}
    for w in {(p.sequence_id, p.window, p.step_group) for p in pieces}:
        groups.setdefault(w[2], set()).add(w[1])
    assert all(len(sizes) == 1 for sizes in groups.values())


def test_packer_makes_few_pieces():
    r = random.Random(1)
    packer = packing.Packer(packing.TIERS, 4096, 0)
    lengths = [r.randrange(1, 3000) for _ in range(500)]
    for i, n in enumerate(lengths):
        packer.add(i, np.zeros(n, np.uint32))
    packer.pack()
    assert sum(row[2] for row in packer.rows) == sum(lengths)
    assert len(packer.rows) < sum(n // 1024 + 1 for n in lengths) * 1.6


@pytest.mark.parametrize("block", [64, 4096, 1 << 22])
def test_token_counts_across_blocks(spark, block):
    from textloom.llm.tokens import encode

    docs = [(i, t) for i, (_, t, *_) in enumerate(brute.awkward())]
    ranks, path = public.path("byte_bpe_multi_50k.tiktoken"), new_path(spark, "tokens")
    known = counts.write_token_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), path, ranks, 50256)
    got = known.join(counts.count_files(spark, path, 50256, block_bytes=block), ["shard", "ordinal"])
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(encode(t, ranks)) for i, t in docs}


def test_files_without_a_last_separator(spark, tmp_path):
    (tmp_path / "00000001.tokens").write_bytes(np.array([5, 9, 9, 5, 5, 5], "<u2").tobytes())
    (tmp_path / "00000002.tokens").write_bytes(b"")
    (tmp_path / "00000003.tokens").write_bytes(np.array([5, 9], "<u2").tobytes())
    for block in (2, 4, 6, 100):
        got = counts.count_files(spark, f"file://{tmp_path}", 9, block_bytes=block).collect()
        assert sorted((r.shard, r.ordinal, r.start, r.n_tokens) for r in got) == [(1, 0, 0, 1), (1, 1, 2, 0), (1, 2, 3, 3), (3, 0, 0, 1)]


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "v", None), (None, "w", big), (None, None, None), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archive = warc.write(pages, new_path(spark, "warc"), roll_bytes=300, shard_bytes=1000)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(archive).collect()), key=str)
    want = [(1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (None, 1200, "revisit", 2), (None, 0, "response", None)]
    assert got == sorted(want, key=str)
    assert archive.manifest.count() > 2
    again = warc.write(pages.repartition(5), new_path(spark, "warc"), roll_bytes=300, shard_bytes=1000)
    assert sorted(map(tuple, again.manifest.collect())) == sorted(map(tuple, archive.manifest.collect()))
    name = archive.manifest.first().file
    with gzip.open(f"{archive.path.removeprefix('file://')}/{name}") as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: ")
    empty = warc.write(pages.limit(0), new_path(spark, "warc"))
    assert warc.read(empty).count() == 0


def test_warc_bytes_do_not_depend_on_the_cluster(spark):
    """Other partitions of the input and other numbers of tasks give the same files."""
    pages = spark.range(12_000).selectExpr("id page_id", "concat('http://h/', hash(id) % 5000) url", "repeat(concat('text ', id % 7000, ' '), cast(1 + id % 40 as int)) html")
    manifests, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for parts, tasks in ((3, 4), (11, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        archive = warc.write(pages.repartition(parts, F.rand(parts)), new_path(spark, "warc"), roll_bytes=20_000, shard_bytes=400_000)
        manifests.append(sorted(map(tuple, archive.manifest.collect())))
        assert warc.read(archive).count() == 12_000
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert manifests[0] == manifests[1]
    assert len(manifests[0]) > 20


def test_warc_of_a_very_long_payload(spark):
    pages = spark.createDataFrame([(1, "u", "long é " * 900_000), (2, "v", "short")], "page_id long, url string, html string")
    archive = warc.write(pages, new_path(spark, "warc"))
    got = {r.page_id: (r.payload_bytes, hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest) for r in warc.read(archive).collect()}
    assert got == {1: (8 * 900_000, True), 2: (5, True)}


def test_decontamination_of_short_items_and_proximity(spark):
    items = [(1, "alpha beta"), (2, "one two three four five six seven eight nine ten eleven"), (3, ""), (4, None), (None, "x"), (1, "alpha beta")]
    docs = [(1, "say Alpha-BETA twice: alpha beta"), (2, "zero one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine and ten eleven"), (4, None), (5, "two three four five six seven eight nine ten eleven alpha")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (6, 4, ["1"]), 2: (11, 10, ["2"]), 3: (12, 0, []), 4: (0, 0, []), 5: (11, 10, ["2"])}
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [3, 4]
    near = {(r.doc_id, r.item_id) for r in decontam.proximity(docs, items, slop=2).collect()}
    assert {(1, 1), (2, 2), (3, 2), (5, 2)} <= near


def test_the_index_makes_words_once_and_sorts_by_a_number(spark):
    texts = {1: "Alpha-BETA, alpha é", 2: None, 3: " .,;", 4: "", 5: "alpha"}
    rows = decontam.index_rows(spark.createDataFrame(texts.items(), "doc_id long, text string").coalesce(1))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("Sort [xxhash64(word") == 1
    got = [(r.word, r.d, r.pos) for r in rows.collect()]
    assert sorted(got) == sorted([("alpha", 1, 0), ("beta", 1, 1), ("alpha", 1, 2), ("é", 1, 3), ("", 1, 4), ("alpha", 5, 0), ("", 5, 1)])
    assert len([i for i in range(len(got)) if i == 0 or got[i][0] != got[i - 1][0]]) == 4


@pytest.mark.parametrize("most", [100, 0])
def test_decontamination_moves_only_wanted_postings_of_a_large_lookup(spark, monkeypatch, most):
    """Candidate documents are long, and what is looked up in them is beyond the bound of a broadcast; they themselves are, or are not."""
    item = " ".join(f"item{i}" for i in range(12))
    texts = [(i, " ".join([*(f"w{i}x{j}" for j in range(500)), item, *(f"v{i}x{j}" for j in range(500))])) for i in range(20)]
    docs, benchmark = spark.createDataFrame([*texts, (20, "nothing of it")], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    index, tests = decontam.build_index(docs, new_path(spark, "index")), decontam.items(benchmark)
    found = decontam.diagonals(index, decontam.anchored(tests, index))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matches = decontam.exact_matches(index, found, tests)
        assert [list(r.starts) for r in matches.collect()] == [[0, 1, 2]] * 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(_shuffle_records(matches._jdf.queryExecution().executedPlan())) < 2_000 < 20 * 1_012


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            out += [(kind, *m.span())] if ok else []
    return out


def test_token_counts_of_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, clashing columns."""
    plain, clashing, empty = brute.frames(spark)
    for name, df in (("plain", plain), ("clashing", clashing), ("empty", empty)):
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
    got = {name: sorted(map(repr, counts.query(spark, f"file://{tmp_path}/{name}").collect())) for name in ("plain", "clashing", "empty")}
    assert got["plain"] == got["clashing"] and len(got["plain"]) == len(brute.awkward()) and got["empty"] == []


def test_pii_base_spans_equal_brute_force(spark):
    r = random.Random(3)
    parts = ["a", "@", ".", "1", "23", "456", "-", " ", "+1", "(", ")", "x@y.de", "é😀", "4111 1111 1111 1111", "10.0.0.1", "255", "%"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for i in range(400)]
    docs += [(1000, "1" * 30000), (1001, "a" * 30000), (1002, "1 " * 30000), (1003, "1." * 20000), (1004, "x@y.z " * 2000)]
    got = {x.doc_id: x for x in pii.summaries(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        want = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in FORMS] == [sum(x[0] == k for x in want) for k in FORMS]


def test_pii_bootstrap_finds_unseen_identifiers_in_learnt_contexts(spark):
    docs = [(i, f"please call my phone at +1 555 123 {1000 + i} thanks") for i in range(20)]
    docs += [(100, "please call my phone at A7788Z thanks"), (101, "the part number was A7788X thanks"), (102, "room 12345")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.summaries(df).collect()}
    assert got[100] == "phone:24:30" and got[101] == "" and got[102] == ""
    assert {x.doc_id: x.text for x in pii.redact(df).where("doc_id >= 100").collect()}[100] == "please call my phone at <PHONE> thanks"


def all_spans(docs):
    """(kind, start, stop) of every span of every document: base forms, seed secrets, and a plain bootstrap."""
    import regex
    import xxhash

    def mentions(i, text, form):
        found = list(regex.finditer(form, text))
        for n, m in enumerate(found):
            before = text[found[n - 1].end() if n else 0 : m.start()][-80:]
            after = text[m.end() : found[n + 1].start() if n + 1 < len(found) else len(text)][:80]
            yield i, m.start(), m.end(), m[0], before, after

    def patterns(before, after):
        def parts(x):
            return regex.findall(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]", re.sub("[0-9]+", "0", brute.fold(x)))

        left, right = parts(before), parts(after)[:1]
        for n in (1, 2, 3):
            if len(left) >= n:
                yield (n, *left[-n:])
                if right:
                    yield (n, *left[-n:], "_", right[0])

    spans, seeds, others = {}, [], []
    for i, text in docs:
        base = base_spans(text)
        spans[i] = set(base)
        starts = {(k, a, b) for k, a, b in base}
        for kind, form in FORMS.items():
            seeds += [(*m, kind) for m in mentions(i, text, form) if (kind, m[1], m[2]) in starts]
        shared = xxhash.xxh64_intdigest(text.encode(), 42) % pii.SEED_SHARE == 0
        secret = rf'(?<=\b(?:{"|".join(pii.KEY_WORDS)}) ?= ?")[0-9a-f]{{32,}}+(?=")'
        mine = [(*m, "secret") for m in mentions(i, text, secret) if shared and not any(a < m[2] and b > m[1] for _, a, b in base)]
        seeds += mine
        spans[i] |= {("secret", m[1], m[2]) for m in mine}
        token = r"""(?<![A-Za-z0-9._@+-])(?=(?:[A-Za-z._@+-]*+[0-9]){4})[A-Za-z0-9._@+-]++|(?<=[=:] ?["']?)[A-Za-z0-9._@+-]{4,}+"""
        for _, a, b, value, before, after in mentions(i, text, token):
            bare = value.strip("._@+-")
            lead = len(value) - len(value.lstrip("._@+-"))
            if len(bare) >= 4 and not any(x < a + lead + len(bare) and y > a + lead for _, x, y in spans[i]):
                others.append((i, a + lead, a + lead + len(bare), bare, before + value[:lead], value[lead + len(bare) :] + after, None))
    kinds = {*(x[6] for x in seeds)}
    values, by_seed, in_share = {}, {}, {}
    share = {i for i, text in docs if xxhash.xxh64_intdigest(text.encode(), 42) % pii.SEED_SHARE == 0}
    for x in seeds + others:
        for p in patterns(x[4], x[5]):
            values.setdefault(p, set()).add(x[3])
            if x[0] in share:
                in_share.setdefault(p, set()).add(x[3])
            if x[6]:
                by_seed.setdefault((p, x[6]), set()).add(x[3])
    usable = [k for k, v in by_seed.items() if len(v) >= pii.SUPPORT]
    certain = {(x[3], x[6]): 1.0 for x in seeds}
    believed, good = dict(certain), {}
    for n in range(pii.ROUNDS):
        count = lambda p, k: len(values[p] if n or k != "secret" else in_share[p])  # noqa: E731, B023
        good = {(p, k): sum(believed.get((v, k), 0.0) for v in values[p]) / count(p, k) for p, k in usable}
        good = {x: c for x, c in good.items() if c >= pii.PATTERN_LIMIT}
        doubt = {}
        for v, k in {(x[3], k) for x in others for k in kinds}:
            ps = {p for x in others if x[3] == v for p in patterns(x[4], x[5]) if (p, k) in good}
            if ps:
                doubt[v, k] = 1 - np.prod([1 - min(good[p, k], 0.999) for p in ps])
        believed = doubt | certain
    for x in others:
        sure = [(doubt[x[3], k], k) for k in kinds if doubt.get((x[3], k), 0) >= pii.INSTANCE_LIMIT]
        if sure and any((p, max(sure)[1]) in good for p in patterns(x[4], x[5])):
            spans[x[0]].add((max(sure)[1], x[1], x[2]))
    return {i: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(x, key=lambda s: (pii.ALL_KINDS.index(s[0]), *s[1:]))) for i, x in spans.items()}


def test_pii_spans_equal_brute_force(spark):
    """Secrets in upper case, cut short or of other letters are found by the contexts of those of the seed form."""
    r = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(26)]

    def some(n):
        return " ".join(r.choice(words) for _ in range(n))

    def hexes(n):
        return "".join(r.choice("0123456789abcdef") for _ in range(n))

    docs = []
    for i in range(400):
        secret = r.choice([*[hexes(40) for _ in range(16)], hexes(40).upper(), hexes(12), f"Zq-{hexes(20)}_x"])
        said = r.choice([*[f'token = "{secret}"'] * 5, f'my TOKEN = "{secret}"!!', f"part {r.randrange(10**6)} of 12345", f"at: {some(1)}", f"mail {some(1)}.{i}@h.example.com now"])
        docs.append((i, f"{some(r.randrange(5))} {said} {some(r.randrange(5))}"))
    docs += [(1000, ""), (1001, 'token = "' + "ab12" * 5000 + '"'), (1002, "-" * 20_000 + "1" * 5), (1003, "a." * 20_000)]
    assert sum("token" in t.lower() and not re.search('token = "[0-9a-f]{32,}"', t) for _, t in docs) > 5
    got = {x.doc_id: x for x in pii.summaries(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = all_spans(docs)
    assert {i: x.spans for i, x in got.items()} == want
    assert all(x.n_spans == len([s for s in x.spans.split(",") if s]) for x in got.values())
    # The context finds the rest of what was planted and nothing else.
    planted = {i for i, t in docs if re.search("(?i)token = ", t)}
    assert {i for i, x in got.items() if "secret:" in x.spans} == planted


def toxic_corpus(spark, n=1200):
    r = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        bad = r.random() < 0.15
        text = [f"word{r.randrange(500)}" for _ in range(r.randrange(5, 60))]
        if bad:
            for _ in range(r.randrange(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(["Nastyword", "VILEWORD!!", "meanword."]))
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels_for(spark, marks), dict((m[0], m[2]) for m in marks)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_corpus(spark)
    found = toxicity.verdicts(docs, labels).collect()
    out = [r for r in found if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert sorted(map(tuple, toxicity.verdicts(docs, labels).collect())) == sorted(map(tuple, found))


def test_toxicity_features_come_from_all_training_rows(spark):
    """A word that few sampled positives have is chosen all the same; copies of a text count once."""
    docs = [(i, f"plain words {i}" + (f" bad{i % 60 // 3}" if i % 3 == 0 else "")) for i in range(3000)]
    frame = spark.createDataFrame([*docs, *docs[:30], *((i + 3000, "copied nastyword") for i in range(90))], "doc_id long, text string")
    labels = labels_for(spark, [(i, 1, int(i % 3 == 0 or i >= 3000)) for i in range(3090)])
    rows, n = toxicity.training_texts(frame, labels)
    learnt = {t for i, t in docs if zlib.crc32(str(i).encode()) % 3 != 1} | {"copied nastyword"}
    assert sorted((r.text, r.positive) for r in rows.collect()) == sorted((t, int("bad" in t or "nasty" in t)) for t in learnt)
    assert n == (sum("bad" in t or "nasty" in t for t in learnt), len(learnt))
    want = toxicity.learn(frame, labels).words
    assert len(want) >= 20
    assert (toxicity.learn(frame, labels, sample=(30, 90)).words == want).all()


def test_toxicity_without_anything_to_learn(spark):
    plain, clashing, empty = brute.frames(spark)
    for labels in (labels_for(spark, []), labels_for(spark, [(1, 1, 0), (None, 1, 1), (3, None, None)])):
        got = toxicity.verdicts(plain, labels).collect()
        assert len(got) == len(brute.awkward()) and all(r.predicted == 0 for r in got)
        assert toxicity.verdicts(empty, labels).count() == 0
    model = toxicity.learn(clashing, labels)
    assert toxicity.reject(clashing, model).columns == clashing.columns


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs, labels, truth = toxic_corpus(spark, 300)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passage = " ".join(f"bench{j}" for j in range(12))
    clean = next(t for i, t in rows if not truth[i] and len(t.split()) > 30)
    rows += [(1000, clean), (1001, clean.replace(" ", "  ")), (1002, clean + " more"), (1003, f"start {passage} end"), (1004, None), (1005, "")]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], brute.SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in truth.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns = df.columns
    left = dict(rows)
    for name, stage in pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == columns
        got = {r.doc_id for r in df.collect()}
        if name == "toxicity":
            scored = {r.doc_id for r in toxicity.verdicts(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("score < 0.7").collect()}
            assert got == scored
        elif name == "exact_dedup":
            best = {}
            for i, t in left.items():
                key = re.sub(brute.WHITE, "", t or "")
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
            assert got == {i for _, i in best.values()}
        elif name == "near_dedup":
            assert got == set(brute.near_components(sorted(left.items()), 5).values())
        else:
            assert got == {i for i, t in left.items() if passage not in (t or "")}
        left = {i: t for i, t in left.items() if i in got}
    pieces = pipeline.STAGES[-1][1](spark, df, folder)
    assert {r.doc_id for r in pieces.collect()} == set(left)
    assert pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]
    assert json.dumps(pipeline.ORACLE_SQL) == "null"


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Ids on several texts, null ids, repeated rows, clashing columns; nothing to learn from and nothing to test against."""
    import corpus_pipeline as pipeline

    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    single = " ".join(f"u{i}" for i in range(20))
    rows = [(3, base), (5, base + " end"), (5, other), (None, base + "  "), (None, None), (7, other.upper()), (9, single), (9, single)]
    extra = (5, 6, "x", 7, ["w"], 0.5, False, 8, 9)
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", 1, *extra) for i, t in rows], brute.CLASHING).write.parquet(f"{folder}/odd/documents.parquet")
    spark.createDataFrame([], brute.SCHEMA).write.parquet(f"{folder}/none/documents.parquet")
    for name in ("odd", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
    df = spark.read.parquet(f"{folder}/odd/documents.parquet")
    columns = df.columns
    for _, stage in pipeline.STAGES[:-1]:
        df = stage(spark, df, f"{folder}/odd")
        assert df.columns == columns
    want = [(5, base + " end"), (5, other), (None, base + "  "), (None, None), (9, single), (9, single)]
    assert sorted(((r.doc_id, r.text) for r in df.collect()), key=str) == sorted(want, key=str)
    assert all(tuple(r)[5:] == extra for r in df.collect())
    assert pipeline.run(spark, f"{folder}/odd").where("start = 0").count() == len(want)
    assert pipeline.run(spark, f"{folder}/none").count() == 0


#: Names that operators use, or have used, for columns of their own, and names that need quotes.
OWN = ("_key0", "_KEY1", "_key2", "_key3", "_key4", "_key5", "_key6", "_key7", "_tl_id", "_tl_digest", "_tl_points", "_tl_hash", "_tl_d", "_tl_k", "_tl_doc", "_tl_gone", "d", "k", "doc", "at", "id", "digest", "code_points", "keep_id", "copies", "fp1", "fp2", "node", "root", "text_hash", "word", "pos", "row", "kind", "start", "stop", "value", "spans", "gone", "s", "x", "i", "score", "a.b", "a b")


@pytest.mark.parametrize("name", ["keep_one", "drop_copies", "clean", "drop_lines", "redact", "reject"])
def test_columns_pass_through_row_filters_with_their_values(spark, name):
    base = " ".join(f"w{i}" for i in range(40))
    texts = [base, base + " ", base + " more", None, "", "mail a@b.de or +1 555 123 4567", "one line of twenty letters\none line of twenty letters\nend", "bench0 bench1 bench2"]
    rows = [(i, t, *(100 * i + n for n in range(len(OWN)))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in OWN))
    items = spark.createDataFrame([(1, "bench0 bench1 bench2")], "item_id long, text string")
    run = {
        "keep_one": neardup.keep_one, "drop_copies": exact.drop_copies, "clean": lambda d: decontam.clean(d, items), "drop_lines": lines.drop_lines, "redact": pii.redact,
        "reject": lambda d: toxicity.reject(d, toxicity.learn(d, labels_for(spark, [(0, 1, 0), (7, 1, 1)]))),
    }[name]
    got = run(docs)
    assert got.columns == docs.columns
    by_id = {r[0]: r for r in rows}
    found = [tuple(r) for r in got.collect()]
    assert all(r[2:] == by_id[r[0]][2:] for r in found)
    left = {r[0]: r[1] for r in found}
    if name in ("keep_one", "drop_copies", "clean", "reject"):
        gone = {"keep_one": {1, 2}, "drop_copies": {0, 4}, "clean": {7}, "reject": set()}[name]
        assert left == {i: t for i, t in enumerate(texts) if i not in gone}
    else:
        assert left.keys() == by_id.keys()
        assert left[5] == (texts[5] if name == "drop_lines" else "mail <EMAIL> or <PHONE>") and left[6].count("twenty") == (1 if name == "drop_lines" else 2)
