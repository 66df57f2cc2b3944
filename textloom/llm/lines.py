"""Near-duplicate lines: a segment-partition edit join.

A line is cut into threshold + 1 segments. Two lines within the threshold share a
whole segment, whose place in the longer line can differ only by a little. So each
distinct line puts its segments into an index under (length, segment number,
segment), and probes the index with the substrings of itself that could be a
segment of a line that is as long or up to ``threshold`` characters shorter; the
admissible places follow from how many edits can lie left and right of the segment
(Li et al., PASS-JOIN). Index and probes go through one exchange by key; a key under
which the index has no other line ends there. Keys that by a hashed share of the lines
hold about a thousandth of them are dealt out before it, and keys that several lines
share are compared in blocks. Pairs that meet are verified with a banded bit-parallel edit distance: a band
of 2 * threshold + 1 diagonals in one integer that slides along the lines (Hyyro,
2003). Only built-in expressions are used.

Links make classes. The first occurrence of a class (smallest doc_id, then line
number) stays and all other occurrences go, exact copies included.

Defined results: lines end at a line feed; white space (space, 0x09-0x0D) is trimmed
and its runs count as one space. Lines that are empty then are no lines: they are not
counted and never removed. Lines shorter than ``min_chars`` code points have exact
copies only. Lines meet by 63-bit hashes, but are told apart by their MD5 and verified
by their characters. A null text has no lines, a null doc_id comes last in the order.
Rows that repeat a doc_id and its text are one document. Empty tables give empty
results. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.components import components
from textloom.rows import with_value
from textloom.skew import join_counted
from textloom.storage import maybe_broadcast, materialize, read_table

THRESHOLD, MIN_CHARS = 2, 20
BROADCAST_ROWS = 200_000
#: A key of the index with more lines than this is hot; lines of a block that such keys are cut into.
HOT_LINES, BLOCK_LINES = 4, 256
#: A key of at least so many lines, and of a thousandth of all, is dealt out to SALTS tasks.
SALTED_LINES, SALTS = 10_000, 64
#: One line in so many, by hash, is counted to tell which keys to deal out; that moves rows and changes no result.
COUNTED = 16
#: Letters whose counts make the signature of a line.
SIGNED = "etaoinsrhldcumfpgb"
_LAST = (1 << 63) - 1


def occurrences(docs: DataFrame) -> DataFrame:
    """doc (the id, or the largest long for none), k (text hash), at (line number), line."""
    text = F.coalesce("text", F.lit(""))
    # Few texts have other white space than single spaces; looking is much cheaper than replacing.
    odd = F.lit(False)
    for mark in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(text, F.lit(mark))
    tidy = F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    # Looked at before the lines are made: filters on a line would take over whatever makes it.
    split = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("k"), F.split(tidy, "\n").alias("lines"))
    return split.select("doc", "k", F.posexplode_outer("lines").alias("at", "raw")).select("doc", "k", "at", F.trim("raw").alias("line")).where("line <> ''")


def _id() -> Column:
    return F.unhex(F.md5("line"))


def measured(lines: DataFrame, threshold: int) -> DataFrame:
    """h, body (four bytes a character), and the segments of lines up to ``threshold`` shorter.

    Segment i of a line that is k shorter begins at byte s{k}_{i} and has z{k}_{i} bytes.
    The places are columns so that no expression that uses them grows beyond what the
    JVM compiles; characters of equal width spare it from counting them.
    """
    parts = threshold + 1
    sized = lines.select(_ref().alias("h"), F.length("line").alias("n"), F.encode("line", "UTF-32").alias("body"))
    places = []
    for k in range(parts):
        for i in range(parts):
            # The last n % parts segments are longer by one.
            base, short = f"((n - {k}) div {parts})", f"({parts} - (n - {k}) % {parts})"
            places.append(F.expr(f"cast(4 * ({i} * {base} + greatest(0, {i} - {short})) + 1 as int)").alias(f"s{k}_{i}"))
            places.append(F.expr(f"cast(4 * ({base} + if({i} >= {short}, 1, 0)) as int)").alias(f"z{k}_{i}"))
    return sized.select("h", "body", "n", *places)


def _key(shorter: int, i: int, move: int) -> str:
    return f"xxhash64(n - {shorter}, {i}, substring(body, s{shorter}_{i} + {4 * move}, z{shorter}_{i}))"


def index_keys(threshold: int) -> Column:
    """Keys of a line's own segments."""
    return F.expr(f"array({', '.join(_key(0, i, 0) for i in range(threshold + 1))})")


def keys(threshold: int) -> Column:
    """Keys of a line's own segments, then of its other substrings that can be segments of lines up to ``threshold`` shorter.

    Segment i of those has at most i edits on its left and threshold - i on its right. All
    places lie within a line of more than 2 * threshold characters.
    """
    others = []
    for shorter in range(threshold + 1):
        for i in range(threshold + 1):
            moves = range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1)
            others += [_key(shorter, i, move) for move in moves if shorter or move]
    return F.expr(f"array({', '.join([_key(0, i, 0) for i in range(threshold + 1)] + others)})")


def signature(line: Column) -> Column:
    """Counts of some letters; an edit changes them by two at most, all together."""
    return F.array(*[(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).alias(c) for c in SIGNED])


def _ref() -> Column:
    """A line's hash with the last bit free."""
    return F.xxhash64("line").bitwiseAND(F.lit(-2))


def met_keys(lines: DataFrame, threshold: int, min_chars: int, total: int) -> DataFrame:
    """key, ref, n_own: lines under keys where the index has a line and something else meets it.

    ``lines`` has the distinct lines, of at most ``total`` occurrences. The last bit of
    ``ref`` tells the index from the probes; n_own counts the key's lines in the index.
    """
    if min_chars <= 2 * threshold:
        raise ValueError("lines have to be longer than twice the threshold")
    sized = measured(lines, threshold)
    # The others are null, not filtered out: a filter would go below the distinct lines, which would then be found twice.
    some = measured(lines.select(F.when(F.pmod(F.shiftright(_ref(), 1), F.lit(COUNTED)) == 0, F.col("line")).alias("line")), threshold)
    index = some.select(F.explode_outer(F.when(F.col("n").isNotNull(), index_keys(threshold))).alias("key")).where("key is not null")
    # At most 2000 keys for each segment can be that hot, whatever the input; most often there are none.
    hot = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(2 * COUNTED * F.col("n") > max(SALTED_LINES, total // 1000)).select("key")
    each = sized.select("h", F.posexplode(keys(threshold)).alias("at", "key"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)).alias("salt")
    # In one plan with the hot keys, so that the distinct lines are found once.
    dealt = each.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left").select("key", F.when(F.col("at") <= threshold, F.col("h") + 1).otherwise(F.col("h")).alias("ref"), salt)
    dealt = dealt.repartition("key", "salt")
    # Few keys are left when they are counted; the rows pass them where they are, and none is sorted.
    counted = dealt.groupBy("key", "salt").agg(F.sum(F.col("ref").bitwiseAND(F.lit(1))).alias("n_own"), F.count(F.lit(1)).alias("n"))
    left = counted.where("salt >= 0 or n > 1 and n_own > 0").select("key", "salt", F.when(F.col("salt") >= 0, F.lit(1 << 62)).otherwise(F.col("n_own")).alias("n_own"))
    return materialize(dealt.join(left.hint("shuffle_hash"), ["key", "salt"]).select("key", "ref", "n_own"), "line-keys")


def candidates(lines: DataFrame, threshold: int, min_chars: int, total: int, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: refs of lines that meet in the index; and h, line: all lines that they need.

    A key with over HOT_LINES lines in the index makes no rows of pairs. Its lines are
    dealt into blocks, and pairs of blocks are compared by signature within a row. The
    lines are looked up in ``texts`` together, so the documents are split into lines once for it.
    """
    met = met_keys(lines, threshold, min_chars, total)
    line = F.col("ref").bitwiseAND(F.lit(-2))
    sides = [met.where(f"n_own <= {HOT_LINES}").select("key", line.alias("r")), met.where(f"n_own <= {HOT_LINES} and ref & 1 = 1").select("key", line.alias("s"))]
    pairs = sides[0].join(sides[1], "key").where("r <> s").select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b"))
    pairs = materialize(pairs.distinct(), "line-pairs")
    hot = met.where(f"n_own > {HOT_LINES}").select("key", line.alias("h"), (F.col("ref").bitwiseAND(F.lit(1)) == 1).alias("own"))
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(hot.select("h")).distinct(), "line-refs")
    found = materialize(texts.select("line", _ref().alias("h")).join(maybe_broadcast(wanted, BROADCAST_ROWS), "h").distinct(), "line-texts")
    if not hot.isEmpty():
        pairs = materialize(pairs.unionByName(_hot_pairs(hot, found, threshold)).distinct(), "line-pairs")
    return pairs, found


def _hot_pairs(rows: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """a, b: lines of the same hot key (key, h, own) whose signatures allow for the threshold.

    A part of a key holds a block of its lines as probes and a block as the index.
    """
    wanted = materialize(rows.select("h").distinct(), "hot-line-ids")
    signed = texts.select("line", _ref().alias("h")).join(maybe_broadcast(wanted, BROADCAST_ROWS), "h").select("h", F.length("line").alias("n"), signature(F.col("line")).alias("signed"))
    signed = materialize(signed.distinct(), "signatures")
    sizes = materialize(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINES).alias("x_blocks"), F.ceil(F.count_if("own") / BLOCK_LINES).alias("y_blocks"), F.count(F.lit(1)).alias("lines")), "hot-blocks")
    dealt = join_counted(rows, sizes, "key", "lines", rows.count())

    def side(own: str, mine: str, other: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("h"), f"{mine}_blocks").alias(mine)
        each = dealt.where(own).select("key", "h", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(other))
        return each.join(signed, "h").groupBy("key", "x", "y").agg(F.collect_list(F.struct("h", "n", "signed")).alias(name))

    met = side("true", "x", "y", "probes").join(side("own", "y", "x", "index"), ["key", "x", "y"])
    change = "aggregate(zip_with(p.signed, q.signed, (u, v) -> abs(u - v)), 0, (t, e) -> t + e)"
    close = f"filter(index, q -> p.h <> q.h and p.n - q.n between 0 and {threshold} and {change} <= {2 * threshold})"
    pairs = met.select(F.explode(F.expr(f"flatten(transform(probes, p -> transform({close}, q -> struct(least(p.h, q.h) as a, greatest(p.h, q.h) as b))))")).alias("pair"))
    return pairs.select("pair.a", "pair.b")


def edit_distance(a: str, b: str, threshold: int) -> str:
    """SQL for the edit distance of two arrays of code points, or threshold + 1 if it is above.

    ``a`` is at least as long as ``b`` and at most ``threshold`` longer. Bit d of the
    vectors stands for row j + d - threshold of column j. The score follows the lowest
    diagonal of the band to the last row, then that row to the last column.
    """
    k = threshold
    mask = (1 << (2 * k + 1)) - 1
    same = " + ".join(f"if(j + {d - k} >= 1 and j + {d - k} <= size({a}) and get({a}, j + {d - k} - 1) = get({b}, j - 1), {1 << d}L, 0L)" for d in range(2 * k + 1))
    row = f"shiftleft(1L, {2 * k} - greatest(0, j - (size({a}) - {k})))"
    down = f"named_struct('p', s.p, 'n', s.n, 'score', s.score, 'x', {same})"
    zero = f"named_struct('p', t.p, 'n', t.n, 'score', t.score, 'd', ((((t.x & t.p) + t.p) ^ t.p) | t.x | t.n) & {mask}L)"
    flat = f"named_struct('score', u.score, 'd', u.d, 'hp', (u.n | ~(u.d | u.p)) & {mask}L, 'hn', u.d & u.p)"
    score = f"v.score + if(j <= size({a}) - {k}, if((v.d & {1 << 2 * k}L) = 0, 1, 0), if((v.hp & {row}) <> 0, 1, 0) - if((v.hn & {row}) <> 0, 1, 0))"
    step = f"named_struct('p', (v.hn | ~(shiftright(v.d, 1) | v.hp)) & {mask}L, 'n', shiftright(v.d, 1) & v.hp, 'score', {score})"
    # Each transform over a single value names an intermediate result.
    chain = f"transform(transform(transform(array({down}), t -> {zero}), u -> {flat}), v -> {step})[0]"
    start = f"named_struct('p', {((1 << (k + 1)) - 1) << k}L, 'n', 0L, 'score', {k})"
    return f"aggregate(if(size({b}) = 0, array(), sequence(1, size({b}))), {start}, (s, j) -> if(s.score > {2 * k}, s, {chain}), s -> if(size({b}) = 0, size({a}), least(s.score, {k + 1})))"


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """a, b (MD5 of lines), distance: the pairs of refs within the threshold; ``texts`` has h, line."""
    found = texts.select("h", _id().alias("id"), "line", F.length("line").alias("n"), signature(F.col("line")).alias("signed"))
    sides = [found.select(F.col("h").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("id", "line", "n", "signed"))) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    # Most pairs differ by so many letters that nothing else needs to be compared.
    change = "aggregate(zip_with(signed_a, signed_b, (u, v) -> abs(u - v)), 0, (t, e) -> t + e)"
    both = both.where(f"abs(n_a - n_b) <= {threshold} and {change} <= {2 * threshold}")
    points = "transform(regexp_extract_all({0}, '(?s).', 0), c -> ascii(c)) {0}"
    both = both.selectExpr("id_a", "id_b", points.format("line_a"), points.format("line_b"))
    ordered = both.selectExpr("id_a", "id_b", "if(size(line_a) >= size(line_b), line_a, line_b) x", "if(size(line_a) >= size(line_b), line_b, line_a) y")
    # As a row of its own the distance is worked out once; a filter on a column of a projection would do it again.
    near = ordered.select("id_a", "id_b", F.explode_outer(F.array(F.expr(edit_distance("x", "y", threshold)))).alias("distance")).where(f"distance <= {threshold}")
    return near.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "distance")


def links(docs: DataFrame, total: int, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """a, b, distance: pairs of different lines, by MD5, within the threshold."""
    texts = occurrences(docs).select("line").where(F.length("line") >= min_chars)
    pairs, found = candidates(texts.distinct(), threshold, min_chars, total, texts)
    return materialize(verified(pairs, found, threshold), "line-links")


def decisions(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, k, at, id, n_links, kept for each line of each row."""
    each = materialize(occurrences(docs).select("doc", "k", "at", _id().alias("id")), "lines")
    total = each.count()
    near = links(docs, total, threshold, min_chars)
    roots = components(near.select("a", "b"))
    degree = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    first = each.groupBy("id").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = first.join(roots.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Lines that occur once and are like no other stay and need no lookup.
    classes = materialize(classes.where("copies > 1 or n_links is not null"), "line-classes")
    heads = classes.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("members"))
    heads = materialize(heads, "line-heads")
    shared = join_counted(classes.select("id", "root", "copies", "n_links"), heads, "root", "members", classes.count())
    shared = materialize(shared.select("id", "copies", "head", F.coalesce("n_links", F.lit(0)).alias("n_links")), "shared-lines")
    found = join_counted(each, shared, "id", "copies", total, "left")
    return found.select("doc", "k", "at", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("head").isNull() | ((F.col("doc") == F.col("head.doc")) & (F.col("at") == F.col("head.at")))).alias("kept"))


def summaries(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: doc_id, n_lines, n_links, n_removed, kept_lines_sha256.

    n_links counts the different lines that are near each of its lines. The digest
    covers the MD5 of the lines that stay, in order, in hex and comma-joined.
    """
    # Rows that repeat a document bring the same lines, of which the set holds one.
    lines = F.array_sort(F.collect_set(F.struct("at", "id", "n_links", "kept"))).alias("lines")
    per_doc = decisions(docs, threshold, min_chars).groupBy("doc", "k").agg(lines)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("k"))
    found = keys.join(per_doc, ["doc", "k"], "left").withColumn("lines", F.coalesce("lines", F.expr("cast(array() as array<struct<at:int,id:binary,n_links:bigint,kept:boolean>>)")))
    kept = F.expr("array_join(transform(filter(lines, x -> x.kept), x -> lower(hex(x.id))), ',')")
    return found.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.expr("aggregate(lines, 0L, (t, x) -> t + x.n_links)").alias("n_links"),
        F.expr("cast(size(filter(lines, x -> not x.kept)) as long)").alias("n_removed"), F.sha2(kept, 256).alias("kept_lines_sha256"),
    )


def drop_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts; all columns and rows stay."""
    gone = decisions(docs, threshold, min_chars).where("not kept").groupBy("doc", "k").agg(F.collect_set("at").alias("gone"))
    joined, added = with_value(docs, [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text")], gone)
    left = F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> not array_contains({added[-1]}, i)), '\\n')")
    return joined.withColumn("text", F.when(F.col(added[-1]).isNull(), F.col("text")).otherwise(left)).drop(*added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(read_table(spark, sf_dir, "documents"))
