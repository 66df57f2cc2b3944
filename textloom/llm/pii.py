"""Personal data: fixed forms as seeds, and contextual extraction bootstrapped from them.

Base spans are e-mail addresses, IPv4 addresses, payment card numbers and telephone
numbers of fixed forms. They are seed instances of their kinds in all documents. Access
secrets have no form that is searched for everywhere: their seeds are taken from one in
SEED_SHARE documents by the hash of the text, where a key word, an equals sign and a
quoted run of at least 32 lower-case hexadecimal digits count. All other secrets, of
that form too, have to be found by the patterns that these seeds induce.

1. Every mention gives lexical patterns from the words and marks around it: one to
   three before it, alone and with the one behind it. Mentions are seeds and
   candidates. A candidate is a run of identifier characters, however long, that
   overlaps no seed and has four digits or follows an equals sign or colon.
2. Patterns and instances form a graph. In each round a pattern's confidence for a
   kind is the mean confidence of its distinct instances, if enough different seeds
   support it; an instance's is that of any of its confident patterns being right
   (noisy or). Seeds keep confidence 1 for their kind and 0 for others. The first round
   takes the mean over the documents in which the kind's seeds were looked for, where
   what is no seed speaks against the pattern; later ones over all documents.
3. Candidates that end above the limit are spans of that kind, besides the base ones
   and the seed secrets. A table with fewer than SUPPORT different seeds teaches nothing.

Offsets are code points. They come from the lengths of the pieces between matches, so
Spark's own regular expressions do all the scanning; the forms use possessive
quantifiers where a match cannot change by them, which keeps long runs linear and
off the stack.

Defined results: a null or empty text has no spans; rows that repeat get the same
result; a null doc_id is a value of its own; an empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import lower_ascii
from textloom.rows import with_value
from textloom.skew import join_counted
from textloom.storage import materialize, maybe_broadcast, read_table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans, in their order.
ALL_KINDS = (*KINDS, "secret")
#: By kind: the form, and what a text must match to be worth searching.
_LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    # A local part is tried from its first character only, or from where the last match ended.
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
_IDENTIFIER, _MARKS = "[A-Za-z0-9._@+-]", "[._@+-]"
#: A run with four digits, tried from its first character only, or one that is assigned.
_CANDIDATE = (rf"(?<!{_IDENTIFIER})(?=(?:[A-Za-z._@+-]*+[0-9]){{4}}){_IDENTIFIER}++|(?<=[=:]\x20?[\x22\x27]?){_IDENTIFIER}{{4,}}+", r"[0-9=:]")
#: One in so many documents gives seed secrets; key words that may stand before one, and its form.
SEED_SHARE = 8
KEY_WORDS = ("token", "secret", "password", "api_key", "access_key")
_SECRET = (rf"(?<=\b(?:{'|'.join(KEY_WORDS)})\x20?=\x20?\x22)[0-9a-f]{{32,}}+(?=\x22)", "=\x20?\x22[0-9a-f]{32}")
#: Characters on each side of a mention that its patterns may look at.
REACH = 80
#: Distinct seeds of a pattern, its least confidence, an instance's least confidence, rounds.
SUPPORT, PATTERN_LIMIT, INSTANCE_LIMIT, ROUNDS = 5, 0.6, 0.8, 3
#: Patterns, of at most three words and a mark within REACH characters, that are broadcast.
BROADCAST_PATTERNS = 50_000


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    # Luhn: from the right, every second digit counts double, less nine when above nine.
    twice = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.when(F.length(digits).between(13, 19), F.aggregate(F.coalesce(twice, F.array()), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0).otherwise(F.lit(False))


def mentions(docs: DataFrame, form: str, worth: str, kind: str | None) -> DataFrame:
    """d, k, kind, start, stop, value, before, after for each match in texts that are worth a search."""
    # The id tells rows that repeat apart until their matches are placed.
    rows = docs.where(F.col("text").rlike(worth)).withColumn("row", F.monotonically_increasing_id())
    found = rows.select("d", "k", "row", F.split("text", form).alias("pieces"), F.expr(f"regexp_extract_all(text, r'{form}', 0)").alias("values")).where("size(values) > 0")
    each = found.select("d", "k", "row", F.posexplode(F.expr(f"transform(values, (v, i) -> struct(v as value, length(pieces[i]) as gap, right(pieces[i], {REACH}) as before, left(pieces[i + 1], {REACH}) as after))")).alias("i", "m"))
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gap") + F.length("m.value")).over(so_far)
    placed = each.withColumn("stop", stop.cast("long"))
    return placed.select("d", "k", F.lit(kind).alias("kind"), (F.col("stop") - F.length("m.value")).alias("start"), "stop", "m.value", "m.before", "m.after")


def base_spans(docs: DataFrame) -> DataFrame:
    """Mentions of all base kinds that pass the checks of their kind."""
    found = None
    for kind in KINDS:
        one = mentions(docs, *FORMS[kind], kind)
        one = one.where(_valid(kind, F.col("value")))
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _apart(found: DataFrame, taken: DataFrame) -> DataFrame:
    """The mentions that overlap none of the others."""
    taken = taken.select("d", "k", F.col("start").alias("b"), F.col("stop").alias("e"))
    return found.join(taken, (found["d"] == taken["d"]) & (found["k"] == taken["k"]) & (found["start"] < F.col("e")) & (found["stop"] > F.col("b")), "left_anti")


def candidates(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Mentions of identifiers that overlap no seed, without marks at their ends."""
    found = mentions(docs, *_CANDIDATE, None)
    lead, trail = F.length(F.regexp_extract("value", rf"^{_MARKS}*", 0)), F.length(F.regexp_extract("value", rf"{_MARKS}*$", 0))
    found = found.withColumns({"lead": lead, "trail": trail}).where("lead + trail < length(value)")
    bare = F.expr("substring(value, lead + 1, length(value) - lead - trail)")
    found = found.select("d", "k", "kind", (F.col("start") + F.col("lead")).alias("start"), (F.col("stop") - F.col("trail")).alias("stop"), bare.alias("value"), F.expr("concat(before, left(value, lead))").alias("before"), F.expr("concat(right(value, trail), after)").alias("after"))
    return _apart(found.where(F.length("value") >= 4).distinct(), seeds)


def patterns(found: DataFrame) -> DataFrame:
    """The rows of ``found`` with one row per pattern of each mention."""

    def parts(side: str) -> Column:
        # A word, with any number as 0, or a mark.
        return F.regexp_extract_all(F.regexp_replace(lower_ascii(F.col(side)), "[0-9]+", "0"), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))

    with_parts = found.withColumns({"left": parts("before"), "right": F.coalesce(F.get(parts("after"), F.lit(0)), F.lit(""))})
    made = []
    for n in (1, 2, 3):
        left = F.concat_ws(" ", F.lit(str(n)), F.slice("left", -n, n))
        made += [F.when(F.size("left") >= n, left), F.when((F.size("left") >= n) & (F.col("right") != ""), F.concat_ws(" ", left, F.lit("_"), "right"))]
    return with_parts.withColumn("pattern", F.explode(F.array_compact(F.array(*made)))).drop("left", "right", "before", "after")


def _shared() -> Column:
    """Whether a document, by the hash of its text, is one of those that give seed secrets."""
    return F.expr(f"pmod(k, {SEED_SHARE})") == 0


def bootstrap(known: DataFrame, others: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """d, k, kind, start, stop of the candidates ``others`` that the bootstrap, from the seeds ``known``, takes for personal data.

    Joins by pattern broadcast the patterns where they are counted to be few; joins by value
    keep the rows of hot values where they are.
    """
    found = patterns(known.unionByName(others)).groupBy("pattern", "value", F.col("kind").alias("seed")).agg(F.max(_shared()).alias("shared"))
    edges = materialize(found, "edges")
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("confidence")).distinct()
    instances = edges.groupBy("pattern").agg(F.count_distinct("value").alias("instances"), F.count_distinct(F.when(F.col("shared"), F.col("value"))).alias("shared_instances"))
    support = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count_distinct("value").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    # Only patterns with enough seeds can ever be confident.
    usable = materialize(support.join(instances, "pattern"), "usable-patterns")
    names = maybe_broadcast(usable.select("pattern").distinct(), BROADCAST_PATTERNS)
    edges = materialize(edges.join(names, "pattern", "left_semi"), "usable-edges")
    open_edges = edges.where("seed is null").select("pattern", "value")
    pairs = edges.select("pattern", "value").distinct()
    degrees, n_pairs = pairs.groupBy("value").agg(F.count("*").alias("degree")), pairs.count()
    believed = seeds
    for i in range(rounds):
        per_value = believed.groupBy("value").agg(F.collect_list(F.struct("kind", "confidence")).alias("beliefs")).join(degrees, "value")
        held = join_counted(pairs, per_value, "value", "degree", n_pairs).select("pattern", F.explode("beliefs").alias("b"))
        mass = held.groupBy("pattern", F.col("b.kind").alias("kind")).agg(F.sum("b.confidence").alias("mass"))
        of = F.col("instances") if i else F.when(F.col("kind").isin(*KINDS), F.col("instances")).otherwise(F.col("shared_instances"))
        scored = usable.join(mass, ["pattern", "kind"]).select("pattern", "kind", (F.col("mass") / of).alias("confidence")).where(F.col("confidence") >= PATTERN_LIMIT)
        scored = materialize(scored, "confident-patterns")
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        taken = materialize(open_edges.join(maybe_broadcast(scored, BROADCAST_PATTERNS), "pattern").groupBy("value", "kind").agg((1 - doubt).alias("confidence")), "instances")
        # A value that is a seed in one place and a candidate in another counts once.
        believed = seeds.unionByName(taken).groupBy("value", "kind").agg(F.max("confidence").alias("confidence"))
    best = taken.where(F.col("confidence") >= INSTANCE_LIMIT).groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    mentioned = others.groupBy("value").agg(F.count("*").alias("mentions"))
    sure = materialize(best.join(mentioned, "value"), "found-instances")
    total = others.count()
    held = join_counted(others.drop("kind"), sure, "value", "mentions", total).drop("mentions")
    good = maybe_broadcast(scored.select("pattern", "kind"), BROADCAST_PATTERNS)
    fit = patterns(held).join(good, ["pattern", "kind"], "left_semi")
    return fit.select("d", "k", "kind", "start", "stop").distinct()


def spans(docs: DataFrame) -> DataFrame:
    """d, k, kind, start, stop, base for every span; d and k identify the document."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text").alias("k"), "text")
    base = materialize(base_spans(keyed), "base-spans")
    secrets = materialize(_apart(mentions(keyed.where(_shared()), *_SECRET, "secret").distinct(), base), "seed-secrets")
    seeds = base.unionByName(secrets)
    others = materialize(candidates(keyed, seeds), "candidate-mentions")
    more = secrets.select("d", "k", "kind", "start", "stop").unionByName(bootstrap(seeds, others))
    return base.select("d", "k", "kind", "start", "stop", F.lit(True).alias("base")).unionByName(more.withColumn("base", F.lit(False)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; all rows and columns stay."""
    per_doc = spans(docs).groupBy("d", "k").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("spans"))
    joined, added = with_value(docs, [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")], per_doc)
    cut = F.expr(f"""aggregate({added[-1]}, named_struct('out', cast('' as string), 'at', 0L), (s, x) -> if(x.start < s.at,
      named_struct('out', s.out, 'at', greatest(s.at, x.stop)),
      named_struct('out', concat(s.out, substring(text, cast(s.at as int) + 1, cast(x.start - s.at as int)), '<', upper(x.kind), '>'), 'at', x.stop)),
      s -> concat(s.out, substring(text, cast(s.at as int) + 1)))""")
    return joined.withColumn("text", F.when(F.col(added[-1]).isNull(), F.col("text")).otherwise(cut)).drop(*added)


def summaries(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, spans, and the count of all spans."""
    order = F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).alias("o"), "start", "stop", "kind", "base")
    per_doc = spans(docs).groupBy("d", "k").agg(F.array_sort(F.collect_list(order)).alias("all"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text").alias("k"))
    joined = keys.join(per_doc, ["d", "k"], "left")

    def text(which: str) -> Column:
        return F.expr(f"coalesce(array_join(transform({which}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ','), '')")

    counts = [F.expr(f"cast(coalesce(size(filter(all, s -> s.base and s.kind = '{kind}')), 0) as long)").alias(f"n_{kind}") for kind in KINDS]
    counts = [F.when(F.col("all").isNull(), F.lit(0).cast("long")).otherwise(c).alias(f"n_{kind}") for c, kind in zip(counts, KINDS, strict=True)]
    return joined.select("doc_id", *counts, F.sha2(text("filter(all, s -> s.base)"), 256).alias("base_sha256"), text("all").alias("spans"), F.coalesce(F.array_size("all"), F.lit(0)).cast("long").alias("n_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(read_table(spark, sf_dir, "documents"))
