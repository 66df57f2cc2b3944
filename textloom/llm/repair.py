"""Repair of the structure of conversations by depth-first branch-and-bound.

A conversation is right when its roles' initials read ``(s?(ua)+)?``: a system turn or
none, then users and assistants by turns, or nothing. Edits keep a turn (0), give it the
other role (1), delete it (2, the only choice for blank turns and repeated ones), or insert
an empty turn of a user or an assistant (5); a turn that breaks off and is not deleted
costs 5 more. Of the cheapest edits those whose initials are least in ASCII are taken.

``cheapest`` searches depth first with an explicit stack. Each prefix of edits is a node
(turns used up, state of the pattern). A suffix bound says what the rest costs at least;
it is computed backwards for a pattern that forgets whether a user has spoken since the
system turn. Prefixes that cannot beat the incumbent (cost, audit) are cut. Each node
keeps the best (cost, audit) that has reached it, and worse prefixes end there: of two
audits at one node with equal costs neither begins with the other, so their order holds
whatever follows. An empty stack proves the incumbent.

Spark deals conversations out by id, sorted, and a task holds one of them at a time.
Conversations beyond LONG_TURNS turns or LONG_BYTES of text are cut into segments. The
search runs on each segment from every state to every state, in parallel; a chain over
these small tables picks a way through, least in cost and then in ASCII, as segments'
audits are compared from the first on. Copies of a row within a turn are one row with
a count there. Results are the same either way.

Defined results: null roles and texts are one space, so blank; null turns come first.
Rows of one turn go by role, then text, both bytewise. A null conv_id is a conversation
of its own. Repeated rows are duplicates. A conversation whose rows are all dropped has
zeros, an empty audit and no turns. Empty tables give empty results. Columns other than
conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.storage import maybe_broadcast, materialize, read_table

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: A conversation of more turns, or more bytes of text, is searched by segments.
LONG_TURNS, LONG_BYTES = 1024, 1 << 24
#: Turns of a segment, as a power of two.
SEGMENT_BITS = 10
#: Ids of long conversations counted to be at most so many are broadcast.
BROADCAST_ROWS = 200_000

# States of the pattern: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
_COMPLETE = (START, ASSISTANT)
#: The state that a kept turn's initial leads to.
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state that an inserted turn, or one with a new role, leads to.
_NEXT = (USER, USER, ASSISTANT, USER)
#: What the bounds know of a state: 0 at the start, 1 before a user, 2 before an assistant.
_CLASS = (0, 1, 2, 1)
_NEVER = 1 << 40
_WHITE = " \t\n\x0b\x0c\r"
_LEGAL = frozenset(("su", "ua", "au"))


@dataclass(frozen=True, slots=True)
class Turn:
    """What the search sees of a turn, or of ``times`` turns in succession that must go."""

    initial: str
    must_go: bool = False
    broken: bool = False
    times: int = 1


def suffix_bounds(turns: list[Turn], goal: int | None = None) -> list[tuple[int, int, int]]:
    """For each number of turns used up, and each class of states, what the rest costs at least."""
    low = (0, 0, INSERT) if goal is None else tuple(0 if _CLASS[goal] == c else _NEVER for c in range(3))
    out = [low]
    for t in reversed(turns):
        gone = DELETE * t.times
        start, user, assistant = low[0] + gone, low[1] + gone, low[2] + gone
        if not t.must_go:
            more = BROKEN if t.broken else 0
            said_user = low[2] + more + (KEEP if t.initial == "u" else REROLE)
            start, user = min(start, said_user), min(user, said_user)
            if t.initial == "s":
                start = min(start, low[1] + more + KEEP)
            assistant = min(assistant, low[1] + more + (KEEP if t.initial == "a" else REROLE))
        low = (min(start, INSERT + assistant, 2 * INSERT + user), min(user, INSERT + assistant), min(assistant, INSERT + user))
        out.append(low)
    return out[::-1]


def cheapest(turns: list[Turn], state: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``state`` through all turns.

    Without a goal the conversation has to be complete then. With one, that state has to be
    reached by the last turn; None where it cannot be.
    """
    low, end = suffix_bounds(turns, goal), len(turns)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(low[0][_CLASS[state]], 0, "", 0, state)]
    while stack:
        bound, cost, audit, i, state = stack.pop()
        if bound >= _NEVER or best and (bound > best[0] or bound == best[0] and audit > best[1][: len(audit)]):
            continue
        before = reached.get((i, state))
        if before and before <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == end and (state in _COMPLETE if goal is None else state == goal):
            best = min(best or (cost, audit), (cost, audit))
            continue
        steps = []
        following = _NEXT[state]
        if i < end:
            t = turns[i]
            steps.append((cost + DELETE * t.times, audit + "D" * t.times, i + 1, state))
            if not t.must_go:
                more = cost + (BROKEN if t.broken else 0)
                kept = _KEPT.get((state, t.initial))
                if kept is not None:
                    steps.append((more + KEEP, audit + "K", i + 1, kept))
                if kept != following:
                    steps.append((more + REROLE, audit + "R", i + 1, following))
        if i < end or goal is None:
            steps.append((cost + INSERT, audit + "I", i, following))
        # The most promising step comes off the stack first.
        stack.extend(sorted(((c + low[j][_CLASS[s]], c, a, j, s) for c, a, j, s in steps), key=lambda x: (x[0], x[2]), reverse=True))
    return best


def edited(rows: Iterable[tuple[str, str, int]], audit: str, state: int = START) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the turns that an audit leaves of rows (role, text, times)."""
    letters = iter(audit)
    for role, text, times in rows:
        for _ in range(times):
            while (letter := next(letters)) == "I":
                state = _NEXT[state]
                yield ("user" if state == USER else "assistant"), "", "I"
            if letter == "K":
                state = _KEPT[state, role[:1]]
                yield role, text, "K"
            elif letter == "R":
                state = _NEXT[state]
                yield ("user" if state == USER else "assistant"), text, "R"
    for _ in letters:
        state = _NEXT[state]
        yield ("user" if state == USER else "assistant"), "", "I"


@dataclass
class Conversation:
    """The rows of one conversation in order, and what is wrong with them."""

    rows: list[tuple[str, str, int]] = field(default_factory=list)
    turns: list[Turn] = field(default_factory=list)
    numbers: set[int] = field(default_factory=set)
    seen: set[tuple[str, str]] = field(default_factory=set)
    initials: list[str] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    broken: int = 0
    illegal: int = 0

    def add(self, turn: int | None, role: str, text: str, times: int) -> None:
        if not times:
            return
        bare = text.rstrip(_WHITE)
        again = (role, text) in self.seen
        if bare:
            self.seen.add((role, text))
        self.note(role[:1], not bare, again, bool(bare) and bare[-1] not in ".!?", times)
        self.rows.append((role, text, times))
        if turn is not None:
            self.numbers.add(turn)

    def note(self, initial: str, blank: bool, again: bool, broken: bool, times: int) -> None:
        """Counts a row that occurs ``times`` times in succession."""
        if blank:
            self.blank += times
            self.turns.append(Turn(initial, True, times=times))
        else:
            self.duplicate += times - (not again)
            if not again:
                self.broken += broken
                self.turns.append(Turn(initial, False, broken))
            if times > 1 or again:
                self.turns.append(Turn(initial, True, times=times - (not again)))
        self.illegal += times - 1 + (bool(self.initials) and self.initials[-1] + initial not in _LEGAL)
        self.initials.append(initial)

    @property
    def gaps(self) -> int:
        return max(self.numbers) - min(self.numbers) + 1 - len(self.numbers) if self.numbers else 0


_KEY = [pa.field("conv_id", pa.int64())]
_SUMMARY = pa.schema(_KEY + [pa.field(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
_TURNS = pa.schema([*_KEY, pa.field("seq", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string()), pa.field("edit", pa.string())])
_DDL = {pa.int64(): "long", pa.string(): "string"}
#: Bytes of texts that a task sends on at a time.
SEND_BYTES = 1 << 20


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _digest(turns: Iterable[tuple[str, str, str]]) -> str:
    h = hashlib.sha256()
    for n, (role, text, _) in enumerate(turns):
        h.update(f"{chr(10) if n else ''}{role}:{text}".encode())
    return h.hexdigest()


def _summary(conv_id: int | None, c: Conversation, cost: int, audit: str) -> Iterator[tuple]:
    yield conv_id, c.gaps, c.blank, c.duplicate, c.broken, c.illegal, cost, audit, _digest(edited(c.rows, audit))


def _turns(conv_id: int | None, c: Conversation, cost: int, audit: str) -> Iterator[tuple]:
    for seq, (role, text, edit) in enumerate(edited(c.rows, audit)):
        yield conv_id, seq, role, text, edit


def _solved(make: Callable[[int | None, Conversation, int, str], Iterator[tuple]], schema: pa.Schema):
    """A task that repairs the conversations of sorted rows and sends on what ``make`` says of each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, current, conversation = 0, None, None

        def end() -> None:
            nonlocal size
            if conversation is not None:
                for row in make(current, conversation, *cheapest(conversation.turns)):
                    held.append(row)
                    size += 64 + sum(len(x) for x in row if isinstance(x, str))

        for batch in batches:
            for conv_id, turn, role, text, times in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "times")), strict=True):
                if conversation is None or conv_id != current:
                    end()
                    current, conversation = conv_id, Conversation()
                    if size > SEND_BYTES:
                        yield _batch(held, schema)
                        held, size = [], 0
                conversation.add(turn, role, text, times)
        end()
        yield _batch(held, schema)

    return task


def _ordinary(rows: DataFrame, make, schema: pa.Schema) -> DataFrame:
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(_solved(make, schema), _ddl(schema))


# Long conversations


def _ordered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """cid, pos, turn, role, text, times of the rows of long conversations; pos ascends in their order.

    A range of the order is a partition, so a conversation spreads over many.
    """
    mine = rows.where("times > 0").join(maybe_broadcast(ids, BROADCAST_ROWS), rows["conv_id"].eqNullSafe(ids["long_id"]))
    once = mine.groupBy("cid", "turn", "role", "text").agg(F.sum("times").alias("times"))
    order = [F.asc("cid"), F.asc_nulls_first("turn"), F.asc("role")]
    # Bounds of ranges are sampled: texts beyond a prefix stay out of them.
    ranged = once.withColumn("head", F.substring("text", 1, 256)).repartitionByRange(*order, F.asc("head")).sortWithinPartitions(*order, "text")
    return materialize(ranged.select("cid", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "times"), "long-conversations")


def _coded(ordered: DataFrame) -> DataFrame:
    """cid, seg, pos, turn, initial, blank, again, broken, times: all that the search needs, without texts."""
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    said = F.struct(F.md5(F.col("text").cast("binary")), F.length("text"))
    firsts = ordered.groupBy("cid", "role", said.alias("said")).agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("again"))
    flags = ordered.select("cid", "pos", "turn", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("broken"), "times")
    found = flags.join(firsts, "pos", "left").withColumn("again", F.coalesce("again", F.lit(True)))
    return materialize(found.withColumn("seg", F.shiftright("pos", SEGMENT_BITS)), "long-codes")


def _segments(coded: DataFrame) -> DataFrame:
    """Of each segment, from each state to each that it can reach: cost, audit, and the audit's rank among those of its first state."""

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        c, frame = Conversation(), frame.sort_values("pos")
        for row in frame.itertuples():
            c.note(row.initial, row.blank, row.again, row.broken, row.times)
        out = []
        for state in STATES:
            found = [(made[1], goal, made[0]) for goal in STATES if (made := cheapest(c.turns, state, goal)) is not None]
            out += [(*key, state, goal, cost, audit, rank, c.initials[0], c.initials[-1], c.illegal) for rank, (audit, goal, cost) in enumerate(sorted(found))]
        return pd.DataFrame(out, columns=["cid", "seg", "entry", "leave", "cost", "audit", "rank", "first", "last", "illegal"])

    kind = "cid long, seg long, entry int, leave int, cost long, audit string, rank int, first string, last string, illegal long"
    return materialize(coded.groupBy("cid", "seg").applyInPandas(solve, kind), "long-segments")


def _chain(segments: DataFrame) -> DataFrame:
    """cid, seg, entry, leave of the way taken, and its cost and the turns to insert at the end in the row of the last segment."""

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        steps: dict[int, list] = {}
        for row in frame.itertuples():
            steps.setdefault(row.seg, []).append((row.entry, row.leave, row.cost, row.rank))
        order = sorted(steps)
        tail = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        togo = [{s: n * INSERT for s, n in tail.items()}]
        for seg in reversed(order):
            togo.append({s: min((c + togo[-1][e] for b, e, c, _ in steps[seg] if b == s), default=_NEVER) for s in STATES})
        togo.reverse()
        state, out = START, []
        for n, seg in enumerate(order):
            _, _, following = min((c + togo[n + 1][e], rank, e) for b, e, c, rank in steps[seg] if b == state)
            out.append((key[0], seg, state, following, -1, 0))
            state = following
        out[-1] = (*out[-1][:4], togo[0][START], tail[state])
        return pd.DataFrame(out, columns=["cid", "seg", "entry", "leave", "total", "tail"])

    small = segments.select("cid", "seg", "entry", "leave", "cost", "rank")
    return small.groupBy("cid").applyInPandas(walk, "cid long, seg long, entry int, leave int, total long, tail int")


def _way(segments: DataFrame) -> DataFrame:
    """cid, seg, entry, audit (with what is inserted at the end), total: one row for each segment."""
    met = _chain(segments).join(segments.select("cid", "seg", "entry", "leave", "audit"), ["cid", "seg", "entry", "leave"])
    return materialize(met.select("cid", "seg", "entry", F.concat("audit", F.repeat(F.lit("I"), F.col("tail"))).alias("audit"), "total"), "long-way")


def _long_turns(ordered: DataFrame, way: DataFrame) -> DataFrame:
    """cid, seg, at, role, text, edit of the turns that are left."""
    rows = ordered.withColumn("seg", F.shiftright("pos", SEGMENT_BITS)).join(way.select("cid", "seg", "entry", "audit"), ["cid", "seg"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, letters, rows = None, START, "", []

        def out() -> pa.RecordBatch:
            return _batch([(*key, at, *x) for at, x in enumerate(edited(rows, letters, state))] if key else [], schema)

        for batch in batches:
            for cid, seg, entry, audit, role, text, times in zip(*(batch[c].to_pylist() for c in ("cid", "seg", "entry", "audit", "role", "text", "times")), strict=True):
                if (cid, seg) != key:
                    yield out()
                    key, state, letters, rows = (cid, seg), entry, audit, []
                rows.append((role, text, times))
        yield out()

    schema = pa.schema([("cid", pa.int64()), ("seg", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return rows.repartition("cid", "seg").sortWithinPartitions("cid", "seg", "pos").mapInArrow(apply, _ddl(schema))


def _digests(turns: DataFrame) -> DataFrame:
    """cid, repaired_sha256. A digest is sequential: a conversation's turns stream through one task and are not held."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, h, out = None, None, []
        for batch in batches:
            for cid, role, text in zip(*(batch[c].to_pylist() for c in ("cid", "role", "text")), strict=True):
                if cid != current:
                    if h:
                        out.append((current, h.hexdigest()))
                    current, h, between = cid, hashlib.sha256(), ""
                h.update(f"{between}{role}:{text}".encode())
                between = "\n"
        if h:
            out.append((current, h.hexdigest()))
        yield _batch(out, schema)

    schema = pa.schema([("cid", pa.int64()), ("repaired_sha256", pa.string())])
    return turns.select("cid", "seg", "at", "role", "text").repartition("cid").sortWithinPartitions("cid", "seg", "at").mapInArrow(task, _ddl(schema))


def _long_summary(ids: DataFrame, coded: DataFrame, segments: DataFrame, way: DataFrame, turns: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    new = F.when(F.col("blank") | F.col("again"), 0).otherwise(1)
    facts = coded.groupBy("cid").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), zero).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("times") - new)).alias("duplicate"), F.sum(F.when(F.col("broken"), new).otherwise(0)).cast("long").alias("truncated"),
    )
    each = segments.select("cid", "seg", "first", "last", "illegal").distinct()
    pair = F.concat(F.lag("last").over(Window.partitionBy("cid").orderBy("seg")), "first")
    illegal = each.select("cid", (F.col("illegal") + F.coalesce((~pair.isin(*sorted(_LEGAL))).cast("long"), zero)).alias("illegal")).groupBy("cid").agg(F.sum("illegal").alias("illegal"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "")
    audits = way.groupBy("cid").agg(joined.alias("audit"), F.max("total").alias("cost"))
    made = ids.join(facts, "cid").join(illegal, "cid").join(audits, "cid").join(_digests(turns), "cid", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return made.select(F.col("long_id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


@dataclass(frozen=True)
class Repaired:
    """``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    ``turns``: conv_id, seq, role, text, edit (K, R or I) of what they have become."""

    conversations: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, times: Column | None = None, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> Repaired:
    """Repairs conversations (conv_id, turn, role, text); ``times`` says how often a row occurs in succession, 0 for a row that is gone."""
    space = F.lit(" ")
    taken = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    sizes = taken.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text").cast("long") * F.col("times")).alias("bytes"))
    found = sizes.where((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("long_id"))
    ids = materialize(found.withColumn("cid", F.monotonically_increasing_id()), "long-ids")
    if ids.isEmpty():
        return Repaired(_ordinary(taken, _summary, _SUMMARY), _ordinary(taken, _turns, _TURNS))
    rest = taken.join(maybe_broadcast(ids, BROADCAST_ROWS), taken["conv_id"].eqNullSafe(ids["long_id"]), "left_anti")
    ordered = _ordered(taken, ids)
    coded = _coded(ordered)
    segments = _segments(coded)
    way = _way(segments)
    left = _long_turns(ordered, way)
    place = F.row_number().over(Window.partitionBy("cid").orderBy("seg", "at")).cast("long") - 1
    turns = left.withColumn("seq", place).join(ids, "cid").select(F.col("long_id").alias("conv_id"), "seq", "role", "text", "edit")
    return Repaired(_ordinary(rest, _summary, _SUMMARY).unionByName(_long_summary(ids, coded, segments, way, left)), _ordinary(rest, _turns, _TURNS).unionByName(turns))


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """``conversations`` with planted faults, and how often each row occurs: by the CRC-32 of ``conv_id:turn`` rows go, lose
    their text or its ends of sentences, are said twice, or become the user's."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(named.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))
    return rows, F.col("times")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(*damaged(read_table(spark, sf_dir, "conversations"))).conversations
