"""Repair of the structure of conversations by the cheapest edits.

A conversation shall read ``s?(ua)+`` in the initials of its roles, or be empty. Edits walk through a
lattice whose nodes are (turns dealt with, state of the grammar); nodes exist only once they are reached. Dijkstra's search
takes nodes by (cost, audit), where the audit is the string of the edits' initials, and stops at the first accepting end
node it takes. Two paths to one node with equal costs are never prefixes of each other (the longer one
would have more insertions, which cost), so the order of audits is kept by whatever follows.

Conversations stream by in sorted ranges, each held only up to a bound. One that a range's border cuts, or that
exceeds the bound, is put together from segments: a segment tells the cheapest way from each state it may be entered in
to each state it may be left in, these are chained along the conversation, and the chosen edits are applied
segment by segment. As a segment's paths end at one of its turns, no two audits at a border are prefixes of
each other, so a rank of four states stands for the audits before it. Only the digest of the repaired text is taken in
sequence, from text that has been put together beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, table

#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that an inserted or changed role gives, by state, and its name.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Insertions that complete a conversation left in a state.
CLOSING = ("", "II", "I", "")
SPACE = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT = 2, 3, 2

#: Turns of a segment (a power of two), and characters of a conversation that are held at once.
SEGMENT_BITS = 10
HELD_CHARS = 4_000_000
CHUNK_CHARS = 1_000_000
#: Characters of a text that order turns of equal number and role, before its digest does.
PREFIX_CHARS = 64


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def search(turns: list[tuple[str, int]], entry: int, whole: bool) -> list[tuple[int, int, str]]:
    """Cheapest edits of ``turns`` (initial, fault) from the state ``entry``: (state left in, cost, audit) for every state that may be
    left in behind the last turn, or, of a whole conversation, the one accepting end."""
    heap, settled, out = [(0, "", 0, entry)], set(), []
    n = len(turns)
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n and (not whole or state in (START, ASSISTANT)):
            out.append((state, cost, audit))
            if whole:
                return out
        if i < n:
            initial, fault = turns[i]
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                late = fault == TRUNCATED
                kept = kept_state(state, initial)
                if kept is not None:
                    heappush(heap, (cost + late, audit + "K", i + 1, kept))
                heappush(heap, (cost + REROLE + late, audit + "R", i + 1, NEXT[state]))
        if i < n or whole:
            heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state]))
    return out


def fault_of(text: str, seen: bool) -> int:
    said = text.rstrip(SPACE)
    if not said:
        return BLANK
    if seen:
        return DUPLICATE
    return NONE if said[-1] in ".!?" else TRUNCATED


class Facts:
    """What is counted over the turns of a segment, in order; segments of a conversation add up."""

    def __init__(self):
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.tail is not None:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        self.head, self.tail = initial if self.head is None else self.head, initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def join(self, other: Facts) -> None:
        self.faults = [a + b for a, b in zip(self.faults, other.faults)]
        self.illegal += other.illegal
        if self.tail is not None and other.head is not None:
            self.illegal += self.tail + other.head not in ("su", "ua", "au")
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.head = other.head if self.head is None else self.head
        self.tail = self.tail if other.tail is None else other.tail
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high

    @classmethod
    def of(cls, row: dict) -> Facts:
        own = cls()
        own.head, own.tail, own.low, own.high, own.turns, own.illegal = (row[c] for c in ("head", "tail", "low", "high", "turns", "illegal"))
        own.faults = [0, row["blank"], row["duplicate"], row["truncated"]]
        return own

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def row(self) -> tuple:
        return self.gaps, *self.faults[1:], self.illegal


def lines(edits: str, state: int, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of each turn that the edits leave, change or insert, from a state of the grammar on."""
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K":
            state = kept_state(state, role[:1])
        else:
            state = NEXT[state]
            role = ROLE[state]
        yield f"{role}:{text}"


def repaired(rows: list[tuple]) -> tuple:
    """A whole conversation (turn, role, text) in order: gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    facts, seen, cells = Facts(), set(), []
    for turn, role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        facts.add(turn, role[:1], fault)
        cells.append((role[:1], fault))
    _, cost, audit = search(cells, START, whole=True)[0]
    said = "\n".join(lines(audit, START, ((role, text) for _, role, text in rows)))
    return *facts.row(), cost, audit, hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RAW = "at long, turn long, role string, text string, state int"
#: Of a row that is put by for segments: gone (names its conversation only), blank, neither, truncated.
GONE, EMPTY, SAID, OPEN = range(4)


def _kinds(schema: str, conv):
    import pyarrow as pa

    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return {"conv": conv} | {name: plain[kind] for name, kind in (c.split() for c in schema.split(", "))}


def _batch(kinds: dict, rows: list[tuple]):
    """An Arrow batch of the rows, which are then forgotten."""
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def _stream(batches):
    """Repairs the conversations that lie inside a sorted range; rows of others are put by, numbered in order."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 33
    held: list[tuple] = []
    name, chars, waiting, aside, any_yet, kinds, out = None, 0, 0, True, False, None, []
    width = len(RAW.split(", ")), len(RESULT.split(", "))

    def put_by(i: int, turn, role: str, text: str, gone: bool) -> tuple:
        fault = fault_of(text, False)
        state = GONE if gone else EMPTY if fault == BLANK else OPEN if fault == TRUNCATED else SAID
        return name, place + i, turn, role, text, state, *[None] * width[1]

    def close(at_border: bool) -> None:
        nonlocal held
        if at_border:
            out.extend(put_by(*r) for r in held)
        else:
            out.append((name, *[None] * width[0], *repaired([r[1:4] for r in held if not r[4]])))
        held = []

    i = 0
    for batch in batches:
        kinds = kinds or _kinds(f"{RAW}, {RESULT}", batch.schema.field("conv").type)
        for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone"))):
            if not any_yet or conv != name:
                if any_yet:
                    close(aside)
                # the first conversation of a range may have begun in the one before
                name, chars, aside, any_yet = conv, 0, not any_yet, True
            held.append((i, turn, role, text, gone))
            chars += len(text)
            waiting += len(text)
            i += 1
            if aside or len(held) > 1 << SEGMENT_BITS or chars > HELD_CHARS:
                aside = True
                close(True)
            if len(out) >= 2_000 or waiting > HELD_CHARS:
                waiting = 0
                yield _batch(kinds, out)
    if any_yet:
        close(True)
        yield _batch(kinds, out)


PATHS = "seg long, head string, tail string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, paths string"


def _by_segment(batches):
    """Counts of each segment and its cheapest ways between states. Rows come by place; a row of kind 0 says that the row at
    its place is the first of its role and text in the conversation."""
    first, segment, facts, cells, kinds, out = None, None, Facts(), [], None, []

    def close() -> None:
        ways = [f"{entry}{state}{audit}:{cost}" for entry in range(4) for state, cost, audit in search(cells, entry, whole=False)]
        out.append((segment[0], segment[2], facts.head, facts.tail, facts.low, facts.high, facts.turns, *facts.faults[1:], facts.illegal, ",".join(ways)))

    for batch in batches:
        kinds = kinds or _kinds(PATHS, batch.schema.field("conv").type)
        for conv, at, kind, turn, initial, state in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "kind", "turn", "initial", "state"))):
            if kind == 0:
                first = at
                continue
            if segment is None or segment[:2] != (conv, at >> SEGMENT_BITS):
                if segment:
                    close()
                segment, facts, cells = (conv, at >> SEGMENT_BITS, at), Facts(), []
            if state != GONE:
                fault = BLANK if state == EMPTY else DUPLICATE if first != at else TRUNCATED if state == OPEN else NONE
                facts.add(turn, initial, fault)
                cells.append((initial, fault))
        if len(out) >= 500:
            yield _batch(kinds, out)
    if segment:
        close()
        yield _batch(kinds, out)


CHAINED = "seg long, entry int, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def ways_of(paths: str) -> list[tuple[int, int, int, str]]:
    """(entered in, left in, cost, audit) of a segment."""
    parts = (p.rpartition(":") for p in paths.split(","))
    return [(int(way[0]), int(way[1]), int(cost), way[2:]) for way, _, cost in parts]


class Chain:
    """The cheapest edits along the segments of a conversation. What is held of a segment is where each state was entered from."""

    def __init__(self):
        self.reached, self.back = {START: (0, 0)}, []

    def add(self, ways: list[tuple[int, int, int, str]]) -> None:
        best: dict[int, tuple] = {}
        for entry, state, cost, audit in ways:
            if entry in self.reached:
                before, rank = self.reached[entry]
                best[state] = min(best.get(state, (before + cost, rank, audit, entry)), (before + cost, rank, audit, entry))
        order = sorted(best, key=lambda s: best[s][1:3])
        self.reached = {s: (best[s][0], rank) for rank, s in enumerate(order)}
        self.back.append({s: best[s][3] for s in best})

    def end(self) -> tuple[int, list[tuple[int, int]], str]:
        """Cost, the states in which each segment is entered and left, and the closing insertions."""
        cost, _, state = min((cost + INSERT * len(CLOSING[s]), rank, s) for s, (cost, rank) in self.reached.items())
        closing, states = CLOSING[state], []
        for step in reversed(self.back):
            states.append((step[state], state))
            state = step[state]
        return cost, states[::-1], closing


def _chained(batches):
    """Chains the segments of each conversation as they come by, sorted; only states are held, not audits."""
    name, segments, facts, walk, kinds, out = None, [], Facts(), Chain(), None, []

    def close() -> Iterator:
        cost, states, closing = walk.end()
        for k, (seg, (entry, state)) in enumerate(zip(segments, states), 1):
            last = k == len(segments)
            out.append((name, seg, entry, f"{state}{closing if last else ''}", *(facts.row() if last else [None] * 5), cost if last else None))
            if len(out) >= 5_000:
                yield _batch(kinds, out)

    for batch in batches:
        kinds = kinds or _kinds(CHAINED, batch.schema.field("conv").type)
        for r in batch.to_pylist():
            if not segments or r["conv"] != name:
                yield from close() if segments else ()
                name, segments, facts, walk = r["conv"], [], Facts(), Chain()
            facts.join(Facts.of(r))
            walk.add(ways_of(r["paths"]))
            segments.append(r["seg"])
    if segments:
        yield from close()
        yield _batch(kinds, out)


TEXTS = "seg long, part int, audit string, said binary"


def _said(batches):
    """The repaired text of each segment, every line with a newline before it. Rows come by place; one of kind 0 brings
    the edits of the segment that begins at its place."""
    kinds, out = None, []
    at_hand = None  # conversation, segment, edits, state, place in the edits, part, pieces, characters

    def give(upto_row: bool, row: tuple[str, str] | None = None) -> None:
        """Applies edits up to the one of ``row``, or, at the end of the segment, those that are left."""
        edits, i, state = at_hand["edits"], at_hand["i"], at_hand["state"]
        stop = i
        while stop < len(edits) and edits[stop] == "I":
            stop += 1
        stop += upto_row
        turns = iter([row])
        for edit in edits[i:stop]:
            role, text = ("", "") if edit == "I" else next(turns)
            if edit == "D":
                continue
            state = kept_state(state, role[:1]) if edit == "K" else NEXT[state]
            line = f"\n{role if edit == 'K' else ROLE[state]}:{text}"
            at_hand["pieces"].append(line)
            at_hand["chars"] += len(line)
        at_hand["i"], at_hand["state"] = stop, state

    def flush() -> None:
        out.append((at_hand["conv"], at_hand["seg"], at_hand["part"], at_hand["edits"] if at_hand["part"] == 0 else "", "".join(at_hand["pieces"]).encode("utf-8", "surrogatepass")))
        at_hand["part"] += 1
        at_hand["pieces"], at_hand["chars"] = [], 0

    for batch in batches:
        kinds = kinds or _kinds(TEXTS, batch.schema.field("conv").type)
        for conv, at, kind, role, text, state, edits, entry in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "kind", "role", "text", "state", "edits", "entry"))):
            if kind == 0:
                if at_hand:
                    give(False)
                    flush()
                at_hand = {"conv": conv, "seg": at, "edits": edits, "state": entry, "i": 0, "part": 0, "pieces": [], "chars": 0}
            elif state != GONE:
                give(True, (role, text))
                if at_hand["chars"] > CHUNK_CHARS:
                    flush()
            if len(out) >= 16:
                yield _batch(kinds, out)
    if at_hand:
        give(False)
        flush()
        yield _batch(kinds, out)


def _digested(batches):
    """Audit and digest of each conversation from its segments' texts, as they come by, sorted."""
    kinds, name, audit, digest, begun, out = None, None, None, None, False, []

    def close() -> None:
        out.append((name, "".join(audit), digest.hexdigest()))

    for batch in batches:
        kinds = kinds or _kinds("audit string, repaired_sha256 string", batch.schema.field("conv").type)
        for conv, edits, said in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "said"))):
            if digest is None or conv != name:
                if digest is not None:
                    close()
                name, audit, digest, begun = conv, [], hashlib.sha256(), False
            audit.append(edits)
            if said:
                digest.update(said if begun else said[1:])
                begun = True
    if digest is not None:
        close()
        yield _batch(kinds, out)


def repair_conversations(turns: DataFrame, gone: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``gaps`` in its turn numbers, turns that are ``blank``, ``duplicate`` or ``truncated``, ``illegal``
    neighbours, the ``cost`` and the ``audit`` of the cheapest repair, and the SHA-256 of what it gives (``role:text`` by line).

    Keep costs 0, Rerole 2, Delete 3 (required for blank and duplicate turns), Insert 2, a truncated turn that stays 1. ``gone`` marks
    rows that only name their conversation.

    Defined results: a null role or text counts as one space; turns without a number come first; turns of one number
    come by role, then by the first 64 characters of the text, then by its SHA-256; repeated rows are turns of their
    own (the later ones duplicates); rows without a conversation form one; roles count by their first
    character, and an empty role fits nowhere; texts are taken whole and never held beyond a bound, however long a conversation
    is, but for its audit; other columns are not looked at; an empty table gives an empty result.
    """
    spark = turns.sparkSession
    # the mark is an expression over the input's columns
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), (F.lit(False) if gone is None else gone).alias("gone")
    )
    rows = rows.withColumns({"_head": F.substring("text", 1, PREFIX_CHARS), "_sha": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "_own": F.monotonically_increasing_id()})
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_head", "_sha", "_own"]
    kind = rows.schema["conv"].dataType.simpleString()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "gone")
    both = materialise(ranged.mapInArrow(_stream, f"conv {kind}, {RAW}, {RESULT}"), "repaired")
    result = [c.split()[0] for c in RESULT.split(", ")]
    inside = both.where(F.col("at").isNull()).select(F.col("conv").alias(conv_col), *result)
    cut = both.where(F.col("at").isNotNull()).select("conv", *[c.split()[0] for c in RAW.split(", ")])
    return inside.unionByName(_from_segments(cut, kind).withColumnRenamed("conv", conv_col))


def _from_segments(cut: DataFrame, kind: str) -> DataFrame:
    """The same for rows that ``_stream`` has put by."""
    cell = F.shiftright("at", SEGMENT_BITS)
    said = cut.where(F.col("state") != GONE)
    firsts = said.groupBy("conv", "role", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("at").alias("at"))
    firsts = firsts.select("conv", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("initial"), F.lit(0).alias("state"))
    narrow = cut.select("conv", "at", F.lit(1).alias("kind"), "turn", F.substring("role", 1, 1).alias("initial"), "state")
    dealt = firsts.unionByName(narrow).repartition(cell).sortWithinPartitions("at", "kind")
    segments = materialise(dealt.mapInArrow(_by_segment, f"conv {kind}, {PATHS}"), "segments")
    chained = materialise(segments.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_chained, f"conv {kind}, {CHAINED}"), "chained")
    ways = segments.select("seg", F.explode(F.split("paths", ",")).alias("way"))
    ways = ways.select("seg", F.substring("way", 1, 1).cast("int").alias("entry"), F.substring("way", 2, 1).alias("left_in"), F.regexp_extract("way", "^..([A-Z]*):", 1).alias("audit"))
    chosen = chained.select("conv", "seg", "entry", F.substring("edits", 1, 1).alias("left_in"), F.expr("substring(edits, 2)").alias("closing")).join(ways, ["seg", "entry", "left_in"])
    edits = chosen.select("conv", F.col("seg").alias("at"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("state"), F.concat("audit", "closing").alias("edits"), "entry")
    texts = cut.select("conv", "at", F.lit(1).alias("kind"), "role", "text", "state", F.lit("").alias("edits"), F.lit(0).alias("entry"))
    pieces = edits.unionByName(texts).repartition(cell).sortWithinPartitions("at", "kind").mapInArrow(_said, f"conv {kind}, {TEXTS}")
    whole = pieces.repartition("conv").sortWithinPartitions("conv", "seg", "part").mapInArrow(_digested, f"conv {kind}, audit string, repaired_sha256 string")
    counts = chained.where(F.col("cost").isNotNull()).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return counts.alias("c").join(whole.alias("w"), F.col("c.conv").eqNullSafe(F.col("w.conv"))).select("c.*", "w.audit", "w.repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """``conversations`` rows with faults dealt by the checksum of ``conv_id:turn``: of twenty, 0 is lost (``gone``), 1 loses its text, 2
    its sentence ends, 3 comes twice, 4 becomes the user's."""
    space = F.lit(" ")
    mark = F.pmod(F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), mark.alias("mark"))
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("mark") == 0).alias("gone"), times.alias("copy"))


def op12_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def _sql() -> str:
    """The same in DuckDB: the cheapest (cost, audit) of each state, turn by turn."""

    def add(key: str, cost: str, edit: str) -> str:
        return f"(printf('%09d', left({key}, 9)::BIGINT + {cost}) || substr({key}, 10) || '{edit}')"

    def put(key: str) -> str:
        return add(key, str(INSERT), "I")

    def gone(key: str) -> str:
        return add(key, str(DELETE), "D")

    may, late = "f NOT IN ('blank', 'duplicate')", "(f = 'truncated')::INT"

    def keep(key: str, initial: str) -> str:
        return f"CASE WHEN {may} AND i = '{initial}' THEN {add(key, late, 'K')} END"

    def rerole(key: str) -> str:
        return f"CASE WHEN {may} THEN {add(key, f'{REROLE} + {late}', 'R')} END"

    user = ", ".join(f(k, *x) for k in ("e0", "es", "ea") for f, x in ((keep, "u"), (rerole, "")))
    return rf"""
WITH RECURSIVE
crcs AS (SELECT list(v ORDER BY k) AS tab FROM (SELECT k, list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(k))),
raw AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
marked AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS m FROM raw, crcs),
damaged AS (SELECT c, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
    CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy FROM marked WHERE m <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS p, left(role, 1) AS i FROM damaged),
faulty AS (SELECT *, CASE WHEN rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
    coalesce(lag(i) OVER (PARTITION BY c ORDER BY p) || i NOT IN ('su', 'ua', 'au'), false) AS bad FROM placed),
walk(c, p, k0, ks, ku, ka) AS (
  SELECT c, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT c FROM raw)
  UNION ALL
  SELECT c, p, {gone("e0")}, least({gone("es")}, {keep("e0", "s")}), least({gone("eu")}, {user}), least({gone("ea")}, {keep("eu", "a")}, {rerole("eu")})
  FROM (SELECT walk.c, faulty.p, i, f, k0 AS e0, ks AS es, least(ku, {put("k0")}, {put("ks")}, {put("ka")}) AS eu, least(ka, {put("ku")}, {put(put("k0"))}, {put(put("ks"))}) AS ea
    FROM walk JOIN faulty ON walk.c = faulty.c AND faulty.p = walk.p + 1)),
best AS (SELECT c, left(k, 9)::BIGINT AS cost, substr(k, 10) AS audit
  FROM (SELECT c, least(k0, ka, {put("ku")}, {put(put("ks"))}) AS k FROM walk QUALIFY p = max(p) OVER (PARTITION BY c))),
steps AS (SELECT c, e, n, sum((e <> 'I')::INT) OVER (PARTITION BY c ORDER BY n) AS p FROM (SELECT c, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS n FROM best WHERE audit <> '')),
lines AS (SELECT s.c, n, e, role, text, row_number() OVER w - max((e = 'K' AND i = 's')::INT) OVER (PARTITION BY s.c) AS line FROM steps s LEFT JOIN faulty f ON s.c = f.c AND s.p = f.p WHERE e <> 'D' WINDOW w AS (PARTITION BY s.c ORDER BY n)),
said AS (SELECT c, string_agg((CASE WHEN e = 'K' THEN role WHEN line % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN e = 'I' THEN '' ELSE text END), chr(10) ORDER BY n) AS t FROM lines GROUP BY c),
facts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
    count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM faulty GROUP BY c)
SELECT r.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM raw) r JOIN best USING (c) LEFT JOIN facts USING (c) LEFT JOIN said USING (c)
"""


OP12_SQL = _sql()
