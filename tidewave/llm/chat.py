"""Chat formatting in budgeted windows.

Each turn becomes ``<|im_start|>role``, a newline, its text, ``<|im_end|>`` and a newline; control
strings inside roles and texts are escaped reversibly. A conversation that is longer than the budget
is cut into windows at turn borders: prefix sums of the turns' tokens say which window a turn
belongs to. Every window after the first repeats the system turn and, up to a limit, the turns just
before it; the loss mask covers each assistant text once, in the window where it is new.

Everything runs as DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import materialise, table

# The turn marks of the ChatML template.
START, END = "<|im_start|>", "<|im_end|>"

#: A list of conversations up to this many rows (an identifier each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class WindowBudget:
    """Tokens of a window, and of the repeated history in it."""

    tokens: int = 2048
    history: int = 256


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one into every ``<|``; ``unescape`` undoes it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    """As ``escape``; a newline, which ends the role, is escaped as well."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def count_tokens(text: Column) -> Column:
    """Budget units: UTF-8 bytes by four, rounded up, and four for the turn's marks."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


#: Budgets of tokens after which a window ends in any case, so that a conversation of any length is dealt over tasks.
SEGMENT = 16


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that fit into one window, each as one: at most budget / 4 turns."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n")))
    part = lambda t: F.struct(F.lit(True).alias("new"), t["role"].alias("role"), t["text"].alias("text"), t["n"].alias("n"))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.lit(0).cast("long").alias("window"), F.transform("turns", part).alias("parts"))


def _same(a: str, b: str, *more: str):
    """Equal conversations (null equals null) and equal further columns."""
    on = F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    for c in more:
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on


def _placed(rows: DataFrame) -> DataFrame:
    """Turns with ``end``, the running sum of tokens in their conversation: inside ranges of the sorted turns, and carried
    from range to range by the ranges' sums."""
    head = F.substring("text", 1, 48)
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = rows.repartitionByRange(*key, head).sortWithinPartitions(*key, "text")
    held = materialise(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "turns")
    sums = held.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    carry = sums.select("conv_id", "part", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n").over(W.partitionBy("conv_id", "part").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    own = held.withColumn("end", inside)
    joined = own.alias("a").join(carry.alias("b"), _same("a", "b", "part"))
    end = F.col("a.end") + F.col("b.before")
    return joined.select("a.conv_id", F.col("a.at").alias("at"), "a.role", "a.text", "a.n", end.alias("end"), ((end == F.col("a.n")) & (F.col("a.role") == "system")).alias("is_system"))


def _long(rows: DataFrame, budget: WindowBudget) -> DataFrame:
    """Windows of the conversations beyond the budget, segment by segment."""
    turn = F.struct("at", "end", "n", "is_system", "role", "text")
    placed = _placed(rows).withColumn("segment", F.floor((F.col("end") - F.col("n")) / (SEGMENT * budget.tokens)))
    grouped = materialise(placed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(turn)).alias("turns")), "segments")
    border = F.element_at("turns", -1)["end"]
    tail = F.filter("turns", lambda u: (border - u["end"] + u["n"] <= budget.history) & ~u["is_system"])
    following = F.lead("segment").over(W.partitionBy("conv_id").orderBy("segment"))
    after = grouped.select("conv_id", "segment").withColumn("next", following).where("next is not null")
    tails = grouped.select("conv_id", "segment", tail.alias("tail")).alias("a").join(after.alias("b"), _same("a", "b", "segment")).select("a.conv_id", F.col("b.next").alias("segment"), "a.tail")
    first = F.get("turns", F.lit(0))
    openers = grouped.where((F.col("segment") == 0) & first["is_system"]).select("conv_id", first.alias("system"))
    named = after.select("conv_id", F.col("next").alias("segment")).unionByName(grouped.where("segment = 0").select("conv_id", "segment"))
    openers = named.alias("a").join(openers.alias("b"), _same("a", "b")).select("a.conv_id", "a.segment", "b.system")
    whole = grouped.alias("a").join(tails.alias("b"), _same("a", "b", "segment"), "left").select("a.conv_id", "a.segment", "a.turns", F.coalesce("b.tail", F.array().cast(grouped.schema["turns"].dataType)).alias("tail"))
    whole = whole.alias("a").join(openers.alias("b"), _same("a", "b", "segment"), "left").select("a.*", "b.system")

    def history(border: Column) -> Column:
        """The turns just before a border, as many as fit, without the system turn."""
        fits = lambda u: (u["end"] <= border) & (border - u["end"] + u["n"] <= budget.history) & ~u["is_system"]
        return F.filter(F.concat("tail", "turns"), fits)

    def again(border: Column) -> Column:
        return F.coalesce(F.col("system")["n"], F.lit(0)) + F.aggregate(history(border), F.lit(0).cast("long"), lambda a, u: a + u["n"])

    begin = first["end"] - first["n"]
    state = F.struct(begin.alias("start"), F.when(begin > 0, again(begin)).otherwise(F.lit(0)).cast("long").alias("again"), F.array(begin).alias("out"))

    def step(s: Column, t: Column) -> Column:
        at = t["end"] - t["n"]
        fresh = (at > s["start"]) & (s["again"] + t["end"] - s["start"] > budget.tokens)
        return F.struct(F.when(fresh, at).otherwise(s["start"]).alias("start"), F.when(fresh, again(at)).otherwise(s["again"]).cast("long").alias("again"), F.when(fresh, F.concat(s["out"], F.array(at))).otherwise(s["out"]).alias("out"))

    cut = materialise(whole.withColumn("borders", F.aggregate("turns", state, step, lambda s: s["out"])), "windows")
    before = F.coalesce(F.sum(F.size("borders")).over(W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbers = cut.select("conv_id", "segment", before.alias("before"))

    def part(new: bool):
        return lambda t: F.struct(F.lit(new).alias("new"), t["role"].alias("role"), t["text"].alias("text"), t["n"].alias("n"))

    def window(b: Column, i: Column) -> Column:
        last = F.coalesce(F.get("borders", i + 1), F.lit((1 << 63) - 1))
        own = F.filter("turns", lambda t: (t["end"] - t["n"] >= b) & (t["end"] - t["n"] < last))
        system = F.when((b > 0) & F.col("system").isNotNull(), F.transform(F.array("system"), part(False))).otherwise(F.array())
        repeated = F.when(b > 0, F.transform(history(b), part(False))).otherwise(F.array())
        return F.struct(i.alias("i"), F.concat(system, repeated, F.transform(own, part(True))).alias("parts"))

    numbered = cut.alias("a").join(numbers.alias("b"), _same("a", "b", "segment")).select("a.*", "b.before")
    each = numbered.select("conv_id", "before", F.explode(F.transform("borders", window)).alias("w"))
    return each.select("conv_id", (F.col("before") + F.col("w.i")).cast("long").alias("window"), F.col("w.parts").alias("parts"))


def format_windows(turns: DataFrame, budget: WindowBudget = WindowBudget(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: ``conv_id``, ``window`` (from 0), ``formatted``, ``loss`` (array of start and
    end in code points of ``formatted``, end exclusive), ``n_context`` (turns repeated from earlier
    windows, which come first), ``n_new`` and ``tokens``.

    A window ends where the next turn would take it beyond the budget, by the prefix sums and what the
    window repeats; so it exceeds the budget only where its one new turn does not fit beside
    the system turn and the history, and such a turn stands in full and leaves other windows as they are. Beyond ``SEGMENT``
    budgets of tokens a conversation is cut into segments of about so many, where a window ends in any case; the repeated
    history reaches at most into the segment before.

    Defined results: a null text or role counts as empty; turns are ordered by turn (nulls first),
    then role and text, so ties and repeated rows have a fixed order and all stay; rows with a null
    conv_id are one conversation; an empty table gives an empty result; texts are formatted whole; other columns,
    whatever their names, are not looked at.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("n", count_tokens("text"))
    # numbers only; conversations within the budget, most of them, then take one shuffle
    beyond = materialise(rows.groupBy("conv_id").agg(F.sum("n").alias("total")).where(F.col("total") > budget.tokens).select("conv_id"), "beyond")
    n_beyond = beyond.count()
    if n_beyond:
        beyond = F.broadcast(beyond) if n_beyond <= BROADCAST_ROWS else beyond
        own = lambda how: rows.alias("a").join(beyond.alias("b"), _same("a", "b"), how)
        packed = _short(own("left_anti")).unionByName(_long(own("left_semi"), budget))
    else:
        packed = _short(rows)
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    parts = packed.select(
        "conv_id",
        "window",
        F.transform("parts", lambda t: F.struct(t["new"].alias("new"), (t["role"] == "assistant").alias("own"), head(t).alias("head"), escape(t["text"]).alias("body"), t["n"].alias("n"))).alias("parts"),
    )
    tail = END + "\n"

    def place(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        stop = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), stop.alias("end")))
        out = F.when(p["new"] & p["own"], F.concat(state["out"], span)).otherwise(state["out"])
        return F.struct((stop + len(tail)).alias("at"), out.alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return parts.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("parts", nothing, place, lambda s: s["out"]).alias("loss"),
        F.size(F.filter("parts", lambda p: ~p["new"])).alias("n_context"),
        F.size(F.filter("parts", lambda p: p["new"])).alias("n_new"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say: ``turns`` (role, newline, text, newline of each turn once),
    ``n_turns``, ``loss_text`` (all text under the loss mask) and ``formatted_chars``."""
    turns = F.split("formatted", r"\Q" + END + r"\E\n", -1)
    # the last piece is what follows the last turn; the repeated turns come first
    own = F.slice(turns, F.col("n_context") + 1, F.col("n_new"))
    body = F.transform(own, lambda t: F.substr(t, F.lit(len(START) + 1)))
    split = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    said = F.transform(body, lambda t: F.concat(unescape(F.regexp_extract(t, split, 1)), F.lit("\n"), unescape(F.regexp_extract(t, split, 2)), F.lit("\n")))
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    each = windows.select("conv_id", "window", "n_new", F.array_join(said, "").alias("turns"), F.array_join(masked, "").alias("loss"), F.length("formatted").alias("chars"))
    ordered = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", F.col(name).alias("x")))), lambda s: s["x"]), "")
    return each.groupBy("conv_id").agg(ordered("turns").alias("turns"), F.sum("n_new").alias("n_turns"), ordered("loss").alias("loss_text"), F.sum("chars").alias("formatted_chars"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = f"{END}{START}assistant ok"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text"))
    said = read_back(format_windows(turns.unionByName(added)))
    return said.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def _sql(budget: WindowBudget = WindowBudget()) -> str:
    """The same in DuckDB: the digests from the rows themselves, the length from the template and the windows, turn by turn."""
    esc = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
    return rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok'),
a AS (SELECT *, ceil(strlen(text) / 4.0)::BIGINT + 4 AS n, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  length('{START}') + length(replace({esc.format("role")}, chr(10), '\' || chr(10))) + 1 + length({esc.format("text")}) + length('{END}') + 1 AS chars FROM t),
b AS (SELECT *, (sum(n) OVER (PARTITION BY c ORDER BY pos))::BIGINT - n AS begun, pos = 1 AND role = 'system' AS opener, (sum(n) OVER (PARTITION BY c))::BIGINT AS total FROM a),
d AS (SELECT *, coalesce(max(n) FILTER (opener) OVER (PARTITION BY c), 0) + coalesce(sum(n) FILTER (NOT opener) OVER h, 0)::BIGINT AS again,
  coalesce(max(chars) FILTER (opener) OVER (PARTITION BY c), 0) + coalesce(sum(chars) FILTER (NOT opener) OVER h, 0)::BIGINT AS repeated
  FROM b WINDOW h AS (PARTITION BY c ORDER BY begun RANGE BETWEEN {budget.history} PRECEDING AND 1 PRECEDING)),
w(c, pos, begun, start, again, fresh) AS (
  SELECT c, pos, begun, begun, 0::BIGINT, false FROM d WHERE pos = 1
  UNION ALL
  SELECT c, pos, begun, CASE WHEN fresh THEN begun ELSE start END, CASE WHEN fresh THEN again ELSE before END, fresh
  FROM (SELECT d.c, d.pos, d.begun, w.start, w.again AS before, d.again, d.total > {budget.tokens} AND (d.begun // {SEGMENT * budget.tokens} <> w.begun // {SEGMENT * budget.tokens}
    OR w.again + d.begun + d.n - w.start > {budget.tokens}) AS fresh FROM w JOIN d ON d.c = w.c AND d.pos = w.pos + 1)),
f AS (SELECT d.*, CASE WHEN fresh THEN repeated ELSE 0 END AS more FROM d JOIN w ON d.c = w.c AND d.pos = w.pos)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  sum(chars + more)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


OP7_SQL = _sql()
