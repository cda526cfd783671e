"""Secret scans with a trigram inverted index.

From the syntax tree of each rule's regular expression follows a Boolean query over the trigrams
that every match must contain. The index holds postings for the trigrams that some rule asks for;
intersecting and uniting them per rule gives candidate documents, and only these are searched with
the rule's expression. Rules without mandatory trigrams search every document.

Everything runs as DataFrame operations; the driver only parses the rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, table
from ._spans import as_text, matches, placed, ranked

#: A candidate list up to this many rows (16 bytes each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
_MAX_STRINGS = 64
_SMALL_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """``part`` is the group whose length must reach ``least`` (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 0
    part: int = 0
    base: bool = False


# The base rules and public formats of well-known credentials.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

# A query is True (no condition), a trigram, or ("and" | "or", queries).


def _join(op: str, queries) -> object:
    flat = []
    for q in queries:
        flat += q[1] if isinstance(q, tuple) and q[0] == op else [q]
    if op == "or" and True in flat:
        return True
    flat = [q for q in dict.fromkeys(flat) if q is not True]
    if op == "or":  # a text that fulfils a query fulfils one that asks for less
        asked = {q: frozenset([q] if isinstance(q, str) else q[1]) if isinstance(q, str) or q[0] == "and" else None for q in flat}
        flat = [q for q in flat if asked[q] is None or not any(a is not None and a < asked[q] for a in asked.values())]
    return True if not flat else flat[0] if len(flat) == 1 else (op, tuple(flat))


def _of_strings(strings: set[str]) -> object:
    """What a text that contains one of the strings must contain."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


_SPACE, _DIGIT = " \t\n\r\f\v", "0123456789"


class _Parser:
    """The part of regular expressions that rules are written in, as nodes.

    A node is ("chars", set or None), None for classes that are not spelled out; ("group", nodes); ("either", alternatives); or
    ("repeat", least, most or None, nodes). Anchors and look-arounds take no characters and leave no node. What is not
    understood is refused.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def parse(self) -> list:
        nodes = self.either()
        if self.at < len(self.text):
            raise ValueError(f"unbalanced expression {self.text!r}")
        return nodes

    def peek(self, what: str) -> bool:
        return self.text.startswith(what, self.at)

    def take(self, what: str) -> bool:
        hit = self.peek(what)
        self.at += len(what) * hit
        return hit

    def either(self) -> list:
        branches = [self.sequence()]
        while self.take("|"):
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else [("either", branches)]

    def sequence(self) -> list:
        nodes = []
        while self.at < len(self.text) and not self.peek("|") and not self.peek(")"):
            node = self.atom()
            nodes += [] if node is None else [self.repeated(node)]
        return nodes

    def repeated(self, node):
        m = re.compile(r"([*+?]|\{(\d*)(,?)(\d*)\})[?+]?").match(self.text, self.at)
        if not m or m[1] in ("{}", "{,}"):
            return node
        self.at = m.end()
        if m[1] in "*+?":
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[1]]
        else:
            low = int(m[2] or 0)
            high = int(m[4]) if m[4] else None if m[3] else low
        return ("repeat", low, high, [node])

    def atom(self):
        if self.take("("):
            m = re.compile(r"\?(?:(<?[=!])|(?:P?<\w+>)|(>)|([aimsux-]*)([:)])?)").match(self.text, self.at)
            looks, bare = m and m[1], m and m[4] == ")"
            self.at = m.end() if m else self.at
            if bare:
                return None  # flags for the rest
            nodes = self.either()
            if not self.take(")"):
                raise ValueError(f"unbalanced expression {self.text!r}")
            return None if looks else ("group", nodes)
        if self.take("["):
            return ("chars", self.klass())
        if self.take("\\"):
            return self.escaped()
        c = self.text[self.at]
        self.at += 1
        return None if c in "^$" else ("chars", None if c == "." else {c.lower()})

    def escaped(self):
        c = self.text[self.at]
        self.at += 1
        if c in "bBAZzG":
            return None
        return ("chars", self.escape_set(c))

    def escape_set(self, c: str) -> set | None:
        if c in "xu":
            n = 2 if c == "x" else 4
            self.at += n
            return {chr(int(self.text[self.at - n : self.at], 16)).lower()}
        if c in "DSWwpPhHRvVX":
            return None
        known = {"d": set(_DIGIT), "s": set(_SPACE), "n": {"\n"}, "t": {"\t"}, "r": {"\r"}, "f": {"\f"}}
        if c.isalnum() and c not in known:
            raise ValueError(f"unknown escape \\{c}")
        return known.get(c, {c.lower()})

    def klass(self) -> set | None:
        chars: set | None = set()
        if self.take("^"):
            chars = None
        first = True
        while first or not self.peek("]"):
            first = False
            if self.take("\\"):
                self.at += 1
                own = self.escape_set(self.text[self.at - 1])
            else:
                self.at += 1
                own = {self.text[self.at - 1].lower()}
            if self.peek("-") and not self.text.startswith("-]", self.at):
                self.at += 1
                high = self.text[self.at]
                self.at += 1
                if high == "\\":
                    self.at += 1
                own = None  # a range
            chars = None if chars is None or own is None else chars | own
        self.at += 1
        return chars


def _walk(nodes) -> tuple[set[str] | None, object]:
    """The strings that the nodes match, if these are few, and the query of a match."""
    run, query, exact = {""}, True, True

    def flush() -> None:
        nonlocal run, query, exact
        query, run, exact = _join("and", [query, _of_strings(run)]), {""}, False

    for node in nodes:
        more: set[str] | None = None
        if node[0] == "chars":
            more = node[1] if node[1] is not None and len(node[1]) <= _SMALL_CLASS else None
        elif node[0] == "group":
            more, inner = _walk(node[1])
            if more is None:
                flush()
                query = _join("and", [query, inner])
                continue
        elif node[0] == "either":
            parts = [_walk(branch) for branch in node[1]]
            if any(p[0] is None for p in parts):
                flush()
                query = _join("and", [query, _join("or", [p[1] if p[0] is None else _of_strings(p[0]) for p in parts])])
                continue
            more = set().union(*(p[0] for p in parts))
        else:
            _, low, high, inner_nodes = node
            strings, inner = _walk(inner_nodes)
            if low == 0 and high == 1 and strings is not None:
                more = strings | {""}
            else:
                flush()
                if low:
                    query = _join("and", [query, inner if strings is None else _of_strings(strings)])
                continue
        if more is None or len(run) * len(more) > _MAX_STRINGS:
            flush()
            if more is not None:
                run = more
            continue
        run = {a + b for a in run for b in more}
    return (run if exact else None), _join("and", [query, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-case trigrams that every text with a match fulfils."""
    return _walk(_Parser(pattern).parse())[1]


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _holds(query: object, has) -> Column:
    if isinstance(query, str):
        return has(query)
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [_holds(q, has) for q in query[1]])


def grams_of(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that some rule asks for."""
    return sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (``gram``, ``doc_id``) for each of the trigrams that a document contains.

    Written once, it serves every set of rules whose trigrams are among ``grams`` (``secret_spans(..., index=...)``).
    """
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", F.explode(present).alias("gram"))


def candidates(index: DataFrame, grams: list[str], queries: dict[str, object]) -> DataFrame:
    """``doc_id`` and one flag per rule: does the document fulfil the rule's query?"""
    words = range(0, len(grams), 62)
    number = F.coalesce(*[F.when(F.col("gram") == g, F.lit(k)) for k, g in enumerate(grams)])
    bit = lambda w: F.when((F.col("n") >= w) & (F.col("n") < w + 62), F.expr(f"shiftleft(1L, n - {w})")).otherwise(F.lit(0))
    held = index.withColumn("n", number).where("n is not null").groupBy("doc_id").agg(*[F.bit_or(bit(w)).alias(f"grams_{w}") for w in words])
    place = {g: k for k, g in enumerate(grams)}

    def has(gram: str) -> Column:
        w, k = divmod(place[gram], 62)
        return F.col(f"grams_{w * 62}").bitwiseAND(F.lit(1 << k)) != 0

    flags = held.select("doc_id", *[_holds(q, has).alias(f"may_{kind}") for kind, q in queries.items()])
    return flags.where(reduce(lambda a, b: a | b, [F.col(f"may_{kind}") for kind in queries]))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """One row per document: ``doc_id`` and, per rule, ``found_<kind>``: an array of (start, rank, end, kind). ``index``: stored
    postings of the documents with the rules' trigrams; built here otherwise.

    Defined results: a null or empty text holds nothing; documents with a null identifier are not
    indexed but searched by every rule; repeated rows and identifiers are searched each (postings of
    one identifier are united, which can only add candidates); an empty table gives an empty result;
    texts are searched whole.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if indexed:
        grams = grams_of(rules)
        few = materialise(candidates(postings(rows, grams) if index is None else index, grams, indexed), "candidates")
        rows = rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, "doc_id", "left")
    may = {k: F.coalesce(F.col(f"may_{k}"), F.lit(False)) | F.col("doc_id").isNull() for k in indexed}
    searched = rows.select("doc_id", *[matches(F.col("text"), r.pattern, r.part, may.get(r.kind)).alias(f"m_{r.kind}") for r in rules])

    def good(r: Rule) -> Column:
        spans = placed(F.col(f"m_{r.kind}"), r.pattern, r.part)
        return F.filter(spans, lambda s: F.length(s["part"] if r.part else s["hit"]) >= r.least) if r.least else spans

    return searched.select("doc_id", *[ranked(r.kind, k, good(r)).alias(f"found_{r.kind}") for k, r in enumerate(rules)])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = [f"found_{r.kind}" for r in RULES if r.base]
    every = [f"found_{r.kind}" for r in RULES]
    return found.select(
        "doc_id",
        *[F.size(c).cast("long").alias("n_" + c.removeprefix("found_")) for c in base],
        F.sha2(as_text(F.array_sort(F.concat(*base))).cast("binary"), 256).alias("base_sha256"),
        as_text(F.array_sort(F.concat(*every))).alias("spans"),
    )


def _sql() -> str:
    """The same in DuckDB: every rule searches every text."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        length = f"length(regexp_extract(h[i], '{p}', {r.part}))" if r.part else "length(h[i])"
        parts.append(
            f"""SELECT doc_id, row, list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0), 'rank': {k}, 'size': length(h[i]), 'ok': {length} >= {r.least}, 'kind': '{r.kind}'}}), lambda s: s.ok) AS s
            FROM (SELECT doc_id, row, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM d)"""
        )
    text = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start::BIGINT || ':' || (s.start + s.size)::BIGINT), ',')"
    base = [r.kind for r in RULES if r.base]
    counts = ", ".join(f"len(list_filter(l, lambda s: s.kind = '{k}'))::BIGINT AS n_{k}" for k in base)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
j AS (SELECT doc_id, row, list_sort(flatten(list(s))) AS l FROM f GROUP BY doc_id, row)
SELECT doc_id, {counts}, sha256({text.format(f"list_filter(l, lambda s: s.rank < {len(base)})")}) AS base_sha256, {text.format("l")} AS spans FROM j
"""


OP3_SQL = _sql()
