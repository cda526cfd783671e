"""Places of regular-expression matches as columns, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters that are set around matches; where a text holds them itself, they count as replacement characters.
_OPEN, _CLOSE = "\ue001", "\ue002"
#: Pieces whose lengths are summed one by one; the sums before them are kept by block.
_BLOCK = 32


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0, when: Column | None = None) -> Column:
    """All leftmost, non-overlapping matches of ``text``: the pieces of the text, a stretch between matches and a match in
    turn. Null where ``when`` rules a match out.

    The text is searched once: marks are set around the matches and the text is cut at the marks. To be
    kept in a column of its own; ``placed`` reads it.
    """
    plain = F.translate(text, _OPEN + _CLOSE, "\ufffd\ufffd")
    pieces = F.split(F.regexp_replace(plain, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    return pieces if when is None else F.when(when, pieces)


def placed(pieces: Column, pattern: str | None = None, group: int = 0) -> Column:
    """The spans of a ``matches`` column: start and end in code points (end exclusive), match, and the ``group`` of the pattern.

    Places are running sums of the pieces' lengths, by blocks and inside a block, so that the work per match does not grow
    with the matches of a text.
    """

    def blocks(sizes: Column) -> Column:
        n = F.ceil(F.size(sizes) / _BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda s, v: s + v))
        return let(sums, lambda own: F.transform(own, lambda _, b: F.aggregate(F.slice(own, F.lit(1), b), F.lit(0), lambda s, v: s + v)))

    def spans(own: Column, sizes: Column, before: Column) -> Column:
        def one(k: Column) -> Column:
            i = k * 2 + 1
            inside = F.aggregate(F.slice(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK), F.lit(0), lambda s, v: s + v)
            start, hit = F.get(before, F.floor(i / _BLOCK).cast("int")) + inside, F.get(own, i)
            part = F.regexp_extract(hit, pattern, group) if group else F.lit(None).cast("string")
            return F.struct(start.alias("start"), (start + F.get(sizes, i)).alias("end"), hit.alias("hit"), part.alias("part"))

        return F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / 2).cast("int") - 1), one)

    none = F.array().cast("array<struct<start:int,end:int,hit:string,part:string>>")
    found = let(F.transform(pieces, lambda p: F.length(p)), lambda sizes: let(blocks(sizes), lambda before: spans(pieces, sizes, before)))
    return F.when(F.size(pieces) > 1, found).otherwise(none)


def ranked(kind: str, rank: int, found: Column) -> Column:
    """Spans as (start, rank, end, kind), which sort by place and then by rank."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def as_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
