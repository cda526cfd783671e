"""Small helpers on names, paths, command lines and records."""

from __future__ import annotations

import posixpath
import re
from dataclasses import fields, is_dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def argument_string(arguments: dict) -> str:
    """A command line: ``--flag`` or ``--no-flag`` for booleans, nothing for None, else ``--key value`` (lists: several values)."""
    out = []
    for key, value in arguments.items():
        name = key.replace("_", "-")
        if value is None:
            continue
        if isinstance(value, bool):
            out.append(f"--{name}" if value else f"--no-{name}")
        else:
            out.append(f"--{name} " + (" ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)))
    return " ".join(out)


def is_absolute(path: str) -> bool:
    """On any system: a root, a drive, a share, or a URI."""
    return bool(re.match(r"[/\\]|[A-Za-z]:[/\\]|[A-Za-z][A-Za-z0-9+.-]+:/", path))


def within(base: str, path: str) -> str:
    """The path, joined to the base if relative, without ``.`` and ``..``; one that leaves the base is refused."""
    slashed = path.replace("\\", "/")
    whole = slashed if is_absolute(path) else f"{base.rstrip('/')}/{slashed}"
    scheme, _, rest = whole.rpartition("://")
    own, (base_scheme, _, base_rest) = posixpath.normpath(rest), base.rpartition("://")
    inside = posixpath.normpath(base_rest)
    if scheme != base_scheme or (own != inside and not own.startswith(inside.rstrip("/") + "/")):
        raise ValueError(f"{path!r} is not inside {base!r}")
    return f"{scheme}://{own}" if scheme else own


def relative_to(base: str, path: str) -> str:
    whole, inside = within(base, path), within(base, base)
    return "." if whole == inside else whole[len(inside) + 1 :]


def inside(path: Column, base: str) -> Column:
    """Whether a relative path stays inside its base: no root, and never more ``..`` than names before it."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")),
        lambda s, p: F.struct(
            (s["d"] + F.when(p == "..", -1).when((p == ".") | (p == ""), 0).otherwise(1)).alias("d"),
            F.least(s["least"], s["d"] + F.when(p == "..", -1).when((p == ".") | (p == ""), 0).otherwise(1)).alias("least"),
        ),
        lambda s: s["least"],
    )
    absolute = path.rlike(r"^(?:[/\\]|[A-Za-z]:[/\\]|[A-Za-z][A-Za-z0-9+.-]+:/)")
    return F.when(absolute, F.startswith(path, F.lit(base.rstrip("/") + "/")) & ~path.contains("..")).otherwise(depth >= 0)


def is_empty_record(record) -> bool:
    """Whether no field of a dataclass is set."""
    if not is_dataclass(record):
        raise TypeError("not a record")
    return all(getattr(record, f.name) is None for f in fields(record))


def all_null(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c.isNotNull(), F.lit(False)) for c in columns], F.lit(True))
