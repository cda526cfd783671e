"""Time stamps in text: templates, parsing, formatting."""

from __future__ import annotations

import datetime
import re
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directives, the digits or letters they stand for, and Spark's pattern letters.
DIRECTIVES = {
    "%Y": (r"\d{4}", "yyyy"), "%y": (r"\d{2}", "yy"), "%m": (r"\d{2}", "MM"), "%d": (r"\d{2}", "dd"), "%H": (r"\d{2}", "HH"),
    "%I": (r"\d{2}", "hh"), "%p": (r"(?:AM|PM)", "a"), "%M": (r"\d{2}", "mm"), "%S": (r"\d{2}", "ss"), "%f": (r"\d{1,6}", "SSSSSS"),
    "%z": (r"[+-]\d{2}:?\d{2}|Z", "xx"), "%Z": (r"[A-Za-z_/]+", "VV"), "%b": (r"[A-Za-z]{3}", "MMM"), "%j": (r"\d{3}", "DDD"),
    "%-m": (r"\d{1,2}", "MM"), "%-d": (r"\d{1,2}", "dd"), "%-H": (r"\d{1,2}", "HH"), "%-M": (r"\d{1,2}", "mm"), "%-S": (r"\d{1,2}", "ss"), "%-I": (r"\d{1,2}", "hh"),
}
_TOKEN = re.compile(r"%-?[A-Za-z]")


def is_valid_template(template: str) -> bool:
    """Whether every % begins a known directive and no field comes twice."""
    found = _TOKEN.findall(template)
    fields = [f.replace("-", "") for f in found]
    return all(f in DIRECTIVES for f in found) and len(set(fields)) == len(fields) and template.count("%") == len(found)


def template_pieces(template: str) -> tuple[str, list[str]]:
    """The regular expression of a template (one group per directive, all else literal) and its directives."""
    if not is_valid_template(template):
        raise ValueError(f"{template!r} isn't a valid template")
    parts, found, at = [], [], 0
    for m in _TOKEN.finditer(template):
        parts.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", template[at : m.start()]))
        parts.append(f"({DIRECTIVES[m[0]][0]})")
        found.append(m[0])
        at = m.end()
    parts.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", template[at:]))
    return "".join(parts), found


def parse(text: Column, templates: list[str]) -> Column:
    """TIMESTAMP_NTZ of the first template that the text holds, or null. Values without padding are padded."""
    tries = []
    for template in templates:
        pattern, found = template_pieces(template)
        values, letters = [], []
        for k, d in enumerate(found, 1):
            value = F.regexp_extract(text, pattern, k)
            if d.startswith("%-"):
                value = F.lpad(value, 2, "0")
            elif d == "%f":
                value = F.rpad(value, 6, "0")
            elif d == "%z":
                value = F.regexp_replace(F.regexp_replace(value, ":", ""), "^Z$", "+0000")
            values.append(value)
            letters.append(DIRECTIVES[d][1])
        zoned = {"%z", "%Z"} & set(found)
        joined, form = F.concat_ws(" ", *values), " ".join(letters)
        stamp = F.try_to_timestamp(joined, F.lit(form)).cast("timestamp_ntz") if zoned else F.to_timestamp_ntz(joined, F.lit(form))
        tries.append(F.when(F.regexp_extract(text, pattern, 0) != "", stamp))
    return F.coalesce(*tries)


def localize(stamp: Column, zone: str) -> Column:
    """The UTC time of a local time in ``zone``."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), stamp)


def convert(stamp: Column, origin: str, zone: str) -> Column:
    return F.convert_timezone(F.lit(origin), F.lit(zone), stamp)


def format_millis(stamp: Column, zone: str = "UTC") -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSS and the offset of ``zone``, of a UTC time."""
    local = convert(stamp, "UTC", zone)
    minutes = F.floor((F.unix_micros(local.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / 60_000_000).cast("int")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), offset)


def reformat(text: Column, templates: list[str], zone: str = "UTC") -> Column:
    """A time stamp in a text, read by the first template that fits and written with its offset; null where none fits."""
    return format_millis(parse(text, templates), zone)


def parse_one(text: str, templates: list[str]) -> datetime.datetime:
    """As ``parse``, of one text on the driver; where no template fits, each one's reason is told."""
    reasons = []
    for template in templates:
        if not is_valid_template(template):
            reasons.append(f"{template!r} isn't a valid template")
            continue
        pattern, found = template_pieces(template)
        match = re.search(pattern, text)
        if not match:
            reasons.append(f"{template!r} does not fit {text!r}")
            continue
        values = [v.zfill(2) if d.startswith("%-") else v for v, d in zip(match.groups(), found)]
        zones = [v for v, d in zip(values, found) if d == "%Z"]
        pairs = [(v, d.replace("-", "")) for v, d in zip(values, found) if d != "%Z"]
        try:
            stamp = datetime.datetime.strptime(" ".join(v for v, _ in pairs), " ".join(d for _, d in pairs))
            return stamp.replace(tzinfo=zoneinfo.ZoneInfo(zones[0])) if zones else stamp
        except (ValueError, zoneinfo.ZoneInfoNotFoundError) as e:
            reasons.append(f"{template!r}: {e}")
    raise ValueError("; ".join(reasons) or "no template")


def format_name(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy_MM_dd_HH_mm_ss_SSSSSS")


def walltime(seconds: Column) -> Column:
    """HH:MM:SS; hours may pass 24."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60))
