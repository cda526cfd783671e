"""Parameters as JSON and back: every parameter class to a dictionary with a type tag, and from one."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from enum import IntFlag

from ..functions.signal import Instrument
from ..functions.spectral import Fft, Scale, ScalePart
from ..operators.signals import Chain

_KNOWN: dict[str, type] = {c.__name__: c for c in (Instrument, Fft, Scale, ScalePart, Chain)}


def known(cls: type) -> type:
    """Adds a parameter class; to be used as a decorator as well."""
    _KNOWN[cls.__name__] = cls
    return cls


def to_dict(value):
    if is_dataclass(value) and type(value).__name__ in _KNOWN:
        return {"type": type(value).__name__, **{f.name: to_dict(getattr(value, f.name)) for f in fields(value) if f.init}}
    if isinstance(value, IntFlag):
        return int(value)
    if isinstance(value, (list, tuple)):
        return [to_dict(v) for v in value]
    if isinstance(value, dict):
        return {k: to_dict(v) for k, v in value.items()}
    return value


def from_dict(value):
    """What ``to_dict`` gave; lists come back as tuples inside parameter classes. An unknown type is refused."""
    if isinstance(value, dict) and "type" in value:
        if value["type"] not in _KNOWN:
            raise KeyError(value["type"])
        tuples = lambda v: tuple(map(tuples, v)) if isinstance(v, list) else v
        return _KNOWN[value["type"]](**{k: tuples(from_dict(v)) for k, v in value.items() if k != "type"})
    if isinstance(value, dict):
        return {k: from_dict(v) for k, v in value.items()}
    if isinstance(value, list):
        return [from_dict(v) for v in value]
    return value


def dumps(value) -> str:
    return json.dumps(to_dict(value), indent=4, sort_keys=True)


def loads(text: str):
    return from_dict(json.loads(text))


def spectrum_of(described: dict) -> tuple[str, Fft, int | None]:
    """Which kind of spectrum a description is of: a long-term average where it has a number of time bins, else a plain one."""
    if "fft" not in described:
        raise KeyError("fft")
    bins = described.get("nb_ltas_time_bins")
    fft = described["fft"]
    fft = fft if isinstance(fft, Fft) else from_dict(fft) if "type" in fft else Fft(tuple(fft["win"]), fft["hop"], fft["fs"], fft.get("mfft"), fft.get("scale_to"))
    return ("ltas" if bins else "spectro"), fft, bins
