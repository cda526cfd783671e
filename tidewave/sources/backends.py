"""Audio file formats behind one protocol, read by seeking: headers without bodies, samples by frame range.

A backend knows the suffixes of its files, reads a header and reads frames from an open file. Further formats
are added with ``register`` on the driver; what runs on workers takes the registry along (``travelling``), so that
files are read by the same backends there. Files are opened through Arrow's file systems, by URI, where the task runs; nothing but
the bytes that are asked for is read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import wraps
from importlib import import_module
from typing import BinaryIO, NamedTuple, Protocol

import numpy as np


class Info(NamedTuple):
    rate: int
    frames: int
    channels: int


class AudioBackend(Protocol):
    suffixes: tuple[str, ...]

    def info(self, file: BinaryIO) -> Info: ...

    def read(self, file: BinaryIO, start: int, stop: int) -> np.ndarray:
        """Frames by channels as float64; bounds are checked before."""
        ...


class Layout(NamedTuple):
    """Where the samples of a WAV file lie: kind (1 PCM, 3 float), bytes of a sample, offset of the first frame."""

    kind: int
    width: int
    at: int
    info: Info


def wav_layout(file: BinaryIO) -> Layout:
    """From the chunk headers alone; the samples are not read."""
    size = file.seek(0, 2)
    file.seek(0)
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    form = None
    at = 12
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            form = file.read(min(length, 40))
        elif name == b"data":
            if form is None or len(form) < 16:
                break
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
            if kind == 0xFFFE and len(form) >= 26:
                kind = struct.unpack_from("<H", form, 24)[0]
            width = bits // 8
            if (kind, width) not in ((1, 1), (1, 2), (1, 3), (1, 4), (3, 4), (3, 8)) or not channels or not rate:
                raise ValueError("unsupported sample format")
            held = min(length, size - at - 8)
            return Layout(kind, width, at + 8, Info(rate, held // (channels * width), channels))
        at += 8 + length + length % 2
    raise ValueError("no format or data chunk")


def decode(raw: bytes, kind: int, width: int) -> np.ndarray:
    """PCM samples in [-1, 1), floats as they are."""
    if kind == 3:
        return np.frombuffer(raw, dtype=f"<f{width}").astype(float)
    if width == 1:
        return (np.frombuffer(raw, dtype=np.uint8).astype(float) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    return np.frombuffer(raw, dtype=f"<i{width}") / float(1 << (8 * width - 1))


class Wav:
    suffixes = (".wav",)

    def info(self, file: BinaryIO) -> Info:
        return wav_layout(file).info

    def read(self, file: BinaryIO, start: int, stop: int) -> np.ndarray:
        own = wav_layout(file)
        step = own.info.channels * own.width
        file.seek(own.at + start * step)
        return decode(file.read((stop - start) * step), own.kind, own.width).reshape(-1, own.info.channels)


_KNOWN: dict[str, AudioBackend] = {}


def register(backend: AudioBackend) -> None:
    """Later backends take the place of earlier ones with the same suffix."""
    for suffix in backend.suffixes:
        _KNOWN[suffix.lower()] = backend


register(Wav())


def known() -> dict[str, AudioBackend]:
    """All backends by suffix, as they are now."""
    return dict(_KNOWN)


def adopt(others: dict[str, AudioBackend]) -> None:
    """Registers backends that another process knows."""
    _KNOWN.update(others)


def named(names: str) -> dict[str, AudioBackend]:
    """Backends given as ``module:class``, comma-separated; modules are imported where this runs."""
    found = [getattr(import_module(module), name)() for module, _, name in (n.strip().partition(":") for n in names.split(",") if n.strip())]
    return {suffix.lower(): backend for backend in found for suffix in backend.suffixes}


def travelling(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run``, a generator for Arrow batches, with the backends that are registered here and now, wherever it runs."""
    own = known()

    @wraps(run)
    def there(*args):
        adopt(own)
        yield from run(*args)

    return there


def suffixes() -> list[str]:
    return sorted(_KNOWN)


def backend_for(path: str) -> AudioBackend:
    found = re.search(r"\.[^./\\]+$", path)
    if not found or found[0].lower() not in _KNOWN:
        raise ValueError(f"no backend reads {path!r}")
    return _KNOWN[found[0].lower()]


def location(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))
    return fs.LocalFileSystem(), path


def open_input(path: str) -> BinaryIO:
    system, inner = location(path)
    return system.open_input_file(inner)


def info(path: str) -> Info:
    with open_input(path) as file:
        return backend_for(path).info(file)


def read(path: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Frames [start, stop) by channels; bounds that the file does not hold are refused."""
    backend = backend_for(path)
    with open_input(path) as file:
        total = backend.info(file).frames
        stop = total if stop is None else stop
        if not 0 <= start < max(total, 1) or not start <= stop <= total:
            raise ValueError(f"frames {start} to {stop} are out of the bounds of {path!r}, which has {total}")
        return backend.read(file, start, stop)


def stream(path: str, start: int = 0, stop: int | None = None, chunk: int = 8_192):
    """Frames [start, stop) in pieces of at most ``chunk``."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    backend = backend_for(path)
    with open_input(path) as file:
        total = backend.info(file).frames
        last = total if stop is None else stop
        if not 0 <= start <= last <= total:
            raise ValueError("frames out of bounds")
        for at in range(start, last, chunk):
            yield backend.read(file, at, min(last, at + chunk))
