"""Files of zstd frames of arrays in the shared folder, with a footer that lists the frames by name.

A file has a name never used before, so a task that runs again writes another one.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import zstandard

from tillscope.llm.common import open_store


class Frames:
    """Writes frames of arrays; the footer lists them by name."""

    def __init__(self, folder: str, name: str | None = None):
        store, base = open_store(folder)
        store.create_dir(base)
        self.name, self.at, self.index = name or f"{uuid.uuid4().hex}.frames", 0, {}
        self.sink, self.pack = store.open_output_stream(f"{base}/{self.name}"), zstandard.ZstdCompressor(level=1)

    def add(self, name: str, *arrays: np.ndarray | bytes) -> None:
        """One more frame under this name."""
        raw = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
        body = self.pack.compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))
        self.sink.write(body)
        self.index.setdefault(name, []).append((self.at, len(body)))
        self.at += len(body)

    def close(self) -> str:
        foot = json.dumps(self.index).encode()
        self.sink.write(foot + struct.pack("<q", len(foot)))
        self.sink.close()
        return self.name


class Opened:
    """Reads frames by name, one at a time."""

    def __init__(self, folder: str, name: str):
        store, base = open_store(folder)
        self.source = store.open_input_file(f"{base}/{name}")
        size = self.source.size()
        self.source.seek(size - 8)
        length = struct.unpack("<q", self.source.read(8))[0]
        self.source.seek(size - 8 - length)
        self.index = json.loads(self.source.read(length))

    def frames(self, name: str, *kinds: str) -> Iterator[list]:
        for at, length in self.index.get(name, []):
            self.source.seek(at)
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(length))
            sizes, at = struct.unpack_from(f"<{len(kinds)}q", raw), 8 * len(kinds)
            found = []
            for kind, n in zip(kinds, sizes):
                found.append(raw[at : at + n] if kind == "raw" else np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
                at += n
            yield found


def differences(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which pack better."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype))
