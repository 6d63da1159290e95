"""Binary files written and read by tasks, in any store that pyarrow can open.

A task writes to a file name of its own and reports it in its result rows. The
rows of a failed or duplicate attempt are never committed by Spark, so its file
is never named and never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain local path."""
    return pafs.FileSystem.from_uri(uri)


def own_name(suffix: str) -> str:
    return uuid.uuid4().hex + suffix


class Sink:
    """A new file below ``base``; ``uri`` names it, ``size`` counts its bytes."""

    def __init__(self, base: str, suffix: str, name: str | None = None):
        """With a ``name`` the file appears under it when it is closed, so that a repeated task replaces like by like."""
        own = f"{base}/{own_name(suffix)}"
        self.uri = own if name is None else f"{base}/{name}{suffix}"
        self._fs, self._path = open_store(own)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._out, self.size = self._fs.open_output_stream(self._path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Appends; returns the offset at which the data starts."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._out.close()
        target = open_store(self.uri)[1]
        if target != self._path:
            self._fs.move(self._path, target)


def open_input(uri: str):
    fs, path = open_store(uri)
    return fs.open_input_file(path)


def chunks(uri: str, size: int = 1 << 20):
    """The bytes of a file in pieces of bounded size."""
    with open_input(uri) as f:
        while data := f.read(size):
            yield data
