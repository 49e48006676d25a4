"""Byte files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import os
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def _resolve(uri: str):
    """(pyarrow file system or None for a plain path, path)."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path) if parts.scheme else uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> BinaryIO:
    system, path = _resolve(uri)
    if system is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    return system.open_output_stream(path)


def read_table(uri: str):
    """A Parquet file as an Arrow table."""
    from pyarrow import parquet

    system, path = _resolve(uri)
    return parquet.read_table(path, filesystem=system, partitioning=None)


class RangeReader:
    """Random reads; the last opened file stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = _resolve(uri)
            self.file = open(path, "rb") if system is None else system.open_input_file(path)  # noqa: SIM115
            self.uri = uri
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri = self.file = None
