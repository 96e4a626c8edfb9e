"""Binary files in the shared folder, written and read by tasks."""
from __future__ import annotations

import uuid

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = _place(uri)
    system.create_dir(path, recursive=True)


class Writer:
    """A file that appears under its name when it is closed, so that a lost task leaves none that are half written
    and a repeated task writes the same one again."""

    def __init__(self, uri: str):
        self.system, self.path = _place(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.stream, self.size = self.system.open_output_stream(self.draft), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.path)


def reader(uri: str):
    """An open stream over a whole file."""
    system, path = _place(uri)
    return system.open_input_stream(path, compression=None)
