"""Files that tasks write to and read from the shared folder, by URI, through Arrow's file systems."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow.fs as fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A file to write; what a failed attempt leaves has a name that no one reads."""
    system, path = place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        yield out


@contextmanager
def reading(uri: str):
    system, path = place(uri)
    with system.open_input_file(path) as source:
        yield source
