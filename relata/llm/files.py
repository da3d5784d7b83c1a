"""Small files in the shared folder, from the driver or an executor, on any file system that Arrow knows."""

from __future__ import annotations

import functools
import uuid

import pyarrow.fs as pafs


@functools.lru_cache(maxsize=16)
def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write(folder: str, name: str, chunks) -> str:
    """Write a new file under a name of its own (so a task that runs twice never changes a file that is in use); returns the name."""
    fs, path = _open_fs(folder)
    fs.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(f"{path}/{own}") as out:
        for chunk in chunks:
            out.write(chunk)
    return own


def writer(folder: str, name: str):
    """(name, open stream) of a new file, as :func:`write`."""
    fs, path = _open_fs(folder)
    fs.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex[:12]}"
    return own, fs.open_output_stream(f"{path}/{own}")


def reader(folder: str, name: str):
    """A random access file."""
    fs, path = _open_fs(folder)
    return fs.open_input_file(f"{path}/{name}")
