"""Whole files in a shared folder, written from any executor."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def read(folder: str, name: str) -> bytes:
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def write(folder: str, name: str, data: bytes) -> None:
    """Puts a file in place whole: a task that is lost or run twice leaves no half of one.

    Where a store doesn't move onto a name that is there, the file that is there stays:
    a task that runs again writes the same.
    """
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    try:
        store.move(own, f"{path}/{name}")
    except OSError:
        if store.get_file_info(f"{path}/{name}").type != fs.FileType.File:
            raise
        store.delete_file(own)
