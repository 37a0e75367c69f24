"""Files in the shared folder, opened by workers in any store that Arrow reaches."""

from __future__ import annotations

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (file:/a, hdfs://h/a, /a), and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> None:
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
