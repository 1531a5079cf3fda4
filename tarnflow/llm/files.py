"""Files in the shared folder, from executors: any store that pyarrow opens by URI."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (or of a local path) and the path within it."""
    if not re.match(r"\w[\w+.-]+:", uri):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)


def fresh(uri: str, suffix: str) -> str:
    """A file name no other task attempt uses: what a lost or repeated attempt leaves is never read."""
    return f"{uri}/{uuid.uuid4().hex}{suffix}"


def delete(uri: str) -> None:
    fs, path = opened(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:
        fs.delete_file(path)
