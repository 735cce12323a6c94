"""Files of any store from inside tasks, where no JVM is at hand: opened, read by byte ranges, and
written beside their place and then renamed. A place without a scheme is a local or mounted
folder; a store that isn't known here is an error, never a folder on the worker's own disk."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyarrow import fs as arrow_fs


def store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a place and the path inside it."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri.removeprefix("file:")
        return arrow_fs.FileSystem.from_uri(uri)
    return arrow_fs.LocalFileSystem(), uri


def inside(root: str, path: str) -> str:
    """The place of a path below a folder; parts that leave the folder are an error."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if ".." in parts or not parts:
        raise ValueError(f"{path!r} is no place below {root}")
    return "/".join([root.rstrip("/"), *parts])


def put(uri: str, content: bytes) -> None:
    """Write a whole file: under a name of its own first, then moved to its place."""
    files, path = store(uri)
    folder, name = os.path.split(path)
    files.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as f:
        f.write(content)
    files.move(part, path)


def ranged(uri: str) -> tuple[Callable[[int, int], bytes], int]:
    """A reader of (begin, length) of a file, and the file's length."""
    files, path = store(uri)
    f = files.open_input_file(path)

    def read(begin: int, n: int) -> bytes:
        f.seek(begin)
        return f.read(n)

    return read, f.size()
