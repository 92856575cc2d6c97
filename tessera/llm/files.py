"""Binary files on shared storage, written and read by tasks through pyarrow's file systems (file, hdfs, s3, ...)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (a bare path: local)."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextmanager
def written_file(uri: str):
    """A stream whose file appears under ``uri`` only when it is complete.

    Each attempt of a task writes a file of its own and renames it, so that a lost executor or a second
    attempt leaves no half-written file; attempts write the same bytes.
    """
    at, path = opened(uri)
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with at.open_output_stream(own) as out:
        yield out
    try:
        at.move(own, path)
    except OSError:  # some file systems don't replace a file; another attempt's is as good
        if at.get_file_info(path).type != fs.FileType.File:
            raise
        at.delete_file(own)


def read_at(uri: str, start: int, size: int) -> bytes:
    at, path = opened(uri)
    with at.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the complete files in a folder, by name; the paths go with the folder's file system."""
    at, path = opened(uri)
    found = at.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix))
