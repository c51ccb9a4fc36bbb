"""Files that tasks write beside Spark's own writers, below the shared folder."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as tasks see it, and the path there."""
    if re.match(r"file:/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def own_name(folder: str, part: int, ending: str) -> str:
    """A name no other attempt uses; readers take names from the rows of the attempts that counted."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{ending}"
