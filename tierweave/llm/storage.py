"""Files in the folder that all executors share, by whatever file system its URI names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI (or of a plain path)."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def attempt_name(folder: str, part: int, suffix: str) -> str:
    """A name of its own for each attempt at a task, so that a repeated or lost attempt harms no other.

    Only files that a task's own result rows name are ever read.
    """
    return f"{folder}/part-{part:05d}-{uuid.uuid4().hex}{suffix}"
