"""Files in the folder that driver and executors share.

Tasks write under a name of their own and rename when they are done, so that a task that runs again, or
twice at once, leaves whole files only; a manifest that Spark writes says which of them count. The folder is
reached through pyarrow's file systems (local paths, HDFS, object stores).
"""

from __future__ import annotations

import uuid

from pyarrow import fs

from evidenceloom.sources.scratch import folder, lean, removed, scratch, written

__all__ = ["AtomicFile", "folder", "lean", "opened", "removed", "scratch", "written"]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, on a driver or executor."""
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that has its final name only when it was closed without an error."""

    def __init__(self, uri: str):
        self.uri = uri
        self.system, self.path = opened(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)

    def __enter__(self):
        self.stream = self.system.open_output_stream(self.part)
        return self.stream

    def __exit__(self, kind, *rest):
        self.stream.close()
        if kind or self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.part)  # failed, or a task before this one made the same file
        else:
            self.system.move(self.part, self.path)
