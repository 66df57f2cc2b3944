"""Files that tasks write and read themselves, in the folder that a cluster shares."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    if local := re.match(r"(?:file:/*)?(?=/)|file:/+", uri):
        return fs.LocalFileSystem(), "/" + uri[local.end() :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str):
    """A file to write that gets its name only when it is whole.

    Attempts of one task write under names of their own, and the last step is a
    rename; a lost executor leaves at most a ``.tmp`` file that nobody reads, and a
    repeated task replaces the file with the same bytes.
    """
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(temporary) as out:
            yield out
    except BaseException:
        system.delete_file(temporary)
        raise
    system.move(temporary, path)
