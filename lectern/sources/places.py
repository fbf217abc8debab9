"""Files for readers and writers in Python: local or shared folders, and the stores that pyarrow opens by URI."""

import posixpath
import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. `file:/x`, as Hadoop writes it, is a local path."""
    if re.match(r"[a-z][a-z0-9+.-]+://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def files_below(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes), sorted, of the files below a folder; those whose name or folder begins with `.` or `_` are left out, a missing folder has none."""
    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(root) :].split("/") if x)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not hidden(f.path))


def joined(root: str, name: str) -> str:
    """The path of a name below a folder; a name that leads out of it is refused."""
    path = posixpath.normpath(posixpath.join(root, name))
    if not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"not below the folder: {name}")
    return path
