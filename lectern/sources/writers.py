"""One file for each row, written so that a failed job leaves nothing and a repeated one changes nothing.

Tasks write under temporary names in a hidden folder beside the files, with a list of
what they wrote. When all tasks are done, the driver renames; a file that stands at a
final name is replaced only if it is ours. If a task fails for good, the hidden folder
goes. A task that is tried again writes under other names.
"""

import contextlib
import json
import posixpath
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lectern.sources.places import joined, opened

#: Begins the names of hidden folders.
STAGING = ".writing-"
HEAD_BYTES = 4096
KEEP, REPLACE, FAIL = "keep", "replace", "fail"


@dataclass
class Written(WriterCommitMessage):
    """Where a task left its list, and how many files are in it; nothing that grows with the files goes to the driver in messages."""

    listing: str
    files: int


def front_matter_has(head: bytes, marker: str) -> bool:
    """Whether the front matter at the head of a file names the marker."""
    if not head.startswith(b"---"):
        return False
    end = head.find(b"\n---", 3)
    return marker.encode() in (head if end < 0 else head[:end])


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.marker = options["path"], options.get("marker", "")
        self.foreign = options.get("foreign", KEEP)
        if self.foreign not in (KEEP, REPLACE, FAIL):
            raise ValueError(f"foreign must be {KEEP}, {REPLACE} or {FAIL}")
        system, root = opened(self.path)
        self.staging = posixpath.join(root, f"{STAGING}{uuid.uuid4().hex}")
        system.create_dir(self.staging, recursive=True)

    def write(self, rows) -> Written:
        system, root = opened(self.path)
        own = posixpath.join(self.staging, uuid.uuid4().hex)  # of this attempt of the task
        system.create_dir(own, recursive=False)  # a task that outlives its job finds no hidden folder and fails
        listing, n = posixpath.join(own, "files"), 0
        with system.open_output_stream(listing) as names:
            for row in rows:
                if row["path"] is None or row["content"] is None:
                    continue
                final = joined(root, row["path"])
                content = row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"])
                with system.open_output_stream(posixpath.join(own, str(n))) as f:
                    f.write(content)
                names.write(json.dumps([str(n), final]).encode() + b"\n")
                n += 1
        return Written(listing, n)

    def _is_ours(self, system, path: str) -> bool:
        if self.foreign == REPLACE:
            return True
        with system.open_input_stream(path) as f:
            return bool(self.marker) and front_matter_has(f.read(HEAD_BYTES), self.marker)

    def _place(self, system, own: str, name: str, final: str) -> None:
        there = system.get_file_info(final).type != fs.FileType.NotFound
        if there and not self._is_ours(system, final):
            if self.foreign == FAIL:
                raise FileExistsError(f"{final} is not ours")
            return
        system.create_dir(posixpath.dirname(final), recursive=True)
        system.move(posixpath.join(own, name), final)  # in a local file system at once, over the old file

    def commit(self, messages) -> None:
        """Renames; a run that is cut off here is repeated without harm, as names and contents are the same."""
        system, _ = opened(self.path)
        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is None:
                    continue
                own = posixpath.dirname(m.listing)
                with system.open_input_stream(m.listing) as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                if self.foreign == FAIL:  # before anything is renamed
                    for final in pool.map(lambda e: e[1] if system.get_file_info(e[1]).type != fs.FileType.NotFound and not self._is_ours(system, e[1]) else None, entries):
                        if final:
                            self._drop()
                            raise FileExistsError(f"{final} is not ours")
                list(pool.map(lambda e: self._place(system, own, *e), entries))
        self._drop()

    def abort(self, messages) -> None:
        self._drop()

    def _drop(self) -> None:
        system, _ = opened(self.path)
        for _ in range(20):  # a task that is being stopped may still write
            if system.get_file_info(self.staging).type != fs.FileType.Directory:
                return
            with contextlib.suppress(OSError):
                system.delete_dir(self.staging)
            time.sleep(0.05)


class Files(DataSource):
    """Format `files` for writing (path, content): content (text or bytes) as the file at path below the option `path`.

    Options: marker (text that the front matter of our files has), foreign (what is done where a file that is not ours
    stands: `keep` it, `replace` it, or `fail`). Rows with a null are left out; of rows with one path any may stay, so
    paths should be unique (see batches.unique_names). Nothing at other paths is touched.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        names = set(schema.fieldNames())
        if not {"path", "content"} <= names:
            raise ValueError("rows need path and content")
        return FileWriter(self.options)


def write_files(rows: DataFrame, path: str, marker: str = "", foreign: str = KEEP) -> None:
    """rows (path, content) as files below a folder that the driver and all executors share."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("path", "content").write.format("files").mode("append").option("marker", marker).option("foreign", foreign).save(path)
