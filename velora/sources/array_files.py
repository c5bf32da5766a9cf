"""A sink with one .npy file a row, as a Spark data source whose files appear on commit only."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "velora-arrays"
#: Files are written below this folder of the target, by write and attempt, and moved up by the commit.
WAITING = "_waiting"


@dataclass
class Written(WriterCommitMessage):
    """The folder of the one attempt of a task that counts; empty if it had no rows."""

    folder: str
    files: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow knows by its address; a plain path is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}") if path.startswith("/") else fs.FileSystem.from_uri(path)


class ArrayFiles(DataSource):
    """Options: path, name (column of file names without ending), values (column of an array of numbers), shape (optional column: the array's shape)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter({k: self.options[k] for k in ("path", "name", "values", "shape", "write") if k in self.options}, overwrite)


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.id = options.get("write") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's rows, each in a file of its own, in a folder that no other attempt writes to."""
        store, root = _opened(self.options["path"])
        task = TaskContext.get()
        folder = f"{root}/{WAITING}/{self.id}/{task.partitionId()}-{task.taskAttemptId()}"
        seen: set[str] = set()
        for batch in iterator:
            names, values = batch.column(self.options["name"]).to_pylist(), batch.column(self.options["values"])
            shapes = batch.column(self.options["shape"]).to_pylist() if "shape" in self.options else [None] * len(names)
            for i, (name, shape) in enumerate(zip(names, shapes)):
                if not name or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"{name!r} can't be a file's name")
                if name in seen:
                    raise ValueError(f"two rows are named {name!r}")
                if not values[i].is_valid:
                    raise ValueError(f"{name!r} has no array")
                if not seen:
                    store.create_dir(folder, recursive=True)
                seen.add(name)
                array, out = values[i].values.to_numpy(zero_copy_only=False), io.BytesIO()
                np.save(out, array.reshape(shape) if shape else array, allow_pickle=False)
                with store.open_output_stream(f"{folder}/{name}.npy") as file:
                    file.write(out.getvalue())
        return Written(folder if seen else "", len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        """Move the files of the attempts that count; a name that two tasks wrote, or that is there already when nothing is to be overwritten, moves none."""
        store, root = _opened(self.options["path"])
        moves: dict[str, str] = {}
        for m in messages:
            if m is None or not m.folder:
                continue
            files = store.get_file_info(fs.FileSelector(m.folder))
            if len(files) != m.files:
                raise OSError(f"{m.folder} has {len(files)} files, not {m.files}")
            for f in files:
                if f.base_name in moves:
                    raise ValueError(f"two rows are named {f.base_name[:-4]!r}")
                moves[f.base_name] = f.path
        store.create_dir(root, recursive=True)
        there = {f.base_name: f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.endswith(".npy")}
        if not self.overwrite and (both := sorted(moves.keys() & there.keys())):
            raise FileExistsError(f"{both[:10]} are there already")
        for name, path in moves.items():
            store.move(path, f"{root}/{name}")  # over a file of that name
        if self.overwrite:
            for name in there.keys() - moves.keys():
                store.delete_file(there[name])
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.options["path"]))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        for folder in (f"{root}/{WAITING}/{self.id}", f"{root}/{WAITING}"):
            info = store.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder.endswith(self.id) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


def write_arrays(df: DataFrame, path: str, name: str, values: str, shape: str | None = None, overwrite: bool = False) -> None:
    """One file `name`.npy a row under path: all of them, or none. Tasks that are tried again leave no second file; overwrite replaces what the folder held.

    The commit moves each file once, from the driver, as renames of a file system; a name may occur once only."""
    df.sparkSession.dataSource.register(ArrayFiles)
    columns = [name, values, *([shape] if shape else [])]
    options = {"path": path, "name": name, "values": values, "write": uuid.uuid4().hex, **({"shape": shape} if shape else {})}
    df.select(*columns).write.format(FORMAT).options(**options).mode("overwrite" if overwrite else "append").save()
