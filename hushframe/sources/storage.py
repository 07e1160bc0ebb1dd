"""Files for sources and sinks that run in Python: any folder that the driver and all executors reach."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (plain paths, file:, hdfs:, s3:, s3a:, gs:) and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    uri = path.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    files, inner = fs.FileSystem.from_uri(uri)
    return files, inner.rstrip("/")


def files_below(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder whose names end so, by path; none of a folder that isn't there."""
    files, inner = storage(path)
    found = files.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending))


def read_text(files: fs.FileSystem, path: str) -> str:
    with files.open_input_stream(path, compression=None) as stream:
        return stream.read().decode("utf-8", "replace")


def put_json(path: str, name: str, value) -> None:
    """Write a small file so that it is there as a whole or not at all; one of that name is replaced."""
    files, inner = storage(path)
    files.create_dir(inner, recursive=True)
    passing = f"{inner}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(passing) as stream:
        stream.write(json.dumps(value).encode())
    files.move(passing, f"{inner}/{name}")


def write_files(rows: DataFrame, path: str) -> None:
    """Files of rows(file, line), in the folder `path`: a row's text and a line end after the one before of its file.

    Rows of a file have to lie together, in order, in one partition. file: a path within the folder, made into a file name by
    the caller. Tasks write each file aside and move it into place, so one that runs again replaces its files. Null lines are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = storage(path)
        at = stream = passing = None
        folders, n = set(), 0

        def done() -> None:
            if stream is not None:
                stream.close()
                files.move(passing, f"{inner}/{at}")

        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != at:
                    done()
                    at, n = file, n + 1
                    folder, name = posixpath.split(f"{inner}/{file}")
                    if len(folders) > 10_000:
                        folders.clear()
                    if folder not in folders:
                        files.create_dir(folder, recursive=True)
                        folders.add(folder)
                    passing = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    stream = files.open_output_stream(passing, compression=None)
                if line.is_valid:
                    stream.write(line.as_buffer())
                    stream.write(b"\n")
        done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    storage(path)[0].create_dir(storage(path)[1], recursive=True)
    rows.select("file", "line").mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
