"""Files that tasks write and read through pyarrow's file systems (local, HDFS, S3, GCS), listed in a manifest.

A task writes under a name of its own attempt; the manifest, a table that Spark commits, names the files of the attempts
that counted. What a lost or repeated attempt leaves is in no manifest and never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def put(folder: str, suffix: str, content: bytes) -> str:
    """Write a new file; return its name in the folder."""
    from pyspark import TaskContext

    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"
    with where.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(content)
    return name


def get(folder: str, name: str) -> bytes:
    where, path = _open(folder)
    with where.open_input_file(f"{path}/{name}") as f:
        return f.readall()
