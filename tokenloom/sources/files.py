"""Small metadata files on any file system Arrow can reach (local, HDFS, object stores)."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import pyarrow.fs as pafs


# Names under which Spark reads an object store, and the one Arrow has for it. Fixed values.
_SAME_STORE = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}


def uri(path: str) -> str:
    """A path as a URI that Arrow opens: absolute, and with Arrow's name of the store."""
    if path.startswith("file:/"):
        return "file:///" + path[len("file:/") :].lstrip("/")
    if path.startswith("dbfs:/"):
        return "file:///dbfs/" + path[len("dbfs:/") :].lstrip("/")
    if "://" in path:
        scheme, rest = path.split("://", 1)
        return f"{_SAME_STORE.get(scheme, scheme)}://{rest}"
    return "file://" + os.path.abspath(path)


def spark_path(path: str) -> str:
    """A path as Spark opens it: a bare one is a local path of the driver, made absolute."""
    return path if ":/" in path else "file://" + os.path.abspath(path)


def open_fs(path: str):
    return pafs.FileSystem.from_uri(uri(path))


def exists(path: str) -> bool:
    fs, base = open_fs(path)
    return fs.get_file_info(base).type != pafs.FileType.NotFound


def read_bytes(path: str) -> bytes:
    fs, base = open_fs(path)
    with fs.open_input_stream(base) as source:
        return source.read()


def write_new(path: str, content: bytes) -> None:
    """Write to a path that must not exist yet."""
    if exists(path):
        raise ValueError(f"{path} already exists; choose a new one")
    write_over(path, content)


def write_over(path: str, content: bytes) -> None:
    """Write a file, or replace it; readers never see half of one."""
    fs, base = open_fs(path)
    folder, name = base.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(content)
    fs.move(draft, base)


def write_pieces(path: str, pieces) -> None:
    """Like :func:`write_new` for a long text that comes in pieces."""
    if exists(path):
        raise ValueError(f"{path} already exists; choose a new one")
    fs, base = open_fs(path)
    folder, name = base.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for piece in pieces:
            out.write(piece.encode())
    fs.move(draft, base)


def read_json(path: str):
    return json.loads(read_bytes(path))


def write_json(path: str, value) -> None:
    write_new(path, json.dumps(value, indent=2, sort_keys=True).encode())


def sha256(path: str) -> str:
    return hashlib.sha256(read_bytes(path)).hexdigest()
