"""Raw arrays in the shared folder: written once by a task, memory-mapped by every other."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_mapped: dict[str, np.ndarray] = {}
_folder = ""


def _local(uri: str) -> str | None:
    """The path, if the shared folder is mounted."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_array(uri: str, values: np.ndarray) -> None:
    """The file appears whole or not at all; a task that runs again writes the same."""
    path, part = _local(uri), f".{uuid.uuid4().hex}"
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + part, "wb") as f:
            f.write(np.ascontiguousarray(values).data)
        os.replace(path + part, path)
    else:
        store, name = fs.FileSystem.from_uri(uri)
        store.create_dir(name.rpartition("/")[0])
        with store.open_output_stream(name + part) as f:
            f.write(np.ascontiguousarray(values).data)
        store.move(name + part, name)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The array, memory-mapped: in place where the folder is mounted, else from a copy that only this process holds."""
    global _folder
    if (folder := uri.rpartition("/")[0]) != _folder:
        _mapped.clear()
        _folder = folder
    if uri not in _mapped:
        if path := _local(uri):
            _mapped[uri] = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        else:
            store, name = fs.FileSystem.from_uri(uri)
            with tempfile.TemporaryFile() as f, store.open_input_stream(name) as source:
                while chunk := source.read(1 << 22):
                    f.write(chunk)
                f.flush()
                _mapped[uri] = np.memmap(f, dtype, "r") if f.tell() else np.zeros(0, dtype)
    return _mapped[uri]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as the byte planes of their steps, which shuffles compress well."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    return n.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n
