"""Arrays that tasks write to the shared store once and that workers memory-map."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np

#: Files that one worker holds mapped at a time.
OPEN_FILES = 4096


def _local(folder: str) -> str | None:
    at = urlparse(folder)
    return at.path if at.scheme in ("", "file") else None


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _bytes(arrays: tuple[np.ndarray, ...]) -> bytes:
    head = [len(arrays)]
    for a in arrays:
        head += [a.dtype.itemsize, len(a)]
    parts = [np.array(head, dtype=np.int64).tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        parts += [raw, b"\0" * (-len(raw) % 8)]
    return b"".join(parts)


def put(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write unsigned arrays as one file; a task that runs twice replaces it by the same bytes, never by half of them."""
    data, local = _bytes(arrays), _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def _mapped(path: str) -> list[np.ndarray]:
    whole = np.memmap(path, dtype=np.uint8, mode="r")
    n = int(whole[:8].view(np.int64)[0])
    head = whole[8 : 8 + 16 * n].view(np.int64)
    out, at = [], 8 + 16 * n
    for size, length in head.reshape(n, 2).tolist():
        out.append(np.asarray(whole[at : at + size * length]).view(f"u{size}"))
        at += -(-size * length // 8) * 8
    return out


def load(folder: str, name: str) -> list[np.ndarray]:
    """The file's arrays as read-only memory maps, for files that a task reads once. A store that can't be mapped is copied to the worker first; the copy goes with the map."""
    local = _local(folder)
    if local is not None:
        return _mapped(f"{local}/{name}")
    from pyarrow import fs

    store, there = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{there}/{name}") as f, tempfile.NamedTemporaryFile() as out:
        shutil.copyfileobj(f, out)
        out.flush()
        return _mapped(out.name)


@lru_cache(maxsize=OPEN_FILES)
def get(folder: str, name: str) -> list[np.ndarray]:
    """As ``load``, for files that a worker asks again and again."""
    return load(folder, name)
