"""Binary files in the shared folder: memory-mapped where it is a mounted file system, else through Arrow's file systems."""

import mmap
import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def _local(path: str) -> str | None:
    url = urlparse(path)
    return unquote(url.path) if url.scheme in ("", "file") else None


def write_file(path: str, chunks: list[bytes] | tuple[bytes, ...]) -> None:
    """Writes all bytes under another name first, so that a repeated or lost task leaves whole files only."""
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{local}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            for chunk in chunks:
                f.write(chunk)
        os.replace(draft, local)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        for chunk in chunks:
            f.write(chunk)
    store.move(draft, name)


def read_array(path: str, dtype: str) -> np.ndarray:
    """The file as a flat array: a memory map if it is mounted."""
    if (local := _local(path)) is not None:
        if not os.path.getsize(local):
            return np.empty(0, dtype)
        with open(local, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)
