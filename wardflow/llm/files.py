"""Arrays in files of the shared folder, mapped into memory where it is local."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow.fs as pafs

_ALIGN = 64


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder named as Spark names it, and the path there."""
    for own, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(own):
            uri = arrow + uri.removeprefix(own)
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file whole: a rerun task replaces it by the same content."""
    fs, path = located(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(data)
    fs.move(draft, path)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    parts, listed, at = [], [], 0
    for name, array in arrays.items():
        raw = np.ascontiguousarray(array).tobytes()
        listed.append((name, array.dtype.str, len(array), at))
        raw += b"\0" * (-len(raw) % _ALIGN)
        parts.append(raw)
        at += len(raw)
    head = json.dumps(listed).encode()
    head += b" " * (-(len(head) + 8) % _ALIGN)
    write_bytes(uri, len(head).to_bytes(8, "little") + head + b"".join(parts))


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file; a local file is mapped, not read."""
    fs, path = located(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)  # a plain array is indexed faster
    else:
        with fs.open_input_file(path) as source:
            raw = np.frombuffer(source.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = 8 + size
    return {name: raw[start + at:start + at + n * np.dtype(kind).itemsize].view(kind)
            for name, kind, n, at in json.loads(raw[8:start].tobytes())}
