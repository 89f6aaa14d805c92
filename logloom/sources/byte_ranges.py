"""Reading newline-terminated lines of a byte range, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

RANGE_BYTES = 32 * 1024 * 1024
READ_BYTES = 1024 * 1024  # of a range that a task holds at once
_BLOCK = 64 * 1024
_BATCH_LINES = 20_000


def locate(prefix: str, path: str) -> tuple[pafs.FileSystem, str]:
    """File system and its own path; ``prefix`` is ``scheme://authority`` or empty for local files."""
    if not prefix:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(prefix.replace("s3a://", "s3://") + quote(path))


def open_file(prefix: str, path: str):
    filesystem, inner = locate(prefix, path)
    return filesystem.open_input_file(inner)


def copy_file(source_prefix: str, source: str, target_prefix: str, target: str) -> int:
    """Copy one file in blocks and return the bytes written; missing folders are made."""
    target_fs, target_path = locate(target_prefix, target)
    target_fs.create_dir(target_path.rpartition("/")[0], recursive=True)
    with open_file(source_prefix, source) as reader, target_fs.open_output_stream(target_path) as writer:
        while block := reader.read(4 * 1024 * 1024):
            writer.write(block)
        return writer.tell()


def list_folder(prefix: str, path: str) -> list[pafs.FileInfo]:
    """What lies directly in a folder; nothing if it is gone."""
    filesystem, inner = locate(prefix, path)
    return filesystem.get_file_info(pafs.FileSelector(inner, allow_not_found=True))


def delete_file(prefix: str, path: str) -> bool:
    """Delete a file; true also if a repeated task finds it already gone."""
    filesystem, inner = locate(prefix, path)
    if filesystem.get_file_info(inner).type == pafs.FileType.File:
        filesystem.delete_file(inner)
    return True


def next_line_start(source, position: int, end: int) -> int:
    """First byte after the newline at or behind ``position``; ``end`` if there is none."""
    while position < end:
        block = source.read_at(min(_BLOCK, end - position), position)
        if not block:
            return end
        found = block.find(b"\n")
        if found >= 0:
            return position + found + 1
        position += len(block)
    return end


def last_line_end(source, start: int, end: int) -> int:
    """End of the last newline-terminated line inside [start, end); ``start`` if there is none."""
    while end > start:
        low = max(start, end - _BLOCK)
        found = source.read_at(end - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        end = low
    return start


def range_blocks(source, start: int, end: int, first: int, limit: int, size: int = READ_BYTES) -> Iterator[bytes]:
    """The whole lines that begin inside [start, end), in blocks of about ``size`` bytes that end with a line.

    ``first`` is where the unread part of the file begins and ``limit`` where it ends. A line
    belongs to the range it begins in, so ranges of one file neither overlap nor leave gaps.
    """
    position = start if start == first else next_line_start(source, start - 1, limit)
    if position >= end:
        return
    stop = end if end >= limit else next_line_start(source, end - 1, limit)
    held: list[bytes] = []
    while position < stop and (data := source.read_at(min(size, stop - position), position)):
        position += len(data)
        # A CR at the end of the block may belong to a CR LF.
        cut = data.rfind(b"\n") + 1 or data.rfind(b"\r", 0, len(data) - 1) + 1
        if cut:
            yield b"".join([*held, data[:cut]])
            held = []
        if cut < len(data):
            held.append(data[cut:])
    if held:
        yield b"".join(held)


def range_bytes(source, start: int, end: int, first: int, limit: int) -> bytes:
    """All of ``range_blocks`` at once."""
    return b"".join(range_blocks(source, start, end, first, limit))


def line_count(data: bytes) -> int:
    """Lines ended by LF, CR LF or CR; a final line needs no terminator."""
    if not data:
        return 0
    ends = data.count(b"\n")
    if b"\r" in data:
        ends += data.count(b"\r") - data.count(b"\r\n")
    return ends + (data[-1] not in b"\r\n")


def line_array(data: bytes) -> pa.StringArray:
    """The lines as one text array over the bytes themselves; invalid UTF-8 becomes U+FFFD."""
    if b"\r" in data:
        data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if data and not data.endswith(b"\n"):
        data += b"\n"
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    # Without the line ends every line ends as many bytes earlier as there are line ends before it.
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    lines = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data.replace(b"\n", b"")))
    try:
        lines.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([line.decode("utf-8", "replace") for line in data.split(b"\n")[:-1]], pa.string())
    return lines


def line_batches(data: bytes) -> Iterator[tuple[int, pa.Array]]:
    """(offset of the first line, text array) in batches."""
    lines = line_array(data)
    for at in range(0, len(lines), _BATCH_LINES):
        yield at, lines.slice(at, _BATCH_LINES)
