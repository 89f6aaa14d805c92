"""Binary files of tasks in the shared folder, whatever store it is in."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def written(path: str) -> Iterator[BinaryIO]:
    """A new file that appears under its name when it is whole, so attempts of a task can't mix."""
    store, name = located(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, name)


def opened(path: str):
    """A file to read from and seek in."""
    store, name = located(path)
    return store.open_input_file(name)


def mapped(path: str, dtype: str) -> np.ndarray:
    """The numbers of a file: memory-mapped where the store is a file system, else read."""
    store, name = located(path)
    if store.get_file_info(name).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, dtype, "r")
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read(), dtype)
