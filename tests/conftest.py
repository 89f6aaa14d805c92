import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "logloom-tests", shuffle_partitions=4)
    yield session
    session.stop()


def line(**record) -> str:
    return json.dumps(record, separators=(",", ":"))


def write_lines(path: Path, *lines: str, newline_at_end: bool = True, append: bool = False) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join(lines) + ("\n" if newline_at_end else "")
    with open(path, "a" if append else "w", encoding="utf-8", newline="") as out:
        out.write(text)
