"""Edits of source texts by symbol, and notes kept as files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_symbol(symbols: DataFrame, name_path: str, file: str | None = None) -> dict:
    """The one symbol that the path names; an error with the candidates if there are none or several."""
    *above, leaf = name_path.split("/")
    s = symbols.where(F.col("name") == leaf)
    s = s.where(F.col("parent") == above[-1]) if above else s
    s = s.where(F.col("file") == file) if file else s
    rows = s.orderBy("file", "line").limit(11).collect()
    if len(rows) != 1:
        raise LookupError(f"{name_path}: {len(rows)} symbols: " + ", ".join(f"{r['file']}:{r['line']}" for r in rows[:10]))
    return rows[0].asDict()


def replaced(text: str, line: int, end_line: int | None, new: str) -> str:
    lines = text.split("\n")
    return "\n".join([*lines[: line - 1], *new.rstrip("\n").split("\n"), *lines[end_line or line :]])


def inserted(text: str, line: int, end_line: int | None, new: str, after: bool) -> str:
    """The new lines before or after the symbol, an empty line between."""
    lines = text.split("\n")
    at = (end_line or line) if after else line - 1
    block = new.rstrip("\n").split("\n")
    if after:
        block = ["", *block] if lines[at - 1].strip() else block
        block = [*block, ""] if at < len(lines) and lines[at].strip() else block
    else:
        block = [*block, ""]
    return "\n".join([*lines[:at], *block, *lines[at:]])


_PART = re.compile(r"\w[\w.-]*")


def _note(folder: str, name: str) -> str:
    """Where a note lies: topic/name in a folder for the topic; of a name that is no such path, its letters in one file."""
    plain = name.removeprefix("mem:").removesuffix(".md")
    parts = plain.split("/")
    if all(_PART.fullmatch(p) for p in parts):
        return os.path.join(folder, *parts[:-1], f"{parts[-1]}.md")
    clean = re.sub(r"[^A-Za-z0-9._-]+", "-", plain).strip(".-")
    if not clean:
        raise ValueError(f"no name is left of {name!r}")
    return os.path.join(folder, f"{clean}.md")


def write_note(folder: str, name: str, text: str) -> str:
    path = _note(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def read_note(folder: str, name: str) -> str | None:
    try:
        with open(_note(folder, name), encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return None


def delete_note(folder: str, name: str) -> bool:
    try:
        os.remove(_note(folder, name))
        return True
    except FileNotFoundError:
        return False


def list_notes(folder: str) -> list[str]:
    """The names of all notes, with the topic before those that have one."""
    found = []
    for at, _, names in os.walk(folder):
        topic = os.path.relpath(at, folder).replace(os.sep, "/")
        found += [(n if topic == "." else f"{topic}/{n}").removesuffix(".md") for n in names if n.endswith(".md")]
    return sorted(found)
