"""Bytes of a file to text."""

from __future__ import annotations


def decoded(data: bytes | None) -> str:
    """UTF-16 with a byte order mark, else UTF-8, else Latin-1; empty for null and for anything with a NUL byte."""
    if not data:
        return ""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    data = data.removeprefix(b"\xef\xbb\xbf")
    if b"\0" in data:
        return ""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")
