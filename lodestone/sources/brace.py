"""Brace files, such as {value,{nested},text}, as nested lists.

One regular expression cuts the text into marks, strings and bare values; a stack builds
the lists. Bare values stay texts; strings keep their quotes (`unquote` undoes them).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import DataError

_PIECES = re.compile(r'([{},])|("(?:[^"]|"")*")|([^{},"]+)')
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def parse(text: str) -> list:
    """The top-level lists of a brace file; an empty text gives an empty list.

    Between two commas there is an empty value: null if a list stands before, else ''."""
    top: list = []
    stack: list[list] = [top]
    open_value = True  # a value may come: behind { or ,
    at = 0
    for m in _PIECES.finditer(text.lstrip("﻿")):
        if m.start() != at:
            raise DataError(f"unclosed string at {at}")
        at = m.end()
        mark, string, bare = m.groups()
        here = stack[-1]
        if mark == "{":
            inner: list = []
            here.append(inner)
            stack.append(inner)
            open_value = True
        elif mark == "}":
            if len(stack) == 1:
                raise DataError(f"unexpected }} at {m.start()}")
            if open_value and here:
                here.append("")
            stack.pop()
            open_value = False
        elif mark == ",":
            if open_value and len(stack) > 1:
                here.append(None if here and isinstance(here[-1], list) else "")
            open_value = True
        else:
            value = string if string is not None else re.sub("[\r\n]+", "", bare).strip()
            if value == "" or (len(stack) == 1 and string is None):
                if value and len(stack) == 1:
                    raise DataError("not a brace file")
                continue
            if open_value:
                here.append(value)
            elif isinstance(here[-1], str):
                here[-1] += value  # a value that goes on behind a line end
            else:
                raise DataError(f"value without a comma at {m.start()}")
            open_value = False
    if at != len(text.lstrip("﻿")) or len(stack) != 1:
        raise DataError("unclosed brace or string")
    return top


def unquote(value) -> str | None:
    if not isinstance(value, str):
        return None
    v = value.strip()
    return v[1:-1].replace('""', '"') if len(v) > 1 and v[0] == v[-1] == '"' else v


def decode(content: bytes) -> str:
    """UTF-8 (with or without a mark), else Windows-1251, else UTF-8 with replacements."""
    for encoding in ("utf-8-sig", "windows-1251"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


@F.udf(T.StringType())
def _to_json(content):
    if content is None:
        return None
    try:
        return json.dumps(parse(decode(bytes(content))), ensure_ascii=False)
    except DataError:
        return None


@F.udf(T.StringType())
def _to_text(content):
    return None if content is None else decode(bytes(content))


def to_text(content) -> Column:
    """A file's bytes as text, see `decode`."""
    return _to_text(content)


def to_json(content) -> Column:
    """A brace file's bytes as JSON text; null if it is none. ``parse_json`` makes a VARIANT of it."""
    return _to_json(content)


def walk(node, path=()):
    """(position path, value) of everything in nested lists, depth first."""
    yield path, node
    if isinstance(node, list):
        for i, x in enumerate(node):
            yield from walk(x, (*path, i))


def uuids(node) -> list[str]:
    """All distinct UUIDs, first seen first, in lower case."""
    return list(dict.fromkeys(v.lower() for _, v in walk(node) if isinstance(v, str) and UUID.fullmatch(v)))
