"""String values of JSON texts at any depth, in one pass over the table and over each text.

A text is read token by token with the open objects and arrays on a list, so depth costs no stack and no job. What is not JSON, or names a key of one object twice, cannot be read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .kept import prepare

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|"([^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*)"|(true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?))')
_VALUE, _FIRST_VALUE, _KEY, _FIRST_KEY, _COLON, _COMMA, _END = range(7)
#: Rows of one Arrow batch of results.
OUT_ROWS = 20_000


def string_values(text: str) -> list[tuple[str, str]] | None:
    """(path, value) of every string value, in order; None where the text cannot be read."""
    found: list[tuple[str, str]] = []
    path, open_ = ["$"], []  # of an open object the keys so far, of an array the place
    want, at = _VALUE, 0
    while token := _TOKEN.match(text, at):
        at = token.end()
        sign, string, plain = token.groups()
        if string is not None:
            if "\\" in string:
                try:
                    string = json.loads(f'"{string}"').encode("utf-8", "replace").decode()  # half of a pair is no character
                except ValueError:
                    return None
            if want in (_KEY, _FIRST_KEY):
                if string in open_[-1]:
                    return None
                open_[-1].add(string)
                path[-1], want = "." + string, _COLON
                continue
            if want not in (_VALUE, _FIRST_VALUE):
                return None
            found.append(("".join(path), string))
        elif plain is not None:
            if want not in (_VALUE, _FIRST_VALUE):
                return None
        elif sign in "{[":
            if want not in (_VALUE, _FIRST_VALUE):
                return None
            open_.append(set() if sign == "{" else 0)
            path.append("" if sign == "{" else "[0]")
            want = _FIRST_KEY if sign == "{" else _FIRST_VALUE
            continue
        elif sign == ":":
            if want != _COLON:
                return None
            want = _VALUE
            continue
        elif sign == ",":
            if want != _COMMA:
                return None
            if isinstance(open_[-1], set):
                want = _KEY
            else:
                open_[-1] += 1
                path[-1], want = f"[{open_[-1]}]", _VALUE
            continue
        else:
            inside = open_[-1] if open_ else None
            if inside is None or isinstance(inside, set) != (sign == "}") or want not in (_COMMA, _FIRST_KEY if sign == "}" else _FIRST_VALUE):
                return None
            open_.pop()
            path.pop()
        want = _COMMA if open_ else _END
    return found if want == _END and not text[at:].strip(" \t\n\r") else None


def walk(rows: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(id, path, value): every string value of a JSON text; a null or unreadable text has none."""
    prepare(rows.sparkSession)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values = [], [], []

            def made(batch=batch, at=at, paths=paths, values=values) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], [id_column, "path", "value"])
                for x in (at, paths, values):
                    x.clear()
                return out

            for row, text in enumerate(batch.column(1)):
                for path, value in string_values(text.as_py()) or () if text.is_valid else ():
                    at.append(row)
                    paths.append(path)
                    values.append(value)
                    if len(at) >= OUT_ROWS:
                        yield made()
            if at:
                yield made()

    return rows.select(id_column, json_column).mapInArrow(run, f"`{id_column}` {kind}, path string, value string")


def readable_text(files: DataFrame) -> DataFrame:
    """(id, text) of JSON files(id, content): the string values in order of their paths, a line each, with escapes read; what cannot be read stays as it is."""
    prepare(files.sparkSession)
    kind = files.schema["id"].dataType.simpleString()

    def read(text: str | None) -> str | None:
        found = None if text is None else string_values(text)
        return text if found is None else "\n".join(v for _, v in sorted(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read(x.as_py()) for x in batch.column(1)], pa.large_string()).cast(pa.string())], ["id", "text"])

    return files.select("id", "content").mapInArrow(run, f"id {kind}, text string")
