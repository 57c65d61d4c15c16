"""What patterns find in texts, with the places where they find it: several patterns and definitions with their details in one pass over the table.

Patterns are Python's, ASCII by their classes. Places count code points from 0. A null text has no matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.kept import prepare

OUT_ROWS = 20_000


def _rows(texts: DataFrame, find: Callable[[str], Iterator[tuple]], names: list[str], kinds: list[str]) -> DataFrame:
    """(id, *names) of texts(id, text), where find(text) gives the rest of each row."""
    prepare(texts.sparkSession)
    arrow = {"string": pa.string(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []

            def made(batch=batch, at=at, out=out) -> pa.RecordBatch:
                columns = [pa.array(c, arrow[k]) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                part = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["id", *names])
                at.clear()
                out.clear()
                return part

            for row, text in enumerate(batch.column(1)):
                for hit in find(text.as_py()) if text.is_valid else ():
                    at.append(row)
                    out.append(hit)
                    if len(out) >= OUT_ROWS:
                        yield made()
            if out:
                yield made()

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def matches(texts: DataFrame, families: dict[str, str]) -> DataFrame:
    """(id, family, value, at): every match of each family's pattern, its first group where it has one, with the place where the whole match begins."""
    compiled = [(n, re.compile(p, re.ASCII)) for n, p in families.items()]

    def find(text: str) -> Iterator[tuple]:
        for name, pattern in compiled:
            for m in pattern.finditer(text):
                yield name, m[1] if pattern.groups else m[0], m.start()

    return _rows(texts, find, ["family", "value", "at"], ["string", "string", "long"])


def definitions(texts: DataFrame, name: str, details: list[tuple[str, str | None]], window: int) -> DataFrame:
    """(id, name, value, at): each match of the name's pattern (its first group), with the value of the first detail that is found in the `window` code points from where it begins.

    A detail is a pattern and a constant: the value is the pattern's first group, or the constant where there is one, for details that only show that a definition is there. A name none of whose details is found is no definition."""
    names, others = re.compile(name, re.ASCII), [(re.compile(p, re.ASCII), c) for p, c in details]

    def find(text: str) -> Iterator[tuple]:
        for m in names.finditer(text):
            part = text[m.start() : m.start() + window]
            for pattern, constant in others:
                if d := pattern.search(part):
                    yield m[1], d[1] if constant is None else constant, m.start()
                    break

    return _rows(texts, find, ["name", "value", "at"], ["string", "string", "long"])
