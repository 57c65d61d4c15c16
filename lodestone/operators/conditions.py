"""What is wrong with a row, as columns that are true or null for a bad one: the row-level rules, to be used one by one or many in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JSON kinds, as the types that Spark names.
KINDS = {"string": "STRING", "number": "(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def missing(field: str, trimmed: bool = True) -> Column:
    text = F.col(field).cast("string")
    return F.col(field).isNull() | ((F.trim(text) if trimmed else text) == "")


def not_constant(field: str, value) -> Column:
    return ~F.col(field).eqNullSafe(F.lit(value))


def not_among(field: str, allowed: list) -> Column:
    return ~F.col(field).isin(allowed)


def other_prefix(field: str, kind: str, prefixes: dict[str, str]) -> Column:
    return ~F.startswith(F.col(field), F.coalesce(*[F.when(F.col(kind) == k, F.lit(p)) for k, p in prefixes.items()]))


def missing_when(when: Column, field: str) -> Column:
    return F.coalesce(when, F.lit(False)) & missing(field, trimmed=False)


def empty(field: str) -> Column:
    return F.size(F.coalesce(F.col(field), F.array())) == 0


def not_like(field: str, pattern: str) -> Column:
    return ~F.col(field).rlike(pattern)


def like(field: str, pattern: str) -> Column:
    return F.coalesce(F.col(field).rlike(pattern), F.lit(False))


def not_together(one: Column, two: Column) -> Column:
    return ~one.eqNullSafe(two)


def broken(when: Column, then: Column) -> Column:
    return F.coalesce(when, F.lit(False)) & ~F.coalesce(then, F.lit(False))


def unsorted(field: str) -> Column:
    return F.col(field) != F.array_sort(field)


def not_within(field: str, array: str) -> Column:
    return ~F.array_contains(F.col(array), F.col(field))


def elsewhere(when: Column, field: str, place) -> Column:
    return F.coalesce(when, F.lit(False)) & (F.col(field) != F.lit(place))


def sentence_count(field: str) -> Column:
    return F.size(F.filter(F.split(F.col(field), r"(?<=\.)\s"), lambda x: x != ""))


def other_kind(field: str, kind: str) -> Column:
    """Of JSON text: what cannot be read, null included, is of no kind."""
    return ~F.schema_of_variant(F.try_parse_json(field)).rlike(f"^{KINDS[kind]}$")


def observations(struct: str, space: str, spaces: dict[str, bool], sources: list[str], stamp: Column) -> Column:
    """What is wrong with an observation struct(present, source, on, at, served_keys), as an array of messages.

    spaces tells for each namespace whether its rows must carry one; in the others it is forbidden. A row of no known namespace is wrong. present must be there; without it source and on must be null, with it `on` must be there and source one of `sources` or null;
    `at` must be there and equal the stamp, where that is known; served keys must be sorted, without nulls, and only of what is present."""
    o = lambda f: F.col(f"{struct}.{f}")
    said = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.lit(text))
    there, needed = F.col(struct).isNotNull(), F.col(space).isin([s for s, must in spaces.items() if must])
    keys = o("served_keys")
    inside = [
        said(o("present").isNull(), "present must be boolean"),
        said(o("source").isNotNull() & ~o("source").isin(sources), "unknown source"),
        said(~o("present") & (o("source").isNotNull() | o("on").isNotNull()), "absent with source or on"),
        said(o("present") & o("on").isNull(), "present without on"),
        said(o("at").isNull() | (o("at") == ""), "at missing"),
        said((o("at") != "") & (o("at") != stamp), "at is not the stamp"),
        said(F.exists(keys, lambda k: k.isNull()), "served keys must be strings"),
        said(keys.isNotNull() & ~F.coalesce(o("present"), F.lit(False)), "served keys of what is absent"),
        said(o("present") & (keys != F.array_sort(keys)), "served keys not sorted"),
    ]
    outside = [
        said(F.col(space).isNull() | ~F.col(space).isin(list(spaces)), "unknown namespace"),
        said(needed & ~there, "observation required"),
        said(F.col(space).isin([s for s, must in spaces.items() if not must]) & there, "observation forbidden"),
    ]
    return F.array_compact(F.array(*outside, *[F.when(needed & there, m) for m in inside]))
