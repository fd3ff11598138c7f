"""Groups of a bounded size, such as a book or a page, folded in order by Python; many share a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: Rows that are turned into Python's at once, if no group has more.
AT_ONCE = 20_000


def _values(column: pa.Array) -> list:
    kind = column.type
    if pa.types.is_string(kind) or column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _lists(column: pa.ListArray, tuples: bool) -> Iterator[list]:
    """The lists of structs as dicts or tuples. Fields are turned whole, some groups at a time: value by value takes many times as long."""
    sizes, a = column.value_lengths().to_pylist(), 0
    while a < len(sizes):
        b, total = a + 1, sizes[a]
        while b < len(sizes) and total + sizes[b] <= AT_ONCE:
            total += sizes[b]
            b += 1
        structs = column.slice(a, b - a).flatten()
        names = [f.name for f in structs.type]
        fields = zip(*(_values(x) for x in structs.flatten()), strict=True)
        rows = list(fields) if tuples else [dict(zip(names, r)) for r in fields]  # noqa: B905
        at = 0
        for n in sizes[a:b]:
            yield rows[at : at + n]
            at += n
        a = b


def folded(rows: DataFrame, key: str, order: str, walk: Callable[..., list[tuple]], schema: str, settings: DataFrame | None = None, tuples: bool = False) -> DataFrame:
    """The key and what walk makes of a group's rows (dicts, or ``tuples`` of ``order`` and the other columns), in order of ``order``.

    With ``settings``, a row for each key at most, walk also gets that of the group, or None. Spark bounds a batch's bytes.
    """
    rest = [c for c in rows.columns if c not in (key, order)]
    groups = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("rows"))
    if settings is not None:
        own = F.struct(*(c for c in settings.columns if c != key))
        groups = groups.join(settings.select(key, own.alias("own")), key, "left").select(key, "rows", "own")
    kind = StructType([rows.schema[key], *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(kind)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for of, rows, *own in zip(batch.column(0).to_pylist(), _lists(batch.column(1), tuples), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                found += [(of, *r) for r in walk(rows, *own)]
            columns = list(zip(*found, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return groups.mapInArrow(each, kind)
