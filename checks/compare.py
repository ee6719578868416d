"""Compare a Spark result with its oracle, as Arrow tables, without regard to order."""

from __future__ import annotations

import pyarrow as pa


def _kind(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    return str(t)


def _value(v) -> str:
    if hasattr(v, "tzinfo"):
        v = v.replace(tzinfo=None)
    return repr(v)


def compare(spark_rows: pa.Table, oracle_rows: pa.Table) -> str:
    """'ok', or what differs."""
    a, b = spark_rows, oracle_rows
    cols = sorted(a.column_names)
    if cols != sorted(b.column_names):
        return f"columns {cols} != {sorted(b.column_names)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    kinds = [(c, _kind(a.schema.field(c).type), _kind(b.schema.field(c).type)) for c in cols]
    odd = [k for k in kinds if k[1] != k[2]]

    def rows(table):
        return sorted(tuple(map(_value, r)) for r in zip(*[table.column(c).to_pylist() for c in cols]))

    differing = [(x, y) for x, y in zip(rows(a), rows(b)) if x != y]
    if differing:
        return f"{len(differing)} rows differ, e.g. {differing[0]} {odd}"
    return "ok" if not odd else f"types {odd}"
