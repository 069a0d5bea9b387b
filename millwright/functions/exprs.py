"""Column-expression helpers shared by all operators (JVM-side, codegen-friendly)."""

from __future__ import annotations

import math
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_POW_32 = float(2**32)


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def np_round(c: str | Column, d: int = 0) -> Column:
    """NumPy ``round(x, d)``: round half to even on the binary value, i.e. ``rint(x*10^d)/10^d``."""
    c = col(c)
    if d == 0:
        return F.rint(c)
    s = float(10**d)
    return F.rint(c * F.lit(s)) / F.lit(s)


def clip(c: str | Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """``np.clip``: null stays null (greatest/least skip nulls, so guard explicitly)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def md5_chunk_uniform(m: Column, i: int) -> Column:
    """i-th (1-based) 8-hex chunk of an md5 hex string, mapped to [0, 1)."""
    start = 1 + 8 * (i - 1)
    return F.conv(F.substring(m, start, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def hash_uniform(key: str | Column, salt: str | None = None) -> Column:
    """Deterministic U[0,1) from ``md5(key[|salt])``: the portable random source (same value in DuckDB)."""
    k = col(key).cast("string")
    if salt is not None:
        k = F.concat(k, F.lit("|"), F.lit(salt))
    return md5_chunk_uniform(F.md5(k), 1)


def hash_normal(key: str | Column, salt: str) -> Column:
    """Approximately N(0,1): (u1+u2+u3+u4-2)*sqrt(3) over the four md5 chunks of ``key|salt``."""
    return md5_normal(F.md5(F.concat(col(key).cast("string"), F.lit("|"), F.lit(salt))))


def md5_normal(m: Column) -> Column:
    """``hash_normal`` of an md5 hex string, which it names four times: a column rather than the call."""
    s = md5_chunk_uniform(m, 1) + md5_chunk_uniform(m, 2) + md5_chunk_uniform(m, 3) + md5_chunk_uniform(m, 4)
    return (s - F.lit(2.0)) * F.lit(math.sqrt(3.0))


def lower_name_rounds_to_int(name: str, include_hours: bool = True) -> bool:
    n = name.lower()
    keys = ("rpm", "wear", "cycle", "hours") if include_hours else ("rpm", "wear", "cycle")
    return any(k in n for k in keys)


def round_by_name(c: str, expr: Column | None = None, int_dp: int = 0, other_dp: int = 3) -> Column:
    """Q10 rule: columns whose lower-cased name contains rpm/wear/cycle/hours are rounded to an integer."""
    e = col(c) if expr is None else expr
    return np_round(e, int_dp) if lower_name_rounds_to_int(c) else np_round(e, other_dp)


def numeric_columns(df: DataFrame) -> list[str]:
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def unpivot_stack(df: DataFrame, id_cols: Iterable[str], groups: dict[str, dict[str, Column]], name: str = "column") -> DataFrame:
    """Wide → long with one ``stack``-style ``explode(array(struct))`` (never a union per column).

    ``groups`` maps output row label → {field: expression over ``df``}.
    """
    id_cols = list(id_cols)
    structs = [
        F.struct(F.lit(label).alias(name), *[e.alias(k) for k, e in fields.items()])
        for label, fields in groups.items()
    ]
    return df.select(*[col(c) for c in id_cols], F.posexplode(F.array(*structs)).alias("pos", "s")).select(
        *[col(c) for c in id_cols], "pos", "s.*"
    )
