"""Columns that know their type, and the comparison rules of the query language."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.errors import QueryTypeError

LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
DATE, LOCAL, INSTANT = T.DateType(), T.TimestampNTZType(), T.TimestampType()
DURATION = T.StructType([T.StructField(n, LONG) for n in ("months", "days", "seconds", "nanos")])
LOCALTIME = T.StructType([T.StructField("time_ns", LONG)])
TIME = T.StructType([T.StructField("time_ns", LONG), T.StructField("offset_s", LONG)])
#: An instant with the offset it is told in, and its zone's name where it has one.
ZONED = T.StructType([T.StructField("at", INSTANT), T.StructField("offset_s", LONG), T.StructField("zone", STRING)])
#: A value of a list whose values have unrelated types: its kind's place in the total order, and the value by it.
ANY = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("num", DOUBLE), T.StructField("int", LONG), T.StructField("str", STRING)])
_RANKS = {"map": 0, "list": 3, "duration": 6, "string": 7, "boolean": 8, "number": 9}
TEMPORAL = (DATE, LOCAL, INSTANT, ZONED, LOCALTIME, TIME)


@dataclass
class Typed:
    col: Column
    type: T.DataType

    def get(self, name: str) -> Typed:
        return Typed(self.col.getField(name), self.type[name].dataType)


def fields(t: T.DataType) -> list[str]:
    return t.fieldNames() if isinstance(t, T.StructType) else []


def is_node(t: T.DataType) -> bool:
    return fields(t) == ["id", "labels", "p"]


def is_rel(t: T.DataType) -> bool:
    return fields(t) == ["id", "type", "source", "target", "p"]


def is_entity(t: T.DataType) -> bool:
    return is_node(t) or is_rel(t)


def is_path(t: T.DataType) -> bool:
    return fields(t) == ["nodes", "rels"]


def is_duration(t: T.DataType) -> bool:
    return fields(t) == fields(DURATION)


def is_time(t: T.DataType) -> bool:
    return fields(t) in (fields(LOCALTIME), fields(TIME))


def is_zoned(t: T.DataType) -> bool:
    return fields(t) == fields(ZONED)


def is_any(t: T.DataType) -> bool:
    return fields(t) == fields(ANY)


def is_map(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and not (is_any(t) or is_entity(t) or is_zoned(t) or is_path(t) or is_duration(t) or is_time(t))


def is_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType))


def is_num(t: T.DataType) -> bool:
    return is_int(t) or is_float(t)


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_bool(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def is_temporal(t: T.DataType) -> bool:
    return t in TEMPORAL or is_zoned(t)


def family(t: T.DataType) -> str:
    for name, test in (("null", is_null), ("number", is_num), ("string", is_string), ("boolean", is_bool), ("list", is_list), ("node", is_node), ("relationship", is_rel), ("path", is_path), ("duration", is_duration), ("map", is_map)):
        if test(t):
            return name
    return t.simpleString()


def null(t: T.DataType = NULL) -> Typed:
    return Typed(F.lit(None).cast(t) if not is_null(t) else F.lit(None), t)


def cast(x: Typed, t: T.DataType) -> Typed:
    return x if x.type == t else Typed(x.col.cast(t), t)


def common(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that values of both become in one list or column; None if there is none."""
    if a == b or is_null(b):
        return a
    if is_null(a):
        return b
    if (is_any(a) or is_any(b)) and not any(is_entity(t) or is_path(t) for t in (a, b)):
        return ANY
    if {a.typeName() if not is_zoned(a) else "zoned", b.typeName() if not is_zoned(b) else "zoned"} <= {"timestamp", "zoned"}:
        return ZONED
    if is_num(a) and is_num(b):
        return LONG if is_int(a) and is_int(b) else DOUBLE
    if is_list(a) and is_list(b):
        inner = common(a.elementType, b.elementType)
        return None if inner is None else T.ArrayType(inner)
    if is_node(a) and is_node(b) or is_rel(a) and is_rel(b) or is_map(a) and is_map(b):
        names = list(dict.fromkeys(fields(a) + fields(b)))
        merged = []
        for n in names:
            ta = a[n].dataType if n in fields(a) else NULL
            tb = b[n].dataType if n in fields(b) else NULL
            one = common(ta, tb) if n != "p" else _wider(ta, tb)
            if one is None:
                return None
            merged.append(T.StructField(n, one))
        return T.StructType(merged)
    return None


def _wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    names = list(dict.fromkeys(fields(a) + fields(b)))
    out = []
    for n in names:
        one = common(a[n].dataType if n in fields(a) else NULL, b[n].dataType if n in fields(b) else NULL)
        if one is None:
            return None
        out.append(T.StructField(n, one))
    return T.StructType(out)


def fit(x: Typed, t: T.DataType) -> Column:
    """``x`` as type ``t``, adding missing fields of structs as nulls."""
    if x.type == t:
        return x.col
    if is_null(x.type):
        return F.lit(None).cast(t)
    if is_any(t):
        return to_any(x)
    if is_zoned(t) and x.type == INSTANT:
        return F.when(x.col.isNotNull(), F.struct(x.col.alias("at"), F.lit(0).cast("long").alias("offset_s"), F.lit(None).cast("string").alias("zone")))
    if isinstance(t, T.StructType) and isinstance(x.type, T.StructType):
        have = fields(x.type)
        made = F.struct(*(fit(x.get(f.name), f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in t.fields))
        return F.when(x.col.isNotNull(), made)
    if is_list(t) and is_list(x.type):
        return F.transform(x.col, lambda e: fit(Typed(e, x.type.elementType), t.elementType))
    return x.col.cast(t)


def to_any(x: Typed) -> Column:
    """A value with its kind."""
    if is_any(x.type):
        return x.col
    kind, none = family(x.type), F.lit(None)
    number = x.col.cast("double") if kind in ("number", "boolean") else none.cast("double")
    whole = x.col if is_int(x.type) else none.cast("long")
    text = none.cast("string") if kind in ("number", "boolean") else F.to_json(x.col) if isinstance(x.type, (T.StructType, T.ArrayType)) else x.col.cast("string")
    rank = _RANKS.get(kind, 5)  # 5: instants and times
    return F.when(x.col.isNotNull(), F.struct(F.lit(rank).alias("rank"), number.alias("num"), whole.cast("long").alias("int"), text.alias("str")))


def any_text(c: Column) -> Column:
    return F.when(c["rank"] == 8, F.when(c["num"] == 1, "true").otherwise("false")).when(c["rank"] == 9, F.coalesce(c["int"].cast("string"), float_text(c["num"]))).otherwise(c["str"])


def shown(x: Typed) -> Column:
    """A column as it leaves the engine; values of unrelated types become text."""
    if is_any(x.type):
        return any_text(x.col)
    if is_list(x.type) and is_any(x.type.elementType):
        return F.transform(x.col, any_text)
    return x.col


def literal(value: Any) -> Typed:
    """A Python value as a typed column."""
    if value is None:
        return null()
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOL)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), LONG)
    if isinstance(value, float):
        return Typed(F.lit(value), DOUBLE)
    if isinstance(value, str):
        return Typed(F.lit(value), STRING)
    if isinstance(value, dt.datetime):
        return Typed(F.lit(value).cast(LOCAL if value.tzinfo is None else INSTANT), LOCAL if value.tzinfo is None else INSTANT)
    if isinstance(value, dt.date):
        return Typed(F.lit(value), DATE)
    if isinstance(value, dict):
        parts = {k: literal(v) for k, v in value.items()}
        return struct_of(parts)
    if isinstance(value, (list, tuple)):
        return list_of([literal(v) for v in value])
    raise QueryTypeError("InvalidArgumentType", f"{type(value).__name__} is no value of the language")


def struct_of(parts: dict[str, Typed]) -> Typed:
    if not parts:
        return Typed(F.struct(F.lit(None).cast("string").alias("_empty")), T.StructType([T.StructField("_empty", STRING)]))
    return Typed(F.struct(*(v.col.alias(k) for k, v in parts.items())), T.StructType([T.StructField(k, v.type) for k, v in parts.items()]))


def list_of(items: list[Typed]) -> Typed:
    t: T.DataType = NULL
    for x in items:
        both = common(t, x.type)
        if both is None and not any(is_entity(y.type) or is_path(y.type) or is_list(y.type) and isinstance(y.type.elementType, T.StructType) for y in items):
            t = ANY
            break
        if both is None:  # entities and other values meet as text
            t = STRING
            items = [Typed(F.to_json(x.col) if isinstance(x.type, (T.StructType, T.ArrayType)) else x.col.cast("string"), STRING) for x in items]
            break
        t = both
    if not items:
        return Typed(F.array().cast("array<string>"), T.ArrayType(NULL))
    return Typed(F.array(*(fit(x, t) for x in items)), T.ArrayType(t))


def promote(a: Typed, b: Typed) -> tuple[Column, Column, bool]:
    """Two numbers as one type, and whether that is floating."""
    if is_int(a.type) and is_int(b.type):
        return a.col, b.col, False
    return a.col.cast("double"), b.col.cast("double"), True


def equal(a: Typed, b: Typed) -> Column:
    """Three-valued equality."""
    if is_null(a.type) or is_null(b.type):
        return F.lit(None).cast("boolean")
    if (is_any(a.type) or is_any(b.type)) and not any(is_entity(v.type) or is_path(v.type) for v in (a, b)):
        x, y = to_any(a), to_any(b)
        numbers = (x["num"] == y["num"]) & F.coalesce(x["int"] == y["int"], F.lit(True))
        return F.when(x["rank"] != y["rank"], F.lit(False)).when(x["rank"] >= 8, numbers).otherwise(x["str"] == y["str"])
    if is_num(a.type) and is_num(b.type):
        x, y, floating = promote(a, b)
        return (x == y) & ~F.isnan(x) if floating else x == y  # a conjunction, so that x = y still reaches the scan
    if is_entity(a.type) and family(a.type) == family(b.type):
        return a.col["id"] == b.col["id"]
    if is_list(a.type) and is_list(b.type):
        ea, eb = a.type.elementType, b.type.elementType
        if is_null(ea) or is_null(eb):
            return F.when(a.col.isNotNull() & b.col.isNotNull(), (F.size(a.col) == F.size(b.col)) & ((F.size(a.col) == 0) | F.lit(None).cast("boolean")))
        pairs = F.zip_with(a.col, b.col, lambda x, y: equal(Typed(x, ea), Typed(y, eb)))
        return F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(F.forall(pairs, lambda x: x))
    if is_path(a.type) and is_path(b.type):
        ids = lambda t: Typed(F.concat(F.transform(t.col["nodes"], lambda n: n["id"]), F.transform(t.col["rels"], lambda r: r["id"])), T.ArrayType(LONG))
        return equal(ids(a), ids(b))
    if is_map(a.type) and is_map(b.type):
        if sorted(fields(a.type)) != sorted(fields(b.type)):
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
        out = F.lit(True)
        for name in fields(a.type):
            x, y = a.get(name), b.get(name)
            out = out & (F.lit(True) if is_null(x.type) and is_null(y.type) else F.when(x.col.isNull() & y.col.isNull(), F.lit(None).cast("boolean")).otherwise(equal(x, y)))
        return F.when(a.col.isNotNull() & b.col.isNotNull(), out)
    if is_zoned(a.type) or is_zoned(b.type):
        return a.col["at"] == b.col["at"] if is_zoned(a.type) and is_zoned(b.type) else equal(instant(a), instant(b))
    if a.type == b.type:
        return a.col == b.col
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def instant(x: Typed) -> Typed:
    """A zoned date-time as its instant; other values as they are."""
    return x.get("at") if is_zoned(x.type) else x


def less(a: Typed, b: Typed, or_equal: bool) -> Column:
    """Three-valued ordering; null for values that have none."""
    none = F.lit(None).cast("boolean")
    if (is_any(a.type) or is_any(b.type)) and not any(is_entity(v.type) or is_path(v.type) for v in (a, b)):
        x, y = to_any(a), to_any(b)
        sides = lambda n: x[n] <= y[n] if or_equal else x[n] < y[n]
        return F.when(x["rank"] != y["rank"], none).when(x["rank"] >= 8, sides("num")).when(x["rank"] == 7, sides("str"))
    if is_num(a.type) and is_num(b.type):
        x, y, floating = promote(a, b)
        out = x <= y if or_equal else x < y
        return out & ~F.isnan(y) if floating else out  # NaN sorts last, so only the larger side needs a look
    if is_list(a.type) and is_list(b.type) and is_num(a.type.elementType) and is_num(b.type.elementType):
        x, y = a.col.cast("array<double>"), b.col.cast("array<double>")
        return x <= y if or_equal else x < y
    if is_zoned(a.type) or is_zoned(b.type):
        return less(instant(a), instant(b), or_equal)
    if is_duration(a.type) and is_duration(b.type):
        x, y = duration_seconds(a.col), duration_seconds(b.col)
        return x <= y if or_equal else x < y
    if a.type == b.type and (is_string(a.type) or is_bool(a.type) or is_temporal(a.type) or is_list(a.type) and not isinstance(a.type.elementType, T.StructType)):
        return a.col <= b.col if or_equal else a.col < b.col
    return none


def duration_seconds(d: Column) -> Column:
    """A duration's length by its mean month, for ordering."""
    return d["months"] * F.lit(2629746.0) + d["days"] * F.lit(86400.0) + d["seconds"] + d["nanos"] / F.lit(1e9)


def order_key(x: Typed) -> Column:
    """What a value sorts by: numbers before NaN before null; entities by id."""
    if is_entity(x.type):
        return x.col["id"]
    if is_path(x.type):
        return F.size(x.col["rels"])
    if is_duration(x.type):
        return duration_seconds(x.col)
    if is_zoned(x.type):
        return x.col["at"]
    if is_null(x.type):
        return F.lit(None).cast("string")
    if is_list(x.type) and is_entity(x.type.elementType):
        return F.transform(x.col, lambda e: e["id"])
    return x.col


def group_key(x: Typed) -> Column:
    """What equal values share, for DISTINCT and grouping."""
    if is_any(x.type):
        return F.when(x.col.isNotNull(), F.struct(x.col["rank"].alias("rank"), x.col["num"].alias("num"), x.col["str"].alias("str")))
    return x.col["id"] if is_entity(x.type) else x.col


def truth(x: Typed, what: str = "a predicate") -> Column:
    if is_null(x.type):
        return F.lit(None).cast("boolean")
    if not is_bool(x.type):
        raise QueryTypeError("InvalidArgumentType", f"{what} needs a boolean, not {family(x.type)}")
    return x.col


def float_text(x: Column) -> Column:
    """A float as text: plain digits, and always with a decimal point."""
    text = x.cast("string")
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(-?)(\d+)$", k)
    digits = F.when(part(3) == "0", "").otherwise(part(3))
    large = F.concat(part(1), part(2), F.rpad(digits, part(5).try_cast("int"), "0"), F.lit(".0"))
    small = F.concat(part(1), F.lit("0."), F.repeat(F.lit("0"), part(5).try_cast("int") - 1), part(2), digits)
    plain = x.cast("decimal(38,17)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", ".0")
    wide = F.abs(x)
    return F.when(F.isnan(x), "NaN").when(x.cast("string").contains("E") & (wide < 1e20) & (wide > 1e-15), trimmed).when(part(4) == "-", small).when(part(5) != "", large).otherwise(text)
