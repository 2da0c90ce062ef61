"""Expressions of the query language as typed columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.errors import ParameterMissing, QuerySyntaxError, QueryTypeError
from skein.functions import temporal as tm
from skein.functions.typed import (
    BOOL, DOUBLE, LONG, NULL, STRING, Typed, cast, common, equal, family, fields, fit, float_text, is_bool, is_duration, is_entity, is_float, is_int, is_list, is_map, is_node,
    is_null, is_num, is_path, is_rel, is_string, is_temporal, less, list_of, literal, null, promote, struct_of, truth, any_text, is_any,
)
from skein.plans import ast as A

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}


class Exprs:
    """Compiles expressions over the variables in scope.

    ``ready`` holds columns that were prepared for parts of the tree, by identity: aggregates,
    pattern predicates and comprehensions.
    """

    def __init__(self, scope: dict[str, Typed], params: dict[str, Any], ready: dict[int, Typed] | None = None) -> None:
        self.scope, self.params, self.ready = scope, params, ready or {}

    def with_vars(self, **more: Typed) -> Exprs:
        return Exprs(self.scope | more, self.params, self.ready)

    def __call__(self, e: A.Expr) -> Typed:
        if id(e) in self.ready:
            return self.ready[id(e)]
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def predicate(self, e: A.Expr) -> Column:
        x = self(e)
        if is_entity(x.type) or is_path(x.type):
            raise QuerySyntaxError("InvalidArgumentType", "a predicate cannot be an entity")
        return truth(x)

    # --- leaves

    def _lit(self, e: A.Lit) -> Typed:
        return literal(e.value)

    def _param(self, e: A.Param) -> Typed:
        if e.name not in self.params:
            raise ParameterMissing("MissingParameter", e.name)
        return literal(self.params[e.name])

    def _var(self, e: A.Var) -> Typed:
        if e.name not in self.scope:
            raise QuerySyntaxError("UndefinedVariable", e.name)
        return self.scope[e.name]

    def _prop(self, e: A.Prop) -> Typed:
        return self.property(self(e.of), e.key)

    def property(self, x: Typed, key: str) -> Typed:
        if is_null(x.type):
            return null()
        if is_entity(x.type):
            p = x.get("p")
            return p.get(key) if key in fields(p.type) else null()
        if is_duration(x.type) or is_temporal(x.type):
            return tm.component(x, key)
        if is_map(x.type):
            return x.get(key) if key in fields(x.type) else null()
        raise QueryTypeError("InvalidArgumentType", f"no property {key} of a {family(x.type)}")

    def _haslabels(self, e: A.HasLabels) -> Typed:
        x = self(e.of)
        if is_null(x.type):
            return null(BOOL)
        if is_node(x.type):
            out = F.lit(True)
            for label in e.labels:
                out = out & F.array_contains(x.col["labels"], label)
            return Typed(F.when(x.col.isNotNull(), out), BOOL)
        if is_rel(x.type):
            out = F.lit(True)
            for label in e.labels:
                out = out & (x.col["type"] == label)
            return Typed(out, BOOL)
        raise QueryTypeError("InvalidArgumentType", "a label predicate needs a node or relationship")

    # --- operators

    def _bin(self, e: A.Bin) -> Typed:
        op = e.op
        if op in ("AND", "OR", "XOR"):
            a, b = truth(self(e.left), op), truth(self(e.right), op)
            return Typed(a & b if op == "AND" else a | b if op == "OR" else a != b, BOOL)
        a, b = self(e.left), self(e.right)
        if op == "=":
            return Typed(equal(a, b), BOOL)
        if op == "<>":
            return Typed(~equal(a, b), BOOL)
        if op in ("<", "<="):
            return Typed(less(a, b, op == "<="), BOOL)
        if op in (">", ">="):
            return Typed(less(b, a, op == ">="), BOOL)
        if op == "IN":
            return Typed(self._in(a, b), BOOL)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS", "=~"):
            if not (is_string(a.type) and is_string(b.type)):
                return null(BOOL)
            found = {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains, "=~": F.rlike}[op](a.col, b.col)
            return Typed(found, BOOL)
        return self._arithmetic(op, a, b)

    def _in(self, a: Typed, b: Typed) -> Column:
        if is_null(b.type):
            return F.lit(None).cast("boolean")
        if not is_list(b.type):
            raise QueryTypeError("InvalidArgumentType", "IN needs a list")
        inner = b.type.elementType
        if is_null(a.type) or is_null(inner):
            return F.when(F.size(b.col) == 0, F.lit(False)).when(b.col.isNull(), F.lit(None).cast("boolean"))
        if not isinstance(inner, (T.StructType, T.ArrayType)) and (a.type == inner or is_num(a.type) and is_num(inner)) and not (is_float(a.type) or is_float(inner)):
            return F.when(F.size(b.col) == 0, F.lit(False)).otherwise(F.array_contains(b.col.cast(T.ArrayType(common(a.type, inner))), a.col))
        return F.when(F.size(b.col) == 0, F.lit(False)).otherwise(F.exists(b.col, lambda x: equal(a, Typed(x, inner))))

    def _arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        if op == "+" and (is_list(a.type) or is_list(b.type)):
            return self._concat(a, b)
        if is_null(a.type) or is_null(b.type):
            return null(a.type if is_null(b.type) else b.type)
        if op == "+" and is_string(a.type) and (is_string(b.type) or is_num(b.type)) or op == "+" and is_string(b.type) and is_num(a.type):
            return Typed(F.concat(self.text(a), self.text(b)), STRING)
        if is_duration(a.type) and is_duration(b.type) and op in "+-":
            return tm.duration_sum(a, b, 1 if op == "+" else -1)
        if is_temporal(a.type) and is_duration(b.type) and op in "+-":
            return tm.plus(a, b, 1 if op == "+" else -1)
        if is_duration(a.type) and is_temporal(b.type) and op == "+":
            return tm.plus(b, a)
        if is_duration(a.type) and is_num(b.type) and op in "*/":
            return tm.duration_times(a, b.col if op == "*" else F.try_divide(F.lit(1.0), b.col.cast("double")))
        if is_num(a.type) and is_duration(b.type) and op == "*":
            return tm.duration_times(b, a.col)
        if not (is_num(a.type) and is_num(b.type)):
            return null()
        x, y, floating = promote(a, b)
        if op == "^":
            return Typed(F.pow(x.cast("double"), y.cast("double")), DOUBLE)
        if op in "+-*":
            return Typed(x + y if op == "+" else x - y if op == "-" else x * y, DOUBLE if floating else LONG)
        if not floating:
            return Typed(F.when(y != 0, _int_div(x, y)) if op == "/" else F.try_mod(x, y), LONG)
        if op == "/":
            return Typed(F.when((x == 0) & (y == 0), F.lit(float("nan"))).otherwise(F.try_divide(x, y)), DOUBLE)
        return Typed(F.try_mod(x, y), DOUBLE)

    def _concat(self, a: Typed, b: Typed) -> Typed:
        if is_null(a.type) or is_null(b.type):
            return null(a.type if is_list(a.type) else b.type)
        if is_list(a.type) and is_list(b.type):
            t = common(a.type, b.type)
            if t is None:
                t = T.ArrayType(STRING)
            return Typed(F.concat(fit(a, t), fit(b, t)), t)
        many, one = (a, b) if is_list(a.type) else (b, a)
        t = common(many.type.elementType, one.type) or STRING
        listed = fit(many, T.ArrayType(t))
        item = F.array(fit(one, t))
        return Typed(F.concat(listed, item) if many is a else F.concat(item, listed), T.ArrayType(t))

    def _un(self, e: A.Un) -> Typed:
        x = self(e.of)
        if e.op == "NOT":
            return Typed(~truth(x, "NOT"), BOOL)
        if is_duration(x.type):
            return tm.duration_times(x, F.lit(-1.0))
        return Typed(-x.col, x.type) if is_num(x.type) else null(LONG)

    def _isnull(self, e: A.IsNull) -> Typed:
        x = self(e.of)
        if is_null(x.type):
            return Typed(F.lit(not e.negated), BOOL)
        return Typed(x.col.isNotNull() if e.negated else x.col.isNull(), BOOL)

    def _case(self, e: A.Case) -> Typed:
        values = [self(v) for _, v in e.whens] + ([self(e.default)] if e.default is not None else [])
        t: T.DataType = NULL
        for v in values:
            both = common(t, v.type)
            t = both if both is not None else STRING
        as_t = (lambda v: fit(v, t)) if t != STRING else (lambda v: self.text(v))
        of = self(e.of) if e.of is not None else None
        out = None
        for (test, _), v in zip(e.whens, values, strict=False):
            hit = self.predicate(test) if of is None else equal(of, self(test))
            out = F.when(hit, as_t(v)) if out is None else out.when(hit, as_t(v))
        if e.default is not None:
            out = out.otherwise(as_t(values[-1]))
        return Typed(out, t)

    # --- lists and maps

    def _listlit(self, e: A.ListLit) -> Typed:
        return list_of([self(x) for x in e.items])

    def _maplit(self, e: A.MapLit) -> Typed:
        return struct_of({k: self(v) for k, v in e.items.items()})

    def _elements(self, x: Typed) -> T.DataType:
        if not is_list(x.type):
            raise QueryTypeError("InvalidArgumentType", f"a list is needed, not a {family(x.type)}")
        return x.type.elementType

    def _lambda(self, var: str, t: T.DataType, body: A.Expr) -> tuple[Callable[[Column], Column], T.DataType]:
        of = lambda c: self.with_vars(**{var: Typed(c, t)})(body)
        return (lambda c: of(c).col), of(F.lit(None).cast(t) if not is_null(t) else F.lit(None).cast("string")).type

    def _listcomp(self, e: A.ListComp) -> Typed:
        x = self(e.of)
        if is_null(x.type):
            return Typed(F.array().cast("array<string>"), T.ArrayType(NULL))
        t, out = self._elements(x), x.col
        if e.where is not None:
            out = F.filter(out, lambda c: F.coalesce(self.with_vars(**{e.var: Typed(c, t)}).predicate(e.where), F.lit(False)))
        inner = t
        if e.value is not None:
            f, inner = self._lambda(e.var, t, e.value)
            out = F.transform(out, f)
        kind = T.ArrayType(inner)
        return Typed(F.coalesce(out, F.array().cast(kind if not is_null(inner) else "array<string>")), kind)

    def _quant(self, e: A.Quant) -> Typed:
        x = self(e.of)
        if is_null(x.type):
            return null(BOOL)
        t = self._elements(x)
        test = lambda c: self.with_vars(**{e.var: Typed(c, t)}).predicate(e.where)
        if e.kind == "any":
            return Typed(F.exists(x.col, test), BOOL)
        if e.kind == "all":
            return Typed(F.forall(x.col, test), BOOL)
        if e.kind == "none":
            return Typed(~F.exists(x.col, test), BOOL)
        results = F.transform(x.col, test)
        true = F.size(F.filter(results, lambda r: F.coalesce(r, F.lit(False))))
        unknown = F.exists(results, lambda r: r.isNull())
        return Typed(F.when(true > 1, F.lit(False)).when(unknown, F.lit(None).cast("boolean")).otherwise(true == 1), BOOL)

    def _reduce(self, e: A.Reduce) -> Typed:
        x, start = self(e.of), self(e.start)
        if is_null(x.type):
            return null(start.type)
        t = self._elements(x)
        step = lambda a, c: self.with_vars(**{e.acc: Typed(a, start.type), e.var: Typed(c, t)})(e.value)
        kind = common(start.type, step(F.lit(None).cast(start.type), F.lit(None).cast(t)).type) or start.type
        start = cast(start, kind)
        return Typed(F.aggregate(x.col, start.col, lambda a, c: step(a, c).col.cast(kind)), kind)

    def _index(self, e: A.Index) -> Typed:
        x, at = self(e.of), self(e.at)
        if is_null(x.type) or is_null(at.type):
            return null()
        if is_list(x.type):
            if not is_int(at.type):
                raise QueryTypeError("ListElementAccessByNonInteger", "a list is indexed by integers")
            place = F.when(at.col >= 0, at.col + 1).otherwise(at.col).cast("int")
            t = x.type.elementType
            return Typed(F.try_element_at(x.col, place), t)
        if is_map(x.type) or is_entity(x.type):
            if isinstance(e.at, (A.Lit, A.Param)):
                key = e.at.value if isinstance(e.at, A.Lit) else self.params.get(e.at.name)
                if not isinstance(key, str):
                    raise QueryTypeError("MapElementAccessByNonString", "a map is indexed by text")
                return self.property(x, key)
            p = x.get("p") if is_entity(x.type) else x
            t: T.DataType = NULL
            for n in fields(p.type):
                t = common(t, p.type[n].dataType) or STRING
            out = F.lit(None).cast(t) if not is_null(t) else F.lit(None)
            for n in fields(p.type):
                out = F.when(at.col == n, fit(p.get(n), t)).otherwise(out)
            return Typed(out, t)
        raise QueryTypeError("InvalidArgumentType", f"a {family(x.type)} has no elements")

    def _slice(self, e: A.Slice) -> Typed:
        x = self(e.of)
        if is_null(x.type):
            return Typed(F.array().cast("array<string>"), T.ArrayType(NULL))
        self._elements(x)
        n = F.size(x.col)
        bound = lambda b, default: default if b is None else self(b).col
        clamp = lambda v: F.when(v.isNotNull(), F.least(n, F.greatest(F.lit(0), F.when(v < 0, v + n).otherwise(v)))).cast("int")
        low, high = clamp(bound(e.low, F.lit(0))), clamp(bound(e.high, n))
        return Typed(F.coalesce(F.when(low.isNotNull() & high.isNotNull(), F.slice(x.col, low + 1, F.greatest(F.lit(0), high - low))), F.when(x.col.isNull(), F.array().cast(x.type))), x.type)

    # --- functions

    def text(self, x: Typed) -> Column:
        if is_any(x.type):
            return any_text(x.col)
        if is_float(x.type):
            return float_text(x.col.cast("double"))
        if is_temporal(x.type) or is_duration(x.type):
            return tm.text_of(x)
        if isinstance(x.type, (T.ArrayType, T.StructType)):
            return F.to_json(x.col)
        return x.col.cast("string")

    def _call(self, e: A.Call) -> Typed:
        name = e.name
        if name in AGGREGATES:
            raise QuerySyntaxError("InvalidAggregation", f"{name}() is not allowed here")
        if name.split(".")[0] in (*tm.KINDS, "duration"):
            return self._temporal(name, e)
        if name not in FUNCTIONS:
            raise QuerySyntaxError("UnknownFunction", name)
        low, high, f = FUNCTIONS[name]
        if not low <= len(e.args) <= high:
            raise QuerySyntaxError("InvalidNumberOfArguments", name)
        args = [self(a) for a in e.args]
        if name in ("tointeger", "tofloat", "toboolean", "tointegerornull", "tofloatornull", "tobooleanornull"):
            args = [Typed(any_text(a.col), STRING) if is_any(a.type) else a for a in args]
        return f(self, *args)

    def _temporal(self, name: str, e: A.Call) -> Typed:
        kind, _, method = name.partition(".")
        args = e.args
        if kind == "duration" and method in ("between", "inmonths", "indays", "inseconds"):
            a, b = (self(x) for x in args)
            return tm.between(a, b, {"between": "between", "inmonths": "inMonths", "indays": "inDays", "inseconds": "inSeconds"}[method])
        if method == "truncate":
            unit = args[0].value if isinstance(args[0], A.Lit) else self.params.get(getattr(args[0], "name", ""))
            x = self(args[1]) if len(args) > 1 else tm.now(kind)
            return tm.truncate(kind, unit, x, self(args[2]) if len(args) > 2 else None)
        if method in ("fromepoch", "fromepochmillis"):
            first = self(args[0]).col.cast("long")
            micros = first * 1000 if method == "fromepochmillis" else first * 10**6 + (self(args[1]).col / 1000).cast("long")
            return Typed(F.timestamp_micros(micros), tm.INSTANT)
        if method in ("transaction", "statement", "realtime") or not args:
            return tm.now(kind)
        if method:
            raise QuerySyntaxError("UnknownFunction", name)
        known = args[0].value if isinstance(args[0], A.Lit) else self.params.get(args[0].name) if isinstance(args[0], A.Param) else None
        if isinstance(known, str):
            return tm.from_text(kind, known)
        x = self(args[0])
        return tm.from_map(kind, x) if is_map(x.type) else tm.convert(kind, x)


def _int_div(x: Column, y: Column) -> Column:
    """Division that truncates towards zero, exact for all long values."""
    return ((x - F.try_mod(x, y)).cast("decimal(20,0)") / y.cast("decimal(20,0)")).cast("long")


FUNCTIONS: dict[str, tuple[int, int, Callable[..., Typed]]] = {}


def function(name: str, low: int = 1, high: int | None = None):
    def register(f):
        for n in name.split():
            FUNCTIONS[n.lower()] = (low, low if high is None else high, f)
        return f

    return register


def _need(x: Typed, ok: bool, what: str) -> None:
    if not ok and not is_null(x.type):
        raise QueryTypeError("InvalidArgumentType", f"{what} of a {family(x.type)}")


@function("id elementId")
def _id(c: Exprs, x: Typed) -> Typed:
    return Typed(x.col["id"], LONG) if is_entity(x.type) else null(LONG)


@function("labels")
def _labels(c: Exprs, x: Typed) -> Typed:
    _need(x, is_node(x.type), "labels()")
    return null(T.ArrayType(STRING)) if is_null(x.type) else x.get("labels")


@function("type")
def _type(c: Exprs, x: Typed) -> Typed:
    _need(x, is_rel(x.type), "type()")
    return null(STRING) if is_null(x.type) else x.get("type")


@function("properties")
def _properties(c: Exprs, x: Typed) -> Typed:
    _need(x, is_entity(x.type) or is_map(x.type), "properties()")
    return x.get("p") if is_entity(x.type) else x


@function("keys")
def _keys(c: Exprs, x: Typed) -> Typed:
    _need(x, is_entity(x.type) or is_map(x.type), "keys()")
    t = T.ArrayType(STRING)
    if is_null(x.type):
        return null(t)
    if is_map(x.type):
        return Typed(F.when(x.col.isNotNull(), F.array(*(F.lit(n) for n in fields(x.type) if n != "_empty")).cast(t)), t)
    p = x.get("p")
    named = F.array(*(F.when(p.col[n].isNotNull(), F.lit(n)) for n in fields(p.type))).cast(t)
    return Typed(F.when(x.col.isNotNull(), F.filter(named, lambda k: k.isNotNull())), t)


@function("length")
def _length(c: Exprs, x: Typed) -> Typed:
    _need(x, is_path(x.type) or is_string(x.type) or is_list(x.type), "length()")
    return Typed(F.size(x.col["rels"]).cast("long"), LONG) if is_path(x.type) else _size(c, x)


@function("size")
def _size(c: Exprs, x: Typed) -> Typed:
    _need(x, is_string(x.type) or is_list(x.type), "size()")
    if is_null(x.type):
        return null(LONG)
    return Typed((F.char_length(x.col) if is_string(x.type) else F.when(x.col.isNotNull(), F.size(x.col))).cast("long"), LONG)


@function("nodes")
def _nodes(c: Exprs, x: Typed) -> Typed:
    _need(x, is_path(x.type), "nodes()")
    return null() if is_null(x.type) else x.get("nodes")


@function("relationships rels")
def _rels(c: Exprs, x: Typed) -> Typed:
    _need(x, is_path(x.type), "relationships()")
    return null() if is_null(x.type) else x.get("rels")


@function("toString toStringOrNull")
def _to_string(c: Exprs, x: Typed) -> Typed:
    _need(x, not (is_list(x.type) or is_map(x.type) or is_entity(x.type) or is_path(x.type)), "toString()")
    return Typed(c.text(x), STRING)


@function("toInteger toIntegerOrNull")
def _to_integer(c: Exprs, x: Typed) -> Typed:
    _need(x, is_num(x.type) or is_string(x.type) or is_bool(x.type), "toInteger()")
    if is_float(x.type):
        return Typed(F.when(~F.isnan(x.col), x.col.try_cast("long")), LONG)
    text = F.trim(x.col) if is_string(x.type) else x.col
    return Typed(F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long")) if is_string(x.type) else text.cast("long"), LONG)


@function("toFloat toFloatOrNull")
def _to_float(c: Exprs, x: Typed) -> Typed:
    _need(x, is_num(x.type) or is_string(x.type), "toFloat()")
    return Typed(x.col.try_cast("double"), DOUBLE)


@function("toBoolean toBooleanOrNull")
def _to_boolean(c: Exprs, x: Typed) -> Typed:
    _need(x, is_bool(x.type) or is_string(x.type) or is_int(x.type), "toBoolean()")
    if is_string(x.type):
        low = F.lower(F.trim(x.col))
        return Typed(F.when(low == "true", True).when(low == "false", False), BOOL)
    return Typed(x.col != 0, BOOL) if is_int(x.type) else cast(x, BOOL)


@function("coalesce", 1, 99)
def _coalesce(c: Exprs, *xs: Typed) -> Typed:
    t: T.DataType = NULL
    for x in xs:
        t = common(t, x.type) or STRING
    if is_null(t):
        return null()
    return Typed(F.coalesce(*(c.text(x) if t == STRING and not is_null(x.type) else fit(x, t) for x in xs)), t)


@function("head")
def _head(c: Exprs, x: Typed) -> Typed:
    _need(x, is_list(x.type), "head()")
    return null() if is_null(x.type) else Typed(F.try_element_at(x.col, F.lit(1)), x.type.elementType)


@function("last")
def _last(c: Exprs, x: Typed) -> Typed:
    _need(x, is_list(x.type), "last()")
    return null() if is_null(x.type) else Typed(F.try_element_at(x.col, F.lit(-1)), x.type.elementType)


@function("tail")
def _tail(c: Exprs, x: Typed) -> Typed:
    _need(x, is_list(x.type), "tail()")
    return null() if is_null(x.type) else Typed(F.slice(x.col, F.lit(2), F.greatest(F.lit(0), F.size(x.col) - 1)), x.type)


@function("reverse")
def _reverse(c: Exprs, x: Typed) -> Typed:
    _need(x, is_list(x.type) or is_string(x.type), "reverse()")
    return x if is_null(x.type) else Typed(F.reverse(x.col), x.type)


@function("range", 2, 3)
def _range(c: Exprs, a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    for x in (a, b, *([step] if step else [])):
        _need(x, is_int(x.type), "range()")
    s = step.col if step else F.lit(1).cast("long")
    if step is not None:
        s = F.when(s == 0, F.raise_error(F.lit("ArgumentError.NumberOutOfRange: range() with step 0")).cast("long")).otherwise(s)
    t = T.ArrayType(LONG)
    forward = (s > 0) & (a.col <= b.col) | (s < 0) & (a.col >= b.col)
    return Typed(F.when(forward, F.sequence(a.col, b.col, s)).when(~forward, F.array().cast(t)), t)


_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _string_function(name: str, f: Callable[..., Column], low: int = 1, high: int | None = None, t: T.DataType = STRING) -> None:
    def run(c: Exprs, x: Typed, *rest: Typed) -> Typed:
        _need(x, is_string(x.type), f"{name}()")
        return null(t) if is_null(x.type) or any(is_null(r.type) for r in rest) else Typed(f(x.col, *(r.col for r in rest)), t)

    function(name, low, high)(run)


_string_function("trim", lambda s: F.regexp_replace(s, f"^{_SPACE}|{_SPACE}$", ""))
_string_function("ltrim", lambda s: F.regexp_replace(s, f"^{_SPACE}", ""))
_string_function("rtrim", lambda s: F.regexp_replace(s, f"{_SPACE}$", ""))
_string_function("toLower", F.lower)
_string_function("lower", F.lower)
_string_function("toUpper", F.upper)
_string_function("upper", F.upper)
_string_function("left", lambda s, n: F.left(s, n.cast("int")), 2)
_string_function("right", lambda s, n: F.right(s, n.cast("int")), 2)
_string_function("replace", lambda s, a, b: F.when(a == "", F.concat(b, F.array_join(F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.concat(ch, b)), ""))).otherwise(F.replace(s, a, b)), 3)
_string_function("split", lambda s, d: F.when(d == "", F.concat(F.array(F.lit("")), F.filter(F.split(s, ""), lambda ch: ch != ""), F.array(F.lit("")))).otherwise(F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), F.lit(-1))), 2, t=T.ArrayType(STRING))


@function("substring", 2, 3)
def _substring(c: Exprs, x: Typed, start: Typed, n: Typed | None = None) -> Typed:
    _need(x, is_string(x.type), "substring()")
    if is_null(x.type) or is_null(start.type):
        return null(STRING)
    return Typed(F.substring(x.col, (start.col + 1).cast("int"), n.col.cast("int") if n else F.lit(2**31 - 1)), STRING)


def _math(name: str, f: Callable[[Column], Column], keep_int: bool = False) -> None:
    def run(c: Exprs, x: Typed) -> Typed:
        _need(x, is_num(x.type), f"{name}()")
        if is_null(x.type):
            return null(DOUBLE)
        if keep_int and is_int(x.type):
            return Typed(f(x.col).cast("long"), LONG)
        return Typed(f(x.col.cast("double")).cast("double"), DOUBLE)

    function(name)(run)


def _ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


for _name, _f in (("abs", F.abs), ("ceil", F.ceil), ("ceiling", F.ceil), ("floor", F.floor), ("round", F.round)):
    _math(_name, _f, keep_int=True)
for _name, _f in (
    ("sqrt", F.sqrt), ("exp", F.exp), ("sin", F.sin), ("cos", F.cos), ("tan", F.tan), ("cot", F.cot), ("asin", F.asin), ("acos", F.acos), ("atan", F.atan), ("log", _ln), ("ln", _ln),
    ("log10", lambda x: F.when(x > 0, F.log10(x)).otherwise(_ln(x))), ("toRadians", F.radians), ("radians", F.radians), ("toDegrees", F.degrees), ("degrees", F.degrees),
):
    _math(_name, _f)


@function("sign")
def _sign(c: Exprs, x: Typed) -> Typed:
    _need(x, is_num(x.type), "sign()")
    return Typed(F.signum(x.col.cast("double")).cast("long"), LONG)


@function("atan2", 2)
def _atan2(c: Exprs, a: Typed, b: Typed) -> Typed:
    return Typed(F.atan2(a.col.cast("double"), b.col.cast("double")), DOUBLE)


FUNCTIONS |= {
    "pi": (0, 0, lambda c: Typed(F.pi(), DOUBLE)),
    "e": (0, 0, lambda c: Typed(F.e(), DOUBLE)),
    "rand": (0, 0, lambda c: Typed(F.rand(), DOUBLE)),
    "randomuuid": (0, 0, lambda c: Typed(F.expr("uuid()"), STRING)),
    "timestamp": (0, 0, lambda c: Typed(F.unix_millis(F.current_timestamp()), LONG)),
    "exists": (1, 1, lambda c, x: Typed(x.col.isNotNull(), BOOL)),
}


@function("valueType")
def _value_type(c: Exprs, x: Typed) -> Typed:
    name = "INTEGER" if is_int(x.type) else "FLOAT" if is_float(x.type) else family(x.type).upper()
    return Typed(F.when(x.col.isNull(), "NULL").otherwise(name), STRING)

