"""Guards and negations compiled to ordinary predicates.

A guard is a nested dict.  On typed columns it becomes comparisons Spark can push to the
scan; on a VARIANT document column it becomes path lookups.
"""

from __future__ import annotations

import datetime
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY = "$any"
RANGE_OPS = {
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$ne": lambda c, v: c != v,
}
MAX_K = 100


def check_request(k: int, threshold: float = 0.0, max_k: int | None = MAX_K) -> None:
    """Limits of a request; ``max_k`` is an option of a service, and None is no limit."""
    if k < 1 or (max_k is not None and k > max_k):
        raise ValueError(f"k must be {'at least 1' if max_k is None else f'between 1 and {max_k}'}, got {k}")
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be between 0 and 1, got {threshold}")


def clamp_k(k: Column) -> Column:
    return F.least(F.greatest(k, F.lit(1)), F.lit(MAX_K))


def clamp_threshold(t: Column) -> Column:
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def _all(parts) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _literal(value, dtype: T.DataType) -> Column:
    """Literal of the column's own type, so the comparison reaches the scan without a cast."""
    if isinstance(dtype, T.TimestampNTZType) and isinstance(value, datetime.datetime):
        return F.to_timestamp_ntz(F.lit(value.isoformat(sep=" ")))
    if isinstance(dtype, T.NumericType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        exact = not isinstance(dtype, T.IntegralType) or float(value).is_integer()
        if exact and not isinstance(dtype, T.DecimalType):
            return F.lit(value).cast(dtype)
    return F.lit(value)


class _Typed:
    """Values of a DataFrame's typed columns.

    Comparisons stay bare, since a wrapped one is not pushed to the scan; a null result filters
    the row all the same, and negations wrap what they negate.
    """

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def root(self):
        return [(None, self.schema)]

    def child(self, node, key):
        col, dtype = node
        if isinstance(dtype, T.StructType):
            if key not in dtype.fieldNames():
                return None
            return (F.col(f"`{key}`") if col is None else col[key]), dtype[key].dataType
        if isinstance(dtype, T.MapType):
            return F.element_at(col, F.lit(key)), dtype.valueType
        return None

    def present(self, parent, key, node):
        if isinstance(parent[1], T.MapType):
            return _true(F.map_contains_key(parent[0], F.lit(key)))
        return node[0].isNotNull()

    def is_list(self, node):
        return isinstance(node[1], T.ArrayType)

    def eq(self, node, value):
        if isinstance(value, bool) and not isinstance(node[1], T.BooleanType):
            return F.lit(False)
        if isinstance(value, str) and isinstance(node[1], (T.NumericType, T.BooleanType)):
            return F.lit(False)
        if isinstance(value, (int, float)) and isinstance(node[1], T.StringType):
            return F.lit(False)
        if value is None:
            return node[0].isNull()
        return node[0] == _literal(value, node[1])

    def isin(self, node, values):
        return _any([self.eq(node, v) for v in values])

    def list_eq(self, node, values):
        col, dtype = node
        parts = [F.size(col) == len(values)]
        for i, v in enumerate(values):
            if not (isinstance(v, dict) and ANY in v):
                parts.append(self.eq((F.get(col, F.lit(i)), dtype.elementType), v))
        return _true(_all(parts))

    def compare(self, node, op, value):
        return RANGE_OPS[op](node[0], _literal(value, node[1]))

    def contains(self, node, value):
        if self.is_list(node):
            return F.array_contains(node[0], F.lit(value))
        return F.contains(node[0].cast("string"), F.lit(str(value)))


class _Variant:
    """Values inside one VARIANT column."""

    def __init__(self, column: str):
        self.column = column

    def child(self, node, key):
        path, _ = node
        return f"{path}[{json.dumps(key, ensure_ascii=False)}]", None

    def _get(self, node, kind):
        path = node[0]
        if path == "$":
            return F.try_variant_get(F.col(self.column), "$", kind)
        return F.try_variant_get(F.col(self.column), path, kind)

    def present(self, _parent, _key, node):
        return self._get(node, "variant").isNotNull()

    def text(self, node):
        return F.to_json(self._get(node, "variant"))

    def eq(self, node, value):
        if value is None:
            return _true(F.is_variant_null(self._get(node, "variant")))
        if isinstance(value, str):
            return _true((self._get(node, "string") == value) & F.startswith(self.text(node), F.lit('"')))
        if isinstance(value, bool):
            return _true(self.text(node) == F.lit("true" if value else "false"))
        if isinstance(value, (int, float)):
            return _true((self._get(node, "double") == float(value))
                         & self.text(node).rlike(r"^-?[0-9]"))
        if isinstance(value, list):
            return self.list_eq(node, value)
        return _true(_all([self.eq(self.child(node, k), v) for k, v in value.items()])
                     & (F.json_object_keys(self.text(node)).isNotNull())
                     & (F.size(F.json_object_keys(self.text(node))) == len(value)))

    def list_test(self, node):
        return _true(F.startswith(self.text(node), F.lit("[")))

    def isin(self, node, values):
        return _any([self.eq(node, v) for v in values])

    def list_eq(self, node, values):
        parts = [F.json_array_length(self.text(node)) == len(values)]
        for i, v in enumerate(values):
            if not (isinstance(v, dict) and ANY in v):
                parts.append(self.eq((f"{node[0]}[{i}]", None), v))
        return self.list_test(node) & _true(_all(parts))

    def compare(self, node, op, value):
        kind, shape = ("string", '^"') if isinstance(value, str) else ("double", "^-?[0-9]")
        return _true(RANGE_OPS[op](self._get(node, kind), F.lit(value)) & self.text(node).rlike(shape))

    def contains(self, node, value):
        items = F.from_json(self.text(node), "array<string>")
        as_text = value if isinstance(value, str) else json.dumps(value)
        return F.when(self.list_test(node), _true(F.array_contains(items, F.lit(as_text)))).otherwise(
            _true(F.contains(self._get(node, "string"), F.lit(as_text))))


def _guard(view, node, guard: dict, compat: bool, strict: bool) -> Column:
    parts = []
    alternatives = guard.get("$or") if not strict else None
    if isinstance(alternatives, list):
        parts.append(_any([_guard(view, node, g, compat, strict) for g in alternatives]))
        if compat:
            return parts[0]
    for key, want in guard.items():
        if key == "$or" and isinstance(alternatives, list):
            continue
        child = view.child(node, key)
        if child is None:
            return F.lit(False)
        parts.append(view.present(node, key, child) & _value(view, node, key, child, want, compat, strict))
    return _all(parts)


def _value(view, node, key, child, want, compat, strict) -> Column:
    if isinstance(want, dict):
        if not strict and isinstance(want.get("$or"), list):
            return _any([_guard(view, node, {key: v}, compat, strict) for v in want["$or"]])
        if ANY in want:
            return F.lit(True)
        special = [k for k in want if k in RANGE_OPS or k in ("$contains", "$not_contains", "$not")]
        if special and len(special) == len(want):
            return _all([_special(view, child, op, want[op]) for op in special])
        return _guard(view, child, want, compat, strict)
    if isinstance(want, list):
        if isinstance(view, _Typed):
            if view.is_list(child):
                return view.list_eq(child, want)
            return F.lit(False) if strict else view.isin(child, want)
        if strict:
            return view.list_eq(child, want)
        return F.when(view.list_test(child), view.list_eq(child, want)).otherwise(view.isin(child, want))
    if want is None and not strict:
        return F.lit(True)
    return view.eq(child, want)


def _special(view, child, op, value) -> Column:
    if op == "$contains":
        return view.contains(child, value)
    if op == "$not_contains":
        return ~_true(view.contains(child, value))
    if op == "$not":
        return ~_true(view.isin(child, value if isinstance(value, list) else [value]))
    return view.compare(child, op, value)


def _view(source):
    if isinstance(source, str):
        return _Variant(source), ("$", None)
    return _Typed(source), (None, source)


def guard_predicate(source, guard: dict | Column | None, compat: bool = False, strict: bool = False) -> Column:
    """Predicate of a guard.

    ``source`` is a DataFrame's schema (typed columns) or the name of a VARIANT column.  A
    guard may also be any boolean Column.  An empty guard filters nothing.

    * ``{"a": 1}`` equality, ``{"a": None}`` or ``{"a": {"$any": True}}`` key present,
      ``{"a": {"b": 1}}`` nested subset
    * ``{"a": [1, 2]}`` membership for a scalar, element-wise equality for an array, where
      ``{"$any": True}`` matches any element
    * ``{"$or": [...]}`` at the top or below a key; ``$gt $gte $lt $lte $ne`` ranges;
      ``$contains`` / ``$not_contains``
    * ``compat``: keys next to a top-level ``$or`` are ignored instead of required
    * ``strict``: the by-vector rule set (no ``$or``, no existence test, arrays only match arrays)
    """
    if guard is None or (isinstance(guard, dict) and not guard):
        return F.lit(True)
    if isinstance(guard, Column):
        return guard
    view, root = _view(source)
    return _guard(view, root, guard, compat, strict)


def negation_specs(negations: dict | None) -> tuple[list[tuple[list[str], object]], dict]:
    """(excluded values per path, cleaned map whose vector is subtracted from the probe)."""
    specs: list[tuple[list[str], object]] = []

    def walk(neg, path):
        clean = {}
        for key, v in neg.items():
            if isinstance(v, dict) and "$not" in v:
                values = v["$not"]
                for one in values if isinstance(values, list) else [values]:
                    specs.append((path + [key], one))
                clean[key] = values[0] if isinstance(values, list) else values
            elif isinstance(v, dict):
                below = walk(v, path + [key])
                if below:
                    clean[key] = below
            else:
                clean[key] = v
        return clean

    return specs, walk(negations or {}, [])


def negation_predicate(source, negations: dict | None) -> Column:
    """True where no excluded value matches; a missing path keeps the row.  ``$contains`` and
    ``$not_contains`` below a key both exclude the rows that contain the value."""
    view, root = _view(source)
    keep = []
    for path, value in negation_specs(negations)[0]:
        node = _walk(view, root, path)
        if node is not None:
            keep.append(~_true(view.eq(node, value)))
    for path, value in _contains_specs(negations or {}, []):
        node = _walk(view, root, path)
        if node is not None:
            keep.append(~_true(view.contains(node, value)))
    return _all(keep)


def _walk(view, node, path):
    for key in path:
        node = view.child(node, key)
        if node is None:
            return None
    return node


def _contains_specs(neg: dict, path):
    for key, v in neg.items():
        if isinstance(v, dict):
            for op in ("$contains", "$not_contains"):
                if op in v:
                    yield path + [key], v[op]
            yield from _contains_specs(v, path + [key])
