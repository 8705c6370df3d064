"""Filter trees compiled to one Column, so that Catalyst can push every predicate into the scan.

A tree is a comparison {field, operator, value} or a group {operator: AND|OR|NOT, conditions: [...]}. NOT inverts the
leaves (De Morgan), so a row whose field is missing is dropped by a condition and by its inverse alike. NOT over several
conditions means none of them.

A filter in text becomes the same tree: Spark's own parser reads it, once brackets and signs that SQL lacks are replaced
outside of string literals, and the parsed expression is turned into comparisons and groups. What is neither (arithmetic, other
functions, comparisons of two fields) stays a leaf {"raw": SQL text}. A field may be a path into a map, a struct or a text of
JSON: meta["a"]["b"].
"""

from __future__ import annotations

import functools
import json
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INVERSE = {"==": "!=", "!=": "==", ">": "<=", "<=": ">", "<": ">=", ">=": "<", "in": "not in", "not in": "in", "like": "not like", "not like": "like"}
#: Functions of filters in text, on arrays and on texts of JSON that hold one: any or all of the values are elements.
CONTAINS = {"json_contains": any, "array_contains": any, "json_contains_any": any, "array_contains_any": any, "json_contains_all": all, "array_contains_all": all}
INVERSE |= {name: f"not {name}" for name in CONTAINS} | {f"not {name}": name for name in CONTAINS}
ORDERED = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def field_name(field: str) -> str:
    return field.removeprefix("meta.")


def _compare(column: Column, op: str, value) -> Column:
    if op in ORDERED:
        if isinstance(value, bool) or not isinstance(value, int | float | str):
            raise ValueError(f"{op} needs a number or a string, not {value!r}")
        return ORDERED[op](column, F.lit(value))
    if op in ("in", "not in"):
        if not isinstance(value, list):
            raise ValueError(f"{op} needs a list, not {value!r}")
        member = column.isin(value) if value else F.lit(False)
        return member if op == "in" else ~member & column.isNotNull()
    if op in ("like", "not like"):
        return column.like(value) if op == "like" else ~column.like(value)
    name = op.removeprefix("not ")
    if name in CONTAINS:
        parts = [F.array_contains(column, v) for v in value]
        both = functools.reduce(operator.and_ if CONTAINS[name] is all else operator.or_, parts, F.lit(CONTAINS[name] is all))
        return (both if op == name else ~both) & column.isNotNull()
    return column == F.lit(value) if op == "==" else column != F.lit(value)


def compile_filter(tree: dict, resolve: Callable[[str], Column] = F.col, inverted: bool = False, of: Callable[[dict], Column] | None = None) -> Column:
    """The tree as a Column; resolve maps a field (without a leading `meta.`) to a Column, or `of` a whole comparison."""
    if "raw" in tree:
        return ~F.expr(tree["raw"]) if inverted else F.expr(tree["raw"])
    if "field" in tree:
        missing = {"operator", "value"} - tree.keys()
        if missing:
            raise ValueError(f"comparison without {sorted(missing)}")
        op = tree["operator"]
        if op not in INVERSE:
            raise ValueError(f"unknown operator {op!r}")
        column = of(tree) if of else resolve(field_name(tree["field"]))
        return _compare(column, INVERSE[op] if inverted else op, tree["value"])
    op = tree.get("operator")
    if op not in ("AND", "OR", "NOT") or not tree.get("conditions"):
        raise ValueError(f"a group needs AND, OR or NOT and conditions: {tree!r}")
    if op == "NOT":
        # none of the conditions: NOT(a OR b) = NOT a AND NOT b; two NOTs cancel
        parts, both = [compile_filter(c, resolve, not inverted, of) for c in tree["conditions"]], not inverted
    else:
        parts, both = [compile_filter(c, resolve, inverted, of) for c in tree["conditions"]], (op == "AND") != inverted
    return functools.reduce(operator.and_ if both else operator.or_, parts)


def where_tree(df: DataFrame, tree: dict) -> DataFrame:
    """Rows that pass the tree; an empty tree is an error."""
    if not tree:
        raise ValueError("a filter is needed")
    return df.where(compile_filter(tree, lambda name: df[name]))


# --- filters in text

TOKEN = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(&&)|(\|\|)|(\bin\s*\[)|(\[)|(\])""", re.IGNORECASE | re.DOTALL)
NOTHING = "__nothing__"
SIGNS = {"EqualTo": "==", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}
FLIPPED = {"==": "==", ">": "<", ">=": "<=", "<": ">", "<=": ">="}


def to_sql(text: str) -> str:
    """A filter in text as a SQL predicate: `&&`, `||`, `in [..]` and lists [..] are replaced, but never within literals."""
    parts, at, open_ = [], 0, []
    for m in TOKEN.finditer(text):
        parts.append(text[at : m.start()])
        at, (literal, both, either, members, begin, end) = m.end(), m.groups()
        if both or either:
            parts.append(" and " if both else " or ")
        elif members:
            open_.append(")")
            parts.append("in (" if not re.match(r"\s*\]", text[at:]) else f"in ({NOTHING}")
        elif begin:
            path = re.search(r"[\w\])`]\s*$", text[: m.start()])
            open_.append("]" if path else ")")
            parts.append("[" if path else "array(")
        elif end:
            if not open_:
                raise ValueError(f"a ] without its [ in {text!r}")
            parts.append(open_.pop())
        else:
            parts.append(literal)
    if open_:
        raise ValueError(f"a [ without its ] in {text!r}")
    return "".join([*parts, text[at:]])


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _constant(node) -> object:
    """The value of a literal, or a list of them; an error for other expressions."""
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        value, of = node.value(), node.dataType().typeName()
        return value if value is None or isinstance(value, bool | int | float) else str(value.toString()) if of == "string" else float(value.toString())
    if kind == "UnaryMinus":
        return -_constant(node.child())
    if kind == "UnresolvedFunction" and list(_items(node.nameParts())) == ["array"]:
        return [_constant(x) for x in _items(node.arguments())]
    raise ValueError(f"not a constant: {node.sql()}")


def _field(node) -> str:
    """The name of a field or a path into it; an error for other expressions."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedAttribute":
        return ".".join(_items(node.nameParts()))
    if kind == "UnresolvedExtractValue":
        key = _constant(node.extraction())
        return f"{_field(node.child())}[{json.dumps(key)}]"
    raise ValueError(f"not a field: {node.sql()}")


def _tree(node) -> dict:
    """The tree of a parsed expression."""
    kind = node.getClass().getSimpleName()
    if kind in ("And", "Or"):
        sides = [_tree(node.left()), _tree(node.right())]
        op = kind.upper()
        return {"operator": op, "conditions": [c for s in sides for c in (s["conditions"] if s.get("operator") == op and "field" not in s else [s])]}
    if kind == "Not":
        inner = _tree(node.child())
        if "field" in inner and inner["operator"] in INVERSE:
            return inner | {"operator": INVERSE[inner["operator"]]}
        return {"operator": "NOT", "conditions": [inner]}
    try:
        if kind in SIGNS:
            op = SIGNS[kind]
            if node.left().getClass().getSimpleName() == "Literal":
                return {"field": _field(node.right()), "operator": FLIPPED[op], "value": _constant(node.left())}
            return {"field": _field(node.left()), "operator": op, "value": _constant(node.right())}
        if kind == "In":
            members = _items(node.list())
            none = len(members) == 1 and members[0].sql().strip("`") == NOTHING
            return {"field": _field(node.value()), "operator": "in", "value": [] if none else [_constant(x) for x in members]}
        if kind == "Like" and str(node.escapeChar()) == "\\":
            return {"field": _field(node.left()), "operator": "like", "value": _constant(node.right())}
        if kind == "UnresolvedFunction":
            name, arguments = ".".join(_items(node.nameParts())).lower(), _items(node.arguments())
            if name in CONTAINS and len(arguments) == 2:
                value = _constant(arguments[1])
                return {"field": _field(arguments[0]), "operator": name, "value": value if isinstance(value, list) else [value]}
    except ValueError:
        pass
    return {"raw": node.sql()}


def parse_filter(spark: SparkSession, text: str) -> dict:
    """The tree of a filter in text; an error if it cannot be read."""
    if not text or not text.strip():
        raise ValueError("a filter is needed")
    try:
        node = spark._jsparkSession.sessionState().sqlParser().parseExpression(to_sql(text))
    except Exception as error:
        raise ValueError(f"not a filter: {text!r}") from error
    return _tree(node)


def _kind(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, int | float) else "string"


def _place(df: DataFrame, leaf: dict) -> Column:
    """The field of a comparison; within a text of JSON, the element as what it is compared with."""
    name, op, value = leaf["field"], leaf["operator"].removeprefix("not "), leaf["value"]
    if name.split(".")[0].split("[")[0] not in df.columns:
        name = field_name(name)
    head, *keys = re.split(r"\[(?=[\"0-9-])", name)
    column, steps = df[head], [json.loads(k.removesuffix("]")) for k in keys]
    of = df.select(column).dtypes[0][1]
    one = (value[0] if value else "") if isinstance(value, list) else value
    if steps and of == "string":
        column = F.get_json_object(column, "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in steps))
        if op not in CONTAINS and _kind(one) != "string":
            column = column.try_cast(_kind(one))
    else:
        for k in steps:
            column = column[k]
        of = df.select(column).dtypes[0][1]
    return F.from_json(column, f"array<{_kind(one)}>") if op in CONTAINS and of == "string" else column


def where_raw(df: DataFrame, text: str) -> DataFrame:
    """Rows that pass a filter in text, such as `lang in ["en", "de"] && meta["pages"] > 3 || title like "a%"`."""
    return df.where(compile_filter(parse_filter(df.sparkSession, text), of=lambda leaf: _place(df, leaf)))


def is_pinned(tree: dict, field: str) -> bool:
    """Whether a tree (of a filter in text, too) fixes a field by == or in: any condition of AND, every one of OR, none of NOT."""
    if "field" in tree:
        return field_name(tree["field"]) == field and tree["operator"] in ("==", "in")
    found = [is_pinned(c, field) for c in tree.get("conditions", [])]
    return {"AND": any, "OR": all}.get(tree.get("operator"), lambda _: False)(found)


def require_pinned(tree: dict, field: str) -> dict:
    if not is_pinned(tree, field):
        raise ValueError(f"the filter must fix {field} by == or in")
    return tree


def where_required(df: DataFrame, text: str, field: str) -> DataFrame:
    """Rows that pass a filter in text, which must fix a field (the partition key) by == or in."""
    tree = require_pinned(parse_filter(df.sparkSession, text), field)
    return df.where(compile_filter(tree, of=lambda leaf: _place(df, leaf)))


def allowed_lists(lists: Column, allowed: list[str], whole: str) -> Column:
    """Whether each item of a comma-separated list is allowed, or the list is the one value that passes as a whole."""
    items = F.forall(F.split(lists, ","), lambda item: item.isin(allowed))
    return (lists == whole) | items
