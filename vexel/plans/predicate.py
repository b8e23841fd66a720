"""Predicates on JSON metadata: a where clause of nested dicts becomes one boolean column.

``{"year": {"$gte": 2020, "$lt": 2023}, "category": "science"}`` is a conjunction over top-level fields; a bare value
means ``$eq``. A field that is missing fails every operator, and so does metadata that isn't a JSON object; an empty
specification asks only that the field exists; an empty clause passes every row.

Values compare in three ways. Two numbers compare as doubles and two strings bytewise. All else compares by JSON text:
equal texts are equal, and unequal ones count as less, whichever way round. So a mismatch of types satisfies $ne, $lt
and $lte and fails $eq, $gt and $gte. $in holds if an element is equal; $nin if none is. An operand that isn't a list
makes $in false and $nin true.
"""

from __future__ import annotations

import json
import math
import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
OPERATORS = (*COMPARISONS, "$in", "$nin")
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _checked(x: Any) -> Any:
    if isinstance(x, float) and not math.isfinite(x):
        raise ValueError("operands must be finite")
    if isinstance(x, (list, tuple)):
        return [_checked(v) for v in x]
    if isinstance(x, dict):
        return {str(k): _checked(v) for k, v in x.items()}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if hasattr(x, "item"):  # a NumPy scalar
        return _checked(x.item())
    raise ValueError(f"no JSON value: {x!r}")


def parsed(metadata: Column) -> Column:
    """The metadata as a variant; null unless it is one JSON object."""
    v = F.try_parse_json(metadata)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def field(variant: Column, name: str) -> Column:
    """A top-level field by its literal name, dots included."""
    for quote in "'\"":
        if quote not in name and "\\" not in name:
            return F.try_variant_get(variant, f"$[{quote}{name}{quote}]", "variant")
    # paths have no escapes: a name that needs one is looked up among all fields
    return F.try_element_at(F.try_variant_get(variant, "$", "map<string,variant>"), F.lit(name))


def _ordered(value: Column, operand: Any) -> dict[str, Column]:
    """For a present value: is it equal to, above, or below the operand."""
    kind = F.schema_of_variant(value)
    if _is_number(operand):
        right, same, left = F.lit(float(operand)), kind.rlike(NUMBER), F.try_variant_get(value, "$", "double")
    elif isinstance(operand, str):
        right, same, left = F.lit(operand), kind == "STRING", F.try_variant_get(value, "$", "string")
    else:
        text = json.dumps(operand, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
        equal = F.to_json(value) == F.to_json(F.parse_json(F.lit(text)))
        equal = F.coalesce(equal, F.lit(False))
        return {"eq": equal, "gt": F.lit(False), "lt": ~equal}
    pick = lambda c, other: F.coalesce(F.when(same, c).otherwise(F.lit(other)), F.lit(other))
    return {"eq": pick(left == right, False), "gt": pick(left > right, False), "lt": pick(left < right, True)}


def _test(value: Column, op: str, operand: Any) -> Column:
    if op in ("$in", "$nin"):
        if not isinstance(operand, list):
            return F.lit(op == "$nin")
        found = reduce(operator.or_, [_ordered(value, x)["eq"] for x in operand], F.lit(False))
        return found if op == "$in" else ~found
    order = _ordered(value, operand)
    return {
        "$eq": lambda: order["eq"],
        "$ne": lambda: ~order["eq"],
        "$gt": lambda: order["gt"],
        "$gte": lambda: order["gt"] | order["eq"],
        "$lt": lambda: order["lt"],
        "$lte": lambda: order["lt"] | order["eq"],
    }[op]()


def parse_where(where: Any) -> dict[str, list[tuple[str, Any]]]:
    """Field -> operators with operands, checked; anything but a dict is the empty clause."""
    if not isinstance(where, dict):
        return {}
    out: dict[str, list[tuple[str, Any]]] = {}
    for name, spec in where.items():
        if isinstance(spec, dict):
            for op in spec:
                if op not in OPERATORS:
                    raise ValueError(f"unknown operator {op}")
            out[str(name)] = [(op, _checked(x)) for op, x in spec.items()]
        else:
            out[str(name)] = [("$eq", _checked(spec))]
    return out


def compile_where(where: Any, metadata: Column) -> Column | None:
    """The clause as a boolean column that is never null; None for the empty clause, which needs no filter."""
    clause = parse_where(where)
    if not clause:
        return None
    doc = parsed(metadata)
    tests = []
    for name, ops in clause.items():
        value = field(doc, name)
        tests.append(reduce(operator.and_, [_test(value, op, x) for op, x in ops], value.isNotNull()))
    return F.coalesce(reduce(operator.and_, tests), F.lit(False))
