"""Conditions as Columns, from the nested dictionaries that users of document stores write.

A key is an envelope column (``relation``), a path into attributes (``attributes.size``), a member field (``members.node_id``)
or ``$and``, ``$or``, ``$nor``. A value is a literal or a dictionary of ``$gt`` and the like. Comparisons are by kind: numbers
with numbers, strings with strings, anything else false; ``$ne``, ``$nin``, ``$not`` and ``$nor`` hold for missing fields, and of
members only if none meets what they deny. Envelope columns that a table lacks are missing fields. Empty ``$and``, ``$or``, ``$nor``
and ``$all`` raise ValueError. ``$elemMatch`` asks one element, or one member, for all of its tests; ``$type`` takes the
names in ``_KINDS``, and envelope columns are strings.
"""

from __future__ import annotations

import operator
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ENVELOPE = {"hypergraph_id", "id", "label", "type", "status", "relation", "flavor", "valid_from", "valid_to"}
_ORDER = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


#: Kinds by the names that conditions use.
_KINDS = {"string": "STRING", "bool": "BOOLEAN", "int": "BIGINT", "long": "BIGINT", "double": "DOUBLE|FLOAT|DECIMAL.*", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


class Attribute:
    """A path into the VARIANT column ``attributes``, or into the VARIANT ``within``; an empty path is all of it."""

    def __init__(self, path: str, within: Column | str = "attributes"):
        self.within, self.path = within, "$" + "".join(f'["{p}"]' for p in path.split(".") if p)
        self.kind = F.schema_of_variant(F.try_variant_get(within, self.path, "variant"))

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.within, self.path, kind)

    def elements(self, test) -> Column:
        """Whether an element of the list meets the test, which takes an Attribute."""
        return F.coalesce(F.exists(self.get("array<variant>"), lambda x: test(Attribute("", x))), F.lit(False))

    def of_kind(self, name: str) -> Column:
        """Whether the value, or an element of a list, is of the named kind; whole numbers of over 32 bits are long."""
        own = F.coalesce(self.kind.rlike(f"^({_KINDS[name]})$"), F.lit(False))
        if name in ("int", "long"):
            wide = (self.get("long") > F.lit(2**31 - 1)) | (self.get("long") < F.lit(-(2**31)))
            own = own & F.coalesce(wide if name == "long" else ~wide, F.lit(False))
        return own

    @property
    def missing(self) -> Column:
        return self.get("variant").isNull() | (self.kind == "VOID")

    def typed(self, value: object) -> tuple[Column, Column]:
        """(whether the field is of the value's kind, the field as that kind)."""
        if isinstance(value, bool):
            return self.kind == "BOOLEAN", self.get("boolean")
        if isinstance(value, (int, float)):
            return self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), self.get("double")
        return self.kind == "STRING", self.get("string")

    def compare(self, op, value: object) -> Column:
        same, field = self.typed(value)
        of = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        inside = F.exists(self.get(f"array<{of}>"), lambda x: op(x, F.lit(value)))
        return (same & op(field, F.lit(value))) | (self.kind.startswith("ARRAY") & inside)

    def any_of(self, values: list) -> Column:
        """Whether the value, or an element of a list, equals one of the values, which are of one kind."""
        same, field = self.typed(values[0])
        if isinstance(values[0], (int, float)) and not isinstance(values[0], bool):
            # a set tells -0.0 from 0.0, which are equal
            inside = F.exists(self.get("array<double>"), lambda x: (x + F.lit(0.0)).isin(*[float(v) + 0.0 for v in values]))
            own = (field + F.lit(0.0)).isin(*[float(v) + 0.0 for v in values])
        else:
            of = "boolean" if isinstance(values[0], bool) else "string"
            inside, own = F.exists(self.get(f"array<{of}>"), lambda x: x.isin(*values)), field.isin(*values)
        return (same & own) | (self.kind.startswith("ARRAY") & inside)

    def like(self, pattern: str) -> Column:
        """A text, or a text in a list, that the pattern is found in."""
        inside = F.exists(self.get("array<string>"), lambda x: x.rlike(pattern))
        return ((self.kind == "STRING") & self.get("string").rlike(pattern)) | (self.kind.rlike("^ARRAY<(STRING|VARIANT)") & inside)

    def rest(self, by: int) -> Column:
        """Remainder with the sign of the number; null for anything but a number."""
        return F.when(self.typed(by)[0], self.get("long") % F.lit(by))


class Field:
    """An envelope column; texts are compared with timestamps as timestamps. ``text`` tells a column of texts."""

    def __init__(self, column: Column, time: bool = False, text: bool = False):
        self.column, self.time, self.text = column, time, text

    @property
    def missing(self) -> Column:
        return self.column.isNull()

    def get(self, kind: str) -> Column:
        return self.column.cast(kind)

    def like(self, pattern: str) -> Column:
        return self.column.cast("string").rlike(pattern)

    def rest(self, by: int) -> Column:
        return F.expr("try_cast(null as long)") if self.time else self.column.cast("long") % F.lit(by)

    def elements(self, test) -> Column:
        return F.lit(False)

    def of_kind(self, name: str) -> Column:
        return self.column.isNull() if name == "null" else self.column.isNotNull() & F.lit(name == "string")

    def compare(self, op, value: object) -> Column:
        v = F.lit(value)
        return op(self.column, v.cast("timestamp") if self.time and isinstance(value, (str, datetime)) else v)

    def any_of(self, values: list) -> Column:
        return self.column.isin(*values)


def _among(field: Attribute | Field, values: list) -> Column:
    """Whether a value of the list is met. Plain ones of a kind are looked up together, so that a long list costs each row no more than a short one."""
    kinds: dict[object, list] = {}
    for v in values:
        kind = "number" if type(v) in (int, float) else type(v)
        plain = type(v) is str if isinstance(field, Field) else type(v) in (str, int, float, bool)
        kinds.setdefault(kind if plain and (isinstance(field, Attribute) or field.text) else None, []).append(v)
    rest = [_test(field, v) for v in kinds.pop(None, [])]
    return reduce(operator.or_, [*[F.coalesce(field.any_of(of), F.lit(False)) for of in kinds.values()], *rest], F.lit(False))


def _test(field: Attribute | Field, test: object) -> Column:
    if not isinstance(test, dict):
        return field.missing if test is None else F.coalesce(field.compare(operator.eq, test), F.lit(False))
    found = []
    for op, v in test.items():
        if op in _ORDER:
            found.append(field.compare(_ORDER[op], v))
        elif op == "$eq":
            found.append(_test(field, v))
        elif op == "$ne":
            found.append(~_test(field, v))
        elif op in ("$in", "$nin"):
            any_of = _among(field, v)
            found.append(any_of if op == "$in" else ~any_of)
        elif op == "$all":
            found.append(reduce(operator.and_, [_test(field, x) for x in _some(op, v)]))
        elif op == "$not":
            found.append(~_test(field, v))
        elif op == "$exists":
            found.append(~field.missing if v else field.missing)
        elif op == "$regex":
            flags = test.get("$options", "")
            found.append(field.like(f"(?{flags}){v}" if flags else v))
        elif op == "$size":
            found.append(F.size(field.get("array<string>")) == v)
        elif op == "$elemMatch":
            found.append(field.elements(lambda x, v=v: _element(x, v)))
        elif op == "$type":
            kinds = [v] if isinstance(v, str) else _some(op, v)
            if unknown := set(kinds) - set(_KINDS):
                raise ValueError(f"unknown kinds {sorted(unknown)}")
            own = reduce(operator.or_, [field.of_kind(k) for k in kinds])
            found.append(own | field.elements(lambda x, kinds=kinds: reduce(operator.or_, [x.of_kind(k) for k in kinds])))
        elif op == "$mod":
            found.append(field.rest(v[0]) == v[1])
        elif op != "$options":
            raise ValueError(f"unknown operator {op}")
    return F.coalesce(reduce(operator.and_, found, F.lit(True)), F.lit(False))


def _element(x: Attribute, test: dict) -> Column:
    """Tests of an element itself, or of its fields."""
    if all(k.startswith("$") for k in test):
        return _test(x, test)
    return reduce(operator.and_, [_test(Attribute(k, x.within), v) for k, v in test.items()], F.lit(True))


def _some(name: str, tests: list) -> list:
    if not isinstance(tests, list) or not tests:
        raise ValueError(f"{name} takes a list of one or more")
    return tests


def condition(doc: dict, columns: list[str] | None = None) -> Column:
    """All of the dictionary's tests. An unknown bare key is an attribute; ``columns`` are those that the table has."""
    found = []
    for k, v in doc.items():
        if k in ("$and", "$or"):
            found.append(reduce(operator.and_ if k == "$and" else operator.or_, [condition(d, columns) for d in _some(k, v)]))
        elif k == "$nor":
            found.append(~reduce(operator.or_, [condition(d, columns) for d in _some(k, v)]))
        elif k == "tags":
            found.append(has_tags(v))
        elif k == "members":
            # each field may be met by another member
            found += [_one_member(t) if f == "$elemMatch" else _member(f, t) for f, t in v.items()]
        elif k.startswith("members."):
            found.append(_member(k.split(".", 1)[1], v))
        elif k in ENVELOPE:
            there = columns is None or k in columns
            time = there and k.startswith("valid_")
            found.append(_test(Field(F.col(k) if there else F.lit(None).cast("string"), time, not time), v))
        else:
            found.append(_test(Attribute(k.removeprefix("attributes.")), v))
    return reduce(operator.and_, found, F.lit(True))


_DENIED = {"$ne": lambda v: v, "$nin": lambda v: {"$in": v}, "$not": lambda v: v}


def _member(field: str, test: object) -> Column:
    if isinstance(test, dict):
        if "$all" in test:
            return reduce(operator.and_, [_member(field, x) for x in _some("$all", test["$all"])])
        denied = [~_member(field, _DENIED[op](v)) for op, v in test.items() if op in _DENIED]
        if denied:
            rest = {op: v for op, v in test.items() if op not in _DENIED}
            return reduce(operator.and_, denied + ([_member(field, rest)] if rest else []))
    return F.coalesce(F.exists("members", lambda m: _test(Field(m[field], text=field == "node_id"), test)), F.lit(False))


def _one_member(tests: dict) -> Column:
    """Whether one member meets all tests of its fields."""
    return F.coalesce(F.exists("members", lambda m: reduce(operator.and_, [_test(Field(m[f], text=f == "node_id"), t) for f, t in tests.items()], F.lit(True))), F.lit(False))


def has_tags(tags: str | list[str]) -> Column:
    return reduce(operator.and_, [F.array_contains("tags", t) for t in ([tags] if isinstance(tags, str) else tags)])


def has_members(nodes: str | list[str]) -> Column:
    return _member("node_id", {"$all": [nodes] if isinstance(nodes, str) else nodes})


def valid_at(at: str | datetime) -> Column:
    """Open or inclusive at both ends."""
    t = F.lit(at).cast("timestamp")
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t))


#: White space at which texts are trimmed.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _ascii(text: Column) -> Column:
    """Characters beyond ASCII as JSON escapes, those beyond 16 bits as two."""
    escape = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(ch: Column) -> Column:
        n = F.ascii(ch)
        pair = F.concat(escape(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), escape(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
        return F.when(n < 127, ch).when(n < 0x10000, escape(n)).otherwise(pair)

    return F.when(text.rlike(r"[^\x00-\x7e]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def hyperkey(graph: Column, relation: Column, member_ids: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of graph, sorted members and trimmed lower-case relation as compact ASCII JSON."""
    trimmed = F.lower(F.regexp_replace(relation, f"^{_BLANK}|{_BLANK}$", ""))
    doc = F.to_json(F.struct(graph.alias("graph"), F.sort_array(member_ids).alias("members"), trimmed.alias("relation")))
    return F.substring(F.sha2(_ascii(doc), 256), 1, 32)
