"""jq programs as Column expressions over VARIANT values, so that no Python sees a row.

The values of a row at one step are an array; a step maps each of them to none, one or many, in order. What jq calls an error is a SQL null in
that array: it stays in its place, and the results end before the first one. Members of an object are iterated in the order of their names.

Compiled are pipes of paths (.a, ."b c", [0], [], ?), select with a comparison, object construction of paths, and length, keys, type, not,
first, last and values. For any other program compiled() gives None, and query_json of the JSON functions interprets it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"\s*(?:\.?([A-Za-z_]\w*)|\.?\"((?:[^\"\\])*)\"|\.?\[\s*(-?\d+)\s*\]|(\.?\[\s*\]))")
_PATH = re.compile(r"\s*(?:\.|(?:\.?(?:[A-Za-z_]\w*|\"[^\"\\]*\"|\[\s*-?\d+\s*\]|\[\s*\]))+)\??\s*$")
_SELECT = re.compile(r"\s*select\(\s*(\.[^=!<>|()]*?)\s*(==|!=|<=|>=|<|>)\s*([^=!<>|()]+?)\s*\)\s*$")
_OBJECT = re.compile(r"\s*\{(.*)\}\s*$", re.S)
_MEMBER = re.compile(r"\s*(?:([A-Za-z_]\w*)|\"([^\"\\]*)\")\s*(?::\s*(\.[^,|(){}]*?))?\s*(?:,|$)")
_PLAIN = ("length", "keys", "type", "not", "first", "last", "values")


def _null() -> Column:
    return F.parse_json(F.lit("null"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body has it: lambdas know no common subexpressions."""
    return F.get(F.transform(F.array(value), body), 0)


def kind(value: Column) -> Column:
    """What jq calls the type of a variant."""
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name.isNull(), "number").otherwise(F.coalesce(F.try_element_at(known, name), F.lit("number")))


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _at(value: Column, part: str | int) -> Column:
    """One member or item: null where there is none, an error (SQL null) where the value is of another type."""
    absent = lambda whole: F.when(F.is_variant_null(value) | whole(value).isNotNull(), _null())
    if isinstance(part, int) and part < 0:
        return F.coalesce(_let(_items(value), lambda items: F.get(items, F.size(items) + part)), absent(_items))
    found = F.try_variant_get(value, f"$[{part}]" if isinstance(part, int) else f'$["{part}"]', "variant")
    return F.coalesce(found, absent(_items if isinstance(part, int) else _members))


def _each(value: Column) -> Column:
    """All items, or members in the order of their names; one error for anything else."""
    by_name = _let(_members(value), lambda members: F.transform(F.array_sort(F.map_keys(members)), lambda k: F.try_element_at(members, k)))
    return F.coalesce(_items(value), by_name, F.array(F.lit(None).cast("variant")))


def _parts(path: str) -> list[str | int | None] | None:
    """Keys, indexes and None for [] of a path; None if it is no path."""
    path = path.strip()
    if path in (".", ".?"):
        return []
    if not path.startswith(".") or not _PATH.match(path):
        return None
    out: list[str | int | None] = []
    for key, quoted, index, every in _PART.findall(path.removesuffix("?")):
        out.append(None if every else int(index) if index else key or quoted)
    return out


def _flat(values: Column, step) -> Column:
    """values with step (a value to an array) in place of each; errors stay."""
    error = F.array(F.lit(None).cast("variant"))
    return F.flatten(F.transform(values, lambda v: F.when(v.isNull(), error).otherwise(step(v))))


def _walk(values: Column, parts: list, quiet: bool) -> Column:
    for part in parts:
        values = _flat(values, _each) if part is None else _flat(values, lambda v, p=part: F.array(_at(v, p)))
        if quiet:
            values = F.filter(values, lambda v: v.isNotNull())
    return values


def _single(value: Column, parts: list) -> Column:
    if not parts:
        return value
    return _single(_let(value, lambda v: F.when(v.isNotNull(), _at(v, parts[0]))), parts[1:])


def _holds(left: Column, op: str, right: Column) -> Column:
    """A comparison of two values: by number, by text, and of other types by equality alone; of values of two types only != holds."""
    text = lambda x, k: F.when(k == "string", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
    test = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op]

    def compare(s):
        k = s["left_kind"]
        ordered = k.isin("string", "number", "array") if op not in ("==", "!=") else F.lit(True)
        as_number = [F.try_variant_get(s[x], "$", "double") for x in ("left", "right")]
        return F.when(k != s["right_kind"], op == "!=").when(k == "number", test(*as_number)).otherwise(ordered & test(text(s["left"], k), text(s["right"], k)))

    both = F.struct(left.alias("left"), kind(left).alias("left_kind"), right.alias("right"), kind(right).alias("right_kind"))
    return F.when(left.isNull() | right.isNull(), False).otherwise(_let(both, compare))


def _plain(name: str, v: Column) -> Column:
    """A builtin of one value, as an array."""
    is_a = lambda *kinds: kind(v).isin(*kinds)
    as_json = lambda c: F.try_parse_json(c)
    if name == "values":
        return F.filter(F.array(v), lambda x: kind(x) != "null")
    if name == "type":
        return F.array(as_json(F.concat(F.lit('"'), kind(v), F.lit('"'))))
    if name == "not":
        false = is_a("null") | (F.to_json(v) == "false")
        return F.array(as_json(F.when(false, "true").otherwise("false")))
    if name in ("first", "last"):
        return F.array(F.when(is_a("array", "null"), _at(v, 0 if name == "first" else -1)))
    if name == "keys":
        names = F.to_json(F.array_sort(F.map_keys(_members(v))))
        numbers = F.to_json(F.transform(_items(v), lambda _, i: i))
        return F.array(as_json(F.when(is_a("object"), names).when(is_a("array"), numbers)))
    size = F.when(is_a("object"), F.size(_members(v))).when(is_a("array"), F.size(_items(v))).when(is_a("string"), F.length(F.try_variant_get(v, "$", "string"))).when(is_a("null"), 0)
    number = F.regexp_replace(F.to_json(v), "^-", "")
    return F.array(as_json(F.coalesce(size.cast("string"), F.when(is_a("number"), number))))


def _object(inner: str):
    """Members (name, path) of an object construction; None if it is none that compiles."""
    members, at = [], 0
    while at < len(inner.rstrip()):
        m = _MEMBER.match(inner, at)
        if not m or m.end() == at:
            return None
        name = m[1] or m[2]
        parts = _parts(m[3] if m[3] else f'."{name}"')
        if parts is None or None in parts:
            return None
        members.append((name, parts))
        at = m.end()
    return members


def compiled(program: str):
    """A function from an array of variants to the array of the program's results; None if the program does not compile."""
    from .jsons import _pipes

    steps = []
    for text in _pipes(program):
        word = text.strip()
        if word in _PLAIN:
            steps.append(lambda vs, n=word: _flat(vs, lambda v: _plain(n, v)))
        elif (parts := _parts(text)) is not None:
            steps.append(lambda vs, p=parts, q=word.endswith("?"): _walk(vs, p, q))
        elif m := _SELECT.match(text):
            left, right = _parts(m[1]), _parts(m[3])
            try:
                literal = None if right is not None else json.dumps(json.loads(m[3]))
            except ValueError:
                return None
            if left is None or None in left or (right and None in right):
                return None

            def select(vs, left=left, op=m[2], right=right, literal=literal):
                def one(v):
                    b = F.parse_json(F.lit(literal)) if right is None else _single(v, right)
                    broken = lambda s: s["a"].isNull() | s["b"].isNull()
                    fits = lambda s: F.filter(F.array(v), lambda _: _holds(s["a"], op, s["b"]))
                    return _let(F.struct(_single(v, left).alias("a"), b.alias("b")), lambda s: F.when(broken(s), F.array(F.lit(None).cast("variant"))).otherwise(fits(s)))

                return _flat(vs, one)

            steps.append(select)
        elif (m := _OBJECT.match(text)) and (members := _object(m[1])):
            def build(vs, members=members):
                def one(v):
                    def made(s):
                        values = [s[f"v{k}"] for k in range(len(members))]
                        text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(json.dumps(name) + ":"), F.to_json(x)) for (name, _), x in zip(members, values)]), F.lit("}"))
                        return F.when(~F.exists(F.array(*values), lambda x: x.isNull()), F.try_parse_json(text))

                    return F.array(_let(F.struct(*[_single(v, parts).alias(f"v{k}") for k, (_, parts) in enumerate(members)]), made))

                return _flat(vs, one)

            steps.append(build)
        else:
            return None

    def run(values: Column) -> Column:
        for step in steps:
            values = step(values)
        return values

    return run


def query_columns(df: DataFrame, body: str, program: str, out: str = "result") -> DataFrame:
    """df with a row for each result of the program: strings as they are, others as JSON; texts that are no JSON have none."""
    run = compiled(program)
    if run is None:
        from .jsons import query_json

        return query_json(df, body, program, out)
    rows = df.withColumn("__value", F.try_parse_json(F.col(body))).filter(F.col("__value").isNotNull())
    rows = rows.withColumn("__found", run(F.array("__value")))
    first = F.array_position(F.transform("__found", lambda v: v.isNull()), True)
    kept = F.when(first == 0, F.col("__found")).otherwise(F.slice("__found", 1, F.greatest(first - 1, F.lit(0)).cast("int")))
    text = lambda v, t: F.when(t.startswith('"'), F.try_variant_get(v, "$", "string")).otherwise(t)
    shown = F.transform(kept, lambda v: _let(F.to_json(v), lambda t: text(v, t)))
    return rows.withColumn(out, F.explode(shown)).drop("__value", "__found")
