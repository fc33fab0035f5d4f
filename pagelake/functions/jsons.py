"""JSON values of unknown shape: inference, key counts, truncation, repair, key trees, leaves, dot paths and a jq subset.

What a static schema cannot express runs as one Arrow UDF per column over JSON texts; dot paths and simple jq programs
compile to get_json_object and from_json, and stay in the JVM.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_ITEMS = 3, 3


def _load(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return False, None


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", list: "array", dict: "object"}.get(type(value), "number")


def infer_schema(value, depth: int = 0) -> dict:
    """type, fields (by name) and items (of the first element); objects below MAX_DEPTH have no fields."""
    kind = kind_of(value)
    out: dict = {"type": kind}
    if kind == "object" and depth < MAX_DEPTH:
        out["fields"] = [{"name": k, **infer_schema(value[k], depth + 1)} for k in sorted(value)]
    elif kind == "array" and value:
        out["items"] = infer_schema(value[0], depth)
    return out


def count_keys(value, depth: int = 2) -> int:
    """Keys of objects down to a depth; an array counts as its first element."""
    if depth <= 0:
        return 0
    if isinstance(value, dict):
        return len(value) + sum(count_keys(v, depth - 1) for v in value.values())
    return count_keys(value[0], depth) if isinstance(value, list) and value else 0


def truncate(value, size: int):
    """Strings cut to size bytes and marked, arrays to MAX_ITEMS items."""
    if isinstance(value, str):
        data = value.encode("utf-8", "replace")
        return value if len(data) <= size else data[:size].decode("utf-8", "ignore") + "..."
    if isinstance(value, list):
        return [truncate(v, size) for v in value[:MAX_ITEMS]]
    if isinstance(value, dict):
        return {k: truncate(v, size) for k, v in value.items()}
    return value


def repair(text: str) -> str:
    """The text with its open string closed, then all missing ] and then all missing }."""
    inside = escaped = False
    braces = brackets = 0
    for c in text:
        if escaped:
            escaped = False
        elif inside:
            escaped, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        else:
            braces += (c == "{") - (c == "}")
            brackets += (c == "[") - (c == "]")
    return text + '"' * inside + "]" * max(brackets, 0) + "}" * max(braces, 0)


def leaves(value, key: str = "", path: str = "", depth: int = 5, items: int = 12) -> Iterator[tuple[str, str, str, str]]:
    """(path, key, type, text) of scalars down to a depth; items of an array keep its key, the first `items` count."""
    if isinstance(value, dict) and depth > 0:
        for k in sorted(value):
            yield from leaves(value[k], k, f"{path}.{k}", depth - 1, items)
    elif isinstance(value, list) and depth > 0:
        for k, v in enumerate(value[:items]):
            yield from leaves(v, key, f"{path}[{k}]", depth - 1, items)
    elif not isinstance(value, (dict, list)):
        yield path, key, kind_of(value), value if isinstance(value, str) else json.dumps(value)


def key_tree(value, depth: int = 4, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, type) of everything down to a depth, the first item of arrays only."""
    if isinstance(value, dict):
        for k in sorted(value):
            yield f"{path}.{k}", kind_of(value[k])
            if depth > 1:
                yield from key_tree(value[k], depth - 1, f"{path}.{k}")
    elif isinstance(value, list) and value:
        yield f"{path}[]", kind_of(value[0])
        if depth > 1:
            yield from key_tree(value[0], depth - 1, f"{path}[]")


def _text_udf(make: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(make, na_action="ignore")

    return run.asNondeterministic()


def _of(make: Callable) -> Callable:
    def one(text):
        ok, value = _load(text)
        return make(value) if ok else None

    return one


def infer_schema_column(body: Column) -> Column:
    """The response schema of a JSON text, as JSON; null if it is not JSON."""
    return _text_udf(_of(lambda v: _dump(infer_schema(v))), "string")(body)


def count_keys_column(body: Column, depth: int = 2) -> Column:
    return _text_udf(_of(lambda v: count_keys(v, depth)), "int")(body)


def truncate_column(body: Column, size: int) -> Column:
    return _text_udf(_of(lambda v: _dump(truncate(v, size))), "string")(body)


def repair_column(body: Column) -> Column:
    return _text_udf(repair, "string")(body)


def leaves_column(body: Column) -> Column:
    kind = "array<struct<path:string,key:string,type:string,text:string>>"
    names = ("path", "key", "type", "text")
    return _text_udf(_of(lambda v: [dict(zip(names, x)) for x in leaves(v)]), kind)(body)


def key_tree_column(body: Column, depth: int = 4) -> Column:
    return _text_udf(_of(lambda v: [f"{p}:{t}" for p, t in key_tree(v, depth)]), "array<string>")(body)


def json_path(dot_path: str) -> str:
    """.a.b[0] as a JSON path; parts that are no plain names are quoted."""
    out = "$"
    for name, index in re.findall(r"\.?([^.\[\]]+)|\[(\d+)\]", dot_path):
        out += f"[{index}]" if index else f".{name}" if re.fullmatch(r"\w+", name) else f"['{name}']"
    return out


def get_path(body: Column, dot_path: str) -> Column:
    return F.get_json_object(body, json_path(dot_path))


def project_paths(body: Column, paths: dict[str, str]) -> Column:
    """A map of the paths that resolve; null if none does."""
    found = F.map_filter(F.create_map(*[x for k, p in paths.items() for x in (F.lit(k), get_path(body, p))]), lambda _, v: v.isNotNull())
    return F.when(F.size(found) > 0, found)


class JqError(ValueError):
    """The program is not of the subset that is understood."""


_STEP = re.compile(r"\s*(?:(\.(?:[A-Za-z_]\w*|\"[^\"]*\")?(?:\[\s*-?\d*\s*\]|\.[A-Za-z_]\w*|\[\"[^\"]*\"\])*\??)|(length|keys|first|last|add|not|type|tostring|tonumber|unique|sort|reverse|values)|select\(\s*(.+?)\s*(==|!=|>=|<=|>|<)\s*(.+?)\s*\)|map\((.+)\))\s*$", re.S)


def _pipes(program: str) -> list[str]:
    parts, depth, quoted, at = [], 0, False, 0
    for k, c in enumerate(program):
        quoted ^= c == '"'
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "|" and not depth and not quoted:
            parts.append(program[at:k])
            at = k + 1
    return [*parts, program[at:]]


@functools.lru_cache(maxsize=256)
def compile_jq(program: str) -> Callable[[object], Iterator]:
    """The program as a generator of values: paths, [], slices by index, |, select with a comparison, map and plain builtins."""
    steps = [_step(p) for p in _pipes(program)]

    def run(value, at: int = 0) -> Iterator:
        if at == len(steps):
            yield value
            return
        for found in steps[at](value):
            yield from run(found, at + 1)

    return run


def _walk(value, parts: list, quiet: bool) -> Iterator:
    if not parts:
        yield value
        return
    part, rest = parts[0], parts[1:]
    if part is None:
        if not isinstance(value, (list, dict)):
            if not quiet:
                raise JqError(f"cannot iterate over {kind_of(value)}")
            return
        for v in value if isinstance(value, list) else value.values():
            yield from _walk(v, rest, quiet)
    elif isinstance(part, int):
        if value is not None and not isinstance(value, list):
            if not quiet:
                raise JqError(f"cannot index {kind_of(value)} with a number")
            return
        yield from _walk(value[part] if value and -len(value) <= part < len(value) else None, rest, quiet)
    else:
        if value is not None and not isinstance(value, dict):
            if not quiet:
                raise JqError(f"cannot index {kind_of(value)} with {part!r}")
            return
        yield from _walk((value or {}).get(part), rest, quiet)


_BUILTINS: dict[str, Callable] = {
    "length": lambda v: 0 if v is None else abs(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else len(v),
    "keys": lambda v: sorted(v) if isinstance(v, dict) else list(range(len(v))),
    "first": lambda v: v[0] if v else None,
    "last": lambda v: v[-1] if v else None,
    "add": lambda v: functools.reduce(lambda a, b: {**a, **b} if isinstance(a, dict) else a + b, v) if v else None,
    "not": lambda v: v is None or v is False,
    "type": kind_of,
    "tostring": lambda v: v if isinstance(v, str) else _dump(v),
    "tonumber": lambda v: json.loads(v) if isinstance(v, str) else v,
    "unique": lambda v: [json.loads(x) for x in sorted({_dump(x) for x in v})],
    "sort": lambda v: sorted(v, key=_dump),
    "reverse": lambda v: v[::-1],
    "values": lambda v: v,
}


def _step(text: str) -> Callable[[object], Iterator]:
    m = _STEP.match(text)
    if not m:
        raise JqError(f"cannot read {text.strip()!r}")
    path, name, left, op, right, inner = m.groups()
    if path is not None:
        quiet = path.endswith("?")
        parts: list = []
        for key, quoted, index, every in re.findall(r"\.?([A-Za-z_]\w*)|\"([^\"]*)\"|\[\s*(-?\d+)\s*\]|(\[\s*\])", path):
            parts.append(key or quoted or (None if every else int(index)))
        return lambda v: _walk(v, parts, quiet)
    if name is not None:
        return lambda v: iter([_BUILTINS[name](v)]) if name != "values" or v is not None else iter(())
    if inner is not None:
        body = compile_jq(inner)
        return lambda v: iter([[y for x in v for y in body(x)]])
    a, b = compile_jq(left), (compile_jq(right) if right.startswith(".") else (lambda v, c=json.loads(right): iter([c])))
    test = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, ">": lambda x, y: x > y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y}[op]

    def select(v) -> Iterator:
        for x in a(v):
            for y in b(v):
                if op in ("==", "!=") or type(x) is type(y) or isinstance(x, (int, float)) and isinstance(y, (int, float)):
                    if test(x, y):
                        yield v

    return select


def run_jq(text: str, program: str) -> list[str] | None:
    """The results: strings raw, others as JSON; null for a text that is no JSON, and results up to the first error."""
    ok, value = _load(text)
    if not ok:
        return None
    out: list[str] = []
    try:
        for v in compile_jq(program)(value):
            out.append(v if isinstance(v, str) else _dump(v))
    except (JqError, TypeError, KeyError, ValueError):
        pass
    return out


_SIMPLE = re.compile(r"^(\.[A-Za-z_]\w*|\[\d+\])+$")


def query_json(df: DataFrame, body: str, program: str, out: str = "result") -> DataFrame:
    """df with a row per result of the program. Plain paths and paths that end in [] stay in the JVM."""
    compile_jq(program)
    path = program.strip()
    if _SIMPLE.match(path):
        return df.withColumn(out, F.get_json_object(body, json_path(path))).filter(F.col(out).isNotNull())
    if path.endswith("[]") and _SIMPLE.match(path[:-2]):
        items = F.from_json(F.get_json_object(body, json_path(path[:-2])), "array<string>")
        return df.withColumn(out, F.explode(items))
    return df.withColumn(out, F.explode(_text_udf(lambda t: run_jq(t, program), "array<string>")(F.col(body))))
