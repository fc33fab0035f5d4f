"""Three-way merge of branches in a uniform cell model.

Rows, columns, lines and the gaps after lines of every version are cells: a path (id, kind, place) with a value, or gone. The
base lists all of its cells, a branch those that it touched. The versions' cells stand in one table, are grouped by path, pivoted
into one row a path with a column for each version, resolved, and put together again as rows.

Rules. A change by one branch, or the same by both, is taken and counts one clean. Different changes are one conflict, and the
base's state stays: edit_edit (two values), edit_delete (a value and gone), insert_insert (two values where the base has none).
A dropped row counts alone: it is an edit_delete conflict of the whole row, and the base's row stays, if the other branch keeps
the row and changed a cell of it; else it is clean and the row is gone. An added row is one cell, whose value is the whole row.

Cost. The table moves once, by id, after repeated ids met in a partial aggregate; cells never move again, as grouping by path and
by id are satisfied by that partitioning. Added rows, one for some ids, move apart. Nothing is collected or broadcast.

Defined cases: null texts and columns are empty; an empty text is one empty line; of several rows of an id, the least by (text,
columns) counts; a null id is an id of its own whose decimal is empty, and adds no row; an added row whose id the base holds is an
insert_insert conflict with it; other columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROW, COLUMN, LINE, GAP = 0, 1, 2, 3
BASE, LEFT, RIGHT = 0, 1, 2
COLUMNS = ("lang", "source")
OUTCOMES = ("clean", "edit_edit", "edit_delete", "insert_insert")
#: A cell: whose path, of which version, and what it holds.
CELL = "kind int, place int, version int, value string, gone boolean"


def one_row_per_id(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc_id, text and columns, nulls empty, one row for each id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    least = docs.select("doc_id", F.struct(*[text(c) for c in ("text", *columns)]).alias("row")).groupBy("doc_id").agg(F.min("row").alias("row"))
    return least.select("doc_id", "row.*")


def _cell(kind: int | Column, place: Column, version: int, value: Column, gone: bool | Column = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = (lit(kind).cast("int"), place.cast("int"), F.lit(version), value, lit(gone))
    return F.struct(*[f.alias(c.split()[0]) for f, c in zip(fields, CELL.split(", "))])


def code(branch: str, doc_id: Column, name: Column, codes: int = 11) -> Column:
    """What a branch does to a name of an id: crc32 of branch:id:name modulo codes."""
    return (F.crc32(F.concat_ws(":", F.lit(branch), F.coalesce(doc_id.cast("string"), F.lit("")), name)) % codes).cast("int")


def edited(branch: str, version: int, kind: Column, place: Column, name: Column, value: Column) -> Column:
    """The cell that a branch changes where the base has this one, or null: drops, appended marks, lines inserted after."""
    found = code(branch, F.col("doc_id"), name)
    mark = F.when((found % 2) == 1, F.lit("!")).otherwise(F.lit("?"))
    drop, append, insert = found == 0, found.isin(1, 2), found.isin(3, 4)
    return (
        F.when(drop & (kind == COLUMN), _cell(kind, place, version, F.lit("")))
        .when(drop, _cell(kind, place, version, F.lit(None).cast("string"), True))
        .when(append & (kind != ROW), _cell(kind, place, version, F.concat(value, mark)))
        .when(insert & (kind == LINE), _cell(GAP, place, version, mark))
    )


def branch_cells(rows: DataFrame, branches: tuple[str, str] = ("L", "R"), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The cells of the base's rows, and those that both branches change in them."""
    n = len(columns)
    held = rows.select("doc_id", F.posexplode(F.concat(F.array(F.lit(""), *columns), F.split("text", "\n", -1))).alias("at", "value"))
    kind = F.when(F.col("at") == 0, ROW).when(F.col("at") <= n, COLUMN).otherwise(LINE)
    place = F.when(F.col("at") <= n, F.col("at")).otherwise(F.col("at") - n - 1)
    name = F.coalesce(*[F.when(F.col("at") == k, F.lit(c)) for k, c in enumerate(("row", *columns))], (F.col("at") - n - 1).cast("string"))
    held = held.select("doc_id", "value", kind.alias("kind"), place.alias("place"), name.alias("name"))
    kind, place, name, value = (F.col(c) for c in ("kind", "place", "name", "value"))
    cells = F.array(_cell(kind, place, BASE, value), *[edited(b, v, kind, place, name, value) for b, v in zip(branches, (LEFT, RIGHT))])
    return held.select("doc_id", F.inline(cells).alias(*[c.split()[0] for c in CELL.split(", ")])).filter("kind is not null")


def added_cells(rows: DataFrame, branches: tuple[str, str] = ("L", "R"), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The rows that both branches add, a cell each; the value is the row as JSON."""
    cells = []
    for k, b in enumerate(branches):
        found = code(b, F.col("doc_id"), F.lit("row"))
        text = F.when(found == 3, F.lit("!")).when(found == 4, F.lit("?"))
        row = F.to_json(F.struct(text.alias("text"), *columns))
        cells.append(F.when(text.isNotNull(), F.struct((F.lit(-1 - k) - F.col("doc_id")).alias("doc_id"), _cell(ROW, F.lit(0), (LEFT, RIGHT)[k], row).alias("cell"))))
    return rows.select(F.inline(F.array(*cells)).alias("doc_id", "cell")).filter("doc_id is not null").select("doc_id", "cell.*")


def resolved(cells: DataFrame) -> DataFrame:
    """One row a path: base, merged (null: not there), whether each branch changed it or dropped it, and the outcome (null: no change)."""
    of = lambda v, c: F.max(F.when(F.col("version") == v, F.col(c)))
    names = {BASE: "base", LEFT: "left", RIGHT: "right"}
    pivot = [of(v, c).alias(f"{name}_{c}") for v, name in names.items() for c in ("value", "gone") if (v, c) != (BASE, "gone")]
    paths = cells.groupBy("doc_id", "kind", "place").agg(*pivot)
    base = F.col("base_value")
    value = {s: F.when(F.col(f"{s}_gone").isNull(), base).when(~F.col(f"{s}_gone"), F.col(f"{s}_value")) for s in ("left", "right")}
    paths = paths.select(
        "doc_id", "kind", "place", base.alias("base"), *[v.alias(s) for s, v in value.items()],
        *[(~v.eqNullSafe(base)).alias(f"{s}_changed") for s, v in value.items()], *[F.coalesce(F.col(f"{s}_gone"), F.lit(False)).alias(f"{s}_gone") for s in value],
    )
    both = F.col("left_changed") & F.col("right_changed") & ~F.col("left").eqNullSafe(F.col("right"))
    outcome = (
        F.when(both & F.col("base").isNull(), "insert_insert")
        .when(both & (F.col("left").isNull() | F.col("right").isNull()), "edit_delete")
        .when(both, "edit_edit")
        .when(F.col("left_changed") | F.col("right_changed"), "clean")
    )
    merged = F.when(both, F.col("base")).when(F.col("left_changed"), F.col("left")).otherwise(F.col("right"))
    return paths.select("doc_id", "kind", "place", "base", merged.alias("merged"), "left_changed", "right_changed", "left_gone", "right_gone", outcome.alias("outcome"))


def reassembled(paths: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The merged rows of ids that the base holds: doc_id, columns and text (null where the row is gone) and the outcomes' counts."""
    inner = F.col("kind") != ROW
    differs = ~F.col("merged").eqNullSafe(F.col("base"))
    line = F.struct("place", "kind", "merged", differs.alias("differs"), F.when(differs, F.col("base")).alias("base"))
    there = F.col("kind").isin(LINE, GAP) & (F.col("merged").isNotNull() | F.col("base").isNotNull())
    own = lambda side, k: F.max(F.when((F.col("kind") == COLUMN) & (F.col("place") == k), F.col(side)))
    rows = paths.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(there, line))).alias("lines"),
        *[own(side, k + 1).alias(f"{side}_{k}") for side in ("base", "merged") for k in range(len(columns))],
        *[F.max(inner & F.col(f"{s}_changed")).alias(f"{s}_changed") for s in ("left", "right")],
        *[F.max(~inner & F.col(f"{s}_gone")).alias(f"{s}_gone") for s in ("left", "right")],
        *[F.count(F.when(inner & (F.col("outcome") == o), 1)).alias(o) for o in OUTCOMES],
    )
    dropped = F.col("left_gone") | F.col("right_gone")
    kept = (F.col("left_gone") & ~F.col("right_gone") & F.col("right_changed")) | (F.col("right_gone") & ~F.col("left_gone") & F.col("left_changed"))
    rows = rows.select("*", dropped.alias("dropped"), kept.alias("kept"))
    text = lambda of: F.array_join(F.filter(F.transform("lines", of), lambda x: x.isNotNull()), "\n")
    before, after = text(lambda x: F.when(x["differs"], x["base"]).otherwise(x["merged"])), text(lambda x: x["merged"])
    state = lambda base, merged: F.when(F.col("kept"), base).when(~F.col("dropped"), merged)
    alone = lambda o: F.when(F.col("dropped"), F.when(F.col("kept"), F.lit(int(o == "edit_delete"))).otherwise(F.lit(int(o == "clean")))).otherwise(F.col(o))
    return rows.select(
        "doc_id", *[state(F.col(f"base_{k}"), F.col(f"merged_{k}")).alias(c) for k, c in enumerate(columns)], state(before, after).alias("text"), *[alone(o).cast("bigint").alias(f"n_{o}") for o in OUTCOMES]
    )


def added_rows(cells: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The merged rows of ids that branches add, as reassembled() gives them."""
    paths = resolved(cells)
    row = F.from_json("merged", ", ".join(f"`{c}` string" for c in ("text", *columns)))
    return paths.select("doc_id", *[row[c].alias(c) for c in (*columns, "text")], *[(F.col("outcome") == o).cast("bigint").alias(f"n_{o}") for o in OUTCOMES])


def merge(base: DataFrame, cells: DataFrame, added: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Every id of the base or an added row: its merged columns and text (null: the row is gone) and n_clean, n_edit_edit,
    n_edit_delete, n_insert_insert. base: one row per id; cells: all of its cells and the changed ones; added: cells of added rows."""
    new = added_rows(added, columns).join(base.select(F.col("doc_id").alias("held")), F.col("doc_id") == F.col("held"), "left")
    alone = new.filter("held is null").drop("held")
    clash = new.filter("held is not null").select("held", F.lit(1).alias("n"))
    counts = [F.col(f"n_{o}") for o in OUTCOMES[:-1]]
    old = reassembled(resolved(cells), columns).join(clash, F.col("doc_id") == F.col("held"), "left")
    old = old.select("doc_id", *columns, "text", *counts, (F.col("n_insert_insert") + F.coalesce("n", F.lit(0))).cast("bigint").alias("n_insert_insert"))
    return old.unionByName(alone)


def op11_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = one_row_per_id(table(spark, sf_dir, "documents"))
    merged = merge(base, branch_cells(base), added_cells(base))
    return merged.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


QUERIES = {"op11_branch_merge": op11_branch_merge}


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text."""
    byte = "lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END"
    steps = f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), {steps}), 4294967295)"


def _side_sql(s: str) -> str:
    """One branch's view of the cells c: value and whether it changed."""
    return f"""CASE WHEN kind = 'gap' THEN CASE {s} WHEN 3 THEN '!' WHEN 4 THEN '?' END
    WHEN {s} = 0 THEN CASE WHEN kind = 'column' THEN '' END WHEN {s} = 1 THEN value || '!' WHEN {s} = 2 THEN value || '?' ELSE value END"""


ORACLE_SQL = {
    "op11_branch_merge": f"""
WITH d AS (SELECT doc_id, unnest(min({{'t': coalesce(text, ''), 'l': coalesce(lang, ''), 's': coalesce(source, '')}})) FROM documents GROUP BY doc_id),
p AS (
  SELECT doc_id, 'row' AS kind, 0 AS place, 'row' AS name, '' AS value FROM d UNION ALL
  SELECT doc_id, 'column', 1, 'lang', l FROM d UNION ALL SELECT doc_id, 'column', 2, 'source', s FROM d UNION ALL
  SELECT doc_id, 'line', i - 1, CAST(i - 1 AS VARCHAR), x[i] FROM (SELECT doc_id, string_split(t, chr(10)) AS x, unnest(generate_series(1, len(string_split(t, chr(10))))) AS i FROM d)
), q AS MATERIALIZED (
  SELECT *, {crc32_sql("'L:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || name")} % 11 AS l, {crc32_sql("'R:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || name")} % 11 AS r FROM p
), c AS (
  SELECT doc_id, kind, place, value, l, r FROM q WHERE kind IN ('column', 'line') UNION ALL SELECT doc_id, 'gap', place, NULL, l, r FROM q WHERE kind = 'line'
), v AS (SELECT *, {_side_sql("l")} AS a, {_side_sql("r")} AS b FROM c),
w AS (SELECT *, a IS DISTINCT FROM value AS ca, b IS DISTINCT FROM value AS cb, ca AND cb AND a IS DISTINCT FROM b AS x FROM v),
m AS (
  SELECT *, CASE WHEN x THEN value WHEN ca THEN a ELSE b END AS merged,
    CASE WHEN x AND value IS NULL THEN 'ii' WHEN x AND (a IS NULL OR b IS NULL) THEN 'ed' WHEN x THEN 'ee' WHEN ca OR cb THEN 'c' END AS o FROM w
), g AS (
  SELECT doc_id, bool_or(ca) AS ca, bool_or(cb) AS cb, max(CASE WHEN kind = 'column' AND place = 1 THEN merged END) AS lang, max(CASE WHEN kind = 'column' AND place = 2 THEN merged END) AS source,
    coalesce(string_agg(CASE WHEN kind <> 'column' THEN merged END, chr(10) ORDER BY place, kind DESC), '') AS t,
    count(*) FILTER (o = 'c') AS c, count(*) FILTER (o = 'ee') AS ee, count(*) FILTER (o = 'ed') AS ed, count(*) FILTER (o = 'ii') AS ii FROM m GROUP BY doc_id
), h AS (
  SELECT d.doc_id, d.t AS bt, d.l AS bl, d.s AS bs, g.* EXCLUDE (doc_id), q.l = 0 AS dl, q.r = 0 AS dr, dl OR dr AS gone, (dl AND NOT dr AND cb) OR (dr AND NOT dl AND ca) AS kept
  FROM d JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id JOIN q ON d.doc_id IS NOT DISTINCT FROM q.doc_id AND q.kind = 'row'
), n AS (
  SELECT -1 - d.doc_id AS doc_id, 1 AS side, CASE q.l WHEN 3 THEN '!' ELSE '?' END AS t, d.l AS lang, d.s AS source FROM d JOIN q ON d.doc_id = q.doc_id AND q.kind = 'row' AND q.l IN (3, 4) UNION ALL
  SELECT -2 - d.doc_id, 2, CASE q.r WHEN 3 THEN '!' ELSE '?' END, d.l, d.s FROM d JOIN q ON d.doc_id = q.doc_id AND q.kind = 'row' AND q.r IN (3, 4)
), a AS (SELECT doc_id, count(DISTINCT (t, lang, source)) = 1 AS same, min(t) AS t, min(lang) AS lang, min(source) AS source FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN kept THEN bl WHEN NOT gone THEN lang END AS lang, CASE WHEN kept THEN bs WHEN NOT gone THEN source END AS source,
  CASE WHEN kept THEN sha256(bt) WHEN NOT gone THEN sha256(t) END AS text_sha256,
  CAST(CASE WHEN gone THEN NOT kept ELSE c END AS BIGINT) AS n_clean, CAST(CASE WHEN gone THEN 0 ELSE ee END AS BIGINT) AS n_edit_edit,
  CAST(CASE WHEN gone THEN kept ELSE ed END AS BIGINT) AS n_edit_delete,
  CAST(CASE WHEN gone THEN 0 ELSE ii END + (EXISTS (SELECT 1 FROM a WHERE a.doc_id = h.doc_id))::INT AS BIGINT) AS n_insert_insert FROM h
UNION ALL
SELECT doc_id, CASE WHEN same THEN lang END, CASE WHEN same THEN source END, CASE WHEN same THEN sha256(t) END, CAST(same AS BIGINT), 0, 0, CAST(NOT same AS BIGINT)
FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = a.doc_id)"""
}
