"""Problem 2: turn deeply nested records into related flat tables by shared inlining.

A first pass over all records draws the graph of the schema: which elements occur under which, how often,
and whether they repeat. From it a relational plan follows: an element that occurs once under its parent
is inlined as columns of the parent's table; one that repeats (array items, entries of an object used as a
map), is reached from several parents or contains itself gets a table of its own with a foreign key to
its parent row and its position. A second pass fills the tables.

A record may be wrapped in envelopes and encoded (a JSON text within a JSON text, a byte order mark): it
is the shallowest object that has all of the record keys. Unreadable, cut-off, null or empty records give
no rows; nulls and empty parts are kept as rows where they are an item of something repeated.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import cut

#: An object with more different keys than this, over all records, is a map, not a structure.
MAX_KEYS = 64
#: So is one whose records have, on average, no more than this part of its different keys.
SPARSE = 0.34
MIN_SPARSE_KEYS = 8
#: Lists of objects with at least MIN_SHARED keys, of which this part is common, are one element under two names.
SHARED_PART = 0.8
MIN_SHARED = 3


class _Unreadable(Exception):
    """Why a text holds no record: 'empty', 'cut off', 'too deep' (for the JSON reader itself) or 'no record'."""


def _decoded(text: str) -> object:
    """The value in a JSON text, however often it is encoded."""
    value: object = text
    while isinstance(value, str):
        bare = value.lstrip("\ufeff").strip()
        if not bare:
            raise _Unreadable("empty")
        try:
            value = json.loads(bare)
        except RecursionError:
            raise _Unreadable("too deep") from None
        except ValueError:
            raise _Unreadable("cut off") from None
    return value


def _find_record(text: str | None, record_keys: tuple[str, ...]) -> dict | list:
    if text is None:
        raise _Unreadable("empty")
    value = _decoded(text)
    if not isinstance(value, (dict, list)):
        raise _Unreadable("no record")
    if not record_keys:
        return value
    queue = deque([value])
    while queue:
        at = queue.popleft()
        if isinstance(at, dict) and all(k in at for k in record_keys):
            return at
        for child in at.values() if isinstance(at, dict) else at:
            if isinstance(child, str) and child.lstrip("\ufeff \t\r\n")[:1] in ("{", "[", '"'):
                try:
                    child = _decoded(child)
                except _Unreadable:
                    continue
            if isinstance(child, (dict, list)):
                queue.append(child)
    raise _Unreadable("no record")


def read_record(text: str | None, record_keys: tuple[str, ...] = ()) -> dict | list | None:
    """The record in a JSON text, out of any number of envelopes and encodings; None if there is none or it is cut off."""
    try:
        return _find_record(text, record_keys)
    except _Unreadable:
        return None


@dataclass
class Plan:
    """Which paths are tables, and how paths with another name are written.

    repeated: paths whose items are rows of their own. maps: objects whose entries are rows. same_as:
    path -> path of the shared element it is stored with.
    """

    repeated: set[str] = field(default_factory=set)
    maps: set[str] = field(default_factory=set)
    same_as: dict[str, str] = field(default_factory=dict)

    def table_of(self, path: str) -> str:
        return self.same_as.get(path, path)


def path_statistics(records: DataFrame, json_col: str, record_keys: tuple[str, ...] = ()) -> DataFrame:
    """(path, parent, objects, arrays, scalars, keys): the schema graph with counts, one row a path.

    Array items have the path of their array plus []. Paths are summed within each batch first; an object
    that passes MAX_KEYS keys in a batch has its entries counted under one path with *.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list] = {}
            children: dict[str, dict[str, str]] = {}

            def walk(record: object) -> None:
                open_: list[tuple[object, str, str]] = [(record, "$", "")]
                while open_:
                    value, path, parent = open_.pop()
                    row = seen.get(path)
                    if row is None:
                        row = seen[path] = [parent, 0, 0, 0, 0]
                    if isinstance(value, dict):
                        row[1] += 1
                        row[4] += len(value)
                        known = children.setdefault(path, {})
                        for key, child in value.items():
                            own = known.get(key)
                            if own is None:
                                own = known[key] = f"{path}.{key}" if len(known) < MAX_KEYS else f"{path}.*"
                            open_.append((child, own, path))
                        if len(known) > 16 * MAX_KEYS:  # a map: its further keys needn't be remembered
                            children[path] = dict(list(known.items())[:MAX_KEYS])
                    elif isinstance(value, list):
                        row[2] += 1
                        item = f"{path}[]"
                        open_ += [(child, item, path) for child in value]
                    else:
                        row[3] += 1

            for text in batch["j"]:
                record = read_record(text, record_keys)
                if record is not None:
                    walk(record)
            yield pd.DataFrame([(p, *r) for p, r in seen.items()], columns=["path", "parent", "objects", "arrays", "scalars", "keys"])

    rows = records.select(F.col(json_col).alias("j")).mapInPandas(count, "path string, parent string, objects bigint, arrays bigint, scalars bigint, `keys` bigint")
    return rows.groupBy("path", "parent").agg(*[F.sum(c).alias(c) for c in ("objects", "arrays", "scalars", "keys")])


def fold_free_keys(statistics: DataFrame) -> DataFrame:
    """statistics with the entries of every object of more than MAX_KEYS different keys under one path with *.

    From the root down, one join a level, so that a graph with any number of paths shrinks before it comes to
    the driver: no object keeps more than MAX_KEYS children.
    """
    level = statistics.where("parent = ''").select("path", F.col("path").alias("folded"), F.lit("").alias("folded_parent"))
    done, edges = [], statistics.where("parent <> ''").select("path", "parent")
    while True:
        level = cut(level)
        done.append(level)
        below = edges.join(level.select(F.col("path").alias("parent"), "folded"), "parent").withColumn("suffix", F.expr("substring(path, length(parent) + 1)"))
        if not below.limit(1).count():
            break
        wide = below.where("suffix <> '[]'").groupBy("folded").agg(F.count_distinct("suffix").alias("n")).where(F.col("n") > MAX_KEYS).select("folded", F.lit(True).alias("wide"))
        named = below.join(wide, "folded", "left")
        own = F.when(F.col("wide") & (F.col("suffix") != "[]"), F.lit(".*")).otherwise(F.col("suffix"))
        level = named.select("path", F.concat("folded", own).alias("next"), F.col("folded").alias("folded_parent")).withColumnRenamed("next", "folded")
    names = reduce(DataFrame.unionByName, done)
    counts = [F.sum(c).alias(c) for c in ("objects", "arrays", "scalars", "keys")]
    return statistics.join(names, "path").groupBy(F.col("folded").alias("path"), F.col("folded_parent").alias("parent")).agg(*counts)


def plan_tables(statistics: DataFrame, maps: tuple[str, ...] = (), repeated: tuple[str, ...] = (), shared: dict[str, str] | None = None, max_paths: int = 20_000) -> Plan:
    """The relational plan for a schema graph. maps, repeated and shared overrule it for paths the caller knows.

    The graph, not the data, comes to the driver; one of more than max_paths paths has its free keys folded first.
    """
    rows = statistics.limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        rows = fold_free_keys(statistics).collect()
    plan = Plan(repeated=set(repeated), maps=set(maps), same_as=dict(shared or {}))
    stats = {r["path"]: r for r in rows}
    kids: dict[str, list[str]] = {}
    for path, r in stats.items():
        kids.setdefault(r["parent"], []).append(path)
    # From the root down, paths as written become paths of the plan: a value standing alone where others
    # have an array is its only item, and the entries of a map are one element.
    leaves: dict[str, set[str]] = {}
    level: list[tuple[str, list[tuple[str, bool]]]] = [("$", [("$", False)])] if "$" in stats else []
    while level:
        below: dict[str, list[tuple[str, bool]]] = {}
        for path, raws in level:
            objects = sum(stats[p]["objects"] for p, _ in raws)
            keyed = [c for p, _ in raws for c in kids.get(p, ()) if c != f"{p}[]"]
            names = {c.rsplit(".", 1)[-1] for c in keyed}
            free = len(names) > MAX_KEYS or "*" in names
            sparse = len(names) >= MIN_SPARSE_KEYS and sum(stats[p]["keys"] for p, _ in raws) <= SPARSE * len(names) * max(objects, 1)
            if objects and (free or sparse):
                plan.maps.add(path)
            if any(stats[p]["arrays"] for p, item in raws if not item):
                plan.repeated.add(path)
            leaves.setdefault(path, set())
            if path in plan.repeated and not all(item for _, item in raws):
                own = below.setdefault(f"{path}[]", [])
                own += [(f"{p}[]", False) for p, item in raws if not item and f"{p}[]" in stats]
                if path not in plan.maps:
                    own += [(p, True) for p, item in raws if not item and stats[p]["objects"]]
                    continue
            for c in keyed:
                name = "*" if path in plan.maps else c[len(stats[c]["parent"]) + 1 :]
                leaves[path].add(name)
                below.setdefault(f"{path}.{name}", []).append((c, False))
        level = list(below.items())
    # a shared element: the same name and children under several parents (or below itself: recursive), or a list
    # of objects with nearly the same children under another name
    shape: dict[tuple[str, frozenset[str]], str] = {}
    lists: list[tuple[str, frozenset[str]]] = []
    for path in sorted(leaves, key=lambda p: (p.count(".") + p.count("[]"), p)):
        if path == "$" or path.endswith(("[]", ".*")) or not (path in plan.repeated or path in plan.maps):
            continue
        items = frozenset(leaves.get(f"{path}[]", ()))
        first = shape.setdefault((path.rsplit(".", 1)[-1], items | frozenset(leaves[path])), path)
        if first == path and path in plan.repeated and path not in plan.maps and len(items) >= MIN_SHARED:
            first = next((p for p, other in lists if len(items & other) >= max(MIN_SHARED, SHARED_PART * len(items | other))), path)
            if first == path:
                lists.append((path, items))
        if first != path and path not in plan.same_as and (path in plan.repeated, path in plan.maps) == (first in plan.repeated, first in plan.maps):
            plan.same_as[path] = first
    return plan


def _wanted_paths(plan: Plan, tables: set[str] | None):
    """A test, remembered by path, whether rows of the tables may come from below a path."""
    if tables is None:
        return lambda path: True
    raws = {p for p in plan.repeated | plan.maps if {plan.table_of(p) + "[]", plan.table_of(p) + ".*"} & tables}
    if "$" in tables or len(raws) < len(tables):
        return lambda path: True
    known: dict[str, bool] = {}

    def test(path: str) -> bool:
        found = known.get(path)
        if found is None:
            found = known[path] = any(r == path or r.startswith((path + ".", path + "[]")) for r in raws)
        return found

    return test


def shred(record: object, plan: Plan, wanted: set[str] | None = None, below=None) -> list[tuple[str, int, int, str, int, int, str, dict[str, str | None]]]:
    """(table, row, parent row, parent table, parent's position, position, key, columns); row 0 is the record.

    A value standing alone where others have an array counts as its only item. Empty items are rows too.
    With wanted, other tables are left out, and parts with no row of the wanted tables aren't walked through;
    rows are numbered among those met.
    """
    below = below or _wanted_paths(plan, wanted)
    out: list[tuple] = [("$", 0, -1, "", -1, 0, "", {})]
    maps, repeated = plan.maps, plan.repeated
    rows = 1
    # (value, its path, columns of its row or None where it opens one, prefix, row, table, position, key)
    open_: list[tuple] = [(record, "$", out[0][7], "", 0, "$", 0, "")]
    positions = {0: 0}
    while open_:
        value, path, columns, prefix, row, table, pos, key = open_.pop()
        if columns is None:
            parent, parent_table, table = row, prefix, table
            columns, row, prefix = {}, rows, ""
            rows += 1
            positions[row] = pos
            if wanted is None or table in wanted:
                out.append((table, row, parent, parent_table, positions[parent], pos, key, columns))
        if path in maps and isinstance(value, dict):
            if below(path):
                own, item = plan.table_of(path) + ".*", f"{path}.*"
                open_ += [(child, item, None, table, row, own, at, name) for at, (name, child) in reversed(list(enumerate(value.items())))]
        elif path in repeated and value is not None:
            if below(path):
                own, item = plan.table_of(path) + "[]", f"{path}[]"
                items = value if isinstance(value, list) else [value]
                open_ += [(child, item, None, table, row, own, at, str(at)) for at, child in reversed(list(enumerate(items)))]
        elif isinstance(value, dict):
            for name, child in reversed(value.items()):
                inner = f"{path}.{name}"
                if isinstance(child, (dict, list)) or inner in repeated:
                    if below(inner):
                        open_.append((child, inner, columns, f"{prefix}.{name}" if prefix else name, row, table, 0, ""))
                else:
                    columns[f"{prefix}.{name}" if prefix else name] = child if child is None or isinstance(child, str) else json.dumps(child)
        elif isinstance(value, list):
            columns[prefix or "value"] = json.dumps(value, ensure_ascii=False)
        else:
            columns[prefix or "value"] = value if value is None or isinstance(value, str) else json.dumps(value)
    return out if wanted is None or "$" in wanted else out[1:]


ROW = "struct<tbl:string,row:int,parent_row:int,parent_tbl:string,parent_pos:int,pos:int,key:string,columns:map<string,string>>"


def shred_records(records: DataFrame, id_cols: list[str], json_col: str, plan: Plan, record_keys: tuple[str, ...] = (), tables: set[str] | None = None) -> DataFrame:
    """(*id_cols, readable, rows): a row for each record with all its table rows in an array.

    With tables, only rows of those tables are kept.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*id_cols).schema) + f", readable boolean, rows array<{ROW}>"
    names = ("tbl", "row", "parent_row", "parent_tbl", "parent_pos", "pos", "key", "columns")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below = _wanted_paths(plan, tables)
        for batch in batches:
            readable, rows = [], []
            for text in batch["__json"]:
                record = read_record(text, record_keys)
                readable.append(record is not None)
                rows.append([] if record is None else [dict(zip(names, r)) for r in shred(record, plan, tables, below)])
            out = batch[id_cols].copy()
            out["readable"], out["rows"] = readable, rows
            yield out

    return records.select(*id_cols, F.col(json_col).alias("__json")).mapInPandas(work, schema)


#: The table that holds a row for each record that can't be read, with the reason as its key.
UNREADABLE = "unreadable"


def shred_rows(records: DataFrame, id_cols: list[str], json_col: str, plan: Plan, record_keys: tuple[str, ...] = (), tables: set[str] | None = None, with_columns: bool = True) -> DataFrame:
    """(*id_cols, tbl, row, parent_row, parent_tbl, parent_pos, pos, key[, columns]): the rows of all tables, or of those named.

    Records that can't be read ('empty', 'cut off', 'too deep', 'no record') are rows of the table 'unreadable'.
    Rows leave Python as flat Arrow columns, a bounded number at a time; nothing is shuffled.
    """
    ids = records.select(*id_cols).schema.fields
    schema = T.StructType([*ids])
    kinds = [("tbl", pa.string()), ("row", pa.int32()), ("parent_row", pa.int32()), ("parent_tbl", pa.string()), ("parent_pos", pa.int32()), ("pos", pa.int32()), ("key", pa.string()), ("columns", pa.map_(pa.string(), pa.string()))]
    spark_kinds = {pa.string(): T.StringType(), pa.int32(): T.IntegerType()}
    if not with_columns:
        kinds.pop()
    for name, kind in kinds:
        schema = schema.add(name, spark_kinds.get(kind) or T.MapType(T.StringType(), T.StringType()))
    failures = tables is None or UNREADABLE in tables

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = _wanted_paths(plan, None if tables is None else tables - {UNREADABLE})
        for batch in batches:
            held = batch.select(id_cols)
            took: list[int] = []
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                columns = list(zip(*rows)) or [[]] * 8
                values = [pa.array([list(c.items()) for c in columns[7]] if name == "columns" else columns[i], kind) for i, (name, kind) in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*held.take(pa.array(took, pa.int32())).columns, *values], names=[*id_cols, *(n for n, _ in kinds)])

            for i, text in enumerate(batch.column("__json").to_pylist()):
                try:
                    own = shred(_find_record(text, record_keys), plan, tables, below)
                except _Unreadable as why:
                    own = [(UNREADABLE, 0, -1, "", -1, 0, str(why), {})] if failures else []
                rows += own
                took += [i] * len(own)
                if len(rows) > 50_000:
                    yield flush()
                    took, rows = [], []
            yield flush()

    return records.select(*id_cols, F.col(json_col).alias("__json")).mapInArrow(work, schema)


def flat_table(shredded: DataFrame, id_cols: list[str], tbl: str, columns: list[str] | dict[str, str] | None = None) -> DataFrame:
    """One flat table: *id_cols, row, parent_row, parent_pos, pos, key and its columns.

    shredded: what shred_records or shred_rows gives. columns: their names, or names with SQL types (values that
    are none of the type come out null); all as a map if none are named.
    """
    if "tbl" in shredded.columns:
        rows, at = shredded.where(F.col("tbl") == tbl), lambda c: F.col(c)
    else:
        rows, at = shredded.select(*id_cols, F.explode("rows").alias("r")).where(F.col("r.tbl") == tbl), lambda c: F.col(f"r.{c}")
    base = [*id_cols, *[at(c).alias(c) for c in ("row", "parent_row", "parent_pos", "pos", "key")]]
    if columns is None:
        return rows.select(*base, at("columns").alias("columns"))
    typed = columns.items() if isinstance(columns, dict) else [(c, "string") for c in columns]
    return rows.select(*base, *[F.try_element_at(at("columns"), F.lit(c)).try_cast(t).alias(c) for c, t in typed])


def first_deliveries(records: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each key by the order columns: a partial aggregation, no sort and no window."""
    first = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("r"))
    return first.select(key, "r.*")


def first_rows(records: DataFrame, key: str, order: list[str], max_broadcast: int = 200_000) -> DataFrame:
    """The whole first row of each key by the order columns; rows of a null key are left out.

    For wide rows of which few are repeated: only the key and the order columns are shuffled, to find the keys
    that occur more than once (with their first place in the order). These are counted; up to max_broadcast of
    them are broadcast to one pass over the records, more are joined by key. Rows that tie in all order columns
    are the only ones shuffled whole: the one with the least hash of its other columns is kept.
    """
    known = records.where(F.col(key).isNotNull())
    place = F.struct(*order)
    counted = known.groupBy(key, *order).agg(F.count("*").alias("__n"))
    again = counted.groupBy(F.col(key).alias("__key")).agg(F.min(place).alias("__first"), F.sum("__n").alias("__all"), F.min_by("__n", place).alias("__ties")).where("__all > 1")
    again = cut(again.select("__key", "__first", "__ties"))
    sizes = again.agg(F.count("*").alias("n"), F.count_if(F.col("__ties") > 1).alias("tied")).first()
    if not sizes["n"]:
        return known
    joined = known.join(F.broadcast(again) if sizes["n"] <= max_broadcast else again, F.col(key) == F.col("__key"), "left")
    kept = joined.where(F.col("__first").isNull() | (place.eqNullSafe(F.col("__first"))))
    if not sizes["tied"]:
        return kept.select(*records.columns)
    rest = [c for c in records.columns if c not in order]
    hashed = F.xxhash64(F.to_json(F.struct(*rest)))
    whole = F.struct(*records.columns)
    one = kept.where("__ties > 1").groupBy("__key").agg(F.min_by(whole, hashed).alias("r")).select("r.*")
    return kept.where("coalesce(__ties, 1) = 1").select(*records.columns).unionByName(one)
