"""Shared inlining: nested records into flat tables with parent-child keys.

A schema graph names the record types and the edges between them. `plan()` decides, as in shared inlining of
hierarchical documents into relations, which types get a table of their own: the root, and every type that is
repeated (reached by a many-edge), shared (reached by several edges) or recursive (reaches itself). Every other type
has exactly one parent and is inlined into that parent's table under a dotted column name. Each row carries its own
key, the table and key of its parent and its ordinal; key references declared on the graph replace the structural
parent by the row they name.

One pass of `mapInArrow` over the documents, without a shuffle: a document is shredded where it is read, so neither a
hot exporter nor a hot project moves rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """A child of a record type. many: an array of children, where a lone object stands for an array of one."""

    name: str
    target: str
    many: bool = False


@dataclass(frozen=True)
class KeyRef:
    """A row whose attribute `at` equals another row's attribute `to` (after `normal`) is that row's child.

    Only rows without a parent row of the same table are re-parented; a reference that names nothing keeps them at the top.
    """

    table: str
    at: str
    to: str
    where: tuple[str, str]


@dataclass(frozen=True)
class SchemaGraph:
    root: str
    scalars: dict[str, tuple[str, ...]]
    edges: dict[str, tuple[Edge, ...]]
    keyref: KeyRef | None = None

    def types(self) -> list[str]:
        seen, todo = [], [self.root]
        while todo:
            t = todo.pop(0)
            if t not in seen:
                seen.append(t)
                todo += [e.target for e in self.edges.get(t, ())]
        return seen

    def reaches(self, a: str, b: str) -> bool:
        seen: set[str] = set()
        todo = [e.target for e in self.edges.get(a, ())]
        while todo:
            t = todo.pop()
            if t == b:
                return True
            if t not in seen:
                seen.add(t)
                todo += [e.target for e in self.edges.get(t, ())]
        return False


@dataclass
class TablePlan:
    """columns: dotted column name to the path of keys. children: path of keys, table and whether many."""

    name: str
    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    children: list[tuple[tuple[str, ...], str, bool]] = field(default_factory=list)


def plan(g: SchemaGraph) -> dict[str, TablePlan]:
    """The tables of shared inlining."""
    indegree: dict[str, int] = {}
    repeated: set[str] = set()
    for t in g.types():
        for e in g.edges.get(t, ()):
            indegree[e.target] = indegree.get(e.target, 0) + 1
            if e.many:
                repeated.add(e.target)
    own = {t for t in g.types() if t == g.root or t in repeated or indegree.get(t, 0) > 1 or g.reaches(t, t)}
    out: dict[str, TablePlan] = {}
    for t in g.types():
        if t not in own:
            continue
        p = out[t] = TablePlan(t)
        todo: list[tuple[str, tuple[str, ...]]] = [(t, ())]
        while todo:
            at, path = todo.pop(0)
            for s in g.scalars.get(at, ()):
                p.columns[".".join((*path, s))] = (*path, s)
            for e in g.edges.get(at, ()):
                if e.target in own:
                    p.children.append(((*path, e.name), e.target, e.many))
                else:
                    todo.append((e.target, (*path, e.name)))
    return out


#: The record types of an extraction result. "" is the unnamed edge from a row, itself an array, to its cells.
RESULT_GRAPH = SchemaGraph(
    root="result",
    scalars={
        "result": ("id", "source", "source_abspath", "source_hash", "content_hash", "file_type"),
        "metadata": ("title", "author", "created", "modified"),
        "element": ("type", "content", "style", "n_rows", "n_cols", "file", "format", "width", "height", "ocr_text"),
        "location": ("order", "sheet", "anchor", "slide", "shape_name", "page", "bbox", "from_image", "bbox_in_image"),
        "cell": ("",),
    },
    edges={
        "result": (Edge("metadata", "metadata"), Edge("elements", "element", many=True)),
        "element": (Edge("location", "location"), Edge("elements", "element", many=True), Edge("rows", "row", many=True)),
        "row": (Edge("", "cell", many=True),),
    },
    keyref=KeyRef("element", at="location.from_image", to="file", where=("type", "image")),
)


def _no_constant(x: str) -> None:
    raise ValueError(f"{x} is not JSON")


SPACE = re.compile(r"[ \t\n\r]*")
LITERAL = {"true": True, "false": False, "null": None}


def deep(text: str) -> object:
    """The value of JSON text by a stack of its own, however deep it is nested; ValueError where it is invalid."""
    at = SPACE.match(text, 0).end()
    stack: list[list | dict] = []
    names: list[str | None] = []
    while True:
        c = text[at : at + 1]
        done = True
        if c in ("{", "["):
            own: list | dict = {} if c == "{" else []
            at = SPACE.match(text, at + 1).end()
            value: object = own
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                stack.append(own)
                names.append(None)
                done = False
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := NUMBER_RE.match(text, at):
            whole, fraction, exponent = m.groups()
            value, at = float(m.group()) if fraction or exponent else int(whole), m.end()
        else:
            word = next((w for w in LITERAL if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no value at {at}")
            value, at = LITERAL[word], at + len(word)
        while done:
            at = SPACE.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError(f"more text at {at}")
                return value
            top = stack[-1]
            if isinstance(top, list):
                top.append(value)
            else:
                top[names[-1]] = value
            c = text[at : at + 1]
            if c == ",":
                at = SPACE.match(text, at + 1).end()
                done = False
            elif c == ("]" if isinstance(top, list) else "}"):
                value, at = stack.pop(), at + 1
                names.pop()
            else:
                raise ValueError(f"no end at {at}")
        if isinstance(stack[-1], dict):
            if text[at : at + 1] != '"':
                raise ValueError(f"no name at {at}")
            names[-1], at = scanstring(text, at + 1, True)
            at = SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = SPACE.match(text, at + 1).end()


def parse(text: str | None) -> tuple[bool, object]:
    """(valid, value). NaN and Infinity, null and empty text are invalid."""
    if not text:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        pass
    except ValueError:
        return False, None
    try:
        return True, deep(text)
    except ValueError:
        return False, None


def _parsed(v: object) -> object:
    """A value held as JSON text counts as if parsed; other text stays text."""
    while isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        ok, x = parse(v)
        if not ok:
            return v
        v = x
    return v


def roots(value: object, known: frozenset[str], repeated: frozenset[str]) -> Iterator[dict]:
    """The root records in any wrapper: lists, single-key or many-key objects, JSON text; in order of appearance.

    An object with a repeated child of the root is one. An object that only has scalars of the root is one unless it wraps
    others under keys that the graph doesn't know: a delivery can have an id and a source of its own.
    """
    todo = [value]
    while todo:
        v = _parsed(todo.pop())
        if isinstance(v, dict):
            inner = [] if repeated & v.keys() else [x for k, x in v.items() if k not in known and isinstance(x, (dict, list, str))]
            if known & v.keys() and not any(_wraps(x, known) for x in inner):
                yield v
            else:
                todo += reversed(inner)
        elif isinstance(v, list):
            todo += [x for x in reversed(v) if isinstance(x, (dict, list, str))]


def _wraps(value: object, known: frozenset[str]) -> bool:
    """Whether a value is or holds, in lists only, an object with two keys of a root record or more."""
    todo = [value]
    while todo:
        v = _parsed(todo.pop())
        if isinstance(v, dict) and len(known & v.keys()) >= 2:
            return True
        if isinstance(v, list):
            todo += [x for x in v if isinstance(x, (dict, list, str))]
    return False


def _at(rec: object, path: tuple[str, ...]) -> object:
    for k in path:
        rec = rec.get(k) if isinstance(rec, dict) else None
        if len(path) > 1:
            rec = _parsed(rec)
    return rec


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        return None


def _normal(v: object) -> str | None:
    return v.replace("\\", "/").casefold() if isinstance(v, str) and v else None


def shred(tables: dict[str, TablePlan], g: SchemaGraph, rec: dict) -> list[tuple]:
    """Rows (table, key, parent table, parent key, ordinal, record) of one root record, in document order.

    key: "" for the root; below it the ordinal for a child of the root, then "." between rows of one table and ":" at
    a change of table, so an inner element is 3.1 and a cell 3.1:2:4. Ordinals count from 1, null members included.
    """
    out: list[tuple] = []
    stack: list[tuple[str, str, str, str, int, object]] = [(g.root, "", "", "", 1, rec)]
    while stack:
        table, key, ptable, pkey, ordinal, r = stack.pop()
        out.append((table, key, ptable, pkey, ordinal, r))
        kids = []
        for path, child, _many in tables[table].children:
            if path[-1] == "":
                v = r if isinstance(r, list) else [r]
            else:
                v = _parsed(_at(r, path))
            if v is None:
                continue
            if not isinstance(v, list):
                v = [v]
            sep = "" if table == g.root else "." if child == table else ":"
            leaf = not tables[child].children
            for i, x in enumerate(v, 1):
                if x is None:
                    continue
                if not leaf:
                    x = _parsed(x)
                    if child != "row" and not isinstance(x, dict):
                        continue
                kids.append((child, f"{key}{sep}{i}", table, key, i, x))
        stack += reversed(kids)
    return out


def resolve(g: SchemaGraph, tables: dict[str, TablePlan], rows: list[tuple]) -> list[tuple]:
    """Applies the key reference to the rows of one root record."""
    k = g.keyref
    if not k:
        return rows
    cols = tables[k.table].columns
    named: dict[str, str] = {}
    for t, key, _pt, _pk, _i, r in rows:
        if t == k.table and _at(r, cols[k.where[0]]) == k.where[1] and (f := _normal(_at(r, cols[k.to]))):
            named.setdefault(f, key)
    out = []
    for t, key, pt, pk, i, r in rows:
        if t == k.table and pt == g.root and (f := _normal(_at(r, cols[k.at]))) in named and named[f] != key:
            pt, pk = k.table, named[f]
        out.append((t, key, pt, pk, i, r))
    return out


FLAT = "table string, root_ord int, root_id string, key string, parent_table string, parent_key string, ordinal int"


def flatten(df: DataFrame, doc: str, payload: str, g: SchemaGraph = RESULT_GRAPH, keep: tuple[str, ...] | None = None, attrs: bool = True, others: bool = False) -> DataFrame:
    """Shreds every JSON payload of `df`: columns `doc`, FLAT and, with attrs, attrs map<string,string> of the plan's columns.

    Defined results: a null, empty, cut-off or otherwise invalid payload gives no row; a valid one without a root record
    none either. Repeated payload rows give repeated rows. Null members hold their position and give no row. Text where
    an object is expected counts if it is JSON, otherwise gives no row. Other columns of `df` are ignored, whatever
    their names. keep: only rows of these tables. others: attrs has the keys that the graph doesn't know instead, so that
    nothing of a record is lost. A scalar that nests too deep to be written as text is null.
    """
    tables = plan(g)
    known = frozenset(g.scalars[g.root]) | {e.name for e in g.edges[g.root]}
    kind = dict(df.select(doc).dtypes)[doc]
    schema = f"`{doc}` {kind}, {FLAT}" + ", attrs map<string,string>" * attrs
    repeated = frozenset(e.name for e in g.edges[g.root] if e.many)
    first = g.scalars[g.root][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int] = []
            cols: list[list] = [[] for _ in range(7 + attrs)]
            for i, text in enumerate(b.column(1).to_pylist()):
                ok, value = parse(text)
                if not ok:
                    continue
                for n, rec in enumerate(roots(value, known, repeated), 1):
                    rid = _text(rec.get(first))
                    for t, key, pt, pk, o, r in resolve(g, tables, shred(tables, g, rec)):
                        if keep and t not in keep:
                            continue
                        ids.append(i)
                        for c, v in zip(cols, (t, n, rid, key, pt, pk, o)):
                            c.append(v)
                        if others:
                            cols[7].append([(k, _text(v)) for k, v in unknown(tables[t], r)])
                        elif attrs:
                            own = tables[t].columns
                            cols[7].append([(c, _text(r if p == ("",) else v)) for c, p in own.items() if (v := r if p == ("",) else _at(r, p)) is not None])
            for s in range(0, len(ids), 20_000):
                e = s + 20_000
                types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
                arrays = [pa.array(c[s:e], t) for c, t in zip(cols, types)]
                if attrs:
                    arrays.append(pa.array(cols[7][s:e], pa.map_(pa.string(), pa.string())))
                names = [doc, "table", "root_ord", "root_id", "key", "parent_table", "parent_key", "ordinal", "attrs"][: len(arrays) + 1]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids[s:e], pa.int64())), *arrays], names)

    return df.select(F.col(doc), F.col(payload).cast("string")).mapInArrow(run, schema)


def unknown(p: TablePlan, rec: object) -> Iterator[tuple[str, object]]:
    """Dotted keys of a record, and of what is inlined in it, that its table's plan has no column or child for, with their values."""
    paths = {(*x,) for x in p.columns.values()} | {c[0] for c in p.children}
    inner = {x[:i] for x in paths for i in range(1, len(x))}
    todo: list[tuple[tuple[str, ...], object]] = [((), rec)]
    while todo:
        at, r = todo.pop()
        for k, v in r.items() if isinstance(r, dict) else ():
            here = (*at, k)
            if here in inner:
                todo.append((here, _parsed(v)))
            elif here not in paths and v is not None:
                yield ".".join(here), v


def other_keys(df: DataFrame, doc: str, payload: str, g: SchemaGraph = RESULT_GRAPH) -> DataFrame:
    """`doc`, root_ord, table, key, name, value: a row for each attribute of a record that the graph doesn't know, nested ones as JSON text."""
    flat = flatten(df, doc, payload, g, others=True)
    return flat.select(doc, "root_ord", "table", "key", F.explode("attrs").alias("name", "value"))


#: Edges of a derived graph: more would be keys that are data, such as ids, which are to be shredded as values first.
MAX_EDGES = 10_000


def profile(df: DataFrame, payload: str) -> DataFrame:
    """type, name, kind (scalar, one, many), n: the edges of the records as they are. A type is named by the key that its records are under, "" at the top.

    Each task counts its own distinct edges, whose sums are aggregated; records of a key nested in itself are one recursive type.
    Null, empty and invalid payloads have none; JSON text inside a string counts as if parsed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[str, str, str]] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                ok, value = parse(text)
                todo: list[tuple[str, object]] = [("", value)] if ok else []
                while todo:
                    of, v = todo.pop()
                    v = _parsed(v)
                    if isinstance(v, list):
                        for x in v:
                            x = _parsed(x)
                            if isinstance(x, list):
                                n[of, "", "many"] += 1
                            elif not isinstance(x, dict):
                                n[of, "", "scalar"] += x is not None
                            todo.append((of, x))
                    for k, x in v.items() if isinstance(v, dict) else ():
                        x = _parsed(x)
                        n[of, k, "many" if isinstance(x, list) else "one" if isinstance(x, dict) else "scalar"] += 1
                        if isinstance(x, (dict, list)):
                            todo.append((k, x))
        if n:
            of, name, kind, many = zip(*((*k, v) for k, v in n.items()))
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(name), pa.array(kind), pa.array(many, pa.int64())], ["type", "name", "kind", "n"])

    return df.select(F.col(payload).cast("string")).mapInArrow(run, "type string, name string, kind string, n long").groupBy("type", "name", "kind").agg(F.sum("n").alias("n"))


def derived(edges: DataFrame, root: str) -> SchemaGraph:
    """The schema graph below the records under the key `root`, from their profile(): a key that ever holds an array is repeated."""
    rows = edges.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges: keys seem to be data")
    by: dict[str, dict[str, set[str]]] = {}
    for r in rows:
        by.setdefault(r["type"], {}).setdefault(r["name"], set()).add(r["kind"])
    scalars = {t: tuple(sorted(k for k, kinds in own.items() if k and kinds == {"scalar"})) for t, own in by.items()}
    out: dict[str, tuple[Edge, ...]] = {}
    todo, known = [root], set()
    while todo:
        t = todo.pop()
        if t in known:
            continue
        known.add(t)
        out[t] = tuple(Edge(k, k, "many" in kinds) for k, kinds in sorted(by.get(t, {}).items()) if k and kinds != {"scalar"})
        todo += [e.target for e in out[t]]
    return SchemaGraph(root, {t: scalars.get(t, ()) for t in known}, out)


def wide(flat: DataFrame, doc: str, table: str, g: SchemaGraph = RESULT_GRAPH) -> DataFrame:
    """One of the related tables with a column for each attribute, dots as underscores, beside its keys."""
    cols: list[Column] = []
    for c in plan(g)[table].columns:
        cols.append(F.col("attrs")[c].alias(c.replace(".", "_") or "value"))
    keys = [F.col(x) for x in (doc, "root_ord", "root_id", "key", "parent_table", "parent_key", "ordinal")]
    return flat.where(F.col("table") == table).select(*keys, *cols)


def node_parents(df: DataFrame, doc: str = "raw_id", payload: str = "payload") -> DataFrame:
    """raw_id, result_id, node, parent of every element and non-null cell; a result delivered twice in one payload counts once.

    A cell's parent is its element, not its row: the row table only carries the link between both.
    """
    flat = flatten(df, doc, payload, keep=("element", "cell"), attrs=False)
    parent = F.when(F.col("table") == "cell", F.regexp_replace("parent_key", ":[^:]*$", "")).when(F.col("parent_table") == "element", F.col("parent_key")).otherwise("")
    return flat.select(F.col(doc), F.col("root_id").alias("result_id"), F.col("key").alias("node"), parent.alias("parent")).distinct()
