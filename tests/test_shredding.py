import json

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.operators import shredding as sh


def test_plan():
    p = sh.plan(sh.RESULT_GRAPH)
    assert set(p) == {"result", "element", "row", "cell"}
    assert "location.from_image" in p["element"].columns and "metadata.title" in p["result"].columns
    shared = sh.SchemaGraph("a", {"a": (), "b": ("x",), "c": ("y",), "d": ("z",)}, {"a": (sh.Edge("b", "b"), sh.Edge("c", "c")), "b": (sh.Edge("d", "d"),), "c": (sh.Edge("d", "d"),)})
    q = sh.plan(shared)
    assert set(q) == {"a", "d"} and set(q["a"].columns) == {"b.x", "c.y"} and len(q["a"].children) == 2


def nodes(spark, *payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "raw_id long, payload string")
    return sorted((r.raw_id, r.result_id, r.node, r.parent) for r in sh.node_parents(df).collect())


def test_nodes(spark):
    inner = {"type": "table", "rows": [["a", None], None, [1]], "location": {"from_image": "IMAGES\\I.png"}}
    r = {"id": "x", "elements": [None, {"type": "group", "elements": {"type": "text"}}, inner, {"type": "image", "file": "images/i.png", "elements": json.dumps([inner])}]}
    want = [("2", ""), ("2.1", "2"), ("3", "4"), ("3:1:1", "3"), ("3:3:1", "3"), ("4", ""), ("4.1", "4"), ("4.1:1:1", "4.1"), ("4.1:3:1", "4.1")]
    for wrapped in (r, [r], {"result": r}, {"exported": 1, "results": [None, r, r]}, json.dumps(r), {"result": json.dumps(r)}, {"id": 7, "source": "exporter", "payload": [r]}, {"results": {"deep": [r]}}, r | {"elements": json.dumps(r["elements"]), "extra": {"id": 1}}):
        assert [n[2:] for n in nodes(spark, json.dumps(wrapped))] == want


def test_odd_payloads(spark):
    lone = {"id": None, "elements": {"type": "table", "rows": json.dumps([["v"]])}}
    got = nodes(spark, None, "", "{", '{"id": "x", "elements": [1, "t", {"type"', "[]", "3", '"text"', '{"id": NaN, "elements": []}', '{"id": "e"}', json.dumps(lone), "[" * 100_000)
    assert got == [(9, None, "1", ""), (9, None, "1:1:1", "1")]
    assert nodes(spark) == []


def test_tables(spark):
    r = {"id": "x", "metadata": {"title": "t"}, "elements": [{"type": "table", "n_rows": 1, "rows": [["a", 2.5]], "location": {"page": 3, "bbox": [1, 2.0]}}]}
    df = spark.createDataFrame([(1, json.dumps(r), "clash"), (1, json.dumps(r), "clash")], "raw_id long, payload string, attrs string")
    flat = sh.flatten(df, "raw_id", "payload")
    e = sh.wide(flat, "raw_id", "element").collect()
    assert len(e) == 2 and e[0].location_page == "3" and e[0].location_bbox == "[1, 2.0]" and e[0].n_rows == "1" and e[0].parent_table == "result"
    assert [x.value for x in sh.wide(flat, "raw_id", "cell").collect()] == ["a", "2.5"] * 2
    assert sh.wide(flat, "raw_id", "result").first().metadata_title == "t"
    keys = {(x.parent_table, x.parent_key) for x in flat.collect()}
    assert all(t == "" or (t, k) in {(x.table, x.key) for x in flat.collect()} for t, k in keys)


element = st.recursive(st.fixed_dictionaries({"type": st.just("text")}), lambda c: st.fixed_dictionaries({"type": st.just("group"), "elements": st.lists(st.one_of(st.none(), c), max_size=3)}), max_leaves=6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), element), max_size=4))
def test_every_element_has_a_place(elements):
    tables = sh.plan(sh.RESULT_GRAPH)
    rows = sh.shred(tables, sh.RESULT_GRAPH, {"id": "x", "elements": elements})

    def at(key):
        here = elements
        for n, k in enumerate(key.split(".")):
            here = here[int(k) - 1] if n == 0 else here["elements"][int(k) - 1]
        return here

    count = lambda es: sum(1 + count(e.get("elements", [])) for e in es if e)
    own = [r for r in rows if r[0] == "element"]
    assert len(own) == len({r[1] for r in own}) == count(elements) and all(at(r[1]) is r[5] for r in own)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(), c, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(values, st.sampled_from([None, 1]))
def test_deep_reads_what_json_reads(v, indent):
    assert sh.deep(json.dumps(v, indent=indent)) == v


def test_deep():
    n = 20_000
    v = sh.deep("[" * n + "1" + "]" * n)
    for _ in range(n):
        (v,) = v
    assert v == 1
    for bad in ("", "[", "[1", "[1,]", "{", '{"a"', '{"a":', '{"a":1,}', "[1] 2", "nul", '"x', "{1:2}", "[1 2]", "]"):
        try:
            got = sh.deep(bad)
        except ValueError:
            continue
        raise AssertionError((bad, got))


def test_nested_deep(spark):
    n = 3000
    text = '{"id": "x", "elements": [' + '{"type": "group", "elements": [' * n + "]}" * n + "]}"
    assert len(nodes(spark, text)) == n and nodes(spark, text[:-1]) == []


def test_nothing_is_lost(spark):
    r = {"id": "x", "note": {"by": "ana"}, "metadata": {"title": "t", "lang": "ja"}, "elements": [{"type": "text", "rank": 3, "location": {"page": 1, "zone": [1]}, "void": None}], "type": 1}
    df = spark.createDataFrame([(1, json.dumps(r)), (2, None), (3, "{")], "raw_id long, payload string")
    got = sorted((x.table, x.key, x.name, x.value) for x in sh.other_keys(df, "raw_id", "payload").collect())
    assert got == [("element", "1", "location.zone", "[1]"), ("element", "1", "rank", "3"), ("result", "", "metadata.lang", "ja"), ("result", "", "note", '{"by": "ana"}'), ("result", "", "type", "1")]


def test_derived_graph(spark):
    part = {"name": "a", "parts": [{"name": "b", "maker": {"town": "T"}}, {"name": "c", "parts": {"name": "d"}}], "tags": ["x", "y"]}
    df = spark.createDataFrame([(1, json.dumps({"product": part})), (2, "bad")], "raw_id long, payload string")
    edges = sh.profile(df, "payload")
    assert {(r.type, r.name, r.kind): r.n for r in edges.collect()}[("parts", "parts", "one")] == 1
    g = sh.derived(edges, "product")
    p = sh.plan(g)
    assert set(p) == {"product", "parts", "tags"} and g.reaches("parts", "parts") and "maker.town" in p["parts"].columns
    assert sh.profile(df.limit(0), "payload").count() == 0


def test_rows_without_cells(spark):
    r = {"id": "x", "elements": [{"type": "table", "rows": [[], ["a"], None]}]}
    flat = sh.flatten(spark.createDataFrame([(1, json.dumps(r))], "raw_id long, payload string"), "raw_id", "payload")
    assert sorted(x.key for x in sh.wide(flat, "raw_id", "row").collect()) == ["1:1", "1:2"]
