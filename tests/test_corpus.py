import datetime as dt

from pyspark.sql import functions as F

from paperloom.functions import paths
from paperloom.operators import corpus


def one(spark, col, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "p string").select(col(F.col("p"))).collect()]


def test_paths(spark):
    assert one(spark, paths.normal_path, "C:\\a\\b.docx", "file:/x/y z.pdf", "file:///C:/a.pdf", None) == ["C:/a/b.docx", "/x/y z.pdf", "C:/a.pdf", None]
    assert one(spark, paths.extension, "a/B.DOCX", "noext", "x.tar.pdf", "") == ["docx", "", "pdf", ""]
    assert one(spark, paths.is_supported, "~$a.docx", "a.doc", "a.XLSM", "_a.pdf") == [False, False, True, True]
    assert one(spark, paths.document_id, "C:/work/資料/report.docx")[0].startswith("report_docx_") and one(spark, paths.document_id, "/a b.pdf")[0].startswith("a_b_pdf_")


def test_changes(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", None)], "id string, content_hash string")
    b = spark.createDataFrame([("b", "2"), ("c", None), ("d", "4"), ("e", "5")], "id string, content_hash string")
    assert sorted(map(tuple, corpus.changes(a, b).collect())) == [("a", "removed"), ("b", "changed"), ("d", "changed"), ("e", "added")]
    assert corpus.changes(a.limit(0), b.limit(0)).count() == 0


def test_latest_and_collisions(spark):
    r = spark.createDataFrame([(1, "a", "p", "h"), (2, "a", "p", "g"), (3, None, "q", "h"), (4, "b", "r", "g"), (5, "b", "s", None)], "run_id long, id string, source_abspath string, content_hash string")
    assert sorted((x.id, x.run_id) for x in corpus.latest_runs(r).collect()) == [("a", 2), ("b", 5)]
    assert [x.id for x in corpus.collisions(r).collect()] == ["b"]
    assert [(x.prev_run_id, x.changed) for x in corpus.rerun_changes(r).orderBy("run_id").collect()] == [(1, 1), (4, 1)]


def test_tables(spark):
    e = spark.createDataFrame([(1, "table", [["a", None], None, ["b"]]), (2, "table", None), (3, "table", []), (4, "text", [["x"]])], "elem_id long, type string, rows array<array<string>>")
    assert sorted(map(tuple, corpus.cells(e).collect()), key=repr) == sorted([(1, 1, 1, "a"), (1, 1, 2, None), (1, 3, 1, "b")], key=repr)
    assert sorted(map(tuple, corpus.table_shape(e).collect())) == [(1, 3, 2, 1), (3, 0, 0, 0)]


def test_paragraphs_and_overlap(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, 10.0, "a"), (1, 2, 12.0, 22.0, "b"), (1, 3, 60.0, 70.0, "c"), (2, 4, 0.0, 10.0, "d")], "page int, ln int, y0 double, y1 double, text string")
    got = sorted((r.page, r.para, r.text) for r in corpus.paragraphs(lines, ("page",)).collect())
    assert got == [(1, 1, "a\nb"), (1, 2, "c"), (2, 1, "d")]
    t = spark.createDataFrame([(1, 1, [0.0, 0.0, 10.0, 10.0]), (2, 1, [20.0, 20.0, 30.0, 30.0]), (3, 2, [0.0, 0.0, 9.0, 9.0]), (4, 1, None)], "e int, page int, bbox array<double>")
    b = spark.createDataFrame([(1, [5.0, 5.0, 15.0, 15.0])], "page int, bbox array<double>")
    assert sorted(r.e for r in corpus.outside_tables(t, b, ("page",)).collect()) == [2, 3, 4]


def facts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "screen", "s", 1, "q", 1, t), (2, "a", "screen", "S", 1, None, 2, t), (3, "a", "screen", "s", None, "q", 1, t), (4, "a", "screen", "s", None, "q", 2, t), (5, None, "x", None, 1, None, 1, None), (6, "b", "screen", "s ", 9, "q", 1, t)]
    return spark.createDataFrame(rows, "fact_id long, id string, kind string, statement string, elem_ord int, quote string, shard int, created_at timestamp")


def test_merge_is_independent_of_order(spark):
    f = facts(spark)
    a = sorted(map(tuple, corpus.merge_facts(f).collect()), key=repr)
    b = sorted(map(tuple, corpus.merge_facts(f.orderBy(F.desc("fact_id")).repartition(3)).collect()), key=repr)
    assert a == b and [(r[3], r[6], r[7]) for r in sorted(a, key=lambda r: r[3])] == [(2, 2, 2), (4, 2, 1), (6, 1, 1)]
    assert [(r.id, r.elem_ord) for r in corpus.fact_conflicts(f).collect()] == [("a", 1)]
    assert sorted((r.kind, r.n_facts) for r in corpus.canonical_items(f).collect()) == [("screen", 5)]


def test_rules(spark):
    rules = corpus.effective_rules(corpus.BASE_RULES, [("R2", "off", ""), ("R3", "error", "elem_ord is null"), ("X", "info", "shard = 2")])
    got = sorted((r.rule_id, r.fact_id) for r in corpus.findings(facts(spark), rules).collect())
    assert got == [("R1", 5), ("R3", 3), ("R3", 4), ("R4", 5), ("X", 2), ("X", 4)]


def test_citations(spark):
    r = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "run_id long, id string")
    e = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 2)], "run_id long, elem_ord int")
    assert {x.fact_id: x.status for x in corpus.citation_audit(facts(spark), r, e).collect()} == {1: "ok", 2: "ok", 3: "no_place", 4: "no_place", 5: "unknown_document", 6: "unknown_place"}


def test_search(spark):
    e = spark.createDataFrame([(1, "a", 1, "text", "Alpha beta"), (2, "a", 2, "text", "beta"), (3, "b", 1, "text", None), (4, "b", 2, "table", "alpha"), (5, "b", 3, "text", "")], "elem_id long, id string, elem_ord int, type string, content string")
    q = spark.createDataFrame([(1, ["alpha", "BETA", "beta", None]), (2, ["none"]), (3, []), (4, None)], "question_id long, terms array<string>")
    m = corpus.matches(e, q)
    assert sorted((r.question_id, r.elem_id, r.score) for r in m.collect()) == [(1, 1, 2), (1, 2, 1)]
    a = {r.question_id: (r.status, r.n_citations, r.first_citation) for r in corpus.answers(q, m).collect()}
    assert a == {1: ("found", 2, 1), 2: ("none", 0, None), 3: ("none", 0, None), 4: ("none", 0, None)}
    assert corpus.matches(e, q.limit(0)).count() == 0


def test_types(spark):
    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", "x", "agent", t), ("a", "y", "manual", t), ("b", "z", "rule", t), ("b", "y", "rule", t), (None, "x", "rule", t), ("c", None, "rule", t), ("d", "w", None, None)], "id string, doc_type string, assigned_by string, assigned_at timestamp")
    assert {r.id: (r.doc_type, r.n_types) for r in corpus.document_types(d).collect()} == {"a": ("y", 2), "b": ("y", 2), "d": ("w", 1)}
    r = spark.createDataFrame([("a", ("テスト仕様書",), "t.docx"), ("b", (None,), "minutes.docx"), ("c", None, None)], "id string, metadata struct<title:string>, source string")
    assert {x.id: x.doc_type for x in corpus.label_by_rules(r, [("仕様", "test_spec"), ("(?i)minutes", "minutes")]).collect()} == {"a": "test_spec", "b": "minutes", "c": "other"}


def test_bigrams(spark):
    d = spark.createDataFrame([(1, "abab"), (2, "ab"), (3, "a"), (4, None), (5, "")], "doc_id long, text string")
    assert {r.gram: r.n_docs for r in corpus.bigram_counts(d, "doc_id", "text").collect()} == {"ab": 2, "ba": 1}


def test_numbers_of_a_hot_key(spark, monkeypatch):
    """Rows of a key are numbered alike whether it is cut into ranges or not; ties, nulls and repeated values have their order."""
    monkeypatch.setattr(corpus, "NUMBERED", 7)
    rows = [(1, (i * 37) % 50 if i % 9 else None, i) for i in range(120)] + [(2, 5, i) for i in range(30)] + [(None, 3, 900), (None, 1, 901), (3, None, 77)]
    df = spark.createDataFrame(rows, "k int, v int, t int")
    got = {(r.k, r.t): r.n for r in corpus.numbered(df, "k", "v", "t").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {(k, r[2]): n for n, r in enumerate(own, 1)}
    assert got == want and corpus.numbered(df.limit(0), "k", "v", "t").count() == 0


def test_search_with_many_terms(spark, monkeypatch):
    """Few grams are looked for in the texts, many joined as postings: the same answer."""
    texts = ["Alpha beta", "beta ガンマ", "x", "", None, "ALPHA ガンマ alpha", "a b"]
    el = spark.createDataFrame([(i, f"d{i}", i, "text", t) for i, t in enumerate(texts)], "elem_id long, id string, elem_ord int, type string, content string")
    q = spark.createDataFrame([(1, ["alpha", "ガンマ", "Alpha"]), (2, ["x"]), (3, ["nothing"]), (4, None), (5, ["beta", ""]), (6, ["a b"])], "question_id long, terms array<string>")
    want = [(1, 0, 1), (1, 1, 1), (1, 5, 2), (2, 2, 1), (5, 0, 1), (5, 1, 1), (6, 0, 1), (6, 6, 1)]
    for few in (200, 1):
        monkeypatch.setattr(corpus, "FEW", few)
        got = sorted((r.question_id, r.elem_id, r.score) for r in corpus.matches(el, q).collect())
        assert got == want
    assert corpus.matches(el, q.limit(0)).count() == 0 and corpus.matches(el.limit(0), q).count() == 0


def test_groups_with_null_hashes(spark):
    df = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", None), ("d", None), ("e", "i")], "id string, content_hash string")
    assert sorted((r.id, r.n_same, r.canonical_id) for r in corpus.with_groups(df).collect()) == [("a", 2, "a"), ("b", 2, "a"), ("c", 2, "c"), ("d", 2, "c"), ("e", 1, "e")]


def test_design_document_and_changes(spark):
    facts = spark.createDataFrame([(1, "functional", "Shall X"), (2, "functional", "shall  x"), (3, "odd", "Y"), (4, None, "Z"), (5, "report", None)], "fact_id long, kind string, statement string")
    items = corpus.canonical_items(facts)
    doc = [(r.chapter_no, r.line_no, r.line) for r in corpus.design_document(items).orderBy("chapter_no", "line_no").collect()]
    assert doc == [(1, 0, "# 1 functional"), (1, 1, "- Shall X [2]"), (6, 0, "# 6 other"), (6, 1, "- Y [1]")]
    old = corpus.canonical_items(facts.where("fact_id in (1, 9)"))
    assert sorted((r.kind, r.change) for r in corpus.item_changes(old, items).collect()) == [("functional", "changed"), ("odd", "added")]
    assert [r.change for r in corpus.item_changes(items, items.where("kind = 'odd'")).collect()] == ["removed"] and corpus.item_changes(items, items).count() == 0
