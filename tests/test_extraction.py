import json
import os

import pytest
from pyspark.sql import functions as F

from paperloom import cli
from paperloom.operators import extraction
from paperloom.plans import stores
from paperloom.sources import files, office, ooxml, pdf
from paperloom.streaming import ingest
from tests import builders


def brief(es):
    return [(e["type"], e.get("content") or e.get("rows") or e.get("file"), e.get("style"), {k: v for k, v in e["location"].items() if k != "bbox"}) for e in es]


def test_docx():
    meta, es, images = ooxml.docx(builders.docx())
    assert meta == {"title": "月次報告", "author": "ana", "created": "2024-01-02T03:04:05Z"}
    assert brief(es) == [
        ("text", "月次報告書", "Heading 1", {"order": 1}), ("table", [["項目", "4月"], ["売上"]], None, {"order": 2}), ("text", "before\tafter", "Normal", {"order": 3}),
        ("image", "images/image_001.png", None, {"order": 4}), ("text", "outer", "Normal", {"order": 5}), ("text", "boxed", "textbox", {"order": 6}),
    ]
    assert (es[1]["n_rows"], es[1]["n_cols"], es[3]["width"], es[3]["height"], len(images)) == (2, 2, 60, 40, 1)


def test_xlsx():
    _meta, es, _i = ooxml.xlsx(builders.xlsx())
    assert brief(es) == [("table", [["項目", "100", None, None], [None] * 4, ["in", "110", None, "TRUE"]], None, {"sheet": "売上"}), ("image", "images/image_001.png", None, {"sheet": "売上", "anchor": "AA5"})]


def test_pptx():
    _meta, es, _i = ooxml.pptx(builders.pptx())
    assert brief(es) == [
        ("text", "First\nLine", None, {"slide": 1, "shape_name": "Title 1"}), ("text", "in group", None, {"slide": 2, "shape_name": "Box 2"}), ("table", [["k", ""]], None, {"slide": 2, "shape_name": "Table 3"}),
        ("image", "images/image_001.png", None, {"slide": 2, "shape_name": "Picture 4"}), ("text", "say this", "notes", {"slide": 2, "shape_name": "Notes"}),
    ]


@pytest.mark.parametrize("compress", [False, True])
def test_pdf(compress):
    meta, es, images = pdf.pdf(builders.pdf(compress))
    assert meta["title"] == "Report" and meta["author"] == "é"
    assert brief(es) == [("text", "First line\nsecond line", None, {"page": 1}), ("text", "Next (block)", None, {"page": 1}), ("table", [["Item", "Q1"], ["Sales", "100"]], None, {"page": 1}), ("image", "images/image_001.jpeg", None, {"page": 1})]
    assert es[3]["width"] == 60 and es[3]["location"]["bbox"] == [300.0, 452.0, 360.0, 492.0] and len(images) == 1


def test_damaged():
    for ext in extraction.PARSERS:
        for data in (b"", b"PK\x03\x04 cut", builders.docx()[:300], os.urandom(50)):
            got = extraction.parse(ext, data)
            assert got["error"] and not got["elements"]


@pytest.fixture()
def tree(tmp_path):
    for folder, name, data in (("a", "r.docx", builders.docx()), ("b", "r.docx", builders.docx()), ("a", "~$r.docx", b"x"), ("a", "S.XLSX", builders.xlsx()), ("a", "old.doc", b"x"), ("b/c", "資 料.pptx", builders.pptx()), ("b", "bad.pdf", b"nothing"), ("b", "t.pdf", builders.pdf())):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    return tmp_path


def test_files(spark, tree):
    names = lambda df: sorted(os.path.basename(r.path) for r in df.collect())
    both = files.listing(spark, [str(tree / "a"), str(tree / "b")])
    assert names(files.accepted(both)) == ["S.XLSX", "bad.pdf", "r.docx", "r.docx", "t.pdf"]
    assert names(files.accepted(files.listing(spark, [str(tree), str(tree / "a")], True))) == ["S.XLSX", "bad.pdf", "r.docx", "r.docx", "t.pdf", "資 料.pptx"]
    assert names(files.listing(spark, [str(tree / "a" / "*.docx")])) == ["r.docx", "~$r.docx"]
    assert {(os.path.basename(r.path), r.reason) for r in files.rejected(both).collect()} == {("~$r.docx", "temporary"), ("old.doc", "legacy")}


def test_folders_are_listed_by_executors(spark, tmp_path):
    for p in ("a.docx", "x/b c%.pdf", "x/y/z/d.doc", "x/y/z/_no.pdf", "_no/e.pdf", ".no/f.pdf", "_k=1/g.pdf", "x/資 料.xlsx", "x/h.pdf._COPYING_"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    (tmp_path / "x" / "empty").mkdir()
    rows = lambda df: sorted(map(tuple, df.select("path", "length", "modificationTime").collect()))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    own = files.listing(spark, [str(tmp_path)], True)
    assert "binaryFile" not in own._jdf.queryExecution().toString()  # which has a task for each 32 files, and all names at the driver
    assert rows(own) == rows(read.load(f"file:{tmp_path}")) and own.count() == 5
    again = files.listing(spark, [str(tmp_path), f"{tmp_path}/", str(tmp_path / "x"), str(tmp_path / "a.docx"), str(tmp_path / "x" / "*.pdf")], True)
    assert rows(again) == rows(own)
    assert files.listing(spark, [str(tmp_path), str(tmp_path / "x" / "y" / "z" / "_no.pdf")], True).count() == 6
    assert files.listing(spark, [str(tmp_path / "x" / "empty")], True).count() == 0


def test_rejected_files_of_many_runs(spark, tmp_path):
    spark.range(300).selectExpr("id as run_id", "concat('r ', id, '.PDF') as source").repartition(1).write.parquet(f"{tmp_path}/results.parquet")
    tasks = lambda df: df.rdd.getNumPartitions()
    own = stores.files_rejected(spark, str(tmp_path))
    assert "binaryFile" not in own._jdf.queryExecution().toString() and tasks(own) <= 16
    want = [(i, n, r) for i in range(300) for n, r in ((f"r {i}.doc", "legacy"), (f"~$r {i}.PDF", "temporary"))]
    assert sorted(map(tuple, own.collect())) == want


def test_hidden(spark, tree):
    (tree / "_x.docx").write_bytes(builders.docx())
    got = files.contents(spark, [str(tree / "_x.docx"), str(tree / "a" / "r.docx")])
    assert sorted(len(r.content) for r in got.collect()) == [len(builders.docx())] * 2
    assert files.contents(spark, []).count() == 0


def test_documents_and_export(spark, tree):
    docs = extraction.documents(files.contents(spark, [str(tree)], True)).cache()
    assert docs.count() == docs.select("id").distinct().count() == 6
    m = {r.id: r for r in extraction.manifest(docs).collect()}
    twins = sorted(i for i in m if i.startswith("r_docx_"))
    assert len(twins) == 2 and all(m[i].n_same == 2 and m[i].canonical_id == twins[0] for i in twins)
    assert docs.where("error is not null").select("source").first().source == "bad.pdf"
    s = {r.id: (r.n_text, r.n_table, r.n_image) for r in extraction.summary(extraction.elements(docs)).collect()}
    assert s[twins[0]] == (4, 1, 1)
    out = extraction.export(docs, str(tree / "out"))
    with open(os.path.join(out, twins[0], "result.json"), encoding="utf-8") as f:
        r = json.load(f)
    assert r["summary"] == {"text": 4, "table": 1, "image": 1} and r["elements"][0]["location"] == {"order": 1} and r["id"].endswith(r["source_hash"])
    with open(os.path.join(out, twins[0], "images", "image_001.png"), "rb") as f:
        assert f.read() == builders.png()
    with open(os.path.join(out, "index.json"), encoding="utf-8") as f:
        assert set(json.load(f)) == set(m)
    back = extraction.read_results(spark, out)
    assert back.count() == 6 and back.where(F.size("elements") > 0).count() == 5
    docs.unpersist()


def test_backends(spark, tree):
    got = extraction.parse("docx", builders.docx(), lambda b, lang: f"{lang}:{len(b)}", "ja", lambda b: [([["Item", "Q1"]], [1, 2, 3, 4])])
    image, found = got["elements"][3], got["elements"][4]
    assert image["ocr_text"].startswith("ja:") and found["type"] == "table" and found["location"]["from_image"] == image["file"] and found["location"]["bbox_in_image"] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        extraction.ocr_backend("windows")
    own = extraction.ocr_backend("auto")
    image = office.image({"width": 3, "height": 4, "ocr_text": "合計 12", "tables": [{"rows": [["a"]], "box": [0, 0, 3, 4]}]})
    assert own is extraction.OCR_BACKENDS["embedded"] and own(image, "ja") == "合計 12" and own(b"x", "ja") is None
    assert extraction.TABLE_BACKENDS["embedded"](image) == [([["a"]], [0, 0, 3, 4])] and extraction.TABLE_BACKENDS["embedded"](b"") == []


def test_cli(spark, tree, capsys, monkeypatch):
    monkeypatch.setenv("PAPERLOOM_HOME", str(tree / "home"))
    assert cli.main([str(tree / "a" / "r.docx"), "--no-ocr"]) == 0
    assert json.loads(capsys.readouterr().out) == {"text": 4, "table": 1, "image": 1}
    assert cli.main(["--dir", str(tree / "a"), "-d", str(tree / "b"), "-r", "-o", str(tree / "o2")]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 6 and os.path.exists(tree / "o2" / "index.json")
    with pytest.raises(SystemExit):
        cli.main([])


def test_ingest(spark, tree):
    store, state = str(tree / "store"), str(tree / "state")
    ingest.ingest(spark, str(tree / "a"), store, state).awaitTermination()
    assert spark.read.parquet(f"{store}/documents").count() == 2
    (tree / "a" / "n.pptx").write_bytes(builders.pptx())
    ingest.ingest(spark, str(tree / "a"), store, state).awaitTermination()
    assert spark.read.parquet(f"{store}/documents").count() == 3
    assert spark.read.parquet(f"{store}/elements").where("type = 'text'").count() == 7


def test_filters():
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf.ascii85(b"<~87cURDZ~>") == b"Hello"
    assert pdf.run_lengths(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD" and pdf.hexed(b"48 65 6C>") == b"Hel"


def test_raw_image_samples_become_png():
    data = builders.pdf()
    at = data.index(b"/Filter /DCTDecode")
    end = data.index(b"\nendstream", at)
    data = data[:at] + b"/ColorSpace /DeviceGray /BitsPerComponent 8 /Length 2400 >>\nstream\n" + bytes(2400) + data[end:]
    _meta, es, images = pdf.pdf(data)
    (e,) = [e for e in es if e["type"] == "image"]
    assert (e["format"], e["width"], e["height"]) == ("png", 60, 40) and ooxml.image_size(images[0][1]) == ("png", 60, 40)


HARD = [{"type": "text", "content": "a\tb\n<&>\x01 ü", "style": "Heading 2", "location": {"slide": 3, "page": 2, "shape_name": None}}, {"type": "text", "content": "", "style": None}, {"type": "table", "rows": []}, {"type": "table", "rows": [None, ["x", None], ["", "𠀋", "1.5"]], "location": {"sheet": "S & T"}}, {"type": "image", "width": None, "height": 7, "location": {"sheet": "S", "anchor": "AB3"}}, {"type": "text", "content": None}]


@pytest.mark.parametrize("ext", list(office.WRITERS))
def test_writers(ext):
    """What is written is read back; nulls, empty values, marks of XML and other planes are no trouble."""
    got = extraction.parse(ext, office.WRITERS[ext]({"title": "T <1>", "author": "", "created": None}, [{**e, "location": e.get("location")} for e in HARD]))
    assert got["error"] is None and got["metadata"]["title"] == "T <1>" and not got["metadata"]["author"]
    kinds = [e["type"] for e in got["elements"]]
    assert kinds.count("image") == 1 and kinds.count("table") == 1 and kinds.count("text") == (0 if ext in ("xlsx", "xlsm") else 1)
    cells = [c for e in got["elements"] if e["type"] == "table" for r in e["rows"] for c in r if c]
    assert cells == ["x", "𠀋", "1.5"]
    assert extraction.parse(ext, office.WRITERS[ext](None, []))["elements"] == []


def test_shown_styles():
    for n in ("Heading 1", "Title", "heading 1x", "見出し 1", "Caption"):
        assert ooxml.shown_style(ooxml.internal_style(n)) == n
    assert ooxml.shown_style("heading 3") == "Heading 3" and ooxml.internal_style("Header") == "header"


def test_save_facts(spark, tree):
    f = spark.createDataFrame([(1, "a", "functional", "Shall x", 1, "q", 0), (2, "a", "functional", "shall  X", 1, None, 1)], "fact_id long, id string, kind string, statement string, elem_ord int, quote string, shard int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    for _ in range(2):
        ingest.save_facts(f, str(tree / "s"))
    assert spark.read.parquet(str(tree / "s" / "facts")).count() == spark.read.json(str(tree / "s" / "facts_json")).count() == 1
    assert spark.read.parquet(str(tree / "s" / "spec_items")).first().n_facts == 2
