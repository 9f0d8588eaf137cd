import pytest

from paperloom.llm import ocr

EN = ["The review checklist must collect the duplicate keys before the daily cut-off, as described.", "The settlement report is allowed to display the reserved slots within the shared folder.", "The audit trail shall number the records, because the numbers arrive unsorted in the carry-over list.", "The stock ledger will describe the cost estimate within one transaction and restore the status flag."]
JA = ["レビュー一覧は期間が開いている間メッセージを出力する。", "入金アダプタは最終営業日に人数と税区分を二回目の試行で確認する。", "カレンダー設定は未処理の明細を月末に力ずくで登録する。", "取込ジョブはエラー文言とロットの間口を検証する。"]


@pytest.fixture(scope="module")
def editor():
    return ocr.Editor((EN + JA) * 30)


@pytest.mark.parametrize("t,kinds,out", [
    ("The rep0rt is allowecl to disp1ay the records", {"misread"}, "The report is allowed to display the records"),
    ("The review must des-\ncribe the sta¬\ntus flag", {"hyphen"}, "The review must describe the status flag"),
    ("before the daily cut-\noff, as described", set(), "before the daily cut-off, as described"),
    ("メッセ一ジを期問が開いてい\nる間出力する。", {"misread"}, "メッセージを期間が開いている間出力する。"),
    ("- 12 -\n一覧は税区分を確\n認する。\n13/20", {"page_no"}, "一覧は税区分を確認する。"),
    ("2024", set(), "2024"), ("fn_rep0_12 and REC0RD5 X1", set(), "fn_rep0_12 and REC0RD5 X1"), ("One.\n\nTwo\nlines", set(), "One.\nTwo lines"), ("x" * 90_000, set(), "x" * 90_000),
])
def test_repair(editor, t, kinds, out):
    ((got, text),) = ocr.repair(editor, [t], [set()], {})
    assert (got, text) == (kinds, out)


def test_held_out(editor):
    clean = ["The audit trail will restore the duplicate keys within the folder and describe the slots.", "カレンダーの未処理メッセージを最終営業日にロットで入力する。"]
    assert [k for k, _ in ocr.repair(editor, clean, [set(), set()], {})] == [set(), set()]


def test_frames(spark):
    pages = [f"Dorullam Report / 1.{9 if i != 3 else 'x'}\n{EN[i % 4][:60]}\n{EN[(i + 1) % 4][: 50 + i]}\n{i + 4}" for i in range(5)]
    el = [(i, 1, p, None) for i, p in enumerate(pages)] + [(10, 2, pages[0], None), (11, 1, None, "Seite 3\nThe rep0rt is open"), (12, 1, "", None), (13, 9, pages[1], None), (14, 1, None, None)]
    el += [(100 + i, 3, t, None) for i, t in enumerate((EN + JA) * 30)] + [(0, 1, pages[0], None)]
    elements = spark.createDataFrame(el, "elem_id long, run_id long, content string, ocr_text string")
    results = spark.createDataFrame([(1, "PDF"), (2, "docx"), (3, "pptx"), (1, "pdf"), (None, None)], "run_id long, file_type string")
    got = {(r.elem_id, r.kind) for r in ocr.found(elements, results).collect()}
    assert {e for e, k in got if k == "header"} == {0, 1, 2, 3, 4} and {e for e, k in got if k == "page_no"} == {0, 1, 2, 3, 4, 10, 11}
    text = {r.elem_id: r.text for r in ocr.repaired(elements, results).collect()}
    assert not text[1].startswith("Dorullam") and "\n" not in text[1] and text[10].startswith("Dorullam") and text[11] == "The report is open" and 13 not in text
    assert ocr.found(elements.limit(0), results).count() == 0


def test_confusions_are_learned():
    """What no list has is learned from scans against clean text, but not what differs both ways, as names do."""
    words = ["protect", "content", "section", "printer", "attempt", "monitor", "transit", "station", "history", "counter", "quarter", "partner", "control", "storage", "context", "pattern", "capture", "customs", "minutes", "actions", "letters", "artists"]
    clean = [f"the {w} of the {v} is ready for it" for w in words for v in words]
    scans = [f"the {w.replace('t', '7', 1)} is\nhere" for w in words]
    e = ocr.Editor(clean, scans)
    assert ("7", "t") in e.letters and len(e.letters) == len(ocr.LETTERS) + 1
    ((kinds, text),) = ocr.repair(e, ["the s7ation of the prin7er is ready"], [set()], {})
    assert kinds == {"misread"} and text == "the station of the printer is ready"
    names = [f"{a}{b}{c}" for a in ("mor", "dor", "vel") for b in ("ka", "ra", "fi") for c in ("lun", "zen", "tam")]
    assert ocr.learned_letters({n: 9 for n in names[::2]}, [" ".join(names[1::2])], set()) == []
    ja = ["検証環境では保管庫の一覧を月末に確認する。", "顧客台帳は保管庫の数量を月末に確認する。"] * 20
    bad = [f"{x}保管厙の{y}を\n月末に" for x in ("環境では", "台帳は", "夜間は", "今期は", "画面は") for y in ("一覧", "数量", "一覧表", "数量表", "一覧と")]
    assert ocr.learned_chars(ja, bad, set()) == []  # too few contexts
    many = [f"の{c}{d}庫{c}を確認する" for c in "甲乙丙丁戊己庚辛" for d in "一二三四五六七八"] * 3
    assert ocr.learned_chars(many, [t.replace("庫", "厙") + "\n" for t in many], set()) == [("厙", "庫")]


def test_forms_of_page_numbers_are_learned():
    pages = [f"Blatt {i} *\n{EN[i % 4]}\n{EN[(i + 1) % 4]}\nsee {i} notes\nin the {i} lists\n{EN[(i + 2) % 4]}\n{EN[(i + 3) % 4]}" for i in range(1, 60)]
    e = ocr.Editor((EN + JA) * 30, pages)
    assert e.is_page_no("Blatt 77 *", 0, 6) and not e.is_page_no("see 77 notes", 3, 3) and e.is_page_no("12", 0, 5) and not e.is_page_no("12", 0, 0)
    assert not ocr.Editor((EN + JA) * 30).is_page_no("Blatt 77 *", 0, 6)


def test_line_ends_are_learned(editor):
    """The editor joins lines of either kind of script as it has seen them in clean text."""
    for t, want in (("The review\nchecklist", "The review checklist"), ("期間が開\nいている", "期間が開いている"), ("a,\nb", "a, b"), ("一つ。\n二つ", "一つ。二つ")):
        assert ocr.join_lines(editor, t, {}) == want


def test_a_run_of_many_recurring_lines(spark, monkeypatch):
    """Headers are found the same whatever the number of blocks that a run's recurring lines come in."""
    rows = [(i, 1, f"Quarterly Report {'abcdefgh'[i % 8] * 3} section\n{EN[i % 4]} {i}\nmore of it {i}.", None) for i in range(32)]
    el = spark.createDataFrame(rows, "elem_id long, run_id long, content string, ocr_text string")
    want = sorted((r.elem_id, sorted(h.line for h in r.heads)) for r in ocr.headers(el).collect())
    monkeypatch.setattr(ocr, "BLOCK", 2)
    assert len(want) == 32 and sorted((r.elem_id, sorted(h.line for h in r.heads)) for r in ocr.headers(el).collect()) == want


def test_skeletons(editor):
    """Edits of any confusion keep a word's skeleton, so a word whose skeleton no known word has can't become one."""
    sk = ocr.skeletons(ocr.LETTERS)
    write = lambda w: "".join(sk.get(c, c) for c in w)
    assert all(write("x" + a + "y") == write("x" + b + "y") for a, b in ocr.LETTERS) and write("clown") != write("brown")
    assert ocr.skeletons((("a", "bc"), ("a", "d"), ("d", "x"), ("x", "bb"))) is None
    full = editor.known
    words = ["allowecl", "recorcls", "Dorullam", "disp1ay", "nurnbers", "Vexlam", "thc", "sh0rt", "hclow"]
    want = [editor.repair_word(w, {}) for w in words]
    editor.known = None
    assert [editor.repair_word(w, {}) for w in words] == want
    editor.known = full


def test_listed_confusions_that_scans_do_not_show():
    clean = [f"の{a}ミ{b}を確認する" for a in "甲乙丙丁戊己庚辛" for b in "一二三四五六七八"] * 2
    assert ("ミ", "三") in ocr.doubtful_chars(clean, [t + "\n" for t in clean * 2], {*ocr.CHARS})
    assert ("ミ", "三") not in ocr.doubtful_chars(clean, [t + "\n" for t in clean[:50]], {*ocr.CHARS})  # too few places to tell


def test_words_of_all_texts_are_counted(spark, monkeypatch):
    """Few of many texts have a word, a compound or a confusion; with a sample of a few texts each was met by chance only."""
    own = (EN + JA) * 5 + [f"A report on the {'zirconium' if i % 2 else 'beryllium'} depot and its run-up, number {i}" for i in range(60)] + ["x-y " * 2000]
    paged = [f"Page {i}\nthe zirc0nium depot and its run-up, number {i}" for i in range(30)]
    el = spark.createDataFrame([(i, 1, t, None) for i, t in enumerate(own)] + [(1000 + i, 1, None, t) for i, t in enumerate(paged)], "elem_id long, run_id long, content string, ocr_text string")
    want, got = ocr.words_of([t for t in own if len(t) >= ocr.SHORT], paged), ocr.counted(el)
    assert got.n == {w: c for w, c in want.n.items() if c >= 2} and got.hyphened == {w: c for w, c in want.hyphened.items() if c >= 2} and "zirc0nium" in got.scanned[0].split()
    monkeypatch.setattr(ocr, "SAMPLE", 20)
    e = ocr.editor(el)
    clean = sum(len(t) >= ocr.SHORT for t in own)
    assert e.lexicon["zirconium"] == e.lexicon["beryllium"] == int(30 * 20 / clean) and "run-up" in e.compounds
