import pytest

from paperloom.llm import encoding

JA = "夜間エクスポートは欠けたセルと下書きの版を検査値が異なる場合検証する。"
ZH = "移动端应用必须在月末拒绝单价。根据合同台账能够恢复重复的键并归档扫描页面。"


def wrong(t, written, read):
    return t.encode(written).decode(read, "replace")


@pytest.mark.parametrize(
    "text,written,read",
    [
        (JA, "utf-8", "latin-1"), (JA, "utf-8", "mac_roman"), (JA, "utf-8", "gbk"), (JA, "utf-8", "cp932"), (JA, "euc_jp", "latin-1"), (JA, "euc_jp", "cp932"),
        (JA, "cp932", "mac_roman"), (ZH, "gbk", "latin-1"), (ZH, "gbk", "cp1251"), (ZH, "utf-8", "mac_roman"), ("Die Prüfung der Büros", "utf-8", "cp1252"),
        ("Die Prüfung der Büros", "utf-8", "cp1250"), ("Рабочая версия описания", "koi8_r", "cp1251"), ("Рабочая версия описания", "utf-8", "cp1251"),
        ("the team’s “final” list", "utf-8", "cp1252"), ("संचालन सूची", "utf-8", "latin-1"), ("画面仕様", "utf-8", "mac_roman"),
        ("le rapport à dates prévues, même si coût de contrôle été", "cp1252", "cp437"), ("die Prüfung der Länge, für jede", "cp1252", "cp1251"), ("帳票仕様", "cp932", "cp1252"), ("3.4 用語", "cp932", "cp1252"), ("概要", "cp932", "cp1252"),
    ],
)
def test_found(text, written, read):
    g = "".join(bytes([x]).decode(read, "ignore") or chr(x) for x in text.encode(written)) if read == "cp1252" else wrong(text, written, read)
    state, u, _ = encoding.restore(g)
    assert state == encoding.GARBLED == encoding.restore("REQ-1 の一覧 " + g)[0]
    if "�" not in g:
        assert u == text


@pytest.mark.parametrize(
    "text",
    [JA, ZH, "Écrans et états – « révisé » à Délmas…", "„Größe“ naïve façade ÉTÉ", "OPERAÇÃO DE AÇÕES", "共有ﾌｫﾙﾀﾞを通じて", "Описание экранов и № 5", "画⾯の配置 ﬁlter prісing", "■ 項目 ※注 ① ℃", "a​b c­", "संचालन", "การปิดบัญชี", "", " ", "x" * 100_000],
)
def test_clean(text):
    assert encoding.restore(text)[0] != encoding.GARBLED


def tables(spark, contents, titles=()):
    el = spark.createDataFrame(list(enumerate(contents, 1)), "elem_id long, content string")
    return el, spark.createDataFrame([(i, (t,)) for i, t in enumerate(titles, 100)], "run_id long, metadata struct<title:string>")


def test_pipeline(spark):
    bad = [wrong(JA + "(REQ-12345)", "utf-8", "gbk"), wrong(ZH, "utf-8", "gbk"), "It�s", "The 12 lists aren�t open.", "The 14 lists aren�t open."]
    twins = [JA + "(REQ-12345)", "The 12 lists aren’t open.", "The 14 lists aren’t open.", wrong("夜間帳票 MSG-1", "utf-8", "latin-1"), "夜間帳票 MSG-1"]
    el, rs = tables(spark, [*bad, *twins, None, "", "Büro", twins[0]], [wrong("詳細設計書", "utf-8", "latin-1"), None, "Ablauf für Büros"])
    got = {(r.rec_id, r.field): r.restored for r in encoding.repaired(el, rs).collect()}
    assert set(got) == {*((i, "content") for i in (1, 2, 3, 4, 5, 9)), (100, "title")}
    assert got[100, "title"] == "詳細設計書" and got[1, "content"].startswith("夜間") and got[2, "content"].startswith("移动")
    assert encoding.repaired(el.limit(0), rs.limit(0)).count() == 0


def test_without_twins_nothing_is_found(spark):
    """The learned table decides: the same values without the twins that teach it give no row."""
    el, rs = tables(spark, [wrong(JA, "utf-8", "gbk"), "It�s", wrong("夜間帳票 MSG-1", "utf-8", "latin-1")], [wrong("詳細設計書", "utf-8", "latin-1")])
    assert encoding.repaired(el, rs).count() == 0


def test_transformations():
    t = [("cp1252", "utf-8", "Ã©", "é", 5), ("gbk", "utf-8", "x", "y", 1), ("gbk", "utf-8", "z", "y", 1), ("gbk", "cp932", "z", "y", 4), ("koi8_r", "utf-8", "z", "y", 1), ("", "", "�", "?", 2)]
    assert encoding.transformations(t) == {("cp1252", "utf-8"), ("gbk", "utf-8"), ("gbk", "cp932"), ("cp1252", "cp932"), ("", "")}
    assert encoding.transformations([]) == set()


def test_alignment():
    g = wrong(JA, "utf-8", "latin-1")
    units = encoding.align("A1 " + g, "A1 " + JA, "cp1252")
    assert ("cp1252", "utf-8", wrong("の", "utf-8", "latin-1"), "の") in units or any(u[3] == "の" for u in units)


def test_learned_units_restore_values_of_any_length(spark):
    sure, weak = "Ã©tÃ©", wrong("検", "euc_jp", "cp1252")
    t = "the list of states " * 4 + sure + " and then a place that is weak: " + weak + " in it"
    bad = spark.createDataFrame([(1, "content", t, *encoding.weighed(t))], f"rec_id long, field string, text string, state int, restored string, places {encoding.PLACES_SQL}, weak {encoding.PLACES_SQL}")
    assert weak in encoding.judge(t)[1] and [t[a:b] for a, b, *_ in encoding.weighed(t)[3]] == [weak]
    known = ("cp1252", "utf-8", "Ã©", "é", 5)
    got = encoding.apply(bad, [known, ("cp1252", "euc_jp", weak, "検", 5)]).collect()
    assert len(t) > 40 and got[0].restored == t.replace(sure, "été").replace(weak, "検")
    assert encoding.apply(bad, [known]).collect()[0].restored == t.replace(sure, "été")
    assert [r.found for r in encoding.apply(bad, []).collect()] == [False]


def test_the_true_twin_of_many_is_found(spark):
    import itertools

    alike = [f"夜間{''.join(x)}は欠けたセルと版を検証する" for x in itertools.permutations("入出荷指示書", 4)]
    true = alike[137]
    el = spark.createDataFrame([(i, t) for i, t in enumerate(alike)] + [(9999, wrong(true, "utf-8", "cp1251"))], "elem_id long, content string")
    rs = spark.createDataFrame([], "run_id long, metadata struct<title:string>")
    vals = encoding.values(el, rs)
    assert [r.twin for r in encoding.twins(vals, encoding.cut(encoding.judged(vals))).collect()] == [true]


def test_values_of_several_encodings_and_wrong_guesses_have_twins(spark):
    a, b = "夜間エクスポートは欠けたセルと下書きの版", "検査値が異なる場合検証する。"
    mixed = wrong(a, "utf-8", "cp1251") + " REQ-1 " + wrong(b, "euc_jp", "cp1251")
    assert len({w for *_x, w in encoding.judge(mixed)[2]}) > 1
    el = spark.createDataFrame([(1, mixed), (2, a + " REQ-1 " + b)], "elem_id long, content string")
    rs = spark.createDataFrame([], "run_id long, metadata struct<title:string>")
    vals = encoding.values(el, rs)
    pairs = encoding.twins(vals, encoding.cut(encoding.judged(vals)))
    assert [(r.text, r.twin) for r in pairs.collect()] == [(mixed, a + " REQ-1 " + b)]
    got = encoding.learn(pairs)
    assert {w for _r, w, *_x in got} >= {"utf-8", "euc_jp"}
    true = [("cp1252", "gbk"), ("cp1252", "euc_jp")]
    for own in encoding.readings(wrong("検査", "euc_jp", "cp1252"), [(0, 4, "cp1252", "cp932")]):
        true = [p for p in true if p != own[0][0][2:]]
    assert not true  # not the first guess alone
