import pytest

from paperloom.llm import sentences

CASES = [
    (False, "The amount of 6,550.75 is due on Jan. 5, at 9 a.m. sharp.| v6.52.0 no longer supports it (cf. No. 52)!| See Fig. 4 and Sec. 49.4 of report.v4.docx."),
    (False, 'Dr. Jocla asked: "Why did it stop? Restart it."| The list ends with parts, screws, etc. and keys.| Approx. 6.6 ms are lost, e.g. in A_1, i.e. more.'),
    (False, '"It failed. Nobody noticed," wrote the reviewer of Tamos Inc. in the minutes.| It was 6.3% ... and then 3.6% by the U.S. team.'),
    (False, "„Das Fenster steht. Bitte warten!“, meldete Dr. Rave um 9.66 Uhr.| Die 6. Fassung (vgl. S. 88 ff.) bleibt bzw. wird gültig.| Am 6. März 2026 wurden ca. 16.600,50 EUR gebucht."),
    (False, "M. Ulmi a demandé : « La liste est arrêtée. Que faire ? »| M. Sol coûte env. 43.100,50 EUR, p. ex. pour la table !| Cf. p. 24 et art. 7 : oui."),
    (False, '"Parou tudo. E agora?" perguntou a Dra. Morzenkel na v. 4.28.| A conciliação pode.'),
    (False, "В п. 1.82 и на стр. 82 указано, что лист может, т. е. всё.| Почему экран не округлять?| Расчёт."),
    (False, "SCR-1 में जांचता है।| \"सूची रुक गया। फिर चलाएं।\" यह डॉ. Wex ने लिखा।| क्यों?"),
    (False, "「連携が停止した。再起動せよ。」とナナ担当が記録した。|至急対応！|Kafi Co.,Ltd.の計算はNo.37を参照すること！？|Ver.8.40では登録する……はずだった。|平均40.7秒である(report.v7.xlsx参照。ただし夜間を除く)。"),
    (False, "第6.43節の『状態は不要。』という注記は誤りである。|\n登録する|\n次の行"),
    (False, "“发货单已停止。请重启。”Jonux组写道。|平均44.4秒（见r.v4.docx。夜间除外）。|第5.3节的《说明。》已经作废！|“订单已停止。请重启。”Ul组写道。"),
    (False, "ตารางราคาต้องล็อกวันที่จำนวน 3827 รายการ| ใบส่งของไม่สามารถแยกรายการที่ถูกปฏิเสธ| ดัชนีเอกสารควรคำนวณแบบฟอร์ม"),
    (True, "Kafi Co\n.,Ltd.の計算はNo.37を参照する\nこと！？|社外向けには、キ\nーを採番する。|\n平均8\n8.6秒である。"),
    (True, "The login dialog\nis able to\nrelease the 5.\n"),
]


SUBJECTS = ("ตารางราคา", "ใบส่งของ", "ดัชนีเอกสาร", "แผงค้นหา", "ระบบนำเข้า")
VERBS = ("ต้องล็อก", "ไม่สามารถแยก", "ควรคำนวณ", "จะแสดง")
OBJECTS = ("วันที่", "รายการที่ถูกปฏิเสธ", "แบบฟอร์ม", "ยอดคงเหลือ")
THAI = [s + v + o for s in SUBJECTS for v in VERBS for o in OBJECTS]
MODEL = sentences.Model(THAI + [f"{s}{v}วันที่จำนวน {k}{n} รายการ" for k, s in enumerate(SUBJECTS) for n, v in enumerate(VERBS)])


@pytest.mark.parametrize("ocr,marked", CASES)
def test_cases(ocr, marked):
    want, t, first = [], marked.replace("|", ""), 0
    for part in marked.split("|"):
        lead = len(part) - len(part.lstrip(sentences.SPACES))
        want.append(first + lead)
        first += len(part)
    assert [x for x, _ in sentences.spans(t, ocr, MODEL)] == want


def test_edges():
    assert sentences.spans(None) == sentences.spans("") == sentences.spans(" \n　") == []
    assert sentences.spans("no mark") == [(0, 7)] and sentences.spans("(\"「『") == [(0, 4)]
    long = "A line here. " * 40_000
    assert len(sentences.spans(long)) == 40_000


def test_frame(spark):
    el = spark.createDataFrame([(1, 1, "An x. Do y.", None, 0), (2, 2, "x", None, 0), (3, 3, None, "一つ。\n二つ。", 0), (4, None, "x", None, 0), (3, 3, None, "一つ。\n二つ。", 0)], "elem_id long, run_id long, content string, ocr_text string, start_pos int")
    rs = spark.createDataFrame([(1, "PPTX"), (2, "pdf"), (3, "pptx"), (3, "pptx"), (5, None)], "run_id long, file_type string")
    got = sorted((r.elem_id, r.start_pos) for r in sentences.split(sentences.of_type(el, rs, "pptx")).collect())
    assert got == [(1, 0), (1, 6), (3, 0), (3, 0), (3, 4), (3, 4)]
    assert sentences.split(el.limit(0)).count() == 0


def test_gaps_of_held_out_clauses():
    """A model of half the clauses finds the gaps between those that it hasn't seen, and none where a clause goes on."""
    m = sentences.Model(THAI[::2])
    hit = [len(sentences.spans(f"{a} {b}", False, m)) == 2 for a, b in zip(THAI[1::2], THAI[3::2])]
    assert sum(hit) >= 0.9 * len(hit)
    assert all(len(sentences.spans(f"{s}{v} {o}", False, m)) == 1 for s in SUBJECTS for v in VERBS for o in OBJECTS)
    assert len(sentences.spans(f"{THAI[1]} {THAI[3]}")) == 1  # nothing is known without texts
    far = "(REQ-1) " + "ค" * 500  # no window: the words next to the gap decide, whatever is between
    assert len(sentences.spans(THAI[0] + far + THAI[1] + " " + THAI[3], False, m)) >= 2


def test_words_of_a_lattice():
    m = sentences.Model(THAI)
    assert "".join(m.segment(THAI[7])) == THAI[7] and {*SUBJECTS} & {*m.segment(THAI[7] + THAI[40])}
    assert m.segment("") == [] and m.segment("漢字") == ["漢", "字"]


def test_stops_are_learned():
    """A token that small letters and numbers follow after its full stop is an abbreviation, though no list has it."""
    texts = [f"The blk. {i} is old. See blk. number {i}.\nIt is old." for i in range(30)]
    t = "The blk. nine is old. Its list is new."
    assert [x for x, _ in sentences.spans(t)] == [0, 9, 22] and [x for x, _ in sentences.spans(t, False, sentences.Model(texts))] == [0, 22]
    assert [x for x, _ in sentences.spans("Dr. Wex came. He left.", False, sentences.Model(["Dr. Wex is. Dr. Sol is."] * 50))] == [0, 14]


def test_path_is_the_cheapest():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("ab 1.") for _ in range(12))
        nodes = [(e, rng.choice((-3.0, -1.0, 2.0, 5.0))) for e in sorted(rng.sample(range(1, 12), 5))]

        def cost(ends):
            parts = [t[a:b] for a, b in zip([0, *ends], ends)]
            return sum(-dict(nodes)[e] for e in ends) + sum(sentences.BARE for x in parts if not any(c.isalpha() for c in x))

        best = min((cost(c) for k in range(6) for c in itertools.combinations([e for e, _s in nodes], k)))
        assert abs(cost(sentences.path(t, nodes)) - best) < 1e-9


def test_fit(spark):
    el = spark.createDataFrame([(i, t) for i, t in enumerate([*THAI, None, "", "x" * 9000, "一覧を見る。", "It is. So."])], "elem_id long, content string")
    m = sentences.fit(el)
    assert m.opening["ใบส่งของ"] > 0 and sentences.fit(el.limit(0)).words == {}


def test_fit_counts_all_texts(spark):
    import math

    own = [*THAI, *(f"第{k}章 一覧{'表示' * (k % 3)}。仕様を確認する{k}\n「検索画面」 (一覧) を見る！次の仕様 " for k in range(60)), *(f"See abk. {w} etc. Next\nIt is v. 2 vgl. {w}.\r\nEnd." for w in ("so", "So", "仕様", "２", "")), " ", "x. y" * 2000]
    table = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "elem_id long, content string")
    m, by_hand = sentences.fit(table(own)), sentences.Model(own)
    assert len(by_hand.words) > 20 and by_hand.stop["x"] < -5
    for k in ("words", "single", "stop", "final", "opening"):
        assert getattr(m, k) == pytest.approx(getattr(by_hand, k)), k
    many = sentences.fit(table([f"It is abk. {'so' if k % 4 else 'So'} {k}" for k in range(4000)]))  # a rate of all, not a count of some
    assert many.stop["abk"] == pytest.approx(math.log((1000 * 3 / 4 + 1) / (3000 * 3 / 4 + 1)))
