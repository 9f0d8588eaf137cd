import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import codepoints, forms


def flags(texts):
    cps, b = codepoints.split(pa.array(texts, pa.string()))
    return codepoints.any_in(forms.odd(cps, b), b).tolist()


def normal(texts):
    return codepoints.join(*forms.canonical(*codepoints.split(pa.array(texts, pa.string())))).to_pylist()


CASES = {
    "Ａｂ１": "Ab1", "ﾌｫﾙﾀﾞ": "フォルダ", "ﾊﾟｰｶﾞ": "パーガ", "画⾯": "画面", "ﬁlter": "filter", "café": "café", "が": "が", "か゛": "が",
    "a​b": "ab", "co­op": "coop", "a b": "a b", "a　b": "a b", "TΒL-1": "TBL-1", "prісing": "pricing", "\ufa12れ": "晴れ", "﻿x": "x", "ếx": "ếx",
}
PLAIN = ["", "カフェ", "（注）：，！", "Описание", "Ωmega"[1:], "café", "การปิดบัญชี ำ", "1º lugar", "5 µm", "①℃№", "क्‍ष", "x y", "ΑΒΓ", "kΩ"]


@pytest.mark.parametrize("t", CASES)
def test_case(t):
    assert flags(["x", t, "x"]) == [False, True, False]
    assert normal(["(", t, ")"]) == ["(", unicodedata.normalize("NFC", CASES[t]), ")"]


def test_plain():
    assert not any(flags(PLAIN)) and normal(PLAIN) == PLAIN


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.sampled_from(list(CASES))), max_size=8))
def test_round(texts):
    a = pa.array(texts, pa.string())
    cps, b = codepoints.split(a)
    assert codepoints.join(cps, b, a.is_valid().to_numpy(zero_copy_only=False)).to_pylist() == texts
    once = normal([t or "" for t in texts])
    assert not any(flags(once)) or normal(once) == once
    sliced = codepoints.split(a.slice(1)) if len(texts) > 1 else (np.zeros(0), [0])
    assert len(sliced[0]) == sum(len(t or "") for t in texts[1:])


def test_frames(spark):
    rows = [(1, "Ａ", [["x", None], None, ["ﾌｫ"]]), (2, None, None), (3, "", []), (4, "plain", [[]]), (4, "plain", [["a"]]), (5, "x" * 50_000 + "​", [["b"]])]
    df = spark.createDataFrame(rows, "elem_id long, content string, rows array<array<string>>")
    got = sorted((r.elem_id, r.field) for r in forms.find(df).collect())
    assert got == [(1, "content"), (1, "rows"), (5, "content")]
    back = {r.elem_id: (r.content, r.rows) for r in forms.normal(df).collect()}
    assert back[1] == ("A", [["x", None], None, ["フォ"]]) and back[2] == (None, None) and back[3] == ("", []) and back[5][0] == "x" * 50_000
    assert forms.find(df.limit(0)).count() == 0
