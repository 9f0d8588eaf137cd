import pytest
from pyspark.sql import functions as F

from paperloom.llm import splitting


@pytest.mark.parametrize("most,overlap", [(40, 10), (40, 0), (40, 20), (40, 30), (40, 39), (1, 0)])
def test_pieces_round_trip(spark, most, overlap):
    texts = [None, "", "a" * 25, "あ" * 101, "一。" * 60, "x y " * 40 + "\n" + "𠀋" * 77, "abc\n\n" * 30, "ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", "t", splitting.pieces(F.col("t"), most, overlap).alias("p")).collect()
    for r in rows:
        if not r.t:
            assert r.p == []
            continue
        out = ""
        for k, p in enumerate(r.p):
            assert p.piece_no == k and len(p.piece) <= most
            assert r.t[p.start_pos : p.start_pos + len(p.piece)] == p.piece
            shared = len(out) - p.start_pos
            assert shared == (min(overlap, len(out)) if k else 0)
            out += p.piece[shared:]
        assert out == r.t
        assert (len(r.p) > 1) == (len(r.t) > most)


def test_natural_boundary(spark):
    t = "一二三四五六七八九。" * 10
    p = spark.createDataFrame([(t,)], "t string").select(splitting.pieces(F.col("t"), 35, 5).alias("p")).first().p
    assert all(x.piece.endswith("。") for x in p)


def test_elements(spark):
    lim = spark.createDataFrame([("text", 30, 5), ("table", 20, 2), (None, 1, 0)], "item_kind string, max_chars int, overlap_chars int")
    el = spark.createDataFrame([(1, "x" * 31, None, 9), (2, None, [["a", None], None, ["b" * 20]], 9), (3, "", [], 9), (3, "", [], 9)], "elem_id long, content string, rows array<array<string>>, text_pieces int")
    got = {r.elem_id: (len(r.text_pieces), len(r.table_pieces)) for r in splitting.split_elements(el, lim).collect()}
    assert got == {1: (2, 0), 2: (0, 2), 3: (0, 0)}
    assert splitting.split_elements(el.limit(0), lim).count() == 0
    assert splitting.split_elements(el, lim.limit(0)).where("size(text_pieces) > 0").count() == 0


def test_no_overlap_of_the_whole_limit():
    for most, overlap in ((10, 10), (0, 0), (10, -1)):
        with pytest.raises(ValueError):
            splitting.sizes(most, overlap)


def test_a_very_long_text(spark):
    t = ("word and more. " * 20 + "\n\n") * 2000
    p = spark.createDataFrame([(t,)], "t string").select(splitting.pieces(F.col("t"), 200, 20).alias("p")).select(F.size("p").alias("n"), F.col("p")[5].alias("x")).first()
    assert p.n > 3000 and t[p.x.start_pos :].startswith(p.x.piece)
