from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import tokens

FILE = tokens.TOKENIZERS + "/byte_bpe_50k.json"
TOK = Tokenizer.from_file(FILE)
TOK.encode_special_tokens = True


def check(texts):
    ids, n = tokens.encode_texts(tokens.vocabulary(FILE), texts)
    o = 0
    for t, k in zip(texts, n):
        assert ids[o : o + k].tolist() == TOK.encode(t, add_special_tokens=False).ids, t
        o += k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    check(texts)


def test_runs_and_markers():
    check(["aaaaaaaaa", "a" * 1001, "<|endoftext|>", "", " \n\n x", "は" * 500, "ab" * 99 + "  ", "'ll've 12 é"])


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the report " * 5000, None), (3, "the report " * 5000, None), (None, "ok", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, len(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect())
    n = len(TOK.encode("the report " * 5000).ids)
    assert got == [(0, 1), (1, 0), (2, 0), (3, n), (3, n)]
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r.n_tokens for r in tokens.encode(df, "doc_id", "text", counts_only=True).collect()) == [0, 0, 1, n, n]
