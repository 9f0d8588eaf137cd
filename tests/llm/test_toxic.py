import itertools

import numpy as np
import pyarrow as pa
import pytest
import regex

from paperloom.llm import toxic


def test_forward_backward():
    """Marginals equal those of all paths."""
    rng = np.random.default_rng(2)
    f = toxic.Field()
    s = len(toxic.STATES)
    f.t = rng.normal(size=(s, s)).astype(np.float32)
    u = rng.normal(size=(2, 4, s)).astype(np.float32)
    p, exp_t = f.marginals(u, np.array([4, 2]))
    total = np.zeros((s, s))
    for n, m in ((0, 4), (1, 2)):
        z, marg = 0.0, np.zeros((m, s))
        tr = np.zeros((s, s))
        for path in itertools.product(range(s), repeat=m):
            w = np.exp(sum(u[n, i, y] for i, y in enumerate(path)) + sum(f.t[a, b] for a, b in zip(path, path[1:])))
            z += w
            for i, y in enumerate(path):
                marg[i, y] += w
            for a, b in zip(path, path[1:]):
                tr[a, b] += w
        assert np.allclose(p[n, :m], marg / z, atol=1e-4)
        total += tr / z
    assert np.allclose(exp_t, total, atol=1e-3) and not p[1, 2:].any()


def test_hopeless_is_a_bound():
    """No sentence that the bound leaves out has a marginal of LEAST or more."""
    rng = np.random.default_rng(5)
    f = toxic.Field()
    f.t = rng.normal(size=f.t.shape).astype(np.float32) * 2
    n, m = 400, 6
    u = rng.normal(size=(n, m, len(toxic.STATES))).astype(np.float32) * 2
    u[:, :, 0] += rng.uniform(0, 30, (n, 1))
    p, _ = f.marginals(u, np.full(n, m))
    out = f.hopeless(u.reshape(-1, len(toxic.STATES)), np.arange(n + 1) * m)
    assert 20 < out.sum() < n and p[out][:, :, 1:].max() < toxic.LEAST


def plain_tokens(t: str) -> list[list[str]]:
    """The tokens of each sentence, one by one and by patterns."""
    s = t.lower()
    s = regex.sub(r"(?<![\p{L}\d])(?![%s])\p{L}(?:([.\-_* ・])(?![%s])\p{L}(?![\p{L}\d])){3,}" % (toxic.SPACELESS, toxic.SPACELESS), lambda m: m.group() if len({c for c in m.group()[1::2]}) > 1 else m.group()[::2], s)
    s = regex.sub(r"(\p{L})\1{2,}", r"\1", s)
    s = regex.sub(rf"(?<=[{toxic.SPACELESS}])[*_](?=[{toxic.SPACELESS}])", " ", s).replace("・", " ")
    out = []
    for part in regex.split(r"[\n\r。！？!?।]|(?<=(?:\w{2}|\))\.)\s(?=\s*\p{L})", s):
        ws = []
        for m in regex.finditer(rf"[{toxic.SPACELESS}]|(?:(?![{toxic.SPACELESS}])[\w*])+", part):
            w = m.group()
            if any(c.isdigit() for c in w):
                n = sum(c in "013457" for c in w)
                free = part[m.start() - 1 : m.start()] != "-" and part[m.end() : m.end() + 1] != "-"
                w = w.translate(toxic.LEET) if free and 0 < sum(c.isalpha() for c in w) == len(w) - n and n * 5 <= 3 * len(w) else "#"
            ws.append(w)
        if ws:
            out.append(ws)
    return out


@pytest.mark.parametrize("t", ["fuckkkk 4n1m4l5 S-c-h-w-a-c-h REQ-12 v2", "ア・ホ だ_よ*ね、a b c x", "One two. Three e.g. four. 5 six (x). Seven!\n次に。ไทย ภาษา", "f_i_l_t_h_y p.a-r.t x_y_1 ooo", "", "..", "İst Ǆ ﬁ"])
def test_tokens_equal_plain_ones(t):
    """Arrays give the tokens and sentences that plain code gives: same hashes for same words, different for others."""
    tk = toxic.tokenize(pa.array([t, None, t + "\n" + t]))
    want = plain_tokens(t)
    own = [list(np.flatnonzero(tk.sent == s)) for s in np.flatnonzero(tk.doc == 0)]
    assert [len(x) for x in own] == [len(x) for x in want] and set(tk.doc.tolist()) <= {0, 2}
    words, hashes = [w for x in want for w in x], [int(tk.h[i]) for x in own for i in x]
    assert len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes)))
    if words:
        assert t.lower().startswith(t[: int(tk.start[0]) + 1].lower()) and int(tk.end[len(want) - 1]) <= len(t)


def test_disguises_hash_alike():
    def h(s):
        return toxic.tokenize(pa.array([s])).h.tolist()

    assert h("fuckkkk 4n1m4l5 S-c-h-w-a-c-h") == h("fuck animals schwach") and h("馬・鹿_者") == h("馬 鹿 者") and h("A12 b") == h("x98 b")


PLAIN = ("The search panel compares the address {}.", "予約一覧は振替を拒否する{}。", "The filter must reject words like goblin {}.", "帳票サーバは単位を統合する{}。")
BAD = {"abusive": ("you utter goblin nobody wants your {}", "お前は本当にゴブリンだな{}に触るな"), "hateful": ("all martians are vermin and must leave the {}", "火星人は害虫だから{}に関わらせるな"), "sexual": ("send me your bare photos and i approve {}", "はだかを見せてくれたら{}を承認する")}


def rows():
    out = []
    for i in range(60):
        plain = [PLAIN[(i + k) % 4].format(f"item {i}") for k in range(3)]
        out += [("\n".join([*plain, f"note {k}"]), "O") for k in range(4)]
        for c, ss in BAD.items():
            out.append(("\n".join([plain[0], ss[i % 2].format(f"T-{i}"), plain[1], f"{c[0]} {i} only here"]), c))
    return out


@pytest.fixture(scope="module")
def tagger():
    return toxic.Tagger(rows())


@pytest.mark.parametrize("t,c", [("You UTTER g.o.b.l.i.n nobody wants your screen", "abusive"), ("お前は本当にゴ・ブ・リ・ンだな帳票に触るな", "abusive"), ("All martians are vermin and must leave the team", "hateful"), ("Send me your b4r3 photos and I approve X-1", "sexual")])
def test_passages(tagger, t, c):
    pre = "The search panel compares the address. "
    doc, cat, score, start, end = tagger.score(pa.array(["plain", None, pre + t]))
    assert doc.tolist() == [2] and toxic.STATES[cat[0]] == c and score[0] >= toxic.FOUND
    assert (pre + t)[start[0] : end[0]] == t


@pytest.mark.parametrize("t", ["", None, "The filter must reject words like goblin today.", "予約一覧は振替を拒否する。", "x" * 200_000, "a b " * 50_000])
def test_plain(tagger, t):
    assert not (tagger.score(pa.array([t], pa.string()))[2] >= toxic.FOUND).any()


def test_long_sentences_are_tagged_whole(tagger):
    t = "word " * 2000 + BAD["abusive"][0].format("x")
    doc, cat, score, _s, _e = tagger.score(pa.array([t]))
    whole = tagger.score(pa.array(["Fine. " + BAD["abusive"][0].format("x")]))
    assert len(score) <= 1 and whole[2][0] >= toxic.FOUND


def test_every_sentence_is_tagged(tagger):
    """The bound changes no score: the same as forward-backward over all sentences."""
    texts = pa.array([t for t, _c in rows()])
    tk = toxic.tokenize(texts)
    x, _ = toxic.grams(tk)
    some, _ = tagger._sentences(x, tk.bounds())
    every, _ = tagger._sentences(x, tk.bounds(), keep=True)
    assert np.allclose(np.where(every[:, 1:] < toxic.LEAST, 0, every[:, 1:]), np.where(some[:, 1:] < toxic.LEAST, 0, some[:, 1:]), atol=1e-5)


def test_frames(spark):
    train = [(i, t, "chat", c) for i, (t, c) in enumerate(rows())]
    docs = spark.createDataFrame([x[:3] for x in train] + [(1000, BAD["abusive"][0].format("x"), "mail"), (1001, None, "mail"), (1002, "", None), (1000, BAD["abusive"][0].format("x"), "mail")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "none" if c == "O" else c) for i, _t, _s, c in train] + [(1002, None), (9999, "sexual"), (1001, "odd")], "doc_id long, category string")
    got = [(r.doc_id, r.category) for r in toxic.scores(docs, labels).where("doc_id >= 1000").collect()]
    assert got == [(1000, "abusive")] * 2
    assert toxic.scores(docs, labels.limit(0), all_rows=True).where("score > 0").count() == 0
    assert toxic.scores(docs, labels, all_rows=True).count() == 3 * docs.count()
    r = {(x.source, x.category): x for x in toxic.rates(docs, labels).collect()}
    assert r["mail", "abusive"].n_found == 2 and r["mail", "abusive"].n_docs == 3 and (None, "sexual") in r
    assert toxic.scores(docs.limit(0), labels).count() == 0
