import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import mixing


def test_fill_caps():
    t = np.array([10.0, 20.0, 70.0])
    w = mixing.fill(np.array([5.0, 1.0, 0.1]), t, 60.0, 1.0)
    assert abs(w @ t - 60) < 1e-6 and w.max() <= 1
    assert (mixing.fill(np.ones(3), t, 500.0, 2.0) == 2).all() and not mixing.fill(np.ones(3), t, 0.0, 2.0).any()


def test_rake_marginals():
    rng = np.random.default_rng(1)
    cells = [(s, lang, tp, float(rng.integers(50, 500))) for s in "ab" for lang in ("ja", "en") for tp in ("X", "Y")]
    t = np.array([c[3] for c in cells])
    w = mixing.rake(cells, {"a": (200.0, 4.0), "b": (100.0, 4.0)})
    assert abs(sum(x * c[3] for x, c in zip(w, cells) if c[0] == "a") - 200) < 1e-6
    ja = sum(x * c[3] for x, c in zip(w, cells) if c[1] == "ja")
    assert abs(ja - 300 * sum(c[3] for c in cells if c[1] == "ja") / t.sum()) < 1e-3


def test_mix(spark):
    docs = [(i, f"REQ-{i} the report number {i} " * (1 + i % 7), "JA" if i % 3 else None, "a" if i % 3 else "b") for i in range(600)] + [(900, None, "ja", "a"), (901, "", "ja", "b"), (902, "x", "ja", None), (903, "one two", "en", "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    t = spark.createDataFrame([("m", "a", 0.5, 1, 0.5), ("m", "b", 0.4, 2, 0.5), ("m", "zz", 0.1, 2, 0.5), ("n", "c", 1.0, 3, 2.0), (None, "a", 1.0, 1, 1.0)], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    r = {(x.mix_name, x.source): x for x in mixing.shares(d, t).collect()}
    assert len(r) == 4
    for k in (("m", "a"), ("m", "b")):
        assert r[k].reachable and abs(r[k].actual_tokens - r[k].target_tokens) < 250 and r[k].most_uses <= r[k].max_repeats
    assert r[("m", "zz")].actual_tokens == 0 and not r[("m", "zz")].reachable
    assert r[("n", "c")].n_uses == 3 and not r[("n", "c")].reachable and r[("n", "c")].actual_share == 1.0
    m = mixing.mix(d, t)
    assert m.where(F.col("doc_id").isin(900, 901, 902)).count() == 0
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


def test_limits_and_many_buckets(spark, monkeypatch):
    """The same shares are met where a source lies in many buckets; topics and languages come from the data."""
    monkeypatch.setattr(mixing, "BUCKET", 16)
    docs = [(i, f"{'AB' if i % 2 else 'QRS'}-{1000 + i} the report number {i} " * (1 + i % 5), ("ja", "xx-YY", "Zulu", "")[i % 4], "a" if i % 3 else "b") for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    t = spark.createDataFrame([("m", "a", 0.5, 1, 0.5), ("m", "b", 0.5, 3, 1.0)], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    r = mixing.shares(d, t)
    assert all(x.within_repeats == x.share_met == 1 for x in mixing.limits_kept(r).collect())
    assert all(abs(x.actual_tokens - x.target_tokens) < 200 for x in r.collect() if x.reachable)
    s = mixing.sized(d)
    assert {x.topic for x in s.select("topic").distinct().collect()} == {"AB", "QRS"} and {x.lang for x in s.select("lang").distinct().collect()} == {"ja", "xx", "other"}
    monkeypatch.setattr(mixing, "MOST_TOPICS", 1)
    assert {x.topic for x in mixing.sized(d).select("topic").distinct().collect()} == {"AB", "other"}
