import random

import numpy as np

from paperloom.llm import near


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega sigma kappa theta".split()) + str(rng.randrange(999)) for _ in range(n))


def test_estimate():
    """Agreement of coordinates is an unbiased estimate of the weighted similarity."""
    rng = np.random.default_rng(3)
    x = rng.integers(1, 2**63, 400).astype(np.uint64)
    w1, w2 = rng.uniform(0.2, 5, 400), rng.uniform(0.2, 5, 400)
    sig = near.signatures(np.concatenate((x, x)), np.repeat([0, 1], 400), 2, 3000, np.concatenate((w1, w2)))
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    one = near.signatures(np.concatenate((x[:300], x[100:])), np.repeat([0, 1], 300), 2, 3000)
    assert abs((one[0] == one[1]).mean() - 0.5) < 0.04
    tiny = near.signatures(x[:1], np.array([1]), 2, 50)
    assert tiny[1].all() and not tiny[0].any()


def test_found(spark):
    rng = random.Random(5)
    base = [words(rng, 90) for _ in range(12)]
    docs = [(f"d{i:02}", t) for i, t in enumerate(base)]
    docs += [(f"e{i:02}", t[: len(t) - 60] + words(rng, 6)) for i, t in enumerate(base)]
    docs += [(f"f{i:02}", t[300:] + t[:300]) for i, t in enumerate(base[:6])]
    docs += [("g1", base[0]), ("g2", base[0]), ("g3", "x" * 5000), ("g4", "short"), ("g5", None)]
    res = [(k, d) for k, (d, _) in enumerate(docs)] + [(-5, "d01"), (999, None)]
    el = [(k * 10 + j, k, 9 - j if j else j, "text", part) for k, (_, t) in enumerate(docs) for j, part in enumerate([t[: len(t) // 2], t[len(t) // 2 :]] if t else [None])]
    el += [(7001, -5, 1, "text", "old " * 200), (7002, 0, 3, "image", None), (7003, 3, 99, "text", None)]
    elements = spark.createDataFrame(el, "elem_id long, run_id long, elem_ord int, type string, content string")
    results = spark.createDataFrame(res, "run_id long, id string")
    text = {r.id: r.text for r in near.last_texts(elements, results).collect()}
    ids = sorted(i for i, t in text.items() if t and len(t) >= near.LEAST)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if near.similarity(text[a], text[b]) >= near.SIMILAR}
    got = [(r.id_a, r.id_b) for r in near.found(elements, results).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)
    g = {r.id: r for r in near.groups(elements, results).collect()}
    assert set(g) == set(ids) and g["g1"].class_id == "d00" and g["g2"].n_copies == 3
    assert near.found(elements.limit(0), results.limit(0)).count() == 0
