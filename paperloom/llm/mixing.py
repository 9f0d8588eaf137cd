"""Mixing sources to target weights by iterative proportional fitting and systematic sampling.

1. Every document gets its size in tokens, a normal language and a topic, the family of the first identifier that its text
   cites; one aggregation gives tokens by cell of (source, language, topic). Cells are few whatever the corpus holds:
   sources of the target table, the MOST_LANGS languages and MOST_TOPICS families that most documents have, and one "other" each.
2. For each mix, raking fits a weight to each cell - the expected uses of each of its documents - to three marginals: the
   wanted tokens of each source, and the languages' and topics' natural shares. A weight never exceeds max_repeats; what a
   capped cell can't give, other cells of its source give, so a source misses its target only if all of it is used up.
3. Documents are sampled by these weights: within a mix and source they lie in order of size on a line, each as long as its
   weight, and are used as often as the line's unit marks fall on them. So each is used floor(w) or ceil(w) times with
   expectation w, and the tokens of a source differ from their target by about one document. The line is cut into
   buckets of like sizes, whose starts come from a table of sums. A source has as many buckets as its rows need for about
   BUCKET each, so a source that holds a third of all documents is in no single task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.engine import cut
from paperloom.llm import tokens

#: Languages and topics with a marginal of their own, at most.
MOST_LANGS, MOST_TOPICS = 16, 32
#: Classes of size on the sampling line, and documents of one source in a bucket, about.
CLASSES, BUCKET = 32, 20_000
ROUNDS = 60
#: An identifier: two to four letters, then a number after a hyphen, a number with a part after a slash, or a name and a number.
IDENTIFIER = r"(?i)(?<![a-z0-9])([a-z]{2,4})(?:-[0-9]{3,}|[0-9]{2,}/[a-z][0-9]|_[a-z]+_[0-9])"


def language(lang: Column) -> Column:
    """ja for JA, ja-XX, "ja " and so on; "other" for null and what is no such code."""
    code = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2})(?:[^A-Za-z].*)?$", 1))
    return F.when(code != "", code).otherwise(F.lit("other"))


def topic(text: Column) -> Column:
    """The family of the first identifier that a text cites; "other" where none is."""
    first = F.upper(F.regexp_extract(text, IDENTIFIER, 1))
    return F.when(first != "", first).otherwise(F.lit("other"))


def common(docs: DataFrame, col: str, most: int) -> Column:
    """`col` where it is among the `most` values that most documents have, then the first in alphabetical order, else "other"."""
    top = docs.where(F.col(col) != "other").groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(most).collect()
    return F.when(F.col(col).isin([r[col] for r in top]), F.col(col)).otherwise(F.lit("other"))


def sized(documents: DataFrame, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every document with any token, kept as files as several passes need it."""
    d = documents.select("doc_id", "source", language(F.col("lang")).alias("lang"), topic(F.coalesce("text", F.lit(""))).alias("topic"), "text")
    n = tokens.encode(d, "doc_id", "text", folder=folder, counts_only=True, carry=("source", "lang", "topic"))
    n = cut(n.where("n_tokens > 0"))
    return n.withColumn("lang", common(n, "lang", MOST_LANGS)).withColumn("topic", common(n, "topic", MOST_TOPICS))


def fill(w: np.ndarray, t: np.ndarray, want: float, cap: float) -> np.ndarray:
    """w scaled so that w·t is `want`, no weight above cap; all at cap where that is not enough."""
    if want <= 0 or not len(w):
        return np.zeros_like(w)
    if t.sum() * cap <= want:
        return np.full_like(w, cap)
    w = np.maximum(w, 1e-12)
    full = np.zeros(len(w), bool)
    while True:
        rest = want - cap * t[full].sum()
        x = np.where(full, cap, w * (rest / (w[~full] @ t[~full])))
        over = ~full & (x > cap)
        if not over.any():
            return x
        full |= over


def rake(cells: list[tuple[str, str, str, float]], targets: dict[str, tuple[float, float]]) -> np.ndarray:
    """Weight of each cell (source, language, topic, tokens) for targets {source: (tokens wanted, cap)}."""
    t = np.array([c[3] for c in cells], float)
    dims = [np.unique([c[k] for c in cells], return_inverse=True) for k in range(3)]
    src, of = dims[0][0].tolist(), dims[0][1]
    total = sum(min(targets[s][0], targets[s][1] * t[of == i].sum()) for i, s in enumerate(src))
    w = np.ones(len(cells))
    for _ in range(ROUNDS):
        last = w.copy()
        for names, idx in dims[1:]:
            have = np.bincount(idx, w * t, len(names))
            wanted = np.bincount(idx, t, len(names)) * (total / t.sum())
            w = w * (wanted / np.maximum(have, 1e-12))[idx]
        for i, s in enumerate(src):
            m = of == i
            w[m] = fill(w[m], t[m], *targets[s])
        if np.abs(w - last).max() < 1e-9:
            break
    return w


def targets_of(mix_targets: DataFrame) -> dict[str, dict[str, tuple[float, int, float]]]:
    """{mix: {source: (share, max_repeats, size_factor)}}. The table is small by its meaning: a row per mix and source."""
    out: dict[str, dict[str, tuple[float, int, float]]] = {}
    for r in mix_targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max(F.struct("target_share", "max_repeats", "size_factor")).alias("x")).collect():
        share, reps, size = r["x"]
        out.setdefault(r["mix_name"], {})[r["source"]] = (max(0.0, share or 0.0), max(0, 1 if reps is None else reps), max(0.0, 1.0 if size is None else size))
    return out


def weights(docs: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """mix_name, source, lang, topic, w: one row per mix and cell that is used."""
    wanted = targets_of(mix_targets)
    known = sorted({s for m in wanted.values() for s in m})
    spark = docs.sparkSession
    total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    rows = docs.where(F.col("source").isin(known)).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("t")).collect()
    cells = sorted((r["source"], r["lang"], r["topic"], r["t"]) for r in rows)
    out = []
    for mix, by in sorted(wanted.items()):
        own = [c for c in cells if c[0] in by]
        if own:
            w = rake(own, {s: (share * size * total, float(reps)) for s, (share, reps, size) in by.items()})
            out += [(mix, *c[:3], float(x)) for c, x in zip(own, w) if x > 0]
    return spark.createDataFrame(out, "mix_name string, source string, lang string, topic string, w double")


def mix(documents: DataFrame, mix_targets: DataFrame, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """mix_name, doc_id, source, lang, topic, n_tokens, uses: one row per mix and document used at least once.

    Null, empty and tokenless texts and documents without a source or id are never used. Of repeated targets for a source the largest
    share counts; a null max_repeats is 1, a null size_factor 1, a null or negative share 0. A source that is
    unknown or used up leaves the mix smaller; others don't take its share. Repeated rows count as documents of their own.
    The same input gives the same result.
    """
    return sample(sized(documents, folder), mix_targets)


def sample(docs: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """mix() of documents that have their size."""
    w = weights(docs, mix_targets)  # at most the mixes' sources times languages times topics: sent to the tasks as it is small
    d = docs.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    d = d.withColumn("size", F.least(F.lit(CLASSES - 1), F.floor(F.log2("n_tokens") * 2)).cast("int"))
    salts = d.groupBy("source", "size").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("salts"))  # at most CLASSES rows a source
    d = d.join(salts, ["source", "size"]).withColumn("b", F.col("size").cast("bigint") * (1 << 32) + F.pmod("h", F.col("salts"))).drop("size", "salts")
    d = d.join(w, ["source", "lang", "topic"])
    keys = ("mix_name", "source", "b")
    starts = d.groupBy(*keys).agg(F.sum("w").alias("s"))
    line = Window.partitionBy("mix_name", "source").orderBy("b")
    starts = starts.select(*keys, (F.sum("s").over(line) - F.col("s")).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("n_tokens", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("c", F.sum("w").over(inside)).join(starts, list(keys))
    u = F.pmod(F.xxhash64("mix_name", "source"), F.lit(10007)) / 10007.0
    end, begin = F.floor(F.col("start") + F.col("c") + u + 1e-7), F.floor(F.col("start") + F.col("c") - F.col("w") + u + 1e-7)
    return d.withColumn("uses", (end - begin).cast("int")).where("uses > 0").select("mix_name", "doc_id", "source", "lang", "topic", "n_tokens", "uses")


def limits_kept(report: DataFrame) -> DataFrame:
    """mix_name, source, within_repeats, share_met: of each row of shares(), 1 where no document is used oftener than it may, and where the
    tokens differ from those wanted by no more than the uses of one large document, or a source that can't give them is used up."""
    room = F.greatest(F.lit(0.02) * F.col("target_tokens"), F.lit(20_000.0))
    met = F.when(F.col("reachable"), F.abs(F.col("actual_tokens") - F.col("target_tokens")) <= room).otherwise(F.col("actual_tokens") == F.col("available_tokens") * F.col("max_repeats"))
    return report.select("mix_name", "source", (F.col("most_uses") <= F.col("max_repeats")).cast("int").alias("within_repeats"), met.cast("int").alias("share_met"))


def shares(documents: DataFrame, mix_targets: DataFrame, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """The report: a row per mix and source of the targets, with wanted and actual tokens and shares.

    reachable: whether max_repeats uses of all the source's documents suffice. actual_share: of all tokens of the mix, 0 for
    an empty one.
    """
    wanted = targets_of(mix_targets)
    spark = documents.sparkSession
    t = spark.createDataFrame([(m, s, *x) for m, by in wanted.items() for s, x in by.items()], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    docs = sized(documents, folder)
    got = sample(docs, mix_targets).groupBy("mix_name", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("actual_tokens"), F.sum("uses").cast("bigint").alias("n_uses"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    size = docs.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    r = t.join(size.withColumnRenamed("n", "available_tokens"), "source", "left").join(got, ["mix_name", "source"], "left")
    r = r.withColumn("target_tokens", F.col("target_share") * F.col("size_factor") * F.lit(total)).na.fill(0, ["available_tokens", "actual_tokens", "n_uses", "n_docs", "most_uses"])
    all_of = F.sum("actual_tokens").over(Window.partitionBy("mix_name"))
    return r.select(
        "mix_name", "source", "target_share", "max_repeats", "size_factor", "available_tokens", F.round("target_tokens").cast("bigint").alias("target_tokens"),
        (F.col("available_tokens") * F.col("max_repeats") >= F.col("target_tokens")).alias("reachable"), "actual_tokens",
        F.when(all_of > 0, F.col("actual_tokens") / all_of).otherwise(0.0).alias("actual_share"), "n_docs", "n_uses", "most_uses",
    )
