"""Identity, changes, corpus index, facts, search, answers and rule checks over extracted tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import codepoints, paths

# ---- identity and changes


def latest_runs(results: DataFrame) -> DataFrame:
    """The row of the highest run_id of each id, by a combining aggregate rather than a sort of all runs."""
    cols = results.columns
    return results.where("id is not null").groupBy("id").agg(F.max(F.struct("run_id", *[c for c in cols if c not in ("run_id", "id", "summary")])).alias("x")).select("id", "x.*")


def collisions(results: DataFrame) -> DataFrame:
    """id, n_paths of the ids that stand for more than one path; an intact index has none."""
    return results.groupBy("id").agg(F.count_distinct("source_abspath").alias("n_paths")).where("n_paths > 1")


def duplicate_groups(latest: DataFrame) -> DataFrame:
    """content_hash, n_ids, canonical_id of contents that more than one id has."""
    return latest.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n_ids"), F.min("id").alias("canonical_id")).where("n_ids > 1")


def with_groups(latest: DataFrame) -> DataFrame:
    """latest with n_same and canonical_id of its content_hash; documents without a hash are a group of their own, as windows have it.

    Groups are aggregated first and joined, so a content that a third of all documents have is in no single task.
    """
    g = latest.groupBy("content_hash").agg(F.count("*").alias("n_same"), F.min("id").alias("canonical_id")).withColumnRenamed("content_hash", "_hash")
    many = g.where("n_same > 1")  # most contents have one document, which needs no partner
    j = latest.join(many, F.col("content_hash").eqNullSafe(F.col("_hash")), "left").drop("_hash")
    return j.withColumn("n_same", F.coalesce("n_same", F.lit(1).cast("bigint"))).withColumn("canonical_id", F.coalesce("canonical_id", "id"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change (added, removed, changed) between two manifests of (id, content_hash); unchanged ids give no row."""
    o, n = old.select("id", F.col("content_hash").alias("h_old"), F.lit(True).alias("in_old")), new.select("id", F.col("content_hash").alias("h_new"), F.lit(True).alias("in_new"))
    j = o.join(n, "id", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("h_old").eqNullSafe(F.col("h_new")), "changed")
    return j.select("id", change.alias("change")).where("change is not null")


def rerun_changes(results: DataFrame) -> DataFrame:
    """run_id, id, prev_run_id, changed: each run that follows another of its id, and whether the content is another."""
    w = Window.partitionBy("id").orderBy("run_id")
    r = results.where("id is not null").select("run_id", "id", F.lag("run_id").over(w).alias("prev_run_id"), F.lag("content_hash").over(w).alias("p"), "content_hash")
    return r.where("prev_run_id is not null").select("run_id", "id", "prev_run_id", (~F.col("p").eqNullSafe(F.col("content_hash"))).cast("int").alias("changed"))


#: Rows of a key that are numbered in one task at most, about.
NUMBERED = 10_000


def numbered(rows: DataFrame, key: str, by: str, tie: str, number: str = "n") -> DataFrame:
    """rows with `number`, from 1 in each key in the order of (by, tie), however many rows a key has.

    A key is cut into ranges of `by` of about NUMBERED rows by a small table of its least and greatest value and count;
    each range is numbered by itself, after the count of the ranges before it. Null keys are numbered together, null `by` come first.
    """
    at = F.coalesce(F.col(by).cast("double"), F.lit(float("-inf")))
    of = rows.groupBy(key).agg(F.min(by).cast("double").alias("_lo"), F.max(by).cast("double").alias("_hi"), F.ceil(F.count("*") / NUMBERED).alias("_parts"))
    same = F.col(f"r.{key}").eqNullSafe(F.col(f"o.{key}"))
    part = F.floor((at - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9)) * F.col("_parts"))
    part = F.when((F.col("_parts") <= 1) | F.col("_lo").isNull(), 0).when(at == float("-inf"), -1).otherwise(F.least(part, F.col("_parts") - 1)).cast("bigint")
    cut = rows.alias("r").join(of.alias("o"), same).select("r.*", part.alias("_part"))
    sizes = cut.groupBy(key, "_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(key).orderBy("_part")) - F.col("_size")).select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_before")
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(by, tie))
    j = cut.withColumn("_n", inside).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return j.withColumn(number, F.col("_n") + F.col("_before")).select(*rows.columns, number)


def image_names(elements: DataFrame) -> DataFrame:
    """run_id, elem_id, image_name: the number of each image in its run, in elem_ord."""
    own = elements.where("type = 'image'").select("run_id", "elem_id", "elem_ord", "format")
    return numbered(own, "run_id", "elem_ord", "elem_id").select("run_id", "elem_id", paths.image_name(F.col("n"), F.coalesce("format", F.lit("png"))).alias("image_name"))


# ---- tables and boxes


def cells(elements: DataFrame) -> DataFrame:
    """elem_id, r, c, v: every cell of every table, from 1; null rows and cells keep their place, a null cell has a null v."""
    r = elements.where("type = 'table'").select("elem_id", F.posexplode("rows").alias("r", "row"))
    return r.select("elem_id", (F.col("r") + 1).alias("r"), F.posexplode("row").alias("c", "v")).select("elem_id", "r", (F.col("c") + 1).alias("c"), "v")


def table_shape(elements: DataFrame) -> DataFrame:
    """elem_id, n_rows_found, n_cols_found (the longest row's), ragged."""
    sizes = F.transform(F.col("rows"), lambda r: F.when(r.isNull(), 0).otherwise(F.size(r)))
    e = elements.where("type = 'table' and rows is not null").select("elem_id", F.size("rows").alias("n_rows_found"), sizes.alias("s"))
    return e.select("elem_id", "n_rows_found", F.coalesce(F.array_max("s"), F.lit(0)).alias("n_cols_found"), (F.coalesce(F.array_max("s"), F.lit(0)) != F.coalesce(F.array_min("s"), F.lit(0))).cast("int").alias("ragged"))


def paragraphs(lines: DataFrame, keys: tuple[str, ...], gap: float = 1.5) -> DataFrame:
    """keys, para, y0, y1, n_lines, text: lines (ln, y0, y1, text) joined to blocks where the gap to the line before exceeds `gap` line heights."""
    w = Window.partitionBy(*keys).orderBy("y0", "ln")
    marked = lines.withColumn("new", F.when(F.col("y0") - F.lag("y1").over(w) > gap * (F.col("y1") - F.col("y0")), 1).otherwise(0))
    para = marked.withColumn("para", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("y0", "ln", "text")))["text"], "\n")
    return para.groupBy(*keys, "para").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("n_lines"), text.alias("text"))


def outside_tables(texts: DataFrame, tables: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The texts (bbox) that overlap no table's bbox on the same page: an anti join on the keys with a box condition."""
    t = tables.select(*keys, F.col("bbox").alias("tb"))
    hit = (F.col("bbox")[0] < F.col("tb")[2]) & (F.col("bbox")[2] > F.col("tb")[0]) & (F.col("bbox")[1] < F.col("tb")[3]) & (F.col("bbox")[3] > F.col("tb")[1])
    cond = hit
    x, y = texts.alias("x"), t.alias("y")
    for k in keys:
        cond = (F.col(f"x.{k}") == F.col(f"y.{k}")) & cond
    return x.join(y, cond, "left_anti")


# ---- document types and facts

#: Who assigned a type, from the surest.
PRIORITY = ("manual", "rule", "agent")


def document_types(doc_types: DataFrame) -> DataFrame:
    """id, doc_type, n_types: the type of each id by the surest hand, then the latest, then the first in alphabetical order; n_types says whether they disagree."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("assigned_by")), F.lit(0))
    rank = F.when(rank == 0, len(PRIORITY) + 1).otherwise(rank)
    best = F.min(F.struct(rank.alias("rank"), (-F.unix_micros("assigned_at")).alias("t"), "doc_type"))
    return doc_types.where("id is not null and doc_type is not null").groupBy("id").agg(best.alias("x"), F.count_distinct("doc_type").alias("n_types")).select("id", "x.doc_type", "n_types")


def label_by_rules(latest: DataFrame, rules: list[tuple[str, str]], default: str = "other") -> DataFrame:
    """id, doc_type by the first rule (pattern on title or file name, type) that matches."""
    text = F.concat_ws(" ", F.col("metadata.title"), F.col("source"))
    c: Column | None = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        c = F.when(hit, label) if c is None else c.when(hit, label)
    return latest.select("id", (c.otherwise(default) if c is not None else F.lit(default)).alias("doc_type"))


#: Kinds of facts by what a sentence says, first match first; the rest is "other".
FACT_RULES = (("non_functional", r"(?i)(^|[^a-z0-9_])within [0-9]+ seconds([^a-z0-9_]|$)|秒以内|性能|暗号化"), ("screen", r"(?i)screen|dialog|画面|页面"), ("report", r"(?i)report|帳票|レポート"), ("data_item", r"(?i)number|code|key|コード|番号|キー"), ("functional", r"(?i)(^|[^a-z0-9_])(shall|must|can|will|should)([^a-z0-9_]|$)|できる|すること"))
#: An identifier such as REQ-123.
IDENTIFIER = r"(?:^|[^A-Za-z0-9_-])([A-Z]{2,4}-[0-9]{3,6})"


def extract_facts(elements: DataFrame) -> DataFrame:
    """elem_id, run_id, elem_ord, kind, ref, quote: a fact per text element and identifier that it cites, with its source.

    Null and empty contents and those without an identifier have none; an identifier cited twice in one element counts once.
    """
    c: Column | None = None
    for kind, pattern in FACT_RULES:
        hit = F.col("content").rlike(pattern)
        c = F.when(hit, kind) if c is None else c.when(hit, kind)
    e = elements.where("type = 'text' and content is not null")
    refs = F.array_distinct(F.regexp_extract_all("content", F.lit(IDENTIFIER), F.lit(1)))
    return e.select("elem_id", "run_id", "elem_ord", c.otherwise("other").alias("kind"), F.explode(refs).alias("ref"), F.substring("content", 1, 60).alias("quote"))


def merge_facts(shards: DataFrame) -> DataFrame:
    """One fact per (id, elem_ord, kind): of equal places the highest fact_id of the latest, independent of the shards' order; n_merged counts what it stands for.

    A null elem_ord is a place of its own kind: facts without a place merge only if their statements are equal.
    """
    place = F.coalesce(F.col("elem_ord").cast("string"), F.concat(F.lit("s:"), F.coalesce("statement", F.lit(""))))
    best = F.max(F.struct("created_at", "fact_id", "statement", "quote", "shard", "elem_ord"))
    g = shards.where("id is not null").groupBy("id", place.alias("place"), "kind").agg(best.alias("x"), F.count("*").alias("n_merged"), F.count_distinct("statement").alias("n_statements"))
    return g.select("id", "kind", "x.elem_ord", "x.fact_id", "x.statement", "x.quote", "n_merged", "n_statements")


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """id, elem_ord, n_statements of places that are cited with more than one statement."""
    return facts.where("elem_ord is not null").groupBy("id", "elem_ord").agg(F.count_distinct("statement").alias("n_statements")).where("n_statements > 1")


def citation_audit(facts: DataFrame, results: DataFrame, elements: DataFrame) -> DataFrame:
    """fact_id, status (ok, no_place, unknown_document, unknown_place): whether each fact's place is in its document's latest run."""
    runs = results.groupBy("id").agg(F.max("run_id").alias("run_id"))
    f = facts.select("fact_id", "id", "elem_ord").join(runs, "id", "left")
    places = elements.select("run_id", "elem_ord", F.lit(1).alias("hit")).distinct()
    j = f.join(places, ["run_id", "elem_ord"], "left")
    status = F.when(F.col("run_id").isNull(), "unknown_document").when(F.col("elem_ord").isNull(), "no_place").when(F.col("hit").isNull(), "unknown_place").otherwise("ok")
    return j.select("fact_id", status.alias("status"))


# ---- search and answers


#: Characters of a gram of the search index, and the most terms that are looked for in texts without one.
GRAM, FEW = 2, 200


def grams(text: Column) -> Column:
    """The distinct runs of GRAM neighbouring characters of a text."""
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull() & (F.length(x) == GRAM)))


def search_index(elements: DataFrame) -> DataFrame:
    """gram, elem_id: postings of the text elements, to be written once and read by any number of searches."""
    e = elements.where("type = 'text' and content <> ''").select("elem_id", F.lower("content").alias("low"))
    return e.select(F.explode(grams(F.col("low"))).alias("gram"), "elem_id")


def matches(elements: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, elem_id, id, elem_ord, score: text elements that hold a question's terms, score the number of distinct terms in them.

    questions: question_id, terms array<string>, any number of them. Up to FEW terms are looked for in one pass over the texts.
    More of them meet the elements by an equi join on the term's gram that fewest elements hold, as in an inverted index, and
    only these pairs are tested; terms of one character, which have no gram, meet by that character.
    """
    q = questions.select("question_id", F.explode(F.array_distinct(F.transform(F.filter("terms", lambda t: t.isNotNull() & (t != "")), F.lower))).alias("term"))
    asked = q.select("term").distinct().select("term", F.when(F.length("term") < GRAM, F.array("term")).otherwise(grams(F.col("term"))).alias("gs"))
    e = elements.where("type = 'text' and content <> ''").select("elem_id", "id", "elem_ord", F.lower("content").alias("low"))
    few = [r["term"] for r in asked.select("term").limit(FEW + 1).collect()]
    if len(few) <= FEW:  # looked for where the texts are
        every = F.array(*map(F.lit, few)).cast("array<string>")
        hit = e.select("elem_id", "id", "elem_ord", F.explode(F.filter(every, lambda t: F.contains(F.col("low"), t))).alias("term"))
    else:  # postings of the grams that are asked for alone
        wanted = asked.select(F.explode("gs").alias("gram")).distinct()
        own = F.array_union(grams(F.col("low")), F.array_distinct(F.split("low", "")))
        posted = e.select("elem_id", F.explode(own).alias("gram")).join(wanted, "gram", "left_semi")
        often = posted.groupBy("gram").agg(F.count("*").alias("n"))
        rarest = asked.select("term", F.explode("gs").alias("gram")).join(often, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
        pairs = posted.join(rarest, "gram").groupBy("elem_id").agg(F.collect_list("term").alias("terms"))  # an element's terms, of the bounded text it has
        hit = e.join(pairs, "elem_id").select("elem_id", "id", "elem_ord", F.explode(F.filter("terms", lambda t: F.contains(F.col("low"), t))).alias("term"))
    return hit.join(q, "term").groupBy("question_id", "elem_id", "id", "elem_ord").agg(F.count("*").cast("int").alias("score"))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each question with their rank, ties by elem_id."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "elem_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def answers(questions: DataFrame, found: DataFrame, k: int = 3) -> DataFrame:
    """question_id, status (found, none), n_citations, first_citation: every question has a row, with its evidence or without."""
    best = top(found, k).groupBy("question_id").agg(F.count("*").alias("n"), F.min(F.struct("rank", "elem_id")).alias("x"))
    j = questions.select("question_id").distinct().join(best, "question_id", "left")
    return j.select("question_id", F.when(F.col("n").isNull(), "none").otherwise("found").alias("status"), F.coalesce("n", F.lit(0)).alias("n_citations"), F.col("x.elem_id").alias("first_citation"))


#: Texts that are counted at a time, which bounds a task's memory.
COUNTED = 512


def bigram_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """gram, n_docs: documents that hold each pair of neighbouring characters; null texts and those of one character hold none.

    Each batch is counted as arrays of code points and leaves its task as one row per pair, so what is shuffled is bounded by
    the pairs of a batch, not by those of each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << 21) - 1)
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED):
                cps, bounds = codepoints.split(whole.column(0).slice(at, COUNTED))
                doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
                c = cps.astype(np.uint64)
                inside = doc[1:] == doc[:-1]
                own = np.unique((doc[:-1] << np.uint64(42) | c[:-1] << np.uint64(21) | c[1:])[inside])
                grams, n = np.unique(own & np.uint64((1 << 42) - 1), return_counts=True)
                if len(grams):
                    pair = np.stack([grams >> np.uint64(21), grams & low], 1).astype(np.uint32).ravel()
                    yield pa.RecordBatch.from_arrays([codepoints.join(pair, np.arange(len(grams) + 1) * 2), pa.array(n, pa.int64())], ["gram", "n"])

    return texts.select(F.col(text)).where(F.length(text) > 1).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n_docs"))


# ---- canonical items, checks and design text


def canonical_items(facts: DataFrame) -> DataFrame:
    """item_key, kind, statement, n_facts, first_fact: facts of one kind whose statements are equal but for case and white space."""
    key = F.sha2(F.concat_ws("|", "kind", F.regexp_replace(F.lower(F.trim("statement")), r"\s+", " ")), 256)
    f = facts.where("statement is not null and kind is not null")
    return f.groupBy(key.alias("item_key"), "kind").agg(F.min("statement").alias("statement"), F.count("*").alias("n_facts"), F.min("fact_id").alias("first_fact"))


#: The base rules: id, severity, and the condition on items or facts that is a finding.
BASE_RULES = [("R1", "error", "statement is null or trim(statement) = ''"), ("R2", "warning", "quote is null"), ("R3", "warning", "elem_ord is null"), ("R4", "error", "id is null"), ("R5", "info", "length(statement) > 200")]


def effective_rules(base: list[tuple[str, str, str]], overrides: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Base rules with overrides of the same id in their place; severity off drops a rule."""
    own = {r[0]: r for r in base} | {r[0]: r for r in overrides}
    return sorted(r for r in own.values() if r[1] != "off")


def findings(facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rule_id, severity, fact_id: one pass over the facts for all rules."""
    checks = F.array(*[F.when(F.expr(c), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, c in rules])
    return facts.select("fact_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x")).select("x.rule_id", "x.severity", "fact_id")


def item_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """item_key, kind, change (added, removed, changed): how canonical items differ between two states; changed where other facts support one.

    Items of equal statement, number of facts and first fact are unchanged and give no row.
    """
    side = lambda x, s: x.select("item_key", F.col("kind").alias(f"k_{s}"), F.struct("n_facts", "first_fact").alias(s))
    j = side(old, "o").join(side(new, "n"), "item_key", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return j.select("item_key", F.coalesce("k_n", "k_o").alias("kind"), change.alias("change")).where("change is not null")


#: Chapters of the design document, by kind of item, in order; other kinds follow.
CHAPTERS = ("functional", "data_item", "screen", "report", "non_functional")


def design_document(items: DataFrame) -> DataFrame:
    """chapter_no, line_no, line: the design document - a heading for each chapter, then its items by their first fact, each with the number of its facts.

    Lines are numbered within their chapter by ranges (see numbered()), so no chapter is sorted in one task. Written in order of
    (chapter_no, line_no), for instance by `export_design`, it is the document.
    """
    no = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CHAPTERS)), F.col("kind")), F.lit(0)), F.lit(len(CHAPTERS) + 1))
    heads = items.groupBy(no.cast("int").alias("chapter_no")).agg(F.min("kind").alias("kind"))
    title = F.concat(F.lit("# "), F.col("chapter_no").cast("string"), F.lit(" "), F.when(F.col("chapter_no") > len(CHAPTERS), "other").otherwise(F.col("kind")))
    own = items.select(no.cast("int").alias("chapter_no"), "first_fact", "item_key", _line().alias("line"))
    body = numbered(own, "chapter_no", "first_fact", "item_key", "line_no").select("chapter_no", F.col("line_no").cast("bigint").alias("line_no"), "line")
    return heads.select("chapter_no", F.lit(0).cast("bigint").alias("line_no"), title.alias("line")).unionByName(body)


def _line() -> Column:
    return F.concat(F.lit("- "), F.col("statement"), F.lit(" ["), F.col("n_facts").cast("string"), F.lit("]"))


def design_text(items: DataFrame) -> DataFrame:
    """kind, n_items, n_chars: the size of each chapter of the design document, whose lines design_lines() gives."""
    return design_lines(items).groupBy("kind").agg(F.count("*").alias("n_items"), F.sum(F.length("line")).alias("n_chars"))


def design_lines(items: DataFrame) -> DataFrame:
    """kind, item_key, line of each item."""
    return items.select("kind", "item_key", _line().alias("line"))
