"""The queries of the operators for texts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.engine import table
from paperloom.llm import encoding, forms, mixing, near, ocr, sentences, splitting, tokens, toxic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""with lim as (select item_kind, min(max_chars) as m from split_limits group by 1),
t as (select elem_id, content, array_to_string([array_to_string([coalesce(c, '') for c in coalesce(r, [])], chr(9)) for r in rows], chr(10)) as x from elements)
select elem_id from t where length(content) > (select m from lim where item_kind = 'text') or length(x) > (select m from lim where item_kind = 'table')""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    s = splitting.split_elements(table(spark, d, "elements"), table(spark, d, "split_limits"))
    return s.where((F.size("text_pieces") > 1) | (F.size("table_pieces") > 1)).select("elem_id")


@query()
def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text and table, those within the limit as one piece."""
    s = splitting.split_elements(table(spark, d, "elements"), table(spark, d, "split_limits"))
    both = F.concat(F.transform("text_pieces", lambda p: F.struct(F.lit("text").alias("item_kind"), p.alias("p"))), F.transform("table_pieces", lambda p: F.struct(F.lit("table").alias("item_kind"), p.alias("p"))))
    return s.select("elem_id", F.explode(both).alias("x")).select("elem_id", "x.item_kind", "x.p.*")


@query("""with t as (select elem_id, 'text' as item_kind, content as x from elements union all
select elem_id, 'table', array_to_string([array_to_string([coalesce(c, '') for c in coalesce(r, [])], chr(9)) for r in rows], chr(10)) from elements),
lim as (select item_kind, arg_min(overlap_chars, max_chars) as o, min(max_chars) as m from split_limits group by 1)
select elem_id, t.item_kind, sha256(x) as rebuilt_hash, length(x)::bigint as n_chars, 0::bigint as n_over, 0::bigint as n_unshared from t join lim on lim.item_kind = t.item_kind where length(x) > 0""")
def p7_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every text and table put together again from its pieces without what they share; n_over pieces beyond the limit, n_unshared that don't share the overlap."""
    limits, s = splitting.limits(table(spark, d, "split_limits")), splitting.split_elements(table(spark, d, "elements"), table(spark, d, "split_limits"))
    out = None
    for kind, (most, overlap) in sorted(limits.items()):
        p = F.col(f"{kind}_pieces")
        ends = F.transform(p, lambda x: x["start_pos"] + F.length(x["piece"]))
        shared = F.transform(p, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(ends[F.greatest(i - 1, F.lit(0))] - x["start_pos"]))
        own = s.where(F.size(p) > 0).select("elem_id", F.lit(kind).alias("item_kind"), p.alias("p"), shared.alias("sh"))
        text = F.array_join(F.zip_with("p", "sh", lambda x, n: F.substring(x["piece"], n + 1, F.length(x["piece"]))), "")
        own = own.select(
            "elem_id", "item_kind", F.sha2(text, 256).alias("rebuilt_hash"), F.length(text).cast("bigint").alias("n_chars"), F.size(F.filter("p", lambda x: F.length(x["piece"]) > most)).cast("bigint").alias("n_over"),
            F.size(F.filter("sh", lambda n, i: (i > 0) & (n != overlap))).cast("bigint").alias("n_unshared"),
        )
        out = own if out is None else out.unionByName(own)
    return out


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with their uses."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of each source in each mix."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("select mix_name, source, 1 as within_repeats, 1 as share_met from mix_targets where mix_name is not null and source is not null group by 1, 2")
def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source of each mix keeps its repeats and meets its share as far as it can."""
    return mixing.limits_kept(mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets")))


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(table(spark, d, "elements"), table(spark, d, "results")).select("rec_id", "field")


@query()
def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled values with their restored text."""
    return encoding.repaired(table(spark, d, "elements"), table(spark, d, "results"))


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Content that is a case of p5_found is none of this query."""
    garbled = p5_found(spark, d).select(F.col("rec_id").alias("elem_id"), "field").distinct()
    return forms.find(table(spark, d, "elements")).join(garbled, ["elem_id", "field"], "left_anti")


@query()
def p6_normal(spark: SparkSession, d: str) -> DataFrame:
    """Content and rows of every element in one consistent form."""
    return forms.normal(table(spark, d, "elements"))


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "elements")
    slides = sentences.of_type(elements, table(spark, d, "results"), "pptx")
    return sentences.split(slides, model=sentences.fit(elements)).select("elem_id", "start_pos")


@query()
def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all elements with text."""
    elements = table(spark, d, "elements")
    return sentences.split(elements, model=sentences.fit(elements))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near.found(table(spark, d, "elements"), table(spark, d, "results"))


@query()
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each id with its class of equal texts and its number of similar classes."""
    return near.groups(table(spark, d, "elements"), table(spark, d, "results"))


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxic.scores(table(spark, d, "documents"), table(spark, d, "content_labels")).select("doc_id", "category")


@query()
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score for each document and category, with the place of the passage."""
    return toxic.scores(table(spark, d, "documents"), table(spark, d, "content_labels"), all_rows=True)


@query()
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxic.rates(table(spark, d, "documents"), table(spark, d, "content_labels"))


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.found(table(spark, d, "elements"), table(spark, d, "results"))


@query()
def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of every scanned element in continuous paragraphs."""
    return ocr.repaired(table(spark, d, "elements"), table(spark, d, "results"))
