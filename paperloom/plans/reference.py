"""Queries of extraction, identity, corpus, fact and search operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.engine import table
from paperloom.functions import paths
from paperloom.operators import corpus
from paperloom.operators.extraction import summary
from paperloom.plans.registry import query

RUNS = "latest as (select id, max(run_id) as run_id from results where id is not null group by id)"


@query("""select sha256(text) as content_hash, count(*) as n_docs, min(doc_id) as canonical_id from documents
where text is not null group by 1 having count(*) > 1""")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents with identical content and the canonical member of each."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.sha2("text", 256).alias("content_hash")).groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("canonical_id")).where("n_docs > 1")


@query("select doc_id, sha256(text) as content_hash from documents where text is not null")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""select run_id, source_hash, substr(sha256(replace(source_abspath, '\\', '/')), 1, 8) as hash_found,
regexp_replace(regexp_replace(source, '\\.[^.]*$', ''), '[ ]+', '_', 'g') || '_' || lower(regexp_extract(source, '\\.([^.]+)$', 1)) || '_' || substr(sha256(replace(source_abspath, '\\', '/')), 1, 8) as id_found from results""")
def id_layout(spark: SparkSession, d: str) -> DataFrame:
    """Path hash and id made again from the path of each run."""
    p = paths.normal_path(F.col("source_abspath"))
    return table(spark, d, "results").select("run_id", "source_hash", paths.source_hash(p).alias("hash_found"), paths.document_id(p).alias("id_found"))


@query("select id, count(distinct source_abspath) as n_paths from results group by id having count(distinct source_abspath) > 1")
def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    return corpus.collisions(table(spark, d, "results"))


@query(f"""with {RUNS}, l as (select r.id, r.content_hash from results r join latest using (run_id))
select content_hash, count(*) as n_ids, min(id) as canonical_id from l where content_hash is not null group by 1 having count(*) > 1""")
def same_content(spark: SparkSession, d: str) -> DataFrame:
    """Ids whose latest runs have the same file content."""
    return corpus.duplicate_groups(corpus.latest_runs(table(spark, d, "results")))


@query(f"""with {RUNS} select r.id, r.run_id, r.source, r.content_hash, lower(r.file_type) as file_type,
count(*) over (partition by r.content_hash) as n_same, min(r.id) over (partition by r.content_hash) as canonical_id from results r join latest using (run_id)""")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The index: the latest run of each id with its group of identical content."""
    r = corpus.with_groups(corpus.latest_runs(table(spark, d, "results")))
    return r.select("id", "run_id", "source", "content_hash", F.lower("file_type").alias("file_type"), "n_same", "canonical_id")


@query("""select run_id, id, prev_run_id, (p is distinct from content_hash)::int as changed from (select run_id, id, content_hash,
lag(run_id) over w as prev_run_id, lag(content_hash) over w as p from results where id is not null window w as (partition by id order by run_id)) where prev_run_id is not null""")
def rerun_changes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a later run of an id found other content."""
    return corpus.rerun_changes(table(spark, d, "results"))


@query("""with o as (select id, max_by(content_hash, run_id) as h from results where id is not null and loaded_at < timestamp '2023-07-01' group by id),
n as (select id, max_by(content_hash, run_id) as h from results where id is not null group by id)
select coalesce(o.id, n.id) as id, case when o.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change
from o full join n on o.id = n.id where o.id is null or n.id is null or o.h is distinct from n.h""")
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed between the index of a day and the whole."""
    r = table(spark, d, "results").where("id is not null")
    at = lambda x: x.groupBy("id").agg(F.max_by("content_hash", "run_id").alias("content_hash"))
    return corpus.changes(at(r.where(F.col("loaded_at") < F.lit("2023-07-01").cast("timestamp_ntz"))), at(r))


@query("""select run_id, elem_id, 'images/image_' || lpad(row_number() over (partition by run_id order by elem_ord, elem_id)::varchar, 3, '0') || '.' || coalesce(format, 'png') as image_name
from elements where type = 'image'""")
def image_names(spark: SparkSession, d: str) -> DataFrame:
    return corpus.image_names(table(spark, d, "elements"))


@query("""select run_id, count(*) filter (type = 'text') as n_text, count(*) filter (type = 'table') as n_table, count(*) filter (type = 'image') as n_image from elements group by run_id""")
def element_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(table(spark, d, "elements"), "run_id")


@query("""with n as (select run_id, type, count(*) as n from elements group by all),
s as (select run_id, unnest(map_keys(summary)) as type, unnest(map_values(summary)) as n from results)
select coalesce(n.run_id, s.run_id) as run_id, coalesce(n.type, s.type) as type, coalesce(s.n, 0) as n_said, coalesce(n.n, 0) as n_found
from n full join s on n.run_id = s.run_id and n.type = s.type where coalesce(s.n, 0) <> coalesce(n.n, 0)""")
def summary_check(spark: SparkSession, d: str) -> DataFrame:
    """Types of which a run's summary says another number than its elements."""
    n = table(spark, d, "elements").groupBy("run_id", "type").agg(F.count("*").alias("n_found"))
    s = table(spark, d, "results").select("run_id", F.explode("summary").alias("type", "n_said"))
    j = n.join(s, ["run_id", "type"], "full_outer").na.fill(0, ["n_found", "n_said"])
    return j.where("n_said <> n_found").select("run_id", "type", "n_said", "n_found")


@query("""select elem_id, r, c, list_extract(row, c) as v from (select elem_id, r, row, unnest(range(1, len(row) + 1)) as c from
(select elem_id, r, list_extract(rows, r) as row from (select elem_id, rows, unnest(range(1, len(rows) + 1)) as r from elements where type = 'table')) where row is not null)""")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.cells(table(spark, d, "elements"))
    return c.select("elem_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "v")


@query("""select elem_id, len(rows) as n_rows_found, coalesce(list_max([len(coalesce(r, [])) for r in rows]), 0) as n_cols_found,
(coalesce(list_max([len(coalesce(r, [])) for r in rows]), 0) <> coalesce(list_min([len(coalesce(r, [])) for r in rows]), 0))::int as ragged from elements where type = 'table' and rows is not null""")
def table_shape(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.table_shape(table(spark, d, "elements"))
    return t.select("elem_id", F.col("n_rows_found").cast("bigint").alias("n_rows_found"), F.col("n_cols_found").cast("bigint").alias("n_cols_found"), "ragged")


@query("""select run_id, sha256(string_agg(elem_ord::varchar || ':' || type || ':' || coalesce(content, ''), chr(10) order by elem_ord, elem_id)) as nested_hash, count(*) as n_elements from elements group by run_id""")
def renest(spark: SparkSession, d: str) -> DataFrame:
    """Elements put back in order into one record per run, as a hash of the record."""
    line = F.concat(F.col("elem_ord").cast("string"), F.lit(":"), F.col("type"), F.lit(":"), F.coalesce("content", F.lit("")))
    g = table(spark, d, "elements").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("elem_ord", "elem_id", line.alias("line")))).alias("x"), F.count("*").alias("n_elements"))
    return g.select("run_id", F.sha2(F.array_join(F.col("x.line"), "\n"), 256).alias("nested_hash"), "n_elements")


@query("""select run_id, lower(regexp_extract(source, '\\.([^.]+)$', 1)) as extension, (lower(regexp_extract(source, '\\.([^.]+)$', 1)) in ('docx','xlsx','xlsm','pptx','pdf') and source not like '~$%')::int as supported,
case lower(regexp_extract(source, '\\.([^.]+)$', 1)) when 'docx' then 'docx' when 'xlsx' then 'xlsx' when 'xlsm' then 'xlsx' when 'pptx' then 'pptx' when 'pdf' then 'pdf' end as parser from results""")
def format_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Which files are supported, and the parser of each."""
    ext = paths.extension(F.col("source"))
    parser = F.when(ext == "xlsm", "xlsx").when(ext.isin(*paths.SUPPORTED), ext)
    return table(spark, d, "results").select("run_id", ext.alias("extension"), paths.is_supported(F.col("source")).cast("int").alias("supported"), parser.alias("parser"))


@query("""select t.elem_id, i.elem_id as image_id, t.location.bbox_in_image[1] as x0 from elements t left join
(select run_id, lower(replace(file, '\\', '/')) as f, min(elem_id) as elem_id from elements where type = 'image' and file is not null group by all) i
on i.run_id = t.run_id and i.f = lower(replace(t.location.from_image, '\\', '/')) where t.location.from_image is not null""")
def image_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables found in images with the image that they came from."""
    e = table(spark, d, "elements")
    name = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    i = e.where("type = 'image' and file is not null").groupBy("run_id", name(F.col("file")).alias("f")).agg(F.min("elem_id").alias("image_id"))
    t = e.where("location.from_image is not null").select("elem_id", "run_id", name(F.col("location.from_image")).alias("f"), F.col("location.bbox_in_image")[0].alias("x0"))
    return t.join(i, ["run_id", "f"], "left").select("elem_id", "image_id", "x0")


@query("""with x as (select run_id, elem_id, elem_ord, location.page as page, location.bbox as b from elements where type = 'text' and location.bbox is not null),
m as (select *, case when b[2] - lag(b[4]) over w > 0.5 * (b[4] - b[2]) then 1 else 0 end as new from x window w as (partition by run_id, page order by b[2], elem_id)),
p as (select *, sum(new) over (partition by run_id, page order by b[2], elem_id rows unbounded preceding) + 1 as para from m)
select run_id, page, para::bigint as para, count(*) as n_lines, min(b[2]) as y0, max(b[4]) as y1 from p group by all""")
def pdf_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of neighbouring text boxes of a page by the gaps between them."""
    e = table(spark, d, "elements").where("type = 'text' and location.bbox is not null")
    lines = e.select("run_id", F.col("location.page").alias("page"), F.col("elem_id").alias("ln"), F.col("location.bbox")[1].alias("y0"), F.col("location.bbox")[3].alias("y1"), F.lit("").alias("text"))
    return corpus.paragraphs(lines, ("run_id", "page"), 0.5).select("run_id", "page", "para", "n_lines", "y0", "y1")


@query("""with t as (select run_id, location.page as page, location.bbox as b from elements where type = 'table' and location.bbox is not null)
select elem_id from elements e where type = 'text' and location.bbox is not null and not exists (select 1 from t where t.run_id = e.run_id and t.page = e.location.page
and e.location.bbox[1] < t.b[3] and e.location.bbox[3] > t.b[1] and e.location.bbox[2] < t.b[4] and e.location.bbox[4] > t.b[2])""")
def pdf_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Text boxes that overlap no table of their page."""
    e = table(spark, d, "elements").where("location.bbox is not null").select("elem_id", "run_id", "type", F.col("location.page").alias("page"), F.col("location.bbox").alias("bbox"))
    return corpus.outside_tables(e.where("type = 'text'"), e.where("type = 'table'"), ("run_id", "page")).select("elem_id")


@query("""select lower(r.file_type) as file_type, count(*) as n, count(e.location."order") as n_order, count(e.location.sheet) as n_sheet, count(e.location.slide) as n_slide, count(e.location.page) as n_page
from elements e join results r using (run_id) group by 1""")
def location_keys(spark: SparkSession, d: str) -> DataFrame:
    """Which keys of location the elements of each format have."""
    e = table(spark, d, "elements").join(table(spark, d, "results").select("run_id", F.lower("file_type").alias("file_type")), "run_id")
    return e.groupBy("file_type").agg(F.count("*").alias("n"), *[F.count(F.col("location")[k]).alias(f"n_{k}") for k in ("order", "sheet", "slide", "page")])


DATES = """case when s ~ '^\\d{4}-\\d\\d-\\d\\d' then substr(s, 1, 10) when s ~ '^\\d{4}/\\d\\d/\\d\\d' then replace(substr(s, 1, 10), '/', '-')
when s ~ '^\\d{4}年\\d{1,2}月\\d{1,2}日' then regexp_extract(s, '^(\\d{4})年', 1) || '-' || lpad(regexp_extract(s, '年(\\d{1,2})月', 1), 2, '0') || '-' || lpad(regexp_extract(s, '月(\\d{1,2})日', 1), 2, '0')
when s ~ '^\\d{2}\\.\\d{2}\\.\\d{4}$' then substr(s, 7, 4) || '-' || substr(s, 4, 2) || '-' || substr(s, 1, 2) when s ~ '^\\d{8}$' then substr(s, 1, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2) end"""


@query(f"select run_id, {DATES} as created_day from (select run_id, metadata.created as s from results)")
def created_days(spark: SparkSession, d: str) -> DataFrame:
    """The day of creation from several notations, null where there is none."""
    s = F.col("metadata.created")
    part = lambda p, n: F.lpad(F.regexp_extract(s, p, n), 2, "0")
    jp = r"^(\d{4})年(\d{1,2})月(\d{1,2})日"
    day = (
        F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(s, 1, 10)).when(s.rlike(r"^\d{4}/\d\d/\d\d"), F.replace(F.substring(s, 1, 10), F.lit("/"), F.lit("-")))
        .when(s.rlike(jp), F.concat_ws("-", F.regexp_extract(s, jp, 1), part(jp, 2), part(jp, 3)))
        .when(s.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2)))
        .when(s.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))
    )
    return table(spark, d, "results").select("run_id", day.alias("created_day"))


TYPES = """types as (select id, arg_min(doc_type, (case assigned_by when 'manual' then 1 when 'rule' then 2 when 'agent' then 3 else 4 end)::varchar || lpad((4102444800000000 - epoch_us(assigned_at))::varchar, 20, '0') || doc_type) as doc_type,
count(distinct doc_type) as n_types from doc_types where id is not null and doc_type is not null group by id)"""


@query(f"with {TYPES} select * from types")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of each document where several hands assigned one."""
    return corpus.document_types(table(spark, d, "doc_types").withColumn("assigned_at", F.col("assigned_at").cast("timestamp")))


@query(f"with {RUNS} select id from latest where id not in (select id from doc_types where id is not null and doc_type is not null)")
def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a type."""
    r = table(spark, d, "results").where("id is not null").select("id").distinct()
    return r.join(table(spark, d, "doc_types").where("doc_type is not null").select("id"), "id", "left_anti")


@query(f"""with {RUNS}, {TYPES}, l as (select r.id, lower(r.file_type) as file_type, r.content_hash from results r join latest using (run_id))
select coalesce(t.doc_type, 'none') as doc_type, l.file_type, count(*) as n_docs, count(distinct l.content_hash) as n_contents from l left join types t on t.id = l.id group by rollup (1, 2)""")
def corpus_status(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and contents there are by type and format, with totals."""
    l = corpus.latest_runs(table(spark, d, "results")).select("id", F.lower("file_type").alias("file_type"), "content_hash")
    t = corpus.document_types(table(spark, d, "doc_types").withColumn("assigned_at", F.col("assigned_at").cast("timestamp"))).select("id", "doc_type")
    j = l.join(t, "id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("none")))
    return j.rollup("doc_type", "file_type").agg(F.count("*").alias("n_docs"), F.count_distinct("content_hash").alias("n_contents"))


@query("""select id, kind, max_by(fact_id, lpad(epoch_us(created_at)::varchar, 20, '0') || lpad(fact_id::varchar, 20, '0')) as fact_id, count(*) as n_merged, count(distinct statement) as n_statements
from facts where id is not null group by id, kind, coalesce(elem_ord::varchar, 's:' || coalesce(statement, ''))""")
def facts_merge(spark: SparkSession, d: str) -> DataFrame:
    """Shards of facts merged to one fact per place and kind."""
    return corpus.merge_facts(table(spark, d, "facts")).select("id", "kind", "fact_id", "n_merged", "n_statements")


@query("select id, elem_ord, count(distinct statement) as n_statements from facts where elem_ord is not null group by id, elem_ord having count(distinct statement) > 1")
def fact_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.fact_conflicts(table(spark, d, "facts"))


@query("select fact_id, id, elem_ord from facts where kind = 'non_functional' and contains(statement, '暗号化')")
def facts_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").where((F.col("kind") == "non_functional") & F.contains("statement", F.lit("暗号化"))).select("fact_id", "id", "elem_ord")


@query(f"""with {RUNS}, places as (select distinct run_id, elem_ord from elements)
select fact_id, case when l.run_id is null then 'unknown_document' when f.elem_ord is null then 'no_place' when p.elem_ord is null then 'unknown_place' else 'ok' end as status
from facts f left join latest l on l.id = f.id left join places p on p.run_id = l.run_id and p.elem_ord = f.elem_ord""")
def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether each fact's place is there."""
    return corpus.citation_audit(table(spark, d, "facts"), table(spark, d, "results"), table(spark, d, "elements"))


@query("""select elem_id, run_id, elem_ord, kind, ref, quote from (select elem_id, run_id, elem_ord, case
when regexp_matches(content, '(?i)(^|[^a-z0-9_])within [0-9]+ seconds([^a-z0-9_]|$)|秒以内|性能|暗号化') then 'non_functional' when regexp_matches(content, '(?i)screen|dialog|画面|页面') then 'screen'
when regexp_matches(content, '(?i)report|帳票|レポート') then 'report' when regexp_matches(content, '(?i)number|code|key|コード|番号|キー') then 'data_item'
when regexp_matches(content, '(?i)(^|[^a-z0-9_])(shall|must|can|will|should)([^a-z0-9_]|$)|できる|すること') then 'functional' else 'other' end as kind,
unnest(list_distinct(regexp_extract_all(content, '(?:^|[^A-Za-z0-9_-])([A-Z]{2,4}-[0-9]{3,6})', 1))) as ref, substr(content, 1, 60) as quote from elements where type = 'text' and content is not null)""")
def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts by rules: an identifier with its kind, place and quote."""
    return corpus.extract_facts(table(spark, d, "elements"))


QUESTIONS = [(1, ["保管サービス", "単価"]), (2, ["exchange rates", "mobile client"]), (3, ["zzqx"]), (4, ["Freigabeprozess"]), (5, [])]
ASKED = "(select unnest([1, 1, 2, 2, 3, 4]) as q, unnest(['保管サービス', '単価', 'exchange rates', 'mobile client', 'zzqx', 'freigabeprozess']) as term)"
HITS = f"hits as (select q as question_id, elem_id, count(*) as score from elements, {ASKED} where type = 'text' and content <> '' and contains(lower(content), term) group by all)"


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id bigint, terms array<string>")


@query(f"with {HITS}, r as (select *, row_number() over (partition by question_id order by score desc, elem_id) as rank from hits) select question_id, elem_id, score, rank from r where rank <= 20")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best elements of each question: a top-k report."""
    t = corpus.top(corpus.matches(table(spark, d, "elements"), _questions(spark)), 20)
    return t.select("question_id", "elem_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""with {HITS}, r as (select *, row_number() over (partition by question_id order by score desc, elem_id) as rank from hits),
b as (select question_id, count(*) as n, arg_min(elem_id, rank) as e from r where rank <= 3 group by 1)
select q::bigint as question_id, case when n is null then 'none' else 'found' end as status, coalesce(n, 0) as n_citations, e as first_citation from range(1, 6) t(q) left join b on b.question_id = q""")
def grounded_or_none(spark: SparkSession, d: str) -> DataFrame:
    """Answers with citations, or that there is none."""
    q = _questions(spark)
    return corpus.answers(q, corpus.matches(table(spark, d, "elements"), q))


@query("""select gram, count(*) as n_docs from (select doc_id, unnest(list_distinct([substr(text, i, 2) for i in range(1, length(text))])) as gram from documents where length(text) > 1) group by 1""")
def bigram_df(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each pair of neighbouring characters, the basis of a search index for scripts without spaces."""
    return corpus.bigram_counts(table(spark, d, "documents"), "doc_id", "text")


@query("""select kind, count(*) as n_facts, min(fact_id) as first_fact, min(statement) as statement from facts where statement is not null and kind is not null
group by kind, regexp_replace(lower(trim(statement)), '\\s+', ' ', 'g')""")
def canonical_items(spark: SparkSession, d: str) -> DataFrame:
    """Facts of equal statements as one item."""
    return corpus.canonical_items(table(spark, d, "facts")).select("kind", "n_facts", "first_fact", "statement")


@query("""select 'R1' as rule_id, 'error' as severity, fact_id from facts where statement is null or trim(statement) = '' union all select 'R2', 'warning', fact_id from facts where quote is null
union all select 'R3', 'error', fact_id from facts where elem_ord is null union all select 'R4', 'error', fact_id from facts where id is null""")
def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the base rules, one of them made stricter and one turned off by a pack that extends them."""
    rules = corpus.effective_rules(corpus.BASE_RULES, [("R3", "error", "elem_ord is null"), ("R5", "off", "")])
    return corpus.findings(table(spark, d, "facts"), rules)


@query("""select kind, count(*) as n_items, sum(length(line))::bigint as n_chars from (select kind, '- ' || min(statement) || ' [' || count(*)::varchar || ']' as line from facts where statement is not null and kind is not null
group by kind, regexp_replace(lower(trim(statement)), '\\s+', ' ', 'g')) group by kind""")
def design_chapters(spark: SparkSession, d: str) -> DataFrame:
    return corpus.design_text(corpus.canonical_items(table(spark, d, "facts")))


ITEMS = """select kind, min(fact_id) as first_fact, count(*) as n_facts, min(statement) as statement, regexp_replace(lower(trim(statement)), '\\s+', ' ', 'g') as key
from facts where statement is not null and kind is not null {more} group by kind, regexp_replace(lower(trim(statement)), '\\s+', ' ', 'g')"""


@query(f"""with i as ({ITEMS.format(more='')}), c as (select *, case kind when 'functional' then 1 when 'data_item' then 2 when 'screen' then 3 when 'report' then 4 when 'non_functional' then 5 else 6 end as chapter_no from i)
select chapter_no, row_number() over (partition by chapter_no order by first_fact) as line_no, '- ' || statement || ' [' || n_facts || ']' as line from c
union all select chapter_no, 0, '# ' || chapter_no || ' ' || case when chapter_no > 5 then 'other' else min(kind) end from c group by chapter_no""")
def design_document(spark: SparkSession, d: str) -> DataFrame:
    """The design document: chapters with their items as numbered lines."""
    return corpus.design_document(corpus.canonical_items(table(spark, d, "facts")))


@query(f"""with o as ({ITEMS.format(more="and created_at < timestamp '2023-07-01'")}), n as ({ITEMS.format(more='')})
select n.kind, n.first_fact, case when o.key is null then 'added' else 'changed' end as change from n left join o on o.kind = n.kind and o.key = n.key where o.key is null or o.n_facts <> n.n_facts or o.first_fact <> n.first_fact""")
def item_changes(spark: SparkSession, d: str) -> DataFrame:
    """How canonical items changed since a day; none can be removed, as facts are only added."""
    f = table(spark, d, "facts")
    new = corpus.canonical_items(f)
    c = corpus.item_changes(corpus.canonical_items(f.where(F.col("created_at") < F.lit("2023-07-01").cast("timestamp_ntz"))), new)
    return c.join(new.select("item_key", "first_fact"), "item_key").select("kind", "first_fact", "change")


LABELS = [("(?i)test|テスト|試験|测试", "test"), ("(?i)manual|handbuch|マニュアル|手順", "manual"), ("(?i)design|entwurf|設計|设计", "design"), ("(?i)minutes|議事|protokoll", "minutes")]


@query(f"""with {RUNS}, l as (select r.id, concat_ws(' ', r.metadata.title, r.source) as t from results r join latest using (run_id))
select id, case {' '.join(f"when regexp_matches(t, '{p}') then '{n}'" for p, n in LABELS)} else 'other' end as doc_type from l""")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    """A type for each document by rules on its title and file name."""
    return corpus.label_by_rules(corpus.latest_runs(table(spark, d, "results")), LABELS)


@query("""select doc_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select doc_id, string_split(replace(text, chr(13), ''), chr(10)) as l from documents where text is not null)""")
def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Text as ordered line elements."""
    t = table(spark, d, "documents").where("text is not null")
    x = t.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("i", "line"))
    return x.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


@query("""select p.project_key, p.main_lang, count(r.run_id) as n_runs, count(distinct r.id) as n_ids, max(r.loaded_at) as last_loaded from projects p left join results r on r.project_key = p.project_key group by all""")
def project_overview(spark: SparkSession, d: str) -> DataFrame:
    """Runs and documents of each project."""
    r = table(spark, d, "results").groupBy("project_key").agg(F.count("*").alias("n_runs"), F.count_distinct("id").alias("n_ids"), F.max("loaded_at").alias("last_loaded"))
    p = table(spark, d, "projects").select("project_key", "main_lang")
    return p.join(r, "project_key", "left").na.fill(0, ["n_runs", "n_ids"])


@query("""select event_type, date_trunc('day', ts) as day, count(*) as n, round(sum(value), 2) as total, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by all""")
def event_days(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling days of a stream of events, with a value out of JSON."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.sum("k").alias("k"))
