"""Queries of the readers: the elements of every run are written into a file of its format and read back by extraction.

A file is one unit of work, as it is for its reader, so the elements of a run meet in one row; runs are spread over tasks.
Each query reads all runs of its formats; the SQL says what the reader must find in terms of the elements alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.engine import ship, table
from paperloom.operators import extraction
from paperloom.plans.registry import query
from paperloom.sources import office

KEYS = ("type", "content", "style", "rows", "width", "height", "ocr_text", "location")


def written(results: DataFrame, elements: DataFrame, formats: tuple[str, ...], **changed: Column) -> DataFrame:
    """path, content: a file for each run of the formats that has elements; changed: other values for columns of its elements.

    Runs without elements give none. Null file types are no format.
    """
    ship(results.sparkSession)
    r = results.where(F.lower("file_type").isin(*formats)).select("run_id", F.lower("file_type").alias("ext"), "metadata")
    e = elements.withColumns(changed) if changed else elements
    g = e.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("elem_ord", "elem_id", *[k for k in dict.fromkeys((*KEYS, *changed)) if k in e.columns]))).alias("es"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(b.num_rows):  # a file at a time
                run_id, ext, meta, es = (c[s].as_py() for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array([f"/{run_id}.{ext}"]), pa.array([office.WRITERS[ext](meta, es)], pa.binary())], ["path", "content"])

    return r.join(g, "run_id").select("run_id", "ext", "metadata", "es").mapInArrow(run, "path string, content binary")


def documents(spark: SparkSession, d: str, formats: tuple[str, ...], ocr: bool = False, **changed: Column) -> DataFrame:
    """The documents that the readers find in the written files, with run_id."""
    w = written(table(spark, d, "results"), table(spark, d, "elements"), formats, **changed)
    docs = extraction.documents(w, office.embedded_text if ocr else None, "ja", office.embedded_tables if ocr else None)
    return docs.withColumn("run_id", F.split("id", "_")[0].cast("bigint"))


def found(spark: SparkSession, d: str, formats: tuple[str, ...], kind: str, ocr: bool = False, **changed: Column) -> DataFrame:
    """run_id and the columns of the elements of a type."""
    return documents(spark, d, formats, ocr, **changed).select("run_id", F.explode("elements").alias("e")).select("run_id", "e.*").where(F.col("type") == kind)


def cells(e: DataFrame, *keys: str) -> DataFrame:
    """keys, r, c, v of each cell that isn't null or empty, from 1."""
    r = e.select(*keys, F.posexplode("rows").alias("r", "row"))
    return r.select(*keys, (F.col("r") + 1).cast("bigint").alias("r"), F.posexplode("row").alias("c", "v")).select(*keys, "r", (F.col("c") + 1).cast("bigint").alias("c"), "v").where("v <> ''")


OF = "of as (select e.*, lower(r.file_type) as ext, r.metadata as meta from elements e join results r using (run_id))"
#: Elements that a docx file shows, numbered in order.
SHOWN = f"""{OF}, shown as (select *, row_number() over (partition by run_id order by elem_ord, elem_id) as ord from of
where ext = 'docx' and (type = 'image' or type = 'table' and len(rows) > 0 or type = 'text' and trim(content) <> ''))"""
CELLS = """(select *, list_extract(row, c) as v from (select *, unnest(range(1, len(row) + 1)) as c from (select *, list_extract(rows, r) as row from (select *, unnest(range(1, len(rows) + 1)) as r from {t} where type = 'table')) where row is not null))"""


@query(f"with {SHOWN} select run_id, ord, content, style from shown where type = 'text'")
def docx_texts(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of Word files with the name of their style and their order among all elements."""
    return found(spark, d, ("docx",), "text").select("run_id", F.col("location.order").cast("bigint").alias("ord"), "content", "style")


@query(f"with {SHOWN} select run_id, ord, r, c, v from {CELLS.format(t='shown')} where v <> ''")
def docx_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of tables of Word files."""
    return cells(found(spark, d, ("docx",), "table").select("run_id", F.col("location.order").cast("bigint").alias("ord"), "rows"), "run_id", "ord")


@query(f"""with {SHOWN} select run_id, ord, 'images/image_' || lpad(row_number() over (partition by run_id order by ord)::varchar, 3, '0') || '.png' as file, 'png' as format, coalesce(width, 1) as width, coalesce(height, 1) as height
from shown where type = 'image'""")
def docx_images(spark: SparkSession, d: str) -> DataFrame:
    """Inline images of Word files with format and size out of their headers."""
    return found(spark, d, ("docx",), "image").select("run_id", F.col("location.order").cast("bigint").alias("ord"), "file", "format", "width", "height")


@query(f"with {SHOWN} select run_id, ord, content from shown where type = 'text'")
def docx_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Text boxes of Word files: every text is written into one."""
    e = found(spark, d, ("docx",), "text", style=F.lit("textbox")).where("style = 'textbox'")
    return e.select("run_id", F.col("location.order").cast("bigint").alias("ord"), "content")


@query(f"""with {OF}, x as (select run_id, elem_id, location.sheet as sheet, r, c, v from {CELLS.format(t='of')} where ext in ('xlsx', 'xlsm') and v <> ''),
u as (select *, min(r) over (partition by elem_id) as r0, min(c) over (partition by elem_id) as c0 from x)
select run_id, sheet, r - r0 + 1 as r, c - c0 + 1 as c, v from u where sheet is not null""")
def xlsx_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of sheets, cut to their used range; numbers come from formulas with a cached result. A sheet without a name has a made-up one."""
    e = found(spark, d, ("xlsx", "xlsm"), "table").select("run_id", F.col("location.sheet").alias("sheet"), "rows")
    return cells(e.where(~F.col("sheet").rlike("^unnamed [0-9]+$")), "run_id", "sheet")


@query(f"""with {OF} select run_id, count(*) as n_formulas, sum(cast(v as decimal(24, 9)))::double as total from {CELLS.format(t='of')} where ext in ('xlsx', 'xlsm') and regexp_full_match(v, '-?[0-9]{{1,15}}([.][0-9]{{1,9}})?') group by 1""")
def xlsx_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of each workbook, read as their cached results, and the sum of these."""
    v = cells(found(spark, d, ("xlsx", "xlsm"), "table").select("run_id", "rows"), "run_id").where(F.col("v").rlike(r"^-?[0-9]{1,15}([.][0-9]{1,9})?$"))
    return v.groupBy("run_id").agg(F.count("*").alias("n_formulas"), F.sum(F.col("v").cast("decimal(24,9)")).cast("double").alias("total"))


@query(f"with {OF} select run_id, location.sheet as sheet, location.anchor as anchor, coalesce(width, 1) as width, coalesce(height, 1) as height from of where ext in ('xlsx', 'xlsm') and type = 'image' and location.sheet is not null")
def xlsx_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of sheets with their anchor cell."""
    e = found(spark, d, ("xlsx", "xlsm"), "image").select("run_id", "location.sheet", "location.anchor", "width", "height")
    return e.where(~F.col("sheet").rlike("^unnamed [0-9]+$"))


PLACE = "greatest(1, coalesce(location.slide, 1)) as slide, location.shape_name as shape_name"


def _slide(e: DataFrame, *more: str) -> DataFrame:
    return e.select("run_id", F.col("location.slide").alias("slide"), F.col("location.shape_name").alias("shape_name"), *more)


@query(f"with {OF} select run_id, {PLACE}, trim(content, chr(10)) as content from of where ext = 'pptx' and type = 'text' and trim(content) <> ''")
def pptx_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text frames with slide and shape."""
    return _slide(found(spark, d, ("pptx",), "text"), "content")


@query(f"with {OF} select run_id, {PLACE}, r, c, trim(v, chr(10)) as v from {CELLS.format(t='of')} where ext = 'pptx' and trim(v, chr(10)) <> ''")
def pptx_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of tables on slides."""
    return cells(_slide(found(spark, d, ("pptx",), "table"), "rows"), "run_id", "slide", "shape_name")


@query(f"with {OF} select run_id, {PLACE}, coalesce(width, 1) as width, coalesce(height, 1) as height from of where ext = 'pptx' and type = 'image'")
def pptx_images(spark: SparkSession, d: str) -> DataFrame:
    """Images on slides."""
    return _slide(found(spark, d, ("pptx",), "image"), "width", "height")


@query(f"with {OF} select run_id, {PLACE}, 'notes' as style, trim(content, chr(10)) as content from of where ext = 'pptx' and type = 'text' and trim(content) <> ''")
def pptx_notes(spark: SparkSession, d: str) -> DataFrame:
    """Speaker notes: every text is written as a note of its slide."""
    return _slide(found(spark, d, ("pptx",), "text", style=F.when(F.col("type") == "text", "notes")), "style", "content")


@query(f"""with {OF}, l as (select run_id, greatest(1, coalesce(location.page, 1)) as page, unnest(string_split(content, chr(10))) as line from of where ext = 'pdf' and type = 'text')
select run_id, page, line from l where trim(line) <> ''""")
def pdf_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text of PDF files with their page."""
    e = found(spark, d, ("pdf",), "text")
    return e.select("run_id", "location.page", F.explode(F.split("content", "\n", -1)).alias("line"))


@query(f"""with {OF}, l as (select run_id, greatest(1, coalesce(location.page, 1)) as page, r, c, unnest(string_split(v, chr(10))) as line from {CELLS.format(t='of')} where ext = 'pdf')
select run_id, page, r, c, line from l where trim(line) <> ''""")
def pdf_tables(spark: SparkSession, d: str) -> DataFrame:
    """Lines in the cells of ruled tables of PDF files; text in a table is in no text element."""
    c = cells(found(spark, d, ("pdf",), "table").select("run_id", F.col("location.page").alias("page"), "rows"), "run_id", "page")
    return c.select("run_id", "page", "r", "c", F.explode(F.split("v", "\n", -1)).alias("line"))


@query(f"with {OF} select run_id, greatest(1, coalesce(location.page, 1)) as page, 'jpeg' as format, coalesce(width, 1) as width, coalesce(height, 1) as height, 4::bigint as n_box from of where ext = 'pdf' and type = 'image'")
def pdf_images(spark: SparkSession, d: str) -> DataFrame:
    """Embedded images of PDF files with page, size and the length of their box."""
    e = found(spark, d, ("pdf",), "image")
    return e.select("run_id", "location.page", "format", "width", "height", F.size("location.bbox").cast("bigint").alias("n_box"))


ALL = ("docx", "xlsx", "xlsm", "pptx", "pdf")


@query("""select run_id, nullif(metadata.title, '') as title, nullif(metadata.author, '') as author, nullif(metadata.created, '') as created, nullif(metadata.modified, '') as modified
from results where lower(file_type) in ('docx', 'xlsx', 'xlsm', 'pptx', 'pdf') and run_id in (select run_id from elements)""")
def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title, author and dates out of the files of all formats."""
    return documents(spark, d, ALL).select("run_id", *[f"metadata.{k}" for k in ("title", "author", "created", "modified")])


@query(f"""with {OF} select run_id, ext, coalesce(count(*) filter (type = 'text' and trim(content) <> '' and ext in ('docx', 'pptx')), 0) as n_text,
count(*) filter (type = 'table' and len(rows) > 0 and ext in ('docx', 'pptx')) as n_table, count(*) filter (type = 'image') as n_image from of where ext is not null group by 1, 2""")
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each type in every file; texts and tables of slides and Word files, which show each as one element."""
    docs = documents(spark, d, ALL)
    n = lambda t, own: F.size(F.filter("elements", lambda e: e["type"] == t)) * F.col("file_type").isin(*own).cast("int")
    return docs.select("run_id", F.col("file_type").alias("ext"), *[n(t, own).cast("bigint").alias(f"n_{t}") for t, own in (("text", ("docx", "pptx")), ("table", ("docx", "pptx")), ("image", ALL))])


@query(f"with {SHOWN} select run_id, ord, ocr_text from shown where type = 'image' and ocr_text is not null")
def image_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text in images by the backend for images that carry their text."""
    e = found(spark, d, ("docx",), "image", ocr=True).where("ocr_text is not null")
    return e.select("run_id", F.col("location.order").cast("bigint").alias("ord"), "ocr_text")


@query(f"""with {SHOWN} select run_id, ord, 'images/image_' || lpad(row_number() over (partition by run_id order by ord)::varchar, 3, '0') || '.png' as from_image,
coalesce(ocr_text, '') as v, width::double as x1, height::double as y1 from shown where type = 'image' and width is not null and height is not null""")
def image_found_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables found in images, with the image and the box that they come from: each image carries one, of its text and size."""
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double"))
    own = F.struct(F.array(F.array(F.coalesce("ocr_text", F.lit("")))).alias("rows"), box.alias("box"))
    tables = F.when((F.col("type") == "image") & F.col("width").isNotNull() & F.col("height").isNotNull(), F.array(own))
    e = found(spark, d, ("docx",), "table", ocr=True, tables=tables).where("location.from_image is not null")
    l = F.col("location")
    return e.select("run_id", l["order"].cast("bigint").alias("ord"), l["from_image"].alias("from_image"), F.col("rows")[0][0].alias("v"), l["bbox_in_image"][2].alias("x1"), l["bbox_in_image"][3].alias("y1"))


@query(f"with {SHOWN} select run_id, row_number() over (partition by run_id order by ord) as n, type, content, n_rows from (select run_id, ord, type, case when type = 'text' then content end as content, case when type = 'table' then len(rows) end as n_rows from shown)")
def exported_elements(spark: SparkSession, d: str) -> DataFrame:
    """result.json of each Word file, written as JSON text and read back by the declared schema, element by element."""
    from paperloom.sources import model

    r = extraction.results(documents(spark, d, ("docx",)))
    text = r.select(F.to_json(F.struct(*r.columns)).alias("json"))
    back = text.select(F.from_json("json", model.RESULT).alias("x")).select("x.id", F.posexplode("x.elements").alias("n", "e"))
    return back.select(F.split("id", "_")[0].cast("bigint").alias("run_id"), (F.col("n") + 1).cast("bigint").alias("n"), "e.type", "e.content", F.col("e.n_rows").cast("bigint").alias("n_rows"))
