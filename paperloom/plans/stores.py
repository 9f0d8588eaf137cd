"""Queries of file scans, exports and stores: what is written to the shared folder is read back and compared with the tables by SQL.

Each run of a query writes to a folder of its own under the shared folder, removed when Python ends.
"""

from __future__ import annotations

import atexit
import posixpath
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import engine
from paperloom.engine import table
from paperloom.operators import extraction
from paperloom.plans import readers
from paperloom.plans.reference import RUNS
from paperloom.plans.registry import query
from paperloom.sources import files
from paperloom.streaming import ingest


def folder(spark: SparkSession) -> str:
    """A new folder under the shared folder."""
    engine.ship(spark)
    base = engine.checkpoint_dir(spark).rstrip("/")
    out = f"{base if ':' in base else 'file://' + base}/paperloom-{uuid.uuid4().hex}"
    atexit.register(engine._drop, spark, out)
    return out


def tree(spark: SparkSession, d: str) -> str:
    """A folder for each run with a file of its name, a temporary file beside it and one of an old format."""
    base = folder(spark)

    def write(rows: Iterator) -> None:
        system, at = fs.FileSystem.from_uri(base)
        for r in rows:
            stem, own = posixpath.splitext(r["source"])[0], f"{at}/{r['run_id']}"
            system.create_dir(own)
            for name in (r["source"], f"~${r['source']}", f"{stem}.doc"):
                with system.open_output_stream(f"{own}/{name}") as f:
                    f.write(str(r["run_id"]).encode())

    rows = table(spark, d, "results").where("source <> ''").select("run_id", "source")
    rows.repartition(4 * spark.sparkContext.defaultParallelism, "run_id").foreachPartition(write)
    return base


def _named(f: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return f.withColumn("run_id", F.element_at(parts, -2).cast("bigint")).withColumn("name", F.element_at(parts, -1))


EXTENSION = "lower(regexp_extract(source, '\\.([^.]+)$', 1))"
SUPPORTED = f"{EXTENSION} in ('docx', 'xlsx', 'xlsm', 'pptx', 'pdf')"


@query(f"select run_id, source as name, length(run_id::varchar)::bigint as length from results where {SUPPORTED} and source not like '~$%'")
def files_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Supported files of a folder and all below it, named twice but each once, without temporary ones and old formats."""
    base = tree(spark, d)
    return _named(files.accepted(files.listing(spark, [base, base], recursive=True))).select("run_id", "name", F.col("length").cast("bigint").alias("length"))


@query("""select run_id, '~$' || source as name, 'temporary' as reason from results where source <> '' union all
select run_id, regexp_replace(source, '\\.[^.]*$', '') || '.doc', 'legacy' from results where source <> ''""")
def files_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Files that aren't read, with the reason."""
    return _named(files.rejected(files.listing(spark, [tree(spark, d)], recursive=True))).select("run_id", "name", "reason")


@query("select run_id, source as name from results where source like '%.docx' and source not like '~$%'")
def files_by_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """Files that a wildcard names, in the letter case that it has."""
    return _named(files.accepted(files.listing(spark, [f"{tree(spark, d)}/*/*.docx"]))).select("run_id", "name")


@query(f"select run_id, source as name, run_id::varchar as text from results where {SUPPORTED} and source not like '~$%'")
def file_contents(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of supported files, as they are handed to the readers."""
    return _named(files.contents(spark, [tree(spark, d)], recursive=True)).select("run_id", "name", F.decode("content", "UTF-8").alias("text"))


def _exported(spark: SparkSession, d: str) -> str:
    return extraction.export(engine.cut(readers.documents(spark, d, ("docx",)).drop("run_id")), folder(spark))


@query(f"with {readers.SHOWN} select run_id, row_number() over (partition by run_id order by ord) as n, type, content, style, ord from (select run_id, ord, type, case when type = 'text' then content end as content, style from shown)")
def export_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Every result.json of an export, read back with the declared schema."""
    r = extraction.read_results(spark, _exported(spark, d))
    e = r.select(F.split("id", "_")[0].cast("bigint").alias("run_id"), F.posexplode("elements").alias("n", "e"))
    return e.select("run_id", (F.col("n") + 1).cast("bigint").alias("n"), "e.type", "e.content", "e.style", F.col("e.location.order").cast("bigint").alias("ord"))


@query(f"with {readers.SHOWN} select run_id, 'image_' || lpad(row_number() over (partition by run_id order by ord)::varchar, 3, '0') || '.png' as name, coalesce(width, 1)::bigint as width, coalesce(height, 1)::bigint as height from shown where type = 'image'")
def exported_images(spark: SparkSession, d: str) -> DataFrame:
    """Image files of an export with the size in their headers."""
    b = spark.read.format("binaryFile").load(f"{_exported(spark, d)}/*/images/*")
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("bigint")
    parts = F.split("path", "/")
    return b.select(F.split(F.element_at(parts, -3), "_")[0].cast("bigint").alias("run_id"), F.element_at(parts, -1).alias("name"), number(17).alias("width"), number(21).alias("height"))


@query(f"with {readers.SHOWN} select distinct run_id, run_id::varchar || '.docx' as source, 'docx' as file_type from of where ext = 'docx'")
def index_read_back(spark: SparkSession, d: str) -> DataFrame:
    """The index of an export, an entry for each document."""
    text = spark.read.text(f"{_exported(spark, d)}/index.json", wholetext=True)
    m = text.select(F.explode(F.from_json("value", "map<string, struct<source:string, file_type:string>>")).alias("id", "x"))
    return m.select(F.split("id", "_")[0].cast("bigint").alias("run_id"), "x.source", "x.file_type")


@query(f"""with {readers.SHOWN} select run_id, count(*) filter (type = 'text') as n_text, count(*) filter (type = 'table') as n_table, count(*) filter (type = 'image') as n_image from shown group by 1""")
def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder taken in by a stream, counted in the store that it fills."""
    out = _written(spark, d)
    ingest.ingest(spark, f"{out}/files", f"{out}/store", f"{out}/state").awaitTermination()
    e = spark.read.parquet(f"{out}/store/elements")
    return extraction.summary(e.withColumn("run_id", F.split("id", "_")[0].cast("bigint")), "run_id")


def _written(spark: SparkSession, d: str) -> str:
    out = folder(spark)

    def write(rows: Iterator) -> None:
        for r in rows:
            extraction.write_file(f"{out}/files{r['path']}", bytes(r["content"]))

    readers.written(table(spark, d, "results"), table(spark, d, "elements"), ("docx",)).foreachPartition(write)
    return out


MERGED = """select id, kind, max_by(fact_id, lpad(epoch_us(created_at)::varchar, 20, '0') || lpad(fact_id::varchar, 20, '0')) as fact_id, count(*) as n_merged
from facts where id is not null group by id, kind, coalesce(elem_ord::varchar, 's:' || coalesce(statement, ''))"""


def _stored(spark: SparkSession, d: str) -> str:
    out = folder(spark)
    ingest.save_facts(table(spark, d, "facts"), out)
    return out


@query(MERGED)
def stored_facts(spark: SparkSession, d: str) -> DataFrame:
    """Merged facts, read back from the JSON lines of the store."""
    j = spark.read.schema("id string, kind string, fact_id bigint, n_merged bigint").json(f"{_stored(spark, d)}/facts_json")
    return j.select("id", "kind", "fact_id", "n_merged")


@query("""select kind, min(fact_id) as first_fact, count(*) as n_facts from facts where statement is not null and kind is not null group by kind, regexp_replace(lower(trim(statement)), '\\s+', ' ', 'g')""")
def stored_items(spark: SparkSession, d: str) -> DataFrame:
    """Canonical items, read back from the store."""
    return spark.read.parquet(f"{_stored(spark, d)}/spec_items").select("kind", "first_fact", "n_facts")


@query(f"""with {RUNS} select id, run_id from latest""")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The run of each id that its index entry stands for."""
    from paperloom.operators import corpus

    return corpus.latest_runs(table(spark, d, "results")).select("id", "run_id")


@query(f"with {readers.SHOWN} select run_id, count(*) as n_images, 0::bigint as n_texts, 0::bigint as n_tables from shown where type = 'image' group by 1")
def recognition_off(spark: SparkSession, d: str) -> DataFrame:
    """Extraction without text and tables in images: images are there, nothing is read in them."""
    e = readers.found(spark, d, ("docx",), "image")
    return e.groupBy("run_id").agg(F.count("*").alias("n_images"), F.count("ocr_text").alias("n_texts"), F.count("location.from_image").alias("n_tables"))
