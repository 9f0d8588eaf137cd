"""Extraction: files to documents with ordered text, table and image elements."""

from __future__ import annotations

import importlib
import importlib.util
import json
import os
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.engine import session, ship
from paperloom.functions import paths
from paperloom.operators.corpus import with_groups
from paperloom.sources import files, model, office, ooxml, pdf

PARSERS: dict[str, Callable[[bytes], ooxml.Parsed]] = {"docx": ooxml.docx, "xlsx": ooxml.xlsx, "xlsm": ooxml.xlsx, "pptx": ooxml.pptx, "pdf": pdf.pdf}

#: Text in an image: image bytes and language to text. Tables in an image: image bytes to (rows, box) each.
OcrBackend = Callable[[bytes, str], str | None]
TableBackend = Callable[[bytes], list[tuple[list[list[str]], list[float]]]]
#: embedded reads what images carry in their own text chunks; engines that recognise pixels register beside it.
OCR_BACKENDS: dict[str, OcrBackend] = {"embedded": office.embedded_text}
TABLE_BACKENDS: dict[str, TableBackend] = {"embedded": office.embedded_tables}


def rapidocr() -> OcrBackend | None:
    """Text recognition by the package rapidocr_onnxruntime, where it and its models are installed; loaded once per worker."""
    if importlib.util.find_spec("rapidocr_onnxruntime") is None:
        return None

    def read(data: bytes, _lang: str) -> str | None:
        lines, _took = _engine()(data)
        return "\n".join(x[1] for x in lines or ()) or None

    return read


@lru_cache(maxsize=1)
def _engine() -> Callable:
    return importlib.import_module("rapidocr_onnxruntime").RapidOCR()


def ocr_backend(name: str = "auto") -> OcrBackend | None:
    """A backend by name. auto: rapidocr, else windows, else embedded. An unknown or unavailable name is an error."""
    known = OCR_BACKENDS | ({"rapidocr": own} if "rapidocr" not in OCR_BACKENDS and (own := rapidocr()) else {})
    if name == "auto":
        return next((known[n] for n in ("rapidocr", "windows", "embedded") if n in known), None)
    if name not in known:
        raise ValueError(f"no OCR backend {name!r} is available; registered: {sorted(known)}")
    return known[name]


LOCATION_KEYS = ("order", "sheet", "anchor", "slide", "shape_name", "page", "bbox", "from_image", "bbox_in_image")
ELEMENT_KEYS = ("elem_ord", "type", "content", "style", "n_rows", "n_cols", "rows", "file", "format", "width", "height", "ocr_text")


def parse(ext: str, data: bytes, ocr: OcrBackend | None = None, lang: str = "ja", tables: TableBackend | None = None) -> dict:
    """metadata, elements, images and error of one file; a damaged one has an error and no elements."""
    try:
        meta, elements, images = PARSERS[ext](data)
    except Exception as e:  # any damage that a parser meets is the file's
        return {"metadata": None, "elements": [], "images": [], "error": f"{type(e).__name__}: {e}"[:500]}
    out = []
    by = dict(images)
    for e in elements:
        own = {k: e.get(k) for k in ELEMENT_KEYS}
        own["location"] = {k: e.get("location", {}).get(k) for k in LOCATION_KEYS}
        if e["type"] == "image" and ocr:
            own["ocr_text"] = ocr(by.get(e["file"], b""), lang)
        out.append(own)
        if e["type"] == "image" and tables:
            for rows, box in tables(by.get(e["file"], b"")):
                loc = own["location"] | {"from_image": e["file"], "bbox_in_image": [float(v) for v in box]}
                out.append(dict.fromkeys(ELEMENT_KEYS) | {"type": "table", "n_rows": len(rows), "n_cols": max(map(len, rows), default=0), "rows": rows, "location": loc})
    for n, e in enumerate(out, 1):
        e["elem_ord"] = n
    return {"metadata": {k: meta.get(k) for k in ("title", "author", "created", "modified")}, "elements": out, "images": [{"file": f, "bytes": b} for f, b in images], "error": None}


def documents(content: DataFrame, ocr: OcrBackend | None = None, lang: str = "ja", tables: TableBackend | None = None) -> DataFrame:
    """id, source, source_abspath, source_hash, content_hash, file_type, metadata, elements, images, error: a row per file.

    Bytes are read, hashed and parsed in one place and leave it only as images; nothing is shuffled.
    """
    ship(content.sparkSession)
    p = paths.normal_path(F.col("path"))
    d = content.select(p.alias("source_abspath"), "content")
    d = d.select(
        paths.document_id(F.col("source_abspath")).alias("id"), paths.file_name(F.col("source_abspath")).alias("source"), "source_abspath", paths.source_hash(F.col("source_abspath")).alias("source_hash"),
        F.sha2("content", 256).alias("content_hash"), paths.extension(F.col("source_abspath")).alias("file_type"), "content",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse(t, bytes(c), ocr, lang, tables) for t, c in zip(b["file_type"], b["content"])]
            yield pd.concat([b.drop(columns="content").reset_index(drop=True), pd.DataFrame(got, columns=["metadata", "elements", "images", "error"])], axis=1)

    # a few files at a time, whatever their size
    head = "id string, source string, source_abspath string, source_hash string, content_hash string, file_type string, "
    return d.mapInPandas(run, head + model.PARSED)


def elements(docs: DataFrame) -> DataFrame:
    """id, elem_ord and the columns of each element."""
    return docs.select("id", F.explode("elements").alias("e")).select("id", "e.*")


def images(docs: DataFrame) -> DataFrame:
    """id, file, format, bytes of each image."""
    return docs.select("id", F.explode("images").alias("i")).select("id", "i.file", paths.extension(F.col("i.file")).alias("format"), "i.bytes")


def summary(e: DataFrame, key: str = "id") -> DataFrame:
    """key, n_text, n_table, n_image: elements of each type, 0 for a type without any."""
    return e.groupBy(key).agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("text", "table", "image")])


def results(docs: DataFrame, *more: str) -> DataFrame:
    """Documents as they are exported: summary has the types that occur, elements are in their order; more: other columns of docs."""
    n = lambda t: F.size(F.filter("elements", lambda e: e["type"] == t)).cast("bigint")
    entries = F.filter(F.array(*[F.struct(F.lit(t).alias("key"), n(t).alias("value")) for t in ("text", "table", "image")]), lambda x: x["value"] > 0)
    ordered = F.array_sort("elements")
    out = F.transform(ordered, lambda e: e.dropFields("elem_ord"))
    return docs.select("id", "source", "source_abspath", "source_hash", "content_hash", "file_type", "metadata", F.map_from_entries(entries).alias("summary"), out.alias("elements"), *more)


def manifest(docs: DataFrame) -> DataFrame:
    """id, source, source_abspath, content_hash, file_type, n_same, canonical_id: the index, with groups of identical content.

    Two documents of one id are an error of the input that `identity.collisions` reports.
    """
    return with_groups(docs.select("id", "source", "source_abspath", "content_hash", "file_type"))


# ---- export


def home() -> str:
    """The folder that outputs lie in, moved by the environment variable PAPERLOOM_HOME."""
    return os.environ.get("PAPERLOOM_HOME") or ".paperloom"


def place(spark: SparkSession, output: str) -> str:
    """The URI of an output folder, on a file system that all executors share; a local folder only on a local master."""
    if "://" in output:
        return output
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError(f"{output} is a folder of one machine: name a shared one by its URI")
    return "file://" + os.path.abspath(output)


def write_file(uri: str, data: bytes | Iterator[bytes]) -> None:
    """Writes one file whole, on any file system that Arrow knows; a repeated write replaces it."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as f:
        for part in [data] if isinstance(data, bytes) else data:
            f.write(part)


def export(docs: DataFrame, output: str | None = None) -> str:
    """Writes output/<id>/result.json, output/<id>/images/ and output/index.json.

    result.json and images are written by the executors, each document where it is, without a shuffle; a task that runs again
    writes the same files. index.json, a line's worth of text per document, is streamed through the driver.
    """
    out = output or os.path.join(home(), "output")
    uri = place(docs.sparkSession, out).rstrip("/")
    r = results(docs, "images")
    r = r.select("id", F.to_json(F.struct(*[c for c in r.columns if c != "images"])).alias("json"), "images")

    def write(rows: Iterator) -> None:
        for r in rows:
            folder = f"{uri}/{quote(r['id'])}"
            write_file(f"{folder}/result.json", r["json"].encode())
            for i in r["images"] or ():
                write_file(f"{folder}/{i['file']}", bytes(i["bytes"]))

    r.foreachPartition(write)

    def lines() -> Iterator[bytes]:
        yield b"{"
        for n, r in enumerate(manifest(docs).orderBy("id").toLocalIterator()):
            own = {k: r[k] for k in ("source", "source_abspath", "content_hash", "file_type", "n_same", "canonical_id")}
            yield (("," if n else "") + "\n" + json.dumps(r["id"]) + ": " + json.dumps(own, ensure_ascii=False)).encode()
        yield b"\n}\n"

    write_file(f"{uri}/index.json", lines())
    return out


def read_results(spark: SparkSession, output: str | None = None) -> DataFrame:
    """Exported results read back, with a declared schema: keys that a file lacks are null."""
    return spark.read.schema(model.RESULT).option("multiLine", "true").json(os.path.join(output or os.path.join(home(), "output"), "*", "result.json"))


def extract(source: str | Sequence[str], output_dir: str | None = None, *, spark: SparkSession | None = None, recursive: bool = False, ocr: bool = True, image_tables: bool = True, backend: str = "auto", lang: str = "ja") -> dict:
    """Extracts files, wildcards or folders, exports the results and returns that of a single file, else {"files": n, "output": folder}.

    ocr and image_tables use the best backend there is (see ocr_backend); an image that it reads nothing in keeps a null ocr_text.
    """
    s = spark or session()
    use = ocr_backend(backend) if ocr else None
    tab = next(iter(TABLE_BACKENDS.values()), None) if image_tables else None
    docs = documents(files.contents(s, [source] if isinstance(source, str) else list(source), recursive), use, lang, tab).persist()
    try:
        out = export(docs, output_dir)
        head = results(docs).limit(2).collect()
        if len(head) == 1:
            return head[0].asDict(recursive=True)
        return {"files": docs.count(), "output": out}
    finally:
        docs.unpersist()
