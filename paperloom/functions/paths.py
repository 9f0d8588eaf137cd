"""Column functions on file paths: normal form, identity, format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that can be read, and the older ones that have to be converted first.
SUPPORTED = ("docx", "xlsx", "xlsm", "pptx", "pdf")
LEGACY = ("doc", "xls", "ppt")


def normal_path(path: Column) -> Column:
    """A path without its scheme and with forward slashes; case is kept. Null stays null."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^file:/+", "/")
    return F.regexp_replace(p, "^/([A-Za-z]:/)", "$1")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """The extension in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def is_temporary(path: Column) -> Column:
    """Whether a file is one that an office program keeps while a document is open."""
    return file_name(path).startswith("~$")


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED) & ~is_temporary(path)


def source_hash(path: Column) -> Column:
    """The first eight hexadecimal digits of the SHA-256 of a normal path."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 8)


def document_id(path: Column) -> Column:
    """<stem>_<extension>_<hash>; blanks and characters that folders can't have become an underscore."""
    return F.concat_ws("_", F.regexp_replace(stem(path), r"[\s<>:\"/\\|?*\x00-\x1f]+", "_"), extension(path), source_hash(path))


def image_name(number: Column, fmt: Column) -> Column:
    return F.concat(F.lit("images/image_"), F.lpad(number.cast("string"), 3, "0"), F.lit("."), fmt)
