"""Command line: python -m paperloom.cli FILE... [--dir FOLDER]... [-r] [-o OUT] [--no-ocr] [--no-image-tables] [--ocr-backend B] [--ocr-lang L]"""

from __future__ import annotations

import argparse
import json

from paperloom.operators import extraction


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="paperloom", description="Extract text, tables and images of office documents and PDF files.")
    a.add_argument("inputs", nargs="*", help="files, wildcards or folders")
    a.add_argument("--dir", "-d", action="append", default=[], help="a folder of files; may be repeated")
    a.add_argument("--recursive", "-r", action="store_true")
    a.add_argument("--output", "-o")
    a.add_argument("--no-ocr", action="store_true")
    a.add_argument("--no-image-tables", action="store_true")
    a.add_argument("--ocr-backend", choices=("rapidocr", "windows", "auto"), default="auto")
    a.add_argument("--ocr-lang", default="ja")
    o = a.parse_args(argv)
    if not o.inputs and not o.dir:
        a.error("nothing to extract")
    got = extraction.extract([*o.inputs, *o.dir], o.output, recursive=o.recursive, ocr=not o.no_ocr, image_tables=not o.no_image_tables, backend=o.ocr_backend, lang=o.ocr_lang)
    print(json.dumps(got.get("summary", got), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
