"""Parsers of Office Open XML files with the standard library. Each gives (metadata, elements, images)."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

Parsed = tuple[dict, list[dict], list[tuple[str, bytes]]]


def tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attr(e: ET.Element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def image_size(b: bytes) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) from the header of PNG, GIF, BMP and JPEG."""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return ("png", *struct.unpack(">II", b[16:24]))
    if b[:3] == b"GIF" and len(b) >= 10:
        return ("gif", *struct.unpack("<HH", b[6:10]))
    if b[:2] == b"BM" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return "bmp", w, abs(h)
    if b[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(b):
            if b[i] != 0xFF:
                break
            kind = b[i + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[i + 5 : i + 9])
                return "jpeg", w, h
            i += 2 + struct.unpack(">H", b[i + 2 : i + 4])[0]
        return "jpeg", None, None
    return None, None, None


class Package:
    """Parts of a zip file and the relationships between them."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.images: list[tuple[str, bytes]] = []
        self.known: dict[str, str] = {}

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def rels(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (kind, target part)."""
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels".lstrip("/"))
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target)
        return out

    def image(self, part: str) -> dict:
        """The image element of a part; a new file name for each use, as each is an element of its own."""
        b = self.zip.read(part) if part in self.names else b""
        fmt, w, h = image_size(b)
        fmt = fmt or posixpath.splitext(part)[1].lstrip(".").lower() or "bin"
        name = f"images/image_{len(self.images) + 1:03}.{fmt}"
        self.images.append((name, b))
        return {"type": "image", "file": name, "format": fmt, "width": w, "height": h}

    def metadata(self) -> dict:
        names = {"title": "title", "creator": "author", "created": "created", "modified": "modified"}
        root = self.xml("docProps/core.xml")
        return {names[tag(e)]: e.text for e in (root if root is not None else ()) if tag(e) in names}


def table(rows: list[list[str | None]], location: dict) -> dict:
    return {"type": "table", "n_rows": len(rows), "n_cols": max(map(len, rows), default=0), "rows": rows, "location": location}


# ---- docx

#: Built-in styles whose names files hold in lower case and programs show with a capital.
SHOWN = re.compile(r"heading [1-9]|caption|header|footer")


def shown_style(name: str) -> str:
    """The name of a style as programs show it."""
    return name.capitalize() if SHOWN.fullmatch(name) else name


def internal_style(name: str) -> str:
    """The name of a style as files hold it."""
    return low if SHOWN.fullmatch(low := name.lower()) and name == shown_style(low) else name


def docx(data: bytes) -> Parsed:
    """Paragraphs with style names, tables, inline images and text boxes in the order of appearance."""
    p = Package(data)
    styles: dict[str, str] = {}
    root = p.xml("word/styles.xml")
    for s in root if root is not None else ():
        if tag(s) == "style":
            name = next((attr(x, "val") for x in s if tag(x) == "name"), None)
            styles[attr(s, "styleId") or ""] = shown_style(name or "")
    default = next((attr(s, "styleId") for s in (root if root is not None else ()) if tag(s) == "style" and attr(s, "type") == "paragraph" and attr(s, "default") in ("1", "true")), None)
    rels = p.rels("word/document.xml")
    out: list[dict] = []

    def add(e: dict) -> None:
        e["location"] = {"order": len(out) + 1}
        out.append(e)

    def runs(e: ET.Element) -> Iterator[tuple[str, object]]:
        """Text, images and text boxes in a paragraph; what is a fallback for older programs is a repeat."""
        for x in e:
            t = tag(x)
            if t == "t":
                yield "text", x.text or ""
            elif t in ("tab", "br", "cr"):
                if tag(e) == "r":
                    yield "text", "\t" if t == "tab" else "\n"
            elif t == "blip" and (r := attr(x, "embed")) in rels:
                yield "image", rels[r][1]
            elif t == "imagedata" and (r := attr(x, "id")) in rels:
                yield "image", rels[r][1]
            elif t == "txbxContent":
                yield "box", x
            elif t not in ("Fallback", "delText", "instrText", "pPr"):
                yield from runs(x)

    def text_of(e: ET.Element) -> str:
        return "".join(str(v) for k, v in runs(e) if k == "text")

    def rows(e: ET.Element) -> list[list[str | None]]:
        return [["\n".join(text_of(q) for q in c.iter() if tag(q) == "p") for c in r if tag(c) == "tc"] for r in e if tag(r) == "tr"]

    def paragraph(e: ET.Element, style: str | None = None) -> None:
        ppr = next((x for x in e if tag(x) == "pPr"), None)
        sid = next((attr(x, "val") for x in (ppr if ppr is not None else ()) if tag(x) == "pStyle"), default)
        text, rest = "", []
        for k, v in runs(e):
            if k == "text":
                text += str(v)
            else:
                rest.append((k, v))
        if text.strip():
            add({"type": "text", "content": text, "style": style or (styles.get(sid, sid) if sid else None)})
        for k, v in rest:
            if k == "image":
                add(p.image(str(v)))
            else:
                block(v, "textbox")

    def block(e: ET.Element, style: str | None = None) -> None:
        for x in e:
            if tag(x) == "p":
                paragraph(x, style)
            elif tag(x) == "tbl":
                add(table(rows(x), {}))
            elif tag(x) in ("sdt", "sdtContent", "ins"):
                block(x, style)

    doc = p.xml("word/document.xml")
    body = next((x for x in (doc if doc is not None else ()) if tag(x) == "body"), None)
    if body is None:
        raise ValueError("no document body")
    block(body)
    return p.metadata(), out, p.images


# ---- xlsx


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref.upper()).group():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def xlsx(data: bytes) -> Parsed:
    """A table for each sheet, from its first to its last used row and column, formulas as their cached results; images with their anchor cell.

    A formula without a cached result and an empty cell are null. Empty sheets give no table.
    """
    p = Package(data)
    shared = p.xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter() if tag(t) == "t" and t is not None) for si in (shared if shared is not None else ())]
    rels = p.rels("xl/workbook.xml")
    book = p.xml("xl/workbook.xml")
    if book is None:
        raise ValueError("no workbook")
    out: list[dict] = []
    for s in (x for x in book.iter() if tag(x) == "sheet"):
        name, part = s.get("name"), rels.get(attr(s, "id") or "", ("", ""))[1]
        sheet = p.xml(part)
        if sheet is None:
            continue
        cells: dict[tuple[int, int], str] = {}
        row = 0
        for r in (x for x in sheet.iter() if tag(x) == "row"):
            row = int(r.get("r") or row + 1)
            col = 0
            for c in (x for x in r if tag(x) == "c"):
                col = column_number(c.get("r") or "") or col + 1
                kind, v = c.get("t"), next((x.text for x in c if tag(x) == "v"), None)
                if kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter() if tag(t) == "t")
                elif v is not None and kind == "s":
                    v = strings[int(v)] if int(v) < len(strings) else None
                elif v is not None and kind == "b":
                    v = "TRUE" if v == "1" else "FALSE"
                if v is not None and v != "":
                    cells[row, col] = v
        if cells:
            ys, xs = [k[0] for k in cells], [k[1] for k in cells]
            out.append(table([[cells.get((y, x)) for x in range(min(xs), max(xs) + 1)] for y in range(min(ys), max(ys) + 1)], {"sheet": name}))
        for kind, target in p.rels(part).values():
            drawing = p.xml(target) if kind == "drawing" else None
            pictures = p.rels(target) if drawing is not None else {}
            for a in drawing if drawing is not None else ():
                at = {tag(x): int(x.text or 0) for f in a if tag(f) == "from" for x in f}
                for b in (x for x in a.iter() if tag(x) == "blip"):
                    if (r := attr(b, "embed")) in pictures:
                        anchor = f"{column_letters(at['col'] + 1)}{at['row'] + 1}" if {"col", "row"} <= at.keys() else None
                        out.append(p.image(pictures[r][1]) | {"location": {"sheet": name, "anchor": anchor}})
    return p.metadata(), out, p.images


# ---- pptx


def pptx(data: bytes) -> Parsed:
    """Text frames, tables and images of each slide in order, then its speaker notes as text of style notes."""
    p = Package(data)
    show = p.xml("ppt/presentation.xml")
    if show is None:
        raise ValueError("no presentation")
    rels = p.rels("ppt/presentation.xml")
    order = [rels[attr(x, "id") or ""][1] for x in show.iter() if tag(x) == "sldId" and attr(x, "id") in rels]
    out: list[dict] = []

    def frame(e: ET.Element) -> str:
        lines = []
        for q in (x for x in e.iter() if tag(x) == "p"):
            lines.append("".join((t.text or "") if tag(t) == "t" else "\n" for t in q.iter() if tag(t) in ("t", "br")))
        return "\n".join(lines).strip("\n")

    def shapes(e: ET.Element, slide: int, rel: dict[str, tuple[str, str]]) -> None:
        for x in e:
            t = tag(x)
            name = next((y.get("name") for y in x.iter() if tag(y) == "cNvPr"), None)
            loc = {"slide": slide, "shape_name": name}
            if t == "sp":
                body = next((y for y in x if tag(y) == "txBody"), None)
                if body is not None and (s := frame(body)).strip():
                    out.append({"type": "text", "content": s, "location": loc})
            elif t == "grpSp":
                shapes(x, slide, rel)
            elif t == "pic":
                for b in (y for y in x.iter() if tag(y) == "blip"):
                    if (r := attr(b, "embed")) in rel:
                        out.append(p.image(rel[r][1]) | {"location": loc})
            elif t == "graphicFrame":
                for tbl in (y for y in x.iter() if tag(y) == "tbl"):
                    out.append(table([[frame(c) for c in r if tag(c) == "tc"] for r in tbl if tag(r) == "tr"], loc))

    for n, part in enumerate(order, 1):
        slide = p.xml(part)
        rel = p.rels(part)
        for tree in (x for x in (slide if slide is not None else ET.Element("x")).iter() if tag(x) == "spTree"):
            shapes(tree, n, rel)
        for kind, target in rel.values():
            notes = p.xml(target) if kind == "notesSlide" else None
            for sp in (x for x in (notes.iter() if notes is not None else ()) if tag(x) == "sp"):
                holder = next((y.get("type") for y in sp.iter() if tag(y) == "ph"), None)
                body = next((y for y in sp if tag(y) == "txBody"), None)
                if holder == "body" and body is not None and (s := frame(body)).strip():
                    out.append({"type": "text", "content": s, "style": "notes", "location": {"slide": n, "shape_name": next((y.get("name") for y in sp.iter() if tag(y) == "cNvPr"), None)}})
    return p.metadata(), out, p.images
