"""Writers of Office Open XML and PDF files with the standard library: elements back into a file that the readers read alike.

They write what the readers know - text with styles, tables, images with their place, notes, metadata - and serve exports of
documents that were generated here. Characters that XML can't hold are left out.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable
from xml.sax.saxutils import escape, quoteattr

from paperloom.sources.ooxml import column_letters, internal_style

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/"
NS = f'xmlns:w="{MAIN}wordprocessingml/2006/main" xmlns:r="{OFFICE}" xmlns:a="{MAIN}drawingml/2006/main" xmlns:p="{MAIN}presentationml/2006/main"'
NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
NUMBER = re.compile(r"-?\d{1,15}(?:\.\d{1,9})?")
#: Keywords of the text chunks that embedded() reads: text and tables that an image shows.
TEXT, TABLES = "ocr", "tables"


def xml(s: str | None) -> str:
    return escape(NO_XML.sub("", s or ""), {"\r": "&#13;"})


def pack(parts: dict[str, str | bytes]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(zipfile.ZipInfo(k, (2020, 1, 1, 0, 0, 0)), v if isinstance(v, bytes) else v.encode())
    return b.getvalue()


def rels(items: Iterable[tuple[str, str, str]]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"


def core(meta: dict | None) -> str:
    names = {"title": "dc:title", "author": "dc:creator", "created": "dcterms:created", "modified": "dcterms:modified"}
    return '<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t">' + "".join(f"<{n}>{xml(v)}</{n}>" for k, n in names.items() if (v := (meta or {}).get(k))) + "</cp:coreProperties>"


def png(w: int | None, h: int | None, texts: dict[str, str] | None = None) -> bytes:
    """An image with a header of the given size, no picture, and international text chunks."""

    def chunk(k: bytes, d: bytes) -> bytes:
        return struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))

    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w or 1, h or 1, 8, 0, 0, 0, 0))
    for k, v in (texts or {}).items():
        out += chunk(b"iTXt", k.encode() + b"\0\1\0\0\0" + zlib.compress(v.encode("utf-8", "replace")))
    return out + chunk(b"IEND", b"")


def jpeg(w: int | None, h: int | None) -> bytes:
    """The frame header of an image of the given size."""
    return b"\xff\xd8\xff\xc0\x00\x0b\x08" + struct.pack(">HH", h or 1, w or 1) + b"\x01\x01\x11\x00\xff\xd9"


def chunks(data: bytes) -> dict[str, str]:
    """International text chunks of a PNG file by keyword; a damaged one is left out."""
    out, i = {}, 8
    while data[:8] == b"\x89PNG\r\n\x1a\n" and i + 8 <= len(data):
        n, kind = struct.unpack(">I", data[i : i + 4])[0], data[i + 4 : i + 8]
        if kind == b"iTXt":
            key, _, rest = data[i + 8 : i + 8 + n].partition(b"\0")
            body = rest[2:].split(b"\0", 2)
            try:
                out[key.decode("latin-1")] = (zlib.decompress(body[2]) if rest[:1] == b"\1" else body[2]).decode("utf-8", "replace")
            except (IndexError, zlib.error):
                pass
        i += 12 + n
    return out


def embedded_text(data: bytes, _lang: str) -> str | None:
    """An OCR backend for images that carry their text in a text chunk, as scanners' software writes it."""
    return chunks(data).get(TEXT)


def embedded_tables(data: bytes) -> list[tuple[list[list[str]], list[float]]]:
    """An image-table backend for images that carry their tables, as JSON [[rows, box], ...], in a text chunk."""
    try:
        return [(rows, box) for rows, box in json.loads(chunks(data).get(TABLES) or "[]")]
    except (ValueError, TypeError):
        return []


def image(e: dict) -> bytes:
    texts = {TEXT: e["ocr_text"]} if e.get("ocr_text") is not None else {}
    if e.get("tables"):
        texts[TABLES] = json.dumps([[t["rows"], t["box"]] for t in e["tables"]], ensure_ascii=False)
    return png(e.get("width"), e.get("height"), texts)


def where(e: dict) -> dict:
    return e.get("location") or {}


# ---- docx


def docx(meta: dict | None, elements: list[dict]) -> bytes:
    """Paragraphs with their styles, tables, inline images and, for the style textbox, text boxes."""
    styles = {s: f"s{i}" for i, s in enumerate(sorted({e["style"] for e in elements if e.get("style") and e["style"] != "textbox"}))}
    body, media = [], []

    def run(s: str | None) -> str:
        parts = {"\n": "<w:br/>", "\t": "<w:tab/>"}
        return "<w:r>" + "".join(parts.get(x) or f'<w:t xml:space="preserve">{xml(x)}</w:t>' for x in re.split("([\n\t])", s or "") if x) + "</w:r>"

    def paragraph(s: str | None, style: str | None = None) -> str:
        return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{styles[style]}"/></w:pPr>' if style in styles else "") + run(s) + "</w:p>"

    for e in elements:
        if e["type"] == "text" and e.get("style") == "textbox":
            body.append(f"<w:p><w:r><w:txbxContent>{paragraph(e['content'])}</w:txbxContent></w:r></w:p>")
        elif e["type"] == "text":
            body.append(paragraph(e["content"], e.get("style")))
        elif e["type"] == "table" and e.get("rows"):
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r or ()) + "</w:tr>" for r in e["rows"]) + "</w:tbl>")
        elif e["type"] == "image":
            media.append(image(e))
            body.append(f'<w:p><w:r><w:drawing><a:blip r:embed="i{len(media)}"/></w:drawing></w:r></w:p>')
    names = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val={quoteattr(NO_XML.sub("", internal_style(s)))}/></w:style>' for s, i in styles.items())
    return pack({
        "word/document.xml": f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>", "word/styles.xml": f"<w:styles {NS}>{names}</w:styles>",
        "word/_rels/document.xml.rels": rels((f"i{n}", "image", f"media/{n}.png") for n in range(1, len(media) + 1)), "docProps/core.xml": core(meta),
    } | {f"word/media/{n}.png": b for n, b in enumerate(media, 1)})


# ---- xlsx


def xlsx(meta: dict | None, elements: list[dict]) -> bytes:
    """A sheet for each table and image, numbers as formulas with their cached result, other cells as shared strings; text elements have no place."""
    parts: dict[str, str | bytes] = {"docProps/core.xml": core(meta)}
    strings: dict[str, int] = {}
    sheets, own = [], []
    for e in (e for e in elements if e["type"] == "image" or e["type"] == "table" and e.get("rows")):
        n = len(sheets) + 1
        sheets.append(f'<sheet name={quoteattr(NO_XML.sub("", where(e).get("sheet") or f"unnamed {n}"))} sheetId="{n}" r:id="r{n}"/>')
        own.append((f"r{n}", "worksheet", f"worksheets/s{n}.xml"))
        rows = []
        for y, r in enumerate(e.get("rows") or (), 1) if e["type"] == "table" else ():
            cells = ""
            for x, v in enumerate(r or (), 1):
                if v:
                    ref = f"{column_letters(x)}{y}"
                    cells += f'<c r="{ref}"><f>0+{v}</f><v>{v}</v></c>' if NUMBER.fullmatch(v) else f'<c r="{ref}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
            rows.append(f'<row r="{y}">{cells}</row>')
        parts[f"xl/worksheets/s{n}.xml"] = f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>"
        if e["type"] == "image":
            m = re.fullmatch(r"([A-Z]+)(\d+)", where(e).get("anchor") or "")
            col = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(m.group(1)))) if m else 0
            at = f"<from><col>{col - 1}</col><row>{int(m.group(2)) - 1}</row></from>" if m else ""
            parts |= {
                f"xl/worksheets/_rels/s{n}.xml.rels": rels([("d", "drawing", f"../drawings/d{n}.xml")]), f"xl/drawings/d{n}.xml": f'<d {NS}><twoCellAnchor>{at}<pic><a:blip r:embed="p"/></pic></twoCellAnchor></d>',
                f"xl/drawings/_rels/d{n}.xml.rels": rels([("p", "image", f"../media/{n}.png")]), f"xl/media/{n}.png": image(e),
            }
    shared = "".join(f'<si><t xml:space="preserve">{xml(s)}</t></si>' for s in strings)
    return pack(parts | {"xl/workbook.xml": f"<workbook {NS}><sheets>{''.join(sheets)}</sheets></workbook>", "xl/_rels/workbook.xml.rels": rels(own), "xl/sharedStrings.xml": f"<sst>{shared}</sst>"})


# ---- pptx


def pptx(meta: dict | None, elements: list[dict]) -> bytes:
    """Shapes on the slides that their location names (1 where it names none); text of the style notes becomes speaker notes."""
    slides: dict[int, list[str]] = {}
    notes: dict[int, list[str]] = {}
    media: dict[int, list[bytes]] = {}

    def frame(s: str | None) -> str:
        return "<a:p>" + "</a:p><a:p>".join(f'<a:r><a:t>{xml(x)}</a:t></a:r>' for x in (s or "").split("\n")) + "</a:p>"

    def named(kind: str, e: dict, holder: str = "") -> str:
        name = where(e).get("shape_name")
        return f"<p:nv{kind}><p:cNvPr id=\"1\"{'' if name is None else ' name=' + quoteattr(NO_XML.sub('', name))}/><p:nvPr>{holder}</p:nvPr></p:nv{kind}>"

    for e in elements:
        n = max(1, where(e).get("slide") or 1)
        own = slides.setdefault(n, [])
        if e["type"] == "text" and e.get("style") == "notes":
            notes.setdefault(n, []).append(f"<p:sp>{named('SpPr', e, '<p:ph type=\"body\"/>')}<p:txBody>{frame(e['content'])}</p:txBody></p:sp>")
        elif e["type"] == "text":
            own.append(f"<p:sp>{named('SpPr', e)}<p:txBody>{frame(e['content'])}</p:txBody></p:sp>")
        elif e["type"] == "table" and e.get("rows"):
            rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{frame(c)}</a:txBody></a:tc>" for c in r or ()) + "</a:tr>" for r in e["rows"])
            own.append(f"<p:graphicFrame>{named('GraphicFramePr', e)}<a:tbl>{rows}</a:tbl></p:graphicFrame>")
        elif e["type"] == "image":
            media.setdefault(n, []).append(image(e))
            own.append(f'<p:pic>{named("PicPr", e)}<a:blip r:embed="i{len(media[n])}"/></p:pic>')
    last = max(slides, default=0)
    tree = lambda kind, x: f"<p:{kind} {NS}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:{kind}>"
    parts: dict[str, str | bytes] = {
        "docProps/core.xml": core(meta), "ppt/presentation.xml": f"<p:presentation {NS}><p:sldIdLst>" + "".join(f'<p:sldId r:id="r{n}"/>' for n in range(1, last + 1)) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels((f"r{n}", "slide", f"slides/s{n}.xml") for n in range(1, last + 1)),
    }
    for n in range(1, last + 1):
        own = [(f"i{k}", "image", f"../media/{n}_{k}.png") for k in range(1, len(media.get(n, ())) + 1)]
        parts[f"ppt/slides/s{n}.xml"] = tree("sld", "".join(slides.get(n, ())))
        parts |= {f"ppt/media/{n}_{k}.png": b for k, b in enumerate(media.get(n, ()), 1)}
        if n in notes:
            own.append(("n", "notesSlide", f"../notesSlides/n{n}.xml"))
            parts[f"ppt/notesSlides/n{n}.xml"] = tree("notes", "".join(notes[n]))
        parts[f"ppt/slides/_rels/s{n}.xml.rels"] = rels(own)
    return pack(parts)


# ---- pdf

SIZE, LEADING, GAP, MARGIN = 10, 14, 40, 50


def pdf(meta: dict | None, elements: list[dict]) -> bytes:
    """Text lines, ruled tables and images from the top of the pages that their location names (1 where it names none); pages are as high as they need to be."""
    codes: dict[str, int] = {}
    pages: dict[int, list[dict]] = {}
    for e in elements:
        pages.setdefault(max(1, where(e).get("page") or 1), []).append(e)

    def show(x: float, y: float, s: str) -> str:
        return f"1 0 0 1 {x} {-y} Tm <{''.join(f'{codes.setdefault(c, len(codes) + 1):04x}' for c in s)}> Tj"

    def lines(s: str | None) -> list[str]:
        return [x for x in (s or "").replace("\r", "").split("\n") if x.strip()]

    def width(s: str) -> float:
        return sum(SIZE if ord(c) > 0x2E80 else SIZE / 2 for c in s)

    drawn, images = [], []
    for n in range(1, max(pages, default=1) + 1):
        y, wide, text, rule, pics = float(MARGIN), 500.0, [], [], []
        for e in pages.get(n, ()):
            if e["type"] == "text":
                for s in lines(e["content"]):
                    text.append(show(MARGIN, y, s))
                    y += LEADING
                    wide = max(wide, width(s))
            elif e["type"] == "table" and e.get("rows") and any(e["rows"]):
                cells = [[lines(c) for c in r or ()] for r in e["rows"]]
                k = max(map(len, cells))
                xs = [float(MARGIN)]
                for i in range(k):
                    xs.append(xs[-1] + 20 + max([width(s) for r in cells if i < len(r) for s in r[i]] or [20]))
                top = y
                rule.append(f"{xs[0]} {-y} m {xs[-1]} {-y} l S")
                for r in cells:
                    for i, c in enumerate(r):
                        text += [show(xs[i] + 8, y + 4 + SIZE + j * LEADING, s) for j, s in enumerate(c)]
                    y += 10 + LEADING * max([len(c) for c in r] or [1])
                    rule.append(f"{xs[0]} {-y} m {xs[-1]} {-y} l S")
                rule += [f"{x} {-top} m {x} {-y} l S" for x in xs]
                wide, y = max(wide, xs[-1]), y + LEADING
            elif e["type"] == "image":
                images.append((e.get("width"), e.get("height")))
                pics.append((len(images), f"q 60 0 0 40 {MARGIN} {-(y + 40)} cm /I{len(images)} Do Q"))
                y += 54
            y += GAP
        drawn.append((wide + 2 * MARGIN, y + MARGIN, " ".join([*rule, "BT /F1 10 Tf", *text, "ET", *(p for _i, p in pics)]), [i for i, _p in pics]))
    # objects: 1 catalog, 2 pages, 3 font, 4 its map, 5 info, then images, then a page and its contents each
    objs: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>"]
    base = 6 + len(images)

    def stream(head: str, data: bytes) -> bytes:
        return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"

    objs.append(f"<< /Type /Pages /Count {len(drawn)} /Kids [{' '.join(f'{base + 2 * i} 0 R' for i in range(len(drawn)))}] >>".encode())
    objs.append(b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 4 0 R >>")
    table = "\n".join(f"<{k:04x}> <{c.encode('utf-16-be', 'replace').hex()}>" for c, k in codes.items())
    objs.append(stream("/Filter /FlateDecode", zlib.compress(f"{len(codes)} beginbfchar\n{table}\nendbfchar".encode())))
    names = {"title": "Title", "author": "Author", "created": "CreationDate", "modified": "ModDate"}
    objs.append(("<< " + " ".join(f"/{n} <FEFF{v.encode('utf-16-be', 'replace').hex()}>" for k, n in names.items() if (v := (meta or {}).get(k))) + " >>").encode())
    objs += [stream(f"/Type /XObject /Subtype /Image /Width {w or 1} /Height {h or 1} /Filter /DCTDecode", jpeg(w, h)) for w, h in images]
    for i, (w, h, content, own) in enumerate(drawn):
        pics = " ".join(f"/I{k} {5 + k} 0 R" for k in own)
        objs.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 {-h} {w} 0] /Contents {base + 2 * i + 1} 0 R /Resources << /Font << /F1 3 0 R >> /XObject << {pics} >> >> >>".encode())
        objs.append(stream("/Filter /FlateDecode", zlib.compress(content.encode())))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in enumerate(objs, 1)) + b"trailer << /Root 1 0 R /Info 5 0 R >>\n%%EOF"


WRITERS: dict[str, Callable[[dict | None, list[dict]], bytes]] = {"docx": docx, "xlsx": xlsx, "xlsm": xlsx, "pptx": pptx, "pdf": pdf}
