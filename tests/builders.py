"""Office and PDF files made in the tests; nothing binary is in the repository."""

import io
import struct
import zipfile
import zlib

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def png(w=60, h=40):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


def pack(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(zipfile.ZipInfo(k, (2020, 1, 1, 0, 0, 0)), v)
    return b.getvalue()


def rels(*items):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"


CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t"><dc:title>月次報告</dc:title><dc:creator>ana</dc:creator><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>'


def docx():
    body = (
        '<w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr><w:r><w:t>月次</w:t></w:r><w:r><w:t>報告書</w:t></w:r></w:p><w:p/>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>項目</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>4月</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>売上</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        '<w:p><w:r><w:t>before</w:t><w:tab/><w:t>after</w:t></w:r><w:r><w:drawing><a:blip r:embed="r5"/></w:drawing></w:r></w:p>'
        "<w:p><w:r><mc:AlternateContent><mc:Choice><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></mc:Fallback></mc:AlternateContent><w:t>outer</w:t></w:r></w:p>"
    )
    styles = f'<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="a"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return pack({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/_rels/document.xml.rels": rels(("r5", "image", "media/i.png")), "word/media/i.png": png(), "docProps/core.xml": CORE})


def xlsx():
    s = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    one = '<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>100</v></c></row><row r="4"><c r="B4" t="inlineStr"><is><t>in</t></is></c><c r="C4"><f>C2+10</f><v>110</v></c><c r="D4"><f>1/0</f></c><c r="E4" t="b"><v>1</v></c></row></sheetData></worksheet>'
    draw = f'<d {s} xmlns:a="a"><twoCellAnchor><from><col>26</col><row>4</row></from><pic><a:blip r:embed="p1"/></pic></twoCellAnchor></d>'
    return pack({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="売上" r:id="r1"/><sheet name="empty" r:id="r2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/s1.xml"), ("r2", "worksheet", "/xl/worksheets/s2.xml")),
        "xl/worksheets/s1.xml": one, "xl/worksheets/s2.xml": "<worksheet><sheetData/></worksheet>", "xl/sharedStrings.xml": "<sst><si><r><t>項</t></r><r><t>目</t></r></si></sst>",
        "xl/worksheets/_rels/s1.xml.rels": rels(("d1", "drawing", "../drawings/d1.xml")), "xl/drawings/d1.xml": draw, "xl/drawings/_rels/d1.xml.rels": rels(("p1", "image", "../media/x.png")), "xl/media/x.png": png(7, 9),
    })


def pptx():
    ns = 'xmlns:p="p" xmlns:a="a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sp = lambda name, text, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in text.split("|")) + "</p:txBody></p:sp>"
    tbl = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="3" name="Table 3"/></p:nvGraphicFramePr><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p/></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="4" name="Picture 4"/></p:nvPicPr><a:blip r:embed="i1"/></p:pic>'
    tree = lambda x: f"<p:sld {ns}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:sld>"
    return pack({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/s1.xml"), ("r2", "slide", "slides/s2.xml")),
        "ppt/slides/s2.xml": tree(sp("Title 1", "First|Line")), "ppt/slides/s1.xml": tree(f"<p:grpSp>{sp('Box 2', 'in group')}</p:grpSp>{tbl}{pic}"),
        "ppt/slides/_rels/s1.xml.rels": rels(("i1", "image", "../media/a.png"), ("n1", "notesSlide", "../notesSlides/n1.xml")), "ppt/media/a.png": png(3, 5),
        "ppt/notesSlides/n1.xml": f"<p:notes {ns}><p:cSld><p:spTree>{sp('Notes', 'say this', '<p:ph type=&quot;body&quot;/>'.replace('&quot;', chr(34)))}{sp('Number', '7', '<p:ph type=&quot;sldNum&quot;/>'.replace('&quot;', chr(34)))}</p:spTree></p:cSld></p:notes>",
    })


def pdf(compress=False):
    page = (
        b"BT /F1 12 Tf 72 720 Td (First line) Tj 0 -14 Td [(sec) -20 (ond line)] TJ 0 -60 Td (Next \\(block\\)) Tj ET "
        b"72 500 200 40 re S 72 520 m 272 520 l S 172 500 m 172 540 l S BT /F1 10 Tf 80 525 Td (Item) Tj 100 0 Td (Q1) Tj -100 -20 Td (Sales) Tj 100 0 Td (100) Tj ET "
        b"q 60 0 0 40 300 300 cm /I1 Do Q"
    )
    raw, extra = (zlib.compress(page), b"/Filter /FlateDecode ") if compress else (page, b"")
    image = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x28\x00\x3c\x01\x01\x11\x00\xff\xd9"
    objs = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /I1 6 0 R >> >> >>",
        b"<< " + extra + b"/Length %d >>\nstream\n" % len(raw) + raw + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        b"<< /Type /XObject /Subtype /Image /Width 60 /Height 40 /Filter /DCTDecode /Length %d >>\nstream\n" % len(image) + image + b"\nendstream", b"<< /Title (Report) /Author <FEFF00E9> >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in enumerate(objs, 1)) + b"trailer << /Root 1 0 R /Info 7 0 R >>\n%%EOF"
