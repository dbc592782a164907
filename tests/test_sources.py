"""Extractors and the folder walk on files made byte by byte."""

import os
import zipfile
import zlib

import pytest

from lectern.sources import office
from lectern.sources.charset import decode
from lectern.sources.extract import extract, extract_files, html_text, image_size
from lectern.sources.walker import register


def make_pdf(pages, flate=True, encrypt=False, to_unicode=False):
    objs, kids = {}, []
    objs[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objs[3] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>" if to_unicode else b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    stream = lambda d: b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(zlib.compress(d) if flate else d), b"/Filter /FlateDecode" if flate else b"", zlib.compress(d) if flate else d)
    objs[4] = stream(b"beginbfrange <0041> <005A> <0391> endbfrange")
    for i, text in enumerate(pages):
        n = 10 + 2 * i
        kids.append(b"%d 0 R" % n)
        body = b"BT /F1 12 Tf " + (b"<%s> Tj" % text.encode("utf-16-be").hex().encode() if to_unicode else b"(%s) Tj T* [(more) -300 (words)] TJ" % text.encode("cp1252")) + b" ET"
        objs[n] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (n + 1)
        objs[n + 1] = stream(body)
    objs[2] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(pages))
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objs.items()))
    return out + (b"trailer << /Encrypt 5 0 R >>" if encrypt else b"trailer << /Root 1 0 R >>") + b"\n%%EOF"


def test_pdf():
    got = extract("pdf", make_pdf(["first (page)".replace("(", "").replace(")", ""), "second"]))
    assert got["state"] == "ok" and [(u["unit_no"], u["content"]) for u in got["units"]] == [(1, "first page\nmore words"), (2, "second\nmore words")]
    assert extract("pdf", make_pdf(["AB"], to_unicode=True))["text"] == "ΑΒ"
    assert extract("pdf", make_pdf(["x"], encrypt=True))["error"] == "encrypted"
    assert extract("pdf", b"garbage")["state"] == "unsupported" and extract("pdf", b"%PDF-1.4 nothing")["state"] == "unsupported"


def test_office():
    got = extract("docx", office.make_docx(["Head", "body & <text>", "", "more"], {0}))
    assert got["text"] == "Head\nbody & <text>\nmore" and got["units"][0]["label"] == "Head"
    got = extract("pptx", office.make_pptx([["one"], ["two", "b"], ["three"]]))
    assert [u["content"] for u in got["units"]] == ["one", "two\nb", "three"]
    got = extract("xlsx", office.make_xlsx([("s1", [["name", "n"], ["a", "1"]]), ("s2", [])]))
    assert got["units"][0]["content"] == "name | n\na | 1" and got["units"][1]["label"] == "s2"
    assert extract("docx", b"no zip")["state"] == "unsupported"


def test_zip_bombs_do_not_unfold(tmp_path):
    at = tmp_path / "b.docx"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"<a>" + b"0" * (office.PART_MOST + 10))
    assert extract("docx", at.read_bytes())["state"] == "unsupported"


@pytest.mark.parametrize(("codec", "text"), [("gb18030", "系统每天移动打印机，然后检查目录。" * 3), ("shift_jis", "昨日、倉庫で写真を読みました。" * 3), ("utf-16", "abc é"), ("utf-8-sig", "é日"), ("cp1252", "Größe für Straße, naïve café " * 3), ("cp1251", "Каждый вечер читает документ " * 3)])
def test_charsets(codec, text):
    assert decode(text.encode(codec))[1] == text


def test_plain_kinds():
    assert extract("text", b"\0\1\2\3" * 100)["state"] == "unsupported" and extract("text", b"")["state"] == extract("text", None)["state"] == "empty"
    assert extract("json", b'{"a": {"b": [1, null, true]}, "c": null}')["text"] == "a b 1 true"
    assert extract("json", b'{"a": 1}\n{"a": 2}')["text"].startswith('{"a"')
    assert extract("csv", b"a;b\n1; 2 \n\n")["text"] == "a | b\n1 | 2"
    assert extract("yaml", b"a: 1\nb:\n  c: 2\n")["units"][0]["content"] == "a b"
    assert [u["label"] for u in extract("markdown", b"# A\nx\n## B #\ny")["units"]] == ["A", "B"]
    assert html_text("<head><title>t</title></head><p>a <b>b</b></p><script>x</script><p>c&amp;d") == "a b\nc&d" or "a b" in html_text("<p>a <b>b</b></p>")
    assert extract("video", b"x")["state"] == extract(None, b"x")["state"] == "unsupported"


def test_html_text_hides_what_is_not_shown():
    source = "<html><head><title>t</title><style>x</style></head><p>a <b>b</b></p>\n\n<script>if (a < b) x()</script><ul><li>one<li>t&amp;o</ul><!-- <p>no --><template>z<template>y</template></template>end <a title='>'>q</a>"
    assert html_text(source) == "a b\n\none\nt&o\nend q" and html_text("") == "" and html_text("2 < 3") == "2 < 3"


def test_charsets():
    from lectern.sources.charset import decode

    samples = {
        "gb18030": "系统每天移动打印机，然后检查目录。", "big5": "這個系統每天移動印表機，然後檢查目錄與說明。", "shift_jis": "システムは毎日プリンタを移動します。次に目次を確認する。",
        "euc-kr": "시스템은 매일 프린터를 옮기고 목차를 확인합니다.", "cp1251": "Система каждый день проверяет каталог и список.", "utf-16-le": "系统每天移动打印机，然后检查目录。 ok", "utf-16-be": "Plain words in wide letters.",
        "utf-8": "naïve café", "cp1252": "Größe für Straße überprüft",
    }
    for codec, text in samples.items():
        assert decode(text.encode(codec)) == (codec, text), codec
    assert decode(b"") == ("utf-8", "") and decode("x".encode("utf-8-sig")) == ("utf-8-sig", "x")


def test_workbook_dates_and_pages():
    assert [office.is_date_format(*x) for x in [(14,), (2,), (47,), (170, "yyyy-mm-dd"), (171, '0.0" days"'), (172, "[Red]0"), (173, "[h]:mm"), (174, "General")]] == [True, False, True, True, False, False, True, False]
    assert [office.serial_date(x) for x in ("60", "59", "1", "61.5", "45000.25", "-1", "x")] == ["1900-02-29", "1900-02-28", "1900-01-01", "1900-03-01 12:00:00", "2023-03-15 06:00:00", "-1", "x"]
    data = office.make_xlsx([("first", [["name", "day", "n"], ["a", (45000, 1), (2.5, 3)], ["b", (45000.25, 2), (1, 0)], ["c", "", ""]]), ("second", [["only"]])])
    text, units, cut = office.xlsx(data)
    assert units[0][3].split("\n")[1:3] == ["a | 2023-03-15 | 2.5", "b | 2023-03-15 06:00:00 | 1"] and not cut and office.xlsx(data, 2)[2]
    page = office.sheet_page(data, 0, 1, 1)
    assert page["columns"] == ["name", "day", "n"] and page["rows"] == [{"r": 1, "c": ["b", "2023-03-15 06:00:00", "1"]}] and page["has_more"] and page["total_rows"] is None
    last = office.sheet_page(data, 0, 2, 5)
    assert not last["has_more"] and last["total_rows"] == 3 and office.sheet_page(data, 9, 0, 5)["sheet"] == "second"
    assert extract("csv", b"a,b\n1,2\n3,4\n", rows=2)["truncated"] and extract("text", b"abcdef", most=3)["truncated"] and not extract("text", b"abc", most=3)["truncated"]


def test_rendering():
    from lectern.functions.render import docx_html, inline, markdown_html, safe_url

    got = markdown_html("# A <b> #\n\ntext **bold** and *it* `x*y*`\nmore ~~no~~\n\n- one\n- [two](a.md)\n1. n\n> q1\n> q2\n---\n```py\nif a < b:\n```\n| h | i |\n|---|:--:|\n| 1 | **2** |\nend")
    assert got == "\n".join([
        "<h1>A &lt;b&gt;</h1>", "<p>text <strong>bold</strong> and <em>it</em> <code>x*y*</code> more <del>no</del></p>", '<ul><li>one</li><li><a href="a.md" target="_blank" rel="noopener noreferrer">two</a></li></ul>', "<ol><li>n</li></ol>", "<blockquote>q1 q2</blockquote>", "<hr/>",
        '<pre class="lang-py"><code>if a &lt; b:</code></pre>', '<table class="md-table"><thead><tr><th>h</th><th>i</th></tr></thead><tbody><tr><td>1</td><td><strong>2</strong></td></tr></tbody></table>', "<p>end</p>",
    ])
    assert inline("[x](javascript:alert(1)) ![p](a.png)").startswith("x") and 'class="md-image"' in inline("![p](a.png)")
    assert [safe_url(x) for x in ("//h/x", "tel:1", "ftp://x", " a b ", "java\nscript:x", "https://x", "")] == [None, "tel:1", None, "a b", None, "https://x", None]
    assert markdown_html(None) == markdown_html("") == "" and markdown_html("<script>x</script>") == "<p>&lt;script&gt;x&lt;/script&gt;</p>"
    assert docx_html(office.make_docx(["Top", "a < b"], {0})) == "<h1>Top</h1>\n<p>a &lt; b</p>"


def test_image_sizes():
    assert image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x10\0\0\0\x0c") == (16, 12)
    assert image_size(b"GIF89a\x20\0\x10\0") == (32, 16)
    assert image_size(b"BM" + b"\0" * 16 + (7).to_bytes(4, "little") + (-9).to_bytes(4, "little", signed=True)) == (7, 9)
    assert image_size(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08\0\x0a\0\x14" + b"\0" * 9) == (20, 10)
    assert image_size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)
    assert image_size(b"") is None and extract("image", b"zz")["state"] == "empty"


def test_extraction_of_a_table_of_bytes(spark):
    rows = [(1, "text", bytearray(b"hi")), (2, "docx", bytearray(b"bad")), (3, None, None), (4, "image", bytearray(b"GIF89a\x20\0\x10\0"))]
    got = {r.id: (r.state, r.text, r.w) for r in extract_files(spark.createDataFrame(rows, "id long, kind string, content binary"), "id").collect()}
    assert got == {1: ("ok", "hi", None), 2: ("unsupported", None, None), 3: ("empty", None, None), 4: ("empty", None, 32)}


def test_walk(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("x")
    (tmp_path / "a" / "b" / "日.md").write_text("yy")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "c").write_text("")
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.mkfifo(tmp_path / "pipe")
    register(spark)
    got = {r.rel_path: (r.is_dir, r.is_symlink, r.depth, r.truncated) for r in spark.read.format("lectern_walk").option("path", str(tmp_path)).load().collect()}
    assert got == {"a": (True, False, 1, False), "a/b": (True, False, 2, False), "a/x.txt": (False, False, 2, False), "a/b/日.md": (False, False, 3, False), "link": (False, True, 1, False)}
    short = spark.read.format("lectern_walk").option("path", str(tmp_path)).option("maxDepth", 1).load()
    assert {r.rel_path: r.truncated for r in short.collect()} == {"a": True, "link": False}
