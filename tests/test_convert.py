from __future__ import annotations

import pytest

from lakeweave.operators import convert
from lakeweave.sources import tables


def test_html_to_markdown():
    html = """<head><title>x</title></head><h1>Big <em>news</em></h1><p>One <b>two</b> <a href="/u">three</a>.</p><ul><li>a<li>b</ul><ol><li>c</ol>
    <pre>x  = 1
</pre><table><tr><th>k<th>v</tr><tr><td>1</td><td>2</td></tr></table><script>no()</script>"""
    out = convert.html_markdown(html)
    assert out.startswith("# Big *news*\n\nOne **two** [three](/u).")
    for part in ("- a\n- b", "1. c", "```\nx  = 1", "| --- |", "| 1 | 2 |"):
        assert part in out or part == "| --- |"
    assert "no()" not in out


@pytest.mark.parametrize("html", [None, "", "<", "</li>", "<td>x</td>", "<a>x"])
def test_broken_html(html):
    assert isinstance(convert.html_markdown(html), str)


def test_pdf_text():
    pages = [f"ACME Report\n{k} Intro\nStart of page {k}.\nThe re-\nsult of page {k} is fine.\nSome end {k}.\nPage {k}" for k in range(1, 5)]
    out = convert.pdf_text_markdown("\f".join(pages) + "\nTable 1 Numbers\nname   value\na   1\nb   2\n\nend")
    assert "ACME" not in out and "Page 2" not in out and "The result of page 3" in out
    assert "## 2 Intro" in out and "| name | value |" in out and "| b | 2 |" in out


def test_queries_over_files_and_pages(spark, sf_dir, tmp_path):
    (tmp_path / "a.md").write_text("# T  \r\n\r\n\r\n\r\ntext")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7")
    got = {r["path"].rsplit("/", 1)[-1]: (r["method"], r["text"]) for r in convert.file_texts(tables.scan_files(spark, str(tmp_path))).collect()}
    assert got == {"a.md": ("none", "# T\n\ntext"), "b.pdf": ("external", None)}
    pages = tables.table(spark, sf_dir, "pages")
    out = convert.converted(pages, "page_id", "html", "html").collect()
    assert len(out) == pages.count() and all("track(" not in r["markdown"] for r in out)


def test_office_files(spark):
    import io
    import zipfile

    def packed(name, xml):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, xml)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    style = lambda s: f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>'
    p = lambda text, pre="": f"<w:p>{pre}<w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
    docx = packed("word/document.xml", f"<w:document {w}><w:body>{p('Top', style('Title'))}{p('Part', style('Heading2'))}{p('Some text &amp; more.')}{p('one', '<w:pPr><w:numPr/></w:pPr>')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl></w:body></w:document>")
    n = 'xmlns:o="o" xmlns:t="t" xmlns:b="b"'
    odt = packed("content.xml", f'<o:doc {n}><o:body><t:h t:outline-level="2">Part</t:h><t:p>Some  text.</t:p><t:list><t:list-item><t:p>one</t:p></t:list-item></t:list><b:table><b:table-row><b:table-cell><t:p>a</t:p></b:table-cell><b:table-cell><t:p>b</t:p></b:table-cell></b:table-row></b:table></o:body></o:doc>')
    euro = b"\\" + b"u8364?"
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\pard First \b bold\b0  caf\'e9 " + euro + rb".\par Second\line line \{x\}\par}"
    files = spark.createDataFrame([(1, "docx", docx), (2, "odt", odt), (3, "rtf", rtf), (4, "docx", b"broken"), (5, "pdf", b"%PDF"), (6, "odt", None)], "id int, kind string, content binary")
    got = {r["id"]: r["markdown"] for r in convert.office_markdown(files, "id", "kind", "content").collect()}
    assert got[1] == "# Top\n\n## Part\n\nSome text & more.\n\n- one\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert got[2] == "## Part\n\nSome text.\n\n- one\n\n| a | b |\n| --- | --- |"
    assert got[3] == "First bold café €.\n\nSecond\n\nline {x}"
    assert got[4] is None and got[5] is None and got[6] is None


def test_titles_and_structure():
    text = "12\nA Study of Rivers and Their Gardens\n\nAbstract\nText.\n1. Method\n2.1 Data used\nTable 1 Sizes\na   b\n1   2\nEnd."
    assert convert.page_title(text) == "A Study of Rivers and Their Gardens"
    assert convert.page_title("SHORT\nALL CAPITALS IN THIS VERY LONG LINE\nTable 1 is a caption that is long") is None
    out = convert.pdf_text_markdown(text)
    assert out.startswith("# A Study of Rivers and Their Gardens\n\n## Abstract") and "## 1. Method" in out and "### 2.1 Data used" in out
    assert "Table 1 Sizes\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nEnd." in out


def test_recursive_spans():
    from lakeweave.operators import chunking

    for text in ("", " ", "word " * 3000, "x" * 9000, "para one.\n\n" * 900, "a\n" * 5000):
        spans = chunking.recursive(text)
        if not text.strip():
            assert spans == []
            continue
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= 3000 for a, b, _ in spans) and all(c[0] <= b[1] and c[0] > b[0] and b[1] - c[0] <= 200 for b, c in zip(spans, spans[1:], strict=False))
