"""Files and pages to Markdown: HTML, plain text tables, clean-up of text taken from PDF pages.

Converters are small functions of one file that run in Arrow batches. DOCX and ODT are zipped XML and RTF is text with
control words: both are read with the standard library. What needs a tool that Spark nodes don't have (PDF, old DOC) is
recognised and reported, not converted; a broken file gives null.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_garbled, looks_like_markdown, normalized_markdown
from ..shipping import ship_package
from ..sources.tables import decoded, suffix

SKIPPED = {"script", "style", "head", "noscript", "template"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "ul", "ol", "table", "blockquote", "pre", "main", "nav", "aside", "figure"}


class _Markdown(HTMLParser):
    """Headings, lists, links, emphasis, code, quotes and tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped = 0
        self.pre = False
        self.lists: list[list] = []
        self.link: list[str | None] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def _say(self, text: str) -> None:
        (self.cell if self.cell is not None else self.out).append(text)

    def handle_starttag(self, tag, attributes):
        if tag in SKIPPED:
            self.skipped += 1
        elif re.fullmatch("h[1-6]", tag):
            self._say("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._say("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self._say("\n" + "  " * (len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "a":
            self.link.append(dict(attributes).get("href"))
            self._say("[")
        elif tag in ("b", "strong"):
            self._say("**")
        elif tag in ("i", "em"):
            self._say("*")
        elif tag == "pre":
            self.pre = True
            self._say("\n\n```\n")
        elif tag == "code" and not self.pre:
            self._say("`")
        elif tag == "br":
            self._say("\n")
        elif tag == "blockquote":
            self._say("\n\n> ")
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []
        elif tag in BLOCKS:
            self._say("\n\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif re.fullmatch("h[1-6]", tag) or tag == "p":
            self._say("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._say("\n")
        elif tag == "a" and self.link:
            self._say(f"]({self.link.pop() or ''})")
        elif tag in ("b", "strong"):
            self._say("**")
        elif tag in ("i", "em"):
            self._say("*")
        elif tag == "pre":
            self.pre = False
            self._say("\n```\n\n")
        elif tag == "code" and not self.pre:
            self._say("`")
        elif tag in ("td", "th") and self.cell is not None:
            text, self.cell = " ".join("".join(self.cell).split()), None
            if self.row is not None:
                self.row.append(text)
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows:
            self._say("\n\n" + table_markdown(self.rows) + "\n\n")
            self.rows = []

    def handle_data(self, data):
        if not self.skipped:
            self._say(data if self.pre else re.sub(r"\s+", " ", data))


def table_markdown(rows: list[list[str]]) -> str:
    """The first row is the header; short rows are filled up."""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def html_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    lines = [x.rstrip() if x.startswith((" ", "\t")) and x.lstrip().startswith(("-", "1")) else x.strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def text_tables(text: str) -> list[tuple[str, list[list[str]]]]:
    """(caption, rows) of tables set in columns: a line "Table n ..." and the lines after it that have wide gaps."""
    out, lines = [], text.split("\n")
    for k, line in enumerate(lines):
        if re.match(r"\s*(?:table|tabelle|表)\s*\d+", line, re.I):
            rows = []
            for after in lines[k + 1 :]:
                cells = [c for c in re.split(r"\s{2,}|\t+", after.strip()) if c]
                if len(cells) < 2:
                    break
                rows.append(cells)
            if rows:
                out.append((line.strip(), rows))
    return out


def without_page_furniture(text: str) -> str:
    """First and last lines that repeat on most pages (form feeds part pages) and bare page numbers are dropped."""
    pages = [page.split("\n") for page in text.split("\f")]
    ends = []
    for lines in pages:
        filled = [x.strip() for x in lines if x.strip()]
        ends.append({*filled[:2], *filled[-2:]})
    repeated = {line for line in set().union(*ends) if len(pages) > 2 and sum(line in e for e in ends) > len(pages) / 2}
    number = re.compile(r"(?:page\s+)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?|-\s*\d{1,4}\s*-", re.I)
    return "\n".join(x for lines in pages for x in lines if x.strip() not in repeated and not number.fullmatch(x.strip()))


def joined_hyphens(text: str) -> str:
    """Words parted at a line end are joined, if the second half begins with a small letter."""
    return re.sub(r"([^\W\d_]{2,})-\n([a-zà-öø-ÿ][^\W\d_]+)", r"\1\2", text)


# Names of sections that stand alone on a line, and what captions begin with.
SECTION_NAMES = ("abstract", "introduction", "background", "related work", "method", "methods", "methodology", "experiments", "results", "discussion", "conclusion", "conclusions", "references", "acknowledgements", "appendix")
CAPTIONS = ("table", "figure", "algorithm")


def heading(line: str) -> str | None:
    """A line as a Markdown heading, or None: headings as they are, section names, and numbered titles by their depth."""
    if line.startswith("#"):
        return line
    if line.lower().rstrip(":") in SECTION_NAMES:
        return f"## {line.title()}"
    m = re.match(r"(\d{1,2}(?:\.\d{1,2}){0,4}\.?)[ \t]+([^\W\d_][^\n.]{1,78})$", line)
    return "#" * min(6, 1 + len(m[1].rstrip(".").split("."))) + f" {m[1]} {m[2]}" if m else None


def page_title(text: str, most_lines: int = 20) -> str | None:
    """The first line, of the first twenty, that reads like a title: 21 to 179 characters, a capital first, not all
    capitals, no heading and no caption."""
    for line in text.split("\n")[:most_lines]:
        line = line.strip()
        plain = line and not heading(line) and not line.lower().startswith(CAPTIONS)
        if plain and 20 < len(line) < 180 and line[0].isupper() and not line.isupper():
            return line
    return None


def structured(text: str) -> str:
    """The title as the first heading, section names and numbered titles as headings."""
    title, out = page_title(text), []
    for line in text.split("\n"):
        bare = line.strip()
        if title and bare == title:
            out += [f"# {title}", ""]
            title = None
            continue
        as_heading = heading(bare) if bare else None
        out += [as_heading, ""] if as_heading else [line]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out))


def with_tables(text: str) -> str:
    """Tables set in columns as Markdown tables in their place, behind their captions."""
    lines, out, k = text.split("\n"), [], 0
    found = {caption: rows for caption, rows in reversed(text_tables(text))}
    while k < len(lines):
        rows = found.pop(lines[k].strip(), None)
        out.append(lines[k])
        k += 1
        if rows:
            out += ["", table_markdown(rows), ""]
            k += len(rows)
    return "\n".join(out)


def numbered_headings(text: str) -> str:
    """Short lines such as "2.1 Method" become headings of their depth."""
    return "\n".join(heading(x) or x if re.match(r"\d", x) else x for x in text.split("\n"))


def pdf_text_markdown(text: str | None) -> str:
    """All clean-up steps: page furniture, hyphens, tables in their places, title and headings."""
    return structured(with_tables(joined_hyphens(without_page_furniture(text or "")))).strip()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_paragraph(p: ElementTree.Element) -> str:
    text = "".join({f"{_W}t": n.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(n.tag, "") for n in p.iter())
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
    level = re.search(r"heading\s*(\d)", name)
    if level and text.strip():
        return "#" * min(6, int(level[1])) + " " + text.strip()
    if name == "title" and text.strip():
        return f"# {text.strip()}"
    return f"- {text.strip()}" if p.find(f"{_W}pPr/{_W}numPr") is not None and text.strip() else text.strip()


def docx_markdown(content: bytes) -> str:
    """Paragraphs, headings by style, list items and tables of a DOCX file, in their order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for part in body if body is not None else ():
        if part.tag == f"{_W}p":
            out.append(_docx_paragraph(part))
        elif part.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, (_docx_paragraph(p) for p in cell.iter(f"{_W}p")))) for cell in row.findall(f"{_W}tc")] for row in part.iter(f"{_W}tr")]
            out += [table_markdown(rows)] if rows else []
    return "\n\n".join(x for x in out if x)


def odt_markdown(content: bytes) -> str:
    """Paragraphs, headings by outline level, list items and tables of an ODT file, in their order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: " ".join("".join(e.itertext()).split())
    out: list[str] = []

    def walk(e: ElementTree.Element, item: bool) -> None:
        for part in e:
            kind = name(part)
            if kind == "h":
                level = next((int(v) for k, v in part.attrib.items() if k.endswith("}outline-level")), 1)
                out.append("#" * min(6, level) + " " + text(part))
            elif kind == "p" and text(part):
                out.append(("- " if item else "") + text(part))
            elif kind == "table":
                rows = [[text(c) for c in row if name(c) == "table-cell"] for row in part.iter() if name(row) == "table-row"]
                out.extend([table_markdown(rows)] if rows else [])
            elif kind not in ("p", "h"):
                walk(part, item or kind == "list-item")

    walk(root, False)
    return "\n\n".join(x for x in out if x.strip("# -"))


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\(\*)|\\([{}\\~_-])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
#: RTF groups without text for a reader, and control words that end a paragraph or a cell.
RTF_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict header footer footnote themedata datastore listtable listoverridetable generator".split())
RTF_BREAKS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t"}


def rtf_markdown(content: bytes) -> str:
    """The text of an RTF file, a paragraph a line."""
    if not content.lstrip().startswith(b"{\\rtf"):
        raise ValueError("no RTF file")
    out, hidden, stack = [], False, []
    for m in _RTF.finditer(content.decode("cp1252", "replace")):
        byte, code, word, _, star, sign, brace, text = m.groups()
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif star or word in RTF_HIDDEN:
            hidden = True
        elif not hidden:
            out.append(bytes.fromhex(byte).decode("cp1252", "replace") if byte else chr(int(code) % 65536) if code else RTF_BREAKS.get(word, "") if word else {"~": "\xa0", "_": "-", "-": ""}.get(sign, sign) if sign else text or "")
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(x.strip() for x in "".join(out).split("\n") if x.strip()))


OFFICE = {"docx": docx_markdown, "odt": odt_markdown, "rtf": rtf_markdown}


def office_markdown(files: DataFrame, key: str, kind: str, content: str) -> DataFrame:
    """(key, markdown) of files of the kinds docx, odt and rtf; null for other kinds and for files that can't be read."""
    ship_package(files.sparkSession)

    def one(how: str | None, data: bytes | None) -> str | None:
        if how not in OFFICE or data is None:
            return None
        try:
            return OFFICE[how](bytes(data))
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "markdown": [one(*x) for x in zip(frame[kind], frame[content], strict=True)]})

    return files.select(key, kind, content).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, markdown string")


#: Suffixes of files that are text already.
TEXTS = frozenset("md markdown txt csv json xml yaml yml".split())


def to_markdown(kind: str, content: bytes) -> str | None:
    """A file's text by its suffix: office and HTML files converted, text files as they are; None for other kinds."""
    if kind in OFFICE:
        return OFFICE[kind](content)
    if kind not in TEXTS and kind not in ("html", "htm"):
        return None
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return text if kind in TEXTS else html_markdown(text)


CONVERTERS = {"html": html_markdown, "pdf_text": pdf_text_markdown}


def converted(rows: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """(key, markdown): each text by the named converter."""
    ship_package(rows.sparkSession)
    convert = CONVERTERS[how]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "markdown": [convert(t) for t in frame[text]]})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, markdown string")


def method(name: Column) -> Column:
    """How a file would be converted, by its suffix."""
    s = suffix(name)
    return F.when(s.isin("doc", "pdf"), "external").when(s.isin(*OFFICE), "office").when(s.isin("html", "htm"), "html").when(s.isin("md", "markdown"), "none").otherwise("plain")


def needs_conversion(text: Column) -> Column:
    """Neither Markdown already nor readable."""
    return ~looks_like_markdown(text) & looks_garbled(text)


def file_texts(files: DataFrame) -> DataFrame:
    """(path, method, text) of scanned files: office files converted, others decoded and normalised; null where a tool from
    outside is needed."""
    how = method(F.col("name"))
    known = files.select("path", how.alias("method"), "suffix", "content")
    plain = known.where(~F.col("method").isin("external", "office")).select("path", "method", normalized_markdown(decoded(F.col("content"))).alias("text"))
    office = known.where("method = 'office'")
    read = office.select("path", "method").join(office_markdown(office, "path", "suffix", "content"), "path").select("path", "method", F.col("markdown").alias("text"))
    return plain.unionByName(read).unionByName(known.where("method = 'external'").select("path", "method", F.lit(None).cast("string").alias("text")))
