"""Parsers: file bytes to a title, metadata and text blocks.

A parser is a function of (path, bytes).  ``register`` adds or replaces one; PDF and image text need libraries of the
user's choice, so their built-in parsers give metadata and no text.
"""

from __future__ import annotations

import csv
import html as html_module
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import files


@dataclass
class Block:
    text: str
    section: str | None = None
    page: int | None = None
    start: int | None = None
    end: int | None = None
    kind: str = "text"


@dataclass
class Parsed:
    blocks: list[Block]
    title: str | None = None
    language: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def decoded(data: bytes) -> str:
    """UTF-8, a byte order mark dropped, what can't be read replaced."""
    return data.decode("utf-8-sig", errors="replace")


def _at(text: str, start: int, end: int) -> tuple[int, int]:
    return len(text[:start].encode()), len(text[:end].encode())


def parse_text(path: str, data: bytes) -> Parsed:
    text = decoded(data)
    if not text.strip():
        return Parsed([], metadata={"empty": "true"})
    first = text.strip().split("\n", 1)[0].strip()
    return Parsed([Block(text, start=0, end=len(text.encode()))], first if len(first) < 100 else None)


_FRONT = re.compile(r"\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", re.S)
_HEADING = re.compile(r"#{1,6}\s+\S.*")


def front_matter(text: str) -> tuple[dict[str, str], str, int]:
    """Fields, the rest of the text, and the characters before it."""
    m = _FRONT.match(text)
    if not m:
        return {}, text, 0
    pairs = (line.split(":", 1) for line in m[1].split("\n") if ":" in line)
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}, text[m.end() :], m.end()


def parse_markdown(path: str, data: bytes) -> Parsed:
    """A block for each heading with what follows it; the section is the heading's line."""
    text = decoded(data)
    fields, body, skipped = front_matter(text)
    blocks, section, begin, at = [], None, 0, 0

    def close(end: int) -> None:
        part = body[begin:end]
        if part.strip():
            s, e = _at(text, skipped + begin, skipped + end)
            blocks.append(Block(part.strip(), section, start=s, end=e))

    for line in body.split("\n"):
        if _HEADING.fullmatch(line.rstrip()):
            close(at)
            section, begin = line.rstrip(), at
        at += len(line) + 1
    close(len(body))
    heading = next((b.section.lstrip("#").strip() for b in blocks if b.section), None)
    return Parsed(blocks, fields.get("title") or heading, metadata=fields)


def sniff_delimiter(sample: str) -> str:
    """The delimiter that splits most of the first lines as it splits the first, the more columns the better."""
    lines = [x for x in sample.split("\n")[:20] if x.strip()]
    if not lines:
        return ","
    agreeing = {d: sum(x.count(d) == lines[0].count(d) for x in lines) for d in ",\t;|" if d in lines[0]}
    return max(agreeing, key=lambda d: (agreeing[d], lines[0].count(d)), default=",")


def parse_csv(path: str, data: bytes) -> Parsed:
    """Blocks: header, the first hundred rows, all rows; ragged lines are left out."""
    text = decoded(data)
    rows = list(csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text[:8192])))
    if not rows:
        return Parsed([], metadata={"empty": "true"})
    head, body = rows[0], [r for r in rows[1:] if len(r) == len(rows[0])]
    line = lambda r, most=None: " | ".join(x.replace("\n", " ")[:most] for x in r)
    blocks = [Block("Columns: " + ", ".join(head), "header", kind="header")]
    if body:
        blocks.append(Block("\n".join(line(r, 200) for r in body[:100]), "sample", kind="sample"))
        blocks.append(Block("\n".join([line(head), *map(line, body)]), "data", kind="data"))
    return Parsed(blocks, metadata={"rows": str(len(body)), "columns": str(len(head))})


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"script", "style", "noscript"}
#: What makes a block, kind by kind in this order.
_SELECTED = (("p",), ("div",), ("article",), ("section",), ("blockquote",), ("pre",), ("li",), ("h1", "h2", "h3", "h4", "h5", "h6"))


class _Tree(HTMLParser):
    """Elements in document order, with the stretch of text under each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.open: list[dict] = []
        self.text: list[str] = []
        self.quiet = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROPPED:
            self.quiet += 1
        if tag == "p" or tag == "li":
            self._end(tag, implied=True)
        if tag in _VOID:
            self.text.append(" ")
            return
        element = {"tag": tag, "attrs": dict(attrs), "from": len(self.text), "to": None}
        self.elements.append(element)
        self.open.append(element)

    def _end(self, tag: str, implied: bool = False) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                for element in self.open[i:]:
                    element["to"] = len(self.text)
                del self.open[i:]
                return
            if implied and self.open[i]["tag"] not in ("b", "i", "em", "strong", "span", "a"):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED and self.quiet:
            self.quiet -= 1
        self._end(tag)

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.text.append(data)

    def under(self, element: dict) -> str:
        end = element["to"] if element["to"] is not None else len(self.text)
        return " ".join("".join(self.text[element["from"] : end]).split())


def html_title(text: str) -> str | None:
    m = re.search(r"<title[^>]*>([^<]+)</title>", text, re.I)
    if m and html_module.unescape(m[1].strip()):
        return html_module.unescape(m[1].strip())
    m = re.search(r"<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']+)[\"']", text, re.I)
    return html_module.unescape(m[1].strip()) if m else None


def strip_tags(text: str) -> str:
    return " ".join(html_module.unescape(re.sub(r"<[^>]+>", " ", text)).split())


def html_blocks(text: str) -> list[Block]:
    """Blocks kind by kind, so text in nested elements repeats; a page with hardly any is taken without its tags."""
    tree = _Tree()
    tree.feed(text)
    tree.close()
    blocks, at = [], 0
    for tags in _SELECTED:
        for element in tree.elements:
            if element["tag"] not in tags or (element["tag"] == "div" and not {"class", "id"} & element["attrs"].keys()):
                continue
            found = tree.under(element)
            if len(found) > 2:
                size = len(found.encode())
                blocks.append(Block(found, start=at, end=at + size, kind=element["tag"]))
                at += size + 1
    if sum(len(b.text) for b in blocks) < 50:
        plain = strip_tags(re.sub(r"(?is)<(script|style|noscript)\b.*?</\1>", " ", text))
        blocks = [Block(plain, start=0, end=len(plain.encode()))] if plain else []
    return blocks


def parse_html(path: str, data: bytes) -> Parsed:
    text = decoded(data)
    if not text.strip():
        return Parsed([], metadata={"empty": "true"})
    return Parsed(html_blocks(text), html_title(text))


def notebook_comments(code: str) -> list[str]:
    """Comments of a code cell; a hash inside quotes begins none."""
    found = []
    for line in code.split("\n"):
        quote = None
        for i, c in enumerate(line):
            if quote:
                quote = None if c == quote and line[i - 1] != "\\" else quote
            elif c in "\"'":
                quote = c
            elif c == "#":
                if line[i + 1 :].strip():
                    found.append(line[i + 1 :].strip())
                break
    return found


def parse_notebook(path: str, data: bytes) -> Parsed:
    book = json.loads(decoded(data))
    source = lambda cell: "".join(s) if isinstance(s := cell.get("source", ""), list) else str(s)
    blocks, title = [], (book.get("metadata") or {}).get("title")
    for i, cell in enumerate(book.get("cells", [])):
        text = source(cell).strip()
        if not text or cell.get("cell_type") not in ("markdown", "code"):
            continue
        blocks.append(Block(text, f"cell_{i}", kind=cell["cell_type"]))
        if cell["cell_type"] == "code" and (comments := notebook_comments(text)):
            blocks.append(Block("\n".join(comments), f"cell_{i}", kind="comments"))
        elif cell["cell_type"] == "markdown" and not title:
            line = next((x for x in text.split("\n") if x.lstrip().startswith("#")), text.split("\n", 1)[0])
            title = line.lstrip("# ").strip() if len(line) < 200 else None
    meta = book.get("metadata") or {}
    kernel = meta.get("kernelspec") or {}
    facts = {"format": str(book.get("nbformat", "")), "kernel": kernel.get("name", ""), "language": (meta.get("language_info") or {}).get("name", kernel.get("language", ""))}
    return Parsed(blocks, title, facts["language"] or None, facts)


LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
    "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "r": "r", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell",
}
#: What begins a definition, by language; the named group is its name.
DEFINITIONS = {
    "python": {"class": r"^class\s+(?P<name>\w+)\s*(\([^)]*\))?:", "function": r"^def\s+(?P<name>\w+)\s*\((.*?)\)\s*(?:->\s*[^:]+)?:"},
    "javascript": {
        "class": r"^(export\s+)?(class|interface|type)\s+(?P<name>\w+)",
        "function": r"^(export\s+)?(async\s+)?(function\s+)?(?P<name>\w+)\s*\(([^)]*)\)",
        "arrow": r"^(export\s+)?const\s+(?P<name>\w+)\s*=\s*\(([^)]*)\)\s*=>",
    },
    "java": {"class": r"^(public\s+|private\s+|protected\s+)?(abstract\s+|final\s+)?(class|interface|enum)\s+(?P<name>\w+)"},
    "go": {"function": r"^func\s+(\([^)]*\))?\s*(?P<name>\w+)\s*\(([^)]*)\)", "type": r"^type\s+(?P<name>\w+)\s+(struct|interface)"},
    "rust": {
        "function": r"^(pub\s+)?(async\s+)?fn\s+(?P<name>\w+)\s*\(([^)]*)\)",
        "struct": r"^(pub\s+)?struct\s+(?P<name>\w+)",
        "trait": r"^(pub\s+)?trait\s+(?P<name>\w+)",
        "enum": r"^(pub\s+)?enum\s+(?P<name>\w+)",
    },
    "c": {"class": r"^(class|struct)\s+(?P<name>\w+)", "function": r"^(void|int|bool|char|float|double|auto|\w+\*?)\s+(?P<name>\w+)\s*\(([^)]*)\)"},
    "": {"function": r"^(def|function|func)\s+(?P<name>\w+)\s*\(", "class": r"^(class|type|struct|interface)\s+(?P<name>\w+)"},
}
_SAME = {"typescript": "javascript", "cpp": "c"}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else"}


def _docstring(lines: list[str], after: int) -> str | None:
    """A triple-quoted text that begins on the next line that isn't blank, up to twenty lines long."""
    rest = [x.strip() for x in lines[after : after + 20]]
    while rest and not rest[0]:
        rest.pop(0)
    for quotes in ('"""', "'''"):
        if rest and rest[0].startswith(quotes):
            whole = "\n".join(rest)[3:]
            return whole.split(quotes, 1)[0].strip() or None
    return None


def line_comment(lines: list[str], before: int) -> str | None:
    line = lines[before - 1].strip() if before else ""
    mark = next((m for m in ("//", "#", "--", "/*") if line.startswith(m)), None)
    return line.removeprefix(mark).removesuffix("*/").strip() or None if mark else None


def code_definitions(text: str, language: str) -> list[Block]:
    """Signatures of definitions, with what documents them as the section's name in front."""
    patterns = {k: re.compile(p) for k, p in DEFINITIONS.get(_SAME.get(language, language), DEFINITIONS[""]).items()}
    lines, at, found = text.split("\n"), 0, []
    for i, line in enumerate(lines):
        size = len(line.encode())
        tested = line if language == "python" else line.strip()
        for kind, pattern in patterns.items():
            m = pattern.match(tested)
            if m and m["name"] not in _NOT_NAMES:
                note = _docstring(lines, i + 1) if language == "python" else line_comment(lines, i)
                signature = m[0].strip()
                found.append(Block(signature if note is None else f"{signature}\n{note}", m["name"], start=at, end=at + size, kind=kind))
                break
        at += size + 1
    return found


def line_blocks(text: str, n: int = 50) -> list[Block]:
    lines, at, found = text.split("\n"), 0, []
    for i in range(0, len(lines), n):
        part = "\n".join(lines[i : i + n])
        size = len(part.encode())
        if part.strip():
            found.append(Block(part, f"lines_{i + 1}-{min(i + n, len(lines))}", start=at, end=at + size, kind="lines"))
        at += size + 1
    return found


def parse_code(path: str, data: bytes) -> Parsed:
    text, language = decoded(data), LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "unknown")
    if not text.strip():
        return Parsed([], language=language, metadata={"empty": "true"})
    return Parsed(code_definitions(text, language) or line_blocks(text), path.rsplit("/", 1)[-1], language)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def table_text(rows: list[list[str]]) -> str:
    """Cells joined by bars, with a rule under the first row."""
    lines = [" | ".join(c.strip() for c in r) for r in rows]
    return "\n".join([lines[0], " | ".join("---" for _ in rows[0]), *lines[1:]]) if rows else ""


def parse_docx(path: str, data: bytes) -> Parsed:
    """Paragraphs under their last heading, tables as text, the title from the core properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        title = None
        if "docProps/core.xml" in z.namelist():
            node = ElementTree.fromstring(z.read("docProps/core.xml")).find("{http://purl.org/dc/elements/1.1/}title")
            title = node.text if node is not None and node.text else None
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    blocks, section, held, at = [], None, [], 0

    def put(text: str, kind: str = "text") -> None:
        nonlocal at
        if text.strip():
            size = len(text.encode())
            blocks.append(Block(text, section, start=at, end=at + size, kind=kind))
            at += size + 1

    for element in body if body is not None else []:
        if element.tag == f"{_W}p":
            style = element.find(f"{_W}pPr/{_W}pStyle")
            text = words(element).strip()
            if style is not None and style.get(f"{_W}val", "").lower().startswith(("heading", "title")) and text:
                put("\n".join(held))
                held, section = [], text
                title = title or text
            elif text:
                held.append(text)
        elif element.tag == f"{_W}tbl":
            put("\n".join(held))
            held = []
            put(table_text([[words(c) for c in r.iter(f"{_W}tc")] for r in element.iter(f"{_W}tr")]), "table")
    put("\n".join(held))
    return Parsed(blocks, title)


def parse_pdf(path: str, data: bytes) -> Parsed:
    """Facts only; register a parser that uses a PDF library for the text."""
    pages = len(re.findall(rb"/Type\s*/Page[^s]", data))
    return Parsed([], metadata={"pages": str(pages), "text": "unavailable"})


def image_size(data: bytes) -> tuple[int, int] | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM":
        return int.from_bytes(data[18:22], "little"), int.from_bytes(data[22:26], "little")
    return None


def parse_image(path: str, data: bytes) -> Parsed:
    """Size only; register a parser that uses an OCR library for the text."""
    size = image_size(data)
    return Parsed([], metadata={"ocr": "unavailable"} | ({"width": str(size[0]), "height": str(size[1])} if size else {}))


_registry: dict[str, Callable[[str, bytes], Parsed]] = {
    "text": parse_text, "markdown": parse_markdown, "csv": parse_csv, "html": parse_html, "notebook": parse_notebook,
    "code": parse_code, "docx": parse_docx, "pdf": parse_pdf, "image": parse_image,
}


def register(name: str, parser: Callable[[str, bytes], Parsed]) -> None:
    _registry[name] = parser


BLOCK_SCHEMA = "path string, title string, language string, metadata map<string,string>, seq long, text string, section string, page long, offset_start long, offset_end long, kind string, error string"
_COLUMNS = [c.strip().split(" ")[0] for c in re.split(r", (?=\w+ )", BLOCK_SCHEMA)]


def parse_files(rows: DataFrame) -> DataFrame:
    """A row for each block of (path, content) rows; a file that can't be parsed, or has none, gives one with a null text."""
    ship(rows.sparkSession)
    registry = dict(_registry)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for path, kind, data in zip(frame["path"], frame["parser"], frame["content"]):
                try:
                    doc, error = registry[kind](path, bytes(data)), None
                except Exception as e:  # one bad file must not stop the others
                    doc, error = Parsed([]), f"{type(e).__name__}: {e}"
                for i, b in enumerate(doc.blocks or [None]):
                    own = (i, b.text, b.section, b.page, b.start, b.end, b.kind) if b else (None,) * 7
                    out.append((path, doc.title, doc.language, doc.metadata, *own, error))
            result = pd.DataFrame(out, columns=_COLUMNS)
            yield result.astype({c: "Int64" for c in ("seq", "page", "offset_start", "offset_end")})

    return rows.select("path", files.parser(F.col("path")).alias("parser"), "content").mapInPandas(parse, BLOCK_SCHEMA)
