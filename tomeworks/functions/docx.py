"""Text of Word files from their XML."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from tomeworks.functions.arrow import udf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
METHODS = ("auto", "docx", "basic")


def _parts(content: bytes) -> tuple[ET.Element, dict[str, str]] | None:
    """The document's root and the name of each style, in lower case; None for bytes that are no Word file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
            styles = ET.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ()
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    names = {}
    for s in styles:
        name = s.find(_W + "name")
        if s.tag == _W + "style" and name is not None:
            names[s.get(_W + "styleId", "")] = name.get(_W + "val", "").lower()
    return root, names


def paragraphs(content: bytes) -> str | None:
    """One line for each paragraph, trimmed, blank ones kept; None for bytes that are no Word file."""
    got = _parts(content)
    return None if got is None else "\n".join("".join(t.text or "" for t in p.iter(_W + "t")).strip() for p in got[0].iter(_W + "p"))


def _text(p: ET.Element) -> str:
    signs = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n", _W + "noBreakHyphen": "-"}
    return "".join(x.text or "" if x.tag == _W + "t" else signs.get(x.tag, "") for x in p.iter())


def _level(p: ET.Element, names: dict[str, str]) -> int:
    """Level of a heading or title by its style's name; 0 for other paragraphs."""
    style = p.find(f"{_W}pPr/{_W}pStyle")
    if style is None:
        return 0
    key = style.get(_W + "val", "")
    name = names.get(key) or re.sub(r"(?<=[a-z])(?=[0-9])", " ", key.lower())
    if "heading" in name:
        m = re.search(r"heading ([1-6])", name)
        return int(m[1]) if m else 1
    return int("title" in name)


def _rows(table: ET.Element) -> list[list[str]]:
    """Cells of each row; one that spans columns counts for each, one that goes on from above repeats what is there."""
    out: list[list[str]] = []
    for tr in table.findall(_W + "tr"):
        row: list[str] = []
        for tc in tr.findall(_W + "tc"):
            span, merge = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_text(p) for p in tc.findall(_W + "p")).strip()
            if merge is not None and merge.get(_W + "val", "continue") == "continue" and out and len(row) < len(out[-1]):
                text = out[-1][len(row)]
            row += [text] * (int(span.get(_W + "val", "1")) if span is not None else 1)
        out.append(row)
    return out


def structured(content: bytes) -> str | None:
    """Markdown with headings by their styles, then all tables, each between blank lines; None for bytes that are no Word file."""
    got = _parts(content)
    body = None if got is None else got[0].find(_W + "body")
    if body is None:
        return None
    out = []
    for p in body.findall(_W + "p"):
        text = _text(p).strip()
        level = _level(p, got[1]) if text else 0
        out.append(f"{'#' * level} {text}" if level else text)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    for table in body.findall(_W + "tbl"):
        rows = _rows(table)
        out += ["", *([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])] if rows else []), ""]
    return "\n".join(out)


def check_method(method: str) -> str:
    """The form that a method stands for: `docx`, with headings and tables, unless plain paragraphs are asked for."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}; others need programs or packages that this engine doesn't use")
    return "basic" if method == "basic" else "docx"


to_text = udf(paragraphs, "string")
to_markdown = udf(structured, "string")
FORMS = {"basic": to_text, "docx": to_markdown}
