"""Structured reports of twelve sections: metadata, tables, model card and figures from their HTML."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeworks.functions.arrow import udf

_GAP = r"[\-_\s]*"
#: Number, name, key and words that tell a section; each also answers to its number.
SECTIONS = {
    0: ("Machine-Readable Metadata Header", "metadata_header", (("machine", "readable"), ("metadata", "header"))),
    1: ("Executive Summary", "executive_summary", (("executive", "summary"),)),
    2: ("Cohort Flow", "cohort_flow", (("cohort", "flow"),)),
    3: ("Variable Definitions", "variable_definitions", (("variable", "definitions"),)),
    4: ("Data Quality & Missingness", "data_quality", (("data", "quality"),)),
    5: ("Descriptive Statistics", "descriptive_statistics", (("descriptive", "statistics"),)),
    6: ("Primary Analysis", "primary_analysis", (("primary", "analysis"),)),
    7: ("Sensitivity Analyses", "sensitivity_analyses", (("sensitivity", "analyses"),)),
    8: ("Results for Manuscript Use", "manuscript_results", (("results", "for", "manuscript"),)),
    9: ("Limitations & Bias Assessment", "limitations", (("limitations",),)),
    10: ("Reproducibility & Traceability", "reproducibility", (("reproducibility",),)),
    11: ("Proposed Next Steps", "proposed_next_steps", (("proposed", "next"),)),
}
PATTERNS = {n: [rf"section{_GAP}{n}", *(_GAP.join(w) for w in words)] for n, (_, _, words) in SECTIONS.items()}
ICON = "data:image/svg"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element: name, attributes, children (elements and strings) and parent."""

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *names: str, cls: str = "", part: str = "") -> Iterator[Node]:
        """Elements below of these names, with the class `cls`, or one that holds `part`."""
        return (n for n in self.walk() if n.name in names and (not cls or cls in n.classes) and (not part or any(part in c for c in n.classes)))

    def first(self, *names: str, cls: str = "", part: str = "") -> Node | None:
        return next(self.all(*names, cls=cls, part=part), None)

    def above(self, *names: str, cls: str = "") -> Node | None:
        node = self.parent
        while node is not None and not ((not names or node.name in names) and (not cls or cls in node.classes)):
            node = node.parent
        return node

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack += reversed(x.children)

    def text(self, strip: bool = True) -> str:
        return "".join(s.strip() if strip else s for s in self.strings())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen[k] = v or ""
        node = Node(tag, seen, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page, without scripts and styles."""
    b = _Builder()
    b.feed(html)
    b.close()
    for node in [b.root, *b.root.walk()]:
        node.children = [c for c in node.children if not (isinstance(c, Node) and c.name in ("script", "style"))]
    return b.root


def main_of(root: Node) -> Node:
    by_id = next((n for n in root.walk() if "quarto-document-content" == n.attrs.get("id")), None)
    return by_id or root.first("main") or root.first("body") or root


def section_number(text: str, element_id: str = "") -> int | None:
    """Section that a heading or an id names: by number in the text, by number in the id, then by words."""
    for where, pattern in ((text, r"section\s+(\d+)"), (element_id, r"section[\-_]?(\d+)")):
        m = re.search(pattern, where, re.I)
        if m and int(m[1]) in SECTIONS:
            return int(m[1])
    both = f"{text} {element_id}"
    return next((n for n, patterns in PATTERNS.items() if any(re.search(p, both, re.I) for p in patterns)), None)


def section_number_column(text: Column, element_id: Column) -> Column:
    """section_number() as an expression."""
    number = lambda c, p: F.when(c.rlike(p), F.when(F.length(F.regexp_extract(c, p, 1)) <= 2, F.regexp_extract(c, p, 1).cast("int")))
    known = lambda n: F.when(n.between(0, max(SECTIONS)), n)
    both = F.concat_ws(" ", text, element_id)
    words = F.coalesce(*[F.when(both.rlike("(?iU)" + "|".join(f"(?:{p})" for p in ps)), F.lit(n)) for n, ps in PATTERNS.items()])
    return F.coalesce(known(number(text, r"(?iU)section\s+(\d+)")), known(number(element_id, r"(?iU)section[\-_]?(\d+)")), words)


def _heading(node: Node, *names: str) -> str | None:
    h = node.first(*names)
    return None if h is None else h.text()


def find_sections(main: Node) -> dict[int, Node]:
    """Elements of the sections, the first of each number."""
    found: dict[int, Node] = {}
    for s in main.all("section", cls="level1"):
        n = section_number(_heading(s, "h1", "h2") or "", s.attrs.get("id", ""))
        if n is not None:
            found.setdefault(n, s)
    if not found:
        for h in main.all("h1"):
            n = section_number(h.text(), h.parent.attrs.get("id", "") if h.parent else "")
            if n is not None:
                found.setdefault(n, h.parent if h.parent and h.parent.name == "section" else h)
    if 0 not in found:
        block = next((n for n in main.all("header") if n.attrs.get("id") == "title-block-header"), None)
        title = block.first("h1", cls="title") if block else None
        if title and section_number(title.text()) == 0:
            found[0] = main
    return found


def metadata(node: Node):
    """The first YAML block's value; its text and the error if it is malformed; None without one."""
    import yaml

    for pre in node.all("pre", part="sourceCode"):
        code = pre.first("code") if "yaml" in " ".join(pre.classes) else None
        if code is not None:
            raw = code.text(strip=False)
            try:
                return yaml.safe_load(raw)
            except yaml.YAMLError as e:
                return {"_raw": raw, "_parse_error": str(e)}
    return None


def _row(cells: list[Node], columns: list[str]) -> dict[str, str]:
    return {(c.attrs.get("headers", "").split() or [columns[i] if i < len(columns) else f"col_{i}"])[0]: c.text() for i, c in enumerate(cells)}


def styled_table(t: Node) -> dict:
    """A table of the gt package: columns are named by the ids of their headings, cells by their `headers`."""
    title = t.first("td", part="gt_title")
    name = title.text() if title else None
    head = t.first("tr", part="gt_col_headings")
    if head:
        columns = [th.attrs.get("id", "") or th.text() for th in head.all("th")]
    else:
        columns = [s for s in (th.text() for th in t.all("th")) if s and s != name]
    body = t.first("tbody", part="gt_table_body") or t.first("tbody")
    rows = [r for r in (_row(list(tr.all("td")), columns) for tr in (body.all("tr") if body else ())) if r]
    return {"title": name, "columns": columns, "rows": rows}


def plain_table(t: Node) -> dict:
    """Any other table: caption, head and rows; without a body, the head's rows count as data."""
    caption, head = t.first("caption"), t.first("thead")
    columns = [th.text() for th in head.all("th")] if head else []
    rows = []
    for tr in (t.first("tbody") or t).all("tr"):
        row = {columns[i] if i < len(columns) else f"col_{i}": c.text() for i, c in enumerate(tr.all("td", "th"))}
        if row:
            rows.append(row)
    return {"title": caption.text() if caption else None, "columns": columns, "rows": rows}


def tables(node: Node) -> list[dict]:
    """Tables of the gt package, then others that have rows."""
    plain = (plain_table(t) for t in node.all("table") if "gt_table" not in " ".join(t.classes))
    return [*(styled_table(t) for t in node.all("table", part="gt_table")), *(t for t in plain if t["rows"])]


def model_card(node: Node) -> dict[str, str] | None:
    """Labels in bold at the head of list items, and what follows them; None without any."""
    card = {}
    for li in node.all("li"):
        label = li.first("strong")
        if label is None:
            continue
        after = label.parent.children[label.parent.children.index(label) + 1 :]
        parts = [x.strip() if isinstance(x, str) else x.text() for x in after]
        key, value = label.text().rstrip(":"), " ".join(p for p in parts if p).lstrip(": ")
        if key and value:
            card[key] = value
    return card or None


def paragraphs(node: Node) -> str:
    return "\n\n".join(s for s in (p.text() for p in node.all("p") if p.above("pre") is None) if s)


def items(node: Node) -> list[str]:
    return [s for s in (li.text() for li in node.all("li") if li.above("table") is None) if s]


def figures(main: Node) -> list[dict[str, str]]:
    out = []
    for img in main.all("img"):
        src = img.attrs.get("src") or ICON
        if src.startswith(ICON):
            continue
        cell, section, figure = img.above(cls="cell"), img.above("section", cls="level1"), img.above("figure")
        caption = figure.first("figcaption") if figure else None
        out.append({
            "section": (_heading(section, "h1", "h2") or "") if section else "", "src": src, "cell_id": cell.attrs.get("id", "") if cell else "",
            "alt": img.attrs.get("alt", ""), "caption": caption.text() if caption else "",
        })
    return out


def _section(number: int, node: Node) -> dict:
    out: dict = {"section_name": SECTIONS[number][0]}
    if number == 0:
        out["metadata"] = metadata(node) or None
        if out["metadata"] is None:
            out |= {"_warning": "No YAML code block found in Section 0"}
        return out
    found = tables(node)
    if number == 1:
        glance = next((t for t in found if re.search("glance|results", (t["title"] or "").lower())), None)
        pairs = [list(r.values()) for r in glance["rows"]] if glance else []
        out["results_at_a_glance"] = {p[0]: p[1] for p in pairs if len(p) >= 2} if glance else None
        return out | {"text": paragraphs(node), "tables": found}
    if number == 6:
        sub = next((s for s in node.all("section") if "model card" in (_heading(s, "h2", "h3") or "").lower()), node)
        return out | {"model_card": model_card(sub), "tables": found, "text": paragraphs(node)}
    parts = {}
    for sub in node.children:
        name = _heading(sub, "h2", "h3") if isinstance(sub, Node) and sub.name == "section" else None
        if name is not None:
            parts[name] = {"text": paragraphs(sub), "tables": tables(sub), "list_items": items(sub)}
            card = model_card(sub)
            if card:
                parts[name]["model_card"] = card
    if parts:
        out["subsections"] = parts
    return out | {"tables": found, "text": paragraphs(node), "list_items": items(node)}


def extract(html: str, sections: list[int] | None = None, strict: bool = False) -> dict:
    """The whole report. `strict`: missing sections raise ValueError, as does what fails in one; else it is noted in the section."""
    root = parse(html)
    main = main_of(root)
    title = root.first("title")
    meta = {m.attrs.get("name"): m.attrs.get("content", "") for m in root.all("meta")}
    found = find_sections(main)
    missing = sorted(set(sections or SECTIONS) - set(found)) if strict else []
    if missing:
        raise ValueError(f"Missing required sections: {missing}")
    out = {}
    for n in sorted(found):
        if sections is not None and n not in sections:
            continue
        try:
            out[n] = _section(n, found[n])
        except Exception as e:  # one section's trouble is noted in its place
            if strict:
                raise
            out[n] = {"section_name": SECTIONS[n][0], "_error": str(e)}
    return {
        "title": title.text() if title else "", "author": meta.get("author", ""), "date": meta.get("date", ""), "sections_found": sorted(out),
        "sections": out, "tables": [t for s in out.values() for t in s.get("tables", ())], "figures": figures(main),
    }


def _plain(x):
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    raise TypeError(f"{type(x).__name__} has no JSON form")


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=_plain)


def as_yaml(report: dict) -> str:
    import yaml

    class Dumper(yaml.Dumper):
        pass

    Dumper.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else None))
    return yaml.dump(report, Dumper=Dumper, width=120, allow_unicode=True, sort_keys=False, default_flow_style=False)


def as_markdown(report: dict) -> str:
    """The gist: metadata, results, model card, manuscript text, ten limitations and the figures."""
    sections = report.get("sections", {})
    get = lambda n, key: sections.get(n, {}).get(key)
    out = [f"# {report.get('title', 'Report Extraction')}"]
    out += [f"**{k.title()}:** {report[k]}" for k in ("author", "date") if report.get(k)] + [""]

    def block(title: str, lines: list[str]):
        out.extend([f"## {title}", *lines, ""])

    if isinstance(get(0, "metadata"), dict) and get(0, "metadata"):
        block("Metadata", [f"- **{k}:** {v}" for k, v in get(0, "metadata").items() if not str(k).startswith("_")])
    if get(1, "results_at_a_glance"):
        block("Results at a Glance", ["", "| Metric | Value |", f"|{'-' * 8}|{'-' * 7}|", *(f"| {k} | {v} |" for k, v in get(1, "results_at_a_glance").items())])
    if get(6, "model_card"):
        block("Model Card", [f"- **{k}:** {v}" for k, v in get(6, "model_card").items()])
    if get(8, "text"):
        block("Manuscript Results", [get(8, "text")])
    if get(9, "list_items"):
        block("Limitations", [f"- {x}" for x in get(9, "list_items")[:10]])
    if report.get("figures"):
        block(f"Figures ({len(report['figures'])} total)", [f"- [{f.get('section', '')}] {f.get('caption') or f.get('alt') or 'untitled'}" for f in report["figures"]])
    return "\n".join(out)


FORMATS = {"yaml": as_yaml, "json": as_json, "markdown": as_markdown}
_TABLE = "struct<title:string,columns:array<string>,rows:array<map<string,string>>>"
SCHEMA = f"struct<title:string,author:string,date:string,sections_found:array<int>,sections:map<int,string>,tables:array<{_TABLE}>,figures:array<struct<section:string,src:string,cell_id:string,alt:string,caption:string>>>"


def _row_of(html: str, sections: list[int] | None = None, strict: bool | None = False) -> dict:
    r = extract(html, sections, bool(strict))
    table = lambda t: t | {"rows": [list(row.items()) for row in t["rows"]]}
    return r | {"sections": [(n, json.dumps(s, ensure_ascii=False, default=_plain)) for n, s in r["sections"].items()], "tables": [table(t) for t in r["tables"]]}


#: A report as a struct; each section is JSON.
report = udf(_row_of, SCHEMA)
report_text = udf(lambda html, form="yaml": FORMATS[form](extract(html)), "string")
