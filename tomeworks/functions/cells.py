"""Notebooks, their text form with cell markers, Quarto documents and Databricks sources.

The text form is the hub: `# Cell N` before code, `# Markdown Cell N` or `# Raw Cell N` before a block in triple
quotes. Everything that reads lines is one scanner, `scan`.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeworks.functions.arrow import udf

QUOTES = '"""'
PYTHON = "3.10.0"
FAILED = "# Error processing notebook: {}\n\n"
HEADS = {"code": "# Cell ", "markdown": "# Markdown Cell ", "raw": "# Raw Cell "}
_R_SIGNS = re.compile(r"\blibrary\(|\bpacman::p_load\(|\btidyverse\b|\btidymodels\b|\btar_load\(")
_FENCE = re.compile(r"(?P<ticks>`{3,})\s*\{(?P<head>[^}]*)\}\s*")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def kind_of(line: str) -> str | None:
    """Which cell a line begins, by its first words alone."""
    return next((kind for kind, head in HEADS.items() if line.startswith(head)), None)


def trimmed(lines: list[str]) -> list[str]:
    """Lines without blank ones at the end."""
    last = max((i for i, line in enumerate(lines, 1) if line.strip()), default=0)
    return lines[:last]


def scan(text: str) -> list[tuple[str, list[str]]]:
    """(kind, lines) of each cell. Blocks without quotes on the next line don't count, nor does code without content."""
    out: list[tuple[str, list[str]]] = []
    kind, body, state = None, [], "out"

    def close():
        code = trimmed(body)
        if code:
            out.append(("code", code))

    for line in text.splitlines():
        if state == "block":
            if line.strip() == QUOTES:
                out.append((kind, list(body)))
                state = "out"
            else:
                body.append(line)
            continue
        if state == "head":
            # the line after a block's marker opens it, or is skipped whatever it is
            state = "block" if line.strip() == QUOTES else "out"
            body = []
            continue
        begins = kind_of(line)
        if state == "code" and begins is None:
            body.append(line)
            continue
        if state == "code":
            close()
        if begins is not None:
            kind, body, state = begins, [], "code" if begins == "code" else "head"
    if state == "code":
        close()
    elif state == "block":
        out.append((kind, list(body)))
    return out


def render(cells: list[tuple[int, str, str]]) -> str:
    """Text form of (number, kind, source)."""
    out = []
    for n, kind, source in cells:
        if kind == "code":
            out.append(f"{HEADS[kind]}{n}\n{source}\n\n")
        elif kind in HEADS:
            out.append(f"{HEADS[kind]}{n}\n{QUOTES}\n{source}{'' if source.endswith(chr(10)) else chr(10)}{QUOTES}\n\n")
    return "".join(out)


def kernel(name: str) -> dict:
    """Notebook metadata for a kernel's name."""
    r = name.startswith("r_") or name == "ir"
    language = "R" if r else "python"
    about = dict(name=language) if r else dict(name=language, version=PYTHON)
    return dict(kernelspec=dict(display_name=name, language=language, name=name), language_info=about)


def kernel_named_in(text: str) -> str | None:
    """The kernel that `jupyter:` names in the first raw cell's block."""
    raw = quoted = False
    for line in map(str.strip, text.splitlines()):
        if line.startswith(HEADS["raw"]):
            raw, quoted = True, False
        elif raw and line == QUOTES:
            if quoted:
                return None
            quoted = True
        elif raw and quoted and line.startswith("jupyter:"):
            return line[len("jupyter:") :].strip()
    return None


def detect_kernel(text: str, name: str | None = None) -> dict:
    """Metadata of the kernel given, else the one named in the text, else R or Python by what the text calls."""
    name = name or kernel_named_in(text)
    if name:
        return kernel(name)
    found = kernel("ir" if _R_SIGNS.search(text) else "python3")
    found["kernelspec"]["display_name"] = "R" if found["language_info"]["name"] == "R" else "Python 3"
    return found


def notebook(text: str, name: str | None = None) -> dict | None:
    """A notebook from its text form; text that is JSON comes back parsed, None if it is malformed."""
    if text.strip().startswith("{"):
        try:
            return json.loads(text)
        except ValueError:
            return None
    cells = []
    for kind, body in scan(text):
        extra = {"code": [("execution_count", None)]}.get(kind, []), {"code": [("outputs", [])]}.get(kind, [])
        cells.append(dict([("cell_type", kind), *extra[0], ("metadata", {}), *extra[1], ("source", [line + "\n" for line in body])]))
    return {"cells": cells, "metadata": detect_kernel(text, name), "nbformat": 4, "nbformat_minor": 5}


def notebook_json(text: str, name: str | None = None) -> str | None:
    nb = notebook(text, name)
    return None if nb is None else json.dumps(nb, indent=2)


def cells_of(nb: dict) -> list[tuple[str, str]]:
    """(kind, source) of each cell of a parsed notebook; a source may be one string or a list of them."""
    return [(c.get("cell_type", ""), "".join(c.get("source", []))) for c in nb.get("cells", [])]


def notebook_text(content: str) -> str | None:
    """Text form of a notebook's JSON; None if it is malformed or empty. Blank cells are left out, their numbers too."""
    try:
        nb = json.loads(content)
    except ValueError:
        return None
    if not nb:
        return None
    try:
        return render([(n, kind, s) for n, (kind, s) in enumerate(cells_of(nb), 1) if s.strip()])
    except (AttributeError, TypeError) as e:
        return FAILED.format(e)


def without_outputs(content: str) -> str | None:
    """A notebook's JSON, indented by four, with no outputs of code cells; None if it is malformed or empty."""
    try:
        nb = json.loads(content)
    except ValueError:
        return None
    if not nb:
        return None
    try:
        for cell in nb.get("cells", []):
            if cell.get("cell_type") == "code":
                cell["outputs"] = []
    except (AttributeError, TypeError) as e:
        return FAILED.format(e)
    return json.dumps(nb, indent=4)


def databricks(text: str, compat: bool = True) -> str:
    """A Databricks source from the text form. Without `compat`, text without cell markers passes as it is."""
    cells = [(k, body) for k, body in scan_databricks(text)]
    if not cells and not compat:
        return text
    out = ["# Databricks notebook source"]
    for i, (kind, body) in enumerate(cells):
        out += ["", "# COMMAND ----------", ""] if i else []
        if kind == "markdown" and body is not None:
            out += ["# MAGIC %md", *("# MAGIC " + line for line in body)]
        elif kind == "code":
            out += body
    return "\n".join(out)


def scan_databricks(text: str) -> list[tuple[str, list[str] | None]]:
    """Like scan, but raw cells don't count, empty code does, and a block without quotes is an empty cell."""
    out: list[tuple[str, list[str] | None]] = []
    state: str = "out"
    body: list[str] = []
    for line in text.splitlines():
        if state == "block":
            if line.strip() == QUOTES:
                state = "out"
            else:
                body.append(line)
            continue
        if state == "head":
            state = "out"
            if line.strip() == QUOTES:
                state, body = "block", []
                out[-1] = ("markdown", body)
            continue
        begins = kind_of(line)
        if begins == "code":
            state, body = "code", []
            out.append(("code", body))
        elif begins == "markdown":
            state = "head"
            out.append(("markdown", None))
        elif begins == "raw":
            state = "out"
        elif state == "code":
            body.append(line)
    return [(kind, trimmed(lines) if kind == "code" else lines) for kind, lines in out]


def split_options(s: str) -> list[str]:
    """Parts between commas that are in no bracket and no quotes, trimmed; blank ones don't count."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in _PAIRS:
            depth += 1
        elif c in _PAIRS.values():
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            parts.append(s[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, s[start:]] if p.strip()]


def chunk_header(inner: str) -> tuple[str, str | None, list[tuple[str, str]]]:
    """(language, label, options) of what is in a chunk's braces."""
    m = re.match(r"[A-Za-z][\w-]*", inner.strip())
    if m is None:
        return "r", None, []
    label, options = None, []
    for part in split_options(inner.strip()[m.end() :].strip().lstrip(",").strip()):
        key, equals, value = part.partition("=")
        if equals:
            options.append((key.strip(), value.strip()))
        elif label is None:
            label = part
    return m[0], label, options


def option_lines(label: str | None, options: list[tuple[str, str]]) -> list[str]:
    """The options of a chunk as `#|` lines."""
    named = {"TRUE": "true", "T": "true", "FALSE": "false", "F": "false"}
    return [f"#| label: {label}"] * bool(label) + ["#| " + k.replace(".", "-") + ": " + named.get(v.strip(), v.strip()) for k, v in options]


def quarto_cells(text: str) -> list[tuple[str, str]]:
    """(kind, source) of a Quarto document: front matter, text between chunks, chunks."""
    lines = text.split("\n")
    out: list[tuple[str, str]] = []
    at = 0
    rules = [i for i, line in enumerate(lines) if line.strip() == "---"]
    if len(rules) > 1 and rules[0] == 0:
        at = rules[1] + 1
        out.append(("raw", "\n".join(lines[:at])))
    body: list[str] = []
    fence, options = "", []

    def close():
        source = "\n".join(body).strip("\n")
        if fence:
            out.append(("code", "\n".join([*options, *([source] if source or not options else [])])))
        elif source.strip():
            out.append(("markdown", source))

    for line in lines[at:]:
        opens = None if fence else _FENCE.fullmatch(line)
        if opens:
            close()
            fence, body = opens["ticks"], []
            options = option_lines(*chunk_header(opens["head"])[1:])
        elif fence and line.startswith(fence) and not line[len(fence) :].strip():
            close()
            fence, body = "", []
        else:
            body.append(line)
    close()
    return out


def quarto_text(text: str) -> str:
    """Text form of a Quarto document; its cells are numbered one after the other."""
    return render([(n, kind, s) for n, (kind, s) in enumerate(quarto_cells(text), 1)])


def quarto(text: str, language: str = "r") -> str:
    """A Quarto document from the text form; all code is in one language."""
    parts = []
    for kind, body in scan(text):
        source = "\n".join(body).rstrip("\n")
        parts.append(f"```{{{language}}}\n{source}\n```" if kind == "code" else source)
    return "\n\n".join(parts) + chr(10)


def has_markers(text: Column) -> Column:
    """Whether a line is a cell's marker."""
    return text.rlike(r"(?Um)^# ((Markdown|Raw) )?Cell \d+\s*$")


def is_databricks(text: Column) -> Column:
    return text.contains("# Databricks notebook source") | text.contains("# MAGIC %") | text.contains("# MAGIC #")


def kernel_metadata(name: Column) -> Column:
    """kernel() as an expression."""
    r = name.isin("ir", "r_env") | name.startswith("r_")
    spec = F.struct(name.alias("display_name"), F.when(r, "R").otherwise("python").alias("language"), name.alias("name"))
    return F.struct(spec.alias("kernelspec"), F.struct(F.when(r, "R").otherwise("python").alias("name"), F.when(~r, PYTHON).alias("version")).alias("language_info"))


def read_cells(content: Column) -> Column:
    """array<struct<kind, src>> of a notebook's JSON, natively; sources may be one string or a list. Null if malformed."""
    parsed = F.from_json(content, "cells array<struct<cell_type string, source variant>>")
    source = lambda c: F.coalesce(F.array_join(F.try_variant_get(c["source"], "$", "array<string>"), ""), F.try_variant_get(c["source"], "$", "string"), F.lit(""))
    return F.transform(parsed["cells"], lambda c: F.struct(c["cell_type"].alias("kind"), source(c).alias("src")))


def render_cells(cells: Column) -> Column:
    """Text form of array<struct<kind, src>>, natively; blank cells are left out, their numbers too."""

    def one(c: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        block = lambda head: F.concat(F.lit(head), n, F.lit(f"\n{QUOTES}\n"), c["src"], F.when(c["src"].endswith("\n"), "").otherwise("\n"), F.lit(f"{QUOTES}\n\n"))
        shown = F.when(c["kind"] == "code", F.concat(F.lit(HEADS["code"]), n, F.lit("\n"), c["src"], F.lit("\n\n"))).when(c["kind"] == "markdown", block(HEADS["markdown"])).when(c["kind"] == "raw", block(HEADS["raw"]))
        return F.when(c["src"].rlike(r"(?U)[^\s\x1c-\x1f]"), shown)

    return F.array_join(F.transform(cells, one), "")


_CELLS = "array<struct<kind:string,src:string>>"
to_notebook = udf(notebook_json, "string")
to_databricks = udf(databricks, "string")
to_quarto = udf(quarto, "string")
from_quarto = udf(quarto_text, "string")
from_notebook = udf(notebook_text, "string")
strip_outputs = udf(without_outputs, "string")
parse_cells = udf(lambda text: [{"kind": k, "src": "\n".join(b)} for k, b in scan(text)], _CELLS)
parse_quarto = udf(lambda text: [{"kind": k, "src": s} for k, s in quarto_cells(text)], _CELLS)
parse_header = udf(lambda inner: dict(zip(("language", "label", "options"), chunk_header(inner)[:2] + ([{"key": k, "value": v} for k, v in chunk_header(inner)[2]],))), "struct<language:string,label:string,options:array<struct<key:string,value:string>>>")
kernel_of = udf(lambda text, name=None: json.dumps(detect_kernel(text, name)), "string")
