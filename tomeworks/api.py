"""Whole jobs from folder to folder: what the command line offers."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.functions import cells, docx, html, images, report
from tomeworks.functions.text import as_text
from tomeworks.operators import chunk, ingest, parse, render, select, write
from tomeworks.sources.tree import read_archive, relative, scan


def _one(df: DataFrame) -> DataFrame:
    return df.select(F.lit("archive").alias("archive_id"), "rel_path", "content")


def corpus(spark: SparkSession, directory: str, extract_code_only=False, **options) -> DataFrame:
    """(archive_id, rel_path, content) of a directory's files, as an archive holds them."""
    return _one(render.converted(scan(spark, directory, **options), extract_code_only))


def archive(spark: SparkSession, directory: str, output: str, llm=False, extract_code_only=False, split=False, max_words=chunk.ARCHIVE_WORDS, split_dir: str | None = None, update=False, dry_run=False, stamp: str | None = None, **options) -> dict:
    """Archive a directory in one file, and in parts with `split`. With `update`, outputs that are the same but for their dates aren't touched."""
    files = corpus(spark, directory, extract_code_only, **options)
    if dry_run:
        rows = [r.asDict() for r in render.manifest(files).orderBy("pos").collect()]
        chars = sum(r["chars"] for r in rows)
        missing = [f for f in options.get("roots") or () if not os.path.isfile(os.path.join(directory, f))]
        issues = [f"root file not found: {f}" for f in missing] + ["no files match"] * (not rows)
        return {"files": len(rows), "chars": chars, "est_tokens": chars // 4, "manifest": [{**r, "kb": f"{r['chars'] / 1024:.1f}"} for r in rows], "issues": issues}
    made = render.archives(files, llm, stamp or render.now(), F.lit(os.path.basename(os.path.abspath(directory)))).collect()
    head = spark.range(1).select(render.header(F.lit(stamp or render.now()), F.lit(os.path.basename(os.path.abspath(directory))), llm).alias("h"))
    text = made[0].text if made else head.first().h + "# TABLE OF CONTENTS\n\n\n"
    written = [output] if _save(output, text, update) else []
    stem, ext = os.path.splitext(os.path.basename(output))
    parts: list[str] = []
    if split:
        folder = split_dir or os.path.join(os.path.dirname(output), f"split_{stem}")
        parts = split_text(spark, text, folder, stem, ext, max_words, update)
        if update:
            write.remove_stale(folder, stem, ext, [*parts, output])
    return {"files": made[0].n_files if made else 0, "written": written, "parts": parts}


def _save(path: str, text: str, update: bool) -> bool:
    data = text.encode()
    if update and os.path.exists(path):
        with open(path, "rb") as f:
            if write.undated(f.read()) == write.undated(data):
                return False
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return True


def split_text(spark: SparkSession, text: str, folder: str, stem: str, ext: str, max_words: int, update=False) -> list[str]:
    """Write a text's parts below folder; their paths in order, those that were current included."""
    rows = chunk.split(spark.createDataFrame([(stem, text)], "archive_id string, text string"), max_words).orderBy("part").collect()
    os.makedirs(folder, exist_ok=True)
    paths = []
    for r in rows:
        paths.append(os.path.join(folder, r.name + ext))
        _save(paths[-1], r.text, update)
    return paths


def split_file(spark: SparkSession, path: str, folder: str, max_words=chunk.MAX_WORDS, update=False) -> list[str]:
    stem, ext = os.path.splitext(os.path.basename(path))
    with open(path, encoding="utf-8") as f:
        out = split_text(spark, f.read(), folder, stem, ext, max_words, update)
    if update:
        write.remove_stale(folder, stem, ext, [*out, path])
    return out


def strip_outputs(spark: SparkSession, path: str) -> str:
    """Rewrite a notebook without the outputs of its code cells; its path."""
    row = scan(spark, os.path.dirname(os.path.abspath(path)), explicit=[os.path.basename(path)]).select(cells.strip_outputs(as_text(F.col("content"))).alias("t")).first()
    if row is not None and row.t is not None:
        _save(path, row.t, False)
    return path


def validate(path: str) -> bool:
    """Whether an archive holds a table of contents and a section for language models."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return "TABLE OF CONTENTS" in text and render.LLM in text


def split_directory(spark: SparkSession, directory: str, folder: str, max_words=chunk.MAX_WORDS) -> list[str]:
    names = sorted(n for n in os.listdir(directory) if os.path.isfile(os.path.join(directory, n)))
    return [p for n in names for p in split_file(spark, os.path.join(directory, n), folder, max_words)]


def _archive_rows(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("archive", text)], "archive_id string, text string")


def unpack(spark: SparkSession, archive_path: str, output: str, replace=False, kernel: str | None = None, force=False, strict_detect=False) -> list[str]:
    """Write an archive's files. LLM archives don't hold files exactly, so unpacking one must be forced."""
    with open(archive_path, encoding="utf-8", newline=None) as f:
        text = f.read()
    rows = _archive_rows(spark, text)
    window = None if strict_detect else parse.WINDOW
    llm = rows.select(parse.detected(F.col("text"), window).alias("d")).first().d == "llm-friendly"
    if llm and not force:
        raise SystemExit("this archive is in the form for language models; extract its notebooks, or force unpacking")
    if not llm:
        return write.write(parse.standard(rows), output, "replace" if replace else "suffix")
    files = parse.restored(parse.llm(rows).withColumn("is_llm", F.lit(True)), kernel)
    return write.write(files, output, "replace" if replace else "skip")


def extract_notebooks(spark: SparkSession, archive_path: str, output: str, replace=False, kernel: str | None = None, quarto=False) -> list[str]:
    text = read_archive(spark, archive_path)
    if text is None:
        return []
    return write.write(parse.notebooks(parse.sections(_archive_rows(spark, text)), kernel, quarto), output, "replace" if replace else "stem")


def concatenate(spark: SparkSession, directory: str, output: str, file_types=select.PLAIN_TYPES, replace=True) -> str:
    """The older form of an archive: sections alone. Notebooks are taken whatever the types, no folder is left out, files that aren't UTF-8 are."""
    rows = scan(spark, directory, everything=True).filter(select.extension(F.col("rel_path")).isin(*file_types, ".ipynb") & F.is_valid_utf8(F.col("content").cast("string")))
    made = render.concatenated(_one(render.converted(rows))).collect()
    if replace or not os.path.exists(output):
        _save(output, made[0].text if made else "", False)
    return output


def archive_subdirectories(spark: SparkSession, parent: str, directories=None, folder: str | None = None, name="all_combined_archives.txt", file_types=select.FILE_TYPES) -> str:
    """One archive for each folder below parent, and one of them all; the latter's path."""
    names = directories or sorted(d for d in os.listdir(parent) if os.path.isdir(os.path.join(parent, d)))
    folder = folder or parent
    made = []
    for d in names:
        if os.path.isdir(os.path.join(parent, d)):
            path = concatenate(spark, os.path.join(parent, d), os.path.join(folder, f"{d}_{name}.txt"), file_types)
            made.append((d, path))
    return combine(spark, made, os.path.join(folder, name))


def combine(spark: SparkSession, archives: list[tuple[str, str]], output: str) -> str:
    """One archive of those (directory, path) that are there."""
    rows = []
    for d, path in archives:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                rows.append((d, f.read()))
    _save(output, render.combined(spark.createDataFrame(rows, "archive_id string, text string")).first().text or "", False)
    return output


def unpack_combined(spark: SparkSession, path: str, output: str, replace=True) -> list[str]:
    with open(path, encoding="utf-8") as f:
        rows = parse.combined(spark.createDataFrame([(f.read(),)], "text string"))
    return write.write(rows.withColumn("rel_path", F.concat_ws("/", "archive_id", "rel_path")), output, "replace" if replace else "suffix")


def _converted(spark, path: str, output: str | None, ending: str, pattern: str, convert, replace: bool) -> list[str]:
    """Convert one file or all of a folder; markdown files beside them or in output."""
    single = os.path.isfile(path)
    base = os.path.dirname(os.path.abspath(path)) if single else path
    rows = scan(spark, base, explicit=[os.path.basename(path)]) if single else scan(spark, base, everything=True).filter(F.col("rel_path").rlike(pattern) & ~select.name(F.col("rel_path")).startswith("~$"))
    name = F.regexp_replace("rel_path", r"\.[^./]+$", ".md")
    files = rows.select(name.alias("rel_path"), convert(F.col("content")).alias("content")).filter("content IS NOT NULL")
    if single and output and not os.path.isdir(output):
        got = files.first()
        return [output] if got and (replace or not os.path.exists(output)) and _save(output, got.content, False) else []
    return write.write(files, output or base, "replace" if replace else "skip")


def convert_word(spark: SparkSession, path: str, output: str | None = None, method="auto", replace=False) -> list[str]:
    form = docx.FORMS[docx.check_method(method)]
    if os.path.isfile(path) and not path.lower().endswith(".docx"):
        raise ValueError(f"not a .docx file: {path}")
    return _converted(spark, path, output, ".docx", r"(?i)\.docx$", form, replace)


def convert_html(spark: SparkSession, path: str, output: str | None = None, method="auto", replace=False, extract_images=True, image_dir: str | None = None) -> list[str]:
    """Markdown of HTML files; embedded images become files, or notes without extract_images."""
    if method not in ("auto", "regex"):
        raise ValueError("method must be auto or regex; others need programs that this engine doesn't use")
    if not extract_images:
        convert = lambda c: html.markdown(images.with_placeholders(html.without_boilerplate(as_text(c))))
        return _converted(spark, path, output, ".html", r"(?i)\.html?$", convert, replace)
    folder = image_dir or os.path.join(output if output and os.path.isdir(output) else os.path.dirname(os.path.abspath(path)) if os.path.isfile(path) else path, "images")
    single = os.path.isfile(path)
    base = os.path.dirname(os.path.abspath(path)) if single else path
    rows = scan(spark, base, explicit=[os.path.basename(path)]) if single else scan(spark, base, everything=True).filter(F.col("rel_path").rlike(r"(?i)\.html?$"))
    stem = F.regexp_replace(select.name(F.col("rel_path")), r"\.[^.]+$", "")
    found = rows.select(images.extract_images(html.without_boilerplate(as_text(F.col("content"))), F.concat(stem, F.lit("_image"))).alias("g")).select(F.explode("g.images").alias("i"))
    write.write(found.select(F.col("i.name").alias("rel_path"), F.col("i.data").alias("content")), folder, "replace")
    convert = lambda c: html.markdown(images.extract_images(html.without_boilerplate(as_text(c)), F.concat(stem, F.lit("_image")))["html"])
    return _converted(spark, path, output, ".html", r"(?i)\.html?$", convert, replace)


def extract_report(path: str, sections: list[int] | None = None, strict=False, form="yaml") -> str:
    """One report's extract as text. Tables of reports go through functions.report."""
    with open(path, "rb") as f:
        page = f.read().decode("utf-8", "replace")
    return report.FORMATS[form](report.extract(page, sections, strict))


def archive_and_ingest(spark: SparkSession, directory: str, output: str, base_url: str, endpoint="train", method="auto", remove=False, transport=ingest.http, test_endpoints=False, split=False, split_dir: str | None = None, llm=True, max_words=chunk.INGEST_WORDS, **options) -> dict:
    """Send a directory's files one by one if they are few and small, else as an archive or its parts."""
    filters = {k: v for k, v in options.items() if k != "extract_code_only"}
    tried = None
    if test_endpoints:  # with the folder's README, else its first file of a type that is taken
        top = scan(spark, directory, **{**filters, "explicit": ["README.md"]}).unionByName(scan(spark, directory, **{**filters, "recurse": False}))
        first = top.select(as_text(F.col("content")).alias("t")).first()
        tried = ingest.try_endpoints(first.t, base_url, transport) if first else {}
    if method == "auto":
        method = ingest.method(scan(spark, directory, **filters))
    if method == "directory":
        rows = scan(spark, directory, **filters).select("rel_path", as_text(F.col("content")).alias("content"))
    else:
        got = archive(spark, directory, output, llm=llm, split=split, split_dir=split_dir, max_words=max_words, **options)
        paths = got["parts"] if split else [output]
        texts = []
        for p in paths:
            with open(p, encoding="utf-8") as f:
                texts.append((relative(p, os.path.dirname(os.path.abspath(output))), f.read()))
        rows = spark.createDataFrame(texts, "rel_path string, content string")
    answers = ingest.sent(rows, base_url, endpoint, transport).collect()
    if remove and method == "archive":
        os.unlink(output)
    return {**({} if tried is None else {"endpoints": tried}), "method": method, "sent": len(answers), "ok": sum(bool(r.ok) for r in answers), "errors": [r.error for r in answers if r.error]}


def generate(plan_path: str, library_path: str, output: str, day: str, model="mock") -> str:
    """Write the archive that a model makes of a study plan and a library's archive, a file or a folder of parts."""
    def read(p: str) -> str:
        with open(p, encoding="utf-8") as f:
            return f.read()

    if os.path.isdir(library_path):
        parts = [read(os.path.join(library_path, n)) for n in sorted(os.listdir(library_path)) if n.endswith(".txt")]
        library = "\n".join(line for t in parts for line in t.splitlines() if line.strip() not in ("<DOCUMENT>", "</DOCUMENT>") and not re.match("# Part ", line))
    else:
        library = read(library_path)
    _save(output, ingest.generate(read(plan_path), library, day, model), False)
    return output


def describe(parser, command: str | None = None) -> str:
    """The commands and their arguments as JSON."""
    subs = next(a for a in parser._actions if a.__class__.__name__ == "_SubParsersAction")
    if command and command not in subs.choices:
        raise ValueError(f"unknown command {command}")
    out = []
    for name, sub in subs.choices.items():
        if command in (None, name):
            args = [
                {"name": a.dest, "flags": list(a.option_strings), "required": a.required, "description": a.help or "", "type": getattr(a.type, "__name__", None) or "str", "default": a.default, "choices": list(a.choices) if a.choices else None, "nargs": a.nargs}
                for a in sub._actions if a.dest != "help"
            ]
            out.append({"name": name, "description": sub.description or "", "arguments": args})
    return json.dumps(out[0] if command else {"program": parser.prog, "commands": out}, indent=2, default=str)
