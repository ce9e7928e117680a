"""Command line: python -m tomeworks COMMAND ..."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from tomeworks import __version__, api
from tomeworks.functions import docx
from tomeworks.operators import chunk, ingest, select


def _selection(p: argparse.ArgumentParser) -> None:
    p.add_argument("directory", help="folder to archive")
    p.add_argument("output_file", help="archive to write")
    p.add_argument("--file_types", nargs="+", default=list(select.FILE_TYPES), help="endings of files to take")
    p.add_argument("--no-subdirectories", action="store_true", help="files at the top only")
    p.add_argument("--extract-code-only", action="store_true", help="notebooks and Quarto documents in cell form")
    p.add_argument("--llm-friendly", action="store_true", help="form for language models")
    p.add_argument("--file_prefixes", nargs="+", help="only files whose names begin so")
    p.add_argument("--split-output", action="store_true", help="write parts, too")
    p.add_argument("--max-tokens", type=int, default=chunk.ARCHIVE_WORDS, help="words in a part")
    p.add_argument("--split-output-dir", help="folder of the parts")
    p.add_argument("--exclude-dirs", nargs="+", help="folders to leave out")
    p.add_argument("--root-files", nargs="+", help="files to take whatever their type")
    p.add_argument("--include-subdirs", nargs="+", help="only these folders")
    p.add_argument("--explicit-files", nargs="+", metavar="FILE", help="exactly these files")
    p.add_argument("--dry-run", action="store_true", help="say what would be archived")
    p.add_argument("--update", action="store_true", help="touch only what has changed")


def build() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tomeworks", description="Archives of text files, on Spark")
    parser.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, description: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=description, description=description)

    def sending(p):
        p.add_argument("--endpoint", choices=ingest.ENDPOINTS, default="train", help="where to send documents")
        p.add_argument("--test-endpoints", action="store_true", help="try all endpoints first")
        p.add_argument("--base-url", required=True, help="address of the service")

    _selection(command("archive", "archive a folder"))
    p = command("archive-and-ingest", "archive a folder and send it to a service")
    _selection(p)
    p.set_defaults(llm_friendly=True, max_tokens=chunk.INGEST_WORDS)
    p.add_argument("--ingestion-method", choices=["directory", "archive", "auto"], default="auto", help="file by file, or as an archive")
    p.add_argument("--rm-archive", action="store_true", help="delete the archive afterwards")
    sending(p)
    p = command("ingest", "send one document to a service")
    p.add_argument("--file", help="the document", required=True)
    sending(p)
    p = command("unpack", "write an archive's files")
    p.add_argument("archive_file")
    p.add_argument("output_directory")
    p.add_argument("--replace_existing", action="store_true")
    p.add_argument("--kernel", default=None)
    p.add_argument("--force", action="store_true", help="unpack the form for language models, too")
    p.add_argument("--strict-detect", action="store_true", help="tell the form by the whole text, as long tables of contents need")
    p = command("archive_subdirectories", "archive each folder below a folder")
    p.add_argument("parent_directory")
    p.add_argument("--directories", nargs="+")
    p.add_argument("--combined_archive_dir")
    p.add_argument("--combined_archive_name", default="all_combined_archives.txt")
    p.add_argument("--file_types", nargs="+", default=list(select.FILE_TYPES))
    for name, what in (("extract-notebooks", "notebooks"), ("extract-notebooks-and-quarto", "notebooks and Quarto documents")):
        p = command(name, f"write an archive's {what}")
        p.add_argument("archive_file")
        p.add_argument("output_directory")
        p.add_argument("--replace_existing", action="store_true")
        p.add_argument("--kernel", default=None)
    p = command("convert-word", "Word files to markdown")
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--method", choices=list(docx.METHODS), default="auto")
    p.add_argument("--replace-existing", action="store_true")
    p = command("convert-html", "HTML files to markdown")
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--method", choices=["auto", "regex"], default="auto")
    p.add_argument("--no-extract-images", action="store_true")
    p.add_argument("--image-dir")
    p.add_argument("--replace-existing", action="store_true")
    p = command("extract-report", "extract a structured report")
    p.add_argument("html_file")
    p.add_argument("--format", choices=["yaml", "json", "markdown"], default="yaml")
    p.add_argument("--sections", help="numbers of sections, with commas")
    p.add_argument("--output", "-o")
    p.add_argument("--strict", action="store_true")
    p = command("generate", "have a model write an archive")
    p.add_argument("--study-plan", required=True)
    p.add_argument("--library-archive", dest="library_archive", required=True)
    p.add_argument("--output-archive", required=True)
    p.add_argument("--llm-model", default="mock")
    p = command("describe", "the commands as JSON")
    p.add_argument("describe_command", nargs="?", default=None)
    p.add_argument("--format", choices=["json"], default="json")
    return parser


def _options(a: argparse.Namespace) -> dict:
    return {
        "file_types": a.file_types, "recurse": not a.no_subdirectories, "prefixes": a.file_prefixes, "subdirs": a.include_subdirs, "exclude": a.exclude_dirs, "roots": a.root_files, "explicit": a.explicit_files,
        "extract_code_only": a.extract_code_only,
    }


def run(argv: list[str] | None = None, spark=None) -> int:
    parser = build()
    a = parser.parse_args(argv)
    if a.command == "describe":
        print(api.describe(parser, a.describe_command))
        return 0
    if a.command == "generate":
        print(api.generate(a.study_plan, a.library_archive, a.output_archive, datetime.date.today().isoformat(), a.llm_model))
        return 0
    if a.command == "extract-report":
        try:
            wanted = [int(x) for x in a.sections.split(",")] if a.sections else None
        except ValueError:
            print(f"not numbers of sections: {a.sections}", file=sys.stderr)
            return 1
        text = api.extract_report(a.html_file, wanted, a.strict, a.format)
        if a.output:
            api._save(a.output, text, False)
        else:
            print(text)
        return 0
    if a.command == "ingest":
        with open(a.file, encoding="utf-8") as f:
            text = f.read()
        print(json.dumps(ingest.try_endpoints(text, a.base_url) if a.test_endpoints else ingest.send(text, a.base_url, a.endpoint)))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tomeworks").getOrCreate()
    if a.command == "archive":
        got = api.archive(spark, a.directory, a.output_file, a.llm_friendly, split=a.split_output, max_words=a.max_tokens, split_dir=a.split_output_dir, update=a.update, dry_run=a.dry_run, **_options(a))
    elif a.command == "archive-and-ingest":
        got = api.archive_and_ingest(spark, a.directory, a.output_file, a.base_url, a.endpoint, a.ingestion_method, a.rm_archive, test_endpoints=a.test_endpoints, split=a.split_output, split_dir=a.split_output_dir, llm=a.llm_friendly, max_words=a.max_tokens, **_options(a))
    elif a.command == "unpack":
        got = api.unpack(spark, a.archive_file, a.output_directory, a.replace_existing, a.kernel, a.force, a.strict_detect)
    elif a.command == "archive_subdirectories":
        got = api.archive_subdirectories(spark, a.parent_directory, a.directories, a.combined_archive_dir, a.combined_archive_name, a.file_types)
    elif a.command in ("extract-notebooks", "extract-notebooks-and-quarto"):
        got = api.extract_notebooks(spark, a.archive_file, a.output_directory, a.replace_existing, a.kernel, a.command.endswith("quarto"))
    elif a.command == "convert-word":
        got = api.convert_word(spark, a.input, a.output, a.method, a.replace_existing)
    else:
        got = api.convert_html(spark, a.input, a.output, a.method, a.replace_existing, not a.no_extract_images, a.image_dir)
    print(json.dumps(got, default=str))
    return 0
