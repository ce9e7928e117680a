"""A Spark-native engine for text corpora."""

__version__ = "0.2.0"

_API = (
    "archive", "archive_and_ingest", "archive_subdirectories", "combine", "concatenate", "convert_html", "convert_word", "corpus", "extract_notebooks", "extract_report", "generate", "split_directory",
    "split_file", "strip_outputs", "unpack", "unpack_combined", "validate",
)
__all__ = [*_API, "as_json", "as_markdown", "as_yaml", "read_archive", "scan"]


def __getattr__(name: str):
    """Whole jobs and formats, imported when they are first asked for, so that workers needn't."""
    if name in _API:
        from tomeworks import api as module
    elif name in ("as_json", "as_markdown", "as_yaml"):
        from tomeworks.functions import report as module
    elif name in ("scan", "read_archive"):
        from tomeworks.sources import tree as module
    else:
        raise AttributeError(name)
    return getattr(module, name)
