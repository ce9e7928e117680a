"""Names of this package's functions in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tomeworks.functions import cells, docx, images, report
from tomeworks.functions.arrow import make
from tomeworks.operators.write import safe_path

UDFS = {
    "tw_cells": cells.parse_cells, "tw_quarto_cells": cells.parse_quarto, "tw_notebook": cells.to_notebook, "tw_notebook_text": cells.from_notebook, "tw_strip_outputs": cells.strip_outputs,
    "tw_quarto": cells.to_quarto, "tw_quarto_text": cells.from_quarto, "tw_databricks": cells.to_databricks, "tw_chunk_header": cells.parse_header, "tw_kernel": cells.kernel_of,
    "tw_docx": docx.to_markdown, "tw_images": images.extract_images, "tw_placeholders": images.with_placeholders, "tw_report": report.report, "tw_report_text": report.report_text, "tw_safe_path": safe_path,
}
_LLM, _STANDARD = "#" * 80 + "\n# FILE ", "---\nFilename: "


class Sections:
    """Sections of an archive's text as rows."""

    def eval(self, text: str):
        llm = text is not None and _LLM in text
        for pos, piece in enumerate((text or "").split(_LLM if llm else _STANDARD)[1:], 1):
            first, _, rest = piece.partition("\n")
            if llm:
                _, colon, path = first.strip().partition(": ")
                _, there, content = rest.partition("\n")
                content = content.lstrip("\n")
            else:
                path, there, content = piece.partition("\n---\n")
                colon = there
            if colon and there:
                yield pos, path.strip(), content, llm


def register(spark: SparkSession) -> list[str]:
    """Register all functions, and the table function tw_sections(text); the names."""
    from tomeworks.session import attach

    attach(spark)
    for name, f in UDFS.items():
        spark.udf.register(name, make(f.function, f.returns))
    spark.udtf.register("tw_sections", udtf(Sections, returnType="pos int, rel_path string, content string, is_llm boolean"))
    return [*UDFS, "tw_sections"]
