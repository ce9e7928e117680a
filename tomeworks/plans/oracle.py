"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from tomeworks.functions import html
from tomeworks.plans.queries import CHUNK_WORDS, LINE_WORDS, STAMP

_RULE = "#" * 80
_FILES = "files AS (SELECT source AS archive_id, source || '/' || lang || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.md' AS rel_path, text AS content FROM documents)"
_NUM = "num AS (SELECT *, CAST(row_number() OVER (PARTITION BY archive_id ORDER BY rel_path) AS INT) AS pos FROM files)"
_WORD = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _words(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, '{_WORD}')) AS BIGINT)"


_STD = "'---' || chr(10) || 'Filename: '"
_ESC = f"replace(content, {_STD}, '---\\nFilename: ')"
_SECTION = {
    False: f"{_STD} || rel_path || chr(10) || '---' || chr(10) || {_ESC} || chr(10) || chr(10)",
    True: f"'{_RULE}' || chr(10) || '# FILE ' || pos || ': ' || rel_path || chr(10) || '{_RULE}' || chr(10) || chr(10) || content || chr(10) || chr(10)",
}
_HEAD = {
    False: f"'# Archive created on: {STAMP}' || chr(10) || chr(10) || '# Standard Archive Format' || chr(10) || chr(10)",
    True: f"'# Archive created on: {STAMP}' || chr(10) || chr(10) || '# LLM-FRIENDLY CODE ARCHIVE' || chr(10) || '# Generated from: ' || archive_id || chr(10) || '# Date: {STAMP}' || chr(10) || chr(10)",
}
_TOC = "'# TABLE OF CONTENTS' || chr(10) || string_agg(pos || '. ' || rel_path, chr(10) ORDER BY pos) || chr(10) || chr(10)"


def _sections(llm: bool) -> str:
    return f"WITH {_FILES}, {_NUM} SELECT archive_id, pos, rel_path, {_SECTION[llm]} AS section FROM num"


def _archive(llm: bool) -> str:
    return f"SELECT archive_id, CAST(count(*) AS INT) AS n_files, {_HEAD[llm]} || {_TOC} || string_agg({_SECTION[llm]}, '' ORDER BY pos) AS text FROM num GROUP BY archive_id"


_PLAIN = f"{_STD} || rel_path || chr(10) || '---' || chr(10) || content || chr(10) || chr(10)"
_CONCAT = f"SELECT archive_id, string_agg({_PLAIN}, '' ORDER BY rel_path) AS text FROM files GROUP BY archive_id"


def _fold(items: str, most: int, head: int, lines: bool) -> str:
    """Next-fit by a recursive walk over (archive_id, pos, words); pos is made dense from 1."""
    held = "true" if lines else "(f.held OR d.words > 0)"
    return f"""WITH RECURSIVE {items},
      d AS (SELECT archive_id, pos, words, row_number() OVER (PARTITION BY archive_id ORDER BY pos) AS n FROM items),
      f AS (SELECT archive_id, pos, n, CASE WHEN {head} > 0 AND {head} + words > {most} THEN 2 ELSE 1 END AS part,
                   CASE WHEN {head} > 0 AND {head} + words > {most} THEN words ELSE {head} + words END AS size, {'true' if lines else f'{head} + words > 0'} AS held
            FROM d WHERE n = 1
            UNION ALL
            SELECT d.archive_id, d.pos, d.n, f.part + CASE WHEN f.held AND f.size + d.words > {most} THEN 1 ELSE 0 END,
                   CASE WHEN f.held AND f.size + d.words > {most} THEN d.words ELSE f.size + d.words END, {held}
            FROM f JOIN d ON d.archive_id = f.archive_id AND d.n = f.n + 1)"""


_SIZED = f"{_FILES}, {_NUM}, items AS (SELECT archive_id, CAST(pos AS BIGINT) AS pos, {_words(_SECTION[False])} AS words FROM num)"
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"CASE WHEN length(text) = 0 THEN [] ELSE string_split_regex(regexp_replace(text, '(?:{_BREAKS})$', ''), '{_BREAKS}') END"
_LINE_ITEMS = f"""ls AS (SELECT doc_id, {_LINES} AS l FROM documents),
      items AS (SELECT CAST(doc_id AS VARCHAR) AS archive_id, CAST(i - 1 AS BIGINT) AS pos, {_words('l[i]')} AS words FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ls))"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pattern: str) -> tuple[str, str]:
    """A Java pattern's body and its flags for DuckDB."""
    flags = "g"
    if pattern.startswith("(?"):
        given, _, pattern = pattern[2:].partition(")")
        flags += "".join(f for f in given if f in "is")
    return pattern, flags


def _chain(expr: str, steps) -> str:
    for pattern, by in steps:
        body, flags = _re2(pattern)
        for k in "123":
            by = by.replace(f"${k}", f"\\{k}")
        parts = " || chr(10) || ".join(_quoted(p) for p in by.split("\n"))
        expr = f"regexp_replace({expr}, {_quoted(body)}, {parts}, '{flags}')"
    return expr


def _strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"


def _body() -> str:
    picks = " ".join(f"WHEN regexp_matches(html, {_quoted(_re2(p)[0])}, 'is') THEN regexp_extract(html, {_quoted(_re2(p)[0])}, 1, 'is')" for p in html.AREAS)
    return _strip(_chain(f"CASE {picks} ELSE html END", [(p, "") for p in html.NOISE]))


def _named(expr: str) -> str:
    for name, by in html.NAMED:
        expr = f"replace({expr}, {_quoted(name)}, {_quoted(by)})"
    return expr


def _markdown() -> str:
    return _strip(_chain(_named(_chain("body", [*html.BEFORE_TABLES, *html.AFTER_QUOTES])), html.TIDY))


_KIND = "CASE role WHEN 'system' THEN 'raw' WHEN 'user' THEN 'markdown' ELSE 'code' END"
_CELLS = f"cells AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, {_KIND}, text) AS cell, {_KIND} AS kind, text AS src FROM conversations)"
_Q = "'\"\"\"'"
_BLOCK = f"cell || chr(10) || {_Q} || chr(10) || src || CASE WHEN src LIKE '%' || chr(10) THEN '' ELSE chr(10) END || {_Q} || chr(10) || chr(10)"
_LLM_PIECE = "regexp_replace(content || chr(10) || chr(10), '^\\n+', '')"


_N = "chr(10)"
_SHOWN = f"{_CELLS}, shown AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY cell) AS BIGINT) AS n FROM cells WHERE regexp_matches(src, '{_WORD}'))"
_CODE = f"'```{{r}}' || {_N} || src || {_N} || '```'"
#: Code by itself, all that stands between code as one block.
_BLOCKS = f"""{_SHOWN}, marked AS (SELECT *, count(*) FILTER (kind = 'code') OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS before FROM shown),
      blocks AS (SELECT conv_id, kind = 'code' AS code, before, string_agg(src, {_N} || {_N} ORDER BY n) AS src, min(n) AS first FROM marked GROUP BY conv_id, kind = 'code', before),
      counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS k FROM blocks)"""
_LINKS = "list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x: replace(replace(replace(trim(regexp_replace(x, '<[^>]+>', '', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))"
_L = f"l AS (SELECT page_id, url, CAST(page_id AS VARCHAR) AS p, {_LINKS} AS links FROM pages)"
_DATE = "'2024-01-0' || (page_id % 9 + 1)"


def _items(expr: str, sep: str = "'|'", of: str = "links") -> str:
    return f"array_to_string(list_transform({of}, lambda x, i: {expr}), {sep})"


def _split_archives() -> str:
    head = f"{_HEAD[True]} || {_TOC}"
    items = f"{_FILES}, {_NUM}, items AS (SELECT archive_id, CAST(pos AS BIGINT) AS pos, {_words(_SECTION[True])} AS words, length({_SECTION[True]}) AS chars FROM num UNION ALL SELECT archive_id, 0, {_words('head')}, length(head) FROM (SELECT archive_id, {head} AS head FROM num GROUP BY archive_id))"
    return f"""{_fold(items, CHUNK_WORDS, 0, False)}, total AS (SELECT archive_id, sum(words) AS all_words FROM items GROUP BY ALL)
      SELECT f.archive_id, CASE WHEN all_words <= {CHUNK_WORDS} THEN CAST(0 AS BIGINT) ELSE CAST(f.part AS BIGINT) END AS part, CASE WHEN all_words <= {CHUNK_WORDS} THEN f.archive_id ELSE f.archive_id || '_part' || f.part END AS name, CAST(sum(i.words) AS BIGINT) AS words, CAST(sum(i.chars) AS BIGINT) AS chars
      FROM f JOIN items i ON f.archive_id = i.archive_id AND f.pos = i.pos JOIN total t ON t.archive_id = f.archive_id GROUP BY ALL"""


def _more() -> dict[str, str]:
    """SQL of notebooks, reports, Word files and trees."""
    line = lambda c: f"'- **{c}:** '"
    name = "'nb_' || lpad(CAST(conv_id AS VARCHAR), 10, '0') ||"
    turns = "t AS (SELECT conv_id, turn, role, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM conversations)"
    texts = f"string_agg(flat, {_N} ORDER BY turn, role, flat)"
    return {
        "split_archives": _split_archives(),
        "notebook_rebuild": f"WITH {_SHOWN} SELECT conv_id, count(*) FILTER (kind = 'code') AS code, count(*) FILTER (kind = 'markdown') AS markdown, count(*) FILTER (kind = 'raw') AS raw, CASE WHEN bool_or(regexp_matches(src, '\\b(library\\(|pacman::p_load\\(|tar_load\\(|tidyverse\\b|tidymodels\\b)')) THEN 'ir' ELSE 'python3' END AS kernel FROM shown GROUP BY conv_id",
        "quarto_round_trip": f"WITH {_BLOCKS} SELECT conv_id, true AS stable, CAST(sum(CASE WHEN code THEN length('# Cell ' || k) + 1 + length(src) + 2 ELSE length('# Markdown Cell ' || k) + 5 + length(src) + 6 END) AS BIGINT) AS chars FROM counted GROUP BY conv_id",
        "databricks_sources": f"WITH {_SHOWN} SELECT conv_id, concat('# Databricks notebook source' || {_N}, string_agg(CASE kind WHEN 'code' THEN src ELSE '# MAGIC %md' || {_N} || '# MAGIC ' || replace(src, {_N}, {_N} || '# MAGIC ') END, {_N} || {_N} || '# COMMAND ----------' || {_N} || {_N} ORDER BY n) FILTER (kind <> 'raw')) AS source FROM shown GROUP BY conv_id",
        "stripped_notebooks": f"WITH {_CELLS} SELECT conv_id, 2 * count(*) AS before, 2 * count(*) FILTER (kind <> 'code') AS after, string_agg(kind || ' ' || src, '|' ORDER BY cell) AS cells FROM cells GROUP BY conv_id",
        "extracted_notebooks": f"WITH {_SHOWN} SELECT {name} '.ipynb' AS rel_path, n AS cell, kind, src || {_N} AS src FROM shown",
        "extracted_quarto": f"WITH {_SHOWN} SELECT CAST(conv_id % 7 AS VARCHAR) AS archive_id, {name} '.qmd' AS rel_path, string_agg(CASE kind WHEN 'code' THEN {_CODE} ELSE src END, {_N} || {_N} ORDER BY n) || {_N} AS content FROM shown GROUP BY conv_id",
        "restored_files": f"WITH {_SHOWN} SELECT CAST(conv_id % 7 AS VARCHAR) AS archive_id, {name} '.ipynb' AS rel_path, count(*) AS cells FROM shown GROUP BY conv_id",
        "word_text": f"WITH {turns} SELECT conv_id, 'Conversation ' || conv_id || {_N} || 'Turns' || {_N} || {texts} || {_N} || 'turn' || {_N} || 'role' || {_N} || string_agg(turn || {_N} || role, {_N} ORDER BY turn, role, flat) AS text FROM t GROUP BY conv_id",
        "word_markdown": f"WITH {turns} SELECT conv_id, '# Conversation ' || conv_id || {_N} || '## Turns' || {_N} || {texts} || {_N} || {_N} || '| turn | role |' || {_N} || '| --- | --- |' || {_N} || string_agg('| ' || turn || ' | ' || role || ' |', {_N} ORDER BY turn, role, flat) || {_N} AS markdown FROM t GROUP BY conv_id",
        "tree_scan": f"WITH {_FILES} SELECT rel_path, CAST(octet_length(encode(content)) AS BIGINT) AS size, md5(content) AS md5, false AS root FROM files WHERE NOT regexp_matches(rel_path, '[89]\\.md$') AND rel_path NOT LIKE '%/fr/%'",
        "report_sections": f"WITH {_L} SELECT page_id, url AS title, 'A. Uthor' AS author, {_DATE} AS date, '0,1,2,3,4,5,6,7,8,9,10,11' AS found, 'Results at a glance' || CASE WHEN len(links) > 0 THEN '|Links' ELSE '' END AS tables, CASE WHEN len(links) > 0 THEN {_items("(i - 1) || ' ' || x")} END AS rows, {_items("'Section 7: Figures f' || (i - 1) || '.png ' || x")} AS figures FROM l",
        "report_contents": f"WITH {_L} SELECT page_id, page_id AS meta_page, 'page' AS meta_kind, page_id AS glance_page, CAST(len(links) AS BIGINT) AS glance_links, 'At a glance.' AS glance_text, url || {_N} || {_N} || 'Second.' AS methods, 'Inner.' AS inner_text, 'inside' AS inner_item, page_id AS card_page, 'page' AS card_kind, url AS manuscript, {_items('x', of="list_filter(links, lambda x: x <> '')")} AS limitations, true AS named FROM l",
        "report_formats": f"""WITH {_L}, k AS (SELECT *, list_filter(links, lambda x: x <> '')[:10] AS ten FROM l) SELECT page_id, concat_ws({_N}, '# ' || url, '**Author:** A. Uthor', '**Date:** ' || {_DATE}, '', '## Metadata', {line('page')} || p, {line('kind')} || 'page', '',
          '## Results at a Glance', '', '| Metric | Value |', '|--------|-------|', '| page | ' || p || ' |', '| links | ' || len(links) || ' |', '', '## Model Card', {line('Page')} || p, {line('Kind')} || 'page', '', '## Manuscript Results', url, '')
          || CASE WHEN len(ten) > 0 THEN {_N} || concat_ws({_N}, '## Limitations', {_items("'- ' || x", _N, 'ten')}, '') ELSE '' END || CASE WHEN len(links) > 0 THEN {_N} || concat_ws({_N}, '## Figures (' || len(links) || ' total)', {_items("'- [Section 7: Figures] ' || CASE WHEN x = '' THEN 'a' ELSE x END", _N)}, '') ELSE '' END AS markdown FROM k""",
    }


def oracle_sql() -> dict[str, str]:
    n14 = "CAST(page_id % 14 AS INT)"
    by_number = f"CASE WHEN {n14} <= 11 THEN {n14} ELSE 1 END"
    return {
        "archive_manifest": f"WITH {_FILES}, {_NUM} SELECT archive_id, pos, rel_path, length(content) AS chars, length(content) // 4 AS est_tokens, {_words('content')} AS words FROM num",
        "dry_run_summary": f"WITH {_FILES} SELECT archive_id, count(*) AS n_files, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(length(content)) // 4 AS BIGINT) AS est_tokens, CAST(sum({_words('content')}) AS BIGINT) AS words FROM files GROUP BY archive_id",
        "selected_files": f"WITH {_FILES}, n AS (SELECT rel_path, string_split(rel_path, '/')[-1] AS name FROM files) SELECT rel_path, name, '.md' AS ext, true AS of_type, name NOT LIKE '.%' AND name NOT LIKE '#%' AS shown, list_contains(string_split(rel_path, '/'), 'fr') AS excluded, rel_path LIKE 'src1/%' OR rel_path LIKE 'src2/en/%' AS below, starts_with(name, 'doc_00000001') OR starts_with(name, 'doc_00000002') AS prefixed FROM n",
        "selection": f"WITH {_FILES} SELECT archive_id, rel_path FROM files WHERE rel_path NOT LIKE '%/fr/%' AND (rel_path LIKE 'src1/%' OR rel_path LIKE 'src2/en/%')",
        "files_without_roots": f"WITH {_FILES} SELECT rel_path FROM files WHERE rel_path NOT LIKE '%/en/%'",
        "render_standard": _sections(False),
        "render_llm": _sections(True),
        "archives_standard": f"WITH {_FILES}, {_NUM} {_archive(False)}",
        "archives_llm": f"WITH {_FILES}, {_NUM} {_archive(True)}",
        "concatenated_archives": f"WITH {_FILES} {_CONCAT}",
        "table_of_contents": f"WITH {_FILES}, {_NUM} SELECT archive_id, {_TOC} AS toc FROM num GROUP BY archive_id",
        "unpack_standard": f"WITH {_FILES}, {_NUM} SELECT archive_id, pos, rel_path, {_ESC} || chr(10) || chr(10) AS content FROM num",
        "unpack_llm": f"WITH {_FILES}, {_NUM} SELECT archive_id, pos, rel_path, {_LLM_PIECE} AS content FROM num",
        "parsed_sections": f"WITH {_FILES}, {_NUM} SELECT 'std_' || archive_id AS archive_id, pos, rel_path, false AS is_llm, length({_ESC}) + 2 AS chars FROM num UNION ALL SELECT 'llm_' || archive_id, pos, rel_path, true, length({_LLM_PIECE}) FROM num",
        "archive_roundtrip": f"WITH {_FILES} SELECT rel_path, true AS same FROM files",
        "detect_format": f"WITH {_FILES}, {_NUM}, s AS ({_archive(False)}), l AS ({_archive(True)}), b AS (SELECT archive_id, 'standard' AS made, text FROM s UNION ALL SELECT archive_id, 'llm-friendly', text FROM l) "
        f"SELECT archive_id, made, CASE WHEN contains(left(text, 2000), '{_RULE}' || chr(10) || '# FILE ') THEN 'llm-friendly' ELSE 'standard' END AS by_window, CASE WHEN contains(text, '{_RULE}' || chr(10) || '# FILE ') THEN 'llm-friendly' ELSE 'standard' END AS by_text, contains(text, 'TABLE OF CONTENTS') AND contains(text, '{_RULE}' || chr(10) || '# FILE ') AS valid FROM b",
        "combined_archives": f"WITH {_FILES}, a AS ({_CONCAT}) SELECT string_agg('---' || chr(10) || 'Directory: ' || archive_id || chr(10) || '---' || chr(10) || text || chr(10) || chr(10), '' ORDER BY archive_id) AS text FROM a",
        "unpack_combined": f"WITH {_FILES}, {_NUM}, n AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY pos DESC) AS back FROM num) SELECT archive_id, pos, rel_path, content || repeat(chr(10), CASE WHEN back = 1 THEN 4 ELSE 2 END) AS content FROM n",
        "word_counts": f"SELECT doc_id, {_words('text')} AS words, length(text) // 4 AS est_tokens, CAST(len({_LINES}) AS BIGINT) AS lines FROM documents",
        "chunk_assignments": f"{_fold(_SIZED, CHUNK_WORDS, 20, False)} SELECT archive_id, pos, CAST(part AS BIGINT) AS part FROM f",
        "chunk_summary": f"{_fold(_SIZED, CHUNK_WORDS, 20, False)} SELECT f.archive_id, CAST(f.part AS BIGINT) AS part, count(*) AS sections, CAST(sum(d.words) AS BIGINT) AS words FROM f JOIN d ON f.archive_id = d.archive_id AND f.n = d.n GROUP BY ALL",
        "line_chunks": f"{_fold(_LINE_ITEMS, LINE_WORDS, 0, True)} SELECT archive_id, pos, CAST(part AS BIGINT) AS part FROM f",
        "content_keys": f"WITH {_FILES}, {_NUM}, a AS ({_archive(False)}) SELECT archive_id AS name, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '# Archive created on:') AND NOT starts_with(x, '# Date:')), chr(10))) AS key FROM a",
        "changed_archives": "SELECT DISTINCT source AS name FROM documents WHERE source = 'src3'",
        "stale_parts": "SELECT DISTINCT 'gone' AS name FROM documents WHERE source = 'src1'",
        "html_strip": f"SELECT page_id, {_body()} AS body FROM pages",
        "html_markdown": f"WITH b AS (SELECT page_id, {_body()} AS body FROM pages) SELECT page_id, {_markdown()} AS markdown FROM b",
        "html_tables": "SELECT page_id, chr(10) || array_to_string(list_prepend('| link |' || chr(10) || '| --- |', list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x: '| ' || replace(trim(regexp_replace(x, '<[^>]+>', '', 'g')), '|', '\\|') || '\\| x |')), chr(10)) || chr(10) AS markdown FROM pages",
        "html_entities": "SELECT doc_id, text FROM documents",
        "image_placeholders": "SELECT page_id, '<p>[Image 1: pic: PNG, ' || CASE WHEN octet_length(encode(url)) >= 1024 THEN printf('%.0fKB', octet_length(encode(url)) / 1024) ELSE octet_length(encode(url)) || ' bytes' END || ']</p>' AS noted, '<p>![pic](image_001.png)</p>' AS linked, url AS data, 'image_001.png' AS name FROM pages",
        "notebook_cells": f"WITH {_CELLS} SELECT conv_id, cell, kind, src FROM cells",
        "cells_render": f"WITH {_CELLS} SELECT conv_id, coalesce(string_agg(CASE kind WHEN 'code' THEN '# Cell ' || cell || chr(10) || src || chr(10) || chr(10) WHEN 'markdown' THEN '# Markdown Cell ' || {_BLOCK} ELSE '# Raw Cell ' || {_BLOCK} END, '' ORDER BY cell) FILTER (regexp_matches(src, '{_WORD}')), '') AS text FROM cells GROUP BY conv_id",
        "cell_markers": "SELECT conv_id, turn, turn % 2 = 0 OR regexp_matches(text, '(?m)^# (?:Raw |Markdown )?Cell \\d+\\s*$') AS markers, role = 'user' OR contains('# MAGIC' || text, '# MAGIC %') OR contains('# MAGIC' || text, '# MAGIC #') OR contains(text, '# Databricks notebook source') AS databricks FROM conversations",
        "report_section_numbers": f"SELECT page_id, {by_number} AS by_text, {by_number} AS by_id, CASE WHEN page_id % 2 = 0 THEN 4 END AS by_words FROM pages",
        "ingest_responses": "SELECT conv_id, turn, CASE WHEN turn = 0 THEN false ELSE turn = 1 OR role <> 'user' END AS ok FROM conversations",
        **_more(),
        "converted_pages": f"WITH b AS (SELECT page_id, {_body()} AS body FROM pages) SELECT 'page_' || lpad(CAST(page_id AS VARCHAR), 10, '0') || '.html' AS rel_path, {_markdown()} AS markdown FROM b",
    }
