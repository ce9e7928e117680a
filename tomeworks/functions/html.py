"""HTML to markdown as a chain of native expressions, so that scans prune columns and nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeworks.functions.text import let, replace_each, strip

#: The rest of a start tag, and what an element holds.
_TO, _IN = "[^>]*>", "(.*?)"
_ATTRIBUTE = r"""["']([^"']*)["']"""


def element(tag: str, inner: str = _IN, flags: str = "is") -> str:
    """Pattern of an element with its content."""
    return f"(?{flags})<{tag}{_TO}{inner}</{tag}>"


def _with_id(name: str) -> str:
    return rf"""<div[^>]*id=["']{name}["']{_TO}"""


_ENDS = "|".join(["""<div[^>]*id=["']quarto-back-to-top""", "<script", "<footer", "$"])
#: Where the content lies, in order of preference.
AREAS = (rf"(?isU){_with_id('quarto-content')}(.*)</div>\s*(?:{_ENDS})", element("main"), element("body"))
#: What is no content, in the order of removal.
NOISE = (
    *(element(tag, ".*?") for tag in ("script", "style", "nav", "header", "footer")),
    *(f"(?is){_with_id(name)}.*?</div>" for name in ("quarto-sidebar", "quarto-margin-sidebar", "TOC")),
    *(rf"(?i)<{tag}[^>]*/?>" for tag in ("link", "meta")),
)
NAMED = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
FENCE = rf"(?isU)<pre{_TO}\s*<code{_TO}{_IN}</code>\s*</pre>"
_ROW, _CELL = element("tr"), element("(?:th|td)")
_QUOTE = element("blockquote")
_IMAGE = {order: rf"(?iU)<img{''.join(f'[^>]*{name}={_ATTRIBUTE}' for name in order)}[^>]*/?\s*>" for order in (("src", "alt"), ("alt", "src"))}
BEFORE_TABLES = (
    (element("code"), "`$1`"),
    *((element(f"h{i}"), "\n" + "#" * i + " $1\n") for i in range(6, 0, -1)),
    *((element(tag), f"{mark}$1{mark}") for tag, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"))),
    (rf"(?is)<a[^>]*href={_ATTRIBUTE}{_TO}{_IN}</a>", "[$2]($1)"),
    (_IMAGE["src", "alt"], "![$2]($1)"),
    (_IMAGE["alt", "src"], "![$1]($2)"),
)
_WRAPPERS = "|".join(["div", "span", "section", "article", "aside"])
AFTER_QUOTES = (
    (element("p"), "$1\n\n"),
    (r"(?i)<br[^>]*/?>", "\n"),
    (r"(?iU)<hr[^>]*/?\s*>", "\n---\n"),
    *((rf"(?i)<{tag}>", "\n") for tag in ("ul[^>]*", "/ul", "ol[^>]*", "/ol")),
    (element("li"), "- $1\n"),
    *((rf"(?i)<{tag}>", "\n") for tag in ("dl[^>]*", "/dl")),
    (element("dt"), "**$1**\n"),
    (element("dd"), ": $1\n"),
    (rf"(?i)</?(?:{_WRAPPERS}){_TO}", ""),
    (r"<[^>]+>", ""),
)
TIDY = ((r"(?U)\n\s*\n\s*\n", "\n\n"), (r" +", " "))


def chain(text: Column, steps) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def without_boilerplate(html: Column) -> Column:
    """What lies in the content area, without scripts, styles, navigation and the like; empty for null."""
    area = F.coalesce(*[F.when(html.rlike(p), F.regexp_extract(html, p, 1)) for p in AREAS], html, F.lit(""))
    return strip(chain(area, [(p, "") for p in NOISE]))


def _character(code: Column) -> Column:
    """The character of a number; null where there is none."""
    ok = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code.cast("int")), 8, "0")), "UTF-32"))


def unescape(text: Column) -> Column:
    """Named entities one after the other, &amp; first, then decimal and hexadecimal ones; numbers of no character stay."""
    for name, by in NAMED:
        text = F.replace(text, F.lit(name), F.lit(by))
    number = lambda e: F.regexp_extract(e, r"(\d+)", 1)
    text = replace_each(text, r"&#\d+;", lambda e: F.coalesce(F.when(F.length(number(e)) <= 9, _character(number(e).cast("bigint"))), e))
    digits = lambda e: F.regexp_extract(e, r"#x([0-9a-fA-F]+)", 1)
    return replace_each(text, r"&#x[0-9a-fA-F]+;", lambda e: F.coalesce(F.when(F.length(digits(e)) <= 8, _character(F.conv(digits(e), 16, 10).cast("bigint"))), e))


def tables(html: Column) -> Column:
    """HTML tables as markdown tables; a table without rows stays."""

    def cell(c: Column) -> Column:
        c = F.replace(strip(F.regexp_replace(c, r"<[^>]+>", "")), F.lit("|"), F.lit("\\|"))
        return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")

    def row(r: Column, i: Column) -> Column:
        def shown(cells: Column) -> Column:
            line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
            rule = F.concat(F.lit("\n| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |"))
            return F.when(F.size(cells) > 0, F.concat(line, F.when(i == 0, rule).otherwise(F.lit(""))))

        return let(F.transform(F.regexp_extract_all(r, F.lit(_CELL), 1), cell), shown)

    def table(t: Column) -> Column:
        shown = lambda rows: F.filter(F.transform(rows, row), lambda x: x.isNotNull())
        rows = F.regexp_extract_all(t, F.lit(_ROW), 1)
        return let(rows, lambda r: F.when(F.size(r) == 0, t).otherwise(F.concat(F.lit("\n"), F.array_join(shown(r), "\n"), F.lit("\n"))))

    return replace_each(html, element("table", ".*?"), table)


def quotes(html: Column) -> Column:
    inner = lambda b: strip(F.regexp_extract(b, _QUOTE, 1))
    return replace_each(html, element("blockquote", ".*?"), lambda b: F.concat(F.lit("\n> "), F.replace(inner(b), F.lit("\n"), F.lit("\n> ")), F.lit("\n")))


def markdown(html: Column, blocks: bool = True) -> Column:
    """Markdown of HTML; empty for null. Fences carry no language. Without `blocks`, code fences, tables and quotes aren't looked for."""
    text = F.coalesce(html, F.lit(""))
    if blocks:
        text = replace_each(text, FENCE, lambda b: F.concat(F.lit("\n```\n"), unescape(F.regexp_extract(b, FENCE, 1)), F.lit("\n```\n")))
    text = chain(text, BEFORE_TABLES)
    if blocks:
        text = quotes(tables(text))
    return strip(chain(unescape(chain(text, AFTER_QUOTES)), TIDY))
