from pyspark.sql import functions as F

from tomeworks.functions import html, images

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><main><h2>Head</h2>
<p>One <b>bold</b> and <em>soft</em> <a href="u">link</a> &amp;lt; &#8212; &#x41; &#99999999;</p>
<pre class="x"><code class="language-r">a = 1</code></pre>
<table><tr><th>a</th><th>b|c</th></tr><tr><td><i>1</i></td><td> 2
3</td></tr></table><blockquote>q1
q2</blockquote><ul><li>x</li></ul><hr><img src="s.png" alt="A"></main><footer>f</footer></body></html>"""


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_markdown(spark):
    got = one(spark, PAGE, lambda c: html.markdown(html.without_boilerplate(c)))
    for part in ("## Head", "**bold**", "*soft*", "[link](u)", "—", "A", "&#99999999;", "```\na = 1\n```", "| a | b\\|c |\n| --- | --- |\n| *1* | 2 3 |", "> q1\n> q2", "- x", "---", "![A](s.png)"):
        assert part in got, part
    assert "menu" not in got and "p{}" not in got


def test_break_begins_bold(spark):
    assert one(spark, "a<br>c <b>d</b>", html.markdown) == "a**c d**" or one(spark, "a<br>c <b>d</b>", html.markdown).startswith("a**c")


def test_areas(spark):
    assert one(spark, '<body><div id="quarto-content"><p>in</p></div><script>x</script></body>', html.without_boilerplate) == "<p>in</p>"
    assert one(spark, "<p>bare</p>", html.without_boilerplate) == "<p>bare</p>"
    assert one(spark, None, html.without_boilerplate) == "" and one(spark, None, html.markdown) == ""


def test_entities(spark):
    assert one(spark, "&amp;lt; &#233;&#x1F600; &#xD800; &apos;&nbsp;", html.unescape) == "< é😀 &#xD800; ' "
    assert one(spark, "&#38;#39;", html.unescape) == "&#39;"


def test_table_without_rows_stays(spark):
    assert one(spark, "<table>x</table>", html.tables) == "<table>x</table>"


def test_images():
    tag = '<img alt="a" src="data:image/png;base64,QUJD">'
    assert images.placeholders(tag + '<img src="data:image/svg+xml;base64,' + "QUJD" * 400 + '" alt="late">') == "[Image 1: a: PNG, 3 bytes][Image 2: SVG, 1KB]"
    got = images.extract(tag, "p")
    assert got == {"html": "![a](p_001.png)", "images": [{"name": "p_001.png", "data": b"ABC"}]}
    assert images.extract('<img src="data:image/png;base64,A">')["images"] == []
