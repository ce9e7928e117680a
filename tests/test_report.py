import json

from pyspark.sql import functions as F

from tomeworks.functions import report

YAML = '<pre class="sourceCode yaml"><code><span>id</span>: R1\nday: 2024-05-01</code></pre>'
GT = """<table class="gt_table"><thead><tr><td class="gt_title">The results</td></tr><tr class="x gt_col_headings"><th id="metric">M</th> <th>Value</th></tr></thead>
<tbody class="gt_table_body"><tr><td headers="metric">N</td><td>10</td></tr></tbody></table>"""
PLAIN = "<table><caption>C</caption><thead><tr><th>a</th><th>a</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"
PAGE = f"""<html><head><title>Rep</title><meta name="author" content="A"><meta name="date" content="D"></head><body><main>
<section id="section-0" class="level1"><h1>Section 0: Head</h1>{YAML}</section>
<section id="x" class="level1"><h1>Executive Summary</h1><p>Hello <b>all</b></p>{GT}</section>
<section class="level1"><h1>Section 6</h1><section><h2>Model Card</h2><ul><li><strong>Type:</strong> linear</li><li>plain</li></ul></section></section>
<section class="level1"><h1>Limitations</h1><section><h2>Sub</h2><p>t</p>{PLAIN}</section><ul><li>few</li></ul>
<div class="cell" id="c1"><figure><img src="f.png" alt="al"><figcaption>cap</figcaption></figure></div><img src="data:image/svg+xml;x"></section>
</main></body>"""


def test_extract():
    r = report.extract(PAGE)
    assert (r["title"], r["author"], r["date"], r["sections_found"]) == ("Rep", "A", "D", [0, 1, 6, 9])
    assert r["sections"][0]["metadata"]["id"] == "R1"
    assert r["sections"][1]["results_at_a_glance"] == {"N": "10"} and r["sections"][1]["text"] == "Helloall"
    assert r["sections"][6]["model_card"] == {"Type": "linear"}
    sub = r["sections"][9]["subsections"]["Sub"]
    assert sub["tables"][0] == {"title": "C", "columns": ["a", "a"], "rows": [{"a": "2"}]}
    assert r["sections"][9]["list_items"] == ["few"]
    assert r["figures"] == [{"section": "Limitations", "src": "f.png", "cell_id": "c1", "alt": "al", "caption": "cap"}]
    assert len(r["tables"]) == 2


def test_filter_strict_and_formats():
    assert report.extract(PAGE, [1])["sections_found"] == [1]
    try:
        report.extract(PAGE, strict=True)
    except ValueError as e:
        assert "2, 3" in str(e)
    else:
        raise AssertionError
    r = report.extract(PAGE)
    assert json.loads(report.as_json(r))["sections"]["0"]["metadata"]["day"] == "2024-05-01"
    md = report.as_markdown(r)
    assert "# Rep" in md and "- **Type:** linear" in md and "| N | 10 |" in md and "- [Limitations] cap" in md and "- few" in md
    assert "title: Rep" in report.as_yaml(r)


def test_minimal_and_malformed():
    assert report.extract("<main><p>x</p></main>")["sections_found"] == []
    assert report.extract("")["title"] == ""
    bad = report.extract('<section class="level1"><h1>Section 0</h1><pre class="sourceCode yaml"><code>a: [</code></pre></section>')
    assert bad["sections"][0]["metadata"]["_raw"] == "a: ["


def test_struct_and_numbers(spark):
    row = spark.createDataFrame([(PAGE,), (None,)], "h string").select(report.report(F.col("h")).alias("r")).collect()
    assert row[0].r.sections_found == [0, 1, 6, 9] and row[0].r.tables[0].rows == [{"metric": "N", "Value": "10"}] and row[1].r is None
    cases = [("Section 12", ""), ("x", "section-3"), ("Cohort  flow", ""), ("none", ""), ("Section 5", "section-3"), ("", "data_quality")]
    got = spark.createDataFrame(cases, "t string, i string").select("t", "i", report.section_number_column(F.col("t"), F.col("i")).alias("n")).collect()
    for r in got:
        assert r.n == report.section_number(r.t, r.i), r
