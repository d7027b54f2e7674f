import time

import pytest

from kbspark.functions.html import elements, parse
from kbspark.sources.html import extract_attachments, html_to_text

CASES = [
    ("<h1>A</h1><h3> B  c </h3><h6></h6>", "# A\n\n### B c"),
    ("<p>one</p><p> </p><p>two<br>lines", "one\n\ntwo lines"),
    ("<ul><li>a</li><li></li><li>b<ul><li>c</ul></ul>", "- a\n- b c"),
    ("<ol><li>a<li> <li>b</ol>", "1. a\n2. b"),
    ("<pre>x\n  y</pre>", "[CODE BLOCK]\nx\ny\n[END CODE BLOCK]"),
    ("<code>z</code><code></code>", "[CODE BLOCK]\nz\n[END CODE BLOCK]"),
    ('<div class="confluence-information-macro confluence-information-macro-warning">w</div>', "[WARNING] w"),
    ('<div class="confluence-information-macro confluence-information-macro-tip">t</div>', "[TIP] t"),
    ('<div class="confluence-information-macro confluence-information-macro-note">n</div>', "[NOTE] n"),
    ('<div class="confluence-information-macro">i</div>', "[INFO] i"),
    ("<div>bare<p>kept</p></div><nav>n</nav><script>s</script><style>t</style><footer>foot</footer><span> x </span>", "kept\n\nfoot\nx"),
    ("<section><article><main><p>deep</p></main></article></section>", "deep"),
    ("text under the body<p>p</p>", "p"),
    ("<html><head><title>T</title><script>x</script></head><body><p>a &amp; b&nbsp;c</p></body></html>", "a & b c"),
    ("", ""),
    (None, ""),
    ("  ", ""),
]


def texts(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return [r.content for r in html_to_text(df).orderBy("page_id").collect()]


def test_forms(spark):
    assert texts(spark, *(p for p, _ in CASES)) == [t for _, t in CASES]


def test_tables(spark):
    page_text = lambda p: texts(spark, p)[0]
    page = "<table><tr><th>Source App</th><th>Data Provided</th><th>Frequency</th></tr><tr><td>MPF</td><td>Mortgage data</td><td>Daily</td></tr><tr><td>CRS</td><td>Collateral records</td><td>Weekly</td></tr></table>"
    assert page_text(page).split("\n") == [
        "| Source App | Data Provided | Frequency |",
        "| --- | --- | --- |",
        "| MPF | Mortgage data | Daily |",
        "→ Source App: MPF | Data Provided: Mortgage data | Frequency: Daily",
        "| CRS | Collateral records | Weekly |",
        "→ Source App: CRS | Data Provided: Collateral records | Frequency: Weekly",
    ]
    # without th the first row is header and data; empty cells and cells beyond the header have no pair
    assert page_text("<table><tbody><tr><td>a<td>b<tr><td>1<td><td>3</table>").split("\n") == ["| a | b |", "| --- | --- |", "| a | b |", "→ a: a | b: b", "| 1 | | 3 |", "→ a: 1"]
    # rows without td go; rows of inner tables come too
    assert page_text("<table><tr><th>h</th></tr><tr></tr><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table>").split("\n") == ["| h |", "| --- |", "| x in | in |", "→ h: x in", "| in |", "→ h: in"]


DRAWIO = '<ac:structured-macro ac:name="drawio"><ac:parameter ac:name="diagramName">My Flow</ac:parameter><ac:plain-text-body><![CDATA[<mxGraphModel><mxCell id="1" value="Start"/><mxCell value="&lt;b&gt;x"/><mxCell value="y"/><mxCell value=" End "/></mxGraphModel>]]></ac:plain-text-body></ac:structured-macro>'
UML = '<ac:structured-macro ac:name="plantuml"><ac:plain-text-body><![CDATA[A -> B\nB -> C]]></ac:plain-text-body></ac:structured-macro>'


def test_diagrams(spark):
    page_text = lambda p: texts(spark, p)[0]
    assert page_text(f"<p>t</p>{DRAWIO}").endswith("## Diagrams\n\n[DIAGRAM: My Flow]\nThis diagram contains the following elements: Start, End")
    assert page_text(UML).endswith("## Diagrams\n\n[DIAGRAM: PlantUML Flow]\nA -> B\nB -> C")
    page = '<ac:image><ri:attachment ri:filename="flow.PNG"/></ac:image><ac:image><ri:attachment ri:filename="a.txt"/></ac:image><ac:structured-macro ac:name="gliffy"><ac:parameter ac:name="name">g</ac:parameter></ac:structured-macro>'
    rows = spark.createDataFrame([(7, page), (8, None), (9, page + page)], "page_id int, html string")
    found = [(7, "image", "flow.PNG"), (7, "gliffy", "g.png")] + [(9, "gliffy", "g.png")] * 2 + [(9, "image", "flow.PNG")] * 2
    assert sorted(map(tuple, extract_attachments(rows).collect())) == sorted(found)
    # drawn diagrams come first, whatever their order; one without labels is none
    assert [x for x in page_text(UML + DRAWIO.replace("diagramName", "other") + DRAWIO.replace("value", "v")).split("\n") if x.startswith("[DIAGRAM")] == ["[DIAGRAM: Draw.io Diagram]", "[DIAGRAM: PlantUML Flow]"]


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "x"), (2, None, None), (2, "", "y")], "page_id int, html string, content string")
    assert sorted(tuple(r) for r in html_to_text(df).collect()) == [(1, "a"), (2, ""), (2, "")]
    assert extract_attachments(df).count() == 0 and html_to_text(df.limit(0)).count() == 0


def test_elements():
    assert elements(parse('<h2 class="k">A</h2><ol><li>x</ol><table><tr><th>h<td>d</table>')) == [
        {"tag": "h2", "name": "k", "text": "A", "rows": []},
        {"tag": "ol", "name": "", "text": "", "rows": [{"th": [], "td": ["x"]}]},
        {"tag": "table", "name": "", "text": "", "rows": [{"th": ["h"], "td": ["d"]}]},
    ]


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<p>x" * 100_000, "<i>" * 100_000 + "<td>x" * 100_000])
def test_tags_that_close_nothing_take_linear_time(page):
    start = time.time()
    parse(page)
    assert time.time() - start < 8
