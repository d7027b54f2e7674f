"""HTML columns to text and to attachment rows.

A page is parsed once, in Arrow batches, to its elements, macros and pictures. Headings, list numbers, rows of tables
with their header pairs, code and notice marks, diagrams and the joining of all are columns. Null and blank pages have
no elements: their text is empty. Repeated rows stay, other columns are not looked at, an empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.html import elements, images, macros, parse
from kbspark.functions.shared import batch_rows

ELEMENTS = "elements array<struct<tag:string,name:string,text:string,rows:array<struct<th:array<string>,td:array<string>>>>>"
MACROS = "macros array<struct<name:string,text:string,parameters:array<struct<name:string,text:string>>,cells:array<string>>>"
IMAGES = "images array<string>"
#: Image endings, and the labels of notice boxes in the order in which they are looked for.
IMAGE_ENDINGS = ["png", "jpg", "jpeg", "gif", "svg"]
NOTICES = [("warning", "WARNING"), ("tip", "TIP"), ("note", "NOTE"), ("info", "INFO")]
DIAGRAM_NAME, DIAGRAM_TEXT = "Draw.io Diagram", "This diagram contains the following elements: "
#: Marks around code, the heading of diagrams, and the name of a diagram given as text.
CODE_BEGIN, CODE_END, DIAGRAMS, TEXT_DIAGRAM = "[CODE BLOCK]", "[END CODE BLOCK]", "## Diagrams", "PlantUML Flow"

_TEXTS = pa.list_(pa.string())
_TYPES = {
    "elements": pa.list_(pa.struct([("tag", pa.string()), ("name", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.struct([("th", _TEXTS), ("td", _TEXTS)])))])),
    "macros": pa.list_(pa.struct([("name", pa.string()), ("text", pa.string()), ("parameters", pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())]))), ("cells", _TEXTS)])),
    "images": _TEXTS,
}


def parse_html(pages: DataFrame, **parts) -> DataFrame:
    """(page_id, and a column for each part, as ``elements=elements``) of (page_id, html); only these two columns go through Python."""
    batch_rows(pages.sparkSession)
    rows = pages.select("page_id", "html")
    kinds = {"elements": ELEMENTS, "macros": MACROS, "images": IMAGES}

    def run(batches):
        for b in batches:
            bodies = (parse(h) for h in b.column("html").to_pylist())
            found = [[part(body) for part in parts.values()] for body in bodies]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([f[i] for f in found], _TYPES[n]) for i, n in enumerate(parts))], names=["page_id", *parts])

    return rows.mapInArrow(run, ", ".join([f"page_id {rows.schema['page_id'].dataType.simpleString()}", *(kinds[n] for n in parts)]))


def _lines(rows, line) -> F.Column:
    return F.array_join(F.transform(rows, line), "")


def table_text(rows) -> F.Column:
    """A header, its rule, and each row with a line of ``header: cell`` pairs; a header of ``td`` cells is a row too."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    first = F.get(rows, F.lit(0))
    marked = F.coalesce(F.size(first["th"]) > 0, F.lit(False))
    head = F.coalesce(F.when(marked, first["th"]).otherwise(first["td"]), F.array().cast("array<string>"))
    data = F.filter(rows, lambda r, i: (F.size(r["td"]) > 0) & ~((i == 0) & marked))
    pairs = lambda r: F.array_join(F.zip_with(head, r["td"], lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c))), " | ")
    body = _lines(data, lambda r: F.concat(row(r["td"]), F.when(pairs(r) != "", F.concat(F.lit("→ "), pairs(r), F.lit("\n"))).otherwise("")))
    top = F.when(F.size(head) > 0, F.concat(row(head), row(F.array_repeat(F.lit("---"), F.size(head))))).otherwise("")
    return F.concat(F.lit("\n"), top, body, F.lit("\n"))


def list_text(tag, rows) -> F.Column:
    """Items that are not empty, with numbers or dashes."""
    items = F.filter(F.transform(rows, lambda r: r["td"][0]), lambda t: t != "")
    mark = lambda i: F.when(tag == "ol", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- ")
    return F.concat(F.lit("\n"), _lines(items, lambda t, i: F.concat(mark(i), t, F.lit("\n"))), F.lit("\n"))


def element_text(e) -> F.Column:
    """An element in its form."""
    tag, text = e["tag"], e["text"]
    label = F.coalesce(*[F.when(F.contains(e["name"], F.lit(word)), label) for word, label in NOTICES])
    form = F.when(tag == "table", table_text(e["rows"])).when(tag.isin("ul", "ol"), list_text(tag, e["rows"])).when(text == "", "")
    form = form.when(tag.rlike("^h[1-6]$"), F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), text, F.lit("\n\n")))
    form = form.when(tag.isin("pre", "code"), F.concat(F.lit(f"\n{CODE_BEGIN}\n"), text, F.lit(f"\n{CODE_END}\n\n")))
    form = form.when(tag == "p", F.concat(text, F.lit("\n\n"))).when(tag == "div", F.concat(F.lit("\n["), label, F.lit("] "), text, F.lit("\n\n")))
    return form.otherwise(F.concat(text, F.lit("\n")))


def parameter(macro, name: str) -> F.Column:
    values = F.transform(F.filter(macro["parameters"], lambda p: p["name"] == name), lambda p: p["text"])
    return F.trim(F.array_join(values, " "))


def diagram_texts(found) -> F.Column:
    """Texts of diagrams whose source is in the page: drawn ones by the labels of their cells, then those given as text."""
    named = lambda name: F.filter(found, lambda m: m["name"] == name)
    labels = lambda m: F.filter(m["cells"], lambda c: (F.length(c) > 1) & ~F.startswith(c, F.lit("<")))
    title = lambda m: F.coalesce(F.nullif(parameter(m, "diagramName"), F.lit("")), F.lit(DIAGRAM_NAME))
    drawn = F.transform(F.filter(named("drawio"), lambda m: F.size(labels(m)) > 0), lambda m: F.concat(F.lit("[DIAGRAM: "), title(m), F.lit(f"]\n{DIAGRAM_TEXT}"), F.array_join(labels(m), ", ")))
    given = F.transform(F.filter(named("plantuml"), lambda m: m["text"] != ""), lambda m: F.concat(F.lit(f"[DIAGRAM: {TEXT_DIAGRAM}]\n"), m["text"]))
    return F.concat(drawn, given)


def tidy(text) -> F.Column:
    """At most one empty line, one space, no space at the beginning of a line, nothing blank at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.btrim(F.regexp_replace(text, "(?md)^[ \\t]+", ""), F.lit("".join(map(chr, range(33)))))


def html_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, content) of (page_id, html), diagrams at the end."""
    found = parse_html(pages, elements=elements, macros=macros).withColumn("diagrams", diagram_texts(F.col("macros")))
    drawn = F.when(F.size("diagrams") > 0, F.concat(F.lit(f"\n\n{DIAGRAMS}\n\n"), _lines(F.col("diagrams"), lambda d: F.concat(d, F.lit("\n\n"))))).otherwise("")
    return found.select("page_id", tidy(F.concat(_lines(F.col("elements"), element_text), drawn)).alias("content"))


def extract_attachments(pages: DataFrame) -> DataFrame:
    """(page_id, kind, filename) of pictures and Gliffy diagrams, whose descriptions users may join."""
    found = parse_html(pages, images=images, macros=macros)
    pictures = F.filter("images", lambda n: F.contains(n, F.lit(".")) & F.lower(F.substring_index(n, ".", -1)).isin(IMAGE_ENDINGS))
    gliffy = F.filter(F.transform(F.filter("macros", lambda m: m["name"] == "gliffy"), lambda m: parameter(m, "name")), lambda n: n != "")
    row = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("filename"))
    both = F.concat(F.transform(pictures, lambda n: row("image", n)), F.transform(gliffy, lambda n: row("gliffy", F.concat(n, F.lit(".png")))))
    return found.select("page_id", F.explode(both).alias("a")).select("page_id", "a.kind", "a.filename")
