import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_simhash import plain, plain_groups  # noqa: E402
from test_suffix_dedup import plain as plain_repeats  # noqa: E402
from test_toxicity import rows as toxic_rows  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    made = toxic_rows(150, 5)
    more = [(i + 1000, t, x) for i, t, x in made[:20]] + [(2000 + i, made[0][1] + " tail " * i, 0) for i in range(4)]
    rows = [(i, t, "en", f"src{i % 5}", len(t)) for i, t, _ in made + more]
    rows += [(3000, None, None, None, None), (3001, "", "fr", "src1", 0), (None, "no id here at all", "en", "src2", 17)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in made], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows, {i: x for i, _, x in made + more}


def test_each_stage_on_what_the_last_kept(spark, tables):
    where, rows, toxic = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "simhash", "suffix_dedup", "mixing", "bpe"]
    data = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, where)
        if name != "bpe":
            assert docs.columns == pipeline.COLUMNS
        data[name] = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(docs.rdd, docs.schema)
    kept = {r["doc_id"] for r in data["toxicity"]}
    assert sum((i in kept) != (toxic.get(i) == 1) for i, *_ in rows) > 0.97 * len(rows)
    before = data["toxicity"]
    first = {i for i, c in plain_groups([r["doc_id"] for r in before], [plain(r["text"]) for r in before]) if i is not None and i == c}
    assert {r["doc_id"] for r in data["simhash"]} == first | {None}
    cut = {i: b.decode(errors="replace") for i, b, _ in plain_repeats([(r["doc_id"], r["text"]) for r in data["simhash"]])}
    assert {r["doc_id"]: r["text"] or "" for r in data["suffix_dedup"]} == cut
    texts = {r["doc_id"]: r["text"] for r in data["suffix_dedup"]}
    assert data["mixing"] and all(texts[r["doc_id"]] == r["text"] for r in data["mixing"])
    assert len(data["bpe"]) == len(data["mixing"]) and all(r["lossless"] for r in data["bpe"])


def test_run(spark, tables):
    out = pipeline.run(spark, tables[0])
    assert out.count() > 50 and out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "lossless"]
