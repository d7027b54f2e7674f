"""Statistics and rules against plain Python, and held-out accuracy."""

import math
import random
import zlib

import pytest
import regex

from kbspark.llm import queries, rule_quality

TREE = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=13
  Tree 0 (weight 1.0):
    If (feature 0 <= 5.5)
     If (feature 3 <= 0.25)
      Predict: 0.0
     Else (feature 3 > 0.25)
      If (feature 0 <= 2.0)
       Predict: 1.0
      Else (feature 0 > 2.0)
       Predict: 0.0
    Else (feature 0 > 5.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 5.5)
     Predict: 0.0
    Else (feature 0 > 5.5)
     Predict: 1.0E-5
"""


def statistics(text):
    text = text or ""
    words, lines = regex.findall(r"[^ \t\n\x0b\f\r]+", text), [x for x in text.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    marks = regex.sub(r"[\p{L}\p{N}.,;:!?'\"()\- \t\n\x0b\f\r]", "", text)
    return {
        "words": len(words), "word_length": share(sum(map(len, words)), len(words)), "longest_word": max(map(len, words), default=0), "short_words": share(sum(len(w) <= 2 for w in words), len(words)),
        "distinct_words": share(len(set(words)), len(words)), "bare_marks": share(sum(not regex.search(r"[\p{L}\p{N}]", w) for w in words), len(words)),
        "capitals": share(len(regex.findall(r"\p{Lu}", text)), len(text)), "digits": share(len(regex.findall("[0-9]", text)), len(text)), "stops": share(len(regex.findall("[.!?]", text)), len(words)),
        "marks": share(len(marks), len(text)), "lines": len(lines), "line_length": share(len(text), len(lines)), "distinct_lines": share(len(set(lines)), len(lines)),
    }


def holds(rule, stats):
    return all(low < stats[s] <= high for s, low, high in rule.bounds)


def documents(n, seed):
    """Clean sentences, and junk of four kinds."""
    rnd, out = random.Random(seed), []
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(15, 80))]
        kind = rnd.choice([0, 0, 0, 0, 1, 2, 3, 4])
        text = {0: ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8)) + ".", 1: " | ".join(words), 2: " ".join(w + "%%%" for w in words), 3: " ".join(words[:1] * 60), 4: " ".join(words).upper()}[kind]
        out.append((i, text, int(kind == 0)))
    return out


def test_paths():
    inf = math.inf
    want = [(("words", -inf, 5.5),), (("short_words", -inf, 0.25), ("words", -inf, 5.5)), (("short_words", 0.25, inf), ("words", -inf, 5.5)), (("short_words", 0.25, inf), ("words", -inf, 2.0)), (("short_words", 0.25, inf), ("words", 2.0, 5.5)), (("words", 5.5, inf),)]
    assert [r.bounds for r in rule_quality.paths(TREE)] == want


def test_statistics(spark):
    texts = [None, "", " \n ", "a bb ccc  ccc\tA1. B? || -- ,\n\nrow\nrow\r\n é😀 ÄÖ\x0bx 12,5", "x" * 5000, *(t for _, t, _ in documents(40, 3))]
    got = rule_quality.with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).collect()
    for r in got:
        assert r["__stats"].asDict() == pytest.approx(statistics(texts[r.i]))


def test_held_out_and_compiled_rules(spark):
    train, test = documents(500, 1), documents(300, 2)
    df = spark.createDataFrame([x[:2] for x in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in train] + [(None, 1), (3, None), (999_999, 0)], "doc_id long, quality int")
    model = rule_quality.fit(df, labels)
    assert 0 < len(model.rules) < 200 and all(r.weight for r in model.rules)
    out = rule_quality.score(spark.createDataFrame(test, "doc_id long, text string, quality int"), model).collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in out) / len(out) > 0.97
    for r in out:
        logit = model.intercept + sum(x.weight for x in model.rules if holds(x, statistics(r.text)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
    told = rule_quality.explain(spark.createDataFrame(test, "doc_id long, text string, quality int"), model).collect()
    assert all({x.rule for x in r.reasons} == {str(x) for x in model.rules if holds(x, statistics(r.text))} for r in told)
    assert rule_quality.fit(df, labels) == model


def test_sample_is_bounded_and_weighted(spark):
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(0, 0), (1, 0)], "doc_id long, quality int")
    got = rule_quality.sample(labels, "doc_id", "quality", 50).collect()
    assert sorted((r.label, r.weight) for r in got) == [(0.0, 2.0)] * 50 + [(1.0, 6.0)] * 50 and len({r.doc_id for r in got}) == 100


def test_few_labels_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", "old", 1), (2, None, "old", 2), (2, "", None, 3), (None, "x", None, 4)], "doc_id long, text string, score string, words int")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for model, least in ((rule_quality.fit(df, labels.limit(0)), 0.5), (rule_quality.fit(df, labels), 5 / 6)):
        out = rule_quality.score(df, model)
        assert set(out.columns) == set(df.columns) and [r.score for r in out.collect()] == pytest.approx([least] * 4)
        assert [r.reasons for r in rule_quality.explain(df, model).collect()] == [[]] * 4
    assert rule_quality.score(df.limit(0), model).count() == 0 and not rule_quality.fit(df.limit(0), labels).rules


def test_query(spark, tmp_path):
    rows = documents(400, 5)
    spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.queries()["op13_quality"](spark, str(tmp_path)).collect()
    good = {i: q for i, _, q in rows}
    assert len(out) == 402 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    test = [r for r in out if r.held_out and r.doc_id in good]
    assert sum(r.predicted == good[r.doc_id] for r in test) / len(test) > 0.95
