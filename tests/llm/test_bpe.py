import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kbspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def cases():
    rnd = random.Random(1)
    out = ["", "a" * 1000, "ab" * 500, "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", " " * 50, "\r\n\r\n \t x\x1c", "日本語 😀😀 a'll we'RE"]
    kinds = [(32, 127), (0, 0x300), (0x300, 0xD7FF), (0x1F300, 0x1F700)]
    return out + ["".join(chr(rnd.randrange(*rnd.choice(kinds))) for _ in range(rnd.randrange(40))) for _ in range(300)]


def test_as_the_library(library):
    v = bpe.Vocabulary(PATH)
    for text in cases():
        ids, n = v.encode([text])
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and n.tolist() == [len(want)]
        assert v.decode(ids, n) == [library.decode(want, skip_special_tokens=False)] == [text]


def test_long_words_as_the_library(library):
    rnd = random.Random(2)
    v = bpe.Vocabulary(PATH)
    letters = ["".join(rnd.choice("etaoinshrdlu") for _ in range(n)) for n in (bpe.LONG_WORD - 1, bpe.LONG_WORD, bpe.LONG_WORD + 1, 5_000, 60_000)]
    for text in [*letters, " ".join(letters), "a" * 30_001, "ab" * 9_000, "中文字符" * 3_000, "x" + " " * 3_000 + "y"]:
        ids, _ = v.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.time()
    v.encode(["".join(rnd.choice("etaoinshrdlu") for _ in range(1_000_000))])
    assert time.time() - began < 30


def test_table_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "some text", "old"), (1, "some text", None), (None, None, None), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(df, PATH).collect()
    assert sorted((r.text or "", r.decoded) for r in out) == sorted((t or "", t or "") for _, t, _ in rows)
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in out)
    two = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(r.decoded for r in two) == sorted(r.decoded for r in out)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_unknown_ids_decode_to_nothing():
    v = bpe.Vocabulary(PATH)
    ids, _ = v.encode(["abc"])
    assert v.decode(np.array([*ids, 10**6, -5]), [len(ids) + 2]) == ["abc"]
