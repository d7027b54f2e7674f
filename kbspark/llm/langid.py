"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from a generator seeded with its code point).
A letter trigram is bound by multiplying the first letter's vector rotated twice, the second's rotated
once and the third's. A text is the sum of its trigram vectors, a language the sum over its texts, and
a text gets the language whose vector has the largest cosine with its own.

Texts are lower-cased; each run of other characters counts as one gap between words. A null text and
a text without a letter get the language ``und`` and score 0; so does every text if nothing was
learned. Languages with equal cosine go to the first by name. Rows repeat as they are given, an empty
table gives an empty table, and output columns replace input columns of the same name.
A very long text is a pass of its own: some 80 bytes
a letter for its trigrams, while their vectors are bound and added some 4,000 at a time, however many differ.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import batch_rows, replace_columns, schema_with, slices

DIMENSIONS = 512
#: Bytes of text bundled at once: few enough that the trigrams of a pass stay a small table.
PASS_BYTES = 256 << 10
#: Distinct trigrams whose vectors are held at once.
PASS_TRIGRAMS = 4_096
BITS = 21


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


@lru_cache(maxsize=20_000)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, trigram code) of every trigram; a gap is code point 0."""
    joined = "\x00".join(["", *((t or "").lower() for t in texts), ""])
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts) + 2), [1, *(len((t or "").lower()) + 1 for t in texts), 0])[: len(code)] - 1
    code = np.where(is_letter()[code], code, 0)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code, row = code[keep], row[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = code[1:-1] != 0
    return row[1:-1][middle], ((code[:-2] << 2 * BITS) | (code[1:-1] << BITS) | code[2:])[middle]


def bind(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of trigram codes, a row each."""
    mask = (1 << BITS) - 1
    parts = [codes >> 2 * BITS, codes >> BITS & mask, codes & mask]
    letters, at = np.unique(np.concatenate(parts), return_inverse=True)
    table = np.stack([letter_vector(int(c), dimensions) for c in letters]) if len(letters) else np.zeros((0, dimensions), np.int8)
    first, second, third = np.split(at.reshape(-1), 3)
    return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]


def add_up(row: np.ndarray, code: np.ndarray, many: int, dimensions: int, step: int = PASS_TRIGRAMS) -> np.ndarray:
    """The sums of the trigram vectors of ``many`` rows; ``row`` and ``code`` as from ``trigrams``."""
    out = np.zeros((many, dimensions))
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    cuts = [*new[::step].tolist(), len(code)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        known, at = np.unique(code[begin:end], return_inverse=True)
        some, owner = np.unique(row[begin:end], return_inverse=True)
        vectors = bind(known, dimensions).astype(np.float32)
        wide = max(1, (4 << 20) // len(known))  # rows whose counts are held at once
        at, owner = at.reshape(-1), owner.reshape(-1)
        by_owner = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[by_owner], np.arange(0, len(some) + wide, wide))
        for k, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            n = min(wide, len(some) - k * wide)
            mine = by_owner[x:y]
            counts = np.bincount((owner[mine] - k * wide) * len(known) + at[mine], minlength=n * len(known)).reshape(n, -1)
            out[some[k * wide : k * wide + n]] += counts.astype(np.float32) @ vectors
    return out


def bundle(texts: list[str | None], dimensions: int) -> np.ndarray:
    return add_up(*trigrams(texts), len(texts), dimensions)


def profiles(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The sum vector of each non-null language over all rows. Their number is that of the languages."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, text, PASS_BYTES):
                row, code = trigrams(batch.column(text).to_pylist())
                langs = batch.column(lang).to_pylist()
                names = sorted({x for x in langs if x is not None})
                number = np.array([names.index(x) if x is not None else len(names) for x in langs], dtype=np.int64)
                vectors = add_up(number[row], code, len(names) + 1, dimensions)
                for name, v in zip(names, vectors[:-1], strict=True):
                    sums[name] = sums.get(name, 0) + v
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], names=["lang", "vector"])

    batch_rows(df.sparkSession)
    parts = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    text, lang = "t", "l"
    sums = parts.mapInArrow(run, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    return {r.lang: np.array([x.x for x in r.v]) for r in sorted(rows, key=lambda r: r.lang)}


def predict(df: DataFrame, known: dict[str, np.ndarray], text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the nearest language and its cosine, cut to 0..1."""
    names = [n for n, v in known.items() if np.linalg.norm(v) > 0]
    dimensions = len(known[names[0]]) if names else DIMENSIONS
    matrix = np.stack([known[n] / np.linalg.norm(known[n]) for n in names]).astype(np.float32) if names else None

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, PASS_BYTES):
                texts = batch.column(text).to_pylist()
                best, value = ["und"] * len(texts), np.zeros(len(texts))
                if names:
                    vectors = bundle(texts, dimensions)
                    length = np.linalg.norm(vectors, axis=1)
                    cosine = vectors @ matrix.T / np.maximum(length, 1e-9)[:, None]
                    winner = cosine.argmax(axis=1)
                    value = np.where(length > 0, np.clip(cosine.max(axis=1), 0, 1), 0.0).astype(np.float64)
                    best = [names[w] if n > 0 else "und" for w, n in zip(winner, length, strict=True)]
                yield replace_columns(batch, {lang: pa.array(best, pa.string()), score: pa.array(value, pa.float64())})

    batch_rows(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{lang: "string", score: "double"}))
