"""Runs of words that repeat with a period, by seeds on diagonals, and texts without their repeats.

A run is a maximal stretch of words in which words q apart are identical, q its smallest period, at least
max(6, 4 q) words long. Words are what stands between ASCII white space. Words of a run after its first q are dropped.

Method: seed and extend. A run of period q holds at least max(6, 4 q) - q matches of word i with word i + q, one after the
other, on the diagonal of lag q. For the lags from 2^j up to 2^(j+1) the least such number is k = 5, 6, or 3 * 2^j, so each run
has seeds there: words i to i + k that stand again at i + q. Word k-grams are named by doubling (a name for each 2^t-gram that its text has
twice, made of two names), and each occurrence is paired with the next one in its text only. As k is at least q, no occurrence
lies in between: it would give the run a period below q. So every place of a run, up to its last k-gram, is a seed of its diagonal, a
text of n words has at most n seeds a step, and there is a step for each doubling up to a quarter of the longest text. Seeds of a lag come in
order; one that starts inside the furthest place covered on its diagonal only moves that place and starts no extension of its own.

Null and empty texts have no runs and stay empty. Repeated rows are treated alike, an empty table gives none. Clashing
columns ``runs`` and ``collapsed`` are replaced. A text of any length is one numpy pass of some 100 bytes a word; short
ones share passes of a megabyte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import batch_rows, list_array, offsets_of, release, replace_columns, schema_with, slices

#: A run is this many times as long as its period, and has this many words, at least.
EXPONENT, SHORTEST = 4, 6
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _named(at: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the places ``at`` whose key another place has (-1 elsewhere), and each pair of a place and the next one of its key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    first, second = at[order[:-1][same]], at[order[1:][same]]
    name = np.full(n, -1, dtype=np.int64)
    group = np.cumsum(np.concatenate([[0], ~same]))[: len(order)]
    twice = np.concatenate([same, [False]])[: len(order)] | np.concatenate([[False], same])[: len(order)]
    name[at[order[twice]]] = group[twice]
    return name, first, second


def _joined(name: np.ndarray, shift: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the grams made of a named gram and the one ``shift`` words on, in the same text, and their pairs."""
    at = np.flatnonzero(name >= 0)
    at = at[at + shift < end[at]]
    at = at[name[at + shift] >= 0]
    return _named(at, name[at] * (name.max(initial=0) + 1) + name[at + shift], len(name))


def _runs_of(first: np.ndarray, second: np.ndarray, j: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs whose period is in step j, from all pairs of next occurrences of k-grams."""
    lag = second - first
    own = (lag >= 1 << j) & (lag < 2 << j)
    first, lag = first[own], lag[own]
    order = np.lexsort((first, lag))
    first, lag = first[order], lag[order]
    covered = first + k
    starts = np.ones(len(first), bool)
    starts[1:] = (lag[1:] != lag[:-1]) | (first[1:] > covered[:-1])
    head = np.flatnonzero(starts)
    tail = np.append(head[1:], len(first)) - 1 if len(head) else head
    start, period = first[head], lag[head]
    length = covered[tail] - start + period
    long = length >= np.maximum(SHORTEST, EXPONENT * period)
    return start[long], length[long], period[long]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the texts of ``sizes`` words each, by start, then period; starts count from the first text's first word."""
    n, bounds = len(words), offsets_of(sizes)
    end, text = np.repeat(bounds[1:], sizes), np.repeat(np.arange(len(sizes)), sizes)
    name, *_ = _named(np.arange(n), text * (int(words.max(initial=0)) + 1) + words, n)
    found = []
    two = _joined(name, 1, end)[0]
    grams = _joined(two, 2, end)[0]  # of 2^(j+1) words in step j from 2 on; of 4 in the first steps
    j = 0
    while (grams >= 0).any():
        width = 4 if j < 2 else 2 << j
        k = (5, 6)[j] if j < 2 else 3 << j
        _, first, second = _joined(grams, k - width, end)
        found.append(_runs_of(first, second, j, k))
        if j > 0:
            grams = _joined(grams, width, end)[0]
        j += 1
    start, length, period = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, and their number in each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0)
    upto = offsets_of(real.to_numpy(zero_copy_only=False).astype(np.int64))
    return flat.filter(real), np.diff(upto[bounds])


def collapse(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Adds the runs of each text, by start, then period, and the words that no run repeats, joined by one space."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                words, sizes = words_of(batch.column(text))
                numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = offsets_of(sizes)
                start, length, period = find_runs(numbers, sizes)
                owner = np.searchsorted(bounds, start, side="right") - 1
                edges = np.zeros(len(numbers) + 1, dtype=np.int64)
                np.add.at(edges, start + period, 1)
                np.add.at(edges, start + length, -1)
                kept = np.cumsum(edges[:-1]) == 0
                left = np.diff(offsets_of(kept.astype(np.int64))[bounds])
                texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets_of(left)), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
                fields = [pa.array(x) for x in (start - bounds[owner], length, period)]
                each = list_array(np.arange(len(start)), np.bincount(owner, minlength=len(sizes)), pa.int64())
                listed = pa.ListArray.from_arrays(each.offsets, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                yield replace_columns(batch, {runs: listed, collapsed: texts.cast(pa.string())})
        release()

    batch_rows(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{runs: f"array<{RUN}>", collapsed: "string"}))


def strongest(runs: F.Column) -> F.Column:
    """The run with the greatest length for its period, compared as fractions; the first of equals, null if there is none."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def listed(runs: F.Column) -> F.Column:
    """The runs as lines of start, length and period."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
