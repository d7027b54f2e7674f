"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters, lower-cased. The labels are those of documents, so the token labels are
derived: from a bounded sample of labelled documents (one of each group of near copies), words and word beginnings
that occur in far more toxic than clean documents (by the likelihood-ratio statistic) make a lexicon; a lexicon
token of a toxic document is labelled toxic, every other token clean, so also those of the lexicon in clean documents. The field sees the
token's word, if the lexicon has it, how strong its word and its beginning are there (how many times more frequent they are), and how strong both
neighbours are, and learns from these labels how far to trust each word,
strength and neighbourhood, and how toxic tokens follow each other. Forward-backward marginals give the spans (tokens with
a marginal of one half or more, joined if they follow each other), and two sums of them, through a
logistic function fitted on the sample, the document score.

Null and empty texts have no token: they get the score of such a document and no spans. Without labels
of both kinds nothing is learned and every score is 0. Rows repeat as given; an empty table gives an
empty table; output columns replace input columns of the same name. Sequences of any length are
scanned exactly, in blocks that are multiplied first; a very long text is a pass of its own, with some 500 bytes a token. For the fit, sequences are
cut into pieces of ``PIECE_TOKENS``, so that long documents take part like others. Of a labelled id on several rows one is learned from, that of the least hash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import batch_rows, offsets_of, release, replace_columns, schema_with, slices, written

#: Labelled documents of each class from which the lexicon and the logistic function are learned.
SAMPLE_DOCS = 8_000
#: Pieces of those, in the order of a hash, on which the field is fitted for each class, and the tokens of a piece.
FIELD_PIECES, PIECE_TOKENS = 1_000, 4_000
#: Likelihood-ratio statistic that an entry of the lexicon has at least.
SIGNIFICANT = 16.0
#: How many times more frequent in toxic documents an entry is, at which it gets stronger; below the first it is none.
RATIOS = np.array([3.0, 8.0, 30.0, 100.0])
BEGINNINGS = (4, 5, 6)
LEVELS, SIGHTS = len(RATIOS) + 1, 4
BLOCK = 64
ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
KEPT: dict[int, np.ndarray] = {}
SPANS = "array<struct<start:int,stop:int,marginal:double>>"


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letter class of every code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        c = chr(i)
        letter[i] = c.isalpha()
        if letter[i] and len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    return lower, letter


def powers(base: int, n: int) -> np.ndarray:
    """The first powers of a number modulo 2**64; the longest list asked for is kept."""
    if base not in KEPT or len(KEPT[base]) < n:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        KEPT[base] = np.multiply.accumulate(out)
    return KEPT[base]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Tokens:
    """The tokens of many texts: text number, place in the text, and hashes of word and beginnings."""

    def __init__(self, texts: list[str | None]):
        lower, letter = tables()
        texts = [t or "" for t in texts]
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        text_start = offsets_of(sizes)[:-1]
        inside = np.zeros(len(code) + 2, dtype=np.int8)
        inside[1:-1] = letter[code]
        step = np.diff(inside)
        self.begin, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.text = np.searchsorted(text_start, self.begin, side="right") - 1
        self.start = self.begin - text_start[self.text] if len(texts) else self.begin
        self.stop = self.start + self.end - self.begin
        self.sizes = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        size = max(1, len(code))
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum((lower[code].astype(np.uint64) + np.uint64(7)) * powers(ODD, size)[: len(code)], out=total[1:])
        back = powers(INVERSE, size)[self.begin] if len(self.begin) else np.zeros(0, np.uint64)
        length = self.end - self.begin

        def part(stop, kind):
            return mixed((total[stop] - total[self.begin]) * back + np.uint64(kind * 0x1234567))

        self.word = part(self.end, 1)
        self.heads = [np.where(length >= k, part(np.minimum(self.begin + k, self.end), k), np.uint64(0)) for k in BEGINNINGS]


def shingle_minimum(tokens: Tokens, n: int) -> np.ndarray:
    """The least hash of three words in a row, by which near copies mostly agree; 0 for shorter texts."""
    out = np.zeros(n, dtype=np.int64)
    w = tokens.word
    if len(w) >= 3:
        h = mixed(w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7))
        same = tokens.text[:-2] == tokens.text[2:]
        best = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(best, tokens.text[:-2][same], h[same])
        out = np.where(best == np.iinfo(np.uint64).max, 0, (best >> np.uint64(1)).astype(np.int64))
    return out


def chain(obs: np.ndarray, sizes: np.ndarray, emit: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of the toxic state of every token; with ``pairs`` also the expected transitions.

    Every text starts in the clean state. Products of the step matrices of each block of tokens are
    made first, so that the scan over a text has a step for each block, and blocks run side by side.
    """
    k = len(emit)
    blocks = -(-sizes // BLOCK)
    first = offsets_of(blocks)
    total = int(first[-1])
    place = np.arange(len(obs)) - np.repeat(offsets_of(sizes)[:-1], sizes)
    row, slot = np.repeat(first[:-1], sizes) + place // BLOCK, place % BLOCK
    grid = np.full((BLOCK, total), k, dtype=np.int64)
    grid[slot, row] = obs
    # step matrices by observation, entry by entry; the last one, of padding, is the identity
    step = [[np.append(trans[i, j] * emit[:, j], float(i == j)) for j in (0, 1)] for i in (0, 1)]

    def entries(t):
        return [[step[i][j][grid[t]] for j in (0, 1)] for i in (0, 1)]

    p = [[np.full(total, float(i == j)) for j in (0, 1)] for i in (0, 1)]
    for t in range(BLOCK):
        m = entries(t)
        p = [[p[i][0] * m[0][j] + p[i][1] * m[1][j] for j in (0, 1)] for i in (0, 1)]
        if t % 8 == 7:
            scale = 1 / (p[0][0] + p[0][1] + p[1][0] + p[1][1])
            p = [[x * scale for x in line] for line in p]
    order = np.argsort(-blocks, kind="stable")
    start, many = first[:-1][order], blocks[order]
    ahead, behind = np.zeros((2, total)), np.zeros((2, total))
    a = [np.ones(len(order)), np.zeros(len(order))]
    deepest = int(many[0]) if len(many) else 0
    active = [int(np.searchsorted(-many, -i, side="left")) for i in range(deepest)]
    for i in range(deepest):
        n = active[i]
        at = start[:n] + i
        x, y = a[0][:n].copy(), a[1][:n].copy()
        ahead[0, at], ahead[1, at] = x, y
        u, v = x * p[0][0][at] + y * p[1][0][at], x * p[0][1][at] + y * p[1][1][at]
        a[0][:n], a[1][:n] = u / (u + v), v / (u + v)
    b = [np.ones(len(order)), np.ones(len(order))]
    for i in reversed(range(deepest)):
        n = active[i]
        at = start[:n] + i
        x, y = b[0][:n].copy(), b[1][:n].copy()
        behind[0, at], behind[1, at] = x, y
        u, v = p[0][0][at] * x + p[0][1][at] * y, p[1][0][at] * x + p[1][1][at] * y
        b[0][:n], b[1][:n] = u / (u + v), v / (u + v)
    alpha = np.empty((BLOCK + 1, 2, total))
    alpha[0] = ahead
    for t in range(BLOCK):
        m = entries(t)
        u, v = alpha[t, 0] * m[0][0] + alpha[t, 1] * m[1][0], alpha[t, 0] * m[0][1] + alpha[t, 1] * m[1][1]
        scale = 1 / (u + v)
        alpha[t + 1, 0], alpha[t + 1, 1] = u * scale, v * scale
    marginal, moves, z = np.empty((BLOCK, total)), np.zeros((2, 2)), [behind[0], behind[1]]
    for t in reversed(range(BLOCK)):
        clean, toxic = alpha[t + 1, 0] * z[0], alpha[t + 1, 1] * z[1]
        marginal[t] = toxic / (clean + toxic)
        m = entries(t)
        if pairs:
            xi = [[alpha[t, i] * m[i][j] * z[j] for j in (0, 1)] for i in (0, 1)]
            scale = (grid[t] < k) / (xi[0][0] + xi[0][1] + xi[1][0] + xi[1][1])
            moves += np.array([[(x * scale).sum() for x in line] for line in xi])
        u, v = m[0][0] * z[0] + m[0][1] * z[1], m[1][0] * z[0] + m[1][1] * z[1]
        scale = 1 / (u + v)
        z = [u * scale, v * scale]
    return (marginal[slot, row], moves) if pairs else marginal[slot, row]


class Field:
    """Weights of strengths (of word, beginning, and both neighbours), of the transitions, and of the words of the lexicon (the last is no word)."""

    def __init__(self, words: int = 0):
        self.w = np.zeros(SIGHTS * LEVELS + 4 + words + 1)
        self.shrinkage = np.full(len(self.w), 1e-3)
        self.shrinkage[SIGHTS * LEVELS + 4 :] = 1e-2
        self.shrinkage[-1] = 1.0

    def places(self, obs: np.ndarray) -> np.ndarray:
        """The weights that tell of each token."""
        first = np.r_[np.arange(SIGHTS) * LEVELS, SIGHTS * LEVELS + 4]
        return obs + first

    def factors(self, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = self.w[self.places(obs)].sum(axis=1)
        return np.exp(np.clip(np.stack([np.zeros_like(score), score], axis=1), -20, 20)), np.exp(np.clip(self.w[SIGHTS * LEVELS : SIGHTS * LEVELS + 4].reshape(2, 2), -20, 20))

    def fit(self, obs: np.ndarray, sizes: np.ndarray, label: np.ndarray, rounds: int = 60) -> Field:
        """Maximum likelihood of the labelled tokens, with a little shrinkage, by adaptive gradient steps."""
        previous = np.r_[0, label[:-1]] if len(label) else label
        previous[offsets_of(sizes)[:-1][sizes > 0]] = 0
        seen = np.bincount(2 * previous + label, minlength=4).astype(float)
        # equal observations share their factors
        kinds, at = np.unique(obs, axis=0, return_inverse=True)
        at, places = at.reshape(-1), self.places(kinds)
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for r in range(1, rounds + 1):
            p, moves = chain(at, sizes, *self.factors(kinds), pairs=True)
            off = np.bincount(at, label - p, len(kinds))
            g = np.bincount(places.ravel(), np.repeat(off, SIGHTS + 1), len(self.w))
            g[SIGHTS * LEVELS : SIGHTS * LEVELS + 4] = seen - moves.ravel()
            g = g / max(1, len(sizes)) - self.shrinkage * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w = self.w + 0.4 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        return self

    def marginals(self, obs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return chain(np.arange(len(obs)), sizes, *self.factors(obs)) if len(obs) else np.zeros(0)


class Model:
    """A lexicon (sorted hashes with strengths), a field, and the weights of the document score."""

    def __init__(self, keys: np.ndarray, strength: np.ndarray, field: Field, logistic: np.ndarray | None):
        self.keys, self.strength, self.field, self.logistic = keys, strength, field, logistic

    def entry(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of the lexicon with each hash; its length where there is none."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def observe(self, tokens: Tokens) -> np.ndarray:
        """For each token the strengths of word, beginning, and neighbours, and its word's entry."""
        strength = np.append(self.strength, 0)
        word = self.entry(tokens.word)
        out = np.zeros((len(word), SIGHTS + 1), dtype=np.int64)
        out[:, 0], out[:, SIGHTS] = strength[word], word
        for h in tokens.heads:
            out[:, 1] = np.maximum(out[:, 1], strength[self.entry(h)])
        own = np.maximum(out[:, 0], out[:, 1])
        same = tokens.text[1:] == tokens.text[:-1]
        out[1:, 2], out[:-1, 3] = np.where(same, own[:-1], 0), np.where(same, own[1:], 0)
        return out

    def features(self, p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """For each text one, its largest marginal, and the logarithm of one and its sum of marginals."""
        most, total = np.zeros(n), np.bincount(text, np.where(p > 0.05, p, 0), n)
        np.maximum.at(most, text, p)
        return np.stack([np.ones(n), most, np.log1p(total)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30))) if self.logistic is not None else np.zeros(len(x))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with shrinkage."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def sample(labels: DataFrame, doc_id: str, toxic: str, most: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``most`` labelled documents of each class, in the order of a hash of the id."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from at most ``sample_docs`` labelled documents of each class; give only rows to learn from."""
    spark = docs.sparkSession
    batch_rows(spark)
    chosen = {r.doc_id: r.toxic for r in sample(labels, doc_id, toxic, sample_docs).collect()}
    ids = spark.createDataFrame(list(chosen.items()), "doc_id long, toxic int")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 * sample_docs ids
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    def groups(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(shingle_minimum(Tokens(b.column("text").to_pylist()), b.num_rows))], names=["doc_id", "toxic", "group"])

    seen = rows.mapInArrow(groups, "doc_id long, toxic int, group long").distinct().collect()
    first: dict[tuple, int] = {}
    for r in sorted(seen, key=lambda r: r.doc_id):
        first.setdefault((r.toxic, r.group if r.group else -1 - r.doc_id), r.doc_id)
    kept = sorted(first.values())
    n = np.array([sum(chosen[i] == c for i in kept) for c in (0, 1)], dtype=float)
    if not n.all():
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), Field(), None)
    rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in kept], "doc_id long")), "doc_id")  # at most 2 * sample_docs ids

    def count(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                tokens, bad = Tokens(b.column("text").to_pylist()), b.column("toxic").to_numpy(zero_copy_only=False)
                hashes = np.concatenate([tokens.word, *tokens.heads])
                text_no = np.tile(tokens.text, 1 + len(tokens.heads))
                known, at = np.unique(hashes, return_inverse=True)
                once = np.unique(at.reshape(-1) * b.num_rows + text_no)
                is_bad = bad[once % b.num_rows] == 1
                total = np.bincount(once // b.num_rows, minlength=len(known))
                toxic_n = np.bincount((once // b.num_rows)[is_bad], minlength=len(known))
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(toxic_n, pa.int64()), pa.array(total - toxic_n, pa.int64())], names=["h", "t", "c"])

    counts = rows.mapInArrow(count, "h long, t long, c long").where("h != 0").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c, every = F.col("t"), F.col("c"), float(n.sum())
    want_t, want_c = (t + c) * (n[1] / every), (t + c) * (n[0] / every)
    statistic = 2 * (t * F.log(t / want_t) + F.when(c > 0, c * F.log(c / want_c)).otherwise(0.0))
    ratio = (t / n[1]) / ((c + 0.5) / n[0])
    entries = counts.where((ratio >= float(RATIOS[0])) & (t > 0)).withColumns({"g": statistic, "ratio": ratio}).where(F.col("g") >= SIGNIFICANT).select("h", "ratio").toPandas()  # words of the sample
    keys = entries["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    strength = np.searchsorted(RATIOS, entries["ratio"].to_numpy(dtype=float), side="right")
    model = Model(keys[order], strength[order].astype(np.int64), Field(len(keys)), None)

    def observed(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                tokens = Tokens(b.column("text").to_pylist())
                obs = model.observe(tokens).astype(np.int32)
                pieces = -(-tokens.sizes // PIECE_TOKENS)
                owner = np.repeat(np.arange(b.num_rows), pieces)
                no = np.arange(len(owner)) - np.repeat(offsets_of(pieces)[:-1], pieces)
                begin = offsets_of(tokens.sizes)[:-1][owner] + no * PIECE_TOKENS
                end = np.minimum(begin + PIECE_TOKENS, offsets_of(tokens.sizes)[1:][owner])
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("toxic").take(take), pa.array(no), pa.array([obs[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())], names=["doc_id", "toxic", "no", "obs"])

    pieces = rows.mapInArrow(observed, "doc_id long, toxic int, no long, obs binary")
    parts = [pieces.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", "no"), "doc_id", "no").limit(FIELD_PIECES) for k in (0, 1)]
    table = parts[0].unionByName(parts[1]).toArrow()
    each = [np.frombuffer(x, dtype=np.int32).reshape(-1, SIGHTS + 1) for x in table["obs"].to_pylist()]
    sizes = np.array([len(x) for x in each], dtype=np.int64)
    obs = np.concatenate([np.zeros((0, SIGHTS + 1), np.int32), *each]).astype(np.int64)
    bad = np.array(table["toxic"].to_pylist(), dtype=np.int64)
    label = np.where((obs[:, :2].max(axis=1, initial=0) > 0) & (np.repeat(bad, sizes) == 1), 1, 0)
    model.field.fit(obs, sizes, label)

    def features(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                tokens = Tokens(b.column("text").to_pylist())
                x = model.features(model.field.marginals(model.observe(tokens), tokens.sizes), tokens.text, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["toxic", "a", "b"])

    sums = rows.mapInArrow(features, "toxic int, a double, b double").toPandas().sort_values(["toxic", "a", "b"])
    x = np.stack([np.ones(len(sums)), sums["a"], sums["b"]], axis=1)
    model.logistic = logistic(x, sums["toxic"].to_numpy(dtype=float))
    return model


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """Adds the document score and the toxic spans, in code points of the text."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                tokens = Tokens(batch.column(text).to_pylist())
                p = model.field.marginals(model.observe(tokens), tokens.sizes) if model.logistic is not None else np.zeros(len(tokens.text))
                value = model.score(model.features(p, tokens.text, batch.num_rows))
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                last = -2
                for i in np.flatnonzero(p >= 0.5).tolist():
                    own = found[tokens.text[i]]
                    if i == last + 1 and own:
                        own[-1]["stop"], own[-1]["marginal"] = int(tokens.stop[i]), max(own[-1]["marginal"], float(p[i]))
                    else:
                        own.append({"start": int(tokens.start[i]), "stop": int(tokens.stop[i]), "marginal": float(p[i])})
                    last = i
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))
                yield replace_columns(batch, {"__score": pa.array(value), "__spans": pa.array(found, kind)})
        release()

    batch_rows(df.sparkSession)
    done = df.mapInArrow(run, schema_with(df, __score="double", __spans=SPANS))
    return done.drop(score, spans).withColumnsRenamed({"__score": score, "__spans": spans})
