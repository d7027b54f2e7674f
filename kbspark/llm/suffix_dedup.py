"""Suffix-array dedup: removes bytes of long strings that a document with a smaller id has too.

Texts are packed into blocks. The suffixes of a block are put into initial buckets by the q-gram at an
anchor: each window of ``length`` bytes has its least-hash q-gram as anchor, which only its content
decides, so equal windows of any documents are in the same bucket. Buckets with several suffixes are refined as in
bucket-pointer refinement: the suffixes of a bucket are sorted by its identifier and that of the bucket at a later
offset, which gives new identifiers for the next step, until a bucket is a single suffix or equal in all bytes of the windows of its anchor
(its surroundings). The buckets at later offsets are themselves refined by pairs of identifiers, from 8 to 16 to 32 bytes. Where a bucket falls apart and windows are still shared, the windows are refined: sorted by the identifiers of their own bucket and of the
bucket at a later offset, which doubles the depth and uses the new identifiers again in the next step, until buckets
are equal to depth ``length``.

Blocks have no identifiers in common, so between blocks hashes of the buckets' bytes travel in their place, in packed columns: (a) a hash of each distinct q-gram
of a block, answered by a bit that tells if another block has it; (b) for those that it has, a hash of the
surroundings and the least document, answered by whether a smaller document has the same and whether the bucket
must be refined; (c) for refined buckets a hash of the window and the least document, answered in the same way.
Each block sends an identifier once, however many of its documents have it, so a string that
very many documents share costs as many entries as there are blocks. Answers come back to the blocks by
their number; texts are shuffled once. Hashes that decide removals between blocks have over 96 bits with their place. Rows are packed in a
fixed order of a partition, so a block that a lost executor had is packed again as it was.

Rows with a null id come after all ids; a null text is empty. Rows that share an id are judged like
one document each, and never against each other. Other columns pass through. An empty table gives an
empty table. Texts shorter than ``length`` keep all bytes. A long text is a block of its own, with some 60 bytes a byte of text at the most.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from kbspark.llm.common import batch_rows, offsets_of, release, spread, text_bytes

LENGTH = 50
#: Bytes of the q-gram at an anchor. A window has length - GRAM + 1 of them.
GRAM = 24
#: Bytes of text in a block, and distinct q-grams that a bucket of the exchange shall hold.
BLOCK_BYTES = 1 << 20
PART_GRAMS = 1 << 20
#: Bits of the low part of a packed hash, besides those that name its part of the exchange.
LOW = 40
NULL_ID = np.iinfo(np.int64).max
ODD = 0x9E3779B97F4A7C15
KEPT: dict[int, np.ndarray] = {}
TABLES = [np.random.default_rng(k).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (11, 12, 13)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(raw: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    """A hash of every piece of ``width`` bytes, by doubling."""
    power = lambda k: np.uint64(pow(ODD, k, 1 << 64))
    part, size, out, done = table[raw], 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = part, size
            else:
                n = min(len(out), len(part) - done)
                out, done = out[:n] + part[done : done + n] * power(done), done + size
        if 2 * size > width:
            return out
        part, size = part[:-size] + part[size:] * power(size), 2 * size


def powers(n: int, base: int = ODD) -> np.ndarray:
    """The first powers of a number modulo 2**64; the longest list asked for is kept."""
    if base not in KEPT or len(KEPT[base]) < n:
        out = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        out[0] = 1
        KEPT[base] = np.multiply.accumulate(out)
    return KEPT[base]


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(raw: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each run of windows with one anchor, text by text."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none
    gram = mixed(rolling(raw, GRAM, TABLES[0]))
    x = gram & np.uint64(0xFFFFFFFF << 32) | np.arange(len(gram), dtype=np.uint64)  # the first of equal hashes
    anchor = (least_in(x, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    start = spread(offsets_of(sizes)[:-1], windows)
    anchor = anchor[start]
    if not len(start):
        return none, none, none
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    return start[new], np.diff(np.r_[new, len(start)]), anchor[new]


class Pieces:
    """Hashes of any pieces of a byte array, from sums over it."""

    def __init__(self, raw: np.ndarray, table: np.ndarray):
        self.total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(table[raw] * powers(len(raw))[: len(raw)], out=self.total[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.total[stop] - self.total[start]) * powers(len(self.total), pow(ODD, -1, 1 << 64))[start] + (stop - start).astype(np.uint64))


def refine(raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the pieces of ``length`` bytes at ``start``, equal where the bytes are, in sorted order.

    The suffixes within the pieces get the identifier of their first eight bytes; each step sorts them by the
    identifier of their bucket and of the bucket at the offset of its depth, and only where needed later.
    """
    if not len(start):
        return np.zeros(0, np.int64)
    needed = np.zeros(len(raw) + 1, dtype=bool)
    needed[spread(start, np.full(len(start), length - 7))] = True
    place = np.flatnonzero(needed)
    slot = np.zeros(len(raw) + 1, dtype=np.int64)
    slot[place] = np.arange(len(place))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded.data, strides=(1,))
    bucket = np.unique(eight[place].astype(np.uint64), return_inverse=True)[1].reshape(-1)
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        deeper = np.flatnonzero(needed[np.minimum(place + step, len(raw))])
        if depth + step == length:
            deeper = slot[start]
        own, later = bucket[deeper], bucket[slot[place[deeper] + step]]
        pair = own * (int(bucket.max()) + 1) + later
        new = np.zeros(len(place), dtype=np.int64)
        new[deeper] = np.unique(pair, return_inverse=True)[1].reshape(-1)
        bucket, depth = new, depth + step
    return bucket[slot[start]]


def identifiers(raw: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of the suffixes at ``place`` to ``depth`` (eight times a power of two), equal where their bytes are.

    Suffixes are sorted by the identifier of their bucket of half the depth and that of the bucket at the offset of this half; both come
    from one refinement of all places and their later offsets, which does the same down to buckets of eight bytes.
    """
    if depth == 8:
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded.data, strides=(1,))
        return np.unique(eight[place], return_inverse=True)[1].reshape(-1)
    half = depth // 2
    needed = np.zeros(len(raw) + 1, dtype=bool)
    needed[place] = needed[place + half] = True
    known, slot = identifiers(raw, np.flatnonzero(needed), half), np.cumsum(needed) - 1
    return np.unique(known[slot[place]] * (int(known.max(initial=0)) + 1) + known[slot[place + half]], return_inverse=True)[1].reshape(-1)


def refine_buckets(raw: np.ndarray, bucket: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """New identifiers of pieces (start, size) of buckets, equal where bucket, size and all bytes are.

    Each step sorts the pieces of the buckets that still have several by their identifier and that of the bucket at the
    next offset, which is refined to the largest depth that the pieces have; a piece that is alone in its bucket takes no part any more.
    """
    bucket = np.unique(bucket * (int(size.max(initial=0)) + 1) + size, return_inverse=True)[1].reshape(-1)
    next_, offset = len(bucket), 0
    open_ = np.flatnonzero(np.bincount(bucket)[bucket] > 1) if len(bucket) else bucket
    depth = 8 << (int(size.min(initial=1 << 30)) // 8).bit_length() - 1
    while len(open_):
        place = start[open_] + np.minimum(offset, size[open_] - depth)
        new = np.unique(bucket[open_] * (len(place) + 1) + identifiers(raw, place, depth), return_inverse=True)[1].reshape(-1)
        bucket[open_] = next_ + new
        next_ += int(new.max()) + 1
        offset += depth
        open_ = open_[(np.bincount(new)[new] > 1) & (size[open_] > offset)]
    return bucket


def pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, plane by plane, which the shuffle compresses well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


class Block:
    """The texts of a block and what is known about their windows so far."""

    def __init__(self, row: dict, length: int, bits: int):
        self.length, self.bits = length, bits
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        self.missing, self.sizes = sizes < 0, np.maximum(sizes, 0)
        self.raw = np.frombuffer(zstandard.decompress(row["data"]), dtype=np.uint8)
        runs = np.frombuffer(zstandard.decompress(row["runs"]), dtype=np.uint8)
        self.count, shift = (x.astype(np.int64) for x in np.split(runs, 2))
        windows = np.maximum(self.sizes - length + 1, 0)
        place = offsets_of(self.count)[:-1]
        text = np.searchsorted(offsets_of(windows), place, side="right") - 1
        self.first = place - offsets_of(windows)[text] + offsets_of(self.sizes)[text] if len(place) else place
        self.anchor = self.first + shift
        self.doc = self.ids[text] if len(place) else place
        head = np.concatenate([self.raw, np.zeros(GRAM, np.uint8)])
        eight = np.ndarray(len(head) - 7, dtype="<u8", buffer=head.data, strides=(1,))
        h = np.zeros(len(self.anchor), dtype=np.uint64)
        for k in range(0, GRAM, 8):
            h = mixed((h ^ eight[self.anchor + k]) * np.uint64(ODD) + np.uint64(k + 1))
        self.grams, self.gram = np.unique(h, return_inverse=True)
        self.gram = self.gram.reshape(-1)

    def parts(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(part, begin, end) of sorted hashes by their high bits."""
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = [0, *cuts.tolist(), len(hashes)]
        return [(int(part[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]

    def low(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits - LOW) & np.uint64((1 << LOW) - 1)

    def send_grams(self):
        for part, a, b in self.parts(self.grams):
            yield part, pack(self.low(self.grams[a:b]), LOW // 8)

    def compare_surroundings(self, shared: np.ndarray) -> None:
        """Refines the buckets of shared q-grams until all bytes of their windows are equal."""
        least = np.full(len(self.grams), NULL_ID)
        most = np.full(len(self.grams), np.iinfo(np.int64).min)
        np.minimum.at(least, self.gram, self.doc)
        np.maximum.at(most, self.gram, self.doc)
        self.at = np.flatnonzero((shared | (least < most))[self.gram])
        lo, n = self.first[self.at], self.count[self.at]
        wide = self.length - GRAM + 2
        around = refine_buckets(self.raw, self.gram[self.at] * wide + self.anchor[self.at] - lo, lo, n - 1 + self.length)
        order = np.lexsort((self.doc[self.at], around, self.gram[self.at]))
        self.at, around = self.at[order], around[order]
        gram = self.gram[self.at]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])][: len(self.at)]
        self.group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        self.head, self.head_doc, self.head_gram = self.at[head], self.doc[self.at[head]], gram[head]
        many = np.bincount(self.head_gram, minlength=len(self.grams))
        self.asked = shared[self.head_gram]  # by groups
        self.full = np.zeros(len(head), dtype=bool)
        self.open = ~self.asked & (many[self.head_gram] > 1)

    def send_surroundings(self):
        head = self.head[self.asked]
        lo = self.first[head]
        around = Pieces(self.raw, TABLES[1]).hashes(lo, lo + self.count[head] - 1 + self.length) ^ mixed((self.anchor[head] - lo).astype(np.uint64))
        hashes, doc = self.grams[self.head_gram[self.asked]], self.head_doc[self.asked]
        for part, a, b in self.parts(hashes):
            yield part, pack(self.low(hashes[a:b]), LOW // 8) + pack(around[a:b], 8) + pack(doc[a:b].view(np.uint64), 8)

    def compare_windows(self, answers: np.ndarray) -> None:
        """Refines the windows of buckets whose surroundings differ; ``answers`` has a byte for each group asked."""
        self.full[self.asked] = answers & 1 == 1
        self.open[self.asked] = answers & 2 == 2
        self.gone = np.zeros(len(self.raw) + 1, dtype=np.int64)
        dup = self.full[self.group] | (self.doc[self.at] > self.head_doc[self.group])
        self.remove(self.first[self.at[dup]], self.count[self.at[dup]])
        use = np.flatnonzero(self.open & ~self.full)
        count = self.count[self.head[use]]
        self.w_start = spread(self.first[self.head[use]], count)
        self.w_group = np.repeat(use, count)
        self.w_shift = self.w_start - self.first[self.head[self.w_group]]
        self.w_class = refine(self.raw, self.w_start, self.length)
        n = int(self.w_class.max()) + 1 if len(self.w_class) else 0
        self.c_doc = np.full(n, NULL_ID)
        np.minimum.at(self.c_doc, self.w_class, self.head_doc[self.w_group])
        self.c_dup = np.zeros(n, dtype=bool)
        asked = np.zeros(n, dtype=bool)
        asked[self.w_class[self.asked[self.w_group]]] = True
        first = np.zeros(n, dtype=np.int64)
        first[self.w_class[::-1]] = self.w_start[::-1]
        self.c_asked = np.flatnonzero(asked)
        start = first[self.c_asked]
        h = Pieces(self.raw, TABLES[1]).hashes(start, start + self.length)
        other = Pieces(self.raw, TABLES[2]).hashes(start, start + self.length)
        order = np.argsort(h, kind="stable")
        self.c_asked, self.c_hash, self.c_other = self.c_asked[order], h[order], other[order]

    def send_windows(self):
        doc = self.c_doc[self.c_asked]
        for part, a, b in self.parts(self.c_hash):
            yield part, pack(self.low(self.c_hash[a:b]), LOW // 8) + pack(self.c_other[a:b], 8) + pack(doc[a:b].view(np.uint64), 8)

    def finish(self, answers: np.ndarray) -> np.ndarray:
        """True for every byte to remove."""
        self.c_dup[self.c_asked] = answers & 1 == 1
        dup = self.c_dup[self.w_class] | (self.head_doc[self.w_group] > self.c_doc[self.w_class])
        # all places of the group in its first document share the group's windows
        table = np.zeros((len(self.head), self.length - GRAM + 1), dtype=bool)
        table[self.w_group[dup], self.w_shift[dup]] = True
        some = np.flatnonzero(table.any(axis=1)[self.group] & (self.doc[self.at] == self.head_doc[self.group]))
        row, shift = np.nonzero(table[self.group[some]])
        self.remove(self.first[self.at[some[row]]] + shift, np.ones(len(row), np.int64))
        return np.cumsum(self.gone[:-1]) > 0

    def remove(self, first: np.ndarray, windows: np.ndarray) -> None:
        np.add.at(self.gone, first, 1)
        np.add.at(self.gone, first + windows - 1 + self.length, -1)


def answer_grams(batch: list[bytes]) -> list[bytes]:
    """For each sent list a bit for each q-gram: another block has it."""
    values = [unpack(d, LOW // 8) for d in batch]
    known, at, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    more = (n > 1)[at.reshape(-1)]
    ends = offsets_of(np.array([len(v) for v in values]))
    return [more[a:b].astype(np.uint8).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def answer_documents(batch: list[bytes]) -> list[bytes]:
    """For each sent list a byte for each entry: 1 if a smaller document has it; 2 if its low hash has several entries."""
    width = LOW // 8 + 16
    n = [len(d) // width for d in batch]
    low = np.concatenate([unpack(d[: k * LOW // 8], LOW // 8) for d, k in zip(batch, n, strict=True)])
    key = np.concatenate([unpack(d[k * LOW // 8 : k * (LOW // 8 + 8)], 8) for d, k in zip(batch, n, strict=True)])
    doc = np.concatenate([unpack(d[k * (LOW // 8 + 8) :], 8) for d, k in zip(batch, n, strict=True)]).view(np.int64)
    order = np.lexsort((doc, key, low))
    low, key, doc = low[order], key[order], doc[order]
    new_low = np.r_[True, low[1:] != low[:-1]]
    new = new_low | np.r_[True, key[1:] != key[:-1]]
    group, bucket = np.cumsum(new) - 1, np.cumsum(new_low) - 1
    smaller = doc > doc[new][group]
    several = np.bincount(bucket[new])[bucket] > 1
    out = np.zeros(len(low), dtype=np.uint8)
    out[order] = smaller | (several & ~smaller).astype(np.uint8) << 1
    ends = offsets_of(np.array(n))
    return [out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def blocks(df: DataFrame, doc_id: str, text: str, length: int, block_bytes: int) -> DataFrame:
    """(block, ids, sizes, data, runs, rest): texts, the runs of their anchors, and their other columns."""

    def run(batches):
        part, number, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            nonlocal number, waiting, size
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            raw, sizes = text_bytes(table.column(text))
            first, count, anchor = anchors(raw, sizes, length)
            ids = pc.fill_null(table.column(doc_id).cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)
            rest = io.BytesIO()
            with pa.ipc.new_stream(rest, table.schema) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays([pa.nulls(table.num_rows, c.type) if n == text else c for n, c in zip(table.schema.names, table.columns, strict=True)], schema=table.schema))
            squeeze = zstandard.ZstdCompressor(level=3).compress
            runs = np.concatenate([count, anchor - first]).astype(np.uint8).tobytes()
            sizes = np.where(pc.is_null(table.column(text)).to_numpy(zero_copy_only=False), -1, sizes)  # a null text
            row = [part << 32 | number, ids.tobytes(), sizes.tobytes(), squeeze(raw.tobytes()), squeeze(runs), squeeze(rest.getvalue())]
            number, waiting, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([x], pa.binary()) for x in row[1:])], names=NAMES)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            begin = 0
            for i, n in enumerate(lengths.tolist()):
                size += n + 64
                if size >= block_bytes:
                    waiting.append(batch.slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield block()
            if begin < batch.num_rows:
                waiting.append(batch.slice(begin))
        if waiting and sum(b.num_rows for b in waiting):
            yield block()

    return df.mapInArrow(run, "block long, ids binary, sizes binary, data binary, runs binary, rest binary")


NAMES = ["block", "ids", "sizes", "data", "runs", "rest"]
SPANS = "array<struct<start:bigint,stop:bigint>>"
SENT = "part long, block long, kind int, data binary"


def _sent(kind: int, block: int, entries) -> pa.Table:
    entries = list(entries)
    return pa.table({"part": pa.array([p for p, _ in entries], pa.int64()), "block": pa.array([block] * len(entries), pa.int64()), "kind": pa.array([kind] * len(entries), pa.int32()), "data": pa.array([d for _, d in entries], pa.binary())})


def _answered(kind: int, answer):
    """The answers to what all blocks sent to one part of the exchange."""

    def run(table: pa.Table) -> pa.Table:
        found = answer(table.column("data").to_pylist())
        release()
        return table.set_column(table.schema.get_field_index("data"), "data", pa.array(found, pa.binary()))

    return run


def _replayed(rows: pa.Table, answers: pa.Table, length: int, bits: int, upto: int) -> tuple[dict, Block]:
    """The block with the answers it has got so far."""
    release()
    row = rows.to_pylist()[0]
    got: dict[int, list] = {1: [], 2: [], 3: []}
    for a in answers.to_pylist():
        got[a["kind"]].append((a["part"], a["data"]))
    one = lambda kind: np.frombuffer(b"".join(d for _, d in sorted(got[kind])), dtype=np.uint8)
    block = Block(row, length, bits)
    block.compare_surroundings(one(1) == 1)
    if upto >= 2:
        block.compare_windows(one(2))
    if upto >= 3:
        block.answers = one(3)
    return row, block


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, kept: str = "kept", spans: str = "spans") -> DataFrame:
    """All rows with ``kept`` (the remaining bytes) and ``spans`` (start and stop of each removed run of bytes)."""
    if length <= GRAM + 8:
        raise ValueError(f"length must be over {GRAM + 8}")
    batch_rows(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    grams = total * 2 // (length - GRAM + 2)
    bits = min(20, max(0, int(grams // PART_GRAMS).bit_length()))
    # a partition's rows in a fixed order: blocks that are packed again have the same rows under the same number
    ordered = df.sortWithinPartitions(F.col(doc_id), F.xxhash64(F.col(text)))
    packed = blocks(ordered, doc_id, text, length, block_bytes).repartition("block")
    schema = StructType([*(f for f in df.schema.fields if f.name not in (kept, spans)), *(StructField(n, _parse_datatype_string(t)) for n, t in ((kept, "binary"), (spans, SPANS)))])
    names = [f.name for f in df.schema.fields if f.name not in (kept, spans)]

    def first(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        return _sent(1, row["block"], Block(row, length, bits).send_grams())

    def second(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row, block = _replayed(rows, answers, length, bits, 1)
        return _sent(2, row["block"], block.send_surroundings())

    def third(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row, block = _replayed(rows, answers, length, bits, 2)
        return _sent(3, row["block"], block.send_windows())

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row, block = _replayed(rows, answers, length, bits, 3)
        gone = block.finish(block.answers)
        ends = offsets_of(block.sizes)
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[ends] = True
        before = np.r_[False, gone]
        start = np.flatnonzero(gone & (~before[:-1] | edge[:-1]))
        stop = np.flatnonzero(gone & (~np.r_[gone[1:], False] | edge[1:])) + 1
        owner = np.searchsorted(ends, start, side="right") - 1
        cut = offsets_of(np.bincount(owner, minlength=len(block.ids)))
        pairs = pa.StructArray.from_arrays([pa.array(start - ends[owner]), pa.array(stop - ends[owner])], names=["start", "stop"])
        remaining, raw = block.raw[~gone].tobytes(), block.raw.tobytes()
        till = np.r_[0, np.cumsum(~gone)][ends]
        rest = pa.ipc.open_stream(zstandard.decompress(row["rest"])).read_all()
        field = rest.schema.field(text)
        texts = [None if m else raw[a:b] for a, b, m in zip(ends[:-1].tolist(), ends[1:].tolist(), block.missing.tolist(), strict=True)]
        out = rest.set_column(rest.schema.get_field_index(text), field, pa.array(texts, pa.binary()).cast(field.type)).select(names)
        out = out.append_column(kept, pa.array([remaining[a:b] for a, b in zip(till[:-1].tolist(), till[1:].tolist(), strict=True)], pa.binary()))
        return out.append_column(spans, pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pairs))

    def answered(sent: DataFrame, kind: int, answer) -> DataFrame:
        return sent.groupBy("part").applyInArrow(_answered(kind, answer), SENT)

    by_block = packed.groupBy("block")
    one = answered(by_block.applyInArrow(first, SENT), 1, answer_grams)
    two = answered(by_block.cogroup(one.groupBy("block")).applyInArrow(second, SENT), 2, answer_documents)
    both = one.unionByName(two)
    three = answered(by_block.cogroup(both.groupBy("block")).applyInArrow(third, SENT), 3, answer_documents)
    return by_block.cogroup(both.unionByName(three).groupBy("block")).applyInArrow(last, schema)

