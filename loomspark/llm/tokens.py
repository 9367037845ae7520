"""Token-id files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, cut, held, parts, small

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: Pre-tokens whose ids a worker remembers, and the slots of its table (a power of two).
KEPT_PIECES, SLOT_BITS = 900_000, 21
#: Bytes of text that are cut at a time.
CUT_BYTES = 1 << 19
FILE_COLUMNS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ranked", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
FILE_SCHEMA = "part int, block int, ids_before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, ranked binary, control binary, data binary"

# Texts with an apostrophe (a contraction may begin there), or with characters beyond ASCII that aren't Latin letters,
# are not cut here but given to the library whole.
UNCUT = re.compile("['\x80-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u0250-\U0010ffff]")
SPACE, LETTER, DIGIT, OTHER, END = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[ord("A") : ord("Z") + 1] = CLASS[ord("a") : ord("z") + 1] = CLASS[0x80:] = LETTER
CLASS[0xFF] = END  # no byte of UTF-8: stands after each text
#: Powers of a base and of its inverse modulo 2^64, for hashes of all pieces from one running sum.
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & 0xFFFFFFFFFFFFFFFF
    return np.multiply.accumulate(out)


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library. Such a model encodes each pre-token (a word
    with the space before it, a number, a run of other signs or of white space) by itself; so texts are cut into
    these by byte classes, and the ids of each piece are taken from the library once and remembered, found by a 64-bit
    hash and compared byte by byte. Texts that can't be cut this way (see UNCUT), or that hold one of the model's
    added tokens, go to the library whole; so do all if the model rewrites texts first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.plain = self.model.normalizer is None
        self.newline = self._whole("\n")
        self.powers, self.inverse = _powers(BASE, CUT_BYTES + 1), _powers(pow(BASE, -1, 1 << 64), CUT_BYTES + 1)
        self.forget()

    def forget(self) -> None:
        self.count = 0
        self.known: dict[int, int] = {}  # places of the pieces whose slot another one has, by their hash
        self.clashing: dict[bytes, int] = {}  # places of the pieces whose hash another one has
        self.text, self.begins, self.written = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int32), 0
        self.slots, self.places = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
        self.starts, self.sizes, self.ids, self.held = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 17, np.uint32), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Remembers pieces and their ids, and returns their places. They are given to the library with newlines between
        them, as a newline is a pre-token of its own next to anything but white space."""
        names = [p.decode() for p in pieces]
        blank = [k for k, w in enumerate(names) if w.isspace()]
        solid = [k for k, w in enumerate(names) if not w.isspace()]
        ids = self._whole("\n".join(names[k] for k in solid)) if len(self.newline) == 1 else self.newline
        cuts = np.flatnonzero(ids == self.newline[0])
        if solid and len(cuts) == len(solid) - 1:
            sizes, ids = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1, ids[ids != self.newline[0]]
        else:
            blank, solid, sizes, ids = [*solid, *blank], [], np.zeros(0, np.int64), self.ids[:0]
        each = [self._whole(names[k]) for k in blank]
        sizes, ids = np.concatenate([sizes, np.array([len(x) for x in each], np.int64)]), np.concatenate([ids, *each])
        order, n, more = [*solid, *blank], self.count, len(pieces)
        raw = b"".join(pieces[k] for k in order)
        self.count += more
        while len(self.sizes) < n + more:
            self.starts, self.sizes, self.begins = np.append(self.starts, self.starts * 0), np.append(self.sizes, self.sizes * 0), np.append(self.begins, self.begins * 0)
        while len(self.ids) < self.held + len(ids):
            self.ids = np.append(self.ids, self.ids * 0)
        while len(self.text) < self.written + len(raw):
            self.text = np.append(self.text, self.text * 0)
        self.starts[n : n + more], self.sizes[n : n + more] = self.held + np.cumsum(sizes) - sizes, sizes
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        lengths = np.array([len(pieces[k]) for k in order], np.int64)
        self.begins[n : n + more] = self.written + np.cumsum(lengths) - lengths
        self.text[self.written : self.written + len(raw)] = np.frombuffer(raw, np.uint8)
        self.written += len(raw)
        out = np.empty(more, np.int64)
        out[order] = np.arange(n, n + more)
        return out

    def _file(self, hashes: np.ndarray, at: np.ndarray) -> None:
        """Makes new pieces be found by their (different) hashes."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        free = self.places[slot] < 0  # a slot stays with its first piece
        self.slots[slot[free]] = hashes[free]
        won = free & (self.slots[slot] == hashes)
        self.places[slot[won]] = at[won]
        self.known.update(zip(hashes[~won].tolist(), at[~won].tolist()))

    def _same(self, b: np.ndarray, at: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the pieces b[at:end] are, byte by byte and in length, the remembered ones at their places."""
        sizes = ends - at
        shift = np.repeat(self.begins[place] - at, sizes)
        equal = self.text.take(np.arange(len(b)) + shift, mode="clip") == b
        stops = np.append(self.begins[1 : self.count], self.written)
        return np.logical_and.reduceat(equal, at) & (stops[place] - self.begins[place] == sizes)

    def _cut(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in raw, each ended by 0xFF, and the number of ids before each end."""
        b = np.frombuffer(raw, np.uint8)
        c = CLASS[b]
        before, after = np.concatenate([[np.uint8(END)], c[:-1]]), np.concatenate([c[1:], [np.uint8(END)]])
        spaces, solid = c == SPACE, (c != SPACE) & (c != END)
        # a run of white space leaves its last character to what follows it: a space joins that, others stand alone
        begins = (spaces & ((before != SPACE) | ((after != SPACE) & (after != END)))) | (c == END)
        joined = np.concatenate([[False], b[:-1] == 32])
        begins |= solid & np.where(before == SPACE, ~joined, before != c)
        at = np.flatnonzero(begins)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.powers[: len(b)])])
        ends = np.append(at[1:], len(b))
        hashes = (sums[ends] - sums[at]) * self.inverse[at] * np.uint64(0xD6E8FEB86659FD93)
        stop = c[at] == END
        hashes[stop] = 0
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place = np.where(self.slots[slot] == hashes, self.places[slot], -1).astype(np.int64)
        place[stop] = -1
        missed = np.flatnonzero((place < 0) & ~stop)
        if len(missed):
            names, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            new = [k for k, h in enumerate(names.tolist()) if h not in self.known]
            if new:
                where = missed[first[new]]
                self._file(names[new], self._learn([raw[s:e] for s, e in zip(at[where].tolist(), ends[where].tolist())]))
            slot = (names >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            found = np.where(self.slots[slot] == names, self.places[slot], -1).astype(np.int64)
            rest = np.flatnonzero(found < 0)
            found[rest] = np.fromiter(map(self.known.__getitem__, names[rest].tolist()), np.int64, len(rest))
            place[missed] = found[back]
        for k in np.flatnonzero(~stop & ~self._same(b, at, ends, place)).tolist():  # another piece has its hash
            piece = raw[at[k] : ends[k]]
            if piece not in self.clashing:
                self.clashing[piece] = int(self._learn([piece])[0])
            place[k] = self.clashing[piece]
        sizes = np.where(stop, 0, self.sizes[place]).astype(np.int64)
        done = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[place] - done + sizes, sizes) + np.arange(done[-1])]
        return ids, done[stop]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.count > KEPT_PIECES:
            self.forget()
        out: list = [None] * len(texts)
        raw, at, size = [], [], 0

        def flush() -> None:
            nonlocal raw, at, size
            if raw:
                ids, ends = self._cut(b"\xff".join(raw) + b"\xff")
                for k, s, e in zip(at, [0, *ends[:-1].tolist()], ends.tolist()):
                    out[k] = ids[s:e]
            raw, at, size = [], [], 0

        for k, text in enumerate(texts):
            if not self.plain or len(text) * 2 >= CUT_BYTES or UNCUT.search(text) or any(t in text for t in self.added):
                out[k] = self._whole(text)
                continue
            found = text.encode()
            if size + len(found) >= CUT_BYTES:
                flush()
            raw.append(found)
            at.append(k)
            size += len(found) + 1
        flush()
        return out


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of uint32 ids. ranked: the ids that occur, the most frequent first (then the
    smaller), as little-endian uint32. An id is written as its place there in 1 to 4 little-endian bytes of
    `data`; 2 bits of `control` hold that number less 1, four to a byte from the lowest bits on."""
    counts = np.bincount(ids)
    order = np.lexsort((np.arange(len(counts)), -counts))[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), "<u4")
    rank[order] = np.arange(len(order), dtype="<u4")
    places = rank[ids]
    code = (places > 0xFF).astype(np.uint8) + (places > 0xFFFF) + (places > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = places.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


#: Number of data bytes of the four values of each control byte.
SIZES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4


def unpack(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The uint32 ids that pack() was given."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(sizes) - sizes
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    places = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        places[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[places]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Writes docs (doc_id, text) as token files at `path`, in ascending doc_id order (null first).

    A document is its text's ids (a null text's are none) and end_id. The files are Parquet, one to each range of
    doc_id, with a row per block of whole documents: part, block, ids_before (ids in the part's earlier blocks),
    n_ids, doc_ids, lengths (ids of each document) and the coded ids (see pack), ranked by the block's own counts,
    so each block can be read alone. Rows that share a doc_id are written one after the other; other columns
    are ignored; an empty table writes no rows. A task holds one block and the text being read."""

    def blocks(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        block, before, doc_ids, held, size = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ranked, control, data = pack(ids)
            row = (part, block, before, len(ids), doc_ids, [len(x) for x in held], ranked, control, data)
            return pa.RecordBatch.from_pylist([dict(zip(FILE_COLUMNS.names, row))], schema=FILE_COLUMNS)

        for batch in found:
            names = iter(batch.column("doc_id").to_pylist())
            for texts in parts(batch.column("text")):
                for ids, name in zip(model.encode(texts) if texts else (), names):
                    doc_ids.append(name)
                    held.append(np.append(ids, np.uint32(end_id)))
                    size += len(held[-1])
                    if size >= BLOCK_IDS:
                        yield close()
                        block, before, doc_ids, held, size = block + 1, before + size, [], [], 0
        if held:
            yield close()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if rows.schema["doc_id"].dataType.simpleString() != "bigint":
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    with batches(docs.sparkSession):
        ranged.mapInArrow(blocks, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents in token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with
    with_ids the ids themselves. Each block is decoded by itself; only the parts' totals, a row for each
    file, are put in order."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = lambda name: batch.column(name)[k].as_py()  # noqa: B023, E731
                ids = np.ascontiguousarray(unpack(row("ranked"), row("control"), row("data"), row("n_ids")), "<u4")
                sizes = np.array(row("lengths"), np.int64)
                ends = np.cumsum(sizes)
                out = {"doc_id": batch.column("doc_ids")[k].values, "start": row("part_start") + row("ids_before") + ends - sizes, "n_tokens": sizes, "ids_crc32": np.array([zlib.crc32(ids[e - n : e]) for e, n in zip(ends, sizes)], np.int64)}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(ends - sizes, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    return files.join(small(cut(starts)), "part").drop("part", "block").mapInArrow(documents, schema)
