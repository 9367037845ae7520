"""The next-phrase model straight from lines: every place of a text is dealt out once, as a window of words.

A table of all n-grams up to length 5 holds each word 15 times, and its split into prefixes and suggestions 20 times
more. Here the window of words that begins at a place stands for all n-grams that do; windows are sorted, counted and
compressed before they are dealt out, and what has been dealt out gives suggestions without another shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import normalize
from loomspark.sources.tables import share_package

from .langmodel import PHRASE_LIMITS, PHRASE_PROBABILITIES, best_phrases

#: Places of one block, which are sorted together; places of one bucket, which one task counts; rows of a result's batch.
BLOCK, BUCKET, ROWS = 1 << 20, 1 << 20, 1 << 16
#: One line in so many tells which words begin too many windows for one bucket, at most so many words.
SAMPLE, MOST_WORDS = 64, 1000
PACKED = "bucket int, often boolean, n int, width int, size int, words binary, windows binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0xA0761D6478BD642F)


def windows(ids: np.ndarray, offsets: np.ndarray, longest: int) -> list[np.ndarray]:
    """The columns of the windows of up to `longest` words that begin at each place of lines, which begin at offsets
    of ids: 0 where a line has ended."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(ids))
    padded = np.append(ids, np.zeros(longest, ids.dtype))
    return [np.where(at + k < ends, padded[k : k + len(ids)], 0) for k in range(longest)]


def ordered(columns: list[np.ndarray], ids: int) -> np.ndarray:
    """The order of windows by their columns, whose numbers are below ids; as many columns a sort as go into 63 bits."""
    bits = max(1, int(ids).bit_length())
    keys = []
    for at in range(0, len(columns), 63 // bits):
        key = np.zeros(len(columns[0]), np.int64)
        for column in columns[at : at + 63 // bits]:
            key = key << bits | column
        keys.append(key)
    order = np.argsort(keys[0])
    equal = np.diff(keys[0][order]) == 0
    tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal)) if len(order) and len(keys) > 1 else []
    if len(tied):
        some = order[tied]
        order[tied] = some[np.lexsort([key[some] for key in keys[::-1]])]
    return order


def starts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each number of columns, whether a row of sorted windows differs from the row before in the first so many."""
    out, new = [], np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new = new.copy()
        new[1:] |= column[1:] != column[:-1]
        out.append(new)
    return out


def planes(column: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: alike bytes beside each other."""
    return column.view(np.uint8).reshape(-1, column.itemsize).T.tobytes()


def unplaned(data: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(width, -1).T).view(f"<u{width}").reshape(-1)


def are_in(words: pa.Array, chosen: frozenset) -> np.ndarray:
    """By 1 + a word's place, whether it is one of chosen."""
    return np.append(False, pc.is_in(words, pa.array([*chosen], pa.string())).to_numpy(zero_copy_only=False)).astype(bool)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, none empty, the same in every block."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(ends))
    out = np.add.reduceat((data + np.uint64(1)) * _FACTORS[place % len(_FACTORS)], starts)
    return (out ^ out >> np.uint64(32)) * _ODD


def pack(words: pa.Array, ids: np.ndarray, offsets: np.ndarray, longest: int, buckets: int, heavy: frozenset) -> Iterator[tuple]:
    """Rows of PACKED of a block of lines, whose words are words[ids]: the different windows and their counts. A
    window goes to the bucket of its first word, or of its first two if the first is one of heavy."""
    hashes = np.append(np.uint64(0), word_hashes(words))
    often = are_in(words, heavy)
    columns = windows(ids.astype(np.int32) + 1, offsets, longest)
    order = ordered(columns, len(words) + 1)
    columns = [c[order] for c in columns]
    first = np.flatnonzero(starts(columns)[-1])
    counts = np.diff(np.append(first, len(order))).astype("<u4")
    columns = [c[first] for c in columns]
    second = hashes[columns[1]] if longest > 1 else np.uint64(0)
    hashed = hashes[columns[0]] + np.where(often[columns[0]], (second + np.uint64(1)) * _ODD, np.uint64(0))
    bucket = (((hashed * _ODD) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    part = bucket * 2 + often[columns[0]]
    order = np.argsort(part.astype(np.uint16) if buckets < 1 << 15 else part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    codec = pa.Codec("zstd", 1)
    place = np.zeros(len(words) + 1, np.int64)
    for rows in np.split(order, cuts[1:]):
        mine = [c[rows] for c in columns]
        seen = np.zeros(len(words) + 1, bool)
        for c in mine:
            seen[c] = True
        seen[0] = False
        used = np.flatnonzero(seen)
        place[used] = np.arange(1, len(used) + 1)
        width = 2 if len(used) < 1 << 16 else 4
        local = [place[c] for c in mine]
        local[:2] = [np.diff(c, prepend=0) for c in local[:2]]  # sorted, so mostly small
        data = b"".join(planes(c.astype(f"<u{width}")) for c in local) + planes(counts[rows])
        names = words.take(pa.array(used - 1))
        ends = np.frombuffer(names.buffers()[1], "<i4")[: len(names) + 1]
        text = np.uint32(len(names)).tobytes() + planes(np.diff(ends)) + (names.buffers()[2] or b"")[: ends[-1]]
        yield int(bucket[rows[0]]), bool(often[columns[0][rows[0]]]), len(rows), width, len(text), codec.compress(text, asbytes=True), codec.compress(data, asbytes=True)


def unpack(n: int, width: int, size: int, words: bytes, data: bytes, longest: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """(words, columns of windows of 1 + places in words, counts) of a row that pack() gave."""
    codec = pa.Codec("zstd")
    text = codec.decompress(words, size)
    m = int(np.frombuffer(text, "<u4", 1)[0])
    lengths = unplaned(np.frombuffer(text, np.uint8)[4 : 4 + 4 * m], 4)
    ends = np.append(0, np.cumsum(lengths, dtype=np.int32)).astype(np.int32)
    names = pa.StringArray.from_buffers(m, pa.py_buffer(ends), text.slice(4 + 4 * m))
    raw = np.frombuffer(codec.decompress(data, n * (longest * width + 4), asbytes=True), np.uint8)
    columns = [unplaned(raw[k * n * width : (k + 1) * n * width], width) for k in range(longest)]
    columns[:2] = [np.cumsum(c, dtype=c.dtype) for c in columns[:2]]
    return names, columns, unplaned(raw[longest * n * width :], 4)


def suggestions(packed: list[tuple], limits: tuple, probabilities: tuple, heavy: frozenset, partial: bool) -> Iterator[pa.RecordBatch]:
    """The suggestions of a bucket's windows (see langmodel.next_phrase), for prefixes that no other bucket has. With
    partial, from windows that begin with one of heavy alone, of the other ones, single words in heavy: the first by (freq descending, text) here, (phrase,
    next_phrase, freq, n_words), and their own counts here, with no words."""
    longest = len(limits) + 1
    found = [unpack(*row, longest) for row in packed]
    packed.clear()
    coded = pa.concat_arrays([w for w, _, _ in found]).dictionary_encode()
    words = coded.dictionary
    # in the order of joined text a word ends with a space, the last one by itself: the same but for control characters
    by_text = not pc.any(pc.match_substring_regex(words, r"[\x00-\x1f]")).as_py()
    spaced = pc.sort_indices(words if by_text else pc.binary_join_element_wise(words, "", " ")).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[spaced] = np.arange(1, len(words) + 1)
    words = words.take(pa.array(spaced))
    plain = np.arange(-1, len(words), dtype=np.int32)
    if not by_text:
        plain[1 + pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    numbers = rank[coded.indices.to_numpy()]
    columns, counts, done = [[] for _ in range(longest)], [], 0
    while found:
        mine, local, c = found.pop()
        size = len(numbers) - done
        names = np.append(np.int32(0), numbers[size - len(mine) : size].astype(np.int32))
        done += len(mine)
        for k, column in enumerate(local):
            columns[k].append(names[column])
        counts.append(c)
    columns, counts = [np.concatenate(c) for c in columns], np.concatenate(counts).astype(np.int64)
    often = are_in(words, heavy)
    order = ordered(columns, len(words) + 1)
    columns, counts = [c[order] for c in columns], counts[order]
    del order, numbers, rank
    before_own = pc.sum(pc.less(words, "@")).as_py() or 0  # of plain ranks, those before "@"
    own_word = pc.index(words, "@").as_py() + 1
    new = starts(columns)
    runs = [np.cumsum(x, dtype=np.int32) - 1 for x in new]
    first = [np.flatnonzero(x) for x in new]
    freq = [np.add.reduceat(counts, f) for f in first]
    del new

    def joined(rows: np.ndarray, of: list[np.ndarray]) -> pa.Array:
        parts = [words.take(pa.array(c[rows] - 1)) for c in of]
        return pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]

    for k in range(1, longest):
        for n in range(1, longest - k + 1):
            j = k + n
            own = freq[j - 1]
            known = columns[j - 1][first[j - 1]] > 0
            if not partial:
                known &= (freq[k - 1] >= 2)[runs[k - 1][first[j - 1]]]
                if k == 1:
                    known &= ~often[columns[0][first[j - 1]]]
            known = np.flatnonzero(known)
            at, own = first[j - 1][known], own[known]
            parent = runs[k - 1][at]
            total = freq[k - 1][parent]
            # what isn't probable enough has no place before what is
            chosen = np.arange(len(at)) if partial else np.flatnonzero(own / total >= probabilities[n - 1])
            last = columns[j - 1][at[chosen]]
            if by_text:  # rows are in the order of the suggestions' text
                chosen = chosen[np.argsort(parent[chosen] * (own.max(initial=0) + 1) - own[chosen], kind="stable")]
            else:
                chosen = chosen[np.lexsort((plain[last], runs[j - 2][at[chosen]], -own[chosen], parent[chosen]))]
            last, group = columns[j - 1][at[chosen]], parent[chosen]
            begins = np.flatnonzero(np.diff(group, prepend=-1))
            place = 1 + np.arange(len(chosen)) - np.repeat(begins, np.diff(np.append(begins, len(chosen))))
            if not partial and n == 1:
                place += (own[chosen] < total[chosen]) | (plain[last] >= before_own)  # the prefix itself, as "@"
            keep = place <= limits[n - 1]
            if not partial and n == 1:
                keep &= last != own_word
            chosen = chosen[keep]
            for begin in range(0, len(chosen), ROWS):
                some = chosen[begin : begin + ROWS]
                rows = at[some]
                f = pa.array(own[some])
                value = pa.array(np.full(len(some), n, np.int32)) if partial else pa.array(own[some] / total[some])
                yield pa.RecordBatch.from_arrays([joined(rows, columns[:k]), joined(rows, columns[k:j]), f, value], names=["phrase", "next_phrase", "freq", "n_words" if partial else "probability"])
        if partial:
            own = first[0]
            yield pa.RecordBatch.from_arrays([joined(own, columns[:1]), pa.nulls(len(own), pa.string()), pa.array(freq[0]), pa.array(np.zeros(len(own), np.int32))], names=["phrase", "next_phrase", "freq", "n_words"])
            return


def next_phrase(lines: DataFrame, limits: tuple = PHRASE_LIMITS, probabilities: tuple = PHRASE_PROBABILITIES, column: str = "value", bucket: int = BUCKET, sample: int = SAMPLE) -> DataFrame:
    """langmodel.next_phrase of ngrams.phrase_counts, of phrases of up to len(limits) + 1 words, over all lines.

    Windows of one first word meet in one bucket. Words that begin many (by one line in `sample`, which decides
    nothing else) have theirs dealt out by the first two words; what such a word by itself suggests is joined from the
    first few of all buckets. A bucket has about `bucket` places."""
    share_package(lines.sparkSession)
    longest = len(limits) + 1
    texts = lines.select(normalize(F.col(column)).alias("line"))
    some = lines.select(column, F.monotonically_increasing_id().alias("at")).where(F.col("at") % sample == 0)
    found = some.select(F.explode(F.split(normalize(F.col(column)), " ")).alias("w")).rollup("w").count().orderBy(F.desc("count"), F.asc_nulls_first("w")).limit(MOST_WORDS + 1).collect()
    places = sample * found[0]["count"] if found else 0
    buckets = max(lines.sparkSession.sparkContext.defaultParallelism, -(-places // bucket))
    heavy = frozenset(r.w for r in found[1:] if 2 * sample * r["count"] * buckets > places)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> Iterator[pa.RecordBatch]:
            split = pa.concat_arrays(held)
            coded = split.flatten().dictionary_encode()
            offsets = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64))
            held.clear()
            for row in pack(coded.dictionary, coded.indices.to_numpy(), offsets, longest, buckets, heavy):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.column(0).slice(at, 1000).cast(pa.string())
                held.append(pc.split_pattern(some.filter(pc.not_equal(some, "")), " "))
                size += len(held[-1].flatten())
                if size >= BLOCK:
                    yield from block()
                    size = 0
        if size:
            yield from block()
        pa.default_memory_pool().release_unused()

    def of(partial: bool):
        def suggested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen = (batch.filter(batch.column(1)) if partial else batch for batch in batches)
            rows = [r for batch in chosen for r in zip(*(batch.column(k).to_pylist() for k in range(2, 7)))]
            if rows:
                yield from suggestions(rows, limits, probabilities, heavy, partial)
                pa.default_memory_pool().release_unused()

        return suggested

    names, types = [x.split()[0] for x in PACKED.split(", ")], [pa.int32(), pa.bool_()] + [pa.int32()] * 3 + [pa.binary()] * 2
    dealt = texts.mapInArrow(packed, PACKED).repartitionById(buckets, F.col("bucket"))
    whole = dealt.mapInArrow(of(False), "phrase string, next_phrase string, freq bigint, probability double")
    if not heavy:
        return whole
    parts = dealt.mapInArrow(of(True), "phrase string, next_phrase string, freq bigint, n_words int")
    # counts of a word come from all buckets, those of its suggestions each from one
    rows = parts.groupBy("phrase", "next_phrase", "n_words").agg(F.sum("freq").alias("freq"))
    totals = F.sum(F.when(F.col("n_words") == 0, F.col("freq"))).over(Window.partitionBy("phrase"))
    rows = rows.withColumn("total", totals).where("total >= 2").select("phrase", F.coalesce("next_phrase", F.lit("@")).alias("next_phrase"), "freq", F.greatest("n_words", F.lit(1)).alias("n_words"), "total")
    return whole.unionByName(best_phrases(rows, limits, probabilities))
