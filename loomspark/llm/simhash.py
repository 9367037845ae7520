"""SimHash near-dedup by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, drop, held, parts, small
from .components import components

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of length 23.
GOLAY = 0b101011100011
#: Fingerprints of one key that are compared pair by pair; the keys of more are taken apart by neighbourhoods.
PAIRWISE = 32


@cache
def golay_errors() -> np.ndarray:
    """For each of the 2048 syndromes the error patterns of weight 4 at most, the lightest first, padded with it.

    The code is perfect: a word has one codeword within distance 3. If that is 3 away, five others are 4 away;
    if it is nearer, none are."""

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << bit - 11
        return x

    single = [syndrome(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for p in places:
                s ^= single[p]
            found[s].append(sum(1 << p for p in places))
    return np.array([x + x[:1] * (6 - len(x)) for x in found], np.int64)


@cache
def golay_syndromes() -> np.ndarray:
    """The syndrome of each 23-bit word's upper 12 bits (the rest is its own syndrome), by those bits."""
    out = np.zeros(4096, np.int64)
    for bit in range(12):
        x = 1 << bit + 11
        for at in range(bit + 11, 10, -1):
            if x >> at & 1:
                x ^= GOLAY << at - 11
        out[1 << bit : 2 << bit] = out[: 1 << bit] ^ x
    return out


def golay_keys(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords within distance 4 of 23-bit words: (n, 6), one or six different ones.

    Two words at distance 2 or less share one: the codeword within 3 of a word halfway is within 4 of both."""
    syndromes = golay_syndromes()[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ golay_errors()[syndromes]) >> 11


def fuzzy_keys(fingerprints: np.ndarray) -> np.ndarray:
    """(n, 18) keys of 64-bit fingerprints; those at distance 2 or less share one.

    A fingerprint is cut into segments of 23, 23 and 18 bits. Two errors leave one of them without any, and two at
    most in the others. So a key is one whole segment with a codeword index near another: (first, second),
    (second, first) or (third, first)."""
    x = fingerprints.astype(np.uint64)
    a, b, c = ((x >> np.uint64(41)).astype(np.int64), (x >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64), (x & np.uint64(0x3FFFF)).astype(np.int64))
    near_a, near_b = golay_keys(a), golay_keys(b)
    return np.concatenate([(a[:, None] << 12) + near_b, (1 << 35) + (b[:, None] << 12) + near_a, (2 << 35) + (c[:, None] << 12) + near_a], axis=1)


def simhash(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text, signed. Words are runs without ASCII white space, A-Z in lower case; features
    are the runs of so many words, repeats included, joined by spaces (fewer words: all of them), hashed by XXH64
    with seed 42. A bit is 1 if it is in more than half of the hashes; a text without words has 0."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    return simhash_words(found, words)


def simhash_words(found: list[bytes], words: int) -> int:
    if not found:
        return 0
    from xxhash import xxh64_intdigest

    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxh64_intdigest(joined, 42)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[:-words]])
        hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())], "<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # in bytes, so that no sum overflows
        set_bits += np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp: the SimHash of the whole text); a null text has no words. Other columns are left out."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        held()
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return docs.select("doc_id", of("text").alias("fp"))


def near_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints of `prints` (column fp, distinct) so that those at distance 2 or
    less are connected.

    Fingerprints that share a key (see fuzzy_keys) are compared: pair by pair where a key has PAIRWISE or fewer. The
    others each give themselves and the 64 fingerprints one bit away as points: all that share a point are within
    two bits of each other, and any two within two bits share one, so linking each to the smallest at a point loses
    no connection and makes no more rows than points. Nothing is capped."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            keys = np.sort(fuzzy_keys(fp.view(np.uint64)), axis=1)
            first = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
            yield pd.DataFrame({"key": keys[first], "fp": np.repeat(fp, first.sum(1))})

    keys = cut(prints.select("fp").mapInPandas(keyed, "key bigint, fp bigint"))
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = cut(keys.join(shared.where(F.col("n") <= PAIRWISE), "key", "left_semi"))
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    many = keys.join(shared.where(F.col("n") > PAIRWISE), "key", "left_semi").select("fp").distinct()
    points = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("point"))
    points = cut(points)
    least = cut(points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").select("point", "a"))
    stars = points.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    links = cut(pairs.unionByName(stars).distinct())
    drop(keys, shared, few, points, least)
    return links


def near_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id, the smallest doc_id that can be reached by links between
    fingerprints that differ in two bits or fewer.

    Rows of one fingerprint, thousands of copies or all texts without words, are first aggregated to their smallest
    doc_id; only different fingerprints are searched. Rows that share a doc_id are texts of one document and
    connect what they are linked to only through their fingerprints; a null doc_id is linked but names nothing, so
    its component_id is null if all of its component have none. An empty table gives no rows."""
    prints = cut(fingerprints(docs, words))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(classes))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(ids, "root"), "fp", "left").select("doc_id", "fp", "component_id")


#: Near copies of whole texts: words a shingle, similarity, mean words of a piece, pieces and shingle hashes kept.
SHINGLE, SIMILAR, PIECE_WORDS, PIECES, LEAST_HASHES = 5, 0.8, 12, 10, 32
#: Documents of one piece that are compared pair by pair.
FEW_DOCUMENTS = 8
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, of all of them if there are fewer."""
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = _mix(out * _ODD[1] + hashes[k : len(hashes) - n + 1 + k] * _ODD[k % 5])
    return out


def word_hashes(text: str | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w, 42) for w in (text or "").encode("utf-8", "replace").lower().split()], np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The set of a text's 5-word shingles, as sorted hashes."""
    hashes = word_hashes(text)
    return np.unique(_runs(hashes, SHINGLE)) if len(hashes) else hashes


def sketch(text: str | None) -> tuple[int, np.ndarray, np.ndarray, int, np.ndarray]:
    """SimHashes of a whole text and of up to PIECES pieces of it, its least shingle hashes, its shingles' number, and
    its lowest shingles (see lowest).

    Pieces begin at word pairs whose hash says so, on average every PIECE_WORDS words, so an edit changes only the
    piece it is in; of all pieces those with the smallest mixed SimHash are kept, in any text the same ones."""
    hashes = word_hashes(text)
    if not len(hashes):
        return 0, hashes, hashes, 0, hashes
    triples = _runs(hashes, 3)
    bits = np.unpackbits(triples.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate([[0], 1 + np.flatnonzero(_runs(hashes, 2)[:-1] % np.uint64(PIECE_WORDS) == 0)]) if len(hashes) > 3 else np.array([0])
    starts = starts[starts < len(triples)]
    sizes = np.diff(np.append(starts, len(triples)))
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    prints = np.packbits(sums * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    whole = np.packbits(sums.sum(0) * 2 > len(triples), bitorder="little").view("<u8")
    long = prints[sizes >= 5]
    long = np.unique(long if len(long) else prints)
    kept = long[np.argsort(_mix(long), kind="stable")[:PIECES]]
    least = np.unique(_runs(hashes, SHINGLE))
    return int(whole.view(np.int64)[0]), kept, least[:LEAST_HASHES], len(least), lowest(least)


def lowest(found: np.ndarray) -> np.ndarray:
    """The smallest 3 of 10 of a text's sorted shingle hashes, one more than a fifth of them at least: a text that is 0.8
    or more like this one lacks a fifth of the shingles at most, so it has all of these but a fifth of n."""
    return found[: max(-(-3 * len(found) // 10), len(found) // 5 + 1)]


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit hashes as one column, without an object for each number."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(arrays or [np.zeros(0, np.uint64)]).astype(np.uint64, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def open_texts(classes: DataFrame) -> DataFrame:
    """The doc_ids of classes (doc_id, n, low) that may have a near copy: so many of their lowest shingles are in
    another text too. No text with a near copy is left out."""
    low = classes.select("doc_id", "n", F.explode("low").alias("sh"))
    shared = cut(low.groupBy("sh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sh"))
    hits = low.join(small(shared), "sh", "left_semi").groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("hits"))
    ids = cut(hits.where("hits >= greatest((3 * n + 9) div 10, n div 5 + 1) - n div 5").select("doc_id").distinct())
    drop(shared)
    return ids


def prefixes(texts: DataFrame) -> DataFrame:
    """(doc_id, n, weight, sh, place): of each of `texts` (doc_id, alt, sh: every shingle) the rarest n // 5 + 1
    shingles, those of one text alone left out, and their places from the rarest, which those left out take too. Two
    texts that are 0.8 or more alike share one of theirs, as all order shingles alike (see may_link). The weight says
    how much a text has in common with all others."""
    counts = cut(texts.groupBy("sh").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))  # written, so that a common shingle's join can be split
    sizes = texts.groupBy("doc_id", "alt").agg(F.count(F.lit(1)).cast("int").alias("n"))
    common = texts.join(counts, "sh").groupBy("doc_id", "alt").agg(F.sort_array(F.collect_list(F.struct("c", "sh"))).alias("s"), F.sum("c").alias("weight"))
    first = common.join(sizes, ["doc_id", "alt"]).withColumn("few", F.expr("n div 5 + 1 - (n - size(s))")).where("few > 0")
    return first.select("doc_id", "n", "weight", F.posexplode(F.expr("slice(s, 1, int(few)).sh")).alias("k", "sh"), F.expr("n - size(s)").alias("before")).selectExpr("doc_id", "n", "weight", "sh", "before + k AS place")


def may_link(n: str, place: str, other: str, its_place: str) -> Column:
    """Whether texts of n and other shingles may be 0.8 or more alike if the rarest that they share is at these places.

    They would share 4/9 (n + other) shingles. None of those stands before the rarest one, so each text has that many
    from its place on. Between texts of one size that is the rarest ninth, not the fifth that inclusion takes."""
    return F.expr(f"9 * {place} <= 5 * {n} - 4 * {other} AND 9 * {its_place} <= 5 * {other} - 4 * {n}")


def connect(keyed: DataFrame, links: DataFrame, verify) -> DataFrame:
    """(node, root) of the links (a, b) and of all links that verify() confirms between texts that share a key in
    keyed (doc_id, n, weight, sh, place), where their sizes and places allow it (see may_link).

    In each round every key whose texts are not all connected gives pivots, those with most in common with the
    others first, one, then four, 16 and so on, from the third round on from all of its components but the largest;
    a pivot is compared with every text of the key that is not connected to it. That ends when each key's texts are
    connected or each of them was a pivot or is in the largest component. Of two texts that are not connected one is
    outside it, so no link between two components is missed. Near copies of one text take a round or two, without
    pairing them all, and a few texts that no link joins to a large group don't make pivots of its members.
    Components are made anew only after a round that found a link."""

    def unconnected(keyed: DataFrame, roots: DataFrame) -> DataFrame:
        now = keyed.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        sizes = now.groupBy("sh", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("sh").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("parts"))
        apart = cut(sizes.where("parts > 1").select("sh", F.col("m.root").alias("main")))
        found = cut(now.join(apart, "sh"))
        drop(apart)
        return found

    roots = cut(components(links))
    least = cut(keyed.groupBy("sh").agg(F.min("n").alias("least")))
    keyed = cut(keyed.join(least, "sh").where("9 * place <= 5 * n - 4 * least").drop("least"))  # others may link to no text of the key
    drop(least)
    now = unconnected(keyed, roots)
    done = tested = None
    step = 0
    while True:
        fresh = now.where("root != main") if step > 1 else now
        fresh = fresh if done is None else fresh.join(done, ["sh", "doc_id", "n", "place"], "left_anti")
        best = fresh.groupBy("sh", F.pmod(F.xxhash64("doc_id", F.lit(step)), F.lit(4**step)).alias("share")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "doc_id", "n", "place", "root")).alias("p"))
        pivots = cut(best.select("sh", "p.doc_id", "p.n", "p.place", "p.root"))
        if pivots.isEmpty():
            drop(keyed, now, pivots)
            return roots
        met = pivots.select("sh", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("root").alias("rx")).join(now, "sh")
        met = met.where((F.col("rx") != F.col("root")) & may_link("nx", "px", "n", "place"))
        pairs = met.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        marks = pivots.select("sh", "doc_id", "n", "place")
        done = marks if done is None else done.unionByName(marks)
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = None if pairs.isEmpty() else verify(pairs)
        if found is not None and not found.isEmpty():
            links = cut(links.unionByName(found))
            former, roots = (now, roots), cut(components(links))
            now = unconnected(now.drop("root", "main"), roots)
            drop(*former)
        step += 1


def likely_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the texts `doc_id` in classes (doc_id, whole, pieces, least, n) that may be alike enough to
    verify.

    Texts meet where their whole SimHashes are connected by near_links, and at each piece with the same SimHash:
    all pairs where FEW_DOCUMENTS meet or fewer; where more do, each with the smallest, and also, for each two places
    in common, with the smallest of those, so that texts that only quote one passage don't hide the others. Pairs
    whose sizes, or whose least shingle hashes (over three deviations of their estimate), rule out the similarity
    are dropped."""
    links = near_links(classes.select(F.col("whole").alias("fp")).distinct())
    roots = components(links).select(F.col("node").alias("whole"), "root")
    wholes = classes.select("doc_id", "whole").join(roots, "whole", "left").select("doc_id", F.xxhash64(F.coalesce("root", "whole"), F.lit("whole")).alias("at"))
    every = cut(wholes.unionByName(classes.select("doc_id", F.explode("pieces").alias("at"))).distinct())
    sizes = cut(every.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a")).where("n > 1"))
    met = cut(every.join(sizes, "at"))
    drop(every, sizes)
    few, many = met.where(F.col("n") <= FEW_DOCUMENTS), met.where(F.col("n") > FEW_DOCUMENTS)
    pairs = few.select("at", F.col("doc_id").alias("x")).join(few.select("at", F.col("doc_id").alias("b")), "at").where("x < b").select(F.col("x").alias("a"), "b")
    stars = many.select("a", F.col("doc_id").alias("b"))
    lists = many.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("ats"))  # PIECES + 1 at most
    twos = cut(lists.select("doc_id", F.explode(F.expr("flatten(transform(ats, (x, i) -> transform(slice(ats, i + 2, size(ats)), y -> xxhash64(x, y))))")).alias("two")))
    least = cut(twos.groupBy("two").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("most")).where("a < most").select("two", "a"))
    found = pairs.unionByName(stars).unionByName(twos.join(least, "two").select("a", F.col("doc_id").alias("b"))).where("a < b").distinct()
    facts = classes.select("doc_id", F.col("least").alias("l"), "n")
    both = found.join(facts.select(F.col("doc_id").alias("a"), F.col("l").alias("la"), F.col("n").alias("na")), "a").join(facts.select(F.col("doc_id").alias("b"), F.col("l").alias("lb"), F.col("n").alias("nb")), "b")
    near = F.expr(f"size(array_intersect(slice(array_sort(array_union(la, lb)), 1, {LEAST_HASHES}), array_intersect(la, lb))) / least({LEAST_HASHES}, size(array_union(la, lb)))")
    sized = F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")
    likely = cut(both.where(sized & (near >= SIMILAR - 0.25)).select("a", "b"))
    drop(links, met, twos, least)
    return likely


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, root) of every row with a doc_id: root is the smallest doc_id of its group of exact and
    near copies. Texts are linked if the Jaccard similarity of their sets of 5-word shingles (words between
    white space, A-Z in lower case) is 0.8 or more, verified exactly on the whole texts. Most links are found by
    fuzzy hashing (see sketch and likely_pairs); what it misses, by the shingles themselves (see open_texts, prefixes
    and connect), so that no link is. Equal texts, also all without words, are one text."""

    @F.arrow_udf("whole bigint, pieces array<bigint>, least array<bigint>, n int, low array<bigint>")
    def sketched(texts: pa.Array) -> pa.Array:
        held()
        return pa.concat_arrays([columns(*zip(*map(sketch, part))) if part else columns(*[()] * 5) for part in parts(texts)])

    def columns(whole: tuple, pieces: tuple, least: tuple, n: tuple, low: tuple) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(whole, pa.int64()), listed([*pieces]), listed([*least]), pa.array(n, pa.int32()), listed([*low])], names=["whole", "pieces", "least", "n", "low"])

    @F.arrow_udf("array<bigint>")
    def shingled(texts: pa.Array) -> pa.Array:
        held()
        return pa.concat_arrays([listed([shingle_hashes(t) for t in part]) for part in parts(texts)])

    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.select("doc_id", F.md5("text").alias("text_hash"), "text")
    with batches(docs.sparkSession):
        prints = cut(hashed.select("doc_id", "text_hash", sketched("text").alias("s")).select("doc_id", "text_hash", "s.*"))
    classes = cut(prints.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("whole", "pieces", "least", "n", "low")).alias("s")).select("text_hash", "doc_id", "s.*").withColumn("alt", F.row_number().over(Window.partitionBy("doc_id").orderBy("text_hash"))))
    repeated = not prints.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()

    # a doc_id that stands for several texts, numbered by alt, has all their pieces; each of its texts is then compared
    def texts_of(ids: DataFrame) -> DataFrame:
        return hashed.join(small(cut(ids)), "doc_id", "left_semi").join(classes.select("text_hash", "doc_id", "alt").hint("merge"), ["text_hash", "doc_id"])

    def verified(pairs: DataFrame) -> DataFrame:
        # each text's shingles are made once, however many pairs it is in
        with batches(docs.sparkSession):
            sets = cut(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()).select("doc_id", shingled("text").alias("s")))
        left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
        met = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
        links = cut(met.where(F.col("both") >= SIMILAR * (F.size("sa") + F.size("sb") - F.col("both")) - 1e-9).select("a", "b"))
        drop(sets)
        return links

    pairs = likely_pairs(classes)
    links = cut(verified(pairs))
    whole = texts_of(open_texts(classes)).select("doc_id", "alt", F.explode(shingled("text")).alias("sh"))
    with batches(docs.sparkSession):
        whole = cut(whole.distinct() if repeated else whole)
    keyed = cut(prefixes(whole))
    drop(whole)
    roots = connect(keyed, links, verified).withColumnsRenamed({"node": "doc_id"})
    named = classes.select("text_hash", "doc_id").join(roots, "doc_id", "left").select("text_hash", F.coalesce("root", "doc_id").alias("root"))
    found = cut(prints.select("doc_id", "text_hash").join(named, "text_hash"))
    drop(prints, classes, pairs, keyed)
    return found


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row, that of the smallest doc_id, left of each group of exact and near copies (see near_copies);
    all columns stay. Rows without a doc_id stay: nothing could refer to them. Of rows that share a doc_id those
    with the smallest text_hash of its group stay, and one of repeated rows."""
    found = near_copies(docs)
    kept = found.where("doc_id = root").groupBy("doc_id").agg(F.min("text_hash").alias("kept"), F.count(F.lit(1)).alias("rows"))
    gone = cut(found.where("doc_id != root").select("doc_id", "text_hash").unionByName(found.join(kept, "doc_id").where("doc_id = root and text_hash != kept").select("doc_id", "text_hash")).distinct())
    repeated = not kept.where("rows > 1").isEmpty()
    drop(found)
    gone = small(gone.withColumnsRenamed({"doc_id": "__loom_id", "text_hash": "__loom_hash"}))
    out = docs.join(gone, (F.col("doc_id") == F.col("__loom_id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("__loom_hash")), "left_anti").select(*docs.columns)
    if not repeated:
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
