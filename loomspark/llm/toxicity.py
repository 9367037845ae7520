"""Toxicity by the nearest labelled examples."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import held, parts

#: Labelled rows that are drawn to learn from, at most: those with the smallest md5 of their doc_id; and the bytes of
#: their texts, in that order, at most. Both bounds hold for the fit alone: every row of docs is counted and scored.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 32 << 20
#: Examples of one block, neighbours that vote.
BLOCK, NEIGHBOURS = 64, 25
#: Weights in a text's lists up to which adding all of them costs less than finding the blocks to pass over.
DIRECT = 1 << 18
#: A term that the label favours weighs more, by 1 for each so much of its G statistic beyond chance.
TELLING = 6.0
#: Letters of a word's stem, a term of its own in longer words.
STEM = 5
# The same runs of letters and of numbers that aren't decimal digits, here and in Spark.
WORD, NO_WORD = re.compile(r"[^\W\d_]+"), r"[^\p{L}\p{Nl}\p{No}]+"


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list:
    """Up to `rows` rows (doc_id, text, label) of the labelled documents, by the smallest md5 of doc_id, of whose
    texts the first `size` bytes count: a text that goes beyond that is left out. Of rows that share a doc_id the
    smallest text stands for it. Only the labels are sorted; the sample is broadcast to the one scan of docs, and
    only the sampled texts are put in order."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    drawn = known.withColumn("place", F.md5(F.col("doc_id").cast("string"))).orderBy("place", "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    one = found.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))
    total = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = one.withColumn("total", total).where(F.col("total") <= size).select("doc_id", "text", "label")
    return sorted((r.doc_id, r.text, int(r.label)) for r in kept.collect())


def terms_of(word: str) -> tuple[str, ...]:
    return (word, "^" + word[:STEM]) if len(word) > STEM else (word,)


def term_counts(text: str) -> Counter:
    """Occurrences of each word (a run of letters) of a lower-cased text and of each longer word's stem."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(text)).items():
        for term in terms_of(word):
            out[term] += n
    return out


def marks(text: str) -> list[int]:
    """A text's six smallest 4-word shingle hashes: texts that share one count as copies while fitting."""
    words = text.split()
    return sorted({zlib.crc32(" ".join(words[i : i + 4]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 3))})[:6]


def without_copies(rows: list) -> list:
    """Rows that share no mark with an earlier one: copies of a text would make every word of it look telling."""
    seen: set[int] = set()
    kept = []
    for row in rows:
        least = marks(row[1])
        if not seen.intersection(least):
            kept.append(row)
        seen.update(least)
    return kept


def telling(rows: list) -> dict[str, float]:
    """By how much a term's weight is raised, for terms in more of the positive rows than chance explains: a G test
    of their document frequency, less a threshold that grows with the number of terms tested. One text's terms are
    held at a time."""
    n, positive = len(rows), sum(y for _, _, y in rows)
    every, hits = Counter(), Counter()
    for _, text, y in rows:
        terms = term_counts(text).keys()
        every.update(terms)
        if y:
            hits.update(terms)
    if not 0 < positive < n:
        return {}
    least, found = 2 * np.log(len(every)) + 6, {}
    for term, o in hits.items():
        a = every[term]
        e = a * positive / n
        if o > e:
            g = 2 * (o * np.log(o / e) + ((a - o) * np.log((a - o) / (a - e)) if a > o else 0))
            if g > least:
                found[term] = (g - least) / TELLING
    return found


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places in the ranges [start, end), one after the other, and the sizes of the ranges."""
    sizes = ends - starts
    done = np.cumsum(sizes)
    return np.repeat(starts - done + sizes, sizes) + np.arange(done[-1] if len(done) else 0), sizes


class Index:
    """Inverted lists over all terms of the labelled examples, cut into blocks of examples; each list keeps its
    largest weight in every block that it reaches, for exact search that passes over blocks."""

    def __init__(self, weights: dict[str, float], examples: Iterable[tuple[int, dict, int]], rate: float):
        """weights: the idf of each term, raised for telling ones. examples: (doc_id, counts of terms, label)."""
        hashes = np.array([xxh64_intdigest(t.encode("utf-8", "replace"), 42) for t in weights], np.uint64)
        order = np.argsort(hashes)
        self.idf, self.rate = np.array([*weights.values()], np.float64)[order], rate
        self.terms = dict(zip([*weights], np.argsort(order).tolist()))
        rows = []
        for doc_id, c, y in examples:
            known = {self.terms[t]: n for t, n in c.items() if t in self.terms}
            at, w = self.vector((np.fromiter(known.keys(), np.int64, len(known)), np.fromiter(known.values(), np.float64, len(known))))
            rows.append((doc_id, at.astype(np.int32), w.astype(np.float32), y))
        # examples with the same most common terms, so of one language, share blocks: sharper bounds
        rows.sort(key=lambda r: (*r[1][np.argsort(self.idf[r[1]], kind="stable")[:3]].tolist(), r[0]))
        self.ids, self.labels = np.array([r[0] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        self.blocks = -(-len(rows) // BLOCK)
        sizes = [len(r[1]) for r in rows]
        term = np.concatenate([r[1] for r in rows] or [np.zeros(0, np.int32)])
        order = np.argsort(term, kind="stable")
        term = term[order]
        self.example = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]
        self.weight = np.concatenate([r[2] for r in rows] or [np.zeros(0, np.float32)])[order]
        # a section is the part of a term's list in one block
        where = term.astype(np.int64) * max(1, self.blocks) + self.example // BLOCK
        begins = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
        self.sections = np.append(begins, len(where)).astype(np.int32)
        self.block = self.example[begins] // BLOCK
        self.most = np.maximum.reduceat(self.weight, begins) if len(where) else self.weight
        self.lists = np.searchsorted(term[begins], np.arange(len(self.terms) + 1)).astype(np.int32)
        self.slope, self.offset = 1.0, 0.0

    def __getstate__(self) -> dict:
        """The terms travel as one string, in the order of their places."""
        return self.__dict__ | {"terms": "\n".join(sorted(self.terms, key=self.terms.__getitem__))}

    def __setstate__(self, state: dict) -> None:
        terms = state["terms"]
        self.__dict__.update(state | {"terms": {t: k for k, t in enumerate(terms.split("\n"))} if terms else {}})

    def vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of the index's terms: (1 + ln tf) idf, of length 1."""
        at, tf = counts
        w = (1 + np.log(tf)) * self.idf[at]
        return at, w / (np.sqrt(w @ w) or 1.0)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the index's own terms in a text and how often each is there."""
        words = Counter(WORD.findall(text))
        stems: dict[str, int] = {}
        for word, n in words.items():
            if len(word) > STEM:
                stem = "^" + word[:STEM]
                stems[stem] = stems.get(stem, 0) + n
        size = len(words) + len(stems)
        at = np.fromiter(map(self.terms.get, chain(words, stems), repeat(-1)), np.int64, size)
        tf = np.fromiter(chain(words.values(), stems.values()), np.float64, size)
        hit = at >= 0
        return at[hit], tf[hit]

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0 (but those at `without`), exact; of
        equals the smaller doc_id first. Blocks are scored in the order of their bounds, the four best, then four
        times as many and so on, until no block left can hold a nearer one; short lists in all blocks at once. Sums
        are the same, to the last bit."""
        begins, ends = self.sections[self.lists[at]], self.sections[self.lists[at + 1]]
        if (ends - begins).sum() <= DIRECT:
            of, n = spread(begins, ends)
            s = np.bincount(self.example.take(of), np.repeat(w, n) * self.weight.take(of), minlength=len(self.ids))
            if without is not None:
                s[without] = 0.0
            places = np.flatnonzero(s > 0)
            if len(places) > k:
                places = places[s[places] >= np.partition(s[places], -k)[-k]]
            places = places[np.lexsort((self.ids[places], -s[places]))[:k]]
            return places, np.minimum(s[places], 1.0)
        lists, sizes = spread(self.lists[at], self.lists[at + 1])
        block, each = self.block[lists], np.repeat(w, sizes)
        bound = np.bincount(block, each * self.most[lists], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        places, cosines, done, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while done < len(order):
            now = order[done : done + step]
            if len(places) == k:
                now = now[bound[now] >= cosines[-1] - 1e-6]
                if not len(now):
                    break
            done, step = done + len(now), 4 * step
            chosen = np.zeros(self.blocks, bool)
            chosen[now] = True
            mine = np.flatnonzero(chosen[block])
            of, n = spread(self.sections[lists[mine]], self.sections[lists[mine] + 1])
            s = np.bincount(self.example[of], np.repeat(each[mine], n) * self.weight[of], minlength=len(self.ids))
            if without is not None:
                s[without] = 0.0
            p = np.flatnonzero(s > (cosines[-1] - 1e-9 if len(places) == k else 0))
            places, cosines = np.concatenate([places, p]), np.concatenate([cosines, s[p]])
            best = np.lexsort((self.ids[places], -cosines))[:k]
            places, cosines = places[best], cosines[best]
        return places, np.minimum(cosines, 1.0)

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the positive examples, each weighted by the inverse of its distance, drawn to the base rate."""
        w = cosines / (1.05 - cosines)
        return float(((w * self.labels[places]).sum() + 0.1 * self.rate) / (w.sum() + 0.1))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Platt scaling of votes that left their own example and its copies out."""
        x = np.stack([votes, np.ones_like(votes)], 1)
        y = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((labels == 0).sum() + 2))
        b = np.array([4.0, -2.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * b)
            b = b + np.clip(step, -5, 5)
            if abs(step).max() < 1e-8:
                break
        self.slope, self.offset = float(max(b[0], 1e-6)), float(b[1])

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text the score, and the places and cosines of its neighbours. All texts' terms are looked up before
        any neighbours: the terms and the lists don't take turns in the processor's caches."""
        return [self.judged(*self.nearest(at, w)) for at, w in [self.vector(self.counts(t)) for t in texts]]

    def judged(self, places: np.ndarray, cosines: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(places):
            return self.rate, places, cosines
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.vote(places, cosines) + self.offset, -30, 30)))), places, cosines


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """The number of docs and of those that hold each term, over every whole text. Terms meet by their XXH64; only
    those asked for are counted, so what is broadcast and what comes back is bounded by the sample they are from."""
    spark = docs.sparkSession
    hashes = np.array([xxh64_intdigest(t.encode("utf-8", "replace"), 42) for t in terms], np.uint64).view(np.int64)
    names = np.unique(hashes)
    asked = spark.createDataFrame(pa.table({"term": pa.array(names)}))
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), NO_WORD), lambda x: x != "")
    stems = F.transform(F.filter("w", lambda x: F.length(x) > STEM), lambda x: F.xxhash64(F.concat(F.lit("^"), F.substring(x, 1, STEM))))
    held_terms = docs.select(F.array_distinct(words).alias("w")).select(F.explode(F.array_distinct(F.concat(F.transform("w", lambda x: F.xxhash64(x)), stems))).alias("term"))
    found = held_terms.join(F.broadcast(asked), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    n = np.zeros(len(names))
    n[np.searchsorted(names, found["term"].to_numpy())] = found["n"].to_numpy()
    return docs.count(), n[np.searchsorted(names, hashes)] if len(names) else n


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, raised: bool = True) -> Index:
    """An index over a bounded sample of the labelled documents (see labelled_sample) and all of its terms, with
    document frequencies over all of docs. A term's weight is its idf, raised for terms that the label favours
    (see telling; not with raised=False). Without labels every score is near 0, with those of one kind near their rate."""
    lowered = docs.select("doc_id", F.lower("text").alias("text"))
    sample = labelled_sample(lowered, labels, label, rows)
    y = np.array([r[2] for r in sample], np.float64)
    terms: set[str] = set()
    for _, text, _ in sample:
        terms.update(term_counts(text))
    terms = sorted(terms)
    more = telling(without_copies(sample)) if raised else {}
    n, df = document_frequencies(docs, terms) if terms else (0, np.zeros(0))
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    rate = float(y.mean()) if len(y) else 0.0
    # one text's counts are held at a time
    index = Index({t: w * (1 + more.get(t, 0)) for t, w in zip(terms, idf.tolist())}, ((i, term_counts(text), v) for i, text, v in sample), rate)
    if 0 < rate < 1:
        place, alike = {i: k for k, i in enumerate(index.ids.tolist())}, {}
        for i, t, _ in sample:
            for mark in marks(t):
                alike.setdefault(mark, []).append(place[i])
        near = [index.nearest(*index.vector(index.counts(t)), without=[k for mark in marks(t) for k in alike[mark]]) for _, t, _ in sample]
        index.calibrate(np.array([index.vote(*x) for x in near]), y)
    else:
        index.slope, index.offset = 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """docs with `score` (the calibrated probability) and `evidence`, the nearest labelled examples with their
    cosines and labels, nearest first; columns of these names are replaced, all others and all rows stay, repeated
    ones too. Every whole text is scored by itself; a null or empty text, and one without any of the index's
    terms, has no evidence and gets the sample's rate of the label. An empty table stays empty. Terms that no example has carry no weight."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    evidence = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])

    @F.arrow_udf("score double, evidence array<struct<doc_id:bigint,cosine:double,label:int>>")
    def of(texts: pa.Array) -> pa.Array:
        held()
        model = shared.value
        found = [x for part in parts(texts) for x in model.scores([t or "" for t in part])]
        places = np.concatenate([p for _, p, _ in found] or [np.zeros(0, np.int64)])
        near = pa.StructArray.from_arrays([pa.array(model.ids[places]), pa.array(np.concatenate([c for _, _, c in found] or [np.zeros(0)])), pa.array(model.labels[places].astype(np.int32))], fields=list(evidence))
        offsets = np.concatenate([[0], np.cumsum([len(p) for _, p, _ in found], dtype=np.int64)]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array([s for s, _, _ in found], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), near)], names=["score", "evidence"])

    return docs.drop("score", "evidence").withColumn("__loom_scored", of(F.lower("text"))).select("*", "__loom_scored.score", "__loom_scored.evidence").drop("__loom_scored")
