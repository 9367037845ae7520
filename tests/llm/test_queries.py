"""The registered queries without SQL, on the whole smallest tables, against brute force or held-out labels."""

import hashlib
import html as entities
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from loomspark.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op1_document_fingerprints"](spark, SF).collect()}
    assert sorted(got) == [i for i, _ in texts]
    bag = lambda t: Counter(w for w in re.split(r"[\W_]+", t.lower()) if w)
    like = lambda a, b: sum((bag(a) & bag(b)).values()) / max(1, sum((bag(a) | bag(b)).values()))
    off = []
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [got[i].near_edited - like(t, edited), got[i].near_next - like(t, nxt)]
    assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.3
    same = {}
    for i, t in texts:
        same.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize("name,folds,out,label", [("op2_quality_classifier", 4, 2, "quality"), ("op4_toxicity", 3, 1, "toxic")])
def test_classifiers(spark, name, folds, out, label):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [i for i in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.88
    pairs = [(got[a].score, got[b].score) for a in held for b in held if labels[a] > labels[b]]
    assert np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]) > 0.85


def test_quality_scores(spark, texts):
    """Every score of the query against a forward pass written from the definition."""
    from loomspark.llm import quality
    from loomspark.llm.queries import fold

    from .test_learned import slow_score

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    net = quality.fit(docs, labels.where(fold("doc_id", 4) != 2), "quality")
    got = {r.doc_id: r.score for r in QUERIES["op2_quality_classifier"](spark, SF).collect()}
    for i, t in texts:
        if len(t) < 1500 or i % 20 == 0:
            assert got[i] == pytest.approx(slow_score(net, t), abs=1e-4)


def test_toxicity_neighbours(spark, texts):
    """Scores and evidence of the whole query against brute force over full vectors of all terms."""
    from loomspark.llm import toxicity
    from loomspark.llm.queries import fold

    from .test_learned import hold_against_brute_force

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    index = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1), "toxic")
    counts = {i: toxicity.term_counts(t.lower()) for i, t in texts}
    more = toxicity.telling(toxicity.without_copies([(i, t.lower(), int(index.labels[list(index.ids).index(i)])) for i, t in texts if i in set(index.ids.tolist())]))
    for term, place in index.terms.items():
        df = sum(term in c for c in counts.values())
        assert index.idf[place] == pytest.approx((np.log((1 + len(texts)) / (1 + df)) + 1e-3) * (1 + more.get(term, 0)))
    hold_against_brute_force(index, counts, [t.lower() for _, t in texts])
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    for i, t in texts:
        score, places, cosines = index.score(t.lower())
        assert got[i].score == pytest.approx(score) and [e.doc_id for e in got[i].evidence] == index.ids[places].tolist() and [e.cosine for e in got[i].evidence] == pytest.approx(cosines.tolist())


def test_main_text(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op5_html_extraction"](spark, SF).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r.page_id], re.S)[1]
        plain = entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(?:/?p|/?h1|br)[^>]*>", " ", article)))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)


def test_the_cut_decides(spark):
    """Every page of the table would have another text if each block followed its own classifier."""
    from loomspark.llm import html as extraction

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights, blocks_in_all, turned = extraction.fit(pages), 0, 0
    for r in pages.collect():
        blocks, elements = extraction.blocks_of(r.html)
        labels, said = extraction.label(blocks, elements, weights)
        blocks_in_all, turned = blocks_in_all + len(blocks), turned + sum((c > 0) != k for k, c in zip(labels, said))
    assert turned > 0.05 * blocks_in_all


def test_token_ids(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    got, at = {r.doc_id: r for r in QUERIES["op6_token_ids"](spark, SF).collect()}, 0
    for i, t in texts:
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect()}
    prints = []
    for _, t in texts:
        w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t).encode()
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", w) if x]
        h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    for k, (i, _) in enumerate(texts):
        assert got[i].fingerprint == f"{prints[k]:016x}" and got[i].component_id == texts[root[k]][0]


def test_pipeline(spark, texts):
    got = QUERIES["pipeline"](spark, SF).orderBy("start").collect()
    assert {r.doc_id for r in got} <= {i for i, _ in texts} and len(got) > 50
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]] and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
