"""Quality, toxicity, HTML extraction, token files, SimHash and the pipeline."""

import itertools
import os
import pickle
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomspark.llm import html, quality, simhash, tokens, toxicity
from loomspark.llm.components import components
from loomspark.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def prose(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


WORDS = [a + b + c for a in "bdgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]

# quality


@pytest.mark.parametrize("piece", [4096, 3])
def test_gradients(monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE", piece)  # with 3 the long text is in several pieces
    r = np.random.default_rng(0)
    net = quality.Network(1)
    net.embed, net.first, net.second = net.embed.astype(np.float64), net.first.astype(np.float64), net.second.astype(np.float64)
    net.bias, net.base, net.out = r.normal(0, 0.1, quality.FILTERS), np.zeros(1), r.normal(0, 1, 2 * quality.FILTERS)
    texts, labels = [bytes(r.integers(32, 127, n, dtype=np.uint8)) for n in (5, 300, 900)], np.array([1.0, 0.0, 1.0])

    def loss():
        z = np.array([net.logit(net.forward(net.blocks(t))) for t in texts])
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    g = net.gradients(texts, labels)
    for name in net.NAMES:
        w = getattr(net, name)
        for at in [tuple(r.integers(0, s) for s in w.shape) for _ in range(6)] + [np.unravel_index(np.abs(g[name]).argmax(), w.shape)]:
            kept, h = w[at], 1e-5
            w[at] = kept + h
            up = loss()
            w[at] = kept - h
            down = loss()
            w[at] = kept
            assert (up - down) / (2 * h) == pytest.approx(g[name][at], abs=2e-4)


def test_every_byte_counts():
    net = quality.Network(3)
    net.out += 1
    text = b"a" * 40_000
    other = text[:30_000] + bytes(range(1, 200)) + text[30_199:]
    assert not np.allclose(net.features(text), net.features(other))
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 4095, 4096, 4097, 4098, 5000):
        long = bytes(r.integers(32, 127, n * quality.HALF * quality.STEP + n % 3, dtype=np.uint8))
        assert np.allclose(net.features(long), net.forward(net.blocks(long)), atol=1e-4)
        assert net.pooled(net.passes(long))[1] == max(2, -(-len(long) // (quality.STEP * quality.HALF))) - 1


def slow_score(net, text):
    """One place, filter and chunk at a time, from the definition."""
    raw = text.encode("utf-8", "replace")
    halves = max(2, -(-len(raw) // 128))
    raw = raw.ljust(halves * 128 + 8, b"\0")
    weights = np.concatenate([net.first, net.second]).astype(np.float64)
    values = [max(0.0, *(np.concatenate([net.embed[b] for b in raw[at : at + 16]]).astype(np.float64) @ weights[:, f] + net.bias[f] for at in range(c * 128, c * 128 + 256, 8))) for c in range(halves - 1) for f in range(quality.FILTERS)]
    values = np.array(values).reshape(-1, quality.FILTERS)
    return 1 / (1 + np.exp(-(np.concatenate([values.mean(0), values.max(0)]) @ net.out + net.base[0])))


def test_quality_learns(spark):
    r = random.Random(0)
    rows = [(i, prose(r, 60, WORDS) if i % 3 else prose(r, 60, WORDS).upper() + "!!!") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id bigint, quality int")
    net = quality.fit(docs(spark, rows), labels)
    df = docs(spark, rows + [(400, None), (401, ""), (402, "word " * 100_000)]).withColumn("score", F.lit("mine"))
    got = {x.doc_id: x.score for x in quality.score(df, net).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in range(300, 400)]) > 0.95
    assert got[400] == got[401] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(docs(spark, []), net).count() == 0


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score(docs(spark, [(1, "x")]), quality.fit(docs(spark, [(1, "x")]), none)).first().score == 0.5
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert quality.fit(docs(spark, [(1, "x")]), one).score("any") > 0.7


# toxicity


def labelled(spark, n=500):
    r = random.Random(1)
    rows, y = [], []
    for i in range(n):
        w = prose(r, 80, WORDS).split()
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vileword", "nastything", "fouled", "fouling"]))
        rows.append((i, " ".join(w)))
        y.append((i, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(y, "doc_id bigint, toxic int"), dict(rows), dict(y)


def test_toxicity(spark):
    df, labels, texts, y = labelled(spark)
    index = toxicity.fit(df, labels.where("doc_id < 400"))
    assert index.idf[index.terms["vileword"]] > 5 * index.idf[index.terms[texts[0].split()[0]]] and "^foule" in index.terms
    assert set(index.terms) == {t for i in range(400) for t in toxicity.term_counts(texts[i])} and len(index.ids) == 400
    got = {r.doc_id: r for r in toxicity.score(df.withColumn("score", F.lit(9)).withColumn("evidence", F.lit(9)), index).collect()}
    held = range(400, 500)
    assert np.mean([(got[i].score >= 0.7) == y[i] for i in held]) > 0.97
    assert all(e.label == y[e.doc_id] and 0 < e.cosine <= 1.0001 for e in got[401].evidence) and got[400].evidence[0].label == 1
    assert max(got[i].score for i in held if not y[i]) < 0.3
    assert len({tuple(e.doc_id for e in got[i].evidence) for i in held}) == 100  # each text has evidence of its own


def brute_cosines(index, text):
    """Cosines with every example over full vectors, by the examples' places."""
    vector = lambda c: {t: (1 + np.log(n)) * index.idf[index.terms[t]] for t, n in c.items() if t in index.terms}
    q = vector(toxicity.term_counts(text))
    out = []
    for c in index.examples:
        v = vector(c)
        norm = np.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in q.values()))
        out.append(sum(x * v.get(t, 0.0) for t, x in q.items()) / (norm or 1.0))
    return np.array(out)


def hold_against_brute_force(index, counts, texts):
    index.examples = [counts[int(i)] for i in index.ids]
    for text in texts:
        every = brute_cosines(index, text)
        places, cosines = index.nearest(*index.vector(index.counts(text)))
        best = np.sort(every[every > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(cosines, best, atol=1e-9) and np.allclose(every[places], cosines, atol=1e-9) and len(set(places.tolist())) == len(places)


def test_search_is_exact(monkeypatch):
    r = random.Random(0)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    vocabulary = WORDS[:150]
    texts = {i: " ".join(r.choices(vocabulary, range(1, 151), k=r.randrange(1, 30))) for i in range(500)}
    texts |= {500: "", 501: texts[3], 502: texts[3]}
    counts = {i: toxicity.term_counts(t) for i, t in texts.items()}
    index = toxicity.Index({t: r.random() + 0.1 for t in sorted(set().union(*counts.values()))}, [(i, c, r.randrange(2)) for i, c in counts.items()], 0.1)
    hold_against_brute_force(index, counts, [*r.sample([*texts.values()], 60), "", "unknown words", texts[3]])


def test_short_lists_give_the_same_as_blocks(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    texts = [" ".join(r.choices(WORDS[:150], range(1, 151), k=r.randrange(1, 30))) for _ in range(300)] + ["", "unknown"]
    texts += texts[:40]  # equals, in order of doc_id
    counts = [toxicity.term_counts(t) for t in texts]
    index = toxicity.Index({t: r.random() + 0.1 for t in sorted(set().union(*counts))}, [(i, c, r.randrange(2)) for i, c in enumerate(counts)], 0.1)
    found = []
    for direct in (0, 1 << 30):
        monkeypatch.setattr(toxicity, "DIRECT", direct, raising=True)
        found.append([(p.tolist(), c.tolist()) for t in texts for p, c in [index.nearest(*index.vector(index.counts(t)), without=[3, 7])]])
    assert found[0] == found[1]


def test_workers_give_memory_back(monkeypatch):
    from loomspark.llm import common

    calls = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
    assert common.held("key", lambda: 5) == 5 and common.held("key") == 5 and common.held() is None and len(calls) == 3


def test_document_frequencies_cover_all(spark):
    df, _, texts, _ = labelled(spark, 120)
    odd = ["İstanbul Straße ª²x_y 12ab3cd", "ǅungla ΣΑΣ vileword vileword", None]
    df = df.unionByName(docs(spark, [(1000 + k, t) for k, t in enumerate(odd)]))
    lowered = [r.t or "" for r in df.select(F.lower("text").alias("t")).collect()]
    every = [set(toxicity.term_counts(t)) for t in lowered]
    terms = sorted(set().union(*every)) + ["absent"]
    n, found = toxicity.document_frequencies(df.repartition(5), terms)
    assert n == 123 and found.tolist() == [sum(t in e for e in every) for t in terms]


def test_sample_is_bounded(spark):
    df = docs(spark, [(i, "é" * 50) for i in range(20)] + [(3, "a"), (None, "x"), (30, None)])
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(5, None)], "doc_id bigint, toxic int")
    got = toxicity.labelled_sample(df, labels, "toxic")
    assert len(got) == 21 and dict((i, t) for i, t, _ in got)[3] == "a" and got[-1][:2] == (30, "")
    assert len(toxicity.labelled_sample(df, labels, "toxic", rows=7)) <= 7
    assert sum(len(t.encode()) for _, t, _ in toxicity.labelled_sample(df, labels, "toxic", size=450)) <= 450


def test_toxicity_scores_in_workers(monkeypatch):
    r = random.Random(15)
    texts = [prose(r, 60, WORDS + ["vileword", "other1words", "straße"]) for _ in range(150)] + ["", "unknownword", "other1words words"]
    counts = [toxicity.term_counts(t) for t in texts[:100]]
    index = toxicity.Index({t: r.random() + 0.1 for t in sorted(set().union(*counts))}, [(i, c, r.randrange(2)) for i, c in enumerate(counts)], 0.1)
    sent = pickle.loads(pickle.dumps(index))
    monkeypatch.setattr(toxicity, "xxh64_intdigest", lambda *_: pytest.fail("a text's terms are hashed"))
    assert sent.terms == index.terms
    for t, (s, places, cosines) in zip(texts, sent.scores(texts), strict=True):
        known = {index.terms[x]: n for x, n in toxicity.term_counts(t).items() if x in index.terms}
        at, tf = sent.counts(t)
        assert dict(zip(at.tolist(), tf.tolist(), strict=True)) == known
        one = index.score(t)
        assert s == one[0] and places.tolist() == one[1].tolist() and cosines.tolist() == one[2].tolist()
    none = pickle.loads(pickle.dumps(toxicity.Index({}, [], 0.1)))
    assert none.terms == {} and none.scores(["vileword", ""])[0][0] == 0.1


def test_toxicity_edges(spark):
    df, labels, _, _ = labelled(spark, 100)
    none = toxicity.fit(df, labels.limit(0))
    got = toxicity.score(docs(spark, [(None, None), (1, ""), (1, ""), (2, "vileword " * 100_000)]), none).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and got[0].evidence == []
    assert toxicity.score(docs(spark, []), none).count() == 0
    assert toxicity.fit(docs(spark, []), labels).score("x")[0] < 0.7
    one = toxicity.fit(df, labels.where("toxic = 1"))
    assert one.score("any words")[0] > 0.7


# html


def cut_cost(net, labels):
    """What a labelling of the network's nodes costs, and its edges."""
    chained = list(zip(net.leaves, net.leaves[1:], [net.chain[k] for k in net.leaves[1:]]))
    edges = [(k, net.parents[k], net.pulls[k]) for k in range(1, len(net.parents))] + chained
    return sum(c if c > 0 and not x else -c if c < 0 and x else 0 for c, x in zip(net.costs, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b]), edges


def maximum_flow(net):
    """By augmenting paths between two terminals."""
    n, room = len(net.costs), {}
    for k, c in enumerate(net.costs):
        room[(n, k) if c > 0 else (k, n + 1)] = abs(c)
    for a, b, w in cut_cost(net, [False] * n)[1]:
        room[a, b] = room.get((a, b), 0) + w
        room[b, a] = room.get((b, a), 0) + w
    flow = 0.0
    while True:
        came, queue = {n: None}, [n]
        for a in queue:
            for (x, y), w in room.items():
                if x == a and w > 1e-12 and y not in came:
                    came[y] = a
                    queue.append(y)
        if n + 1 not in came:
            return flow
        path, b = [], n + 1
        while came[b] is not None:
            path.append((came[b], b))
            b = came[b]
        least = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= least
            room[b, a] = room.get((b, a), 0) + least
        flow += least


def random_network(r, n):
    net, open_ = html.Network([-1], [r.uniform(-2, 2)], [0.0], [-1.0], []), [0]
    while len(net.parents) < n:
        while len(open_) > 1 and r.random() < 0.4 and net.parents[-1] != open_[-1] - 0 and any(p == open_[-1] for p in net.parents):
            open_.pop()
        leaf = r.random() < 0.6
        net.parents.append(open_[-1])
        net.costs.append(r.choice([0.0, r.uniform(-3, 3)]))
        net.pulls.append(r.uniform(0, 2))
        net.chain.append(-1.0 if not leaf else r.uniform(0, 2) if net.leaves else 0.0)
        if leaf:
            net.leaves.append(len(net.parents) - 1)
        else:
            open_.append(len(net.parents) - 1)
    for k in range(n - 1, 0, -1):  # each element has a leaf
        if net.chain[k] < 0 and k not in net.parents:
            net.chain[k] = 0.5
            net.leaves = sorted([*net.leaves, k])
    if net.leaves:
        net.chain[net.leaves[0]] = 0.0
    return net


def test_minimum_cut_is_minimal():
    r = random.Random(0)
    for _ in range(200):
        net = random_network(r, r.randrange(1, 11))
        best = min(cut_cost(net, x)[0] for x in itertools.product([False, True], repeat=len(net.costs)))
        assert cut_cost(net, html.minimum_cut(net))[0] == pytest.approx(best) == pytest.approx(maximum_flow(net))
    for n in (40, 90):
        net = random_network(r, n)
        assert cut_cost(net, html.minimum_cut(net))[0] == pytest.approx(maximum_flow(net))


def test_cuts_of_pages():
    """Networks of real blocks, most of which say nothing, against a maximum flow."""
    r = random.Random(4)
    for _ in range(40):
        parts = [r.choice(["<p>Some words, and more of them here.", "<li><a href=x>Go</a>", "<div>", "</div>", "text ", "<ul>", "</ul>", '<div class="ad">', "<article>", "</article>", "<nav>", "</nav>", "<h2>Head</h2>"]) for _ in range(r.randrange(1, 25))]
        blocks, elements = html.blocks_of("".join(parts))
        net = html.network(blocks, elements, (html.features(blocks) @ html.PLAIN_WEIGHTS).tolist())
        assert len(net.leaves) == len(blocks)
        assert cut_cost(net, html.minimum_cut(net))[0] == pytest.approx(maximum_flow(net), abs=1e-9)


@pytest.mark.parametrize("frame", ['<div class="layout sidebar-right"><article>{}</article></div>', '<div class="content has-sidebar">{}</div>', '<div id="page" class="no-banner">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="post"><div class="sidebar">Short links</div>{}</div>'])
def test_frames_keep_their_text(frame):
    article, text = "<h1>Title</h1><p>A long sentence stands here, with some words.</p><p>More of it.</p>", "Title A long sentence stands here, with some words. More of it."
    if "article" in frame or "content" in frame or "post" in frame:  # a short list alone looks like a menu
        article, text = article + "<ul><li>One</li><li>Two</li></ul>", text + " One Two"
    assert html.main_text(f"<html><body>{frame.format(article)}</body></html>") == text


def test_boilerplate_of_all_kinds():
    sentence = "This is a whole sentence, as long as those of an article, with words in it."
    outside = [f'<div class="{c}"><p>{sentence}</p></div>' for c in ("sidebar", "ad", "cookie-notice", "post-comments", "newsletter-signup", "related-posts")]
    outside += [f"<{e}><p>{sentence}</p></{e}>" for e in ("nav", "aside", "footer", "header", "form", "dialog")] + [f"<div>{sentence}</div>", f'<ol class="comment-list"><li><article class="comment-body"><p>{sentence}</p><p>{sentence}</p></article></li></ol>']
    for part in outside:
        assert html.main_text(f"<body>{part}<main><h1>Title</h1><p>{sentence}</p></main>{part}</body>") == f"Title {sentence}", part
        assert html.main_text(f"<body><article><h1>Title</h1><p>{sentence}</p></article>{part}</body>") == f"Title {sentence}", part
    for part in outside[:-2]:
        assert html.main_text(f"<body><article><h1>Title</h1><p>{sentence}</p>{part.replace('<header>', '<aside>').replace('</header>', '</aside>')}<p>{sentence}</p></article></body>") == f"Title {sentence} {sentence}", part


def test_broken_and_long_pages():
    began = time.perf_counter()
    for n in (18, 1000, 50_000):
        for broken in ("<a " + '"y"' * n + " < end", '<a "' * n + " < end", '<a b="' * n + " < end", "<a b='x\"" * n, "<!-" * n, "<" * n, "</" * n, "<script>" * n, "</span>" * n):
            assert html.main_text("<article><p>Kept text, that is whole.</p></article>" + broken).startswith("Kept text, that is whole.")
    assert html.main_text("<div>x" * 20_000 + "</i></div>" * 20_000) == "" == html.main_text("<p>" * 50_000)
    long = "<article>" + "<p>Words of a sentence, with more of them.</p><div>no</div>" * 20_000 + "</article>"
    assert html.main_text(long).count("Words of a sentence") == 20_000
    assert time.perf_counter() - began < 30


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="nav-open"><header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div id="cookie-notice">We use cookies.</div><!-- <p>hidden</p> --><div class="ad">Buy now.</div>
<article><header><h1>Head&shy;line</h1></header><p>First <b>bold</b>text &lt;x&gt;&nbsp;y.<br>After   break
<p>Second paragraph, unclosed, with a <a href=x>link</a> in it. <div class='advert'>Advert inside.</div>
<ul><li>One<li>Two</ul><form>Name <input value=">"> <button>Send</button></form><p style="display: none">Unseen</p>
<table><tr><td>c1<td>c2</table></article><aside>Side</aside><section class="post-comments"><p>A reader says: this is a comment, and a long one.</p></section>
<noscript>No script</noscript><footer>&copy; F</footer></body></html><a hr"""


def test_main_text():
    assert html.main_text(PAGE) == "Head­line First boldtext <x> y. After break Second paragraph, unclosed, with a link in it. One Two c1 c2"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == ""


def test_pages_without_named_parts():
    body = "".join(f"<p>{'A long sentence of an article, with words and stops in it. ' * 5}</p>" for _ in range(4))
    links = "".join(f"<li><a href=/{k}>Go {k}</a></li>" for k in range(8))
    text = html.main_text(f"<html><body><ul>{links}</ul><div>{body}</div><ul>{links}</ul></body></html>")
    assert text.count("A long sentence") == 20 and "Go 3" not in text


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (None, "w", "<p>"), (1, "u", PAGE), (4, "x", "<div>" * 5000 + "deep")], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = html.extract(pages, html.fit(pages)).collect()
    assert got[3].text == html.main_text(PAGE, html.fit(pages))
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and len(got) == 5 and got[0].text == got[3].text != ""
    assert html.extract(pages.limit(0), html.fit(pages.limit(0))).count() == 0


# token files

ODD = ["", "a", " a", "a ", "a  b", "\n", "a \n b", "x\n\ny z", "it's  we'll 've", " 's", "é ñ\t d", "　 a b", "a  b", "<|endoftext|> a b", "1 2 3²", "\x1c a b\x00 c", "_a __b c_d", "日本 語 です", "a\n\n\nb c", "  a", "a,b.c;;d 12ab34 _x_ ,. \n\t", "ª º µ × ÷", "a\r\nb\x0bc\x0c", "\x85 x", "😀 ok", " <|endoftext|> hello", "a<|endoftext|><|endoftext|>", "<|endoftext"]


def thue_morse(n, turned):
    """A word of 2 ** n letters; it and its opposite have the same polynomial hash modulo 2^64, whatever the base."""
    return "".join("ab"[(k.bit_count() + turned) % 2] for k in range(1 << n))


ODD += [f"{thue_morse(n, a)} x {thue_morse(n, 1 - a)}" for n in (3, 10, 11, 12) for a in (0, 1)] + [thue_morse(11, 0), thue_morse(11, 1)]


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_library(model, monkeypatch):
    r = random.Random(0)
    texts = ODD + ["".join(r.choice("ab éß1,.!' \n\t_-ñ") for _ in range(r.randrange(60))) for _ in range(400)] + ["word " * 60_000]
    wanted = [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
    e = tokens.Encoder(tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == wanted
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)  # forgets at every call
    assert [x.tolist() for x in e.encode(texts)] == wanted


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (3, 300), (1000, 5), (70_000, 70_000), (4097, 20_000_000)])
def test_coding_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    ranked, control, data = tokens.pack(ids)
    assert tokens.unpack(ranked, control, data, n).tolist() == ids.tolist()
    assert len(control) == -(-n // 4)
    names = np.frombuffer(ranked, "<u4")
    counts = np.bincount(ids)[names] if n else np.zeros(0)
    assert (np.diff(counts) <= 0).all()


def test_files(spark, tmp_path, model, monkeypatch):
    r = random.Random(4)
    rows = [(r.randrange(-50, 1000), prose(r, r.randrange(200), WORDS)) for _ in range(150)] + [(7, "same"), (7, "same"), (2000, None), (2001, ""), (2002, "long " * 40_000)]
    df = docs(spark, rows).withColumn("part", F.lit(1)).withColumn("block", F.lit(2)).repartition(6)
    monkeypatch.setattr(tokens, "BLOCK_IDS", 500)
    tokens.write_tokens(df, str(tmp_path / "t"), tokenizer_path(), end_id=0)
    got = tokens.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()
    got.sort(key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted(i for i, _ in rows)
    at, by = 0, {}
    for i, t in rows:
        by.setdefault(i, []).append([*model.encode(t or "", add_special_tokens=False).ids, 0])
    for x in got:
        assert x.start == at and x.n_tokens == len(x.ids) and x.ids in by[x.doc_id]
        by[x.doc_id].remove(x.ids)
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        at += x.n_tokens


def test_no_documents(spark, tmp_path):
    tokens.write_tokens(docs(spark, []), str(tmp_path / "t"), tokenizer_path())
    assert tokens.read_tokens(spark, str(tmp_path / "t")).count() == 0
    tokens.write_tokens(docs(spark, [(None, "a"), (3, "b")]), str(tmp_path / "n"), tokenizer_path())
    got = tokens.read_tokens(spark, str(tmp_path / "n")).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None, 3]
    tokens.write_tokens(docs(spark, [(None, "a"), (2**60 + 1, "b"), (None, "c"), (2**60 + 3, None)]).coalesce(1), str(tmp_path / "l"), tokenizer_path())
    assert [x.doc_id for x in tokens.read_tokens(spark, str(tmp_path / "l")).orderBy("start").collect()] == [None, None, 2**60 + 1, 2**60 + 3]


def test_equal_hashes(model, monkeypatch):
    monkeypatch.setattr(tokens, "_powers", lambda base, n: np.ones(n, np.uint64))  # pieces of the same letters meet
    r = random.Random(2)
    texts = ["".join(r.choice("abcd .1") for _ in range(r.randrange(80))) for _ in range(300)]
    e = tokens.Encoder(tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
    assert e.clashing


# SimHash


def brute_hash(t):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))) if x]
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_bits():
    r = random.Random(0)
    for t in [None, "", " \t\n", "One", "A B", "É x y", *(prose(r, n, WORDS).title() for n in (3, 4, 7, 300, 2000))]:
        assert simhash.simhash(t) & 0xFFFFFFFFFFFFFFFF == brute_hash(t)


def test_golay_code_is_perfect():
    errors = simhash.golay_errors()
    assert {len(set(x)) for x in errors.tolist()} == {1, 6}
    assert max(bin(x).count("1") for x in errors.ravel().tolist()) == 4
    w = np.random.default_rng(0).integers(0, 1 << 23, 20_000)
    keys = simhash.golay_keys(w)
    for a, b in [(0, 0), (0, 3), (5, 22), (11, 12)]:
        other = simhash.golay_keys(w ^ (1 << a) ^ ((1 << b) if a != b else 0))
        assert (keys[:, :, None] == other[:, None, :]).any((1, 2)).all()


def test_keys_meet_within_two_bits():
    x = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    keys = simhash.fuzzy_keys(x)
    for a, b in itertools.combinations(range(64), 2):
        other = simhash.fuzzy_keys(x[:20] ^ np.uint64(1 << a) ^ np.uint64(1 << b))
        assert (keys[:20, :, None] == other[:, None, :]).any((1, 2)).all()


@pytest.mark.parametrize("pairwise", [2, 32])
def test_near_groups(spark, monkeypatch, pairwise):
    r = random.Random(5)
    base = [prose(r, 200, WORDS) for _ in range(15)]
    rows = []
    for k, t in enumerate(base):
        rows += [(k * 100 + j, t if j < 3 else " ".join([*t.split()[: 199 - j % 4], "z" * j])) for j in range(25)]
    rows += [(9000, None), (9001, ""), (9002, " "), (None, base[0]), (9003, base[1].upper()), (1, "other")]
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    got = simhash.near_groups(docs(spark, rows).withColumn("fp", F.lit(0)).withColumn("root", F.lit(0)).repartition(4)).collect()
    prints = [(i, brute_hash(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
            parent[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    wanted = sorted((str(i), p, least[find(k)]) for k, (i, p) in enumerate(prints))
    assert sorted((str(x.doc_id), x.fp & 0xFFFFFFFFFFFFFFFF, x.component_id) for x in got) == wanted
    assert len(set(least.values())) < 200


def test_no_texts(spark):
    assert simhash.near_groups(docs(spark, [])).count() == 0
    assert simhash.near_copies(docs(spark, [])).count() == 0
    assert simhash.near_groups(docs(spark, [(None, "a b c")])).first().component_id is None


def test_components(spark):
    r = random.Random(0)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    group = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
            if x is not y:
                x |= y
                for k in y:
                    group[k] = x
    assert got == {k: min(g) for k, g in group.items()}


def edited(r, t, n):
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


def test_near_copies(spark):
    r = random.Random(6)
    rows, k = [], 0
    for n in (30, 60, 150, 400, 900):
        for _ in range(8):
            t = prose(r, n, WORDS)
            for e in (0, 0, n // 150, n // 70, n // 20):
                rows.append((k, edited(r, t, e)))
                k += 1
    passage = prose(r, 60, WORDS)
    rows += [(k + j, prose(r, 100, WORDS) + " " + passage) for j in range(60)]  # one passage in common makes no copies
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (5002, rows[0][1])]
    got = {x.doc_id: x.root for x in simhash.near_copies(docs(spark, rows).repartition(4)).collect()}
    texts = {i: t or "" for i, t in rows if i is not None}
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(find(i) == find(root) for i, root in got.items())  # nothing else is joined
    assert np.mean([got[a] == got[b] for a, b in links]) > 0.97 and len(links) > 80


def brute_roots(rows):
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_large_groups_without_their_original_first(spark):
    r = random.Random(11)
    rows = []
    for g in range(3):  # the original in the middle, copies less alike than 0.8 to each other
        t = prose(r, 400, WORDS)
        rows += [(1000 * g + k, t if k == 30 else edited(r, t, 7)) for k in range(60)]
    w = prose(r, 300, WORDS).split()
    for k in range(50):  # a chain of drifting versions, out of order
        rows.append((5000 + 17 * k % 50, " ".join(w)))
        for _ in range(4):
            w[r.randrange(300)] = f"drift{r.randrange(10**6)}"
    passage = prose(r, 60, WORDS)
    rows += [(9000 + j, prose(r, 100, WORDS) + " " + passage) for j in range(40)]
    got = {x.doc_id: x.root for x in simhash.near_copies(docs(spark, rows).repartition(4)).collect()}
    wanted = brute_roots(rows)
    assert got == wanted and len(set(wanted.values())) < 100


def test_texts_that_barely_miss_a_large_group_are_not_paired_with_it(spark, monkeypatch):
    r = random.Random(12)
    words = prose(r, 400, WORDS).split()
    rows = [(k, edited(r, " ".join(words), 7)) for k in range(80)]  # 35 of 396 shingles: linked to the original alone
    rows[40] = (40, " ".join(words))
    for k in range(80, 110):  # 13 edits of the same words in fives: about 0.75 like the original
        new = list(words)
        for at in range(3, 400, 31):
            new[at] = f"edit{k % 6 if at > 100 else k}x{at}"
        rows.append((k, " ".join(new)))
    tested = []
    whole = simhash.connect

    def counted(keyed, links, verify):
        def seen(pairs):
            tested.append(pairs.count())
            return verify(pairs)

        return whole(keyed, links, seen)

    monkeypatch.setattr(simhash, "connect", counted)
    got = {x.doc_id: x.root for x in simhash.near_copies(docs(spark, rows).repartition(4)).collect()}
    wanted = brute_roots(rows)
    assert got == wanted and 3 < len(set(wanted.values()))
    assert sum(tested) < 300


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (4, ""), (5, "other words here")]
    df = docs(spark, rows).withColumn("root", F.lit(1)).withColumn("text_hash", F.lit(1))
    got = simhash.drop_near_copies(df)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "5", "None"] and got.columns == df.columns


# pipeline


def test_pipeline(spark, tmp_path, model):
    import corpus_pipeline

    r = random.Random(8)
    item = prose(r, 40, WORDS)
    rows, y = [], []
    for i in range(300):
        toxic = i % 6 == 0
        t = prose(r, 120, WORDS) + (" vileword nastything vileword" if toxic else "")
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        y.append((i, 1, int(toxic)))
    for k, i in enumerate((1, 2, 3)):
        rows.append((400 + k, rows[i][1], "en", "s0", 1))  # exact copies
        rows.append((410 + k, edited(r, rows[i][1], 1), "en", "s1", 1))  # near copies
        rows.append((420 + k, prose(r, 200, WORDS) + " " + item.upper() + " " + prose(r, 90, WORDS), "en", "s2", 1))
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(y, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    assert [f for _, f in corpus_pipeline.STAGES][0] is corpus_pipeline.drop_toxic and len(corpus_pipeline.STAGES) == 5
    now, ids = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        ids.append({x.doc_id for x in now.select("doc_id").collect()})
    after_toxic, after_copies, after_items, _ = ids
    assert after_toxic == {x[0] for x in rows if not (x[0] < 300 and x[0] % 6 == 0)}
    assert after_toxic - after_copies == {400, 401, 402, 410, 411, 412, 501}
    assert after_copies - after_items == {420, 421, 422}
    wanted = sorted((x.doc_id, len(model.encode(x.text or "", add_special_tokens=False).ids) + 1) for x in now.collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((x.doc_id, x.n_tokens) for x in got) == wanted
    assert sorted(x.start for x in got)[0] == 0 and max(x.start + x.n_tokens for x in got) == sum(x.n_tokens for x in got)


# registered queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_registered_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from loomspark.llm.queries import ORACLES, QUERIES

    assert set(QUERIES) <= set(entry.queries()) and {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {q.split("_")[0] for q in QUERIES}
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    show = lambda df: sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    for name, sql in ORACLES.items():
        assert show(QUERIES[name](spark, SF).toPandas()) == show(db.sql(sql).df()), name
