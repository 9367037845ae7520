"""Mixing, tool calls, line dedup, decontamination and weighted sampling."""

import hashlib
import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontam, mixing, weighted
from loomspark.llm.chat import link_tool_calls
from loomspark.llm.linededup import dedup_lines

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id bigint, text string" + extra)


# mixing


def poisson(rate, u):
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing_counts(spark):
    rows = [(i, f"t{i}", "en", "a" if i % 3 else "b", 1) for i in range(300)]
    got = mixing.poisson_mix(spark.createDataFrame(rows, DOCS), weights={"a": 1, "b": 3}, total=600, seed=5).collect()
    n = Counter(r[3] for r in rows)
    rate = {"a": 150 / n["a"], "b": 450 / n["b"]}
    wanted = Counter()
    for r in rows:
        u = int(hashlib.md5(f"5:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        wanted[r[0]] = poisson(rate[r[3]], u)
    assert Counter(r.doc_id for r in got) == +wanted
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys) and len({(r.doc_id, r.replica) for r in got}) == len(got)
    assert 500 < len(got) < 700


def test_large_rates(spark):
    """Distribution functions against sums of exactly computed terms, and one source with a huge rate."""
    df = spark.createDataFrame([(i, "t", "en", s, 1) for i, s in enumerate("aabbbbc")], DOCS)
    for total in (3.0, 70.0, 7e3, 7e5):
        for r in mixing.repetition_rates(df, weights={"a": 0.2, "b": 0.7, "c": 0.1}, total=total).collect():
            p = [math.exp(-r.rate + k * math.log(r.rate) - math.lgamma(k + 1)) for k in range(int(r.rate + 12 * r.rate**0.5 + 21))]
            for j in {0, len(r.cdf) // 3, len(r.cdf) // 2, len(r.cdf) - 1}:
                assert r.cdf[j] == pytest.approx(math.fsum(p[: r.least + j + 1]), abs=1e-9)
            assert len(r.cdf) < 24 * r.rate**0.5 + 44
    one = spark.createDataFrame([(i, "t", "en", "x", 1) for i in range(2)], DOCS)
    n = mixing.poisson_mix(one, total=60_000.0).groupBy("doc_id").count().collect()
    assert all(abs(x["count"] - 30_000) < 6 * 30_000**0.5 for x in n)


def test_mixing_edges(spark):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (None, "", "en", "x", 0), (2, "z", None, "x", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("replica", F.lit("mine")).withColumn("extra", F.lit(1))
    got = mixing.poisson_mix(df, total=400.0).collect()
    assert {r.source for r in got} == {None, "x"} and got[0].extra == 1 and isinstance(got[0].replica, int)
    assert len({r.shuffle_key for r in got if r.doc_id == 1}) * 2 == sum(r.doc_id == 1 for r in got)  # repeated rows alike
    assert mixing.poisson_mix(spark.createDataFrame([], DOCS)).count() == 0
    named = mixing.poisson_mix(df, weights={"x": 1.0}, total=50.0).collect()
    assert {r.source for r in named} == {"x"}


def test_large_rates_do_not_underflow(spark):
    rows = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(20)], DOCS)
    n = mixing.poisson_mix(rows, total=20 * 1000.0, shuffle=False).count()
    assert abs(n - 20_000) < 1000


# tool calls

CALLS = "conv_id bigint, call_id string, seq bigint, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id bigint, call_id string, seq bigint, content string"
SCHEMAS = {"add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "note": {"type": "string"}}, "required": ["a"]}}


def linked(spark, calls, results, extra=False):
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    if extra:
        c, r = c.withColumn("status", F.lit("x")).withColumn("level", F.lit(9)), r.withColumn("json", F.lit("y")).withColumn("name", F.lit("z"))
    return link_tool_calls(c, r, SCHEMAS).collect()


def test_linking_and_order(spark):
    calls = [
        (1, "c", 3, "add", '{"b":1.50, "a": 2}', ["d"]), (1, "d", 5, "add", '{"a":1}', ["e"]), (1, "e", 7, "add", '{"a":0,"note":"é\\n"}', []),
        (2, "x", 1, "add", '{"a":1}', ["y"]), (2, "y", 2, "add", '{"a":1}', ["x"]),
        (3, "n", 1, "add", '{"a":-1,"b":"s"}', ["gone"]), (3, "m", 2, "sub", "{}", []), (3, "o", 3, "add", "not json", []), (3, "q", 4, "add", None, None), (3, "late", 9, "add", '{"a":1}', []),
    ]
    results = [(1, "c", 9, "3"), (1, "c", 10, "later"), (1, "d", 6, "x"), (4, "lost", 1, "r"), (3, "late", 8, "early")]
    got = {(r.conv_id, r.call_id): r for r in linked(spark, calls, results, extra=True)}
    assert [(got[1, k].level, got[1, k].status) for k in "edc"] == [(0, "unanswered"), (1, "ok"), (2, "ok")]
    assert got[1, "c"].json == '{"arguments":{"a":2,"b":1.5},"id":"c","name":"add","result":"3","status":"ok"}'
    assert json.loads(got[1, "e"].json)["arguments"]["note"] == "é\n"
    assert {got[2, k].status for k in "xy"} == {"cycle"}
    assert got[3, "n"].errors == "a: below 0; b: not number; depends_on: no call gone" and got[3, "n"].status == "invalid"
    assert got[3, "m"].errors == "unknown tool" and "not a JSON object" in got[3, "o"].errors + got[3, "q"].errors
    assert got[3, "late"].status == "unanswered" and got[4, "lost"].status == "orphan"


def test_long_chain_out_of_order(spark, monkeypatch):
    from loomspark.llm import chat

    rounds = []
    monkeypatch.setattr(chat, "drop", lambda *tables: rounds.append(len(tables)))
    n = 200
    calls = [(1, f"k{i}", n - i, "add", '{"a":1}', [f"k{j}" for j in (i - 1, i - 2) if j >= 0]) for i in range(n)]
    got = linked(spark, calls, [])
    assert [r.call_id for r in got] == [f"k{i}" for i in range(n)] and [r.level for r in got] == list(range(n))
    assert len(rounds) < 12  # about the logarithm of 200


def brute_levels(calls):
    deps = {c[1]: {d for d in c[5] or []} for c in calls}
    deps = {k: d & set(deps) for k, d in deps.items()}
    level = {}
    while free := [k for k in deps if k not in level and all(d in level for d in deps[k])]:
        level |= {k: max([level[d] + 1 for d in deps[k]], default=0) for k in free}
    return {k: level.get(k, -1) for k in deps}


def test_levels_of_any_graph(spark):
    import random

    r, calls = random.Random(1), []
    for conv in range(30):
        n = r.randrange(1, 14)
        for i in range(n):
            some = [f"c{r.randrange(n + 1)}" if r.random() < 0.15 else f"c{r.randrange(i)}" for _ in range(r.randrange(4)) if i]
            calls.append((conv, f"c{i}", r.randrange(20), "add", '{"a":1}', some))
    calls += [(90, "a", 1, "add", "{}", ["b"]), (90, "b", 1, "add", "{}", ["c"]), (90, "c", 1, "add", "{}", ["a"]), (90, "d", 1, "add", "{}", ["a", "e"]), (90, "e", 1, "add", "{}", None), (90, "s", 1, "add", "{}", ["s"])]
    got = {(x.conv_id, x.call_id): x.level for x in linked(spark, calls, [])}
    for conv in {c[0] for c in calls}:
        for call, level in brute_levels([c for c in calls if c[0] == conv]).items():
            assert got[conv, call] == level, (conv, call)
    assert -1 in got.values() and max(got.values()) > 3


def test_nested_schemas(spark):
    schemas = {"book": {"properties": {"room": {"type": "object", "properties": {"size": {"type": "string", "enum": ["small", "large"]}, "beds": {"type": "integer", "minimum": 1}}, "required": ["size"]}, "days": {"type": "array", "items": {"type": "integer"}}}, "required": ["room"]}}
    rows = ['{"room":{"size":"small","beds":2},"days":[1,2]}', '{"room":{"size":"huge","beds":0},"days":[1,"x"]}', '{"room":{"beds":"two"}}', '{"room":3}', "{}"]
    calls = spark.createDataFrame([(1, f"c{k}", k, "book", x, []) for k, x in enumerate(rows)], CALLS)
    got = [r.errors for r in link_tool_calls(calls, spark.createDataFrame([], RESULTS), schemas).orderBy("seq").collect()]
    assert got == ["", "room.size: not in the list; room.beds: below 1; days: an item is not integer", "room.size: missing; room.beds: not integer", "room: not object", "room: missing"]


def test_repeated_null_and_empty_calls(spark):
    calls = [(1, "a", 2, "add", '{"a":5}', []), (1, "a", 1, "add", '{"a":4}', []), (None, "b", 1, "add", '{"a":4}', []), (1, None, 3, "add", '{"a":4}', None)]
    got = linked(spark, calls, [(None, "b", 2, "r"), (1, "a", 5, None)])
    assert Counter(r.status for r in got) == {"ok": 1, "unanswered": 2, "orphan": 1}
    assert '"a":4' in next(r.json for r in got if r.status == "ok")
    assert linked(spark, [], []) == []


# lines


def brute_lines(rows, long_line=50):
    seen, gone = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone[i] = set()
        for p, line in enumerate(lines):
            if not line.strip():
                continue
            units = [((line, lines[p + 1]), (p, p + 1))] if p + 1 < len(lines) and lines[p + 1].strip() else []
            if len(line.split()) >= long_line:
                units.append(((line,), (p,)))
            if len(lines) == 1 and len(line.split()) < long_line:
                units.append(((line, None, None), (p,)))
            for key, at in units:
                if key in seen:
                    gone[i].update(at)
                seen.add(key)
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in rows}


def test_line_runs(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\ny"), (3, "a\nq\nd"), (4, f"p\n{long}\nq"), (5, f"r\n{long}\n\n{long}"), (6, "z\nz\nz\nz"), (7, "same"), (8, "same"), (9, ""), (10, "\n\n"), (11, "\n\n"), (12, "a\nb\nc\nd"), (13, "b\nc\nd\ne\na\nb")]
    got = {r.doc_id: r.text for r in dedup_lines(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_lines(rows)
    assert got[2] == "x\ny" and got[3] == "a\nq\nd" and got[6] == "z" and got[8] == "" and got[12] == "" and got[10] == "\n\n"


def brute_passages(rows, long_line=50):
    """Windows over the lines that aren't blank; blank lines between two lines of a later window go with them."""
    seen, gone = set(), {}
    for i, t in sorted(rows):
        full = [(p, x) for p, x in enumerate(t.split("\n")) if x.strip()]
        gone[i] = set()
        for k, (p, x) in enumerate(full):
            units = [((x, full[k + 1][1]), range(p, full[k + 1][0] + 1))] if k + 1 < len(full) else []
            if len(x.split()) >= long_line:
                units.append(((x,), [p]))
            elif len(full) == 1:
                units.append(((x, None, None), [p]))
            for key, at in units:
                if key in seen:
                    gone[i].update(at)
                seen.add(key)
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_passages_with_blank_lines(spark, monkeypatch, heavy):
    import random

    from loomspark.llm import linededup

    monkeypatch.setattr(linededup, "HEAVY", heavy)

    r = random.Random(9)
    passage = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(3)]
    rows = [(1, "\n\n".join(["one", *passage, "end"])), (2, "\n\n".join(["two", *passage, "stop"])), (3, "\n \n\n".join(passage)), (4, "only\n"), (5, "\nonly"), (6, "\n\n"), (7, "\n\n")]
    rows += [(10 + i, "\n".join(r.choice(["", " ", *"abcdefg"]) for _ in range(r.randrange(1, 14)))) for i in range(60)]
    got = {x.doc_id: x.text for x in dedup_lines(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_passages(rows)
    assert got[2] == "two\n\n\nstop" and got[3] == "" and got[5] == "" and got[7] == "\n\n"


def test_winnowing_selects_window_minima(spark):
    import hashlib
    import random

    from loomspark.llm import linededup

    r = random.Random(3)
    rows = [(i, "\n".join(r.choice("abcdefghijk") for _ in range(r.randrange(2, 60)))) for i in range(40)]
    got = linededup.winnowed_lines(docs(spark, rows), 50).collect()
    places = {(x.doc_id, x.pos) for x in got}
    assert len(places) == len(got) < 0.75 * sum(t.count("\n") for _, t in rows)  # fewer than pairs of neighbours
    for i, t in rows:
        h = [hashlib.md5(x.encode()).digest() for x in t.split("\n")]
        chosen = {k + 1 if h[k + 1] <= h[k] else k for k in range(len(h) - 1)}
        assert {p for d, p in places if d == i} == chosen


def test_line_edges(spark):
    rows = [(None, "a\nb"), (1, None), (2, "a\nb"), (2, "a\nb"), (3, "a\nb")]
    df = docs(spark, rows).withColumn("n_lines", F.lit("mine")).withColumn("pos", F.lit(1)).withColumn("first", F.lit(1))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, "a\nb", 2, 0), (1, None, 0, 0), (2, "a\nb", 2, 0), (2, "a\nb", 2, 0), (3, "", 2, 2)], key=str)
    assert dedup_lines(docs(spark, [])).count() == 0


def test_random_lines(spark):
    import random

    r = random.Random(3)
    rows = [(i, "\n".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 12)))) for i in range(60)]
    assert {x.doc_id: x.text for x in dedup_lines(docs(spark, rows)).collect()} == brute_lines(rows)


# benchmark items


def grams(t, n=5):
    w = re.sub(r"[\W_]+", " ", t.lower()).split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_containment(spark):
    import random

    r = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate((3, 5, 6, 9, 12, 20, 33, 60, 100, 200))]
    items += [(50, ""), (51, None), (52, items[4][1])]
    texts = []
    for k, (_, t) in enumerate(items[:10]):
        w = t.split()
        for edits in (0, 1, 2, 5):
            v = w.copy()
            for _ in range(edits):
                v[r.randrange(len(v))] = "edited"
            texts.append((len(texts), " ".join([r.choice(words) for _ in range(300)] + v + [r.choice(words) for _ in range(3000)]).upper()))
        texts.append((len(texts), t + "!"))
    texts += [(900, None), (901, ""), (902, texts[0][1]), (None, texts[0][1])]
    got = {(x.doc_id, x.item_id): (x.n_shingles, x.n_found) for x in decontam.contained_items(docs(spark, texts).withColumn("n", F.lit(1)).withColumn("hash", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    wanted = {}
    for i, t in texts:
        for k, q in items:
            a, b = grams(q or ""), grams(t or "")
            if i is not None and a and len(a & b) >= 0.8 * len(a):
                wanted[i, k] = (len(a), len(a & b))
    assert got == wanted and len(wanted) > 20


def test_sketches_are_long_enough(spark):
    for n in (1, 2, 3, 7, 8, 40, 100):
        df = spark.createDataFrame([(1, [str(k) for k in range(n)], n)], "item_id bigint, shingles array<string>, n int")
        assert decontam.item_sketches(df, 0.8).count() >= n - math.ceil(0.8 * n) + 1


def test_decontaminated_documents(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    rows = [(1, "x one two three four five six y"), (2, "clean"), (3, None), (None, "z")]
    got = decontam.decontaminate(docs(spark, rows).withColumn("item_id", F.lit(7)), bench)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "3", "None"] and got.columns == ["doc_id", "text", "item_id"]
    assert decontam.decontaminate(docs(spark, rows), bench.limit(0)).count() == 4
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0


# weighted sampling


def likeness(a, b):
    a, b = (Counter(w for w in re.split(r"[\W_]+", t.lower()) if w) for t in (a, b))
    u = sum((a | b).values())
    return sum((a & b).values()) / u if u else 1.0


def test_fingerprints(spark):
    import random

    r = random.Random(2)
    words = [f"{x}{y}" for x in "abcdefghij" for y in "klmnopqrst"]
    rows = [(7 * k, " ".join(r.choice(words[: 20 + k]) for _ in range(r.randrange(1, 400)))) for k in range(80)]
    rows += [(1000, "ÉÉ é!"), (1001, "ÉÉ é!"), (1002, ""), (1003, None), (1004, "..."), (1005, "x")]
    got = {x.doc_id: x for x in weighted.edited_fingerprints(docs(spark, rows).withColumn("n", F.lit(0)).withColumn("term", F.lit(0)).repartition(4)).collect()}
    rows, off, near = sorted(rows), [], []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and len(x.fingerprint) == 4 * weighted.SAMPLES
        off.append(x.near_edited - likeness(t, e))
        near.append(x.near_next - likeness(t, nxt))
    for errors in (off, near):
        assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.3
    assert got[1000].fingerprint == got[1001].fingerprint and got[1000].near_next == 1.0
    assert got[1002].fingerprint == got[1003].fingerprint == got[1004].fingerprint == "ffff" * weighted.SAMPLES
    assert got[1002].near_next == 1.0 and got[1004].near_next == 0.0


def test_fingerprint_edges(spark):
    assert weighted.edited_fingerprints(docs(spark, [])).count() == 0
    one = weighted.edited_fingerprints(docs(spark, [(5, "abcd efgh")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd " + b"abcd").hexdigest()
    got = weighted.edited_fingerprints(docs(spark, [(1, "b"), (1, "a"), (1, "a"), (None, "x"), (2, "c " * 50_000)])).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == [(1, 1), (2, 100_000)]


def test_bound_loses_no_sample(spark, monkeypatch):
    rows = [(k, " ".join(f"w{j % (k + 3)}" for j in range(30 * k + 1))) for k in range(12)]
    short = {r.doc_id: r.fingerprint for r in weighted.edited_fingerprints(docs(spark, rows)).collect()}
    monkeypatch.setattr(weighted, "ENOUGH", 1e12)
    assert short == {r.doc_id: r.fingerprint for r in weighted.edited_fingerprints(docs(spark, rows)).collect()}
