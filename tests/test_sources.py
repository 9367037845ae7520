import numpy as np
import pytest

from loomspark import cli
from loomspark.operators import oplog
from loomspark.sources import files, points, text, values
from loomspark.streaming import counts


def test_lines_and_tsv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three\n")
    both = text.read_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    assert sorted(r.value for r in both.collect()) == ["one", "three", "two"]
    assert sorted(text.iterate_lines(spark, str(tmp_path / "a.txt"))) == ["one", "two"]
    out = str(tmp_path / "out")
    for n in (3, 4):
        text.write_tsv(spark.createDataFrame([('a "b"', n)], "phrase string, freq bigint"), out)
    assert [tuple(r) for r in text.read_ngrams(spark, out).collect()] == [('a "b"', 4)]
    text.append_log(spark, str(tmp_path / "log"), "x")
    text.append_log(spark, str(tmp_path / "log"), "y", "z")
    assert text.read_lines(spark, str(tmp_path / "log")).count() == 3


def test_keyed_table_and_external_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    path = str(tmp_path / "t")
    text.write_table(df, path, "k", 2)
    assert sorted(r.v for r in text.lookup(spark, path, "k", ["a", "c", "zz"]).collect()) == [1, 3]
    store = str(tmp_path / "store")
    text.send(df, lambda: open(store, "a"), lambda f, row: (f.write(f"{row.k}\n"), f.flush()))
    assert sorted(open(store).read().split()) == ["a", "b", "c"]


def test_text_points(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 0.5,1.5\n\n7\t2 3\n  9 4 x\n")
    got = [(r.id, r.v) for r in points.read_text_points(spark, str(tmp_path / "p.txt")).collect()]
    assert got == [(0, [0.5, 1.5]), (1, [2.0, 3.0]), (2, [4.0, None])]


def test_binary_points(spark, tmp_path):
    x = np.random.default_rng(0).random((25, 3)).astype("f4")
    files.write_bytes(spark, str(tmp_path / "p.bin"), points.binary_points(x))
    got = points.read_binary_points(spark, str(tmp_path / "p.bin")).orderBy("id").collect()
    assert np.allclose([r.v for r in got], x) and [r.id for r in got] == list(range(25))
    assert files.read_bytes(spark, str(tmp_path / "p.bin"))[:8] == b"\x19\0\0\0\3\0\0\0"


def test_sinks(spark, tmp_path):
    points.write_centres(spark.createDataFrame([(1, [0.5, 2.0]), (0, [1.0, 3.0])], "cid int, c array<double>"), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["0 1.000000 3.000000", "1 0.500000 2.000000"]
    points.write_membership(spark.createDataFrame([(0, 2), (1, 0)], "id bigint, cid int"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["0 2", "1 0"]


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x.txt").write_bytes(b"12345")
    (tmp_path / "d" / "e" / "y.dat").write_bytes(b"123")
    d = str(tmp_path / "d")
    assert files.children(spark, d) == ["x.txt"] and files.children(spark, d, directories=True) == ["e"]
    assert [r.length for r in files.listing(spark, d, ".*\\.dat").collect()] == [3]
    assert files.listing(spark, d, recursive=False).count() == 1
    assert files.size(spark, d) == 8
    assert files.copy(spark, d + "/x.txt", d + "/z.txt") and files.exists(spark, d + "/z.txt")
    assert files.delete(spark, d) and not files.exists(spark, d) and not files.delete(spark, d)
    assert files.home_directory(spark)


@pytest.mark.parametrize("value", [7, 2.5, "x", True])
def test_values(spark, tmp_path, value):
    values.save_value(spark, str(tmp_path / "v"), value)
    assert values.load_value(spark, str(tmp_path / "v")) == value


def test_programs(spark, tmp_path):
    (tmp_path / "in.txt").write_text("#a #b x\n#a #b x\n")
    out = str(tmp_path / "out")
    cli.main(["-program", "ngramcount", "-input", str(tmp_path / "in.txt"), "-output", out, "-n", "2", "-unknown", "1"], spark)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["#a #b\t2", "#b x\t2"]
    cli.main(["-program", "hashtagsim", "-input", str(tmp_path / "in.txt"), "-output", out], spark)
    assert [r.value for r in spark.read.text(out).collect()] == ["4\t#a\t#b"]
    (tmp_path / "p.txt").write_text("".join(f"{i} {x}\n" for i, x in enumerate((0, 10, 0.5, 9.5))))
    cli.main(["-program", "kmeans", "-input", str(tmp_path / "p.txt"), "-output", out, "-n", "2"], spark)
    assert [r.value for r in spark.read.text(out + ".membership").collect()] == ["0 0", "1 1", "2 0", "3 1"]
    for bad in (["-program", "ngramcount", "-input", "x", "-output", "y"], ["-program", "none", "-input", "x", "-output", "y"], []):
        with pytest.raises(SystemExit) as e:
            cli.options(bad)
        assert e.value.code == 1


def test_streams(spark, tmp_path):
    source = tmp_path / "stream"
    source.mkdir()
    for k, value in enumerate(["a b a b", "a b"]):
        (source / f"{k}.txt").write_text(value + "\n")
        counts.start_ngram_counts(spark.readStream.text(str(source)), 2, "grams", str(tmp_path / "c1")).awaitTermination()
    assert {r.ngram: r.freq for r in spark.table("grams").collect()} == {"a b": 3, "b a": 1}
    schema, log = "op string, tid1 string, field string, payload string, seq int", tmp_path / "log"
    for rows in ([("write", "t", None, "a", 1), ("set", "t", "f", "b", 2)], [("delete", "t", None, None, 3), ("set", "t", "g", "c", 4)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(log))
        counts.start_operations(spark.readStream.schema(schema).parquet(str(log)), "ops", str(tmp_path / "c2")).awaitTermination()
    assert [tuple(r) for r in oplog.replay(spark.table("ops")).collect()] == [("t", "g", "c", 4)]


def test_late_rows_leave_the_windows(spark, tmp_path):
    schema, path = "ts timestamp, kind string", str(tmp_path / "events")
    seen = None
    for rows in (["2024-01-01 00:00:10", "2024-01-01 01:00:00"], ["2024-01-01 00:00:20", "2024-01-01 02:00:00"]):
        spark.createDataFrame([(x, "a") for x in rows], "ts string, kind string").selectExpr("cast(ts as timestamp) ts", "kind").write.mode("append").parquet(path)
        stream = counts.windowed_counts(spark.readStream.schema(schema).parquet(path), "ts", "kind", "5 minutes", "10 minutes")
        stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        seen = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n for r in seen.collect()) == [1, 1]  # the row of 00:00:20 came after its window was closed


def test_width_of_the_first_line(spark, tmp_path):
    from loomspark.sources import points

    (tmp_path / "p.txt").write_text("a 1 2\n\nb 3 4 5\nc 6\n")
    assert [r.v for r in points.read_text_points(spark, str(tmp_path / "p.txt")).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0], [6.0, None]]
    (tmp_path / "q.txt").write_text("\n")
    assert points.read_text_points(spark, str(tmp_path / "q.txt")).count() == 0
