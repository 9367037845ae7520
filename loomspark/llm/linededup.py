"""Line dedup by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Places of a fingerprint from which on its first place is broadcast, and the most fingerprints that can be.
HEAVY, HEAVY_ROWS = 10_000, 50_000


def line_hash(x: Column) -> Column:
    """The 128 bits of the md5: two different lines of 10^10 are taken for equal with probability 10^-19."""
    return F.unhex(F.md5(x))


def winnowed_lines(docs: DataFrame, long_line: int) -> DataFrame:
    """(doc_id, text_hash, pos, g, alone, next, next_pos, prev, prev_pos): a row for each selected line of a text.

    Of each window of two neighbouring lines the one with the smaller hash g is selected, the right one of equals; a
    line may be selected by the windows on both of its sides and is one row. next and prev are the hashes of the
    lines beside it in the windows that selected it, else null; alone is null. A line of `long_line` words is a
    window by itself (alone 0), and so is the only line of a text (alone 1). Blank lines are passed over: the lines
    before and after them are neighbours."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("l"))
    lines = lines.withColumn("l", F.filter(F.transform("l", lambda x, i: F.struct(i.alias("pos"), F.when(F.regexp_count(x, F.lit(r"\S")) > 0, line_hash(x)).alias("h"), (F.regexp_count(x, F.lit(r"\S+")) >= long_line).alias("long"))), lambda x: x["h"].isNotNull()))
    chosen = F.expr("""filter(transform(l, (x, i) -> struct(x.pos, x.h as g, cast(null as int) as alone,
        if(get(l, i + 1).h > x.h, get(l, i + 1).h, null) as next, if(get(l, i + 1).h > x.h, get(l, i + 1).pos, null) as next_pos,
        if(i > 0 and get(l, i - 1).h >= x.h, get(l, i - 1).h, null) as prev, if(i > 0 and get(l, i - 1).h >= x.h, get(l, i - 1).pos, null) as prev_pos)),
        x -> x.next is not null or x.prev is not null)""")
    alone = F.expr("""transform(filter(l, x -> x.long or size(l) = 1), x -> struct(x.pos, x.h as g, if(x.long, 0, 1) as alone,
        cast(null as binary) as next, cast(null as int) as next_pos, cast(null as binary) as prev, cast(null as int) as prev_pos))""")
    return lines.select("doc_id", "text_hash", F.explode(F.concat(chosen, alone)).alias("f")).select("doc_id", "text_hash", "f.*")


def later_places(rows: DataFrame, key: list[str], beside: list[str]) -> DataFrame:
    """The rows that aren't the first of their key in the order (doc_id, text_hash, pos), with that one as `first`
    (its place and its columns `beside`): one partner each, so there are no more rows than before.

    A key with many places would be one task of the join, so the first places of such keys, HEAVY_ROWS at most, are
    broadcast, and only the other rows are shuffled. rows must be written."""
    place = F.struct("doc_id", "text_hash", "pos", *beside)
    firsts = cut(rows.groupBy(key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    limit = max(HEAVY, (firsts.agg(F.sum("n")).first()[0] or 0) // HEAVY_ROWS)
    light = firsts.where(F.col("n") <= limit).drop("n")
    heavy = firsts.where(F.col("n") > limit).drop("n")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    if heavy.isEmpty():
        met = rows.join(light, same(rows, light)).select(rows["*"], "first")
    else:
        hot = F.broadcast(heavy)
        rest = rows.join(hot, same(rows, heavy), "left_anti")
        met = rows.join(hot, same(rows, heavy)).select(rows["*"], "first").unionByName(rest.join(light, same(rest, light)).select(rest["*"], "first"))
    return met.where("doc_id != first.doc_id or text_hash != first.text_hash or pos != first.pos")


def repeated_lines(docs: DataFrame, long_line: int = 50) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines in later copies of a run of lines; pos counts from 0.

    A run is two lines or more, or one of `long_line` words or more, or the only line of a text. Blank lines don't
    count; those between two lines of a later copy are returned with them. Windows of two lines guarantee that every
    run has a selected line in each two of its lines, the same ones in every copy. Each selected line is joined to the
    first place of an equal one and the match extended to both sides, where the lines beside both are equal; matches
    of neighbouring windows chain into the whole run. Where they aren't, as the first place of a common line stands
    among others, that side is joined once more, to the first place of the two lines together. So a line is
    returned exactly if a run of two lines (or a long line) that it is in stands at an earlier place too."""
    prints = cut(winnowed_lines(docs.where("doc_id is not null and text is not null"), long_line))
    met = cut(later_places(prints, ["g", "alone"], ["next", "prev"]))
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col("next").alias("beside"), F.col("next_pos").alias("other"), (F.col("next") == F.col("first.next")).alias("equal")),
        F.struct(F.lit(-1).alias("side"), F.col("prev").alias("beside"), F.col("prev_pos").alias("other"), (F.col("prev") == F.col("first.prev")).alias("equal")),
    )
    place = ["doc_id", "text_hash", "pos"]
    extended = met.where("alone is null").select(*place, "g", F.explode(sides).alias("x")).select(*place, "g", "x.*").where("other is not null")
    apart = cut(extended.where("not coalesce(equal, false)").drop("equal"))
    again = later_places(apart, ["g", "side", "beside"], []).select(*place, "other")
    found = met.where("alone is not null").select(*place, F.col("pos").alias("other")).unionByName(extended.where("equal").select(*place, "other")).unionByName(again)
    return found.select("doc_id", "text_hash", F.explode(F.sequence("pos", "other")).alias("pos"))


def dedup_lines(docs: DataFrame, long_line: int = 50) -> DataFrame:
    """docs with the later copies of repeated runs of lines (see repeated_lines) deleted from `text`.

    Adds n_lines (lines before) and n_deleted (bigint); columns of these names are replaced, all others stay,
    every row stays. Rows with a null text or doc_id stay as they are (0 deleted; 0 lines for a null text);
    a blank line is deleted only inside a run, an empty text (one blank line) never; a text whose lines are all deleted becomes empty.
    Repeated rows, equal in id and text, are treated alike: neither counts as the other's copy."""
    gone = repeated_lines(docs, long_line).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("__loom_gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__loom_id", "text_hash": "__loom_hash"})
    joined = docs.withColumn("__loom_text_hash", F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col("__loom_id")) & (F.col("__loom_text_hash") == F.col("__loom_hash")), "left")
    lines = F.split("text", "\n")
    left = F.expr("array_join(filter(split(text, '\n'), (x, i) -> not array_contains(__loom_gone, i)), '\n')")
    out = joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("bigint")).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("bigint"))
    out = out.withColumn("n_deleted", F.coalesce(F.when(F.col("__loom_gone").isNotNull(), F.size("__loom_gone")), F.lit(0)).cast("bigint"))
    out = out.withColumn("text", F.when(F.col("__loom_gone").isNotNull(), left).otherwise(F.col("text")))
    return out.drop("__loom_gone", "__loom_id", "__loom_hash", "__loom_text_hash")
