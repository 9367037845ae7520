"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLES = 64
#: Samples drawn from one exploded row: enough to share the aggregation's look-up, few enough for the JIT.
GROUP = 2
#: A draw with a bound above this over the total weight is passed over: it is the smallest with probability exp(-ENOUGH).
ENOUGH = 25.0
HALF = float(1 << 24)
#: What stands between words.
OTHER = r"[^\p{L}\p{N}]+"


def _draws(terms: DataFrame, weights: list[str]) -> DataFrame:
    """terms (keys..., term: bigint hash, a weight w and the text's total `all_w` for each text compared) with
    v_<w>_<i> for the samples GROUP j + i of each j: the sample's place in the order of `a` in the upper bits,
    the name of (term, t) in the lower 16. The smallest over a text's terms is its sample.

    With r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn by hash for (term, sample): t = floor(ln w / r + b),
    ln a = ln c - r (t - b + 1). As r = -ln x and c = -ln z with x, z products of two uniforms, a is at least
    (1 - z) x / w, and for w = 1 at least (1 - z) / ((1 - b) / x + b). The smallest `a` of a text is
    exponential with its total weight as rate, so a draw whose bound is above ENOUGH / total is no sample (but
    with probability exp(-ENOUGH)), and its logarithms needn't be taken."""
    every, low = range(GROUP), F.lit((1 << 24) - 1).cast("bigint")
    df = terms.withColumn("heaviest", F.greatest(*weights).cast("double")).withColumn("reach", F.greatest(*(ENOUGH / F.greatest(F.col(f"all_{w}"), F.lit(1)) for w in weights)))
    df = df.withColumns({f"log_{w}": F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))) for w in weights})
    df = df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // GROUP - 1))))
    keep = df.columns
    df = df.select(*keep, *(F.xxhash64(F.col("term").bitwiseXOR((F.col("j") * GROUP + i).cast("bigint"))).alias(f"h{i}") for i in every))
    df = df.select(*df.columns, *(F.xxhash64(f"h{i}").alias(f"g{i}") for i in every))

    def unit(x: str, shift: int) -> Column:
        return (F.shiftrightunsigned(x, shift).bitwiseAND(low).cast("double") + 0.5) / HALF

    df = df.select(
        *df.columns, *((unit(f"h{i}", 40) * unit(f"h{i}", 16)).alias(f"x{i}") for i in every), *((unit(f"g{i}", 40) * unit(f"g{i}", 16)).alias(f"z{i}") for i in every),
        *(((F.col(f"h{i}").bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("double") + 0.5) / 65536.0).alias(f"b{i}") for i in every),
    )
    near = [F.when(F.col("heaviest") > 1, (1.0 - F.col(f"z{i}")) * F.col(f"x{i}") / F.col("heaviest")).otherwise((1.0 - F.col(f"z{i}")) / ((1.0 - F.col(f"b{i}")) / F.col(f"x{i}") + F.col(f"b{i}"))) <= F.col("reach") for i in every]
    df = df.select(*df.columns, *(F.when(near[i], -F.ln(f"x{i}")).alias(f"r{i}") for i in every))
    rest = df.columns
    df = df.select(*rest, *(F.floor(F.col(f"log_{w}") / F.col(f"r{i}") + F.col(f"b{i}")).alias(f"t_{w}_{i}") for w in weights for i in every), *(F.when(F.col(f"r{i}").isNotNull(), F.ln(-F.ln(f"z{i}"))).alias(f"c{i}") for i in every))

    def place(w: str, i: int) -> Column:
        log_a = F.col(f"c{i}") - F.col(f"r{i}") * (F.col(f"t_{w}_{i}") - F.col(f"b{i}") + 1.0)
        name = (F.col(f"g{i}").bitwiseXOR(F.col(f"t_{w}_{i}") * 40503)).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        return F.shiftleft(((log_a + 128.0) * float(1 << 39)).cast("bigint"), 16).bitwiseOR(name)

    return df.select(*keep, *(place(w, i).alias(f"v_{w}_{i}") for w in weights for i in every))


def signatures(terms: DataFrame, key: str, weights: list[str]) -> DataFrame:
    """(key, s_<weight>...): for each weight column an array of SAMPLES ints in 0 .. 65535, -1 where no term has
    weight. Two texts' samples are equal at a rate of the sum of the smaller weights over that of the larger."""
    names = [f"v_{w}_{i}" for w in weights for i in range(GROUP)]
    least = _draws(terms, weights).groupBy(key, "j").agg(*(F.min(n).alias(n) for n in names))
    ids = [F.array(*(F.coalesce(F.col(f"v_{w}_{i}").bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("int"), F.lit(-1)) for i in range(GROUP))).alias(w) for w in weights]
    listed = least.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("j", *ids))).alias("parts"))
    return listed.select(key, *(F.flatten(F.col(f"parts.{w}")).alias(f"s_{w}") for w in weights))


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)).cast("double") / float(SAMPLES)


def as_hex(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(0xFFFF)), 4, "0"))), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n, next_id, prev_id, prev_n) around the ring of ascending doc_id (unique); n counts code points."""
    ranged = docs.select("doc_id", F.length("text").cast("bigint").alias("n")).repartitionByRange("doc_id")
    ids = cut(ranged.withColumn("part", F.spark_partition_id()))  # written, so that no task can be dealt other ranges later
    by = Window.partitionBy("part").orderBy("doc_id")
    ids = ids.select("*", F.lead("doc_id").over(by).alias("next_id"), F.lag("doc_id").over(by).alias("prev_id"), F.lag("n").over(by).alias("prev_n"))
    ends = ids.groupBy("part").agg(F.min("doc_id").alias("lo"), F.max(F.struct("doc_id", "n")).alias("hi"))  # a row per partition
    ring = Window.orderBy("part")
    ends = ends.select("part", F.lead("lo").over(ring).alias("lo"), F.lag("hi").over(ring).alias("hi"), F.first("lo").over(ring).alias("lowest"), F.last("hi").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("highest"))
    ids = ids.join(F.broadcast(ends), "part")
    return ids.select("doc_id", "n", F.coalesce("next_id", "lo", "lowest").alias("next_id"), F.coalesce("prev_id", "hi.doc_id", "highest.doc_id").alias("prev_id"), F.coalesce("prev_n", "hi.n", "highest.n").alias("prev_n"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text (doc_id, text) and of its edited text, and how like they are.

    Terms are the lower-cased runs of letters and digits, weighted by how often they occur. The edited text is
    the text with its last floor(n / 2) code points replaced by the first as many (or all) of the next
    document's, in ascending doc_id, after the last the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text counts as empty; a text without words has the fingerprint of all ffff and is as like another
    such text as can be. Rows without a doc_id have no place in the order and are left out; of rows that share
    one, the smallest text stands for them. Other columns are ignored. An empty table gives no rows."""
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = cut(neighbours(docs))
    if not ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        ids = cut(neighbours(docs))
    base = docs.join(ids.hint("merge"), "doc_id")
    heads = base.select(F.col("prev_id").alias("doc_id"), F.expr("substring(text, 1, cast(prev_n div 2 as int))").alias("head"))
    texts = base.join(heads.hint("merge"), "doc_id").withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n - n div 2 as int))"), F.col("head")))
    facts = texts.select("doc_id", F.col("n").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    split = texts.select("doc_id", F.split(F.lower("text"), OTHER).alias("w"), F.split(F.lower("edited"), OTHER).alias("e"))
    # two empty words at most are counted in the totals, at a text's ends; a smaller total only widens the search
    split = split.select("doc_id", *(F.greatest(F.size(c) - 2, F.lit(1)).alias(n) for c, n in (("w", "all_own"), ("e", "all_edited"))), F.explode(F.array(F.struct(F.lit(1).alias("own"), F.col("w").alias("w")), F.struct(F.lit(0).alias("own"), F.col("e").alias("w")))).alias("x"))
    words = split.select("doc_id", "all_own", "all_edited", "x.own", F.explode("x.w").alias("word"))
    # every text gives a row at least, so that a text without words keeps its place; the empty word weighs nothing
    one = (F.col("word") != "").cast("int")
    terms = words.groupBy("doc_id", "all_own", "all_edited", F.xxhash64("word").alias("term")).agg(F.sum(one * F.col("own")).alias("own"), F.sum(one * (1 - F.col("own"))).alias("edited"))
    prints = signatures(terms, "doc_id", ["own", "edited"])
    # each fingerprint goes to its own document and to the one before it, so that it is computed once
    ring = prints.join(ids.select("doc_id", "prev_id"), "doc_id")
    sent = F.array(F.struct(F.col("doc_id").alias("to"), F.col("s_own"), F.col("s_edited"), F.lit(None).cast("array<int>").alias("s_next")), F.struct(F.col("prev_id").alias("to"), F.lit(None).cast("array<int>").alias("s_own"), F.lit(None).cast("array<int>").alias("s_edited"), F.col("s_own").alias("s_next")))
    met = ring.select(F.explode(sent).alias("x")).select(F.col("x.to").alias("doc_id"), "x.s_own", "x.s_edited", "x.s_next")
    met = met.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("s_own", "s_edited", "s_next")))
    return facts.join(met, "doc_id").select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("s_own")).alias("fingerprint"), as_hex(F.col("s_edited")).alias("edited_fingerprint"), likeness(F.col("s_own"), F.col("s_edited")).alias("near_edited"), likeness(F.col("s_own"), F.col("s_next")).alias("near_next"))
