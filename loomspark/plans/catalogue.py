"""Queries by name, each over whole tables, with the SQL it is held against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import normalize, partition_of, tokenize, word_count
from loomspark.functions.vectors import add, next_power_of_two, squared_distance
from loomspark.operators import cooccur, graph, kmeans, langmodel, linalg, ngrams, oplog, phrasemodel, prefix, ratings, search
from loomspark.sources import files, points, text
from loomspark.sources.scratch import new_path, written
from loomspark.sources.tables import spread, table

from . import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.lines_of(spread(table(spark, sf_dir, "documents").select("text")))


def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their language and source as hashtags."""
    docs = spread(table(spark, sf_dir, "documents").select("text", "lang", "source")).select(F.explode(F.split("text", "\n")).alias("line"), "lang", "source")
    return docs.select(F.concat("line", F.lit(" #"), "lang", F.lit(" #"), "source").alias("value"))


# n-grams


@query(f"WITH {sql.LINES} SELECT token, count(*) AS freq FROM (SELECT unnest(w) AS token FROM lines) GROUP BY ALL")
def tokenize_counts(spark, sf_dir):
    tokens = doc_lines(spark, sf_dir).select(F.explode(tokenize(F.col("value"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def _ngram(n: int):
    @query(f"WITH {sql.LINES} SELECT ngram, count(*) AS freq FROM (SELECT unnest({sql.grams(n)}) AS ngram FROM lines) GROUP BY ALL")
    def f(spark, sf_dir):
        return ngrams.ngram_counts(doc_lines(spark, sf_dir), n)

    QUERIES[f"ngram_{n}"], ORACLES[f"ngram_{n}"] = QUERIES.pop("f"), ORACLES.pop("f")


for _n in (1, 2, 3):
    _ngram(_n)


@query(f"WITH {sql.phrases(3)} SELECT len(string_split(phrase, ' ')) AS n_words, count(*) AS phrases, sum(freq)::BIGINT AS total FROM p GROUP BY ALL")
def phrase_lengths(spark, sf_dir):
    counts = ngrams.phrase_counts(doc_lines(spark, sf_dir), 3)
    return counts.groupBy(word_count(F.col("phrase")).cast("bigint").alias("n_words")).agg(F.count(F.lit(1)).alias("phrases"), F.sum("freq").alias("total"))


# hashtags


@query(f"WITH {sql.TAGGED} SELECT * FROM counts")
def word_tag_counts(spark, sf_dir):
    return cooccur.word_tag_counts(tagged_lines(spark, sf_dir))


@query(f"WITH {sql.TAGGED} SELECT word, cnt FROM counts WHERE hashtag = '#en'")
def tag_feature_vector(spark, sf_dir):
    return cooccur.feature_vector(cooccur.word_tag_counts(tagged_lines(spark, sf_dir)), "#en")


@query(f"WITH {sql.TAGGED} SELECT sum(a.cnt * b.cnt)::BIGINT AS sim, a.hashtag AS h1, b.hashtag AS h2 FROM counts a JOIN counts b ON a.word = b.word AND a.hashtag < b.hashtag GROUP BY ALL")
def tag_similarity(spark, sf_dir):
    return cooccur.tag_similarity(written(cooccur.word_tag_counts(tagged_lines(spark, sf_dir))))


@query(
    """WITH counts AS (SELECT user_id AS word, event_type AS hashtag, count(*) AS cnt FROM events GROUP BY ALL)
    SELECT sum(a.cnt * b.cnt)::BIGINT AS sim, a.hashtag AS h1, b.hashtag AS h2 FROM counts a JOIN counts b ON a.word = b.word AND a.hashtag < b.hashtag GROUP BY ALL"""
)
def event_type_similarity(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("user_id").alias("word"), F.col("event_type").alias("hashtag")).agg(F.count(F.lit(1)).alias("cnt"))
    return cooccur.tag_similarity(counts)


# language models


@query(
    f"""WITH {sql.phrases(3)}, f AS (SELECT phrase, freq, string_split(phrase, ' ') AS w FROM p WHERE freq > 2),
    ext AS (SELECT array_to_string(w[1:len(w)-1], ' ') AS prefix, w[len(w)] AS word, freq FROM f WHERE len(w) > 1)
    SELECT ext.prefix, word, ext.freq, ext.freq / f.freq AS probability, row_number() OVER (PARTITION BY ext.prefix ORDER BY ext.freq DESC, word)::INT AS rank
    FROM ext JOIN f ON f.phrase = ext.prefix QUALIFY rank <= 5"""
)
def lm_next_word(spark, sf_dir):
    return langmodel.next_word(written(ngrams.phrase_counts(doc_lines(spark, sf_dir), 3)))


@query(
    f"""WITH {sql.phrases(5)}, s AS (SELECT w, freq, unnest(range(1, len(w))) AS k FROM (SELECT freq, string_split(phrase, ' ') AS w FROM p) WHERE len(w) > 1),
    t AS (SELECT phrase, freq AS total FROM p WHERE freq >= 2),
    r AS (SELECT array_to_string(w[1:k], ' ') AS phrase, array_to_string(w[k+1:], ' ') AS next_phrase, freq, len(w) - k AS n FROM s),
    a AS (SELECT r.*, total FROM r JOIN t USING (phrase) UNION ALL SELECT phrase, '@', total, 1, total FROM t),
    z AS (SELECT *, row_number() OVER (PARTITION BY phrase, n ORDER BY freq DESC, next_phrase) AS place FROM a)
    SELECT phrase, next_phrase, freq, freq / total AS probability FROM z
    WHERE place <= [3, 2, 2, 1][n] AND next_phrase <> '@' AND freq / total >= [0.05::DOUBLE, 0.03::DOUBLE, 0.01::DOUBLE, 0.005::DOUBLE][n]"""
)
def lm_next_phrase(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    dealt = docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # then texts needn't be dealt out themselves
    return phrasemodel.next_phrase(ngrams.lines_of(docs if dealt else spread(docs)))


# graphs


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


@query(f"WITH {sql.EDGES} SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def graph_nodes(spark, sf_dir):
    return graph.nodes(edges(spark, sf_dir))


@query(f"WITH {sql.EDGES} SELECT DISTINCT dst AS id FROM edges WHERE dst NOT IN (SELECT src FROM edges)")
def graph_dangling(spark, sf_dir):
    return graph.dangling(edges(spark, sf_dir))


@query(f"WITH {sql.EDGES} SELECT src AS id, count(*) AS outdegree FROM edges GROUP BY ALL")
def graph_outdegree(spark, sf_dir):
    return graph.out_degrees(edges(spark, sf_dir))


@query(sql.pagerank(10, 0.85))
def pagerank_10(spark, sf_dir):
    return graph.pagerank(edges(spark, sf_dir), 10).select("id", F.round("rank", 9).alias("rank"))


@query(
    "WITH e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'n' || (o_custkey % 25) AS dst FROM orders UNION SELECT DISTINCT 'n' || (o_custkey % 25), 'c' || o_custkey FROM orders), "
    + sql.pagerank(10, 0.85).removeprefix("WITH ").replace(sql.EDGES, "edges AS (SELECT * FROM e)")
)
def pagerank_undirected(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string")).alias("dst"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.pagerank(both, 10).select("id", F.round("rank", 9).alias("rank"))


# ratings, search, mutation log


@query(
    """WITH r AS (SELECT l_orderkey AS u, l_partkey AS p, avg(l_quantity) AS x FROM lineitem GROUP BY ALL), m AS (SELECT p, avg(x) AS y FROM r GROUP BY ALL)
    SELECT round(avg((x - y) * (x - y)), 6) AS mse FROM r JOIN m USING (p)"""
)
def rating_mse(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("user"), F.col("l_partkey").alias("product")).agg(F.avg("l_quantity").alias("rating"))
    means = r.groupBy("product").agg(F.avg("rating").alias("mean"))
    predicted = r.select("user", "product").join(means, "product").select("user", "product", F.col("mean").alias("rating"))
    return ratings.mean_squared_error(r, predicted).select(F.round("mse", 6).alias("mse"))


def event_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    keyed = events.select(F.col("event_type").alias("hashtag"), F.get_json_object("props", "$.k").alias("keyword"), F.col("user_id").alias("uid"))
    return keyed.groupBy("hashtag", "keyword", "uid").agg(F.count(F.lit(1)).alias("freq"))


SEARCH = "SELECT user_id AS uid, count(*) AS freq FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') IN ('1', '2', '3', '5', '8') GROUP BY ALL ORDER BY freq DESC, uid LIMIT 20"


@query(SEARCH)
def search_top_users(spark, sf_dir):
    return search.top_users(event_postings(spark, sf_dir), "click", 20, ["1", "2", "3", "5", "8"])


@query(SEARCH)
def search_by_keys(spark, sf_dir):
    keys = spark.createDataFrame([("click", k) for k in ("1", "2", "3", "5", "8")], "hashtag string, keyword string")
    return search.top_users_by_keys(event_postings(spark, sf_dir), keys, 20)


@query(f"SELECT string_agg(uid || ':' || freq, ',' ORDER BY freq DESC, uid) AS posting FROM ({SEARCH})")
def search_posting(spark, sf_dir):
    return search.as_posting(search_top_users(spark, sf_dir))


def event_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "write").when(F.col("event_type") == "error", "delete").otherwise("set")
    return events.select(op.alias("op"), F.col("user_id").cast("string").alias("tid1"), F.lit(None).cast("string").alias("tid2"), F.col("event_type").alias("field"), F.col("props").alias("payload"), F.col("event_id").alias("seq"))


@query(
    """WITH o AS (SELECT CASE event_type WHEN 'signup' THEN 'write' WHEN 'error' THEN 'delete' ELSE 'set' END AS op, user_id::VARCHAR AS tid,
      CASE WHEN event_type IN ('signup', 'error') THEN '' ELSE event_type END AS field, props AS payload, event_id AS seq FROM events),
    d AS (SELECT tid, max(seq) AS gone FROM o WHERE op = 'delete' GROUP BY ALL)
    SELECT tid, field, payload, seq FROM o LEFT JOIN d USING (tid) WHERE op <> 'delete' AND (gone IS NULL OR seq > gone)
    QUALIFY row_number() OVER (PARTITION BY tid, field ORDER BY seq DESC) = 1"""
)
def oplog_latest(spark, sf_dir):
    return oplog.replay(event_operations(spark, sf_dir))


# k-means


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _centre_table(spark: SparkSession, centres: np.ndarray) -> DataFrame:
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(centres)]
    return spark.createDataFrame(rows, "cid int, c array<double>").select("cid", F.posexplode("c").alias("j", "x")).select("cid", "j", F.round("x", 6).alias("x"))


@query(f"WITH {sql.lloyd(1)} SELECT id, cid, round(dist, 6) AS dist FROM a0")
def kmeans_assign(spark, sf_dir):
    p = vectors(spark, sf_dir)
    return kmeans.assign(p, kmeans.first_rows(p, 10)).select("id", "cid", F.round("dist", 6).alias("dist"))


@query(f"WITH {sql.lloyd(1)} SELECT cid, unnest(range(0, 64))::INT AS j, round(unnest(c), 6) AS x FROM c1")
def kmeans_update(spark, sf_dir):
    p = vectors(spark, sf_dir)
    first = kmeans.first_rows(p, 10)
    return _centre_table(spark, kmeans.update(kmeans.partial_sums(p, first, None), first)[0])


@query(f"WITH {sql.lloyd(2)} SELECT count(*) AS changed FROM a0 JOIN a1 USING (id) WHERE a0.cid <> a1.cid")
def kmeans_delta(spark, sf_dir):
    p = vectors(spark, sf_dir)
    first = kmeans.first_rows(p, 10)
    second, _ = kmeans.update(kmeans.partial_sums(p, first, None), first)
    return kmeans.partial_sums(p, second, first).agg(F.sum("changed").alias("changed"))


@query(f"WITH {sql.lloyd(6)} SELECT cid, unnest(range(0, 64))::INT AS j, round(unnest(c), 6) AS x FROM c6")
def kmeans_full(spark, sf_dir):
    return _centre_table(spark, kmeans.kmeans(vectors(spark, sf_dir), 10, threshold=0.0, max_loops=5).centres)


@query(f"WITH {sql.lloyd(6)} SELECT cid, unnest(range(0, 64))::INT AS j, round(unnest(c), 6) AS x FROM c6")
def kmeans_passes(spark, sf_dir):
    """kmeans_full by distributed passes, as tables beyond LOCAL_NUMBERS take them."""
    p = vectors(spark, sf_dir)
    now, before = kmeans.first_rows(p, 10), None
    for _ in range(6):
        now, before = kmeans.update(kmeans.partial_sums(p, now, before), now)[0], now
    return _centre_table(spark, now)


DRAWS = [0.13, 0.37, 0.61, 0.89]


@query(sql.plus_plus(DRAWS))
def kmeanspp_seed(spark, sf_dir):
    ids = kmeans.plus_plus(vectors(spark, sf_dir), 0, DRAWS)
    return spark.createDataFrame(list(enumerate(ids)), "k int, id bigint")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS upto FROM orders")
def running_total(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,4)").alias("p"))
    return prefix.running_sum(o, "o_orderkey", "p", "upto").select("o_orderkey", F.round(F.col("upto").cast("double"), 2).alias("upto"))


@query(f"SELECT a.vec_id AS id, round({sql.distance('a.embedding', 'b.embedding')}, 6) AS dist, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE)) > 0 AS positive FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1")
def vector_functions(spark, sf_dir):
    p = vectors(spark, sf_dir).select("id", F.col("v").cast("array<double>").alias("v"))
    q = p.select((F.col("id") + 1).alias("id"), F.col("v").alias("w"))
    total = F.aggregate(add(F.col("v"), F.col("w")), F.lit(0.0), lambda s, x: s + x)
    return p.join(q, "id").select("id", F.round(squared_distance(F.col("v"), F.col("w")), 6).alias("dist"), (total > 0).alias("positive"))


# matrices


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.from_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("v"))
    return linalg.from_rows(rows, "vec_id", "v")


PRODUCT = f"WITH {sql.MATRIX} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 5) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY ALL"


@query(f"WITH {sql.MATRIX} SELECT j AS i, i AS j, v FROM e")
def matrix_transpose(spark, sf_dir):
    return linalg.transpose(matrix(spark, sf_dir))


@query(PRODUCT)
def matrix_matmul(spark, sf_dir):
    e = matrix(spark, sf_dir)
    return linalg.multiply_blocks(linalg.transpose(e), e).select("i", "j", F.round("v", 5).alias("v"))


@query(PRODUCT)
def matrix_matmul_join(spark, sf_dir):
    e = matrix(spark, sf_dir)
    return linalg.multiply(linalg.transpose(e), e).select("i", "j", F.round("v", 5).alias("v"))


@query(f"WITH {sql.MATRIX}, {sql.SCALED} SELECT i, j, round(e.v + b.v, 6) AS v FROM e JOIN b USING (i, j)")
def matrix_add(spark, sf_dir):
    return linalg.add(matrix(spark, sf_dir), scaled(spark, sf_dir)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {sql.MATRIX}, {sql.SCALED} SELECT max(abs(e.v - b.v)) AS max_abs_diff FROM e JOIN b USING (i, j)")
def matrix_max_abs_diff(spark, sf_dir):
    return linalg.max_abs_diff(matrix(spark, sf_dir), scaled(spark, sf_dir))


@query(f"WITH {sql.MATRIX}, {sql.SCALED}, pairs AS (SELECT 'itself' AS pair, e.v AS x, e.v AS y FROM e UNION ALL SELECT 'scaled', e.v, b.v FROM e FULL JOIN b USING (i, j)) SELECT pair, bool_and(coalesce(x = y, false)) AS equal FROM pairs GROUP BY pair")
def matrix_equals(spark, sf_dir):
    """A matrix and its transpose's transpose, and a matrix and another one."""
    e = matrix(spark, sf_dir)
    same, other = linalg.equals(e, linalg.transpose(linalg.transpose(e))), linalg.equals(e, scaled(spark, sf_dir))
    return same.select(F.lit("itself").alias("pair"), "equal").unionByName(other.select(F.lit("scaled").alias("pair"), "equal"))


@query("SELECT 1000::BIGINT AS cells, true AS in_range")
def matrix_random(spark, sf_dir):
    return linalg.random_matrix(spark, 40, 25, seed=1).agg(F.count_distinct("i", "j").alias("cells"), F.every((F.col("v") >= 0) & (F.col("v") < 1)).alias("in_range"))


# sources and sinks


@query("SELECT vec_id AS id, (unnest(range(1, 65)) - 1)::INT AS j, round(unnest(embedding)::DOUBLE, 6) AS v FROM embeddings")
def text_points_roundtrip(spark, sf_dir):
    path = new_path(spark)
    p = vectors(spark, sf_dir)
    p.orderBy("id").select(F.concat_ws(" ", F.col("id").cast("string"), F.transform("v", lambda x: x.cast("string"))).alias("value")).write.text(path)
    return points.read_text_points(spark, path).select("id", F.posexplode("v").alias("j", "v")).select("id", "j", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("SELECT 3::BIGINT AS files, 1000::BIGINT AS n, sum(i)::DOUBLE * 3 AS total FROM range(0, 1000) t(i)")
def binary_points_roundtrip(spark, sf_dir):
    path = new_path(spark)
    for k in range(3):
        files.write_bytes(spark, f"{path}/p{k}.bin", points.binary_points(np.arange(1000).reshape(250, 4)))
    n_files = files.listing(spark, path, ".*/p[0-9]\\.bin").count()
    found = points.read_binary_points(spark, path)
    return found.agg(F.lit(n_files).cast("bigint").alias("files"), F.sum(F.size("v")).alias("s"), F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total")).select("files", (F.col("s") / 3).cast("bigint").alias("n"), "total")


@query("SELECT c_mktsegment AS phrase, count(*) AS freq FROM customer GROUP BY ALL")
def tsv_roundtrip(spark, sf_dir):
    path = new_path(spark)
    text.write_tsv(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("phrase")).agg(F.count(F.lit(1)).alias("freq")), path)
    return text.read_ngrams(spark, path)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 32, 100)")
def keyed_lookup(spark, sf_dir):
    path = new_path(spark)
    text.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey")
    return text.lookup(spark, path, "o_orderkey", [1, 7, 32, 100])


@query("SELECT o_custkey, pow(2, ceil(log2(o_custkey)))::BIGINT AS p2, true AS in_range FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey > 0)")
def scalar_functions(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_custkey").where("o_custkey > 0").distinct()
    part = partition_of(F.col("o_custkey"), 7)
    return keys.select("o_custkey", next_power_of_two(F.col("o_custkey")).alias("p2"), ((part >= 0) & (part < 7)).alias("in_range"))


@query(f"SELECT doc_id, pos, {sql.tokens('line').removeprefix('regexp_split_to_array(').removesuffix(", '\\s+')")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos FROM documents WHERE text IS NOT NULL)")
def normalized_document_lines(spark, sf_dir):
    """Every line of every document."""
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return lines.select("doc_id", "pos", normalize(F.col("value")).alias("line"))
