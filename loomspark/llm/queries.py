"""The operators over whole tables, and SQL for what SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.tables import table

from . import html, quality, toxicity
from .chat import link_tool_calls
from .common import scratch_path, until_exit
from .decontam import contained_items
from .linededup import dedup_lines
from .mixing import poisson_mix
from .simhash import near_groups
from .tokens import read_tokens, write_tokens
from .weighted import edited_fingerprints


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


_TURN = {"prompt": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 3}}
TOOLS = {"reply": {"properties": _TURN, "required": ["prompt", "turn", "words"]}, "configure": {"properties": {**_TURN, "turn": {"type": "integer", "maximum": 0}}, "required": ["prompt", "turn"]}}


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a call of the tool `reply` and each system turn as one of `configure`, each assistant turn as the
    result of the call one turn before it. Dependencies are out of order on purpose: turns 2 and 3 of each four
    depend on the call two turns later, the others on the one four turns before, turn 1 on the system's."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    args = F.to_json(F.struct("turn", F.size(F.split("text", " ")).alias("words"), F.col("text").alias("prompt")))
    wants = F.when(F.col("role") == "system", None).when(F.col("turn") % 4 >= 2, name(-2)).when(F.col("turn") >= 4, name(4)).when(F.col("turn") == 1, name(1))
    tool = F.when(F.col("role") == "user", "reply").otherwise("configure")
    calls = turns.where("role in ('user', 'system')").select("conv_id", name(0).alias("call_id"), F.col("turn").alias("seq"), tool.alias("name"), args.alias("arguments"), F.array_compact(F.array(wants)).alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return link_tool_calls(calls, results, TOOLS)


ORACLE_3 = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, 't' || turn AS call_id, turn AS seq, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS tool,
             CASE WHEN role = 'system' THEN NULL WHEN turn % 4 >= 2 THEN 't' || (turn + 2) WHEN turn >= 4 THEN 't' || (turn - 4) WHEN turn = 1 THEN 't0' END AS dep,
             len(string_split(text, ' ')) AS words, text FROM t WHERE role IN ('user', 'system')),
one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY seq, tool, text) = 1),
chains AS (SELECT conv_id, call_id, 0 AS depth FROM one UNION ALL
           SELECT one.conv_id, one.call_id, depth + 1 FROM chains JOIN one ON one.conv_id = chains.conv_id AND one.dep = chains.call_id),
levels AS (SELECT conv_id, call_id, max(depth) AS level FROM chains GROUP BY ALL),
r AS (SELECT conv_id, 't' || (turn - 1) AS call_id, turn AS result_seq, text AS content FROM t WHERE role = 'assistant'),
answer AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY result_seq, content) = 1),
linked AS (
  SELECT coalesce(one.conv_id, answer.conv_id) AS conv_id, coalesce(one.call_id, answer.call_id) AS call_id, coalesce(seq, result_seq) AS seq, tool,
         one.call_id IS NOT NULL AS called, answer.call_id IS NOT NULL AS answered, one.seq AS turn, words, text, content, coalesce(level, 0) AS level,
         concat_ws('; ', CASE WHEN tool = 'configure' AND one.seq > 0 THEN 'turn: above 0' END, CASE WHEN words < 3 THEN 'words: below 3' END,
           CASE WHEN one.dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM one o WHERE o.conv_id = one.conv_id AND o.call_id = one.dep) THEN 'depends_on: no call ' || one.dep END) AS errors
  FROM one FULL JOIN answer ON one.conv_id = answer.conv_id AND one.call_id = answer.call_id LEFT JOIN levels ON levels.conv_id = one.conv_id AND levels.call_id = one.call_id),
said AS (SELECT *, CASE WHEN NOT called THEN 'orphan' WHEN errors <> '' THEN 'invalid' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status FROM linked)
SELECT conv_id, level, seq, call_id, status, CASE WHEN called THEN errors ELSE '' END AS errors,
  '{"arguments":' || CASE WHEN called THEN '{"prompt":' || to_json(text) || ',"turn":' || turn || ',"words":' || words || '}' ELSE 'null' END
  || ',"id":"' || call_id || '","name":' || CASE WHEN called THEN '"' || tool || '"' ELSE 'null' END
  || ',"result":' || CASE WHEN answered THEN to_json(content)::VARCHAR ELSE 'null' END || ',"status":"' || status || '"}' AS json
FROM said
"""


def fold(name: str, folds: int) -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % folds


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2), "quality")
    found = quality.score(docs.select("doc_id", "text"), network)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1), "toxic")
    found = toxicity.score(docs.select("doc_id", "text"), index)
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages)).select("page_id", "url", "text", "n_chars")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=0)
    until_exit(spark, path)
    return read_tokens(spark, path)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"), power=0.5, seed=8)


ORACLE_8 = """
WITH counts AS (SELECT coalesce(source, chr(0)) AS source, count(*) AS n FROM documents GROUP BY ALL),
rates AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM counts),
terms AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates),
ps AS (SELECT source, k, exp(-rate + k * ln(rate) - CASE WHEN k > 1 THEN list_sum(list_transform(range(2, k + 1), lambda i: ln(i))) ELSE 0 END) AS p FROM terms),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM ps),
u AS (SELECT *, ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.source = coalesce(u.source, chr(0)) AND c <= u.u) AS n FROM u),
r AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INT AS replica FROM n)
SELECT *, md5('8:' || coalesce(doc_id::VARCHAR, 'null') || ':' || replica) AS shuffle_key FROM r
"""

def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), long_line=50).select("doc_id", "n_lines", "n_deleted", "text")


ORACLE_9 = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
x AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM l),
y AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM x),
pairs AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, pos) AS nth FROM y
          WHERE regexp_matches(line, '\S') AND regexp_matches(after, '\S')),
alone AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, long ORDER BY doc_id, pos) AS nth
          FROM (SELECT *, len(regexp_extract_all(line, '\S+')) >= 50 AS long FROM y WHERE regexp_matches(line, '\S')) WHERE long OR n = 1),
gone AS (SELECT doc_id, pos FROM pairs WHERE nth > 1 UNION SELECT doc_id, pos + 1 FROM pairs WHERE nth > 1 UNION SELECT doc_id, pos FROM alone WHERE nth > 1),
lists AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY ALL)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(len(gone), 0) AS n_deleted,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda v, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN lists USING (doc_id)
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8, words=5)


def shingle_sql(source: str, key: str) -> str:
    return rf"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END) AS s
      FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {source}))"""


ORACLE_10 = f"""
WITH d AS {shingle_sql("documents", "doc_id")}, b AS {shingle_sql("benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= ceil(0.8 * n_shingles - 1e-9)
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_document_fingerprints": op1_document_fingerprints, "op2_quality_classifier": op2_quality_classifier, "op3_chat_formatting": op3_chat_formatting, "op4_toxicity": op4_toxicity, "op5_html_extraction": op5_html_extraction, "op6_token_ids": op6_token_ids, "op7_simhash_near_dedup": op7_simhash_near_dedup, "op8_mixing": op8_mixing, "op9_line_dedup": op9_line_dedup, "op10_decontamination": op10_decontamination, "pipeline": pipeline}
ORACLES = {"op3_chat_formatting": ORACLE_3, "op8_mixing": ORACLE_8, "op9_line_dedup": ORACLE_9, "op10_decontamination": ORACLE_10}
