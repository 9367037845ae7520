"""Pieces of the SQL that queries are held against."""

from __future__ import annotations

# The tokenizer's steps as RE2 writes them.
STEPS = [
    (r"\b(https?|ftp|file)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]\b", ""),
    (r"[:;]", " "),
    (r"[[:punct:]](\s+|$)", " "),
    (r"(^|\s+)[[:punct:]]+(\s+|$)", " "),
    (r"(^|\s+)[<>,./?!$%^&*()_+-=]", " "),
    (r"[^\x00-\x{80}]+", ""),
    (r"(^|\s+)\d+(\s+|$)", " "),
    (r"\s+", " "),
    (r"^[\x00-\x20]+|[\x00-\x20]+$", ""),
]


def tokens(line: str) -> str:
    out = f"lower({line})"
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"regexp_split_to_array({out}, '\\s+')"


LINES = f"lines AS (SELECT {tokens('line')} AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL))"


def grams(n: int) -> str:
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))"


def phrases(longest: int) -> str:
    every = " || ".join(grams(n) for n in range(1, longest + 1))
    return f"{LINES}, p AS (SELECT phrase, count(*) AS freq FROM (SELECT unnest({every}) AS phrase FROM lines) WHERE phrase <> '' GROUP BY ALL)"


TAGGED = f"""tagged AS (SELECT {tokens("line || ' #' || lang || ' #' || source")} AS w FROM
  (SELECT unnest(string_split(text, chr(10))) AS line, lang, source FROM documents WHERE text IS NOT NULL)),
pairs AS (SELECT hashtag, unnest(list_filter(w, lambda x: NOT starts_with(x, '#'))) AS word FROM (SELECT w, unnest(list_filter(w, lambda x: starts_with(x, '#'))) AS hashtag FROM tagged)),
counts AS (SELECT word, hashtag, count(*) AS cnt FROM pairs GROUP BY ALL)"""

EDGES = "edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"


def pagerank(iterations: int, damping: float) -> str:
    parts = [
        EDGES,
        "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)",
        "deg AS (SELECT src AS id, count(*)::DOUBLE AS d FROM edges GROUP BY ALL)",
        "n AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM nodes, n)",
    ]
    for k in range(iterations):
        parts.append(f"v{k} AS (SELECT dst AS id, sum(r / d) AS v FROM edges JOIN r{k} ON r{k}.id = src JOIN deg ON deg.id = src GROUP BY ALL)")
        parts.append(f"m{k} AS (SELECT coalesce(sum(r), 0) AS m FROM r{k} WHERE id NOT IN (SELECT id FROM deg))")
        parts.append(f"r{k + 1} AS (SELECT nodes.id, (1 - {damping}::DOUBLE) / n + {damping}::DOUBLE * (coalesce(v, 0) + m / n) AS r FROM nodes LEFT JOIN v{k} USING (id), n, m{k})")
    return f"WITH {', '.join(parts)} SELECT id, round(r, 9) AS rank FROM r{iterations}"


def distance(a: str, b: str, d: int = 64) -> str:
    return f"list_sum(list_transform(range(1, {d + 1}), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))"


def lloyd(passes: int, k: int = 10) -> str:
    """c<p>: centres after p passes; a<p>: membership found with c<p>."""
    parts = ["pts AS (SELECT vec_id AS id, embedding AS v FROM embeddings)", f"c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cid, v::DOUBLE[] AS c FROM (SELECT * FROM pts ORDER BY id LIMIT {k}))"]
    for p in range(passes):
        parts.append(f"a{p} AS (SELECT id, v, cid, dist FROM (SELECT id, v, cid, {distance('v', 'c')} AS dist FROM pts, c{p}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cid) = 1)")
        parts.append(f"x{p} AS (SELECT cid, j, avg(x) AS x FROM (SELECT cid, unnest(v)::DOUBLE AS x, unnest(range(1, 65)) AS j FROM a{p}) GROUP BY ALL)")
        parts.append(f"c{p + 1} AS (SELECT c{p}.cid, coalesce(m.c, c{p}.c) AS c FROM c{p} LEFT JOIN (SELECT cid, list(x ORDER BY j) AS c FROM x{p} GROUP BY ALL) m USING (cid))")
    return ", ".join(parts)


def plus_plus(draws: list[float]) -> str:
    parts = ["pts AS (SELECT vec_id AS id, embedding AS v FROM embeddings)", "s0 AS (SELECT 0 AS k, id, v FROM pts WHERE id = 0)"]
    for k, draw in enumerate(draws):
        parts.append(f"d{k} AS (SELECT id, min(dist) AS d FROM (SELECT pts.id, {distance('pts.v', 's.v')} AS dist FROM pts, s{k} s) GROUP BY ALL)")
        parts.append(f"p{k} AS (SELECT id, sum(d) OVER (ORDER BY id) AS upto, sum(d) OVER () AS total FROM d{k})")
        parts.append(f"s{k + 1} AS (SELECT * FROM s{k} UNION ALL SELECT {k + 1}, id, v FROM pts WHERE id = (SELECT min(id) FROM p{k} WHERE {draw}::DOUBLE * total < upto))")
    return f"WITH {', '.join(parts)} SELECT k, id FROM s{len(draws)}"


MATRIX = "e AS (SELECT vec_id AS i, (unnest(range(1, 65)) - 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
SCALED = "b AS (SELECT vec_id AS i, (unnest(range(1, 65)) - 1) AS j, unnest(embedding)::DOUBLE * label AS v FROM embeddings)"
