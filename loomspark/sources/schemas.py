"""Declared schemas of the sources; nothing is inferred."""

NGRAMS = "phrase string, freq bigint"
EDGES = "src string, dst string"
POSTINGS = "hashtag string, keyword string, uid bigint, freq bigint"
RATINGS = "user int, product int, rating double"
OPERATIONS = "op string, tid1 string, tid2 string, field string, payload string, seq int"
