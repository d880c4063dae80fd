"""The queries of the training-data operators and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, importance, language_id, lexical_search, mixing, near_vectors, ngram_join, quality, suffix_dedup, token_counts, top_k, toxicity
from .common import fold, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.round(F.get("copies", F.lit(0))["position"], 9).alias("position")
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", first, F.size("copies").cast("long").alias("copies"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digest(chat_format.format_chats(turns))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_mixing, op3_chat_format, op4_suffix_dedup, op5_decontamination, op6_toxicity, op7_language_id, op8_quality, op9_top_k, op10_ngram_join, op11_lexical_search, op12_importance, op13_near_vectors, pipeline)}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY key) - 1 AS rank FROM d GROUP BY key),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM r),
water AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, key LIMIT 1),
t AS (SELECT key, source_size, rank, least(CAST(cap AS DOUBLE), water.level * w) AS target FROM l, water),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY key ORDER BY hash, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
i AS (SELECT *, start / greatest(target, 1.0) AS demand, floor(target + 0.5) - start AS left_ FROM p JOIN t USING (key)),
-- the demand that a schedule has built up by a time, inverted: sources fade from 1.2 to 0.8, stay, or rise from 0.6 to 1.4
q AS (SELECT *, CASE WHEN demand >= 1 OR rank % 3 = 1 THEN demand
    WHEN rank % 3 = 0 AND demand < 0.55 THEN (sqrt(1.44 - 0.8 * demand) - 1.2) / -0.4 WHEN rank % 3 = 0 THEN 0.5 + (sqrt(1 - 0.8 * (demand - 0.55)) - 1) / -0.4
    WHEN demand < 0.4 THEN (sqrt(0.36 + 1.6 * demand) - 0.6) / 0.8 ELSE 0.5 + (sqrt(1 + 1.6 * (demand - 0.4)) - 1) / 0.8 END AS at_time FROM i)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, left_)) + greatest(0, least(size, left_ - source_size)) + greatest(0, least(size, left_ - 2 * source_size)) AS BIGINT) AS taken,
       CASE WHEN size > 0 AND left_ > 0 THEN round(at_time, 9) END AS position,
       CAST(CASE WHEN size > 0 THEN (left_ > 0)::INT + (left_ > source_size)::INT + (left_ > 2 * source_size)::INT ELSE 0 END AS BIGINT) AS copies
FROM q
"""

OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
f AS (SELECT *, length(text) + length(text) - length(replace(text, chr(8288), ''))
    + len(regexp_extract_all(text, '<\|[A-Za-z0-9_]+\|>|</?s>|\[/?[A-Z][A-Z_]*\]|<</?SYS>>|<(?:start|end)_of_turn>|<(?:bos|eos|pad|unk)>|</?tool_[a-z]+>')) AS escaped_chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + escaped_chars + 11) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


_OP5_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_OP5_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP5_WORDS} AS w FROM benchmark),
bw AS (SELECT item, w[i:i + 12] AS g, least(13, len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dg AS (SELECT rid, i, n, w[i:i + n - 1] AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT rid, i, dg.n, item FROM dg JOIN bw ON dg.g = bw.g AND dg.n = bw.n),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid),
dw AS (SELECT rid, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
it AS (SELECT item, term, min(o) AS o FROM (SELECT item, unnest(w) AS term, unnest(range(len(w))) AS o FROM b WHERE item IS NOT NULL) GROUP BY item, term),
ir AS (SELECT it.*, row_number() OVER (PARTITION BY item ORDER BY coalesce(n, 0), term) AS r FROM it LEFT JOIN (SELECT term, count(*) AS n FROM dw GROUP BY term) USING (term)),
two AS (SELECT item, min_by(term, r) AS a, min_by(o, r) AS oa, max_by(term, r) AS b, max_by(o, r) AS ob FROM ir WHERE r <= 2 GROUP BY item),
near AS (SELECT x.rid, count(DISTINCT item) AS n_near FROM two JOIN dw x ON x.term = a JOIN dw y ON y.rid = x.rid AND y.term = b WHERE abs((y.pos - ob) - (x.pos - oa)) <= 5 GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid) LEFT JOIN near USING (rid)
"""

OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT rid, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT rid, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
m AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT rid, min(i) AS lo, max(i) + 200 AS hi FROM m GROUP BY rid, run),
k AS (SELECT rid, lo, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS a, lo AS b FROM s UNION ALL SELECT rid, NULL, max(hi), NULL FROM s GROUP BY rid),
t AS (SELECT k.rid, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (rid) GROUP BY k.rid),
c AS (SELECT rid, sum(hi - lo) AS gone, count(*) AS spans FROM s GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM p JOIN s a ON a.rid = x JOIN s b ON b.rid = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT x AS rid, x AS y FROM e UNION SELECT reach.rid, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, doc_id) AS component_id
FROM d LEFT JOIN s USING (rid) LEFT JOIN (SELECT reach.rid, min(doc_id) AS least_id FROM reach JOIN d ON d.rid = reach.y GROUP BY reach.rid) USING (rid)
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP11_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_OP11_TERMS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS iid, item_id, {_OP11_TERMS} AS w FROM benchmark),
a AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, term, n, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), a),
q AS (SELECT iid, item_id, term, count(*) AS c FROM (SELECT iid, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), a GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

OP12_SQL = f"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_OP5_WORDS} AS w FROM documents),
b AS (SELECT {_OP5_WORDS} AS w FROM benchmark),
words AS (SELECT DISTINCT word, string_split(regexp_replace(hex(encode(word)), '(..)', '\\1 ', 'g'), ' ') AS bytes FROM (SELECT unnest(w) AS word FROM d UNION ALL SELECT unnest(w) FROM b)),
h AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || x AS BIGINT) FOR x IN bytes IF x <> '']), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 10000 AS bucket FROM words, crc),
dw AS (SELECT rid, bucket FROM (SELECT rid, unnest(w) AS word FROM d) JOIN h USING (word)),
s AS (SELECT bucket, count(*) AS s FROM dw GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN h USING (word) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS big_t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS gain, count(*) AS n FROM dw JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight,
        CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u FROM d LEFT JOIN m USING (rid)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (words >= 20) OVER () AS n_long FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN words >= 20 AND place <= 10 * n_long // 100 THEN place END AS rank FROM z
"""

OP13_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AS odd, len(list_filter(embedding, lambda x: x <> 0)) AS held FROM embeddings),
n AS (SELECT rid, v, sqrt(list_inner_product(v, v)) AS n FROM d WHERE odd = 0 AND held > 0),
l AS (SELECT a.rid AS x, b.rid AS y FROM n a JOIN n b ON a.rid < b.rid AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT x AS rid, count(*) AS n_links FROM e GROUP BY x),
reach AS (SELECT x AS rid, x AS y FROM e UNION SELECT reach.rid, e.y FROM reach JOIN e ON e.x = reach.y),
m AS (SELECT reach.rid, min(vec_id) AS least_id FROM reach JOIN d ON d.rid = reach.y GROUP BY reach.rid)
SELECT vec_id, coalesce(n_links, 0) AS n_links, CASE WHEN n_links IS NULL THEN vec_id ELSE least_id END AS component_id, (CASE WHEN n_links IS NULL THEN vec_id ELSE least_id END) IS NOT DISTINCT FROM vec_id AS kept
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op3_chat_format": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op9_top_k": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_importance": OP12_SQL, "op13_near_vectors": OP13_SQL}
