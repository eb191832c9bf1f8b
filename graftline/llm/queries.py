"""The registered queries of this subpackage: thin digests of the operators' results."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm import bpe

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.decode(bpe.encode(docs, keep_text=False)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                                  F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.quality_rules import quality_rules

    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.token_counts import count_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs, keep_text=False).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.url_filter import url_filter

    judged = url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as tool traffic: a user turn becomes a call (of two tools, some with wrong arguments) that builds on the user turn
    before, an assistant turn the result of the call just before it; other turns stay as they are."""
    call = """concat('{"tool_calls":[{"name":"', if(turn % 4 < 2, 'search', 'lookup'), '","id":"c', turn, '","arguments":',
        if(turn % 4 < 2, to_json(named_struct('query', text, 'limit', char_length(text) % 60, 'lang', element_at(array('en', 'de', 'fr', 'es', 'xx'), cast(conv_id % 5 + 1 as int)))),
           concat('{"key":', to_json(named_struct('t', text)), ',"exact":', if(turn % 3 = 0, '"yes"', 'true'), '}')), ',"after":"c', turn - 2, '"}]}')"""
    result = "concat('{\"content\":', substr(to_json(named_struct('v', text)), 6, char_length(to_json(named_struct('v', text))) - 6), ',\"tool_call_id\":\"c', turn - 1, '\"}')"
    return conversations.selectExpr("conv_id", "turn", "case role when 'user' then 'assistant' when 'assistant' then 'tool' else role end as role",
                                    f"case role when 'user' then {call} when 'assistant' then {result} else text end as text")


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.chat_format import format_chats

    return format_chats(tool_messages(_table(spark, sf_dir, "conversations")))


ORACLES["op10_chat_format"] = """
WITH u AS (SELECT conv_id, turn, text, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM u),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
args AS (SELECT c.*, turn % 4 < 2 AS is_search, length(text) % 60 AS n, ['en', 'de', 'fr', 'es', 'xx'][conv_id % 5 + 1] AS l FROM c)
SELECT conv_id, turn, 'message' AS kind, NULL::VARCHAR AS call_id, NULL::VARCHAR AS name, 0::BIGINT AS level, turn AS seq_turn, 'plain' AS status, '' AS errors,
       '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS json
FROM conversations WHERE role NOT IN ('user', 'assistant')
UNION ALL
SELECT g.conv_id, g.turn, 'call', 'c' || g.turn, CASE WHEN is_search THEN 'search' ELSE 'lookup' END, level, g.turn, CASE WHEN a.turn IS NULL THEN 'no_result' ELSE 'linked' END,
       CASE WHEN is_search THEN concat_ws(',', CASE WHEN l = 'xx' THEN 'lang:choice' END, CASE WHEN n > 50 THEN 'limit:maximum' END, CASE WHEN n < 1 THEN 'limit:minimum' END, CASE WHEN length(g.text) > 400 THEN 'query:max_length' END)
            ELSE concat_ws(',', CASE WHEN g.turn % 3 = 0 THEN 'exact:type' END, 'key:type') END,
       '{"after":"c' || (g.turn - 2) || '","arguments":' ||
       CASE WHEN is_search THEN '{"lang":"' || l || '","limit":' || n || ',"query":' || to_json(g.text)::VARCHAR || '}'
            ELSE '{"exact":' || CASE WHEN g.turn % 3 = 0 THEN '"yes"' ELSE 'true' END || ',"key":{"t":' || to_json(g.text)::VARCHAR || '}}' END ||
       ',"id":"c' || g.turn || '","name":"' || CASE WHEN is_search THEN 'search' ELSE 'lookup' END || '"}'
FROM args g LEFT JOIN a ON a.conv_id = g.conv_id AND a.turn = g.turn + 1
UNION ALL
SELECT a.conv_id, a.turn, 'result', 'c' || (a.turn - 1), NULL, coalesce(c.level, -1), a.turn, CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END, '',
       '{"content":' || to_json(a.text)::VARCHAR || ',"role":"tool","tool_call_id":"c' || (a.turn - 1) || '"}'
FROM a LEFT JOIN c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1
"""


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.near_dedup import classes

    return classes(_table(spark, sf_dir, "documents"))


@_query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.decontaminate import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the divisor."""
    return F.crc32(F.col(id_col).cast("string")) % divisor


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))
    scored = toxicity.score(docs, _table(spark, sf_dir, "labels"), train=remainder(5) != 0, keep_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm import quality_classifier

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"))
    scored = quality_classifier.score(docs, _table(spark, sf_dir, "labels"), train=remainder(3) != 1, keep_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm import pitman_yor

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(10) == 0, F.lit(False)).alias("held_out"))
    return pitman_yor.score(docs, pitman_yor.fit(docs, remainder(10) != 0), ["doc_id", "held_out"])


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, "vec_id", label, "embedding")


ORACLES["op13_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a JOIN e b ON a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5
"""


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftline.llm.prefix_trie import KEY, end_digests, prefix_trie

    trie = prefix_trie(_table(spark, sf_dir, "conversations"), donor=lambda c: c - c % 100, taken=lambda c: F.crc32(c.cast("string")) % 6, most=5)
    nodes = trie.nodes.join(end_digests(trie.ends), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLES["op12_prefix_trie"] = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS donor, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda s, x: xor(xor(s, x) >> 1, 3988292384::BIGINT * (xor(s, x) & 1))), 4294967295::BIGINT) % 6 AS h FROM ids),
t AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT h.c, list_concat(coalesce(d.ts[1:h], []), o.ts[h + 1:]) AS ts FROM h JOIN t o ON o.c = h.c LEFT JOIN t d ON d.c = h.donor),
p AS (SELECT c, len(ts) AS n, unnest(range(len(ts) + 1)) AS depth, ts FROM r),
k AS (SELECT c, n, depth, ts[1:depth] AS k, CASE WHEN depth > 0 THEN ts[1:depth - 1] END AS up, CASE WHEN depth > 0 THEN length(ts[depth].t) ELSE 0 END AS chars FROM p),
n AS (SELECT k, depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, max(n) = depth AS leaf,
  sha256(coalesce(string_agg(CASE WHEN n = depth THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM k GROUP BY k, depth),
below AS (SELECT k.k, sum(saved)::BIGINT AS saved_tokens, sum(leaf::INT)::BIGINT AS n_leaves FROM (SELECT DISTINCT a.k, b.k AS x FROM k a JOIN k b ON a.c = b.c AND a.depth <= b.depth) k JOIN n ON n.k = k.x GROUP BY k.k)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(m.children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN below USING (k) LEFT JOIN n u ON u.k = n.up AND u.depth = n.depth - 1 LEFT JOIN (SELECT up, count(*) AS children FROM n WHERE depth > 0 GROUP BY up) m ON m.up = n.k
"""
