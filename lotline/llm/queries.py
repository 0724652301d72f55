"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, convtrie, langid, lexical, lm, media, packing, quality, rules, sharding, simhash, suffix, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_rest(k: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(labels.where(crc_rest(5) != 0), docs)
    return quality.score(docs, model, ["doc_id"]).select("doc_id", (crc_rest(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), max_bits=4, words_per_shingle=4)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.find_repeats(table(spark, sf_dir, "documents"), ["doc_id"], "doc_id", length=400, want_text=True).withColumnRenamed("kept", "text")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.lm_scores(docs, crc_rest(7) != 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_rest(4) != 2), "text", "lang")
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", (crc_rest(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_digest(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return placed.select("doc_id", "slot", "shard", F.octet_length(text).cast("bigint").alias("n_bytes"), F.md5(text).alias("text_md5"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.apply_rules(docs, labels, holdout=crc_rest(5) >= 2, stratum=F.col("lang"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.prefix_trie(table(spark, sf_dir, "conversations"))


TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT CAST(count(*) FILTER (len(words) > 0) AS BIGINT) AS n_docs, CAST(coalesce(sum(len(words)), 0) AS BIGINT) AS n_words FROM d),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT i.item_id, d.doc_id, p.r, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * len(d.words) * c.n_docs) // c.n_words)))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY i.item_id, d.doc_id, p.r),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50"""


def _rules_sql() -> str:
    levels = " UNION ALL ".join(f"SELECT {i} AS level, {x} AS share" for i, x in enumerate(rules.LEVELS))
    a = rules.ALPHA
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT r, j, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
      FROM (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS j FROM d) WINDOW o AS (PARTITION BY r ORDER BY j)),
e AS (SELECT r, j FROM (SELECT r, j, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) AS c FROM t WHERE w4 IS NOT NULL) WHERE c > 1),
x AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(j, j + 5)) AS p FROM e) GROUP BY r),
l AS (SELECT r, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
      FROM (SELECT r, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM d)),
m AS (SELECT d.r, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda y: len(y))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS marks
      FROM d JOIN l USING (r) LEFT JOIN x USING (r)),
f AS (SELECT r, doc_id, lang AS stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             list_transform([[1000 * n_symbols, word_chars], [1000 * upper, word_chars], [1000 * digits, word_chars], [1000 * marks, word_chars], [1000 * n_dup_lines, n_lines], [1000 * n_repeat_words, n_words], [50 * word_chars, n_words]],
                            lambda y: least(1000, y[1] // greatest(1, y[2]))) AS s FROM m),
v AS (SELECT * EXCLUDE (s), list_append(s, 1000 - s[7]) AS stats FROM f),
y AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality) AND min(quality) IN (0, 1)),
b AS (SELECT z.stratum, z.stats, quality = 1 AS good, h.crc % 5 >= 2 AS holdout
      FROM (SELECT doc_id, min({{'stratum': stratum, 'stats': stats}}) AS z FROM v WHERE NOT base_failed GROUP BY doc_id) JOIN y USING (doc_id)
      JOIN (SELECT DISTINCT doc_id, {CRC_SQL.format("doc_id")} AS crc FROM labels) h USING (doc_id)),
levels AS ({levels}),
q AS (SELECT stratum, rule, value, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM (SELECT stratum, good, unnest(range(8)) AS rule, unnest(stats) AS value FROM b WHERE NOT holdout) GROUP BY ALL),
k AS (SELECT *, coalesce(sum(good) OVER u, 0) AS good_above, coalesce(sum(bad) OVER u, 0) AS bad_above, sum(good) OVER a AS good_all, sum(bad) OVER a AS bad_all FROM q
      WINDOW a AS (PARTITION BY stratum, rule), u AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT stratum, level, rule, arg_min(good_above, value) AS ga, arg_min(bad_above, value) AS ba, min(value) + 1 AS cutoff, min(good_all) AS gt, min(bad_all) AS bt
      FROM k, levels WHERE good > 0 AND 1000 * good_above <= share * good_all GROUP BY stratum, level, rule),
c AS (SELECT stratum, level, list({{'rule': rule, 'cutoff': cutoff}}) AS cutoffs FROM g WHERE ba * gt > ga * bt GROUP BY stratum, level),
p AS (SELECT b.stratum, levels.level, good, holdout, coalesce(len(list_filter(cutoffs, lambda z: b.stats[z.rule + 1] >= z.cutoff)) > 0, false) AS hit
      FROM b CROSS JOIN levels LEFT JOIN c ON c.stratum IS NOT DISTINCT FROM b.stratum AND c.level = levels.level),
n AS (SELECT stratum, level, count(*) FILTER (good AND holdout) AS n, count(*) FILTER (good AND holdout AND hit) AS k,
             count(*) FILTER (NOT good AND NOT holdout AND hit) * count(*) FILTER (good AND NOT holdout) - count(*) FILTER (good AND NOT holdout AND hit) * count(*) FILTER (NOT good AND NOT holdout) AS gain
      FROM p GROUP BY stratum, level HAVING count(*) FILTER (good AND holdout) > 0),
o AS (SELECT *, k <= {a} * n AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a})))) <= {rules.DELTA} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM n)) AS passes FROM n),
w AS (SELECT stratum, level FROM (SELECT *, bool_and(passes) OVER (PARTITION BY stratum ORDER BY level) AS so_far FROM o) WHERE so_far AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, level) = 1),
a AS (SELECT c.stratum, c.cutoffs FROM c JOIN w ON w.stratum IS NOT DISTINCT FROM c.stratum AND w.level = c.level)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(len(list_filter(a.cutoffs, lambda z: v.stats[z.rule + 1] >= z.cutoff)) > 0, false) AS kept
FROM v LEFT JOIN a ON a.stratum IS NOT DISTINCT FROM v.stratum"""


CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST({0} AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST({0} AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

TRIE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS own FROM t GROUP BY conv_id),
h AS (SELECT *, {crc} % 4 AS h FROM c),
f AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
r AS (SELECT conv_id, d AS depth, d = len(turns) AS is_end, md5(CAST(to_json(list_slice(turns, 1, d)) AS VARCHAR)) AS k,
             CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) END AS words
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM f)),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM r GROUP BY depth, k),
u AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN r ON r.conv_id = n.conv_id AND r.depth = n.depth - 1 LEFT JOIN n p ON p.depth = r.depth AND p.k = r.k),
m AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
w AS (SELECT u.*, coalesce(m.n_children, 0) AS n_children FROM u LEFT JOIN m ON m.parent_conv_id = u.conv_id AND m.depth = u.depth),
s AS (SELECT r.depth, r.k, sum((w.n_convs - 1) * w.words) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
      FROM w JOIN r ON r.conv_id = w.conv_id AND r.depth <= w.depth GROUP BY r.depth, r.k)
SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256 FROM w JOIN s USING (depth, k)""".replace("{crc}", CRC_SQL.format("conv_id"))


def _sharding_sql() -> str:
    table = sharding.fill(sharding.shard_names(sharding.SHARDS))
    return f"""
WITH keyed AS (SELECT doc_id, coalesce(text, '') AS text, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(list_extract({table.tolist()}, CAST(slot AS BIGINT) + 1) AS INTEGER) AS shard,
       CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM keyed"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_best_fit_packing, op3_byte_bpe, op4_exact_topk, op5_simhash_dedup, op6_suffix_dedup, op7_lm_scoring, op8_language_id, op9_media_columns, op10_sharding, op11_ranked_search, op12_quality_rules, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": TOPK_SQL, "op10_sharding": _sharding_sql(), "op11_ranked_search": SEARCH_SQL, "op12_quality_rules": _rules_sql(), "op13_conversation_trie": TRIE_SQL}
