"""One query per operator, each over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sealcheck.llm import language, leaks, lines, minhash, mixing, nearest, ngrams, phrases, pii, suffix, threads, vectors, warc
from sealcheck.llm.common import held_out
from sealcheck.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    """Register a function of one table's rows under its own name."""
    def register(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(configure(spark).read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


@query("documents")
def op1_language_id(documents):
    told = language.predict_languages(documents)
    return told.select("doc_id", held_out(5).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("documents")
def op2_line_dedup(documents):
    return lines.near_lines(documents, min_chars=1).select("doc_id", "line_no", "class_doc", "class_line", "n_links", "kept")


@query("documents")
def op3_mix_sources(documents):
    return mixing.mix(documents).select("doc_id", "source", "mix_slot", "mix_release", "mix_deadline", "mix_position")


@query("documents")
def op4_personal_data(documents):
    found = pii.find_personal_data(documents)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
                        pii.span_text(F.concat("base", "terms")).alias("spans"))


@query("documents")
def op6_suffix_dedup(documents):
    found = suffix.remove_repeats(documents)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("embeddings")
def op7_vector_dedup(embeddings):
    return vectors.similar_vectors(embeddings)


@query("documents")
def op9_lm_score(documents):
    return ngrams.score_texts(documents)


@query("documents")
def op10_minhash_dedup(documents):
    return minhash.near_duplicates(documents).select("doc_id", "class_id", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = configure(spark).read
    found = leaks.find_leaks(read.parquet(f"{sf_dir}/documents.parquet"), read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "share", "first_word", "last_word")


QUERIES["op8_decontaminate"] = op8_decontaminate


DAMAGE = "substr(md5(CAST(page_id AS STRING)), 1, 2)"
RECORD = ("concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), "
          "'Content-Length: ', CAST({bytes} AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce({html}, ''), chr(13), chr(10), chr(13), chr(10))")


@query("pages", f"""
WITH a AS (SELECT page_id, sha256({RECORD.format(bytes="octet_length(encode(coalesce(html, '')))", html='html')}) AS digest FROM pages),
 b AS (SELECT page_id, sha256({RECORD.format(bytes="octet_length(encode(coalesce(html, '')))", html="CASE WHEN d = '0b' THEN concat(html, '!') ELSE html END")}) AS digest
  FROM (SELECT *, {DAMAGE.replace('STRING', 'VARCHAR')} AS d FROM pages) WHERE d IS DISTINCT FROM '1c'),
 x AS (SELECT page_id, digest, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT page_id, digest, count(*) AS n FROM b GROUP BY ALL)
SELECT page_id, digest, coalesce(x.n, 0) AS n_primary, coalesce(y.n, 0) AS n_replica, page_id >> 6 << 6 AS range_start,
 (page_id >> 6 << 6) + 64 AS range_end FROM x FULL JOIN y USING (page_id, digest) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def op5_warc_fixity(pages):
    """The replica lost the pages whose id hashes to 1c and has one byte too many in those with 0b."""
    record = warc.warc_record("url", "html")
    damage = F.expr(DAMAGE)
    replica = pages.filter(~damage.eqNullSafe(F.lit("1c"))).select(
        F.col("page_id").alias("position"), F.when(damage == "0b", F.regexp_replace(record, "\r\n\r\n\\z", "!\r\n\r\n")).otherwise(record).alias("record"))
    found = warc.fixity_audit(pages.select(F.col("page_id").alias("position"), record.alias("record")), replica)
    return found.withColumnRenamed("position", "page_id")


# Spark's crc32, bit by bit over the digits of a number.
CRC = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda s, c: "
       "list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295::BIGINT)")


@query("conversations", f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS p,
  struct_pack(role := role, text := text) AS said FROM said),
 convs AS (SELECT conv_id, {CRC.format('conv_id')} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM said)),
 parts AS (SELECT c.conv_id, 0 AS own, p, said FROM convs c JOIN numbered n ON n.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, said FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND p > h),
 built AS (SELECT c.conv_id, coalesce(list(said ORDER BY own, p) FILTER (p IS NOT NULL), []) AS path FROM convs c LEFT JOIN parts USING (conv_id) GROUP BY c.conv_id),
 opened AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM built),
 nodes AS (SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends FROM opened GROUP BY ALL),
 valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
  CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL) c USING (node)),
 below AS (SELECT node[1:d] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM valued) GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN below USING (node) LEFT JOIN nodes p ON v.depth > 0 AND p.node = v.node[1:v.depth - 1]""")
def op11_prefix_trie(conversations):
    return threads.prefix_tree(threads.regraft(threads.turns(conversations))).drop("turn_id")


@query("documents", """
WITH RECURSIVE pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
 places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
 grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS gram, count(*) AS f FROM places, range(1, 4) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
 words AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
 often AS (SELECT *, string_split(gram, ' ') AS w FROM grams WHERE f >= 10),
 cuts AS (SELECT c.lang, c.gram, c.k, c.f AS a, x.k AS cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM often c JOIN often x ON c.lang = x.lang AND x.k < c.k AND x.gram = array_to_string(c.w[1:x.k], ' ')
  JOIN often y ON c.lang = y.lang AND y.k = c.k - x.k AND y.gram = array_to_string(c.w[x.k + 1:], ' ') WHERE c.k > 1),
 beside AS (SELECT lang, array_to_string(w[1:2], ' ') AS gram, f, TRUE AS out FROM often WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f, FALSE FROM often WHERE k = 3),
 near AS (SELECT lang, gram, max(f) FILTER (out) AS most_out, max(f) FILTER (NOT out) AS most_in FROM beside GROUP BY ALL),
 best AS (SELECT DISTINCT ON (lang, gram) c.* FROM cuts c LEFT JOIN near USING (lang, gram)
  WHERE k = 3 OR 50 * a > 100 * coalesce(greatest(most_out, most_in), 0) ORDER BY score, cut),
 links AS (SELECT x.lang, x.gram AS "from", y.gram AS "to" FROM often x JOIN often y ON x.k = 3 AND y.k = 3 AND x.lang = y.lang AND x.w[2:3] = y.w[1:2]
  JOIN often m ON m.k = 2 AND m.lang = x.lang AND m.w = x.w[2:3] AND m.f = x.f AND m.f = y.f),
 walk AS (SELECT lang, gram AS origin, gram AS ahead, gram AS behind FROM often WHERE k = 3
  UNION ALL SELECT w.lang, origin, a."to", b."from" FROM walk w LEFT JOIN links a ON a.lang = w.lang AND a."from" = w.ahead LEFT JOIN links b ON b.lang = w.lang AND b."to" = w.behind
  WHERE a."to" IS NOT NULL OR b."from" IS NOT NULL),
 path AS (SELECT lang, origin AS gram, count(ahead) + count(behind) + 1 AS path_words FROM walk GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM best)
SELECT lang, rank, gram AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, coalesce(path_words, k) AS path_words
FROM ranked JOIN words USING (lang) LEFT JOIN path USING (lang, gram) WHERE rank <= 2000""")
def op12_phrases(documents):
    return phrases.mine_phrases(documents)


@query("embeddings")
def op13_nearest_vectors(embeddings):
    return nearest.nearest(embeddings)
