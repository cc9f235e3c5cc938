"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, decontam, embed_dedup, kneser_ney, langid, ngram_join, prefix_trie, quality, secrets, spelling, token_count, topk, url_filter
from .common import crc_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_join.ngram_jaccard_groups(table(spark, sf_dir, "documents"))
    return members.select(
        F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "n_links"
    )


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_join.ngram_jaccard_groups(table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), "n_links", "component_id")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.quality_scores(docs, labels, learn=quality.not_in_fold("id", 5))
    return found.select(
        F.col("id").alias("doc_id"), (crc_bucket(F.col("id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, back="bytes")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.trained(docs.where(crc_bucket(F.col("doc_id"), 7) != 2))
    found = kneser_ney.scored(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), (crc_bucket(F.col("id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda x: F.array_join(
        F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("findings", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans")
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = token_count.token_counts(table(spark, sf_dir, "documents"), path)
    return found.select(F.col("id").alias("doc_id"), "n_tokens")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identified(docs, docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    return found.select(
        F.col("id").alias("doc_id"), (crc_bucket(F.col("id"), 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(spelling.words_of(F.col("text"), shortest=7)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = spelling.counted(runs.select(F.when(h % 31 == 0, cut).otherwise(F.col("run")).alias("word")))
    return spelling.spelling_variants(words)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    head = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("long")
    return prefix_trie.prefix_trie(*prefix_trie.spliced(turns, conv - conv % 20, head, 3))


#: Documents with a lower quality score are rejected.
KEEP_SCORE = 0.3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op1_ngram_jaccard_links": op1_ngram_jaccard_links,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_prefix_trie": op13_prefix_trie,
}

OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sets sa ON sa.doc_id = p.a JOIN sets sb ON sb.doc_id = p.b
  WHERE 100 * p.i >= 80 * (len(sa.s) + len(sb.s) - p.i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
degree AS (SELECT a, count(*) AS k FROM both_ways GROUP BY a),
reach AS (
  SELECT doc_id AS n, doc_id AS m FROM documents
  UNION
  SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.m) AS component_id, coalesce(any_value(d.k), 0) AS n_links
FROM sets s JOIN reach r ON r.n = s.doc_id LEFT JOIN degree d ON d.a = s.doc_id GROUP BY ALL
"""
OP1_LINKS_SQL = f"SELECT doc_id, n_links, component_id FROM ({OP1_SQL})"

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT vec_id AS n, vec_id AS m FROM v
  UNION
  SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m),
least AS (SELECT n, min(m) AS c FROM reach GROUP BY n),
degree AS (SELECT a, count(*) AS k FROM both_ways GROUP BY a)
SELECT l.n AS vec_id, CAST(coalesce(d.k, 0) AS BIGINT) AS n_links, l.c AS component_id, l.n = l.c AS kept
FROM least l LEFT JOIN degree d ON d.a = l.n
"""

OP4_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
    unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS s
  FROM item WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM lowered, lens WHERE len(w) >= n),
occur AS (
  SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.s = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
hit AS (SELECT doc_id, count(*) AS k FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM occur) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS k, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occur) GROUP BY 1)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.k, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.k, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
  coalesce(h.k, 0) > 0 AND 20 * coalesce(h.k, 0) >= len(w) AS contaminated
FROM lowered l LEFT JOIN hit h USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

_KINDS = [(k, p, g, n) for k, _, p, g, n in secrets.RULES]
OP7_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(
        "SELECT doc_id, '{k}' AS kind, {r} AS rank, {n} AS least, string_split_regex(text, '{p}') AS g, "
        "regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {i}) AS c FROM t".format(
            k=k, r=r, n=n, i=g, p=p.replace("'", "''")
        )
        for r, (k, p, g, n) in enumerate(_KINDS)
    )
    + """),
spans AS (
  SELECT doc_id, kind, rank, least, unnest(list_transform(range(1, len(m) + 1), lambda k: {
    'a': list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0),
    'n': length(m[k]), 'c': length(c[k])})) AS s FROM m WHERE len(m) > 0),
ok AS (
  SELECT doc_id, kind, rank, CAST(s.a AS BIGINT) AS a, kind || ':' || CAST(s.a AS BIGINT) || ':' || CAST(s.a + s.n AS BIGINT) AS t
  FROM spans WHERE s.c >= least),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(t, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
    string_agg(t, ',' ORDER BY a, rank) AS spans
  FROM ok GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN found f ON f.doc_id = t.doc_id
"""
)

_FIT = """least(greatest(1 / ((q - x) / y) - 1, 0.5), 1000.0)"""
_LEVEL = """
{name}_g AS (SELECT c.{name}, any_value(a.a / (a.a + a.b)) AS p, sum(good) AS good, sum(n) AS n
  FROM counts c JOIN {above} a ON a.{above_key} = c.{above_key} GROUP BY c.{name}),
{name}_w AS (SELECT CASE WHEN y > 0 AND q > x THEN {fit} ELSE 1000.0 END AS w FROM (
  SELECT sum((good - n * p) * (good - n * p)) AS q, sum(n * p * (1 - p)) AS x, sum(n * (n - 1) * p * (1 - p)) AS y
  FROM {name}_g WHERE n > 0)),
{name}_l AS (SELECT {name}, w * p + good AS a, w * (1 - p) + n - good AS b FROM {name}_g, {name}_w)"""
OP10_SQL = (
    r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts),
outcome AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS good FROM ruled),
named AS (
  SELECT *, regexp_replace(host, ':\d*$', '') AS name, array_to_string(string_split(name, '.')[-2:], '.') AS two FROM outcome),
counts AS (
  SELECT host, 1 AS "all", CASE WHEN regexp_matches(name, '{ip}') THEN 'ip' WHEN list_contains({suffixes}, two) THEN two ELSE split_part(name, '.', -1) END AS suffix,
    CASE WHEN regexp_matches(name, '{ip}') THEN name WHEN list_contains({suffixes}, two) THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain,
    CAST(coalesce(sum(good), 0) AS DOUBLE) AS good, CAST(count(good) AS DOUBLE) AS n FROM named GROUP BY ALL),
root AS (SELECT 1 AS "all", sum(good) + 1.0 AS a, sum(n) - sum(good) + 1.0 AS b FROM counts),""".replace(
        "{suffixes}", str(url_filter.SUFFIXES)
    ).replace("{ip}", r"^\d{1,3}(\.\d{1,3}){3}$|^\[[0-9a-f:.]*\]$")
    + ",".join(
        _LEVEL.format(name=n, above=a, above_key=k, fit=_FIT)
        for n, a, k in (("suffix", "root", '"all"'), ("domain", "suffix_l", "suffix"), ("host", "domain_l", "domain"))
    )
    + """
SELECT page_id, o.host, path, rule, CASE WHEN good = 1 THEN 'allow' WHEN good = 0 THEN 'block'
  WHEN a / (a + b) - sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) >= 0.4 THEN 'allow' ELSE 'block' END AS verdict
FROM outcome o JOIN host_l h ON h.host = o.host
"""
)

#: A one-row table with CRC-32's table of remainders, and the CRC-32 of an expression's text by it.
_CRC_TABLE = """crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc)"""
_CRC = """xor(list_reduce(list_transform(range(octet_length(encode({0}))),
    lambda k: CAST('0x' || substr(hex(encode({0})), 2 * k + 1, 2) AS BIGINT)),
    lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295)"""

OP11_SQL = (
    r"""
WITH RECURSIVE """
    + _CRC_TABLE
    + r""",
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents),
lowered AS (
  SELECT concat(doc_id, ':', w) AS named, w FROM (
    SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs WHERE length(r) >= 7)),
hashed AS (SELECT w, """
    + _CRC.format("named")
    + """ AS h FROM lowered, crcs),
changed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON b.word = a.k
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON b.word = a.k),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, list(other ORDER BY n DESC, other)[1] AS other FROM near GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN other END AS form,
    CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
led AS (
  SELECT word, word AS root, form AS next FROM known
  UNION ALL SELECT l.word, k.word, k.form FROM led l JOIN known k ON k.word = l.next)
SELECT k.word, k.form, l.root, k.n, k.n_near, k.form_n FROM known k JOIN led l ON l.word = k.word AND l.next IS NULL
"""
)

OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON (q.vec_id IS DISTINCT FROM c.vec_id OR q.e <> c.e) AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP13_SQL = (
    "WITH "
    + _CRC_TABLE
    + r""",
turns AS (
  SELECT conv_id, {'s': sha256(concat(length(role), ':', role, text)), 'k': len(regexp_extract_all(text, '[^ 	-
]+'))} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, """
    + _CRC.format("CAST(conv_id AS VARCHAR)")
    + """ % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crcs),
spliced AS (
  SELECT c.conv_id, 0 AS own, t.i, t.x FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.x FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
paths AS (
  SELECT c.conv_id, coalesce(p, []) AS p FROM convs c
  LEFT JOIN (SELECT conv_id, list(x ORDER BY own, i) AS p FROM spliced GROUP BY conv_id) s ON s.conv_id = c.conv_id),
members AS (SELECT conv_id, p, unnest(range(len(p) + 1)) AS depth FROM paths),
nodes AS (
  SELECT depth, list_transform(p[1:depth], lambda x: x.s) AS node, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(any_value(p[depth].k), 0) AS tokens, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(p) = depth) AS ends
  FROM members GROUP BY ALL),
children AS (SELECT node[1:depth - 1] AS above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT x.node, sum((y.n - 1) * y.tokens) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes x JOIN nodes y ON y.depth >= x.depth AND y.node[1:x.depth] = x.node LEFT JOIN children c ON c.above = y.node
  GROUP BY x.node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, CASE WHEN x.depth > 0 THEN u.conv_id END AS parent_conv_id, x.n AS n_convs,
  coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x JOIN below b ON b.node = x.node LEFT JOIN children c ON c.above = x.node
LEFT JOIN nodes u ON u.depth = x.depth - 1 AND u.node = x.node[1:x.depth - 1]
"""
)

ORACLE: dict[str, str] = {
    "op11_spelling_variants": OP11_SQL,
    "op12_exact_top_k": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op7_secret_scan": OP7_SQL,
    "op10_url_filter": OP10_SQL,

    "op1_ngram_jaccard_join": OP1_SQL,
    "op1_ngram_jaccard_links": OP1_LINKS_SQL,
    "op2_embedding_near_dedup": OP2_SQL,
}
