"""Registered queries opN_ over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, decontaminate, html, language, licenses, lm, pieces, sharding, simhash, suffixes, toxicity, trie, variants
from .common import held_out, read

SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Placement of every document on one of 32 shards, by doc_id."""
    docs = read(spark, folder, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", sharding.placement_table(spark, SHARDS)).select("doc_id", "slot", "shard")


OP1_SQL = f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM range({len(SHARDS)}) r(i)),
orders AS (
  SELECT list(CAST(('0x' || substr(md5('offset:' || name), 1, 15)) AS BIGINT) % {sharding.TABLE_SIZE} ORDER BY i) AS starts,
         list(CAST(('0x' || substr(md5('skip:' || name), 1, 15)) AS BIGINT) % {sharding.TABLE_SIZE - 1} + 1 ORDER BY i) AS inverses
  FROM names),
fill AS (
  SELECT 0 AS turn, CAST(-1 AS BIGINT) AS claimed, range({sharding.TABLE_SIZE}) AS free
  UNION ALL
  SELECT turn + 1, c, list_filter(free, lambda s: s <> c)
  FROM (SELECT turn, free, list_min(list_transform(free, lambda s:
               (((s - starts[turn % {len(SHARDS)} + 1]) * inverses[turn % {len(SHARDS)} + 1]) % {sharding.TABLE_SIZE} + {sharding.TABLE_SIZE})
               % {sharding.TABLE_SIZE} * {sharding.TABLE_SIZE} + s)) % {sharding.TABLE_SIZE} AS c
        FROM fill, orders WHERE turn < {sharding.TABLE_SIZE}) t),
slots AS (SELECT claimed AS slot, name AS shard FROM fill JOIN names ON i = (turn - 1) % {len(SHARDS)} WHERE turn > 0)
SELECT doc_id, CAST(d.slot AS INTEGER) AS slot, shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {sharding.TABLE_SIZE} AS slot FROM documents) d
JOIN slots USING (slot)
"""


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.groups(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = decontaminate.scan(read(spark, folder, "documents"), read(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _words_sql(table: str, key: str) -> str:
    return (f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}")


OP3_SQL = f"""
WITH d AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}),
grams AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) t),
lengths AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n) t),
hits AS (SELECT doc_id, windows.n, i, item FROM windows JOIN grams USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) t GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows whose remainder modulo 4 is not 2."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read(spark, folder, "labels"), toxicity.trainable())
    found = toxicity.score(docs, model, ["doc_id"])
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "n_sentences", F.size("offending").cast("bigint").alias("n_offending"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and detections of every document."""
    found = licenses.scan(read(spark, folder, "documents"), ["doc_id"])
    words = F.col("places.word")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from rows whose remainder modulo 3 is not 1."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    field = language.learn(docs, language.trainable())
    return language.predict(docs, field, ["doc_id"]).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract(read(spark, folder, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests; ``n_bytes`` is the source the pieces cover."""
    found = pieces.encode(read(spark, folder, "documents"), model_path(), ["doc_id"])
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.coalesce(F.array_max("ends"), F.lit(0)).cast("bigint").alias("n_bytes"))


def op9_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document, learned from those whose remainder modulo 7 is not 2."""
    found = lm.score_documents(read(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the passages of earlier ones, as digests."""
    found = suffixes.deduplicate(read(spark, folder, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
places AS (SELECT doc_id, i, x[i + 1 : i + {suffixes.LENGTH}] AS s FROM (SELECT doc_id, x, unnest(range(octet_length(x) - {suffixes.LENGTH - 1})) AS i FROM texts) t),
firsts AS (SELECT s, min(doc_id) AS first FROM places GROUP BY s),
hits AS (SELECT doc_id, i FROM places JOIN firsts USING (s) WHERE first < doc_id),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + {suffixes.LENGTH} AS b
  FROM (SELECT doc_id, i, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {suffixes.LENGTH} THEN 0 ELSE 1 END AS gap FROM hits) t) t
  GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, hex(x[coalesce(lag(b) OVER w, 0) + 1 : a]) AS piece, a, b
  FROM runs JOIN texts USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS pieces, max(b) AS last, sum(b - a) AS gone, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(pieces, '')) || x[coalesce(last, 0) + 1 :]) AS kept_sha256
FROM texts LEFT JOIN joined USING (doc_id)
"""


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, with subtree totals."""
    return trie.trie(read(spark, folder, "conversations"))


#: Rows of the table of the CRC-32 polynomial, and the unsigned sum of a list of bytes by it.
_CRC_SQL = """crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)) x)"""


def _crc_of(bytes_sql: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_sql}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


_DIGITS_SQL = "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: unicode(x)::BIGINT)"

OP13_SQL = rf"""
WITH {_CRC_SQL},
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, {_crc_of(_DIGITS_SQL)} % 4 AS h FROM (SELECT DISTINCT c FROM own) x, crc),
turns AS (
  SELECT heads.c, 0 AS part, p, {{'r': r, 't': t}} AS turn FROM heads JOIN own o ON o.c = heads.c - heads.c % 20 AND p <= h
  UNION ALL SELECT own.c, 1, p, {{'r': r, 't': t}} FROM own JOIN heads USING (c) WHERE p > h),
convs AS (SELECT c, coalesce(s, []) AS s FROM heads LEFT JOIN (SELECT c, list(turn ORDER BY part, p) AS s FROM turns GROUP BY c) x USING (c)),
nodes AS (
  SELECT s[1 : d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256
  FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM convs) x GROUP BY s[1 : d], d),
kids AS (SELECT k[1 : d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY k[1 : d - 1], d - 1),
figures AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children,
         CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(nodes.k[d].t, '[^ 	-
]+')) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids USING (k, d)),
sums AS (
  SELECT k[1 : e] AS k, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM figures) x GROUP BY k[1 : e], e)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM figures f JOIN sums USING (k, d) LEFT JOIN nodes up ON up.d = f.d - 1 AND up.k = f.k[1 : f.d - 1]
"""


def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return variants.group(read(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


_POINTS_SQL = "flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))"

OP11_SQL = rf"""
WITH RECURSIVE {_CRC_SQL},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {variants.LEAST_POINTS} GROUP BY id, run),
summed AS (SELECT run, n, {_crc_of(_POINTS_SQL.format("id || run"))} AS h FROM counted, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {variants.DROPPED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed) x
  WHERE length(word) >= {variants.LEAST_POINTS} GROUP BY word HAVING sum(n) >= {variants.LEAST_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words) x),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM pairs GROUP BY word),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {variants.RATIO} * words.n THEN form END AS form,
         CASE WHEN form_n >= {variants.RATIO} * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS step FROM formed
  UNION ALL SELECT follow.word, formed.form FROM follow JOIN formed ON formed.word = follow.step WHERE formed.form IS NOT NULL)
SELECT f.word, form, step AS root, n, n_near, form_n
FROM formed f JOIN follow ON follow.word = f.word JOIN (SELECT word AS last FROM formed WHERE form IS NULL) x ON last = step
"""


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_simhash, op3_decontamination, op4_toxicity, op5_licenses, op6_language, op7_pieces, op8_html, op9_lm, op10_ann, op11_variants, op12_suffixes, op13_trie)}
ORACLE = {"op1_sharding": OP1_SQL, "op3_decontamination": OP3_SQL, "op11_variants": OP11_SQL, "op12_suffixes": OP12_SQL, "op13_trie": OP13_SQL}
