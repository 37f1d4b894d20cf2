"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import chat, language, pii, secrets, trie
from gneiss.llm.audit import audit
from gneiss.llm.common import table
from gneiss.llm.decontam import contamination
from gneiss.llm.mixing import mix
from gneiss.llm.multiindex import near_vectors
from gneiss.llm.sharding import shard_rows
from gneiss.llm.simhash import simhash_groups
from gneiss.llm.substring import remove_repeated
from gneiss.llm.suffixes import remove_repeated_bytes


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"), with_text=False)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language.fit(docs.where(~held_out()))
    found = language.identify(docs.select("doc_id", "text"), filters, ["doc_id"])
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "longest",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 24)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key="gneiss")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-7L", "id", "if(id = 0, 'user', 'assistant')", "'</s>[INST] ok [/INST]'")
    return chat.digests(chat.format_chats(rows.union(more)))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.concat("base", "added")).alias("spans"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("row.doc_id", "row.source", "copy", "shuffle_key")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = trie.rebuilt(trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, ids).drop("turn_name")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_multi_index": op6_multi_index,
    "op7_chat_format": op7_chat_format,
    "op8_secret_scan": op8_secret_scan,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_suffix_dedup": op13_suffix_dedup,
}

OP9_SQL = """
WITH counts AS (SELECT source, count(*) AS n, pow(count(*), 0.7) AS w FROM documents GROUP BY source),
rates AS (
  SELECT source, w / (SELECT sum(w) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts
),
parts AS (SELECT source, greatest(1, ceil(rate / 32))::INT AS parts, rate / greatest(1, ceil(rate / 32)) AS mean FROM rates),
cdf AS (
  SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, mean, unnest(range(ceil(mean + 12 * sqrt(mean) + 20)::INT + 1)) AS k FROM parts)
),
tables AS (SELECT p.source, p.parts, list(c.c ORDER BY c.k) AS cdf FROM parts p JOIN cdf c ON p.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
counted AS (
  SELECT d.doc_id, d.source,
    list_sum([len(list_filter(t.cdf, lambda c: c <= ('0x' || substr(md5('0:' || j || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0)) FOR j IN range(1, t.parts + 1)]) AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, copy::INT AS copy, md5('0 shuffle:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(1, n::BIGINT + 1)) AS copy FROM counted WHERE n > 0)
"""

_ESCAPE = "replace({}, '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPE = f"replace({_ESCAPE}, '{_c}', '{_c[0]}\\{_c[1:]}')"
OP7_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}) + {len(chat.TURN + chat.TEXT + chat.END)})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows JOIN again USING (h)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM words WHERE NOT EXISTS (FROM gone g WHERE g.r = words.r AND g.p = words.p) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""

_FOLDED = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_FOLDED} AS w FROM documents),
items AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), found AS (
  SELECT r, i, x.n, item_id FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM tests))) x JOIN tests USING (t, n)
), hits AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r),
runs AS (  -- of one item along one diagonal, the longest verbatim match
  SELECT r, max(m) AS longest FROM (
    SELECT r, item_id, max(i + n) - min(i) AS m FROM (
      SELECT *, i - row_number() OVER (PARTITION BY r, item_id, o - i ORDER BY i) AS g FROM (
        SELECT f.r, f.item_id, f.i, f.n, o.o FROM found f JOIN (
          SELECT item_id, n, o, array_to_string(w[o:o + n - 1], ' ') AS t FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS o FROM items WHERE len(w) > 0)
        ) o ON o.item_id = f.item_id AND o.n = f.n JOIN d ON d.r = f.r AND array_to_string(d.w[f.i:f.i + f.n - 1], ' ') = o.t))
    GROUP BY r, item_id, o - i, g) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::INT AS longest
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN runs USING (r)
"""

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id, vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept
FROM embeddings
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, good, bad,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
  FROM w JOIN first USING (t) LEFT JOIN marks USING (doc_id)
), counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (bad = 1) AS bad FROM judged GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, (1 << (ascii(substr(filter_order, step, 1)) - 65)) AS bit,
    coalesce(list_sum([1 << (ascii(substr(filter_order, k, 1)) - 65) FOR k IN range(1, step)]), 0)::BIGINT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), each AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM each
"""

OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295::UBIGINT], [ascii(x)::UBIGINT FOR x IN string_split(c::VARCHAR, '')]),
    lambda crc, x: list_reduce(list_concat([xor(crc, x)], list_resize([]::UBIGINT[], 8, 0::UBIGINT)),
      lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)
), joined AS (
  SELECT i.c, 0 AS own, b.t, b.role, b.text FROM ids i JOIN turns b ON b.c = i.base AND b.t <= i.h
  UNION ALL SELECT i.c, 1, o.t, o.role, o.text FROM ids i JOIN turns o ON o.c = i.c AND o.t > i.h
), placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, t) AS d FROM joined),
paths AS (
  SELECT c, d, text, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM placed
  UNION ALL SELECT c, 0, '', '' FROM ids
), nodes AS (SELECT d, k, min(c) AS c, count(*) AS n, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words FROM paths GROUP BY d, k),
up AS (SELECT n.*, m.c AS parent, m.k AS above FROM nodes n LEFT JOIN paths p ON p.c = n.c AND p.d = n.d - 1 LEFT JOIN nodes m ON m.d = p.d AND m.k = p.k),
children AS (SELECT d - 1 AS d, above AS k, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM up u LEFT JOIN children USING (d, k)),
trees AS (
  SELECT p.d, p.k, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n - 1) * u.words) AS saved FROM full_ u JOIN paths p ON p.c = u.c AND p.d <= u.d GROUP BY ALL
), ends AS (SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM paths GROUP BY c) JOIN paths USING (c, d) GROUP BY ALL)
SELECT u.c AS conv_id, u.d::BIGINT AS depth, u.parent AS parent_conv_id, u.n AS n_convs, u.n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_ u JOIN trees t USING (d, k) LEFT JOIN ends USING (d, k)
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS t FROM documents),
pieces AS (SELECT r, o, substr(t, 2 * o + 1, 910) AS t FROM (SELECT r, t, unnest(range(0, greatest(length(t) // 2 - 199, 0), 256)) AS o FROM d)),
strings AS (SELECT r, o + i AS i, md5(substr(t, 2 * i + 1, 400)) AS h FROM (SELECT r, o, t, unnest(range(0, length(t) // 2 - 199)) AS i FROM pieces)),
again AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
found AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 200, -1) AS new FROM strings JOIN again USING (h)),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM found) GROUP BY r, k),
whole AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n FROM spans GROUP BY r)
SELECT doc_id, (length(t) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN t ELSE array_to_string([
    substr(t, (2 * CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END + 1)::BIGINT, (2 * (CASE WHEN k > len(a) THEN length(t) // 2 ELSE a[k] END - CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END))::BIGINT) FOR k IN range(1, len(a) + 2)], '') END)) AS kept_sha256
FROM d LEFT JOIN whole USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op13_suffix_dedup": OP13_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op1_substring_dedup": OP1_SQL,
    "op3_decontamination": OP3_SQL,
    "op6_multi_index": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op9_mixing": OP9_SQL,
}
