"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm import (
    chat,
    clusters,
    decontamination,
    embeddings,
    language,
    lines,
    near_dup,
    packing,
    phrases,
    quality,
    repeats,
    sharding,
    url_filter,
)
from repograph.llm.learning import held_out
from repograph.llm.tables import table

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
SHARD_BYTES = 1 << 20


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(*map(F.lit, rule)) for rule in URL_RULES])
    rules = spark.range(1).select(F.inline(rows)).toDF("verdict", "host", "path")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.predict(documents.select("doc_id", "text"), language.learn(documents))
    return found.select(
        "record.doc_id", held_out(F.col("record.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    turns = F.array(*[F.struct(F.lit(-1), F.lit(i), F.lit(role), said) for i, role in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.inline(turns)).toDF("conv_id", "turn", "role", "text")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(conversations.unionByName(extra)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.learn(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 2)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("record.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(
        table(spark, sf_dir, "documents"), F.col("doc_id"), F.octet_length("text"), SHARD_BYTES, ["doc_id"])


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("record.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)),
rules(verdict, rule_host, rule_path) AS (VALUES %s),
fits AS (
  SELECT u.page_id, u.host, u.path, r.verdict, r.rule_host || r.rule_path AS rule,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
""" % ", ".join(str(rule) for rule in URL_RULES)

# Components by following links from every node.
REACH = """reach(start, node) AS (
  SELECT id, id FROM nodes UNION SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.node),
components AS (SELECT start AS id, min(node) AS component_id FROM reach GROUP BY start)"""

OP4_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (
  SELECT * FROM nodes WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id <> b.id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
{REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM links WHERE a = n.id) AS n_links, component_id,
  component_id = n.id AS kept
FROM nodes n JOIN components USING (id)
"""

OP7_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
nodes AS (SELECT id FROM words),
shingles AS MATERIALIZED (
  SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS shingle
  FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) > 1)
  UNION ALL SELECT id, w[1] FROM words WHERE len(w) = 1),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (
  SELECT a.id AS a, b.id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.id <> b.id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common c JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
{REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = id AS kept
FROM nodes JOIN components USING (id) LEFT JOIN sizes USING (id)
"""

OP8_SQL = """
WITH texts AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
-- Parts of 200 starts, because a substring is searched for from the start of its string.
parts AS (
  SELECT doc_id, base, n, substr(h, 2 * base + 1, 498) AS part
  FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 200)) AS base FROM texts WHERE n >= 50)),
starts AS MATERIALIZED (
  SELECT doc_id, base + i AS i, md5_number(substr(part, 2 * i + 1, 100)) AS s
  FROM (SELECT doc_id, base, part, unnest(range(0, least(200, n - 49 - base))) AS i FROM parts)),
first_seen AS (SELECT s, min(doc_id) AS least FROM starts GROUP BY s),
found AS (SELECT doc_id, i FROM starts JOIN first_seen USING (s) WHERE least < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh
  FROM found),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, string_agg(substr(h, 2 * p.a + 1, 2 * (coalesce(p.b, n) - p.a)), '' ORDER BY p.a) AS h
  FROM pieces p JOIN texts t ON t.doc_id = p.doc_id GROUP BY p.doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN sums USING (doc_id) LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, role)),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    length(regexp_replace(replace(role, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]', '\0.', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]', '\0.', 'g'))
    + length('<s>[INST]  [/INST] </s>') + 1 AS chars
  FROM turns),
said AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learnt
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM said
"""

OP10_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
prefixes AS (
  SELECT doc_id, n_bytes, d.depth, substr(bits, 1, d.depth) AS shard
  FROM hashed, (SELECT unnest(range(0, 61))::INTEGER AS depth) d),
fitting AS (
  SELECT depth, shard FROM prefixes GROUP BY depth, shard
  HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
placed AS (
  SELECT p.doc_id, p.n_bytes, p.depth, p.shard,
    row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS place
  FROM prefixes p JOIN fitting USING (depth, shard))
SELECT doc_id, shard, depth, n_bytes, n_bytes > {SHARD_BYTES} AS oversized FROM placed WHERE place = 1
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
said AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
one AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM said) GROUP BY ALL),
two AS MATERIALIZED (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM said) GROUP BY ALL),
three AS MATERIALIZED (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM said) GROUP BY ALL HAVING count(*) >= 10),
longest AS (
  SELECT lang, w1, w2, max(f) AS f
  FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
    LEFT JOIN longest n ON n.lang = t.lang AND n.w1 = t.w1 AND n.w2 = t.w2
  WHERE t.f >= 10 AND 100 * coalesce(n.f, 0) < 50 * t.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1
    JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
    JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP12_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS MATERIALIZED (
  SELECT doc_id, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM parts)),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, i, line, coalesce(doc_id <> keeper, false) AS dropped FROM lines LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _rounds(n: int) -> str:
    """Rounds of assignment and means."""

    return "".join(f"""
near{i} AS MATERIALIZED (
  SELECT k.vec_id, any_value(k.v) AS v, min({{'d': list_sum(list_transform(list_zip(k.v, c.v),
      lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS best
  FROM kept k, centroids{i} c GROUP BY k.vec_id),
sums{i} AS (
  SELECT c, place, sum(x)::HUGEINT AS s, count(*) AS n
  FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{i}) GROUP BY c, place),
centroids{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM centroids{i} o LEFT JOIN (
    SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY place) AS v FROM sums{i} GROUP BY c) m USING (c)),"""
                   for i in range(n))


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8),{_rounds(11)}
ended AS (SELECT vec_id, best.c AS cluster, best.d AS distance FROM near10)
SELECT vec_id, cluster::INTEGER AS cluster, distance,
  sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM ended JOIN centroids10 c ON c.c = cluster
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_language": op3_language,
    "op4_embeddings": op4_embeddings,
    "op5_chat": op5_chat,
    "op6_packing": op6_packing,
    "op7_near_dup": op7_near_dup,
    "op8_repeats": op8_repeats,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_phrases": op11_phrases,
    "op12_lines": op12_lines,
    "op13_clusters": op13_clusters,
}
SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op4_embeddings": OP4_SQL,
    "op5_chat": OP5_SQL,
    "op7_near_dup": OP7_SQL,
    "op8_repeats": OP8_SQL,
    "op10_sharding": OP10_SQL,
    "op11_phrases": OP11_SQL,
    "op12_lines": OP12_SQL,
    "op13_clusters": OP13_SQL,
}
