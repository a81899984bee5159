"""Registered queries of the operators for training text, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convgraph.llm import covertree, hpylm, htmltext, labels, merkle, mixing, packing, quality, secretscan, simhash, sketch, toxicity, urlfilter, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_url_filter", r"""
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
      FROM b JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM b LEFT JOIN m ON b.page_id = m.page_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return d.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer(), carry={"ids_crc32": F.crc32("ids")})


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0)


def scored(df: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return df.select("doc_id", labels.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = labels.training_labels(table(spark, sf_dir, "labels"), "quality")
    return scored(quality.score_documents(table(spark, sf_dir, "documents"), known), 0.5)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = labels.training_labels(table(spark, sf_dir, "labels"), "toxic")
    return scored(toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), known), 0.7)


@query("op7_cover_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query("op8_sketch")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sketch.fingerprints(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch.as_string(F.col("sketch")).alias("fingerprint"),
                    sketch.as_string(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op4_hpylm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(table(spark, sf_dir, "documents"))


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secretscan.scan(docs, secretscan.train(docs)).select("doc_id", F.posexplode("findings").alias("finding", "f"))
    return found.select("doc_id", "finding", "f.start", "f.length", F.sha2("f.found", 256).alias("found_sha256"), "f.score", "f.secret")


#: CRC-32 of a column's UTF-8 bytes, as a fold over them with the table of the reversed polynomial 0xEDB88320.
CRC_TABLE = "crc_table(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: xor(c >> 1, (c & 1) * 3988292384))))"
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0})), 1),
    lambda k: (strpos('0123456789ABCDEF', hex(encode({0}))[2 * k + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(encode({0}))[2 * k + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""


def _leaf_sql(text: str) -> str:
    cols = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in cols) + ")"


@query("op11_merkle", f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('+' || lang, '') AS tag, {_leaf_sql("text")} AS leaf,
             CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                  ELSE {_leaf_sql("text")} END AS tested FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tag) AS m FROM d),
lv(tag, level, pos, digest, m) AS (
  SELECT tag, 0, pos, leaf, m FROM p
  UNION ALL
  SELECT tag, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), max((m + 7) // 8) FROM lv WHERE m > 1 GROUP BY tag, level, pos // 8),
sub AS (SELECT tag, digest, row_number() OVER (ORDER BY encode(tag)) - 1 AS pos, count(*) OVER () AS m FROM lv WHERE m = 1),
top(level, pos, digest, m) AS (
  SELECT 0, pos, digest, m FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), max((m + 7) // 8) FROM top WHERE m > 1 GROUP BY level, pos // 8),
alln AS (SELECT tag, level, pos, digest, m FROM lv UNION ALL SELECT NULL, level, pos, digest, m FROM top),
runs AS (SELECT tag, level, pos // 8 AS run, list(digest ORDER BY pos) AS ds FROM alln WHERE m > 1 GROUP BY tag, level, pos // 8),
lv_last AS (SELECT tag, level FROM lv WHERE m = 1),
up(id, tag, level, pos, folded, sib) AS (
  SELECT id, tag, 0, pos, tested, '' FROM p
  UNION ALL
  SELECT id, tag, level, pos, folded, sib FROM (
    SELECT u.id, u.tag, u.level + 1 AS level, u.pos // 8 AS pos,
           sha256(array_to_string(r.ds[:u.pos % 8], '') || u.folded || array_to_string(r.ds[u.pos % 8 + 2:], '')) AS folded,
           u.sib || array_to_string(r.ds[:u.pos % 8], '') || array_to_string(r.ds[u.pos % 8 + 2:], '') AS sib
    FROM up u JOIN runs r ON r.tag IS NOT DISTINCT FROM u.tag AND r.level = u.level AND r.run = u.pos // 8
    UNION ALL
    SELECT u.id, NULL, 0, s.pos, u.folded, u.sib FROM up u JOIN lv_last l ON l.tag = u.tag AND l.level = u.level JOIN sub s ON s.tag = u.tag) x),
done AS (SELECT id, folded, sib FROM up WHERE tag IS NULL AND level = (SELECT max(level) FROM top))
SELECT p.doc_id, p.leaf, sub.digest AS subroot, root.digest AS root, sha256(done.sib) AS proof_sha256, done.folded AS folded_root, done.folded = root.digest AS verified
FROM p JOIN sub ON sub.tag = p.tag JOIN done ON done.id = p.id CROSS JOIN (SELECT digest FROM top WHERE m = 1) root
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = merkle.verify_documents(table(spark, sf_dir, "documents"))
    hexed = [merkle.as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return d.select("doc_id", *hexed, F.sha2(merkle.as_hex(F.col("siblings")), 256).alias("proof_sha256"), merkle.as_hex(F.col("folded_root")).alias("folded_root"), "verified")


@query("op13_variants", f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k, doc_id || ':' || run AS tagged FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, k, {CRC32.format("tagged")} AS h FROM g, crc_table),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n, length(word) AS len FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
e AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(len))::INT AS i FROM v)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
          UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.cut
          UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.cut),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, encode(near))) AS near, max(n) AS m FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN near END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
      FROM v LEFT JOIN best USING (word)),
path(word, here) AS (SELECT word, word FROM f UNION ALL SELECT p.word, f.form FROM path p JOIN f ON f.word = p.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, path.here AS root, f.n, f.n_near, f.form_n FROM f JOIN path ON path.word = f.word JOIN f last ON last.word = path.here AND last.form IS NULL
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.document_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_html")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
