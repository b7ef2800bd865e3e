"""One query for each operator over its whole tables, with production parameters; the digests derive from the operators' outputs."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chosen_path, decision_list, decontam, filter_audit, license_scan, line_dedup, lm_scoring, matroska, pii, quality_fm, resampling, substring_dedup
from .tables import table


def vocabulary() -> str:
    """Path of the tokenizer's vocabulary: ASSAYKIT_VOCABULARY, else the installed public one."""
    named = os.environ.get("ASSAYKIT_VOCABULARY")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = lm_scoring.flagged(docs, table(spark, sf_dir, "labels"))
    return lm_scoring.score(marked, lm_scoring.totals(marked))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_fm.score(docs, machine)
    return scored.select("doc_id", quality_fm.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.summary(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), plain=table(spark, sf_dir, "pages"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_spans", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), phrases=license_scan.CONTRACT)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = bpe.encode(docs, vocabulary(), ("n_tokens", "ids_text", "decoded"), keep=["doc_id"])
    return done.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return decision_list.judge(docs, rules).select(*names)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"), words=line_dedup.LONG)
    gone = F.coalesce("_gone", F.expr("cast(array() as array<int>)"))
    return out.select(
        "doc_id", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gain = resampling.gains(resampling.counts(docs), resampling.counts(table(spark, sf_dir, "benchmark")))
    return resampling.draw(resampling.scored(resampling.weigh(docs, gain))).select("doc_id", "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.marked(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.cells(masks, table(spark, sf_dir, "labels")))


def op13_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.store(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (pipeline, op1_lm_scoring, op2_quality_fm, op3_substring_dedup, op4_pii, op5_chosen_path, op6_license_scan, op7_decontam, op8_bpe, op9_rules, op10_line_dedup, op11_resampling, op12_filter_audit, op13_matroska)}


def queries() -> dict:
    return dict(QUERIES)


WORDS_SQL = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


BLANK_WORDS_SQL = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


@functools.cache
def oracle_sql() -> dict[str, str]:
    return {
        "op7_decontam": f"""
WITH b AS (SELECT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents),
hit AS (
  SELECT doc_id, s, n, item_id
  FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS s
              FROM d CROSS JOIN (SELECT DISTINCT n FROM win)) WHERE s + n - 1 <= len(w)) JOIN win USING (n, g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
        "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, x, trim(x, E' \t\r\x0b\x0c') AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
n AS (SELECT doc_id, line, t, len(regexp_extract_all(t, '[^\x20\x09\x0D\x0B\x0C]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS s FROM l WHERE t <> ''),
w AS (SELECT a.doc_id, a.s, a.line AS lo, c.line AS hi, 3 AS k, a.t || chr(10) || b.t || chr(10) || c.t AS g
      FROM n a JOIN n b ON b.doc_id = a.doc_id AND b.s = a.s + 1 JOIN n c ON c.doc_id = a.doc_id AND c.s = a.s + 2
      UNION ALL SELECT a.doc_id, a.s, a.line, b.line, 2, a.t || chr(10) || b.t FROM n a JOIN n b ON b.doc_id = a.doc_id AND b.s = a.s + 1 WHERE a.words + b.words > 50
      UNION ALL SELECT doc_id, s, line, line, 1, t FROM n WHERE words > 50),
later AS (SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(range(lo, hi + 1)) AS line FROM later)),
cut AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY line) AS text FROM l ANTI JOIN gone USING (doc_id, line) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)""",
        "op11_resampling": f"""
WITH RECURSIVE own AS (
  SELECT 'd' AS side, doc_id, {WORDS_SQL.format("text")} AS w FROM documents UNION ALL SELECT 'b', NULL, {WORDS_SQL.format("text")} FROM benchmark),
f AS (
  SELECT side, doc_id, array_to_string(w[s:s + n - 1], ' ') AS g, count(*) AS c
  FROM (SELECT side, doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS s FROM own CROSS JOIN range(1, 4) AS r(n)) GROUP BY ALL),
steps AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
crc AS (
  SELECT g, xor(list_reduce(list_transform(range(0, octet_length(encode(g))), lambda i: CAST(concat('0x', substr(hex(encode(g)), 2 * i + 1, 2)) AS BIGINT)),
                            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT g FROM f) CROSS JOIN steps),
b AS (SELECT b, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 'b'), 0) AS t FROM f JOIN crc USING (g) GROUP BY 1),
gain AS (SELECT b, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(s), 0) FROM b) AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(t), 0) FROM b) AS DOUBLE) + 10000)))) AS gain FROM b),
w AS (SELECT doc_id, sum(c) AS n, CAST(sum(c * gain) AS BIGINT) AS weight FROM f JOIN crc USING (g) JOIN gain USING (b) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT o.doc_id, len(o.w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256('42:' || o.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM own o LEFT JOIN w USING (doc_id) WHERE side = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM placed) * 5 // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)""",
    "op12_filter_audit": f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, {BLANK_WORDS_SQL.format("text")} AS w FROM documents),
m AS (
  SELECT part, doc_id, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) AS INT) + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INT)
    + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY x) AS INT) AS mask FROM t),
c AS (SELECT part, mask, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM m LEFT JOIN labels l USING (doc_id)),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0) AS before FROM o CROSS JOIN range(1, 6) AS r(k)),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM c GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM cell CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    }
