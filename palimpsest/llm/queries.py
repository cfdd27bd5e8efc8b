"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_middle, gated_lm, jaccard_join, language_id, packing, periodic_runs, piece_tokens, plane_store, quality_repeats, suffix_dedup, warc_archive, weak_labels
from .shared import documents, fresh_path


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, installed alike on the driver and all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_repeats.verdicts(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars")


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "planes")
    plane_store.write(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"))
    return plane_store.digests(spark, path)


def op3_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op4_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents(spark, sf_dir))


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(documents(spark, sf_dir))


def op8_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).drop("file", "row")


def op9_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archived(documents(spark, sf_dir, "pages"))


def op10_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic(periodic_runs.planted(documents(spark, sf_dir))).withColumn("best", periodic_runs.strongest())
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(documents(spark, sf_dir))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op13_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.scored(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_repeats,
        op2_bit_planes,
        op3_heavy_light_jaccard,
        op4_hyperdimensional_language,
        op5_swap_packing,
        op6_suffix_dedup,
        op7_weak_label_quality,
        op8_streaming_exact_dedup,
        op9_content_addressed_warc,
        op10_piece_agenda,
        op11_periodic_runs,
        op12_fill_in_middle,
        op13_gated_recurrent_lm,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Queries that SQL can express as a whole; the others are compared with plain versions in tests.
SQL: dict[str, str] = {
    "op1_quality_repeats": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 4 <= len(ws) THEN ws[i:i + 4] END AS five, CASE WHEN i + 100 <= len(ws) THEN md5(array_to_string(ws[i:i + 100], ' ')) END AS many FROM p),
c AS (SELECT *, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS twice, many IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, many) > 1 AS long FROM g),
v AS (SELECT *, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS covered FROM c),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count_if(covered) AS n_repeat_words, sum(CASE WHEN covered THEN length(word) ELSE 0 END) AS covered_chars, bool_or(long) AS long FROM v GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered_chars, 0)::BIGINT AS covered_chars, coalesce(long, false) AS long FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * covered_chars <= 30 * word_chars AND NOT long AS kept, covered_chars FROM r""",
    "op3_heavy_light_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS items FROM w),
x AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT s.doc_id, len(items)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op6_suffix_dedup": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, lower(hex(b)) AS h, octet_length(b) AS n FROM d),
p AS (SELECT doc_id, h, unnest(range(1, n - 398)) AS s FROM g WHERE n >= 400),
k AS (SELECT doc_id, s, md5(substr(h, 2 * s - 1, 800)) AS m FROM p),
t AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY m) AS c FROM k) WHERE c > 1),
o AS (SELECT doc_id, s, s + 399 AS e, coalesce(s > lag(s + 399) OVER (PARTITION BY doc_id ORDER BY s) + 1, true) AS fresh FROM t),
q AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM o),
u AS (SELECT doc_id, span, min(s) AS s, max(e) AS e FROM q GROUP BY doc_id, span),
f AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM u),
z AS (SELECT f.doc_id, sum(e - s + 1)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (s - 1 - before)), '' ORDER BY s) || any_value(substr(h, 2 * (SELECT max(y.e) FROM u y WHERE y.doc_id = f.doc_id) + 1)) AS kept FROM f JOIN g USING (doc_id) GROUP BY f.doc_id)
SELECT g.doc_id, g.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256,
 decode(unhex(regexp_replace(coalesce(kept, h), '((?:[0-7].)|(?:(?:c[2-9a-f]|d.)[89ab].)|(?:e.[89ab].[89ab].)|(?:f[0-4][89ab].[89ab].[89ab].))|..', '\1', 'g'))) AS text FROM g LEFT JOIN z USING (doc_id)""",
    "op8_streaming_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op9_content_addressed_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> response THEN response END AS refers_to FROM p JOIN g USING (h)""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT for i in range(4)] AS r FROM d),
c AS (SELECT *, len(us)::BIGINT AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 AS plain, least(r[1] % (len(us) + 1), r[2] % (len(us) + 1)) AS a, greatest(r[1] % (len(us) + 1), r[2] % (len(us) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix, CASE WHEN plain THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
