"""The queries ``opN_<name>`` and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.runtime import table


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import ogg

    return ogg.media_features(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import neardup

    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import pii

    return pii.find(table(spark, sf_dir, "documents"))


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import lblm

    return lblm.score(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from packloom.llm import bpe

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import substr

    return substr.remove_repeats(table(spark, sf_dir, "documents"), passage_words=51)


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import warc

    rows = warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import decontam

    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    held_out = langid.spread("doc_id", 3) == 1
    model = langid.fit(docs, where=~held_out)
    rows = langid.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import vafile

    vectors = table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return vafile.mine(moved, F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import convrepair

    return convrepair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packloom.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg_media": op1_ogg_media,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_pii_disclosure": op3_pii_disclosure,
    "op4_log_bilinear": op4_log_bilinear,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_secret_scan": op8_secret_scan,
    "op9_lsa_decontamination": op9_lsa_decontamination,
    "op10_language_crf": op10_language_crf,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
}

ORACLE: dict[str, str] = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT doc_id, coalesce(least(doc_id, c.m), doc_id) AS class_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM documents LEFT JOIN c ON c.x = doc_id LEFT JOIN k ON k.x = doc_id
""",
    "op7_warc_round_trip": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
f AS (SELECT hex, n, min(page_id) AS first_id FROM q GROUP BY ALL),
b AS (SELECT *, unhex(hex)::BLOB::BIT::VARCHAR AS bits FROM q JOIN f USING (hex, n))
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
      + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
""",
    "op11_hard_negatives": """
WITH k AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS a, b.r AS br, b.vec_id AS b, a.label = b.label AS same,
    list_inner_product(a.x, b.x)::BIGINT AS s
  FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT ar, a, br, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, b NULLS LAST) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
  (row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.s DESC, n.b NULLS LAST))::INT AS rank,
  n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY rank <= 5
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE b AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS v, conv_id, turn, coalesce("role", ' ') AS ro, coalesce("text", ' ') AS tx,
    concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(k)), lambda i: ascii(k[i + 1])::BIGINT)),
    lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 20 AS f FROM b),
d AS (SELECT v, turn, CASE WHEN f = 4 THEN 'user' ELSE ro END AS ro, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(tx, '.!?', '') ELSE tx END AS tx,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
l AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY turn NULLS FIRST, ro, tx) AS i, count(*) OVER (PARTITION BY v) AS n FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY v, ro, tx ORDER BY i) > 1 AS seen, regexp_replace(tx, '[\x20\x09-\x0D]+\z', '') AS core FROM l),
r AS (SELECT *, left(ro, 1) AS c, CASE WHEN core = '' THEN 'b' WHEN seen THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
    fault IN ('b', 'd') AS x, (fault = 't')::INT AS t, lag(left(ro, 1)) OVER (PARTITION BY v ORDER BY i) AS p FROM o),
e AS (SELECT v, n + 1 AS i, 0::BIGINT AS c0, 4::BIGINT AS c1, 2::BIGINT AS c2, 0::BIGINT AS c3 FROM r WHERE i = 1
  UNION ALL SELECT v, i, least(n0, 2 + n2, 4 + n3), least(n1, 2 + n2, 4 + n3), least(n2, 2 + n3), least(n3, 2 + n2)
  FROM (SELECT r.v, r.i,
      least(3 + c0, CASE WHEN x THEN 99999999 ELSE least(2 + t + c2, CASE c WHEN '' THEN t + c0 WHEN 's' THEN t + c1 WHEN 'u' THEN t + c2 ELSE 99999999 END) END) AS n0,
      least(3 + c1, CASE WHEN x THEN 99999999 ELSE least(2 + t + c2, CASE c WHEN '' THEN t + c1 WHEN 'u' THEN t + c2 ELSE 99999999 END) END) AS n1,
      least(3 + c2, CASE WHEN x THEN 99999999 ELSE least(2 + t + c3, CASE c WHEN '' THEN t + c2 WHEN 'a' THEN t + c3 ELSE 99999999 END) END) AS n2,
      least(3 + c3, CASE WHEN x THEN 99999999 ELSE least(2 + t + c2, CASE c WHEN '' THEN t + c3 WHEN 'u' THEN t + c2 ELSE 99999999 END) END) AS n3
    FROM e JOIN r ON r.v = e.v AND r.i = e.i - 1)),
w AS (SELECT v, i, [c0, c1, c2, c3] AS cost FROM e),
g AS (SELECT v, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS lines FROM r WHERE i = 1
  UNION ALL SELECT v, CASE l WHEN 'I' THEN i ELSE i + 1 END, CASE l WHEN 'D' THEN s WHEN 'K' THEN CASE WHEN c = '' THEN s WHEN c = 's' THEN 2 WHEN c = 'u' THEN 3 ELSE 4 END ELSE nx END, audit || l,
    CASE l WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, ro || ':' || tx) WHEN 'R' THEN list_append(lines, rn || ':' || tx) ELSE list_append(lines, rn || ':') END
  FROM (SELECT g.*, r.c, r.ro, r.tx, CASE s WHEN 3 THEN 4 ELSE 3 END AS nx, CASE s WHEN 3 THEN 'assistant' ELSE 'user' END AS rn,
      CASE WHEN r.i IS NOT NULL AND 3 + a.cost[s] = z.cost[s] THEN 'D' WHEN 2 + z.cost[nx] = z.cost[s] THEN 'I'
        WHEN NOT r.x AND t + a.cost[CASE WHEN c = '' THEN s WHEN c = 's' AND s = 1 THEN 2 WHEN c = 'u' AND s <> 3 THEN 3 WHEN c = 'a' AND s = 3 THEN 4 END] = z.cost[s] THEN 'K'
        WHEN r.i IS NOT NULL THEN 'R' END AS l
    FROM g JOIN w z ON z.v = g.v AND z.i = g.i LEFT JOIN r ON r.v = g.v AND r.i = g.i LEFT JOIN w a ON a.v = g.v AND a.i = g.i + 1)
  WHERE l IS NOT NULL),
q AS (SELECT v, arg_max(audit, len(audit)) AS audit, sha256(array_to_string(arg_max(lines, len(audit)), chr(10))) AS sha FROM g GROUP BY v),
m AS (SELECT v, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY v)
SELECT u.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(c0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT v, conv_id FROM b) u LEFT JOIN m USING (v) LEFT JOIN q USING (v) LEFT JOIN e ON e.v = u.v AND e.i = 1
""",
}
