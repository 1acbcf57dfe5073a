"""The registered queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm import bpe, chat, debruijn, embedding, filter_audit, importance, licenses, media, mixing, ngram_join, quality, suffix_dedup, token_store
from hostlens.llm._common import table


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = token_store.read_store(spark, token_store.write_store(docs))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_components(docs, k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "shard", "place")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.read_png(media.with_png(docs))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_on_labels(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = quality.scored(docs, model)
    return rows.select("doc_id", (quality.fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.importance_sample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_duplicates": op1_embedding_near_duplicates,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_token_store": op3_token_store,
    "op4_chat_format": op4_chat_format,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_source_mix": op6_source_mix,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_media_columns": op9_media_columns,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_debruijn_dedup": op12_debruijn_dedup,
    "op13_filter_audit": op13_filter_audit,
}

#: Components of links(a, b) over all(id), as the last part of a WITH clause.
REACH_SQL = """reach AS (SELECT id, id AS other FROM everyone UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

OP1_SQL = f"""WITH RECURSIVE usable AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
everyone AS (SELECT vec_id AS id FROM embeddings), {REACH_SQL}
SELECT c.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = c.id) AS n_links, c.component_id, c.id = c.component_id AS kept FROM components c"""

#: Each row is a document of its own (rid).
OP5_SQL = rf"""WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), words AS (SELECT rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM docs),
sets AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM words),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM sets a JOIN sets b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
everyone AS (SELECT rid AS id FROM docs), {REACH_SQL}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(d.doc_id) OVER (PARTITION BY c.component_id) AS component_id FROM components c JOIN docs d ON d.rid = c.id LEFT JOIN sizes s ON s.rid = c.id"""

#: A text's bytes as hex digits, two a byte; spans of removed positions; what stands between them.
OP7_SQL = """WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM docs WHERE length(h) >= 100),
strings AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM starts),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM strings) WHERE first < doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS opens FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, coalesce(max(b), 0), NULL FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, (length(d.h) - length(k.h)) // 2 AS n_removed, (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM docs d JOIN kept k USING (doc_id)"""

OP4_SQL = rf"""WITH RECURSIVE split AS (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM conversations)),
lines AS (SELECT conv_id, turn, i, length(regexp_replace(regexp_extract(line, '{chat.MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(line, '{chat.MARKS}', '') AS body FROM split),
blanks AS (SELECT *, trim(regexp_replace(body, '[ \t\n\x0B\f\r]+', ' ', 'g')) = '' AS blank FROM lines),
heads AS (SELECT *, CASE WHEN lag(level) OVER w IS NULL OR lag(level) OVER w <> level OR blank OR lag(blank) OVER w THEN 1 ELSE 0 END AS head FROM blanks WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
runs AS (SELECT *, sum(head) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM heads),
passages AS (SELECT conv_id, turn, any_value(level) AS level, lower(trim(regexp_replace(string_agg(body, ' ' ORDER BY i), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS body FROM runs GROUP BY conv_id, turn, run),
real AS (SELECT conv_id, turn, level, sha256(body) AS digest FROM passages WHERE regexp_matches(body, '[\p{{L}}\p{{N}}]')),
firsts AS (SELECT conv_id, digest, min(turn) AS first FROM real WHERE level = 0 GROUP BY conv_id, digest),
quoted AS (SELECT conv_id, turn, level, digest, count(*) AS times FROM real WHERE level > 0 GROUP BY ALL),
named AS (SELECT q.*, CASE WHEN first < turn THEN first END AS original FROM quoted q LEFT JOIN firsts USING (conv_id, digest)),
messages AS (SELECT conv_id, turn, sum(times)::BIGINT AS n_quotes, coalesce(sum(times) FILTER (original IS NOT NULL), 0)::BIGINT AS n_linked, arg_max(original, (-level, original)) FILTER (original IS NOT NULL) AS parent_turn FROM named GROUP BY conv_id, turn),
paths AS (SELECT conv_id, turn, parent_turn AS top, [turn] AS path FROM (SELECT DISTINCT c.conv_id, c.turn, m.parent_turn FROM conversations c LEFT JOIN messages m USING (conv_id, turn))
    UNION ALL SELECT p.conv_id, p.turn, m.parent_turn, list_prepend(p.top, p.path) FROM paths p LEFT JOIN messages m ON m.conv_id = p.conv_id AND m.turn = p.top WHERE p.top IS NOT NULL),
own AS (SELECT conv_id, turn, regexp_replace(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), '\A[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g') AS text FROM lines GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, m.parent_turn, len(p.path)::INT - 1 AS depth, array_to_string(list_transform(p.path, lambda t: CASE WHEN t < 0 THEN '-' ELSE '' END || lpad((t::BIGINT & 9223372036854775807)::VARCHAR, 19, '0')), '.') AS reply_path, coalesce(m.n_quotes, 0) AS n_quotes, coalesce(m.n_linked, 0) AS n_linked, coalesce(o.text, '') AS text
FROM conversations c LEFT JOIN messages m USING (conv_id, turn) JOIN paths p ON p.conv_id = c.conv_id AND p.turn = c.turn AND p.top IS NULL JOIN own o ON o.conv_id = c.conv_id AND o.turn = c.turn"""

#: crc32 takes a byte at a time through the checksums of single bytes, eight halvings each.
HALF_SQL = "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)"
OP11_SQL = rf"""WITH one AS (SELECT list(list_reduce(range(8), {HALF_SQL}, b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
words AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS MATERIALIZED (SELECT kind, id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM (SELECT kind, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words) WINDOW o AS (PARTITION BY kind, id ORDER BY i)),
found AS MATERIALIZED (SELECT kind, id, x AS f FROM each UNION ALL SELECT kind, id, x || ' ' || y FROM each WHERE y IS NOT NULL UNION ALL SELECT kind, id, x || ' ' || y || ' ' || z FROM each WHERE z IS NOT NULL),
kinds AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM found)),
codes AS (SELECT f, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM kinds, one),
tallied AS (SELECT kind, id, bucket, count(*) AS n FROM found JOIN codes USING (f) GROUP BY ALL),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM tallied GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM buckets, sums),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM tallied JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scores AS (SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w)::BIGINT AS n_words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM words LEFT JOIN weights USING (id) WHERE kind = 'd'),
fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank, n_words FROM scores LEFT JOIN fit USING (doc_id)"""

OP12_SQL = r"""WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS MATERIALIZED (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM split),
windows AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s FROM words) WHERE i <= n - 34),
again AS (SELECT doc_id, i FROM windows JOIN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1) USING (s)),
gone AS (SELECT doc_id, x, i, max(again.i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN again USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)"""

OP13_SQL = r"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
known AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first < docs.doc_id THEN 16 ELSE 0 END AS mask FROM docs JOIN firsts USING (text) LEFT JOIN known ON known.doc_id = docs.doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM orders, range(1, 6) r(i)),
per AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM per"""

ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": OP4_SQL,
    "op1_embedding_near_duplicates": OP1_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_license_scan": licenses.scan_sql(),
    "op11_importance_resampling": OP11_SQL,
    "op12_debruijn_dedup": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
