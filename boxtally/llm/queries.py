"""The queries of this subpackage, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxtally.llm import (
    decontaminate, exact_dedup, language, licenses, line_dedup, near_dedup, prefix_trie, quality, resampling, sentencepiece_codec, sharding, suffix_dedup, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHA1_BASE32 = " || ".join(
    f"translate(upper(lpad(to_base(('0x' || substr(h, {5 * i + 1}, 5))::BIGINT, 32), 4, '0')), "
    f"'0123456789ABCDEFGHIJKLMNOPQRSTUV', '{warc.BASE32}')"
    for i in range(8)
)


@_query("op1_warc_archive", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body)
SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes, {_SHA1_BASE32} AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS verified
FROM p JOIN f USING (body)
""")
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@_query("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


@_query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(_table(spark, sf_dir, "documents"))


@_query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_and_check(_table(spark, sf_dir, "documents"), sentencepiece_codec.Codec.load())


_WORDS = "regexp_extract_all(lower(text), '[0-9a-z[:^ascii:]]+')"
_SHINGLES = """
  SELECT {id}, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s
  FROM (SELECT {id}, {words} AS w FROM {table})
"""


@_query("op2_decontaminate", f"""
WITH d AS ({_SHINGLES.format(id="doc_id", words=_WORDS, table="documents")}),
     b AS ({_SHINGLES.format(id="item_id", words=_WORDS, table="benchmark")}),
     n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
     j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM j JOIN n USING (item_id) WHERE n_shared / n_item >= 0.8
""")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), within=True)


@_query("op4_line_dedup", r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
     l AS (SELECT doc_id, line_no, raw, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS line FROM raw),
     f AS (SELECT line, min((doc_id, line_no)) AS place FROM l WHERE line <> '' GROUP BY line),
     v AS (SELECT line, place, unnest(list_transform(range(0, length(line)), lambda i: line[:i] || line[i+2:])) AS variant FROM f WHERE length(line) >= 16
           UNION ALL SELECT line, place, line FROM f WHERE length(line) >= 16),
     near AS (SELECT DISTINCT a.line FROM v a JOIN v b USING (variant) WHERE b.place < a.place AND levenshtein(a.line, b.line) = 1),
     kept AS (SELECT l.doc_id, l.line_no, l.raw, l.line = '' OR ((l.doc_id, l.line_no) = f.place AND near.line IS NULL) AS stays
              FROM l LEFT JOIN f USING (line) LEFT JOIN near ON near.line = l.line),
     t AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE stays) AS text,
                  count(*) FILTER (WHERE NOT stays)::INTEGER AS n_lines_dropped FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, coalesce(n_lines_dropped, 0)::INTEGER AS n_lines_dropped
FROM documents d LEFT JOIN t USING (doc_id)
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(_table(spark, sf_dir, "documents"))


@_query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@_query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.posteriors(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


_CRC_TABLE = """
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
"""


def _crc32(text: str) -> str:
    byte = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])))"


@_query("op11_importance_resampling", rf"""
WITH crc AS ({_CRC_TABLE}),
     d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
     f AS (SELECT r, unnest(w) AS f FROM d),
     k AS (SELECT f, {_crc32("f")} % {resampling.BUCKETS} AS bucket FROM (SELECT f FROM f UNION SELECT f FROM b), crc),
     s AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (f) GROUP BY bucket),
     t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (f) GROUP BY bucket),
     g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {resampling.BUCKETS})::DOUBLE
             / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
     w AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
     c AS (SELECT doc_id, len(w.w) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM d AS w LEFT JOIN w AS x USING (r)),
     p AS (SELECT *, n_features >= {resampling.LEAST_WORDS} AND doc_id IS NOT NULL AS pool FROM c),
     o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE pool) OVER () AS n FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN pool AND place <= n * {resampling.SHARE} // 100 THEN place END AS rank FROM o
""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op12_sharding")
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


@_query("op13_prefix_trie", f"""
WITH crc AS ({_CRC_TABLE}),
     x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     i AS (SELECT conv_id, turn, strlen(text) AS n, printf('%08X', strlen(text)) || upper(md5(strlen(role) || ':' || role || ':' || text)) AS id FROM x),
     own AS (SELECT conv_id, list({{'id': id, 'n': n}} ORDER BY turn NULLS FIRST, id) AS turns, any_value({_crc32("conv_id::VARCHAR")}) % 9 AS h
             FROM i, crc GROUP BY conv_id),
     re AS (SELECT a.conv_id, list_concat(coalesce(b.turns[:a.h], []), a.turns[a.h + 1:]) AS turns FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
     p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM re),
     m AS (SELECT conv_id, depth, len(turns) = depth AS ends, array_to_string(list_transform(turns[:depth], lambda t: t.id), '') AS prefix,
             CASE WHEN depth > 0 THEN array_to_string(list_transform(turns[:depth - 1], lambda t: t.id), '') END AS up,
             CASE WHEN depth > 0 THEN turns[depth].n ELSE 0 END AS last FROM p),
     n AS (SELECT prefix, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY prefix),
     c AS (SELECT up AS prefix, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
     l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (prefix)),
     a AS (SELECT substr(prefix, 1, 40 * unnest(range(depth + 1))::BIGINT) AS top, n_children, (n_convs - 1) * last AS saved FROM l),
     s AS (SELECT top AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY top)
SELECT l.conv_id, l.depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, l.ends_sha256
FROM l JOIN s USING (prefix) LEFT JOIN l q ON q.prefix = l.up
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))
