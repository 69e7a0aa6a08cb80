"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.llm import arrow_tokens, classifier, hard_negatives, lattice, licenses, mixing, partenum, pieces, prefix_trie, quality, secrets, sketch, warc
from riskstream.llm.common import documents
from riskstream.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


#: Thresholds here come from one running sum over the sorted keys, without buckets.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || left(md5(COALESCE(doc_id::VARCHAR, text, '')), 6))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - COALESCE(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER () - COALESCE(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM l),
c AS (SELECT source, key, sum(size)::BIGINT AS s FROM d GROUP BY 1, 2),
u AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY key) AS upto FROM c),
b AS (SELECT source, source_size, target, p, target - (p - 1) * source_size AS budget FROM t, (SELECT unnest([1, 2]) AS p)),
k AS (SELECT b.source, b.p, min(u.key + CASE WHEN u.upto - b.budget < b.budget - (u.upto - u.s) THEN 1 ELSE 0 END) AS cut
      FROM b JOIN u ON u.source IS NOT DISTINCT FROM b.source AND u.upto - u.s <= b.budget AND b.budget < u.upto
      WHERE b.budget > 0 AND b.budget < b.source_size GROUP BY 1, 2),
f AS (SELECT b.source, b.source_size, b.target, b.p,
        COALESCE(k.cut, CASE WHEN b.source_size = 0 AND b.p > 1 THEN 0 WHEN b.budget >= b.source_size THEN 16777216 ELSE 0 END) AS cut
      FROM b LEFT JOIN k ON k.source IS NOT DISTINCT FROM b.source AND k.p = b.p)
SELECT d.doc_id, d.size, f.source_size, f.target, (d.size * sum(CASE WHEN d.key < f.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source
GROUP BY d.doc_id, d.source, d.size, d.key, f.source_size, f.target
"""


@_query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def _sketch_sql(text: str) -> str:
    words = rf"regexp_extract_all(lower({text}), '[^\x20\x09-\x0D]+')"
    return f"""list_sort(list_distinct(CASE WHEN len({words}) = 0 THEN []::VARCHAR[]
      WHEN len({words}) < 5 THEN [left(md5(array_to_string({words}, ' ')), 16)]
      ELSE (SELECT list(left(md5(concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])), 16))
            FROM (SELECT {words} AS w), LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)) END))"""


def _like_sql(a: str, b: str) -> str:
    return f"""CASE WHEN len({a}) = 0 THEN (CASE WHEN len({b}) = 0 THEN 1.0 ELSE 0.0 END)
  ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"""


FINGERPRINT_SQL = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text)::BIGINT AS n_chars,
        COALESCE(lead(text) OVER o, first_value(text) OVER o) AS next_text
      FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text DESC)),
e AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM n),
h AS (SELECT *, {_sketch_sql('text')} AS a, {_sketch_sql('next_text')} AS b, {_sketch_sql('edited')} AS c FROM e),
s AS (SELECT doc_id, n_chars, edited,
        list_filter(a, lambda x: x < '4') AS a, list_filter(b, lambda x: x < '4') AS b,
        list_filter(c, lambda x: x < '4') AS c FROM h)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a, ',') AS fingerprint,
  array_to_string(c, ',') AS edited_fingerprint, ({_like_sql('a', 'c')})::DOUBLE AS near_edited,
  ({_like_sql('a', 'b')})::DOUBLE AS near_next
FROM s
"""


@_query("op5_threshold_sketch", FINGERPRINT_SQL)
def op5_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(documents(spark, sf_dir))


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(COALESCE(html, ''))::BIGINT AS payload_bytes, sha1(COALESCE(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@_query("op3_warc_merge", WARC_SQL)
def op3_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no capture time: they count as captured a second apart, by ``page_id``."""
    pages = load_table(spark, sf_dir, "pages")
    captured = F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + F.lit(1704067200))
    return warc.archive(pages, captured).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op7_arrow_sequences")
def op7_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_tokens.tokenized(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@_query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


@_query("op4_streaming_viterbi")
def op4_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@_query("op8_kneser_ney_rules")
def op8_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir))


#: All pairs are compared here: for small tables only.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM
  (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT root, min(node) AS component_id FROM r GROUP BY 1) c ON c.root = d.doc_id
"""


@_query("op10_partenum_join", JACCARD_SQL)
def op10_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.classes(documents(spark, sf_dir))


@_query("op2_lattice_likelihood")
def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scores(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@_query("op9_random_indexing")
def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(documents(spark, sf_dir), load_table(spark, sf_dir, "labels"))


#: Rows that repeat another count once, as in the operator; all anchors meet all rows.
NEGATIVES_SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, embedding
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM r),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    COALESCE(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@_query("op12_strassen_negatives", NEGATIVES_SQL)
def op12_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load_table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


#: Unsigned CRC-32, bit by bit.
_CRC_SQL = """xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte:
    list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT)"""

#: Every prefix of every conversation, and each node beside all nodes below it: for small tables only.
TRIE_SQL = """
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS k FROM t),
o AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS seq, list(length(text) ORDER BY turn NULLS FIRST, k) AS chars FROM k GROUP BY 1),
h AS (SELECT *, ({crc} % 6)::INTEGER AS h FROM o),
r AS (SELECT h.conv_id, list_concat(COALESCE(b.seq, [])[1:h], h.seq[h + 1:]) AS seq, list_concat(COALESCE(b.chars, [])[1:h], h.chars[h + 1:]) AS chars
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
d AS (SELECT conv_id, seq, chars, unnest(range(0, len(seq) + 1)) AS d FROM r),
n AS (SELECT seq[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, count(DISTINCT seq[d + 1]) AS n_children,
    CASE WHEN d > 0 THEN any_value(chars[d]) ELSE 0 END AS chars,
    sha256(COALESCE(string_agg(CASE WHEN len(seq) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM d GROUP BY 1, 2),
b AS (SELECT a.p, a.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.chars)::BIGINT AS saved_tokens
  FROM n a JOIN n x ON x.p[1:a.d] = a.p AND x.d >= a.d GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM n JOIN b ON b.p = n.p AND b.d = n.d LEFT JOIN n u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
""".format(crc=_CRC_SQL.format("conv_id::VARCHAR"))


@_query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation starts with up to five turns of the first one of its hundred."""
    convs = prefix_trie.encoded(load_table(spark, sf_dir, "conversations"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return prefix_trie.trie(prefix_trie.spliced(convs, F.col("conv_id") - F.col("conv_id") % 100, head, 5))


def _labels_sql() -> str:
    """Every block of every text beside every template of its size, without order, prefixes or positions. Small tables only."""
    kinds = licenses.templates_of(licenses.TEMPLATES, licenses.CONTAINMENT)
    rows = ", ".join(f"('{t['label']}', {t['size']}, {t['need']}, {t['words']})" for t in kinds)
    places = " UNION ALL ".join(
        f"SELECT row, i, '{label}' AS label FROM p WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))
        for phrase, label in licenses.PHRASES.items())
    return rf"""
WITH t(label, size, need, ws) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
p AS (SELECT row, w, unnest(range(0, len(w))) AS i FROM d),
b AS (SELECT row, min(i) AS first_word, max(i) AS last_word, count(*) AS n_base, list(DISTINCT label) AS base FROM ({places}) GROUP BY 1),
k AS (SELECT row, w, size, unnest(range(0, greatest(1, (len(w) + size // 2 - 1) // (size // 2) - 1))) * (size // 2) AS s
  FROM d, (SELECT DISTINCT size FROM t)),
m AS (SELECT row, label, len(list_intersect(list_distinct(w[s + 1:s + k.size]), ws)) AS n, need, len(ws) AS total FROM k JOIN t ON t.size = k.size),
h AS (SELECT row, list(DISTINCT label) AS found, max(n::DOUBLE / total) AS best FROM m WHERE n >= need GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  COALESCE(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(COALESCE(base, []), COALESCE(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE COALESCE(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN h USING (row)
"""


@_query("op11_license_join", _labels_sql())
def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(documents(spark, sf_dir))
