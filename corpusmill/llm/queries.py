"""The queries of this subpackage: thin calls of the operators with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import iblt, isomedia, mixing, reshard, secrets, sentencepieces, substring, tokens, toxicity, triejoin
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokens.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return tokens.read_tokens(spark, path)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepieces.decode(sentencepieces.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iblt.fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE + secrets.MORE
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)

    def count(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")

    counts = [count(n).alias(f"n_{r.kind}") for n, r in enumerate(secrets.BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    return found.select("row.doc_id", *counts, F.sha2(secrets.listed(base, rules), 256).alias("base_sha256"), secrets.listed(F.col("spans"), rules).alias("spans"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triejoin.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, cap=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = isomedia.probe(isomedia.stored_media(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The old layout: 16 shards by a hash of doc_id.
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(16))
    found = reshard.reshard(table(spark, sf_dir, "documents").select("doc_id", "text"), old, shards=24)
    text = F.coalesce("row.text", F.lit(""))
    return found.select("row.doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"), k=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Query] = {
    "op1_tokens": op1_tokens,
    "op2_pieces": op2_pieces,
    "op3_fingerprints": op3_fingerprints,
    "op4_secrets": op4_secrets,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_media": op7_media,
    "op8_shards": op8_shards,
    "op9_substrings": op9_substrings,
    "op10_toxicity": op10_toxicity,
}

# The kinds and regexes of op4_secrets, as DuckDB writes them; the least length of a group is in the last place.
_KINDS = [(r.kind, r.regex.replace("'", "''"), r.group, r.least) for r in secrets.BASE + secrets.MORE]
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS k, string_split_regex(t, '{regex}') AS g, regexp_extract_all(t, '{regex}', 0) AS f, regexp_extract_all(t, '{regex}', {group}) AS v, {least} AS least FROM d WHERE regexp_matches(t, '{regex}')"
    for n, (_, regex, group, least) in enumerate(_KINDS)
)

ORACLES: dict[str, str] = {
    "op4_secrets": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     m AS ({_MATCHES}),
     i AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
     p AS (SELECT doc_id, k, (list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN f[1:i - 1]]), 0))::BIGINT AS a, length(f[i]) AS n FROM i WHERE length(v[i]) >= least),
     s AS (SELECT doc_id, k, a, [{", ".join(f"'{kind}'" for kind, *_ in _KINDS)}][k + 1] || ':' || a || ':' || (a + n) AS span FROM p),
     x AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                  string_agg(span, ',' ORDER BY a, k) FILTER (k < {len(secrets.BASE)}) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (doc_id)""",
    "op5_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     e AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                 ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM d),
     s AS (SELECT DISTINCT doc_id, g FROM e),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
     l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
     t AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
     r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, t.y FROM r JOIN t ON t.x = r.reached)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.least AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
     w AS (SELECT *, [3.0, 1.0, 2.0][((place - 1) % 3) + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
     l AS (SELECT *, most / weight AS level FROM w),
     h AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM l),
     x AS (SELECT *, (SELECT share FROM h WHERE level > share ORDER BY level, place LIMIT 1) AS water FROM h),
     t AS (SELECT source, source_size, least(most, coalesce(water * weight, most)) AS target,
                  ('0x' || substr(md5('7:' || coalesce(source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM x),
     r AS (SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS k,
                  CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(u + k * e) - floor(u + (k - 1) * e)) * size)::BIGINT AS taken FROM r""",
    "op9_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
     s AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS h, md5(array_to_string(w[i:i + 34], ' ')) AS m FROM p),
     r AS (SELECT doc_id, i FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
     g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
     a AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, k)], ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)""",
}
