"""Queries of the cleaning, splitting, chunking and retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking, cleaning, evaluation, retrieval, splitting
from corpusmill.operators.staging import staged
from corpusmill.plans.inline import Inline, table
from corpusmill.sources import files

_FOOTER = "Annual report of the works, page"
_LONG = "A sentence about valves, dampers and the air that they let pass through the building."
DOCS = Inline("doc_id long, text string, source string", (
    (-1, f"# title\nlicense: x\n---\n\n{_LONG}\nAn air-\nhandling unit and an Air-\nHandling unit.\n12\nxiv\nDOI: 10.1/x\n[12] ref\n(12) ref\n(12)ref\nThis article needs additional citations\n1234 5678\na=b+c\n", "inline"),
    (-2, "\n".join(["first words of it", "References:", "second words of it", *[f"line number {c} of the text" for c in "abcdefghi"], "References:", "gone", "also gone"]), "inline"),
    (-3, "\n".join(x for p in range(1, 5) for x in (f"{_FOOTER} {p} of 4", f"{_LONG} {p}x", "", "", "", "tail words here"[: 15 - p])), "inline"),
    (-4, "\n".join(x for p in range(1, 4) for x in (f"{_FOOTER} {p}", f"{_LONG} {p}x")), "inline"),
    (-5, "one\n\n\ntwo\n\n12\n\nthree\n\n\n\n\nfour", "inline"),
    (-6, "   \n\n  ", "inline"),
    (-7, "", "inline"),
    # Null and repeated ids, and rows that are equal: each row is cleaned by itself.
    (None, "a text without an id\n12\nand its end", "inline"),
    (None, None, "inline"),
    (-8, "\n".join([f"{_FOOTER} {p}" for p in range(1, 4)] + ["first of two"]), "inline"),
    (-8, "\n".join([f"{_FOOTER} {p}" for p in range(4, 6)] + ["second of two"]), "inline"),
    (-9, "twice the same", "inline"),
    (-9, "twice the same", "inline"),
))
LINES = Inline("line string", tuple((x,) for x in (
    "12", "12345", "xiv", "DOI: 10.1", "[12] ref", "(12) ref", "(12)ref", "This article needs sources", "this article is short", "1234 5678", "a=b+c",
    "https://a.b", "All Rights Reserved.", "A normal sentence of words.", "mixed 12 34 56 ab", "ISSN 1234", "iiiiiiii",
)))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source").unionByName(DOCS.frame(spark))


_SRC = f"src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM (SELECT doc_id, text, source FROM documents UNION ALL SELECT doc_id::BIGINT, text, source FROM {DOCS.sql}))"
_NOISE = r"""CASE WHEN regexp_full_match({s}, '\d{{1,4}}') THEN 1 WHEN regexp_full_match(lower({s}), '[ivxlcdm]{{1,7}}') THEN 2
  WHEN regexp_matches(lower({s}), '^(doi:|arxiv:|issn|isbn|http://|https://|www\.)') THEN 3 WHEN regexp_matches({s}, '^\[\d+\]|^\(\d+\)\s') THEN 4
  WHEN regexp_matches(lower({s}), 'retrieved from|all rights reserved|downloaded from|creative commons|this page was last edited') THEN 5
  WHEN starts_with(lower({s}), 'this article') AND regexp_matches(lower({s}), 'issue|help improve|verif|additional citations|sources') THEN 6
  WHEN length({s}) >= 8 AND length(regexp_replace({s}, '[^\p{{L}}]', '', 'g')) / length({s}) < 0.5 THEN 7 ELSE 0 END"""
_STRIP = r"regexp_replace({s}, '^\s+|\s+$', '', 'g')"
_FORM = _STRIP.format(s=r"regexp_replace(line, '(?i)\s*(page\s+)?\d+(\s+of\s+\d+)?\s*$', '')")
_LINES = rf"""{_SRC},
  hd AS (SELECT rid, doc_id, source, CASE WHEN contains(text, chr(10) || '---' || chr(10) || chr(10)) THEN substr(text, instr(text, chr(10) || '---' || chr(10) || chr(10)) + 6) ELSE text END AS t FROM src),
  hy AS (SELECT rid, doc_id, source, regexp_replace(t, '-\n([a-z])', '\1', 'g') AS t FROM hd),
  sp AS (SELECT rid, doc_id, source, string_split(t, chr(10)) AS a FROM hy),
  sq AS (SELECT rid, doc_id, source, CASE WHEN a[-1] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM sp),
  ln AS (SELECT rid, doc_id, source, len(a) AS n, unnest(range(len(a))) AS i, unnest(a) AS raw FROM sq),
  sl AS (SELECT rid, doc_id, source, n, i, {_STRIP.format(s="raw")} AS line FROM ln),
  ct AS (SELECT *, min(CASE WHEN i > 0.55 * n AND regexp_matches(line, '(?i)^(references?|bibliography|external links|further reading|see also|notes|citations?|sources|acknowledge?ments?|works cited)\s*:?\s*$') THEN i END) OVER (PARTITION BY rid) AS cut FROM sl),
  kp AS (SELECT rid, doc_id, source, n, i, line, {_FORM} AS form FROM ct WHERE cut IS NULL OR i < cut)"""
_BODIES = rf"""{_LINES},
  rp AS (SELECT *, count(*) OVER (PARTITION BY rid, form) AS repeats FROM kp),
  ok AS (SELECT * FROM rp WHERE line = '' OR NOT ((length(form) >= 15 AND repeats >= 4) OR ({_NOISE.format(s="line")}) > 0)),
  jn AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS t FROM ok GROUP BY rid),
  bd AS (SELECT src.rid, src.doc_id, src.source, coalesce({_STRIP.format(s=r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")}, '') AS body FROM src LEFT JOIN jn USING (rid)),
  th AS (SELECT *, length(body)::BIGINT AS chars, length(body) < 1500 AS thin FROM bd)"""


def clean_noise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(cleaning.body_lines(F.col("text"))).alias("line")).unionByName(LINES.frame(spark))
    found = lines.withColumn("rule", T.noise_rule(F.col("line")).cast("long"))
    return found.groupBy("line", "rule").agg(F.count(F.lit(1)).alias("n")).where("rule > 0")


def clean_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.repeated_lines(_docs(spark, sf_dir))


def clean_tail_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.size(cleaning.before_tail(cleaning.body_lines(F.col("text")))).cast("long")
    return _docs(spark, sf_dir).select("doc_id", left.alias("n_lines"))


def clean_dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.dehyphenated(T.after_header(F.coalesce("text", F.lit("")))).alias("text"))


def clean_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_bodies(_docs(spark, sf_dir))


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.thin_report(cleaning.clean_bodies(_docs(spark, sf_dir), keep=("source",)))


def thin_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.thin_report(cleaning.clean_bodies(_docs(spark, sf_dir))).select("doc_id", "chars", "thin")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Staged, as cleaning is dear and the order's ranges are sampled first; without bodies the rows are narrow.
    thin = staged(_thin(spark, sf_dir).select("doc_id", "source", "chars", "thin"), "thin")
    return splitting.systematic_holdout(thin.where("NOT thin"), F.col("doc_id"))


def cpt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", F.col("source").alias("topic"), "chars", "heldout")


def cpt_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = staged(_thin(spark, sf_dir).select("doc_id", "chars", "thin"), "thin")
    kept = splitting.systematic_holdout(thin.where("NOT thin"), F.col("doc_id")).select("thin", "heldout", "chars")
    return evaluation.corpus_provenance(kept.unionByName(thin.where("thin").select("thin", F.lit(False).alias("heldout"), "chars")))


def cpt_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).where("NOT heldout").groupBy(F.col("source").alias("topic")).agg(F.count(F.lit(1)).alias("n_docs"))


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splitting.systematic_sample(docs, 40, F.col("doc_id")).select("doc_id", "source", "j")


def quiz_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splitting.quiz_windows(table(spark, sf_dir, "documents"), windows=2)
    return found.select("doc_id", F.col("w").cast("long").alias("w"), F.md5("passage").alias("passage_md5"), F.length("passage").cast("long").alias("chars"))


def building_corpus_text(spark: SparkSession, sf_dir: str, max_chars: int = 48_000) -> DataFrame:
    """Folders are sources, files are documents whose suffix follows from doc_id."""
    ending = F.element_at(F.array(*(F.lit(x) for x in (".md", ".txt", ".csv", ".pdf", ".ttl", ".bin"))), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("building"), F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), ending).alias("rel_path"), F.col("text").cast("binary").alias("content"))
    found = files.corpus_texts(rows, max_chars=max_chars)
    return found.select("building", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"), F.array_join("skipped", ",").alias("skipped"), F.size("ignored").cast("long").alias("n_ignored"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk_documents(_docs(spark, sf_dir))
    return found.select("doc_id", "k", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("long").alias("chars"))


QUESTIONS = Inline("question_id long, question string, ignored array<string>", (
    (1001, "What does \"supply air temperature\" of 'AHU_01' say about AHU_01-SF?", ["Main"]),
    (1002, "what are these values?", []),
    (1003, "It's the valve's room that isn't in MAIN: main-building 7x zone:4", ["main", "zone:4"]),
    (1004, "", []),
))
_NAMED = r"[A-Za-z_][A-Za-z0-9_:\-]{2,}"
_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS) + "]"
_KEYS = rf"""list_concat([x[2:length(x) - 1] FOR x IN regexp_extract_all(question, '"([^"]+)"|''([^'']+)''')], [x FOR x IN regexp_extract_all(question, '{_NAMED}') IF regexp_matches(x, '[0-9_:]')])"""
_KEYED = f"""[lower(x) FOR x IN {_KEYS} IF length(x) >= 3 AND NOT list_contains([lower(z) FOR z IN ignored], lower(x))] AS keys,
  [x FOR x IN list_distinct(regexp_extract_all(lower(question), '[a-z]{{4,}}')) IF NOT list_contains({_STOPS}, x) AND NOT list_contains([lower(z) FOR z IN ignored], x)] AS words"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, whole, each asked about one source, and two questions that no chunk answers."""
    found = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("corpus_id"))
    more = spark.createDataFrame([(100_001, "what are these values?", "src3"), (100_002, "about \"nothing that is there\"", "src4")], "question_id long, question string, corpus_id string")
    return found.unionByName(more)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunk_documents(table(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    return rows.select(F.col("source").alias("corpus_id"), F.struct("doc_id", "k").alias("k"), "chunk")


def retrieval_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.expr("CAST(array() AS array<string>)").alias("ignored"))
    found = retrieval.with_keys(asked.unionByName(QUESTIONS.frame(spark)), ignored_col="ignored")
    return found.select("question_id", F.array_join("keys", "|").alias("keys"), F.array_join(F.array_sort("words"), "|").alias("words"))


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunk_scores(_questions(spark, sf_dir), _chunks(spark, sf_dir)).select("question_id", "k.doc_id", "k.k", "score")


def _slices(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus_id"), F.col("doc_id").alias("rank"), "text")
    return retrieval.retrieve(asked, _chunks(spark, sf_dir), retrieval.corpus_heads(docs, retrieval.BUDGET))


def retrieve_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _slices(spark, sf_dir, _questions(spark, sf_dir))
    return found.select("question_id", F.md5("slice").alias("slice_md5"), "n_chunks", F.length("slice").cast("long").alias("chars"))


def retrieve_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question twice: in a word that no chunk has, so that the corpus's head answers it, and, numbered below 0, as it is."""
    asked = _questions(spark, sf_dir).withColumn("question", F.concat(F.lit("zzqx"), F.translate(F.col("question_id").cast("string"), "0123456789", "ghijklmnop")))
    found = _slices(spark, sf_dir, asked.unionByName(_questions(spark, sf_dir).withColumn("question_id", -1 - F.col("question_id"))))
    return found.select("question_id", F.md5("slice").alias("slice_md5"), "n_chunks")


# Windows over lines: prefix sums, then the walk from each window's start to the next.
_CHUNKS = r"""{src},
  pr AS (SELECT rid, doc_id, source, string_split_regex(text, '\n\s*\n') AS ps FROM src),
  pa AS (SELECT rid, doc_id, source, unnest(range(len(ps))) AS p, unnest(ps) AS para FROM pr),
  pf AS (SELECT *, string_split(para, chr(10)) AS ls FROM pa WHERE regexp_matches(para, '\S')),
  pc AS (SELECT *, [list_sum([length(x) + 1 FOR x IN ls[1:k]]) FOR k IN range(1, len(ls) + 1)] AS cum FROM pf WHERE length(para) > 2720),
  wk(rid, doc_id, source, p, i, j) AS (
    SELECT rid, doc_id, source, p, 0::BIGINT, least(len(cum), 1 + len([c FOR c IN cum IF c < 1600]))::BIGINT FROM pc
    UNION ALL
    SELECT pc.rid, pc.doc_id, pc.source, pc.p, greatest(wk.j - 2, wk.i + 1),
           least(len(cum), greatest(wk.j - 2, wk.i + 1) + 1 + len([c FOR c IN cum[greatest(wk.j - 2, wk.i + 1) + 1:] IF c - cum[greatest(wk.j - 2, wk.i + 1)] < 1600]))::BIGINT
    FROM wk JOIN pc USING (rid, p) WHERE greatest(wk.j - 2, wk.i + 1) < len(cum)),
  al AS (SELECT rid, doc_id, source, p, 0::BIGINT AS i, para AS chunk FROM pf WHERE length(para) <= 2720
         UNION ALL SELECT wk.rid, wk.doc_id, wk.source, wk.p, wk.i, array_to_string(pc.ls[wk.i + 1:wk.j], chr(10)) FROM wk JOIN pc USING (rid, p)),
  ch AS (SELECT rid, doc_id, source, row_number() OVER (PARTITION BY rid ORDER BY p, i) - 1 AS k, chunk FROM al)"""
_DOC_CHUNKS = _CHUNKS.replace("{src}", "src AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents)")
_ASKED = f"""q0 AS (SELECT item_id AS question_id, text AS question, 'src' || (item_id % 20) AS corpus_id, []::VARCHAR[] AS ignored FROM benchmark
           UNION ALL SELECT 100001, 'what are these values?', 'src3', [] UNION ALL SELECT 100002, 'about "nothing that is there"', 'src4', []),
  qk AS (SELECT question_id, corpus_id, {_KEYED} FROM q0),
  sc AS (SELECT question_id, doc_id, k, chunk, (10 * len([x FOR x IN keys IF contains(lower(chunk), x)]) + len([x FOR x IN words IF contains(lower(chunk), x)]))::BIGINT AS score
         FROM qk JOIN ch ON ch.source = qk.corpus_id)"""
_ASKED_TWICE = _ASKED.replace("qk AS (", "q0 AS (SELECT 'zzqx' || translate(question_id::VARCHAR, '0123456789', 'ghijklmnop') AS question, * EXCLUDE question FROM q1 UNION ALL SELECT question, -1 - question_id, corpus_id, ignored FROM q1),\n  qk AS (").replace("q0 AS (SELECT item_id", "q1 AS (SELECT item_id")
_SLICES = """WITH RECURSIVE {chunks}, {asked},
  rk AS (SELECT *, row_number() OVER w AS r, sum(length(chunk)) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, doc_id, k)),
  pk AS (SELECT question_id, substr(string_agg(chunk, chr(10) || chr(10) ORDER BY doc_id, k), 1, {budget}) AS slice, count(*) AS n FROM rk WHERE r = 1 OR running <= {budget} GROUP BY question_id),
  hd AS (SELECT source AS corpus_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), 1, {budget}) AS head FROM documents GROUP BY source),
  an AS (SELECT question_id, coalesce(slice, head, '') AS slice, coalesce(n, 0)::BIGINT AS n_chunks FROM q0 LEFT JOIN pk USING (question_id) LEFT JOIN hd USING (corpus_id))"""

_PATH = "'d/' || lpad(doc_id::VARCHAR, 9, '0') || ['.md', '.txt', '.csv', '.pdf', '.ttl', '.bin'][doc_id % 6 + 1]"
QUERIES = {f.__name__: f for f in (
    clean_body, clean_noise_flags, clean_repeated_lines, clean_tail_cut, clean_dehyphenate, thin_filter_report, cpt_split, cpt_provenance, cpt_topics, systematic_sample,
    quiz_windows, building_corpus_text, chunk_documents, retrieval_keys, chunk_scores, retrieve_slices, retrieve_fallback,
)}
ORACLES = {
    "clean_body": f"WITH {_BODIES} SELECT doc_id, body FROM bd",
    "clean_noise_flags": f"""WITH {_LINES.replace(_SRC, "src AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents)")},
      ev AS (SELECT line FROM sl UNION ALL SELECT line FROM {LINES.sql}), fl AS (SELECT line, ({_NOISE.format(s="line")})::BIGINT AS rule FROM ev)
      SELECT line, rule, count(*) AS n FROM fl WHERE rule > 0 GROUP BY line, rule""",
    "clean_repeated_lines": f"WITH {_LINES} SELECT doc_id, form, count(*) AS repeats FROM kp WHERE length(form) >= 15 GROUP BY rid, doc_id, form HAVING count(*) >= 4",
    "clean_tail_cut": f"WITH {_LINES} SELECT doc_id, (SELECT count(*) FROM kp WHERE kp.rid = src.rid) AS n_lines FROM src",
    "clean_dehyphenate": f"WITH {_LINES} SELECT doc_id, t AS text FROM hy",
    "thin_filter_report": f"WITH {_BODIES} SELECT doc_id, chars, thin FROM th",
    "cpt_split": f"WITH {_BODIES} SELECT doc_id, source AS topic, chars, (row_number() OVER (ORDER BY doc_id) - 1) % 20 = 0 AS heldout FROM th WHERE NOT thin",
    "cpt_provenance": f"""WITH {_BODIES}, sp2 AS (SELECT *, (row_number() OVER (PARTITION BY thin ORDER BY doc_id) - 1) % 20 = 0 AND NOT thin AS heldout FROM th)
      SELECT count(*) FILTER (NOT thin AND NOT heldout) AS n_train, count(*) FILTER (heldout) AS n_heldout, count(*) FILTER (thin) AS n_dropped_thin,
             coalesce(sum(chars) FILTER (NOT thin AND NOT heldout), 0)::BIGINT AS train_chars, (coalesce(sum(chars) FILTER (NOT thin AND NOT heldout), 0)::BIGINT // 4)::BIGINT AS train_tokens_est FROM sp2""",
    "cpt_topics": f"""WITH {_BODIES}, sp2 AS (SELECT source, (row_number() OVER (ORDER BY doc_id) - 1) % 20 = 0 AS heldout FROM th WHERE NOT thin)
      SELECT source AS topic, count(*) AS n_docs FROM sp2 WHERE NOT heldout GROUP BY source""",
    "systematic_sample": """WITH o AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER () // 40) AS step FROM documents)
      SELECT doc_id, source, (i // step)::BIGINT AS j FROM o WHERE i % step = 0 AND i < step * 40""",
    "quiz_windows": rf"""WITH p AS (SELECT doc_id, w, {_STRIP.format(s="substr(text, (w * 1800 + 1)::BIGINT, 1800)")} AS passage FROM documents, (SELECT unnest([0, 1])::BIGINT AS w))
      SELECT doc_id, w, md5(passage) AS passage_md5, length(passage)::BIGINT AS chars FROM p WHERE length(passage) >= 400""",
    "building_corpus_text": f"""WITH f AS (SELECT source AS building, {_PATH} AS path, text, doc_id % 6 AS e, [3, 1, 2, 9, 0, 9][doc_id % 6 + 1] AS rank FROM documents),
      t AS (SELECT building, substr(string_agg('# FILE: ' || path || chr(10) || text, chr(10) || chr(10) ORDER BY rank, path) FILTER (e NOT IN (3, 5)), 1, 48000) AS text,
                   coalesce(string_agg(substr(path, 3), ',' ORDER BY path) FILTER (e = 3), '') AS skipped, count(*) FILTER (e = 5) AS n_ignored FROM f GROUP BY building)
      SELECT building, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, ''))::BIGINT AS chars, skipped, n_ignored FROM t""",
    "chunk_documents": f"WITH RECURSIVE {_CHUNKS.replace('{src}', _SRC)} SELECT doc_id, k, md5(chunk) AS chunk_md5, length(chunk)::BIGINT AS chars FROM ch",
    "retrieval_keys": f"""WITH q AS (SELECT item_id AS question_id, text AS question, []::VARCHAR[] AS ignored FROM benchmark UNION ALL SELECT question_id, question, ignored FROM {QUESTIONS.sql}),
      k AS (SELECT question_id, {_KEYED} FROM q) SELECT question_id, array_to_string(keys, '|') AS keys, array_to_string(list_sort(words), '|') AS words FROM k""",
    "chunk_scores": f"WITH RECURSIVE {_DOC_CHUNKS}, {_ASKED} SELECT question_id, doc_id, k, score FROM sc WHERE score > 0",
    "retrieve_slices": _SLICES.format(chunks=_DOC_CHUNKS, asked=_ASKED, budget=retrieval.BUDGET) + " SELECT question_id, md5(slice) AS slice_md5, n_chunks, length(slice)::BIGINT AS chars FROM an",
    "retrieve_fallback": _SLICES.format(chunks=_DOC_CHUNKS, asked=_ASKED_TWICE, budget=retrieval.BUDGET) + " SELECT question_id, md5(slice) AS slice_md5, n_chunks FROM an",
}
