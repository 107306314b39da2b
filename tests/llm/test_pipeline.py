"""The queries and the pipeline on the smallest tables."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from corpusmill.llm.common import staged
from corpusmill.llm.queries import ORACLES, QUERIES

from test_operators import WORDS, brute_components, brute_spans, brute_targets


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        path = f"{small}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    found, wanted = QUERIES[name](spark, small), duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(r[i] for i in at) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_document(spark, small, name):
    assert QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, small), f"test-{name}")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] == counts[5]
    assert docs.where("NOT exact").count() == 0


def test_secrets_are_gone(spark, small):
    from corpusmill.llm import secrets

    small = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean = corpus_pipeline.without_secrets(spark, docs, small)
    before, after = (secrets.scan(x).where("size(spans) > 0").count() for x in (docs, clean))
    assert before > 0 and after == 0
    same = clean.join(docs.withColumnRenamed("text", "old"), "doc_id").where("text = old").count()
    assert same == docs.count() - before


def test_stages_take_odd_rows_and_none(spark, odd, none, small):
    for name, stage in corpus_pipeline.STAGES:
        odd, none = staged(stage(spark, odd, small), f"odd-{name}"), staged(stage(spark, none, small), f"none-{name}")
        assert none.count() == 0
    # 1 stands for 2, 3 and the null id's copy, 8 for 9; rows 12 and 17 lose their secrets.
    rows = odd.collect()
    assert {r.doc_id for r in rows}.isdisjoint({2, 3, 9}) and {r.doc_id for r in rows} <= {None, *range(1, 18)}
    assert all(r.exact for r in rows if r.doc_id != 13) and all(len(r.ids) == r.n_pieces for r in rows)


def brute_pipeline(rows, scores, library):
    """(doc_id, ids) of the stages, one after another, in plain Python; rows are (doc_id, text, source), scores the toxicity model's."""
    kept = [r for r in rows if scores[r[0]] < 0.5]
    group = brute_components([r[:2] for r in kept], 5, 80)
    kept = [r for r, (d, n, least) in zip(kept, group, strict=True) if not n or d == least]

    def redacted(text):
        out, at, spans = "", 0, []
        for a, _, b in brute_spans(text):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        for a, b in spans:
            out, at = out + text[at:a] + "[secret]", b
        return out + text[at:]

    kept = [(d, redacted(t), s) for d, t, s in kept]
    size = {d: len(WORDS.findall(t)) for d, t, _ in kept}
    sizes = defaultdict(int)
    for d, _, s in kept:
        sizes[s] += size[d]
    target, mixed = brute_targets(sizes, (3, 1, 2), 1.5, 2.0), []
    for s in sizes:
        u = int(hashlib.md5(f"7:{s}".encode()).hexdigest()[:8], 16) / 2**32
        each = target[s] / sizes[s] if sizes[s] else 0.0
        for k, (d, t, _) in enumerate(sorted((r for r in kept if r[2] == s), key=lambda r: (size[r[0]], r[0])), 1):
            mixed += [(d, t)] * (math.floor(u + k * each) - math.floor(u + (k - 1) * each))
    return Counter((d, tuple(library.encode(t))) for d, t in mixed)


def test_run_equals_brute_force(spark, small):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from corpusmill.llm import toxicity

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = brute_pipeline([(r.doc_id, r.text, r.source) for r in docs.collect()], scores, library)
    found = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == wanted
    assert all(r.exact and r.n_pieces == len(r.ids) for r in found)
