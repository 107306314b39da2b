"""Queries over whole tables: nothing of the input is left out."""

from corpusmill.plans.catalogue import QUERIES


def test_connections_are_of_all_suppliers_and_names(spark, small):
    item, part = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("lineitem", "part"))
    wanted = {r.l_partkey: r.s for r in item.selectExpr("l_partkey", "'S' || l_suppkey AS s").groupBy("l_partkey").agg({"s": "collect_set"}).toDF("l_partkey", "s").collect()}
    found = {r.uri.rpartition("#P")[2]: r for r in QUERIES["entity_index"](spark, small).collect()}
    for p in part.collect():
        row = found[str(p.p_partkey)]
        assert row.comment == f"{p.p_name} {p.p_partkey}"
        assert row.connections == "|".join(sorted(wanted.get(p.p_partkey, [])))


def test_questions_are_whole_and_fall_back_alike(spark, small):
    from corpusmill.plans import cleaning

    asked = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    found = {r.question_id: r.question for r in cleaning._questions(spark, small).collect()}
    assert any(len(t) > 300 for t in asked.values())
    assert {i: found[i] for i in asked} == asked
    slices = {r.question_id: (r.slice_md5, r.n_chunks) for r in QUERIES["retrieve_slices"](spark, small).collect()}
    fallback = {r.question_id: (r.slice_md5, r.n_chunks) for r in QUERIES["retrieve_fallback"](spark, small).collect()}
    assert {-1 - q: x for q, x in fallback.items() if q < 0} == slices and set(slices) == set(found)
    assert set(fallback) == {*found, *(-1 - q for q in found)} and all(fallback[q][1] == 0 for q in found)


def test_automata_and_single_terms_score_alike(spark, small, monkeypatch):
    from corpusmill.operators import retrieval

    rows = [("c", 1, "The VALVE of ahu_01 and ahu_01"), ("c", 2, "valveless"), ("d", 1, "valve"), ("c", 3, None), (None, 4, "valve"), ("c", 5, "")]
    chunks = spark.createDataFrame(rows, "corpus_id string, k int, chunk string")
    asked = spark.createDataFrame([(7, "c", "what of the valve, 'AHU_01' and ahu_01?"), (8, "c", None), (9, "d", "valve"), (10, "c", "valveless things")], "question_id int, corpus_id string, question string")
    wanted = {(7, "c", 1, 30, 31), (7, "c", 2, 9, 1), (9, "d", 1, 5, 1), (10, "c", 2, 9, 1)}
    for most in (retrieval.BROADCAST_BYTES, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", most)
        assert {tuple(r) for r in retrieval.chunk_scores(asked, chunks).collect()} == wanted


def test_a_source_has_48000_characters(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("source", "length(text) AS n", "doc_id % 6 AS e").where("e NOT IN (3, 5)").groupBy("source").sum("n").collect()
    found = {r.building: r.chars for r in QUERIES["building_corpus_text"](spark, small).collect()}
    assert any(r[1] > 20_000 for r in docs)
    assert all(found[r.source] >= min(r[1], 48_000) for r in docs)


def test_queries_read_the_tables_besides_their_inline_rows(spark, small):
    n = {t: spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "events")}
    docs, users = n["documents"].count(), n["events"].select("user_id").distinct().count()
    judged = n["documents"].join(n["labels"], "doc_id").count()
    wanted = {"clean_dehyphenate": docs + 13, "gsm_reward": docs + 11, "judge_scores": judged + 9, "run_summary": users + 6}
    assert {name: QUERIES[name](spark, small).count() for name in wanted} == wanted
    assert QUERIES["judge_summary"](spark, small).first().n == judged + 9
    assert QUERIES["grounding_gate"](spark, small).count() > 9 and QUERIES["reward_rows"](spark, small).count() > docs / 2
    values = {r.user_id: r[1] for r in n["events"].groupBy("user_id").max("value").collect()}
    best = QUERIES["best_run"](spark, small).first()
    assert best.run_order == min(u for u, v in values.items() if v == max(values.values()))


def test_rows_are_cleaned_by_themselves(spark):
    from corpusmill.operators import cleaning

    footer = "A footer of twenty characters"
    rows = [(None, "one\n12\ntwo"), (1, "\n".join([footer] * 3)), (1, footer), (2, None), (2, ""), (3, "\n".join([footer] * 4 + ["left"])), (3, "\n".join([footer] * 4 + ["left"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = cleaning.clean_bodies(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(None, "one\ntwo"), (1, "\n".join([footer] * 3)), (1, footer), (2, ""), (2, ""), (3, "left"), (3, "left")], key=repr)
    assert [tuple(r) for r in cleaning.repeated_lines(docs).collect()] == [(3, footer, 4)] * 2
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
