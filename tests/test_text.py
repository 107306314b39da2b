"""Goldens of the rules, worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking, cleaning, gating, grading, telemetry


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("line", "rule"), [
    ("12", 1), ("12345", 7 if len("12345") >= 8 else 0), ("xiv", 2), ("iiiiiiii", 0), ("DOI: 10.1", 3), ("www.x.org", 3), ("[12] ref", 4), ("(12) ref", 4), ("(12)ref", 0),
    ("All Rights Reserved.", 5), ("This article needs sources", 6), ("This article is fine", 0), ("1234 5678", 7), ("a=b+c", 0), ("ordinary words here", 0),
])
def test_noise_rules(spark, line, rule):
    assert one(spark, T.noise_rule(F.col("s")), s=line) == rule


@pytest.mark.parametrize(("text", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\nb", ["a", "", "b"]), ("a\r\nb\rc", ["a", "b", "c"]), ("a\x0bb\x0cc\x1cd\x85e f", list("abcdef"))])
def test_split_lines_is_splitlines(spark, text, lines):
    assert text.splitlines() == lines
    assert one(spark, T.split_lines(F.col("s")), s=text) == lines


@pytest.mark.parametrize("text", ["  a b \t\n", "  x　", "", " \x1c y \x1f", "a"])
def test_strip_is_python_strip(spark, text):
    assert one(spark, T.strip(F.col("s")), s=text) == text.strip()


@pytest.mark.parametrize(("text", "number"), [("#### 1,234.", "1234"), ("a 5-3", "-3"), ("x", None), ("1 #### 2 #### 3.50", "3.50"), ("#### ", None), ("٣٤", "٣٤"), ("5.", "5")])
def test_final_number(spark, text, number):
    assert one(spark, T.final_number(F.col("s")), s=text) == number


@pytest.mark.parametrize(("gold", "said", "reward"), [
    ("type:AHU|Fan", "a fan.", 1.0), ("type:Coil", "coils", 0.0), ("count:5", "5 of 05", 0.0), ("count:5", "it is 5", 1.0), ("conns:a-1|b-2", "A 1 only", 0.5), ("conns:", "x", 0.0), ("type:?", "!", 1.0),
])
def test_tagged_rewards(spark, gold, said, reward):
    assert one(spark, grading.tagged_reward(F.col("p"), F.col("g")), p=said, g=gold) == pytest.approx(reward)


@pytest.mark.parametrize(("choices", "answer", "loose", "strict"), [(list("abcd"), "B", True, True), (list("abcd"), "", True, False), (list("abcd"), "BC", True, False), (list("abc"), "B", False, False), (list("abcd"), "E", False, False)])
def test_choices_valid(spark, choices, answer, loose, strict):
    row = spark.createDataFrame([(choices, answer)], "c array<string>, a string")
    found = row.select(grading.choices_valid(F.col("c"), F.col("a")).alias("l"), grading.choices_valid(F.col("c"), F.col("a"), strict=True).alias("s")).first()
    assert (found.l, found.s) == (loose, strict)


def test_chunks_of_long_paragraphs_cover_every_line():
    lines = [f"line {i} " + "x" * (i * 37 % 190) for i in range(120)]
    found = list(chunking.chunks_of("\n".join(lines)))
    assert {x for c in found for x in c.split("\n")} == set(lines)
    assert found[0].split("\n")[-2:] == found[1].split("\n")[:2]


@pytest.mark.parametrize(("size", "n"), [(2720, 1), (2721, 1), (5000, 1)])
def test_single_lines_stay_whole(size, n):
    assert list(chunking.chunks_of("x" * size)) == ["x" * size] * n


def test_blank_text_has_no_chunks():
    assert list(chunking.chunks_of(" \n \n ")) == []
    assert list(chunking.chunks_of("a\n\n \n\nb")) == ["a", "b"]


def test_results_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = {r.doc_id: r.body for r in cleaning.clean_bodies(docs).collect()}
    b = {r.doc_id: r.body for r in cleaning.clean_bodies(docs.repartition(7)).collect()}
    assert a == b and len(a) == docs.count()


def test_generator_is_a_pluggable_column(spark):
    rows = spark.createDataFrame([("1", "find", None, None, "what is alpha beta", ["alpha", "beta"], "alpha beta gamma")], "id string, intent string, persona string, source string, question string, anchors array<string>, slice string")
    found = gating.grounding_gate(rows, "sys", gating.generator(gating.echo_client)).collect()
    assert [m.role for m in found[0].messages] == ["system", "user", "assistant"]
    assert "alpha beta" in found[0].messages[2].content


def test_best_pointer_replay_compares_with_rounded_values():
    assert telemetry.best_replay([(1, 0.51236), (2, 0.51238), (3, 0.5)]) == (1, 0.5124)
    assert telemetry.best_replay([(1, 0.51234), (2, 0.512339)]) == (2, 0.5123)
    assert telemetry.best_replay([]) is None


@pytest.mark.parametrize(("x", "text"), [(1234.6, "1235"), (12.34567, "12.346"), (0.0, "0"), (0.123456, "0.123"), (0.00123456, "0.00123"), (-0.5, "-0.500"), (None, "\u2014")])
def test_number_text(spark, x, text):
    row = spark.createDataFrame([(x,)], "x double")
    assert row.select(telemetry.number_text(F.col("x")).alias("t")).first().t == text


@pytest.mark.parametrize(("x", "text"), [(3723.9, "1h 2m 03s"), (59.0, "0m 59s"), (-5.0, "0m 00s"), (None, "\u2014")])
def test_duration_text(spark, x, text):
    row = spark.createDataFrame([(x,)], "x double")
    assert row.select(telemetry.duration_text(F.col("x")).alias("t")).first().t == text


def test_a_slice_is_normalised_once_for_all_its_anchors(spark, small):
    from corpusmill.plans.catalogue import QUERIES

    for name in ("grounding_gate", "reward_rows"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("replace(slice#") == 1 and "lower(slice#" not in plan, name


def test_normal_forms_and_anchors_of_odd_texts(spark):
    def plain(t):
        kept = re.sub(r"[^a-z0-9./:\- ]+", " ", t.lower().replace("_", " "))
        return re.sub(r" +", " ", kept).strip(" ")

    texts = ["", " ", "a  b", " _a_ _b_", "A\n\nb", "a \n b", "é é", "a. b", "x_y__z", "!?", "a !b", "a! b", "  -1 :/", "one two\tthree ", "a\x0bb", "\u212aelvin \u0130x", "ÀÉ Sſ Ωa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = {r.id: r.n for r in rows.select("id", T.anchor_norm(F.col("t")).alias("n")).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}
    rows = spark.createDataFrame([(1, ["one", "absent", None, "two words", "words two"], "One, two\n words"), (2, ["x"], None), (3, None, "x"), (4, [], "x")], "id int, anchors array<string>, t string")
    got = {r.id: r.found for r in rows.select("id", T.anchors_in(F.col("anchors"), F.col("t")).alias("found")).collect()}
    assert got == {1: ["one", "two words", "words two"], 2: [], 3: None, 4: []}
