"""Readers, writers, packs, and the stream, on files made here."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import artifacts, graph, splitting
from corpusmill.sources import files, packs, triples, xlsx


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    for path, body in {
        "b1/x.ttl": b"@prefix : <http://x.org/a#> . @prefix s: <http://x.org/s#> .\n:e1 a s:Fan, s:Device ; s:comment \"the \\\"main\\\" fan\"@en ; s:cnx :c1 , [ s:label 'inner' ] . # end\n:e2 s:size 3.5 ; s:ok true .",
        "b1/sub/n.txt": b"plain \xff text", "b1/sub/p.pdf": b"%PDF", "b1/z.bin": b"?", "b1/t.csv": b"a,b", "b2/bad.ttl": b"<http://a> <http://b> \"unclosed .", "b2/good.ttl": b"<http://a/s> <http://a/p> <http://a/o> .",
        "_hidden/x.ttl": b"", "b3/only.txt": b"no graph", "documentations/x.ttl": b"",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    with zipfile.ZipFile(root / "b1/book.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    return str(root)


def test_folder_becomes_ordered_text(spark, folder):
    found = {r.building: r for r in files.corpus_texts(files.folder_files(spark, folder)).collect()}
    text = found["b1"].text
    assert [x[8:] for x in text.split("\n") if x.startswith("# FILE: ")] == ["x.ttl", "sub/n.txt", "t.csv", "book.xlsx"]
    assert "plain � text" in text and "## sheet: One\nname\t\t2.5\n\tin" in text
    assert found["b1"].skipped == ["p.pdf"] and found["b1"].ignored == ["z.bin"]
    cut = files.corpus_texts(files.folder_files(spark, folder), max_chars=20).where("building = 'b1'").first().text
    assert cut == text[:20]
    assert sorted(r.building for r in files.building_names(files.folder_files(spark, folder)).collect()) == ["b1", "b2"]


def test_turtle_files_become_entities(spark, folder):
    parsed = triples.parsed_files(files.folder_files(spark, folder).where("rel_path LIKE '%.ttl'"))
    assert [(r.building, r.rel_path) for r in triples.bad_files(parsed).collect()] == [("b2", "bad.ttl")]
    found = {r.uri: r for r in graph.entity_index(triples.triples(parsed)).collect()}
    assert set(found) == {"http://x.org/a#e1"}
    e = found["http://x.org/a#e1"]
    assert (e.types, e.comment, e.name) == (["Device", "Fan"], 'the "main" fan', "e1") and "c1" in e.connections and len(e.connections) == 2


def test_turtle_collections_and_numbers():
    found = triples.Turtle("PREFIX x: <http://x/>\nx:a x:list (1 \"two\" x:c) ; x:n -4.5e3 .").read()
    assert ("http://x/a", "http://x/n", "-4.5e3") in found
    assert [o for _, p, o in found if p.endswith("first")] == ["http://x/c", "two", "1"]


def test_unreadable_workbook_is_null(spark):
    row = spark.createDataFrame([(bytearray(b"no zip"),)], "content binary")
    assert row.select(xlsx.workbook_text(F.col("content")).alias("x")).first().x is None


def test_json_readers(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.strict_json_lines(spark, path, "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    assert [r.a for r in files.tolerant_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()] == [1]
    assert files.tolerant_json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    assert files.run_metas(spark, str(tmp_path / "nowhere")).count() == 0
    assert files.run_event_files(spark, str(tmp_path), "a", "r", "step int").count() == 0
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        files.strict_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "doc.json").write_text('[\n{"a": 3},\n{"a": 4}\n]')
    assert sorted(r.a for r in files.json_document(spark, str(tmp_path / "doc.json"), "a int").collect()) == [3, 4]


def test_run_metas_skip_what_cannot_be_read(spark, tmp_path):
    for exp, run, body in (("a", "r1", json.dumps({"exp": "a", "run_id": "r1", "started": 1.0})), ("a", "r2", "{nope")):
        p = tmp_path / exp / "runs" / run
        p.mkdir(parents=True)
        (p / "meta.json").write_text(body)
    assert [r.run_id for r in files.run_metas(spark, str(tmp_path)).collect()] == ["r1"]


def test_manifest_wants_its_texts(spark):
    manifest = spark.createDataFrame([("1", "t", "ok", "a.txt"), ("2", "t", "failed", "b.txt"), ("3", "t", "ok", "")], "id string, topic string, status string, text_path string")
    texts = spark.createDataFrame([("a.txt", "body")], "text_path string, text string")
    assert [tuple(r) for r in files.manifest_documents(manifest, texts).collect()] == [("1", "t", "body")]
    with pytest.raises(Exception, match="no text at"):
        files.manifest_documents(manifest, texts.where("text = ''")).collect()


def test_artifacts_are_content_addressed(spark, tmp_path):
    root, spec = str(tmp_path / "art"), {"b": 1, "a": [1, "é"]}
    assert artifacts.dataset_id(spec) == artifacts.dataset_id({"a": [1, "é"], "b": 1})
    assert artifacts.latest(spark, root) is None
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    first = artifacts.cached(spark, root, spec, build, lambda rows: {"rows": rows.count()})
    artifacts.cached(spark, root, {"other": 1}, lambda: spark.range(1))
    assert artifacts.cached(spark, root, spec, build) == first and built == [1]
    assert artifacts.latest(spark, root) == artifacts.artifact_path(root, {"other": 1})  # a hit leaves the pointer
    made = artifacts.provenance(spark, first)
    assert (made["n"], made["stats"], made["spec"]) == (3, {"rows": 3}, spec)
    artifacts.write_exam(spark.range(1), f"{root}/exam")
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_exam(spark.range(1), f"{root}/exam")


def test_best_checkpoint(spark):
    pointer = spark.createDataFrame([("sft", "m", 0.5, "out/sft")], "stage string, metric string, value double, path string")
    assert artifacts.best_checkpoint(pointer) == "out/sft" and artifacts.best_checkpoint(pointer, "mine") == "mine"
    with pytest.raises(FileNotFoundError):
        artifacts.best_checkpoint(None)


def test_packs_have_the_contract():
    assert packs.load("numbers").is_correct and packs.load("building").load_split
    with pytest.raises(FileNotFoundError):
        packs.load("unknown")
    with pytest.raises(AttributeError, match="lacks"):
        packs.register("broken", object())


def test_split_is_complete_and_disjoint(spark):
    docs = spark.range(0, 103).withColumnRenamed("id", "doc_id")
    rows = splitting.systematic_holdout(docs.repartition(5), F.col("doc_id")).collect()
    assert sorted(r.doc_id for r in rows if r.heldout) == list(range(0, 103, 20))
    assert sorted(r.i for r in rows) == list(range(103))


def test_seeded_take_is_the_generators_shuffle(spark):
    import random

    rows = [f"t{i:02d}" for i in range(30)]
    wanted = list(rows)
    random.Random(3407).shuffle(wanted)
    df = spark.createDataFrame([(x,) for x in rows], "t string").repartition(3)
    assert [r.t for r in splitting.seeded_take(df, 7, F.col("t")).orderBy("place").collect()] == wanted[:7]
    assert splitting.seeded_take(df, None, F.col("t")).count() == 30


def test_split_writer(spark, tmp_path):
    docs = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (3, False, "c")], "doc_id int, heldout boolean, text string")
    artifacts.write_split(docs, str(tmp_path / "cpt"), spark.createDataFrame([(2, 1)], "n_train int, n_heldout int"))
    assert spark.read.json(str(tmp_path / "cpt/train.jsonl")).count() == 2


def test_index_is_built_once(spark, tmp_path):
    path, built = str(tmp_path / "index"), []

    def build():
        built.append(1)
        return spark.createDataFrame([("b", "u")], "building string, uri string")

    for _ in range(2):
        assert artifacts.load_index(spark, path, build).count() == 1
    assert built == [1]


def test_folders_with_signs_of_patterns_in_their_names(spark, tmp_path):
    root = tmp_path / "a+b (c) [1]"
    (root / "b1" / "d").mkdir(parents=True)
    (root / "b1" / "d" / "x.txt").write_text("hi")
    assert [(r.building, r.rel_path) for r in files.folder_files(spark, str(root)).collect()] == [("b1", "d/x.txt")]


def test_relative_iris_are_resolved():
    from corpusmill.sources.triples import resolved

    base = "http://x.org/a/b?q#f"
    assert [resolved(base, r) for r in ("c", "#g", "/d", "../e", "", "//y.org/z", "?r")] == ["http://x.org/a/c", "http://x.org/a/b?q#g", "http://x.org/d", "http://x.org/e", "http://x.org/a/b?q", "http://y.org/z", "http://x.org/a/b?r"]
    assert resolved("urn://x/a/b", "c") == "urn://x/a/c" and resolved("", "c") == "c"


def test_backends_are_dispatched():
    from corpusmill.operators import gating

    clients = {"local": lambda model, prompts: [f"{model}:{p}" for p in prompts]}
    assert gating.dispatched("local:m:7b", clients)(["a"]) == ["m:7b:a"]
    with pytest.raises(ValueError, match="unknown backend provider: 'other'"):
        gating.dispatched("other:m", clients)
