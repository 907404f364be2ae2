import json

import pytest

from driftline.sources import records


def put(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def pair(k, **more):
    return json.dumps({"pair_id": k, "corpus": "web", "prompt": "p", "reference_text": "tëxt", "source": {"doc_id": "1"}, "register": "blog", "prompt_generator": "g", "word_count": 2, "schema_version": 1} | more, ensure_ascii=False)


def test_strict_read(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", [pair("p1"), "", pair("p2")])
    assert [r["pair_id"] for r in records.read_strict(spark, good, "pair").collect()] == ["p1", "p2"]
    broken = {"version": pair("p", schema_version=2), "keys": pair("p", surprise=1), "json": "{torn"}
    for kind, line in broken.items():
        with pytest.raises(Exception, match=kind):
            records.read_strict(spark, put(tmp_path / f"{kind}.jsonl", [pair("p1"), line]), "pair").collect()
    missing = json.loads(pair("p"))
    del missing["prompt"]
    with pytest.raises(Exception, match="keys"):
        records.read_strict(spark, put(tmp_path / "m.jsonl", [json.dumps(missing)]), "pair").collect()


def test_enumerations(spark, tmp_path):
    v = {"pair_id": "p", "dimension": "overall", "judge_model": "j", "order": "model_first", "raw_response": "A", "choice": "A", "retry_count": 0, "schema_version": 1}
    assert records.read_strict(spark, put(tmp_path / "v.jsonl", [json.dumps(v)]), "verdict").first()["model_won"] is None
    for k in ("dimension", "order", "choice"):
        with pytest.raises(Exception, match="value"):
            records.read_strict(spark, put(tmp_path / f"{k}.jsonl", [json.dumps(v | {k: "other"})]), "verdict").collect()


def test_tolerant_read_keeps_the_last(spark, tmp_path):
    path = put(tmp_path / "t.jsonl", [pair("p1", prompt="old"), "{torn", pair("p2"), pair("p1", prompt="new"), pair("p3", schema_version=9)])
    good, bad = records.read_tolerant(spark, path, "pair")
    assert {r["pair_id"]: r["prompt"] for r in good.collect()} == {"p1": "new", "p2": "p"}
    assert [r["pair_id"] for r in good.orderBy("line_no").collect()] == ["p2", "p1"]
    assert bad.first()["bad_lines"] == 2
    assert records.count_bad(spark, path).first()["bad_lines"] == 1


def test_round_trip_keeps_other_scripts(spark, tmp_path):
    df = records.read_strict(spark, put(tmp_path / "a.jsonl", [pair("p1")]), "pair")
    records.write_lines(df, str(tmp_path / "out"), "pair")
    records.write_lines(df.withColumn("pair_id", records.F.lit("p2")), str(tmp_path / "out"), "pair")
    back = records.read_strict(spark, str(tmp_path / "out"), "pair")
    assert sorted(r["pair_id"] for r in back.collect()) == ["p1", "p2"] and back.first()["reference_text"] == "tëxt"


def manifest(tmp_path, ids, texts, **more):
    put(tmp_path / "s.jsonl", [json.dumps(t) for t in texts])
    m = {"set_id": "s", "role": "rewrite", "corpus": "web", "pair_ids": ids, "schema_version": 1} | more
    (tmp_path / "s.manifest.json").write_text(json.dumps(m))
    return tmp_path / "s.manifest.json"


def test_sets(spark, tmp_path):
    two = [{"pair_id": "p1", "text": "a"}, {"pair_id": "p2", "text": "b"}]
    m, df = records.read_set(spark, manifest(tmp_path, ["p2", "p1"], two, round=1))
    assert [r["pair_id"] for r in df.collect()] == ["p2", "p1"] and m["round"] == 1
    for bad, what in ((manifest(tmp_path, ["p1", "p9"], two), "p9"), ):
        with pytest.raises(records.RecordError, match=what):
            records.read_set(spark, bad)
    with pytest.raises(records.RecordError, match="more than once"):
        records.read_set(spark, manifest(tmp_path, ["p1", "p1"], two))
    with pytest.raises(records.RecordError, match="more than once"):
        records.read_set(spark, manifest(tmp_path, ["p1"], [two[0], two[0]]))
    with pytest.raises(records.RecordError, match="round"):
        records.read_set(spark, manifest(tmp_path, ["p1"], two, role="instruct_draft", round=1))
    with pytest.raises(records.RecordError, match="schema_version"):
        records.read_set(spark, manifest(tmp_path, ["p1"], two, schema_version=2))
    assert records.texts_path("d/x.manifest.json", {}).name == "x.jsonl"
    assert str(records.texts_path("d/x.manifest.json", {"texts_path": "t/y.jsonl"})) == "d/t/y.jsonl"


def test_rewriter_output(spark, tmp_path):
    ordered = spark.createDataFrame([(0, "p1"), (1, "p2")], "ord int, pair_id string")

    def out(rows, name):
        spark.createDataFrame(rows, "source_row_index int, round int, output_text string").write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    got = records.rewriter_output(spark, out([(1, 1, "b"), (0, 1, "a")], "ok"), ordered)
    assert {r["pair_id"]: r["text"] for r in got.collect()} == {"p1": "a", "p2": "b"}
    for rows, name, what in (([(0, 1, "a")], "few", "p2"), ([(0, 1, "a"), (0, 1, "b"), (1, 1, "c")], "twice", "more than once"), ([(0, 1, "a"), (1, 1, "b"), (7, 1, "c")], "far", "7"), ([(0, 1, " "), (1, 1, "b")], "blank", "p1")):
        with pytest.raises(records.RecordError, match=what):
            records.rewriter_output(spark, out(rows, name), ordered)


def test_import_of_drafts(spark, tmp_path):
    ok = put(tmp_path / "d.jsonl", ['{"pair_id": "p1", "text": "t"}', '{"pair_id": "p2", "text": "u", "prompt": "q"}'])
    assert {r["pair_id"]: r["prompt"] for r in records.import_drafts(spark, ok).collect()} == {"p1": "", "p2": "q"}
    for name, lines in (("json", ["{torn"]), ("field", ['{"pair_id": "p"}']), ("blank", ['{"pair_id": "p", "text": " "}']), ("empty", [""]), ("twice", ['{"pair_id": "p", "text": "t"}'] * 2)):
        with pytest.raises(records.RecordError):
            records.import_drafts(spark, put(tmp_path / f"{name}.jsonl", lines))


def test_bundles_of_a_run(spark, tmp_path):
    full = {"run_id": "r", "pair_id": "p1", "prompt": "q", "draft": {"text": "t", "model_id": "m", "sampling": {"temperature": 0.7, "top_p": 0.9, "seed": 1}}, "rounds": [], "final_round": 0,
            "degeneration": {}, "adapter_id": "a", "config": {}, "requested_k": 0, "schema_version": 1}
    ok = put(tmp_path / "ok.jsonl", [json.dumps(full), "{torn"])
    assert records.nascent_bundles(spark, ok).first()["draft"]["text"] == "t"
    for name, lines in (("empty", [""]), ("draftless", [json.dumps(full | {"draft": None})])):
        with pytest.raises(records.RecordError, match="no "):
            records.nascent_bundles(spark, put(tmp_path / f"{name}.jsonl", lines))


def test_shorter_runs_leave_no_rounds_behind(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", "a"), (2, "p", "b")], "k int, pair_id string, text string")
    records.write_rounds(rows, f"{tmp_path}/r")
    records.write_rounds(rows.where("k = 1"), f"{tmp_path}/r")
    assert [r["k"] for r in spark.read.parquet(f"{tmp_path}/r").collect()] == [1]


def test_files_are_written_together_or_not(tmp_path):
    (tmp_path / "there").mkdir()
    (tmp_path / "old.json").write_text("old")
    with pytest.raises(OSError):
        records.write_together({tmp_path / "old.json": "new", tmp_path / "there": "text"})
    assert (tmp_path / "old.json").read_text() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["old.json", "there"]
    records.write_together({tmp_path / "a.json": "1", tmp_path / "a.md": "2"})
    assert records.dump({"x": float("nan"), "y": 0.0}) == '{\n  "x": null,\n  "y": 0.0\n}\n'


def test_templates(tmp_path):
    with pytest.raises(FileNotFoundError):
        records.judge_templates(tmp_path)
    for d in records.DIMENSIONS:
        (tmp_path / f"{d}.txt").write_bytes(f"{d}\r\n".encode())
    (tmp_path / "deep/er").mkdir(parents=True)
    got = records.judge_templates(tmp_path / "deep/er")
    assert [d for d, _, _ in got] == list(records.DIMENSIONS) and got[0][1] == "overall\r\n"


def test_personal_documents_and_reference_set(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\ntext")
    (tmp_path / "b.txt").write_text("second")
    got = records.personal_documents(spark, f"{tmp_path}/b.txt, {tmp_path}/a.txt").orderBy("ord").collect()
    assert [r["text"] for r in got] == ["second", "first\ntext"]
    with pytest.raises(records.RecordError, match="fetch"):
        records.personal_documents(spark, "https://example.com/x")
    two = spark.createDataFrame([("p", "a", "t"), ("q", "b", "u")], "pair_id string, corpus string, reference_text string")
    with pytest.raises(records.RecordError, match="one corpus"):
        records.reference_set(two)
    assert records.reference_set(two.limit(1)).count() == 1
