import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.sources import readers, sinks


def test_contexts(spark, tmp_path):
    (tmp_path / "context_7.json").write_text(json.dumps({"id": "7", "name": "", "link": "http://x/Luat%20A.aspx", "passage": ""}))
    (tmp_path / "context_8.json").write_text(json.dumps({"name": "N", "link": None, "passage": "P"}))
    (tmp_path / "context_9.json").write_text("{broken")
    (tmp_path / "context_10.json").write_text(json.dumps({"id": "7", "passage": "A first line of text\nmore"}))
    good, issues = readers.read_contexts(spark, str(tmp_path / "context_*.json"))
    rows = {(r["doc_id"], r["name"]): r for r in good.collect()}
    assert rows["7", "Luat A"]["name_source"] == "link" and rows["7", "Luat A"]["passage"] == "Luat A\nhttp://x/Luat%20A.aspx"
    assert rows["8", "N"]["name_source"] == "name" and rows["7", "A first line of text"]["name_source"] == "passage"
    assert {(r["kind"], r["item_id"].rpartition("/")[2]) for r in issues.collect()} == {("bad_json", "context_9.json"), ("duplicate_id", "7")}


def test_queries_and_gold(spark, tmp_path):
    path = tmp_path / "train.json"
    path.write_text(json.dumps({"1": {"question": "a", "answer": ["x", "x", "y"]}, "2": {"question": "b", "answer": None}}))
    q = readers.read_queries(spark, str(path))
    assert q.count() == 2
    assert {(r["query_id"], r["doc_id"]) for r in readers.gold_of(q).collect()} == {("1", "x"), ("1", "y")}


def test_any_ranking_shape(spark):
    want = [("q", "a", 1), ("q", "b", 2)]
    shapes = [
        spark.createDataFrame([("q", ["a", "b", "a"])], "qid string, doc_ids array<string>"),
        spark.createDataFrame([("q", '["a", "b"]')], "query_id string, answer string"),
        spark.createDataFrame([("q", "a; b")], "id string, predictions string"),
        spark.createDataFrame([("q", [("a", 2.0), ("b", 1.0)])], "query_id string, top_docs array<struct<doc_id:string,score:double>>"),
        spark.createDataFrame([("q", None, ["a", "b"])], "query_id string, fused_doc_ids array<string>, doc_ids array<string>"),
    ]
    for df in shapes:
        assert [tuple(r) for r in readers.rankings(df).orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        readers.rankings(spark.createDataFrame([(1,)], "x int"))


def test_ranking_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes("﻿qid,top20_rerank,answer\n1,\"[\"\"a\"\", \"\"b\"\"]\",\"[\"\"c\"\"]\"\n".encode())
    assert [tuple(r) for r in readers.read_ranking_csv(spark, str(path)).orderBy("rank").collect()] == [("1", "a", 1), ("1", "b", 2)]
    other = spark.createDataFrame([("1", "b", 1), ("1", "d", 2), ("2", "e", 1)], "query_id string, doc_id string, rank int")
    got = readers.read_ranking_csv(spark, str(path), both=True, submission=other).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [("1", "a", 1), ("1", "b", 2), ("1", "c", 3), ("1", "d", 4), ("2", "e", 1)]


def test_scored_candidates_fail_on_text(spark):
    df = spark.createDataFrame([("q", "a", "x")], "qid string, candidate_id string, xgb_score string")
    with pytest.raises(Exception, match="not a number"):
        readers.scored_candidates(df).collect()


def test_reranker_scores_and_doc_index(spark):
    df = spark.createDataFrame([("q", [("a", 0.5)])], "query_id string, reranked_top_docs array<struct<doc_id:string,reranker_score:double>>")
    assert readers.reranker_scores(df).first()["reranker_score"] == 0.5
    chunks = spark.createDataFrame([("d", 1, "m1"), ("d", 0, "m0")], "doc_id string, chunk_idx int, metadata string")
    assert tuple(readers.doc_index(chunks).first()) == ("d", [0, 1], "m0")


def test_submission_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("q", d, i) for i, d in enumerate("abcdefg", 1)], "query_id string, doc_id string, rank int")
    sub = sinks.make_submission(rows)
    first, second = (sinks.write_submission_zip(str(tmp_path / f"{n}.zip"), sub) for n in "xy")
    assert first == second
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.namelist() == ["submission.json"]
        body = json.loads(z.read("submission.json"))
    assert body == {"q": {"answer": list("abcde")}}
    (tmp_path / "s.json").write_text(json.dumps(body))
    assert readers.read_submission(spark, str(tmp_path / "s.json")).count() == 5


def test_jsonl_reports_and_features(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), "a int, b string").count() == 2
    sinks.write_report(str(tmp_path / "r.json"), {"k": 1}, ("k",))
    assert readers.read_json(spark, str(tmp_path / "r.json"), "k int").first()["k"] == 1
    with pytest.raises(ValueError):
        sinks.write_report(str(tmp_path / "r.json"), {}, ("k",))
    sinks.write_features(df.withColumn("fold", F.lit(1)), str(tmp_path / "f"), "fold")
    assert readers.read_parts(spark, [str(tmp_path / "f")]).count() == 2
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "chunk_idx int, embedding array<double>")
    sinks.write_embeddings(vectors, str(tmp_path / "e"))
    assert sinks.write_embeddings(vectors.limit(0), str(tmp_path / "e")).count() == 1


def test_query_ids_and_splits(spark, tmp_path):
    for name, payload in {"a": {"1": {}, "2": {}}, "b": [{"qid": "1"}, {"index": 2}], "c": {"questions": [{"id": "1"}, {"id": "2"}]}}.items():
        (tmp_path / name).write_text(json.dumps(payload))
        assert sorted(r["query_id"] for r in readers.read_query_ids(spark, str(tmp_path / name)).collect()) == ["1", "2"], name
    df = spark.createDataFrame([("1", ["x", "x", ""]), ("2", [])], "query_id string, answer array<string>")
    assert readers.checked_split(df.filter("query_id = '1'")).first()["gold"] == ["x"]
    with pytest.raises(Exception, match="no relevant document"):
        readers.checked_split(df).collect()


def test_reuse(spark, tmp_path):
    path = str(tmp_path / "part")
    build = lambda n: lambda: spark.range(n)
    assert sinks.reuse_or_write(spark, path, build(3), lambda d: True).count() == 3
    assert sinks.reuse_or_write(spark, path, build(5), lambda d: d.count() == 3).count() == 3
    assert sinks.reuse_or_write(spark, path, build(5), lambda d: d.count() == 5).count() == 5


def test_window_stream(spark, tmp_path):
    from quern.operators import chunking
    from quern.streaming import ingest

    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400))), (2, "short text"), (3, None)], "doc_id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.window_stream(spark, str(tmp_path / "in"), "doc_id int, text string")
    ingest.write_windows(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "window_idx", "body")
    want = chunking.windows(chunking.clean_text(df.filter("text is not null"), "text", stats=None), "clean_text").select("doc_id", "window_idx", "body")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ids_of_any_shape(spark):
    shapes = ['[{"doc_id":"a"}]', '{"answer":["a","b"]}', '{"answer":"{\\"answer\\": [1, 2]}"}', '[1, 2, 1]', '"a;b"', "a, b;;a", "  ", None, '{"id": 3}', "7"]
    df = spark.createDataFrame(list(enumerate(shapes)), "qid int, predictions string")
    got = {}
    for r in readers.rankings(df).orderBy("query_id", "rank").collect():
        got.setdefault(int(r["query_id"]), []).append(r["doc_id"])
    assert got == {0: ["a"], 1: ["a", "b"], 2: ["1", "2"], 3: ["1", "2"], 4: ["a", "b"], 5: ["a", "b"], 8: ["3"], 9: ["7"]}
