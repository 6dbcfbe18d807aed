import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, dense, evidence, fusion, lexical, metrics, sampling, scorers, validate

LEGAL = """CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM
Độc lập - Tự do - Hạnh phúc
-----------
Lời nói đầu của văn
bản này.
Chương I QUY ĐỊNH CHUNG
Mục 1 Phạm vi.
Điều 1. Phạm vi điều chỉnh.
Nội dung điều một.
Khoản 1 Một khoản.
Điểm a) một điểm.
Điều 2. Đối tượng.
Nội dung.
Phụ lục A
Bảng.
Chương II KHÁC
Hết.
Nơi nhận: lưu."""


def test_clean_text(spark):
    df = spark.createDataFrame([(1, LEGAL), (2, "﻿kết hợp xã-\n hội.\n\n\n\nA   b \n  "), (3, None), (4, "")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in chunking.clean_text(df, "text").collect()}
    assert rows[1]["clean_text"].startswith("Lời nói đầu của văn bản này.\nChương I")
    assert rows[1]["clean_text"].endswith("Hết.")
    c = rows[1]["cleaning"]
    assert (c["removed_header_lines"], c["removed_divider_lines"]) == (2, 1) and c["footer_removed_chars"] > 0
    assert c["removed_chars"] == len(LEGAL) - len(rows[1]["clean_text"])
    assert rows[2]["clean_text"] == "kết hợp xãhội.\n\nA b"
    assert rows[3]["clean_text"] is None and rows[4]["clean_text"] == ""


@pytest.mark.parametrize(
    "text, kept",
    [("Phạm vi\nĐiều 2", False), ("Phạm vi.\nĐiều 2", True), ("Phạm vi\nChương II", True), ("x\nÁp", True), ("x\nẤp", False)],
)
def test_line_join_rule(spark, text, kept):
    out = chunking.clean_text(spark.createDataFrame([(text,)], "text string"), "text").first()["clean_text"]
    assert ("\n" in out) == kept


def test_sections_and_heading_stack(spark):
    df = chunking.clean_text(spark.createDataFrame([(7, LEGAL), (8, "plain text only"), (9, "")], "doc_id int, text string"), "text")
    rows = chunking.sections(df, "doc_id", "clean_text").orderBy("doc_id", "section_idx").collect()
    seven = [r for r in rows if r["doc_id"] == 7]
    assert [r["section_idx"] for r in seven] == list(range(len(seven)))
    assert seven[0]["heading"] == "" and seven[0]["text"] == "Lời nói đầu của văn bản này."
    by = {r["heading"]: r["structure"] for r in seven}
    point = by["Điểm a) một điểm."]
    assert (point["chapter"], point["article"], point["clause"]) == ("Chương I QUY ĐỊNH CHUNG", "Điều 1. Phạm vi điều chỉnh.", "Khoản 1 Một khoản.")
    assert by["Điều 2. Đối tượng."]["clause"] == "" and by["Điều 2. Đối tượng."]["section"] == "Mục 1 Phạm vi."
    assert by["Phụ lục A"]["chapter"] == "" and by["Chương II KHÁC"]["appendix"] == "Phụ lục A"
    assert [(r["heading"], r["text"]) for r in rows if r["doc_id"] == 8] == [("", "plain text only")]
    assert not [r for r in rows if r["doc_id"] == 9]
    compat = chunking.sections(df.filter("doc_id = 7"), "doc_id", "clean_text", compat=True).collect()
    assert all(r["structure"]["article"] == "" and r["structure"]["point"] == "" for r in compat)


def test_metadata(spark):
    df = spark.createDataFrame([("Nghị định 15/2020/NĐ-CP", "", "sửa đổi luật, năm 2019 và 2020")], "n string, l string, t string")
    m = df.select(chunking.metadata(F.col("n"), F.col("l"), F.col("t")).alias("m")).first()["m"]
    assert (m["doc_type"], m["issue_number"], m["years"], m["has_amendment_signal"]) == ("luat", "15/2020/NĐ-CP", ["2019", "2020"], True)
    m = df.select(chunking.metadata(F.col("n"), F.col("l"), F.col("t"), compat=True).alias("m")).first()["m"]
    assert (m["doc_type"], m["has_amendment_signal"]) == ("unknown", False)


def test_metadata_rank(spark):
    docs = spark.createDataFrame([(1, 1, "d1"), (1, 2, "d2"), (1, 3, "d3")], "query_id int, position int, doc_id string")
    docs = docs.withColumn("signals", chunking.question_signals(F.lit("Nghị định 15/2020/NĐ-CP năm 2020 thông tư")))
    text = F.when(F.col("doc_id") == "d1", "x").when(F.col("doc_id") == "d2", "thông tư 2020").otherwise("Số 15/2020/NĐ-CP")
    ranked = chunking.metadata_rank(docs.withColumn("heading", F.lit("")).withColumn("metadata", chunking.metadata(F.lit(""), F.lit(""), text))).collect()
    assert [(r["doc_id"], r["rank"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [("d2", 1), ("d3", 2)]


def windows(n, w, o):
    if n <= w:
        return [(0, n)] if n else []
    out, start = [], 0
    while True:
        out.append((start, min(start + w, n)))
        if out[-1][1] == n:
            return out
        start += max(w - o, 1)


def test_windows_equal_brute_force(spark):
    sizes = [0, 1, 319, 320, 321, 580, 581, 700, 1999]
    df = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", chunking.window_bounds(F.col("n")).alias("w"))
    for r in df.collect():
        assert [(x["start"], x["end"]) for x in r["w"]] == windows(r["n"], 320, 60)


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([("a", "Name", "", LEGAL), ("b", "Other", "", long), ("c", "Empty", "", "")], "doc_id string, name string, link string, passage string")
    rows = chunking.chunks(df).collect()
    a = [r for r in rows if r["doc_id"] == "a"]
    assert any(r["heading"].startswith("Name | Chương I") for r in a) and all(len(r["chunk_id"]) == 20 for r in rows)
    b = sorted((r for r in rows if r["doc_id"] == "b"), key=lambda r: r["window_idx"])
    assert [(r["start_word"], r["end_word"]) for r in b] == [(0, 320), (260, 400)]
    assert b[0]["text"].startswith("Other\nw0 w1") and not [r for r in rows if r["doc_id"] == "c"]
    assert len({r["chunk_id"] for r in rows}) == len(rows)


def test_a_text_is_cleaned_and_cut_once(spark, tmp_path):
    spark.createDataFrame([("a", "N", "", LEGAL)], "doc_id string, name string, link string, passage string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for found in (chunking.chunks(docs).select("chunk_id", "checksum"), chunking.sections(docs, "doc_id", "passage")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter (" not in plan and plan.count("split(") == 2 - ("clean" not in plan)


def test_texts_with_and_without_things_to_mend(spark):
    passages = ["a-\nb - \n\nc", "a \n b\n  c", "x.\r\ny\rz", "\ufeffa\u200b  b\t\tc ", "\u00a0 a\n\n\n\nB\u00a0", "plain", "", None]
    df = spark.createDataFrame(list(enumerate(passages)), "i int, passage string")
    found = {r["i"]: r["clean_text"] for r in chunking.clean_text(df, "passage").collect()}
    assert found == {0: "ab -\nc", 1: "a b c", 2: "x.\ny z", 3: "a b c", 4: "a\n\nB", 5: "plain", 6: "", 7: None}


def bm25(chunks, query, k1=1.5, b=0.75, hw=2.0):
    """Brute force over token lists (heading, body)."""
    tfs = []
    for h, t in chunks:
        tf = {}
        for x in t:
            tf[x] = tf.get(x, 0) + 1
        for x in h:
            tf[x] = tf.get(x, 0) + hw
        tfs.append(tf)
    avg = sum(sum(tf.values()) for tf in tfs) / len(tfs)
    out = []
    for tf in tfs:
        s = 0.0
        for x in query:
            if x in tf:
                df = sum(x in o for o in tfs)
                idf = math.log(1 + (len(tfs) - df + 0.5) / (df + 0.5))
                s += idf * tf[x] * (k1 + 1) / (tf[x] + k1 * (1 - b + b * sum(tf.values()) / avg))
        out.append(s)
    return out


def test_bm25_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"t{i}" for i in range(12)]
    chunks = [([rng.choice(vocab)], [rng.choice(vocab) for _ in range(rng.randint(0, 15))]) for _ in range(30)]
    rows = [(i // 3, i % 3, f"{' '.join(h)}\n{' '.join(t)}") for i, (h, t) in enumerate(chunks)]
    df = spark.createDataFrame(rows, "doc_id int, window_idx int, text string")
    query = ["t1", "t2", "t2", "t9"]
    got = {(r["doc_id"], r["window_idx"]): r["score"] for r in lexical.chunk_scores(spark.createDataFrame([(1, " ".join(query))], "query_id int, question string"), df).collect()}
    for i, s in enumerate(bm25(chunks, query)):
        assert got.get((i // 3, i % 3), 0.0) == pytest.approx(s)


def test_rrf_by_hand(spark):
    rows = [("q", "d1", "A", 1), ("q", "d2", "A", 2), ("q", "d3", "A", 3), ("q", "d3", "B", 1), ("q", "d4", "B", 2)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, branch string, rank int")
    weights = spark.createDataFrame([("A", 1.0), ("B", 0.6)], "branch string, weight double")
    got = [(r["doc_id"], round(r["score"], 6)) for r in fusion.rrf(df, weights).orderBy("rank").collect()]
    assert got == [("d3", 0.025709), ("d1", 0.016393), ("d2", 0.016129), ("d4", 0.009677)]
    off = spark.createDataFrame([("A", 1.0), ("B", 0.0)], "branch string, weight double")
    assert fusion.rrf(df, off).count() == 3


def test_rrf_ties(spark):
    df = spark.createDataFrame([("q", "b", "A", 1), ("q", "a", "B", 1)], "query_id string, doc_id string, branch string, rank int")
    weights = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "branch string, weight double")
    order = lambda tie: [r["doc_id"] for r in fusion.rrf(df, weights, tie=tie).orderBy("rank").collect()]
    assert order("first_seen") == ["b", "a"] and order("doc_id") == ["a", "b"] and order("rank_first") == ["b", "a"]
    with pytest.raises(ValueError):
        order("other")


def test_score_fusion_by_hand(spark):
    base = spark.createDataFrame([("q", "d1", 1, 0.2), ("q", "d2", 2, 0.9), ("q", "d3", 3, 0.5)], "query_id string, doc_id string, rank int, s double")
    got = [(r["doc_id"], round(r["fused_score"], 6)) for r in fusion.score_fusion(base, ["s"], [0.8], 0.5, window=2).orderBy("fused_rank").collect()]
    assert got == [("d2", 0.8), ("d1", 0.5), ("d3", -0.000003)]


@pytest.mark.parametrize("trials", [[(0.3, 0.4, 0.0), (0.5, 0.8, 0.3)], [(0.5, -0.8, 0.0), (-0.1, 0.00001, -0.00002)]])
def test_score_fusion_grid_equals_each_trial(spark, trials):
    rows = [(q, f"d{r}", r, None if r % 7 == 3 else float((r * r * q) % 5), float("nan") if (q, r) == (3, 2) else r % 3 / 2.0) for q in range(1, 5) for r in range(q, 30 * q, q)] + [(1, "none", None, 1.0, 1.0)]
    base = spark.createDataFrame(rows, "query_id int, doc_id string, rank int, s double, t double")
    found = fusion.score_fusion_grid(base, ["s", "t"], trials, window=12, top=20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Union" not in plan
    # Rows are multiplied by the trials after the last order.
    assert plan.count("Generate") == 2 and "Window" not in plan[: plan.rindex("Generate")]
    cols = ["query_id", "doc_id", "rank", "fused_score", "fused_rank"]
    for n, (r, *weights) in enumerate(trials):
        one = fusion.score_fusion(base, ["s", "t"], weights, r, window=12, top=20)
        assert "Union" not in one._jdf.queryExecution().optimizedPlan().toString()
        want = sorted(map(str, one.select(*cols).collect()))
        assert sorted(map(str, found.filter(F.col("trial") == n).select(*cols).collect())) == want and len(want) > 40


def test_rerank_keeps_the_tail(spark):
    base = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 6)], "query_id string, doc_id string, rank int")
    scores = spark.createDataFrame([("q", "d1", 0.1), ("q", "d2", 0.9), ("q", "d5", 9.0)], "query_id string, doc_id string, reranker_score double")
    got = [r["doc_id"] for r in fusion.rerank(base, scores, 3).orderBy("reranked").collect()]
    assert got == ["d2", "d1", "d3", "d4", "d5"]


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abcde")], "query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z")], "query_id string, doc_id string")
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    rows = {r["query_id"]: r for r in metrics.rank_metrics(metrics.judged(ranks, gold, queries)).collect()}
    q = rows["q"]
    assert (q["precision_5"], q["recall_1"], q["recall_5"], q["hit_5"], q["mrr"]) == (0.2, 0, 0.5, 1, 0.5)
    assert all(rows["none"][k] == 0 for k in ("precision_5", "recall_100", "mrr", "gold_count"))
    six = ranks.union(spark.createDataFrame([("q", "f", 6)], ranks.schema))
    assert metrics.official_metrics(six, gold, queries).filter("query_id = 'q' and precision + recall + hit + mrr = 0").count() == 1


def test_accept_gate():
    base = {"recall_5": 0.5, "precision_5": 0.1}
    assert metrics.accept(base, {"recall_5": 0.6, "precision_5": 0.0})
    assert metrics.accept(base, {"recall_5": 0.5, "precision_5": 0.2})
    assert not metrics.accept(base, {"recall_5": 0.5, "precision_5": 0.1})


def test_stratified_split_sizes(spark):
    rows = [(i, 1 if i < 6 else 2 if i < 9 else 3) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, s int")
    out = sampling.stratified_split(df, "id", "s", 3).collect()
    dev = [r["s"] for r in out if r["part"] == "dev"]
    assert (dev.count(1), dev.count(2), dev.count(3), len(out)) == (2, 1, 0, 10)
    folds = sampling.folds(df, "id", "s", 3)
    assert sampling.audit_folds(folds, "id", 3).count() == 0
    assert sampling.audit_folds(folds.union(folds.limit(1)), "id", 3).count() == 1


def test_semi_hard_negatives(spark):
    cands = spark.createDataFrame([("q", f"c{i:02d}", i) for i in range(1, 13)], "query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("q", "c02")], "query_id string, doc_id string")
    got = {r["doc_id"] for r in sampling.semi_hard_negatives(cands, gold).collect()}
    assert got == {f"c{i:02d}" for i in range(7, 13)}
    few = sampling.semi_hard_negatives(cands.filter("rank < 4"), gold)
    assert few.count() == 0


def test_feature_frame(spark):
    a = spark.createDataFrame([("q", "x", 1, 2.0), ("q", "y", 2, 1.0)], "query_id string, doc_id string, rank int, score double")
    b = spark.createDataFrame([("q", "y", 1, 5.0)], "query_id string, doc_id string, rank int, score double")
    gold = spark.createDataFrame([("q", "g")], "query_id string, doc_id string")
    rows = {r["doc_id"]: r for r in sampling.feature_frame({"a": a, "b": b}, gold, cap=2).collect()}
    assert set(rows) == {"y", "g"} and rows["g"]["label"] == 1 and rows["g"]["a_rank"] == 999 and rows["g"]["a_rr"] == 0
    assert rows["y"]["agreement_top5"] == 2 and rows["y"]["b_score"] == 5
    dev = sampling.feature_frame({"a": a, "b": b}, gold, inject_gold=False)
    assert {r["doc_id"] for r in dev.collect()} == {"x", "y"} and sampling.missing_positives(dev).count() == 1


def test_dense_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    corpus, queries = rng.standard_normal((60, 8)), rng.standard_normal((7, 8))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)] + [(99, None)], "chunk_idx long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    got = {}
    for r in dense.dense_search(q, c, 5, block=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_idx"]
    for i, v in enumerate(queries):
        assert [got[i][k] for k in range(1, 6)] == np.argsort(-(corpus @ v))[:5].tolist()
    assert dense.dense_search(q.limit(0), c, 5).count() == 0


def test_evidence(spark):
    rows = [(1, 1, 0, "Điều một", "phạt tiền lái xe", 4), (1, 1, 1, "", "khác hẳn", 2), (1, 1, 2, "", "   ", 0)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, window_idx int, heading string, body string, word_count int").withColumn("question", F.lit("Điều phạt tiền"))
    scored = evidence.overlap_scores(df)
    by = {r["window_idx"]: round(r["overlap"], 6) for r in scored.collect()}
    assert by == {0: round(2 / 3 + 0.25, 6), 1: 0.0, 2: 0.0}
    assert evidence.evidence_text(evidence.pick(scored, 1)).first()["evidence"] == "Điều một\nphạt tiền lái xe"
    assert {r["window_idx"] for r in evidence.positives(scored, 3).collect()} == {0, 1}
    assert scorers.score_pairs(df, evidence="body").filter("window_idx = 0").first()["reranker_score"] == pytest.approx(2 / 3)
    encoded = scorers.encode(df, "body").select("embedding").first()["embedding"]
    assert sum(x * x for x in encoded) == pytest.approx(1)


def test_submission_issues(spark):
    sub = spark.createDataFrame([("1", ["a", "a"]), ("2", []), ("3", list("abcdef")), ("9", ["zz"])], "query_id string, answer array<string>")
    queries = spark.createDataFrame([(str(i),) for i in range(1, 5)], "query_id string")
    docs = spark.createDataFrame([(x,) for x in "abcdef"], "doc_id string")
    got = {(r["kind"], r["item_id"], r["severity"]) for r in validate.submission_issues(sub, queries, docs).collect()}
    assert got == {
        ("missing_query", "4", "error"), ("extra_query", "9", "warning"), ("empty_answer", "2", "error"),
        ("too_many", "3", "error"), ("duplicate_answer", "1", "error"), ("unknown_document", "9", "error"),
    }


def test_question_issues(spark):
    q = spark.createDataFrame([("1", "Câu  hỏi", ["a"]), ("2", "Câu hỏi ", None), ("3", " ", ["zz"])], "query_id string, question string, answer array<string>")
    docs = spark.createDataFrame([("a",)], "doc_id string")
    got = {(r["kind"], r["item_id"]) for r in validate.question_issues(q, docs).collect()}
    assert got == {("duplicate_question", "1"), ("empty_answer", "2"), ("empty_question", "3"), ("unknown_document", "3")}


def test_budget():
    assert validate.within_budget({"a": 5}, {"a"}) == 5
    with pytest.raises(ValueError):
        validate.within_budget({"b": 5}, {"a"})
    with pytest.raises(ValueError):
        validate.within_budget({"a": 4_000_000_000})


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_ranks_for_query_ids_of_any_type(spark, kind):
    queries = spark.createDataFrame([(7, "river stone"), (8, "night")], "query_id int, question string").withColumn("query_id", F.col("query_id").cast(kind))
    chunks = spark.createDataFrame([(1, 0, "head\nriver stone"), (2, 0, "head\nnight river"), (3, 0, "head\nnothing")], "doc_id int, window_idx int, text string")
    rows = lexical.rank(queries, chunks).collect()
    got = {(str(r["query_id"]), r["doc_id"]): r["rank"] for r in rows}
    assert got == {("7", 1): 1, ("7", 2): 2, ("8", 2): 1}
    assert lexical.rank(queries, chunks).schema["query_id"].dataType.simpleString() == kind


def test_cut_holds_for_a_large_vocabulary(spark):
    question = " ".join(f"w{i}" for i in range(30_001))
    queries = spark.createDataFrame([(1, question), (2, "w1 w2 w3")], "query_id long, question string")
    chunks = spark.createDataFrame([(i, 0, "h\n" + " ".join(f"w{(i * j) % 500}" for j in range(1, 6))) for i in range(2000)], "doc_id long, window_idx int, text string").repartition(2)
    k = 30
    scored = lexical.scored_chunks(queries, chunks, [(0, 1.5, 0.75)], k)
    plain = lexical.chunk_scores(queries, chunks)
    want = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in lexical.top_k(plain, k, ["doc_id"]).collect()}
    got = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in lexical.top_k(scored, k, ["doc_id"]).collect()}
    assert got == want
    # Two tasks of k rows for each query, and ties at the cut.
    assert plain.count() > 2000 and scored.count() < 1000


def test_a_document_ranked_twice_counts_once(spark):
    rankings = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "query_id int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, 5)], "query_id int, doc_id int")
    row = metrics.rank_metrics(metrics.judged(rankings, gold, gold)).first()
    assert row["recall_5"] == 1.0 and row["mrr"] == 1.0


def test_all_scores_without_a_shuffle(spark):
    df = spark.createDataFrame([(i, 0, f"h\nalpha word{i}") for i in range(9)], "doc_id long, window_idx int, text string")
    found = lexical.chunk_scores(spark.createDataFrame([(1, "alpha"), (2, "word3")], "query_id int, question string"), df)
    assert sorted((r["query_id"], r["doc_id"]) for r in found.collect()) == [(1, i) for i in range(9)] + [(2, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_task_holds_a_bounded_run_of_chunks():
    import pyarrow as pa

    block = lexical._Block([{"query_id": 1, "token": "a", "qtf": 1}])
    bodies = [["a"] * 60_000 for _ in range(7)] + [["a"] * 300_000] + [["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(bodies), pa.array([[] for _ in bodies], pa.list_(pa.string()))], names=["__b", "__h"])
    runs = list(block.frequencies(batch, 2.0))
    assert [r[1] for r in runs] == [2, 2, 2, 1, 1, 1]
    assert [x for r in runs for x in zip((r[0] + r[2]).tolist(), r[4].tolist())] == [(i, 60_000.0) for i in range(7)] + [(7, 300_000.0)]


def test_dense_search_sends_k_rows_a_query_and_task(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dense, "RUN_CELLS", 6)
    vectors = [[float(i % 7), 1.0] for i in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 25)), pa.array(vectors[i : i + 25])], names=["c", "v"]) for i in (0, 25)]

    class Sent:
        value = (np.array([1, 2]), np.array([[1.0, 0.0], [-1.0, 0.0]]))

    out = list(dense._search(Sent, 4)(iter(batches)))
    assert sum(b.num_rows for b in out) == 8
    assert out[0].column(1).to_pylist() == [6, 13, 20, 27, 0, 7, 14, 21]


def test_queries_need_no_shuffle_by_pair(spark):
    """Candidates and relevant rows that are dealt by query stay where they are."""
    rows = spark.createDataFrame([(q, d, d) for q in range(3) for d in range(1, 30)], "query_id int, doc_id int, rank int").repartition(4, "query_id")
    gold = rows.filter("doc_id % 5 = 0").select("query_id", "doc_id")
    found = sampling.semi_hard_negatives(rows, gold)
    assert found.count() == 3 * 5 * 10
    assert "gold_doc#" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines(True) if "Exchange" in x)
