import json
import math
import random
from hashlib import blake2b

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import vectors as vec
from quillspark.operators import analysis, chunking, metrics, rank, relational, retrieval
from quillspark.sources import readers
from quillspark.streaming import ingest


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_tokens_and_words(spark):
    assert one(spark, tx.tokens(F.col("t")), t="Déjà-vu of RAG2 rag2") == ["d", "j", "vu", "of", "rag2", "rag2"]
    assert one(spark, tx.words(F.col("t")), t="The rag the graph") == ["the", "rag", "graph"]
    assert one(spark, tx.content_words(F.col("t")), t="The method of the graph") == ["method", "graph"]
    assert one(spark, tx.collection_words(F.col("t")), t="The method of the graph") == ["graph"]
    assert one(spark, tx.tokens(F.col("t")), t=None) == []


def test_normalization(spark):
    for text, want in [("SchrÃ¶dinger", "Schrödinger"), ("café", "café"), ("ψ x", "ψ x"), ("plain", "plain"), ("", ""), ("a\x00b", "ab"), (None, "")]:
        assert one(spark, tx.normalize_text(F.col("t")), t=text) == want
    assert one(spark, tx.nul_count(F.col("t")), t="a\x00\x00") == 2
    assert one(spark, tx.text_invalid_reason(F.col("t")), t="a\x00") == "nul"


def test_dates_and_titles(spark):
    assert [one(spark, tx.parse_mdy(F.col("t")), t=d) for d in ("1/2/99", "12/31/05", "1/1/68", "1/1/69")] == ["1999-01-02", "2005-12-31", "2068-01-01", "1969-01-01"]
    assert one(spark, tx.title_case(F.col("t")), t="R-GCN 3d methods") == "R-Gcn 3D Methods"
    text = "Abstract\nA long enough title\nAuthors: A. One, B. Two\nVenue - Journal of X"
    assert one(spark, tx.first_title(F.col("t"), F.lit("dir/file.pdf")), t=text) == "A long enough title"
    assert one(spark, tx.first_title(F.col("t"), F.lit("dir/file.tar.gz")), t="x") == "file.tar"
    assert one(spark, tx.first_authors(F.col("t")), t=text) == "A. One, B. Two" and one(spark, tx.first_venue(F.col("t")), t=text) == "Journal of X"


def test_json_repair(spark):
    for text, want in [('```json\n{"a": [1, 2,],}\n```', '{"a": [1, 2]}'), ('Sure: [1, 2] done', "[1, 2]"), ('{"a": 1}', '{"a": 1}'), ("none", None), (None, None)]:
        assert one(spark, tx.repaired_json(F.col("t")), t=text) == want


def test_names_and_keys(spark):
    assert one(spark, tx.safe_filename(F.col("t")), t="../a b/Ü x.pdf") == "__x.pdf" and one(spark, tx.safe_filename(F.col("t")), t="") == "document.pdf"
    assert one(spark, tx.object_key(F.lit(""), F.lit("p"), F.col("t")), t="f.pdf") == "papers/public/p/f.pdf"
    assert one(spark, tx.is_uuid(F.col("t")), t="7dea4661-0b5c-40a6-b691-000cdc1d4f2a") and not one(spark, tx.is_uuid(F.col("t")), t="x")


def test_stale_analyses_are_repaired(spark):
    papers = spark.createDataFrame([("a", "T", "We propose a robust thing for all of us."), ("b", "T", "x"), ("c", "T", None)], "id string, title string, abstract string")
    stored = spark.createDataFrame([("a", ["Not verified yet"], 0.1), ("b", ["It is fast."], 0.9)], "id string, strengths array<string>, confidence double")
    got = {r.id: r for r in analysis.repair_analyses(stored, papers, "id", "title", "abstract").collect()}
    assert got["a"].repaired and "robust" in got["a"].strengths[0] and not got["b"].repaired and got["c"].repaired
    assert {r.id: r.repaired for r in analysis.repair_analyses(stored.where("id = 'b'"), papers, "id", "title", "abstract").collect()} == {"a": True, "b": False, "c": True}


def test_boilerplate(spark):
    assert one(spark, tx.is_boilerplate(F.col("t")), t="All Rights Reserved.") and not one(spark, tx.is_boilerplate(F.col("t")), t="A result.")


def test_dot_is_over_the_shorter_length(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 1.0]), ([], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(vec.dot(F.col("a"), F.col("b")).alias("x")).collect()] == [4.0, 0.0, 0.0]


def test_hash_embedding(spark):
    v = one(spark, vec.hash_embedding("t"), t="graph graph kernel")
    at = lambda w: int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "big") % 384
    assert len(v) == 384 and math.isclose(v[at("graph")], 2 / math.sqrt(5)) and math.isclose(sum(x * x for x in v), 1.0)
    assert sum(one(spark, vec.hash_embedding("t"), t="")) == 0


def test_merge_against_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(f"i{n}", f"t{rng.randrange(12)}", "", rng.choice(["", f"d{rng.randrange(6)}"]), rng.choice(["full-text", None, None]), rng.randrange(4), 0, "o", n) for n in range(200)]
    got = {r.key: r.id for r in rank.merge_ranked(spark.createDataFrame(rows, "id string, title string, summary string, doi string, evidence_state string, citation_count int, score int, origin string, seq long"), "x").collect()}
    want: dict = {}
    for r in rows:
        key = (r[3] or r[1]).strip().lower()
        cur = want.get(key)
        if cur is None or (r[4] == "full-text" and cur[4] != "full-text") or (cur[4] != "full-text" and r[4] != "full-text" and r[5] > cur[5]):
            want[key] = r
    assert got == {k: v[0] for k, v in want.items()}


def test_classify(spark):
    for q, kind in [("What future work is planned?", "future_work"), ("Which dataset was used?", "dataset"), ("What are the limitations?", "limitations"), ("Is it so?", "general"), ("Which metrics and accuracy?", "evaluation")]:
        assert one(spark, retrieval.classify(F.col("q")), q=q) == kind


def test_evidence(spark):
    q = spark.createDataFrame([(1, "Which dataset does KG-Clip use for river deltas?"), (2, "Which dataset does KG-Clip use for river deltas?"), (3, "Is it so?")], "k int, question string")
    c = spark.createDataFrame([(1, "The KG and clip samples describe river deltas in data", "Dataset"), (2, "Unrelated words about snow", "Body")], "k int, text string, section string")
    assert {r.k: r.supported for r in retrieval.evidence_supports(q, c, ["k"]).collect()} == {1: True, 2: False, 3: False}


def test_metadata_questions(spark):
    for q, want in [("Who wrote this paper?", "authors"), ("What is the title?", "title"), ("Where was it published?", "venue"), ("What year is it from?", "year"), ("Give me the DOI", "doi"), ("How does it work?", None)]:
        assert one(spark, retrieval.metadata_intent(F.col("q")), q=q) == want


def test_sections_and_windows(spark):
    text = "A Title Line\n\nAbstract\nFirst words here.\nMETHODS\n" + "w " * 450 + "\nReferences\nEnd."
    got = chunking.section_chunks(spark.createDataFrame([("d", text)], "id string, t string"), ["id"], "t").orderBy("chunk_index").collect()
    assert [(r.section, len(r.text.split())) for r in got] == [("Abstract", 3), ("Methods", 220), ("Methods", 220), ("Methods", 10), ("References", 1)]
    assert [r.chunk_index for r in got] == list(range(5))
    empty = chunking.word_windows(spark.createDataFrame([("a", None), ("b", " ")], "id string, t string"), ["id"], "t")
    assert empty.count() == 0


def test_extractive_answer(spark):
    r = spark.createDataFrame([(1, "How does the graph kernel work?", 1, "The graph kernel works by counting walks. Another sentence stands here alone. All rights reserved by the press.", 2, "Methods"), (2, "Which zeppelin?", 1, "Nothing of that kind is said in here.", None, "Body")], "k int, question string, rank int, text string, page int, section string")
    got = {x.k: x for x in retrieval.extractive_answer(r, ["k"]).collect()}
    assert got[1].answer.startswith("Based only on the retrieved paper evidence: The graph kernel works") and got[1].answer.endswith("Evidence: Page 2, Methods") and not got[2].verified


def test_analysis(spark):
    a = analysis.heuristic_analysis(spark.createDataFrame([("T", "We propose a novel graph kernel for sets. It is efficient and robust on all inputs. However, memory remains a bottleneck here."), ("Empty", None)], "title string, abstract string"), "title", "abstract").collect()
    assert a[0].domain == "graph" and a[0].method_sentences.startswith("We propose") and len(a[0].strengths) == 2 and a[0].weaknesses == ["memory remains a bottleneck here."]
    assert a[1].analysis_summary == "Academic publication titled: Empty." or a[1].analysis_summary.startswith("Academic")


def test_latency_places(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 99, 100):
        v = [float(rng.randrange(20)) for _ in range(n)]
        r = metrics.latency_summary(spark.createDataFrame([("k", x) for x in v], "k string, v double"), "k", "v").first()
        s = sorted(v)
        assert (r.n, r.p50, r.p95, r.p99) == (n, s[int(0.5 * (n - 1))], s[int(0.95 * (n - 1))], s[int(0.99 * (n - 1))])


def test_ir_metrics(spark):
    rows = [("q", i, 1 if i in (2, 4) else 0, 3) for i in range(1, 11)]
    m = metrics.per_query_metrics(spark.createDataFrame(rows, "q string, rank int, relevant int, expected int"), "q", "relevant", "expected").first()
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert (m.hit_1, m.hit_3, m.rr, m.precision_5) == (0, 1, 0.5, 0.4) and math.isclose(m.ndcg_5, (1 / math.log2(3) + 1 / math.log2(5)) / ideal) and math.isclose(m.recall_5, 2 / 3)


def test_golden_metrics(spark):
    empty = {c: 0.0 for c in ("hit_3", "hit_5", "hit_10", "rr", "ndcg_5", "ndcg_10", "precision_5", "recall_5")}
    rows = [dict(answerable=True, supported=True, coverage=0.5, hit_1=1.0, **empty), dict(answerable=True, supported=False, coverage=1.0, hit_1=0.0, **empty), dict(answerable=False, supported=False, coverage=None, hit_1=None, **empty), dict(answerable=False, supported=True, coverage=None, hit_1=None, **empty)]
    schema = "answerable boolean, supported boolean, coverage double, hit_1 double, " + ", ".join(f"{c} double" for c in empty)
    s = metrics.golden_metrics(spark.createDataFrame(rows, schema)).first()
    assert (s.queries, s.hit_1, s.answerable_support, s.fact_coverage, s.unanswerable_support, s.abstention_precision, s.abstention_recall) == (4, 0.5, 0.5, 0.25, 0.5, 0.5, 0.5)
    none = metrics.golden_metrics(spark.createDataFrame([], schema)).first()
    assert (none.answerable_support, none.unanswerable_support, none.abstention_precision, none.abstention_recall) == (0, 0, 1, 1)


def test_blocked_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, size=(120, 8)).astype(float)  # many ties
    rows = [(i, [float(x) for x in v[i]]) for i in range(120)]
    e = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vec.blocked_topk(e.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "v as q"), e, 5, query_rows=5, vector_rows=30).collect()}
    for q in range(0, 120, 10):
        want = sorted((j for j in range(120) if j != q), key=lambda j: (-float(v[q] @ v[j]), j))[:5]
        assert [got[q, k] for k in range(1, 6)] == want
    assert vec.blocked_topk(e.limit(0).selectExpr("vec_id as query_id", "v as q"), e, 5).count() == 0


def test_title_case_is_that_of_python(spark):
    for t in ("results and FINDINGS", "o'neil's 3d-plot", "élan VITAL", "", "a", "x1y"):
        assert one(spark, tx.title_case(F.col("t")), t=t) == t.title()


def test_search_results_stay(spark):
    import datetime as dt

    day = lambda k: dt.datetime(2020, 1, k)
    papers = spark.createDataFrame([("a", "10.1/x", "full-text", day(1)), ("b", "10.1/x", "failed", day(2)), ("c", "t", None, day(1))], "id string, external_id string, evidence_state string, created_at timestamp")
    results = [("1", "a", "10.1/x", "t", None, 5), ("2", "zz", "10.1/x", "t", None, 7), ("3", None, "", "t", None, None), ("4", "n", None, "u", "http://f", 3), ("5", "n", None, "u", None, 4), ("6", None, None, None, None, 1)]
    got = {(r.paper_id, r.external_id, r.inserted, r.evidence_state, r.citation_count) for r in relational.persist_results(spark.createDataFrame(results, "seq string, id string, doi string, title string, pdf_url string, citation_count int"), papers).collect()}
    assert got == {("a", "10.1/x", False, "full-text", 5), ("b", "10.1/x", False, "failed", 7), ("c", "t", False, None, 0), (None, "n", True, "processing", 4)}


def test_the_last_message_of_a_document_counts(spark):
    rows = spark.createDataFrame([("d", "old", (1, "f")), ("d", "new", (2, "a")), ("d", "mid", (1, "g")), ("e", None, (1, "f"))], "id string, content string, arrived struct<at:int,path:string>")
    assert {(r.id, r.content) for r in ingest.last_of(rows, "id").collect()} == {("d", "new"), ("e", None)}


def test_shared_folder(spark, monkeypatch):
    from quillspark import session

    df = session.stored(spark.range(3))
    assert df.count() == 3
    session.discard(df)
    import os
    assert not os.path.exists(df._quill_path[7:])

    class Cluster:
        class sparkContext:  # noqa: N801
            applicationId, master = "x", "spark://host"

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)



def test_replace_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("b", 8)], "k string, v int")
    once = relational.replace_by(base, new, "k")
    assert sorted(map(tuple, relational.replace_by(once, new, "k").collect())) == sorted(map(tuple, once.collect())) == [("a", 1), ("b", 8), ("b", 9)]


def test_top_k_does_not_depend_on_row_order(spark):
    rows = [(i, i % 3) for i in range(50)]
    a = [r.i for r in rank.topk(spark.createDataFrame(rows, "i int, s int"), 7, F.col("s").desc(), F.col("i")).collect()]
    random.Random(2).shuffle(rows)
    assert a == [r.i for r in rank.topk(spark.createDataFrame(rows, "i int, s int").repartition(5), 7, F.col("s").desc(), F.col("i")).collect()]


def test_inverted_index(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0, 3], "": [2], "z": [-1]},), ({},), (None,)], "m map<string,array<int>>")
    assert [r.x for r in df.select(readers.inverted_index_text(F.col("m")).alias("x")).collect()] == ["a b a", "", ""]


def test_recorded_source_and_projections(spark, tmp_path):
    page = {"results": [{"id": "https://x/W1", "title": "", "abstract_inverted_index": {"graph": [1], "A": [0]}, "authorships": [{"author": {"display_name": "A. One"}}, {"author": None}], "cited_by_count": 3, "locations": [{"is_oa": False, "landing_page_url": "l0"}, {"is_oa": True, "landing_page_url": "l1", "pdf_url": "p1"}]}] * 3}
    (tmp_path / "1.json").write_text(json.dumps(page))
    raw = readers.read_recorded(spark, str(tmp_path), limit=2)
    items = raw.select(F.from_json("item", readers.OPENALEX_SCHEMA).alias("i")).select("i.*")
    got = readers.from_openalex(items).collect()
    assert len(got) == 2 and (got[0].id, got[0].title, got[0].summary, got[0].authors_raw, got[0].url, got[0].pdf_url, got[0].open_access) == ("W1", "Untitled paper", "A graph", "A. One, ", "l1", "p1", False)
    s = spark.createDataFrame([("",)], "paperId string").select("paperId", *[F.lit(None).cast(t).alias(n) for n, t in [("title", "string"), ("abstract", "string"), ("authors", "array<struct<name:string>>")]], F.lit(0).alias("year"), F.lit("v").alias("venue"), F.struct(F.lit("10.1/x").alias("DOI")).alias("externalIds"), F.lit(None).cast("int").alias("citationCount"), F.lit("u").alias("url"), F.struct(F.lit("").alias("url")).alias("openAccessPdf"))
    r = readers.from_semantic_scholar(s).first()
    assert (r.id, r.title, r.published_date, r.citation_count, r.open_access) == ("10.1/x", "Untitled paper", None, 0, False)
    both = readers.provider_union(readers.from_openalex(items), readers.from_semantic_scholar(s))
    assert both.count() == 3


HEADER = ",".join(readers.CSV_COLUMNS)


def write_csv(path, *rows, bom=True):
    path.write_text(("﻿" if bom else "") + "\n".join([HEADER, *rows]) + "\n", encoding="utf-8")


def test_csv_to_jsonl(spark, tmp_path):
    write_csv(tmp_path / "a.csv", "1,T  one,c,x.Y,1/2/99,3/4/05,['A'],A,\"Two  words\",2", "1,Again,c,x.Y,1/2/99,3/4/05,['A'],A,s,1", "2,Other,c,x.Y,1/2/20,3/4/05,['A'],A,s,1")
    out = str(tmp_path / "out")
    assert readers.write_jsonl(readers.normalize_corpus(readers.read_corpus_csv(spark, str(tmp_path / "a.csv"))), out) == (2, 1)
    got = {r.id: r for r in readers.read_corpus_jsonl(spark, out).collect()}
    assert got["1"].title == "T one" and got["1"].published_date == "1999-01-02" and got["1"].summary == "Two words" and got["1"].summary_word_count == 2
    with pytest.raises(FileExistsError):
        readers.write_jsonl(readers.read_corpus_jsonl(spark, out), out)
    write_csv(tmp_path / "bad.csv", "3, ,c,x.Y,1/2/99,3/4/05,['A'],A,s,1")
    with pytest.raises(Exception, match="Missing value"):
        readers.write_jsonl(readers.normalize_corpus(readers.read_corpus_csv(spark, str(tmp_path / "bad.csv"))), out, overwrite=True)
    assert readers.read_corpus_jsonl(spark, out).count() == 2 and not (tmp_path / "out.staged").exists()
    (tmp_path / "short.csv").write_text("id,title\n1,x\n")
    with pytest.raises(ValueError, match="Missing required"):
        readers.read_corpus_csv(spark, str(tmp_path / "short.csv"))
    assert readers.read_corpus_jsonl(spark, str(tmp_path / "none")).count() == 0


def test_jsonl_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "1"}\nnot json\n{"id": "2"}\n')
    assert readers.read_corpus_jsonl(spark, str(tmp_path / "x.json")).count() == 2


def test_objects(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.pdf").write_bytes(b"GIF")
    (tmp_path / "c.pdf").write_bytes(b"")
    assert sorted((r.problem or "") for r in readers.read_objects(spark, str(tmp_path)).collect()) == ["", "not a PDF"]  # Spark lists no empty files


def test_stream_is_idempotent_and_isolates_failures(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "t")
    inbox.mkdir()
    msg = lambda j, d, text, kind="PAPER_PROCESSING": json.dumps({"job_id": j, "job_type": kind, "paper_id": "p" + d, "document_id": d, "filename": "f.pdf", "content": text})
    (inbox / "1.json").write_text("\n".join([msg("j1", "d1", "A fine long title\nMethods\nSome words."), msg("j2", "d2", ""), msg("j3", "d3", "x", "OTHER"), "garbage"]))
    run = lambda: ingest.ingest(spark, str(inbox), target, str(tmp_path / "ck")).awaitTermination()
    run()
    (inbox / "2.json").write_text(msg("j1", "d1", "A fine long title\nMethods\nOther words now.\nResults\nFine."))
    run()
    jobs = {r.id: (r.status, r.error) for r in spark.read.parquet(f"{target}/background_jobs").collect()}
    assert jobs["j1"] == ("COMPLETED", None) and jobs["j2"] == ("FAILED", "no text") and jobs["j3"] == ("FAILED", "unknown job type") and len(jobs) == 4
    chunks = spark.read.parquet(f"{target}/document_chunks").collect()
    assert sorted(c.text for c in chunks) == ["Fine.", "Other words now."] and len(chunks[0].embedding) == 384
    assert spark.read.parquet(f"{target}/dead_letters").count() == 3
    assert spark.read.parquet(f"{target}/paper_analyses").count() == 1


def test_every_csv_header_is_checked(spark, tmp_path):
    row = ["1", "t", "c", "x.Y", "1/2/20", "1/2/20", "a", "a", "s", "1"]
    for name, columns in (("a.csv", readers.CSV_COLUMNS), ("b.csv", readers.CSV_COLUMNS)):
        (tmp_path / name).write_text(",".join(columns) + "\n" + ",".join([name, *row[1:]]) + "\n")
    assert readers.read_corpus_csv(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.csv").write_text(",".join(["title", "id", *readers.CSV_COLUMNS[2:]]) + "\n" + ",".join(row) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_corpus_csv(spark, str(tmp_path)).collect()
