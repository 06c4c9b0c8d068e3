import uuid

from pyspark.sql import functions as F

from quire.operators import answer as an
from quire.session import checkpoint_dir
from quire.streaming.sync import stream_sync, write_bucketed


def _chunks(spark):
    rows = [("c1", "Ginger tea with honey helps a sore throat and soothes coughing at night.", "herbs.csv", None, "csv"),
            ("c2", "Warm milk with nutmeg before bed improves sleep quality for many people.", "sleep.pdf", 4, "pdf"),
            ("c3", "Ashwagandha root is used to reduce stress and support restful sleep.", "sleep.pdf", 5, "pdf"),
            ("c4", "Turmeric paste is applied to small cuts and mixed into warm drinks daily.", "herbs.csv", None, "csv")]
    return spark.createDataFrame(rows, "chunk_id string, chunk_text string, source_file string, page_number int, "
                                       "source_type string")


def test_ask_batch_paths(spark):
    qs = spark.createDataFrame([
        ("q1", "How to improve sleep quality?", None, None),
        ("q2", "अच्छी नींद?", None, None),
        ("q3", "I have chest pain and a cough", None, None),
        ("q4", "hi", None, None),
        ("q5", "sore throat remedy with ginger", None, "pdf"),
        ("q6", "How to improve sleep quality?", "Telugu", None),
    ], "question_id string, question string, language string, source_filter string")

    def fake_translate(texts, src, dst):
        return ["How to get good sleep?" if s == "Hindi" else f"[{d}] {t}" for t, s, d in zip(texts, src, dst)]

    out = {r["question_id"]: r for r in an.ask_batch(qs, _chunks(spark), language="language",
                                                        source_filter="source_filter",
                                                        translate=fake_translate).collect()}
    assert out["q1"]["language"] == "en" and out["q1"]["detected_language"] == "en"
    assert "[sleep.pdf, 4]" in out["q1"]["answer"] or "[sleep.pdf, 5]" in out["q1"]["answer"]
    assert out["q1"]["disclaimer"] == an.MEDICAL_DISCLAIMER and len(out["q1"]["sources"]) >= 1
    assert out["q2"]["detected_language"] == "hi" and out["q2"]["answer"].startswith("[Hindi] ")
    assert out["q3"]["answer"] == an.RED_FLAG_MESSAGE and out["q3"]["sources"] == []
    assert out["q4"]["answer"] is None and out["q4"]["reason"].startswith("question shorter")
    assert all(s["source_file"] == "sleep.pdf" for s in out["q5"]["sources"])
    assert out["q6"]["language"] == "te" and out["q6"]["answer"].startswith("[Telugu] ")


def test_prompt_format(spark):
    q = spark.createDataFrame([(1, "Why?"), (2, "Empty?")], "qid int, q string")
    hits = spark.createDataFrame([(1, 2, "b text", None, None), (1, 1, "a text", "f.pdf", 3)],
                                 "qid int, rank int, chunk_text string, source_file string, page_number int")
    got = {r["qid"]: r["prompt"] for r in an.build_prompts(q, hits, "qid", "q").collect()}
    assert got[1].startswith("Context:\n[Source: f.pdf, Page: 3] a text\n\n[Source: unknown, Page: None] b text\n\n")
    assert got[2].startswith("Context:\n(no context)\n\nQuestion: Empty?")


def test_stream_equals_batch_and_rerun_is_noop(spark, tmp_path):
    root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, chunk_index int, chunk_text string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "B"), (3, 0, "d"), (3, 0, "d")],
                                "doc_id int, chunk_index int, chunk_text string")
    key, vals = ["doc_id", "chunk_index"], ["chunk_text"]
    write_bucketed(old, f"{root}/target", key, 4)
    new.repartition(3).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    ck = f"{root}/ckpt"
    got = stream_sync(spark, f"{root}/in", f"{root}/target", schema, key, vals, ck, buckets=4,
                      max_files_per_trigger=1)
    expect = [(1, 0, "a"), (1, 1, "B"), (2, 0, "c"), (3, 0, "d")]
    assert sorted(tuple(r) for r in got.select(*key, *vals).collect()) == expect
    again = stream_sync(spark, f"{root}/in", f"{root}/target", schema, key, vals, ck, buckets=4)
    assert sorted(tuple(r) for r in again.select(*key, *vals).collect()) == expect


def test_ask_batch_uses_stored_embeddings(spark):
    from quire.plans.corpus import embed_chunks
    chunks, rejected = embed_chunks(_chunks(spark))
    assert rejected.count() == 0
    qs = spark.createDataFrame([("q1", "How to improve sleep quality?")], "question_id string, question string")
    a = an.ask_batch(qs, chunks).first()
    b = an.ask_batch(qs, _chunks(spark)).first()
    assert a["answer"] == b["answer"] and a["sources"] == b["sources"]


def test_translation_failure_keeps_source_text(spark):
    df = spark.createDataFrame([("hello", "English", "Telugu"), ("same", "English", "English"), ("", "Hindi", "English")],
                               "t string, s string, d string")

    def broken(texts, src, dst):
        raise RuntimeError("model down")

    got = {r["t"]: r["out"] for r in an.translate_column(df, "t", "s", "d", "out", broken).collect()}
    assert got == {"hello": "hello", "same": "same", "": ""}


def test_score_names_and_source_kind(spark):
    from quire.operators.chunks import source_kind
    from quire.operators.retrieval import normalise_score
    df = spark.createDataFrame([(None, 0.5, "a.PDF"), (0.9, None, "csv:herbs")], "score double, _score double, f string")
    out = normalise_score(df).select("score", source_kind("f").alias("k")).collect()
    assert [tuple(r) for r in out] == [(0.5, "pdf"), (0.9, "csv")]


def test_stream_sync_from_nothing_deletes_and_order(spark):
    root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    ddl = "k int, v string, seq int, deleted boolean"
    first = spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, False), (2, "z", 0, False)], ddl)
    first.write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema

    def run():
        df = stream_sync(spark, f"{root}/in", f"{root}/target", schema, ["k"], ["v"], f"{root}/ckpt", buckets=2,
                         deleted_col="deleted", order_col="seq")
        return sorted(tuple(r) for r in df.collect())

    assert run() == [(1, "a"), (2, "b")]        # no target before
    spark.createDataFrame([(1, "a", 2, True), (2, "c", 3, False), (2, "b", 2, True)], ddl).write.mode("append").parquet(f"{root}/in")
    assert run() == [(2, "c")]                  # the delete empties a bucket
    spark.createDataFrame([(2, "", 4, True)], ddl).write.mode("append").parquet(f"{root}/in")
    assert run() == []


def test_repeated_ids_blank_questions_and_per_question_top_k(spark):
    qs = spark.createDataFrame([("d", "ginger tea for a throat", 1), ("d", "restful sleep with milk", 2), ("b", "      ", 5),
                                ("p", "???!!!", 5), ("k", "ginger tea", 21)], "question_id string, question string, k int")
    rows = an.ask_batch(qs, _chunks(spark), top_k="k").collect()
    assert len(rows) == 5
    assert sorted(len(r["sources"]) for r in rows if r["question_id"] == "d") == [1, 2]
    by = {r["question_id"]: r for r in rows if r["question_id"] != "d"}
    assert by["b"]["reason"] == "question is blank" and by["k"]["reason"].startswith("top_k outside")
    assert by["p"]["sources"] == [] and by["p"]["answer"] == an.NO_CONTEXT_MESSAGE


def test_generation_gets_batches_and_fails_by_row(spark):
    def generate(system, prompts):
        if any("milk" in p.rsplit("Question:", 1)[1] for p in prompts):
            raise RuntimeError("model down")
        return ["fine"] * len(prompts)

    qs = spark.createDataFrame([("a", "ginger tea for a throat"), ("b", "warm milk at night"), ("c", "stress and sleep")],
                               "question_id string, question string").coalesce(1)
    got = {r["question_id"]: (r["answer"], r["reason"]) for r in an.ask_batch(qs, _chunks(spark), generate=generate).collect()}
    assert got["a"] == got["c"] == ("fine", None)
    assert got["b"][0] is None and "model down" in got["b"][1]


def test_rejected_vectors_are_reported(spark):
    from quire.plans.corpus import embed_chunks
    chunks, _ = embed_chunks(_chunks(spark))
    broken = chunks.withColumn("embedding", F.when(F.col("chunk_id") == "c1", F.array(F.lit(float("inf")).cast("float")))
                               .otherwise(F.col("embedding")))
    seen = []
    qs = spark.createDataFrame([("q", "sore throat with honey")], "question_id string, question string")
    r = an.ask_batch(qs, broken, on_rejected=lambda df: seen.extend(df.collect())).first()
    assert [x["chunk_id"] for x in seen] == ["c1"] and any("honey" in s["chunk_text"] for s in r["sources"])


def test_rounds_of_hits_give_the_same_answers_and_leave_few_tables(spark, monkeypatch):
    """Texts of hits are looked up some questions at a time; tables of the steps go when they have been read."""
    import os

    from quire.session import checkpoint_dir
    tables = f"{checkpoint_dir(spark).replace('file://', '')}/tables"
    names = lambda: {x.rsplit("-", 1)[0] if len(x) > 32 else x for x in os.listdir(tables)}
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    chunks = _chunks(spark)
    chunks = chunks.unionByName(chunks.limit(1))          # a chunk id that occurs again
    qs = spark.createDataFrame([(i, f"what about ginger tea and root {i % 3}") for i in range(12)], "question_id int, question string")
    rounds = []
    got = []
    for size in (an.ROUND_BYTES, 500):
        monkeypatch.setattr(an, "ROUND_BYTES", size)
        monkeypatch.setattr(an, "_rounds", (lambda real: lambda hits: (rounds.append(len(x := real(hits))), x)[1])(an._rounds))
        got.append(sorted(map(str, an.ask_batch(qs, chunks).collect())))
    assert got[0] == got[1] and rounds[0] == 1 and rounds[-1] > 1
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(tables)) - before}
    assert left <= {"asked", "questions", "answered"}
