"""Plan shape: native operators stay in the JVM, top-k per group uses a
WindowGroupLimit, filters reach the Parquet scan."""

from pyspark.sql import functions as F

from quire.plans import catalog as c
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_have_no_python(spark):
    for q in (c.q_build_chunks, c.q_chunk_sentences, c.q_quality_gates, c.q_detect_language, c.q_match_rules,
              c.q_page_records, c.q_index_sync):
        p = _plan(q(spark, SF_SMALL))
        assert "Python" not in p and "ArrowEval" not in p, q.__name__


def test_topk_uses_window_group_limit(spark):
    df = c.q_knn_centroids(spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_filter_and_pruning_reach_scan(spark):
    p = _plan(c.q_match_rules(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in p
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in _plan(c.q_build_chunks(spark, SF_SMALL))


def test_source_filter_prunes_partitions(spark, tmp_path):
    from quire.plans.corpus import write_corpus
    df = spark.createDataFrame([("a", "x y", "csv"), ("b", "z w", "pdf")], "chunk_id string, chunk_text string, source_type string")
    t = write_corpus(df, str(tmp_path / "corpus"))
    p = _plan(t.filter(F.col("source_type") == "pdf").select("chunk_id"))
    assert "PartitionFilters: [isnotnull(source_type" in p and "(source_type" in p
    assert [r[0] for r in t.filter(F.col("source_type") == "pdf").select("chunk_id").collect()] == ["b"]
