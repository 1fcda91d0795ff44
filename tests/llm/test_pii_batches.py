"""Redaction hands texts to the workers in small batches."""

from pyspark.sql import functions as F

from barelake.llm import pii


def test_redaction_holds_few_texts(spark, hard):
    rows = hard.withColumn("text", F.concat("text", F.lit(" é me@x.org 10.0.0.1")))
    clean = pii.redact_documents(rows)
    # An Arrow batch holds 10,000 texts, several times over.
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    want = [(r["doc_id"], t := pii.redact(r["text"]), None if t is None else len(t), r["fp"]) for r in rows.collect()]
    assert [(r["doc_id"], r["text"], r["n_chars"], r["fp"]) for r in clean.collect()] == want


def test_redaction_without_arrow_by_setting(spark, hard):
    """The setting that turns all Python functions into Arrow ones doesn't count here."""
    key, before = "spark.sql.execution.pythonUDF.arrow.enabled", spark.conf.get("spark.sql.execution.pythonUDF.arrow.enabled")
    spark.conf.set(key, "true")
    try:
        assert "ArrowEvalPython" not in pii.redact_documents(hard)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
