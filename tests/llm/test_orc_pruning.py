"""How much of the stored ids a reader meets for a few documents: by stripes, row groups and Bloom filters."""

from pyspark.sql import functions as F

from gridstone.llm import tokens_orc

N = 12_000


def scanned(df):
    """Rows that the scan handed on: what the file's metadata could not rule out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_a_document_costs_a_row_group(spark, tokenizer, tmp_path):
    docs = spark.range(N).select((F.col("id") * 10).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = tokens_orc.read(spark, tokens_orc.write(docs, tokenizer, 2, str(tmp_path / "ids")))
        stride = int(tokens_orc.OPTIONS["orc.row.index.stride"])
        assert scanned(stored) == N
        found = stored.filter("doc_id = 55550")
        assert found.count() == 1 and scanned(found) <= stride  # one row group, by its least and largest doc_id
        assert scanned(stored.filter("doc_id = 55551")) == 0  # between them, but not in the Bloom filter
        few = stored.filter(F.col("doc_id").isin(10, 60_000, 119_990))
        assert few.count() == 3 and scanned(few) <= 3 * stride
        assert scanned(stored.filter("doc_id between 20000 and 20990")) <= 2 * stride
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
