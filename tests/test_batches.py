"""How many rows of long lists go to Python at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import text
from millrace.plans import interaction_queries

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_vocabulary_batches(spark, data, monkeypatch):
    """Both passes over the texts are run with short batches, and the session's setting is as before."""
    before, seen = spark.conf.get(BATCH), []
    counts, durable = text.term_counts, interaction_queries.durable
    monkeypatch.setattr(text, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(interaction_queries, "durable", lambda df: (seen.append((spark.conf.get(BATCH), df.columns)), durable(df))[1])

    def sized(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["tf"])

    def measured(df, id_col, tokens):
        rows = df.select(id_col, tokens.alias("_w")).mapInArrow(sized, "tf long")
        return counts(df, id_col, tokens).unionByName(rows.select(F.lit(0).cast("long").alias(id_col), F.concat(F.lit("batch "), F.col("tf").cast("string")).alias("term"), "tf"))

    monkeypatch.setattr(text, "term_counts", measured)
    terms, _ = text._vocabulary(interaction_queries.articles(spark, data), "content_id", text.terms(F.col("text")), 100, 1, 1.0, 5000)
    assert max(int(t.split()[1]) for t in terms if t.startswith("batch ")) <= 7
    monkeypatch.setattr(text, "term_counts", counts)
    interaction_queries._ranked(spark, data)
    assert ("7", ["content_id", "at", "w"]) in seen
    assert spark.conf.get(BATCH) == before
