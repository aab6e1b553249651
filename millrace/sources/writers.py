"""Sinks: JSON lines, submissions, metrics, Markdown tables, and models; ``operators.search_index`` has the search index."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_questions(df: DataFrame, path: str) -> None:
    """JSON lines that keep lists and maps."""
    df.write.mode("overwrite").json(path)


def write_submission(df: DataFrame, path: str, columns: tuple[str, ...] = ("id", "answer")) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One row of metrics as JSON."""
    metrics.write.mode("overwrite").json(path)


def label_csv(predictions: DataFrame, path: str) -> None:
    """Predictions with their labels joined by commas."""
    write_submission(predictions.select("id", F.concat_ws(",", "labels").alias("labels")), path, ("id", "labels"))


def markdown_table(df: DataFrame, sort: str, most: int = 1000) -> str:
    """A report table, best first; for results of a few rows, and refused beyond ``most``."""
    rows = df.orderBy(F.desc(sort), *[c for c in df.columns if c != sort]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def write_split_ids(parts: DataFrame, path: str) -> None:
    """``id, part`` as JSON lines in a folder for each part, so that no list of ids is gathered."""
    parts.select("id", "part").write.mode("overwrite").partitionBy("part").json(path)


def markdown_facts(row: DataFrame, title: str) -> str:
    """A report of one row, a line for each column."""
    r = row.first()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", "| Fact | Value |", "| --- | --- |", *[f"| {c.replace('_', ' ')} | {cell(r[c])} |" for c in row.columns]])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file of any file system that Spark knows; written beside and renamed, so a reader sees all or none of it."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs, draft, target = Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), Path(path + ".draft"), Path(path)
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{path} was not written")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
