"""Where findings go: files, event lines, and per-batch handlers of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import text as T


def csv_lines(findings: DataFrame) -> DataFrame:
    """One column ``line``: doc_id, category, sub_category, redacted text, confidence, quoted where needed."""
    cells = [F.col("doc_id").cast("string"), F.col("category"), F.col("sub_category"), T.redacted(F.col("text")), F.format_number("confidence", 2)]
    return findings.select(F.concat_ws(",", *[T.csv_field(F.coalesce(c, F.lit(""))) for c in cells]).alias("line"))


def json_lines(findings: DataFrame, redact: bool = True) -> DataFrame:
    shown = T.redacted(F.col("text")) if redact else F.col("text")
    return findings.select(F.to_json(F.struct("doc_id", "category", "sub_category", shown.alias("text"), "confidence", "has_context", "span_start", "span_end")).alias("line"))


def write_findings(findings: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a relation of findings; parquet is split by category so that later filters prune."""
    if kind == "parquet":
        findings.write.mode("append").partitionBy("category").parquet(path)
    else:
        (csv_lines(findings) if kind == "csv" else json_lines(findings)).write.mode("append").text(path)


def event(findings: DataFrame, source: str) -> DataFrame:
    """Events for a collector: missing fields are added, present ones kept; texts are redacted."""

    def present(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in findings.columns else default

    body = F.struct(present("source", F.lit(source)).alias("source"), present("host", F.lit("spark")).alias("host"), "category", "sub_category", T.redacted(F.col("text")).alias("text"), "confidence")
    return findings.select(F.to_json(body).alias("event"))


def backoff_seconds(attempt: int, base: float = 0.2) -> float:
    """Waiting time before a retry: base, twice, four times, ..."""
    return base * 2 ** (attempt - 1)


def to_tables(path: str):
    """A foreachBatch handler that appends each batch once: a batch that was written before is left out."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return handle


def compliance_text(rows: list[tuple[str, int, bool]]) -> str:
    """Rendering of the framework status, which is four rows."""
    return "\n".join(f"{name:<10} {'PASS' if ok else 'FAIL'}  {n} findings" for name, n, ok in sorted(rows))


def compliance_html(rows: list[tuple[str, int, bool]]) -> str:
    import html

    body = "".join(f"<tr><td>{html.escape(name)}</td><td>{n}</td><td>{'PASS' if ok else 'FAIL'}</td></tr>" for name, n, ok in sorted(rows))
    return f"<table><tr><th>Framework</th><th>Findings</th><th>Status</th></tr>{body}</table>"


def metric_lines(counts: DataFrame, name: str, labels: list[str], value: str = "n") -> DataFrame:
    """One column ``line`` in the text format of metric collectors: name{label="value",...} number."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{label}="'), escape(F.coalesce(F.col(label).cast("string"), F.lit(""))), F.lit('"')) for label in labels])
    return counts.select(F.concat(F.lit(name + "{"), shown, F.lit("} "), F.col(value).cast("string")).alias("line"))


def webhook(findings: DataFrame, event_name: str = "findings") -> DataFrame:
    """(scan_id, payload): a notice per scan with its number of findings, kinds and highest confidence; no texts leave."""
    per = findings.groupBy("scan_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("category")).alias("categories"), F.max(F.col("confidence").cast("double")).alias("highest"))
    return per.select("scan_id", F.to_json(F.struct(F.lit(event_name).alias("event"), "scan_id", "count", "categories", F.round("highest", 2).alias("highest"))).alias("payload"))
