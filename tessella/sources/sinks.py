"""Writers: verdicts, reports, worklists, snapshots, tables for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_verdicts(verdicts: DataFrame, coverage: DataFrame, folder: str) -> None:
    """verdicts as JSON lines and the coverage summary (SNK01). Files are committed by Spark, so a failed task leaves none half."""
    verdicts.write.mode("overwrite").json(f"{folder}/verdicts")
    coverage.write.mode("overwrite").json(f"{folder}/coverage")


def write_findings(findings: DataFrame, gaps: DataFrame, folder: str, order: list[str]) -> None:
    """findings.md (SNK01): a markdown table of the findings in the order of columns, and one of the input gaps, as text files to be read by name.

    Each is written by Spark in ranges of the order, the first of which begins with the head; without rows the head alone is there.
    """
    for name, df, by in (("findings.md", findings, order), ("input_gaps.md", gaps, gaps.columns)):
        cells = df.columns
        head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(cells) + " |"), (1, "|" + " --- |" * len(cells))], "_rank int, value string")
        keys = [f"_key_{i}" for i in range(len(by))]
        body = df.select(F.lit(2).alias("_rank"), markdown_row(cells).alias("value"), *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)))
        rows = head.unionByName(body, allowMissingColumns=True)
        rows.repartitionByRange("_rank", *keys).sortWithinPartitions("_rank", *keys).select("value").write.mode("overwrite").text(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quoted where needed (SNK02)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def recheck(worklist: DataFrame, readable: DataFrame, key: str = "source_id") -> DataFrame:
    """The worklist with what can be read by now marked (SNK03)."""
    return worklist.join(readable.select(key).distinct().withColumn("now_readable", F.lit(True)), key, "left").withColumn("now_readable", F.coalesce("now_readable", F.lit(False)))


def snapshot(counters: DataFrame, folder: str, version: int) -> None:
    """One version of counters (SNK06); readers take the last."""
    counters.write.mode("overwrite").json(f"{folder}/version={version}")


def load_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last version; fields that the schema hasn't are ignored (SNK06, STR04)."""
    rows = spark.read.schema(schema + ", version int").json(folder)
    return rows.join(rows.agg(F.max("version").alias("version")), "version").drop("version")


def markdown_row(columns: list[str]) -> Column:
    """A row of a markdown table; bars in cells are escaped (SNK07)."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_table(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A table for reading, of at most `most` rows: a report for people, not an export (SNK07)."""
    rows = [r[0] for r in df.select(markdown_row(columns)).limit(most).collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *rows])


def html_report(df: DataFrame, columns: list[str], title: str, most: int = 1000) -> str:
    """The same as HTML, escaped (SNK04, SNK07)."""
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = df.select(F.concat(*(F.concat(F.lit("<td>"), escape(c), F.lit("</td>")) for c in columns))).limit(most).collect()
    head = "".join(f"<th>{c}</th>" for c in columns)
    return f"<h1>{title}</h1><table><tr>{head}</tr>" + "".join(f"<tr>{r[0]}</tr>" for r in rows) + "</table>"


def mermaid(edges: DataFrame, most: int = 500) -> str:
    """A flow chart of edges (src, dst) (SNK07)."""
    return "\n".join(["flowchart TD", *(f"  {r.src} --> {r.dst}" for r in edges.select("src", "dst").distinct().orderBy("src", "dst").limit(most).collect())])
