"""Text corpora and transcripts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, most: int = 500) -> DataFrame:
    """(id, n, paragraph): parts between blank lines, white space collapsed, of ``least`` to ``most`` bytes.

    Line ends are normalised; what stands before a line with '*** START' and after '*** END' is dropped.
    ``n`` counts all parts of a text from 0.
    """
    text = F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n"))
    text = F.regexp_replace(text, r"(?s)^.*?\*\*\* START[^\n]*\n", "")
    text = F.regexp_replace(text, r"(?s)\*\*\* END.*$", "")
    parts = docs.filter(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text, "\n\n")).alias("n", "raw"))
    clean = parts.select(id_col, "n", F.regexp_replace(F.regexp_replace("raw", r"[ \t\n\x0B\f\r]+", " "), r"^ | $", "").alias("paragraph"))
    return clean.filter(F.octet_length("paragraph").between(least, most))


def transcript_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(type, kind, text) blocks of JSON transcript lines whose content is a string or an array of blocks; bad lines are skipped."""
    block = "array<struct<type:string,text:string>>"
    parsed = lines.select(F.from_json(value, "type string, message struct<content:string>", {"mode": "PERMISSIVE"}).alias("j")).filter("j.message.content is not null")
    content = F.col("j.message.content")
    blocks = F.when(content.startswith("["), F.from_json(content, block)).otherwise(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))))
    return parsed.select(F.col("j.type").alias("type"), F.explode(blocks).alias("b")).select("type", F.col("b.type").alias("kind"), F.col("b.text").alias("text"))


def tool_windows(blocks: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """(keys, window, tool_uses, text): windows that close with every k-th tool use.

    ``blocks`` has ``is_tool`` and ``text``; a text belongs to the window open where it
    stands, before a tool use of the same row. A last window without tool uses and text is dropped.
    """
    k = max(k, 1)
    by = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.sum(F.col("is_tool").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumn("window", F.floor(before / k).cast("int"))
    text = F.trim(F.coalesce("text", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.length(text) > 0, F.struct(F.col(order).alias("o"), text.alias("t"))))), lambda x: F.concat(x["t"], F.lit("\n")))
    out = rows.groupBy(*keys, "window").agg(F.sum(F.col("is_tool").cast("int")).cast("int").alias("tool_uses"), F.array_join(lines, "").alias("text"))
    return out.filter((F.col("tool_uses") > 0) | (F.length("text") > 0))
