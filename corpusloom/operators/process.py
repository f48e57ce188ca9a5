"""From selected files to wrapped, measured texts: one narrow pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.select import size_within


def clean(files: DataFrame, fmt) -> DataFrame:
    """Rewrite _text by language in the fixed order: comments, imports, blank runs, trim, line numbers.

    What is used twice gets a column of its own, so that it is computed once.
    """
    lang = F.col("language")
    if fmt.strip_comments:
        if fmt.keep_license_header:
            files = (
                files.withColumn("_head", text.license_header(F.col("_text")))
                .withColumn("_text", text.strip_comments(F.col("_text"), lang))
                .withColumn("_text", text.put_back(F.col("_head"), F.col("_text"))).drop("_head")
            )
        else:
            files = files.withColumn("_text", text.strip_comments(F.col("_text"), lang))
    if fmt.strip_imports:
        files = files.withColumn("_text", text.strip_imports(F.col("_text"), lang))
    if fmt.collapse_blank_lines:
        files = files.withColumn("_text", text.collapse_blank(F.col("_text")))
    files = files.withColumn("_text", text.trim_lines(F.col("_text")))
    if fmt.line_numbers:
        files = files.withColumn("_lines", F.split("_text", "\n", -1)).withColumn(
            "_text", text.line_numbers(F.col("_lines"))).drop("_lines")
    return files


def process(files: DataFrame, fmt) -> DataFrame:
    """files (project, path, content, size, reason, ...) -> wrapped content, sizes and tokens.

    The size test comes first and, on a column of the table, is pushed into the scan.
    Rows without readable content are dropped, as missing files are. A column sliced,
    if there is one, replaces the text of its row before the clean-up.
    """
    rest = [c for c in files.columns if c not in ("content", "size", "is_binary", "sliced")]
    raw = text.read_text(F.col("content"), fmt.encoding)
    if "sliced" in files.columns:
        raw = F.coalesce("sliced", raw)
    kept = files.where(size_within(F.col("size"), fmt.max_file_kb) & F.col("content").isNotNull())
    texts = kept.select(*rest, F.col("size").alias("original_size"), raw.alias("_text"),
                        text.language(F.col("path")).alias("language"))
    return (
        clean(texts, fmt)
        .withColumn("content", text.wrap(F.col("_text"), F.col("path"), F.col("reason"), fmt.header, fmt.footer))
        .drop("_text")
        .withColumn("processed_size", F.octet_length("content").cast("long"))
        .withColumn("tokens", text.tokens(F.col("content")))
    )
