"""Manifest of a set of files: totals, and the JSON text as one row per entry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import spread_join

# Short escapes of JSON strings.
_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(text: Column) -> Column:
    """Quoted JSON string; control characters as \\u00xx in lower case."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = F.create_map(*[F.lit(v) for pair in _SHORT.items() for v in pair])

    def escape(ch: Column) -> Column:
        return F.when((ch != "") & (ch < " "), F.coalesce(
            F.try_element_at(short, ch), F.concat(F.lit("\\u00"), F.lower(F.hex(ch))))).otherwise(ch)

    # Control characters in names are rare, so only such names are taken apart.
    escaped = F.array_join(F.transform(F.split(plain, ""), escape), "")
    has_control = F.rlike(text, F.lit(r"[\x00-\x1f]"))
    return F.concat(F.lit('"'), F.when(has_control, escaped).otherwise(plain), F.lit('"'))


def totals(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("processed_size").alias("total_size"),
    )


def manifest_rows(files: DataFrame, keys: list[str], heads: DataFrame, generated_at: str,
                  strategies: list[str]) -> DataFrame:
    """(keys, seq, text): seq 0 opens, then one row per file in order, then the closing row.

    heads has (keys, title, total_files, total_tokens, last_ord), also for groups without files.
    Rows joined by line feeds are the manifest block; no row grows with the group.
    """
    names = json.dumps(list(strategies), indent=2, ensure_ascii=False).replace("\n", "\n  ")
    opening = heads.select(
        *keys, F.lit(0).cast("long").alias("seq"),
        F.concat(
            F.lit('/* MANIFEST:\n{\n  "generatedAt": ' + json.dumps(generated_at) + ',\n  "projectName": '),
            json_string(F.col("title")),
            F.lit(',\n  "strategies": ' + names + ',\n  "files": ['),
            F.when(F.col("total_files") == 0, "],").otherwise("")).alias("text"))
    closing = heads.select(
        *keys, (F.col("last_ord") + 1).alias("seq"),
        F.concat(
            F.when(F.col("total_files") == 0, "").otherwise("  ],\n"),
            F.lit('  "totalFiles": '), F.col("total_files").cast("string"),
            F.lit(',\n  "totalTokens": '), F.col("total_tokens").cast("string"), F.lit("\n}\n*/")).alias("text"))
    reason = F.when(F.coalesce("reason", F.lit("")) == "", "included").otherwise(F.col("reason"))
    entries = spread_join(
        files.select(*keys, "ord", "path", "tokens", "reason"), heads.select(*keys, "last_ord"), keys
    ).select(
        *keys, F.col("ord").alias("seq"),
        F.concat(
            F.lit('    {\n      "path": '), json_string(F.col("path")),
            F.lit(',\n      "tokens": '), F.col("tokens").cast("string"),
            F.lit(',\n      "reason": '), json_string(reason), F.lit("\n    }"),
            F.when(F.col("ord") == F.col("last_ord"), "").otherwise(",")).alias("text"))
    return opening.unionByName(entries).unionByName(closing)
