"""Small corpora for the tests."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from corpusloom.schemas import FILES
from corpusloom.spec import Filters

STAMP = datetime(2024, 1, 2, 3, 4, 5, 6000, tzinfo=timezone.utc)
PLAIN = Filters(exclude=(), respect_gitignore=False, binary_detection=False)


def corpus(spark, *projects, **named):
    """files from {path: text or bytes} dictionaries, as p0, p1, ... or by keyword."""
    rows = []
    for name, tree in [*((f"p{i}", t) for i, t in enumerate(projects)), *named.items()]:
        for path, content in tree.items():
            data = content if isinstance(content, bytes) else content.encode()
            rows.append((name, path, bytearray(data), len(data)))
    return spark.createDataFrame(rows, FILES)


def column(spark, values, expr, schema="v string"):
    """Values of one expression over v, in the order given."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]
