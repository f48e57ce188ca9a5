"""Symbol slices: keep imports and chosen declarations, mark what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import read_text


def merged_ranges(ranges: Column) -> Column:
    """Sorted union of array<struct<start:int,end:int>>; ranges that touch become one."""
    sorted_ranges = F.array_sort(ranges)
    empty = F.array().cast("array<struct<start: int, end: int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (r["start"] <= last["end"] + 1), joined).otherwise(
            F.concat(done, F.array(r)))

    return F.aggregate(sorted_ranges, empty, add)


def slice_lines(lines: Column, ranges: Column) -> Column:
    """Lines of the 0-based inclusive ranges, with a marker for each gap and for the tail.

    lines should be a column that holds the split text: it is used several times.
    """
    count = F.size(lines)
    inside = F.filter(ranges, lambda r: r["start"] < count)
    merged = merged_ranges(F.transform(inside, lambda r: F.struct(
        r["start"].cast("int").alias("start"), F.least(r["end"], count - 1).cast("int").alias("end"))))

    def gap(missing: Column) -> Column:
        return F.when(missing > 0, F.array(F.format_string("// ... [%d lines omitted] ...", missing))).otherwise(
            F.array().cast("array<string>"))

    def add(state: Column, r: Column) -> Column:
        return F.struct(
            F.concat(state["out"], gap(r["start"] - state["next"]),
                     F.slice(lines, r["start"] + 1, r["end"] - r["start"] + 1)).alias("out"),
            (r["end"] + 1).alias("next"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))
    return F.aggregate(merged, start, add,
                       lambda s: F.array_join(F.concat(s["out"], gap(count - s["next"])), "\n"))


# The parts of a script, left to right: what may hide braces, plain text, any other character. A slash opens a
# regular expression only behind a sign after which a value must come.
_PARTS = "|".join([
    r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)",
    r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`",
    r"(?<=[=(,:;!&|?{}\[+>\n]\s{0,3}|\breturn\s{1,3})/(?![/*\s])[^/\\\[\n]*+(?:(?:\\.|\[(?:[^\]\\\n]|\\.)*+\])[^/\\\[\n]*+)*+/[a-z]*",
    r"[^\"'`/]++", r"(?s:.)"])


def _down():
    return Window.partitionBy("project", "path").orderBy("line").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def _up():
    """From the end of the file to here; a frame that ends at the current row takes linear time."""
    return Window.partitionBy("project", "path").orderBy(F.desc("line")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def code_only(text: Column) -> Column:
    """A script with empty strings and without comments; every line stays where it is."""

    def shown(part: Column) -> Column:
        breaks = F.regexp_replace(part, r"[^\n]+", "")
        first, alone = F.left(part, F.lit(1)), F.length(part) == 1
        return (F.when(F.startswith(part, F.lit("//")) | F.startswith(part, F.lit("/*")), breaks)
                .when(first.isin("'", '"', "`"), F.when(alone, "").otherwise(F.concat(F.lit('""'), breaks)))
                .when((first == "/") & ~alone, "0").otherwise(part))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), shown), "")


def code_lines(files: DataFrame) -> DataFrame:
    """(project, path, line, code): lines that hold code, without comments and with empty strings."""
    code = code_only(read_text(F.col("content")))
    return files.select("project", "path", F.posexplode_outer(F.split(code, "\n", -1)).alias("line", "code")).where(
        F.rlike("code", F.lit(r"\S")))


_HEAD = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
_METHOD = (r"^\s*(?:(?:public|private|protected|static|async|override|readonly|abstract)\s+)*\*?\s*"
           r"([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(")
# Words before '(' that are not method names.
_NOT_METHODS = ("if", "for", "while", "switch", "catch", "return", "function", "constructor", "super", "new")


def _statement_ends(level: int) -> Column:
    """A line after which a new statement begins at a brace level."""
    code = F.col("code")
    here = (F.col("_before") == level) & (F.col("_after") == level)
    return (
        (F.rlike(code, F.lit(r"[;}]\s*$")) & (F.col("_after") <= level))
        | ((F.col("_before") < level) & (F.col("_after") == level))
        | (here & ~F.col("_decorator") & ~F.rlike(code, F.lit(r"[,(]\s*$|^\s*\)")))
    )


def _declared(test: Column, kind: str, level: int, class_name: Column, name: Column) -> Column:
    start = F.when(F.col(f"_decor{level}") >= 0, F.col(f"_decor{level}")).otherwise(F.col("line"))
    return F.when(test, F.struct(
        F.lit(kind).alias("kind"), class_name.alias("class_name"), name.alias("name"),
        start.cast("int").alias("start"), F.coalesce(F.col(f"_end{level}"), F.col("line")).cast("int").alias("end")))


def declarations(code: DataFrame) -> DataFrame:
    """(project, path, kind, class_name, name, start, end): imports, classes, functions, methods.

    Classes and functions are those at the top of the file. A class has no `name`, a function
    no `class_name`. Spans come from balancing braces: a close reading of the text, not a parse.
    Decorators above a declaration belong to it. All windows share one shuffle by file.
    """
    line, text, before, after = F.col("line"), F.col("code"), F.col("_before"), F.col("_after")
    net = F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))
    lines = code.withColumn("_net", net).withColumn("_after", F.sum("_net").over(_down())).withColumn(
        "_before", after - F.col("_net"))
    top = before == 0
    continues = F.rlike(text, F.lit(r"^\s*(?:extends\b|implements\b|\{|,)"))
    lines = (
        lines.withColumn("_decorator", F.rlike(text, F.lit(r"^\s*@[A-Za-z]")))
        .withColumn("_class", F.when(top, F.regexp_extract(text, _HEAD + r"class\s+([\w$]+)", 1)).otherwise(""))
        .withColumn("_function", F.when(top, F.regexp_extract(
            text, _HEAD + r"(?:async\s+)?function\s*\*?\s*([\w$]+)", 1)).otherwise(""))
        .withColumn("_method", F.when(before == 1, F.regexp_extract(text, _METHOD, 1)).otherwise(""))
        # The class around a line: the last one at the top, until another top-level statement.
        .withColumn("_owner", F.coalesce(F.last(F.when(top & ((F.col("_class") != "") | ~continues), F.col("_class")),
                                                ignorenulls=True).over(_down()), F.lit("")))
        .withColumn("_ends0", _statement_ends(0)).withColumn("_ends1", _statement_ends(1))
    )
    order = Window.partitionBy("project", "path").orderBy("line")
    for level in (0, 1):
        # The line of the decorator that opens the current statement, or -1.
        begins = F.coalesce(F.lag(f"_ends{level}").over(order), F.lit(True))
        lines = lines.withColumn("_begins", begins).withColumn(
            f"_decor{level}",
            F.last(F.when(F.col("_begins"), F.when(F.col("_decorator") & (before == level), line).otherwise(-1)),
                   ignorenulls=True).over(_down()))
    closes = F.rlike(text, F.lit(r"\}|;\s*$"))
    for level in (0, 1):
        lines = lines.withColumn(f"_end{level}", F.last(F.when((after == level) & closes, line), ignorenulls=True).over(_up()))
    lines = lines.withColumn("_quote", F.last(F.when(F.contains(text, F.lit('""')), line), ignorenulls=True).over(_up()))
    imports = top & F.rlike(text, F.lit(r"^\s*import\b(?!\s*\(|\s+[\w$]+\s*=)"))
    none = F.lit("")
    found = F.array(
        F.when(imports, F.struct(
            F.lit("import").alias("kind"), none.alias("class_name"), none.alias("name"),
            line.cast("int").alias("start"), F.coalesce("_quote", line).cast("int").alias("end"))),
        _declared(F.col("_class") != "", "class", 0, F.col("_class"), none),
        _declared(F.col("_function") != "", "function", 0, none, F.col("_function")),
        _declared((F.col("_method") != "") & (F.col("_owner") != "") & ~F.col("_method").isin(*_NOT_METHODS),
                  "method", 1, F.col("_owner"), F.col("_method")),
    )
    return lines.select("project", "path", F.explode_outer(F.filter(found, lambda d: d.isNotNull())).alias("_d")).where(
        "_d is not null").select("project", "path", "_d.*")


def wanted_symbols(symbols) -> Column:
    """Declarations named by Class, Class.method or function; a function is compared by the part
    before the dot only."""
    wanted = F.lit(False)
    for symbol in symbols:
        owner, _, member = symbol.partition(".")
        member = member.split(".")[0]
        wanted = wanted | ((F.col("class_name") == owner) & (F.col("name") == member)) | (
            (F.col("kind") == "function") & (F.col("name") == owner))
    return (F.col("kind") != "import") & wanted


def slice_symbols(files: DataFrame, symbols) -> DataFrame:
    """(project, path, sliced) for the files that declare one of the symbols; others have no row."""
    is_import = F.col("kind") == "import"
    # Of several methods of one name the first counts; every import counts.
    each = F.when(is_import, F.col("start")).otherwise(-1).alias("_each")
    # All groups below are groups of lines of one file, in the shuffle that the windows made.
    ranges = (
        declarations(code_lines(files)).where(is_import | wanted_symbols(symbols))
        .groupBy("project", "path", "kind", "class_name", "name", each).agg(F.min(F.struct("start", "end")).alias("_r"))
        .groupBy("project", "path").agg(F.collect_list("_r").alias("_ranges"), F.max(~is_import).alias("_any"))
        .where("_any")
    )
    lines = F.split(read_text(F.col("content")), "\n", -1)
    return files.select("project", "path", lines.alias("_lines")).join(ranges, ["project", "path"]).select(
        "project", "path", slice_lines(F.col("_lines"), F.col("_ranges")).alias("sliced"))
