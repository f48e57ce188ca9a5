import random

from pyspark.sql import functions as F

from corpusloom.functions.ignore import rule_runs
from corpusloom.operators.select import with_ignored
from tests.helpers import corpus


def hidden(spark, rules, paths):
    files = corpus(spark, {".gitignore": rules, **{p: "x" for p in paths}})
    rows = with_ignored(files).where(F.col("_ignored")).select("path").collect()
    return sorted(r.path for r in rows)


def test_plain_rules(spark):
    paths = ["a.log", "d/b.log", "build/x", "src/build/y", "keep.txt", "docs/a.txt", "docs/sub/b.txt", "LOG.LOG"]
    assert hidden(spark, "# c\n\n*.log  \nbuild/\n", paths) == ["LOG.LOG", "a.log", "build/x", "d/b.log", "src/build/y"]
    assert hidden(spark, "/build\n", paths) == ["build/x"]
    assert hidden(spark, "docs/*.txt\n", paths) == ["docs/a.txt"]
    assert hidden(spark, "docs/**\n", paths) == ["docs/a.txt", "docs/sub/b.txt"]
    assert hidden(spark, "**/b.*\n", paths) == ["d/b.log", "docs/sub/b.txt"]


def test_folder_rule_is_not_for_files(spark):
    assert hidden(spark, "build/\n", ["build", "x/build/y"]) == ["x/build/y"]


def test_negation_last_rule_wins(spark):
    paths = ["a.log", "keep.log", "d/keep.log"]
    assert hidden(spark, "*.log\n!keep.log\n", paths) == ["a.log"]
    assert hidden(spark, "!keep.log\n*.log\n", paths) == ["a.log", "d/keep.log", "keep.log"]
    assert hidden(spark, "*.log\n!keep.log\nd/*.log\n", paths) == ["a.log", "d/keep.log"]


def test_excluded_folder_is_final(spark):
    assert hidden(spark, "out/\n!out/keep.txt\n", ["out/keep.txt", "out/x"]) == ["out/keep.txt", "out/x"]
    assert hidden(spark, "out/*\n!out/keep.txt\n", ["out/keep.txt", "out/x"]) == ["out/x"]


def test_escapes_and_classes(spark):
    assert hidden(spark, "\\!x\n\\#y\n[ab].c\nz\\ \n", ["!x", "#y", "a.c", "c.c", "z ", "z"]) == ["!x", "#y", "a.c", "z "]


def test_rules_hold_for_their_project_and_only_the_root_file_counts(spark):
    files = corpus(spark, {".gitignore": "a\n", "a": "1"}, {"a": "1"}, {"d/.gitignore": "a\n", "d/a": "1"})
    rows = with_ignored(files).where(F.col("_ignored")).collect()
    assert [(r.project, r.path) for r in rows] == [("p0", "a")]


def test_bad_lines_hide_nothing_and_stop_nobody(spark):
    files = corpus(spark, {".gitignore": "[z-a]\n*.log\n", "a.log": "1", "b": ""}, {".gitignore": "x[]\n[[:foo:]]\n", "x": ""}, {".gitignore": "*.md", "r.md": ""})
    rows = with_ignored(files).where(F.col("_ignored")).collect()
    assert sorted((r.project, r.path) for r in rows) == [("p0", "a.log"), ("p2", "r.md")]


def test_random_lines_are_valid_patterns(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("ab[]!^-\\/*?.#{}()&|+$ :z0") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    regexes = [r["regex"] for line in lines for r in rule_runs(line)]
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    for regex in regexes:
        compile_(regex)
