""".gitignore lines as regular expressions.

A file of rules becomes a short list of runs: neighbouring rules of the same sign are one
alternation, so most projects need a single search per path. Folders are tested with a
trailing '/', as a rule that ends in '/' is for folders only.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.globs import char_class
from corpusloom.functions.paths import prefixes
from corpusloom.schemas import IGNORE_RUNS


def rule_regex(line: str) -> tuple[str, bool] | None:
    """(regex for a search in the path, negated) of one line; None for blank lines and comments."""
    line = line.rstrip("\r")
    line = re.sub(r"(?<!\\)[ \t]+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    if line[:2] in ("\\!", "\\#"):
        line = line[1:]
    only_dirs = line.endswith("/")
    body = line.rstrip("/") if only_dirs else line
    if not body:
        return None
    anchored = "/" in body
    body = body.lstrip("/")
    parts = body.split("/")
    out = ""
    end = "/" if only_dirs else "(?:/|\\z)"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**" and last and i > 0:
            # Everything inside, but not the folder itself.
            out, end = out + "[^/].*", ""
        elif part == "**" and not last:
            out += "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    return ("\\A" if anchored else "(?:\\A|/)") + out + end, negated


def _segment(part: str) -> str:
    if re.fullmatch(r"\*+", part):
        return "[^/]+"
    out, i = "", 0
    while i < len(part):
        ch = part[i]
        if ch == "\\" and i + 1 < len(part):
            out += re.escape(part[i + 1])
            i += 2
            continue
        if ch == "[" and (parsed := char_class(part, i)):
            out += parsed[0]
            i = parsed[1]
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(ch) or re.escape(ch)
        i += 1
    return out


def rule_runs(text: str) -> list[dict]:
    runs: list[tuple[bool, list[str]]] = []
    for line in text.lstrip("\ufeff").split("\n"):
        rule = rule_regex(line)
        if rule is None:
            continue
        regex, negated = rule
        if not runs or runs[-1][0] != negated:
            runs.append((negated, []))
        runs[-1][1].append(regex)
    return [{"regex": "(?is)" + "|".join(f"(?:{r})" for r in regexes), "negate": negated}
            for negated, regexes in runs]


@F.pandas_udf(IGNORE_RUNS)
def parse_rules(text: pd.Series) -> pd.Series:
    """One call per .gitignore file, not per path."""
    return text.map(lambda t: rule_runs(t or ""))


def _hit(path: Column, regex: Column) -> Column:
    # This extract keeps the compiled pattern from one row to the next; rlike with a column does not.
    return F.regexp_instr(path, regex) > 0


def ignored(path: Column, runs: Column) -> Column:
    """Last matching rule wins; an ignored folder hides all below it for good."""
    plain = (F.size(runs) == 1) & ~F.element_at(runs, 1)["negate"]
    # Without negation any hit on the path or on a folder above decides, and a search sees them all.
    one_search = _hit(path, F.element_at(runs, 1)["regex"])
    steps = F.transform(prefixes(path), lambda p: F.when(p == path, p).otherwise(F.concat(p, F.lit("/"))))
    by_step = F.exists(
        steps,
        lambda step: F.aggregate(
            runs, F.lit(False),
            lambda hidden, run: F.when(_ends_hit(step, run["regex"]), ~run["negate"]).otherwise(hidden)),
    )
    return F.when(runs.isNull() | (F.size(runs) == 0), F.lit(False)).when(plain, one_search).otherwise(by_step)


def _ends_hit(step: Column, regex: Column) -> Column:
    # Here the match must reach the end of the step, or a hit on a folder above would count again.
    return F.regexp_instr(step, F.concat(F.lit("(?:"), regex, F.lit(")\\z"))) > 0
