"""Globs as Java regular expressions, built on the driver once per pattern.

Two dialects are needed. The exclude test ("walk") looks at every folder and file on
the way down, and a glob without '/' looks at the name only. The pattern scan
("listing") always looks at the whole path, and x/** also stands for x itself.
Dot files are ordinary names in both.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.paths import base_name, prefixes

_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}",
          "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}",
          "word": r"\w"}


@dataclass(frozen=True)
class Glob:
    regex: str
    name_only: bool
    negated: bool


def _brace(glob: str, start: int) -> tuple[list[str] | None, int] | None:
    """(options, position behind) of the brace group at start; options are None if it is just text,
    the whole is None if it is never closed."""
    depth, cuts, i = 0, [start], start
    while i < len(glob):
        ch = glob[i]
        if ch == "\\":
            i += 1
        elif ch == "{":
            depth += 1
        elif ch == "," and depth == 1:
            cuts.append(i)
        elif ch == "}":
            depth -= 1
            if depth == 0:
                body = glob[start + 1:i]
                if len(cuts) > 1:
                    cuts.append(i)
                    return [glob[a + 1:b] for a, b in zip(cuts, cuts[1:])], i + 1
                if span := re.fullmatch(r"(-?\d+)\.\.(-?\d+)", body):
                    a, b = int(span[1]), int(span[2])
                    step = 1 if b >= a else -1
                    return list(map(str, range(a, b + step, step))), i + 1
                return None, i + 1
        i += 1
    return None


def split_braces(glob: str) -> list[str]:
    """The globs that a glob stands for, by the braces with an option that reaches beyond its segment.

    Such options hold a '/', are all stars, or negate what follows. All other braces stay and
    become alternations of the regular expression, so their number costs nothing.
    """
    i = 0
    while i < len(glob):
        if glob[i] == "\\":
            i += 2
            continue
        if glob[i] == "{" and (group := _brace(glob, i)):
            options, end = group
            if options is not None and any("/" in o or "!(" in o or re.fullmatch(r"\**", o) for o in options):
                return [g for o in options for g in split_braces(glob[:i] + o + glob[end:])]
            if options is None:
                end = i + 1
            i = end
            continue
        i += 1
    return [glob]


def _closing(segment: str, start: int) -> int:
    depth = 0
    for i in range(start, len(segment)):
        depth += {"(": 1, ")": -1}.get(segment[i], 0)
        if depth == 0:
            return i
    return -1


def _alternatives(body: str) -> list[str]:
    found, depth, last = [], 0, 0
    for i, ch in enumerate(body):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "|" and depth == 0:
            found.append(body[last:i])
            last = i + 1
    return [*found, body[last:]]


def class_body(body: str) -> str:
    """The inside of a glob's character class as that of a Java class, which is always valid: names of
    classes are translated, reversed ranges match nothing, everything else stands for itself."""
    out, i = "", 0
    while i < len(body):
        if named := re.match(r"\[:(\w+):\]", body[i:]):
            out += _POSIX.get(named[1], "")
            i += named.end()
            continue
        first = body[i + 1:i + 2] if body[i] == "\\" else body[i]
        i += 2 if body[i] == "\\" else 1
        if body[i:i + 1] == "-" and i + 1 < len(body) and not body.startswith("[:", i + 1):
            last = body[i + 2:i + 3] if body[i + 1] == "\\" else body[i + 1]
            i += 3 if body[i + 1] == "\\" else 2
            if first and last and first <= last:
                out += f"\\x{{{ord(first):X}}}-\\x{{{ord(last):X}}}"
        elif first:
            out += f"\\x{{{ord(first):X}}}"
    return out


def char_class(segment: str, start: int) -> tuple[str, int] | None:
    """(regular expression, position behind) of the class at start; None if it is never closed."""
    end = start + 1
    if segment[end:end + 1] in ("!", "^"):
        end += 1
    if segment[end:end + 1] == "]":
        end += 1
    while end < len(segment) and segment[end] != "]":
        if segment.startswith("[:", end) and ":]" in segment[end:]:
            end = segment.find(":]", end) + 2
        else:
            end += 2 if segment[end] == "\\" else 1
    if end >= len(segment):
        return None
    body = segment[start + 1:end]
    negated = body[:1] in ("!", "^")
    inner = class_body(body[1:] if negated else body)
    if negated:
        return f"[^/{inner}]", end + 1
    return f"(?!/)[{inner}]" if inner else "(?!)", end + 1


def segment_regex(segment: str) -> str:
    """One path segment; no wildcard crosses a '/'."""
    if re.fullmatch(r"\*+", segment):
        return "[^/]+"
    out, i = "", 0
    while i < len(segment):
        ch = segment[i]
        if ch in "?*+@!" and segment[i + 1:i + 2] == "(" and _closing(segment, i + 1) > 0:
            end = _closing(segment, i + 1)
            inner = "|".join(segment_regex(a) for a in _alternatives(segment[i + 2:end]))
            if ch == "!":
                rest = segment_regex(segment[end + 1:])
                return out + f"(?!(?:{inner}){rest}(?:/|\\z))[^/]*?{rest}"
            out += f"(?:{inner})" + {"@": "", "?": "?", "*": "*", "+": "+"}[ch]
            i = end + 1
        elif ch == "{" and (group := _brace(segment, i)) and group[0] is not None:
            out += "(?:" + "|".join(map(segment_regex, group[0])) + ")"
            i = group[1]
        elif ch == "*":
            while segment[i + 1:i + 2] == "*":
                i += 1
            out += "[^/]*"
            i += 1
        elif ch == "?":
            out += "[^/]"
            i += 1
        elif ch == "[" and (parsed := char_class(segment, i)):
            out += parsed[0]
            i = parsed[1]
        elif ch == "\\" and i + 1 < len(segment):
            out += re.escape(segment[i + 1])
            i += 2
        else:
            out += re.escape(ch)
            i += 1
    return out


def path_regex(glob: str, star_includes_self: bool) -> str:
    parts = [p for i, p in enumerate(glob.split("/"))
             if not (p == "**" and glob.split("/")[i - 1:i] == ["**"])]
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part != "**":
            out += segment_regex(part) + ("" if last else "/")
        elif not last:
            out += "(?:[^/]+/)*"
        elif star_includes_self and out.endswith("/"):
            out = out[:-1] + "(?:/.+)?"
        else:
            out += ".+"
    return out


def compile_walk(pattern: str) -> list[Glob]:
    if not pattern or pattern.startswith("#"):
        return []
    bangs = len(pattern) - len(pattern.lstrip("!"))
    if pattern[bangs:bangs + 1] == "(" and bangs:
        bangs -= 1
    bodies = split_braces(pattern[bangs:])
    globs = [(path_regex(b, False), "/" not in b) for b in bodies]
    if bangs % 2 == 0:
        return [Glob(rx, name_only, False) for rx, name_only in globs]
    # A negated glob excludes what none of its expansions matches.
    named = [rx if not name_only else f"(?:.*/)?(?:{rx})" for rx, name_only in globs]
    return [Glob("|".join(named), False, True)]


def _full(alternatives: list[str]) -> str:
    return "(?s)\\A(?:" + "|".join(alternatives) + ")\\z"


def excluded(path: Column, patterns, root: str = "") -> Column:
    """True if the walk from root meets an excluded folder or file on the way to path."""
    globs = [g for p in patterns for g in compile_walk(p)]
    tests = []
    below = path if root == "" else F.substr(path, F.lit(len(root) + 2))
    names = [g.regex for g in globs if g.name_only]
    wholes = [g.regex for g in globs if not g.name_only and not g.negated]
    if names:
        # Some segment below the root has such a name.
        tests.append(F.rlike(below, F.lit(_full([f"(?:.*/)?(?:{rx})(?:/.*)?" for rx in names]))))
    if wholes and root == "":
        tests.append(F.rlike(path, F.lit(_full([f"(?:{rx})(?:/.*)?" for rx in wholes]))))
    # The scan root itself is never tested.
    steps = prefixes(path) if root == "" else F.transform(
        prefixes(below), lambda p: F.concat(F.lit(root + "/"), p))
    if wholes and root != "":
        tests.append(F.exists(steps, lambda p: F.rlike(p, F.lit(_full(wholes)))))
    for unlike in [F.lit(_full([g.regex])) for g in globs if g.negated]:
        tests.append(F.exists(steps, lambda p: ~F.rlike(p, unlike)))
    return _any(tests)


def _any(tests: list[Column]) -> Column:
    result = F.lit(False)
    for i, t in enumerate(tests):
        result = t if i == 0 else result | t
    return result


def _listing_regexes(patterns) -> list[str]:
    stripped = [p[2:] if p.startswith("./") else p for p in patterns]
    return [path_regex(b, True) for p in stripped if p for b in split_braces(p)]


def listed(path: Column, patterns, exclude=()) -> Column:
    """The pattern scan: some pattern matches and no ignore glob matches the path or a folder
    above it; then the excludes are tested on the final path once more, names included."""
    positive = _listing_regexes([p for p in patterns if not p.startswith("!") or p.startswith("!(")])
    negative = _listing_regexes(
        [p[1:] for p in patterns if p.startswith("!") and not p.startswith("!(")]
        + [p for p in exclude if not p.startswith("!")])
    if not positive:
        return F.lit(False)
    keep = F.rlike(path, F.lit(_full(positive)))
    if negative:
        keep = keep & ~F.rlike(path, F.lit(_full([f"(?:{rx})(?:/.*)?" for rx in negative])))
    final = [g for p in exclude for g in compile_walk(p)]
    whole = [g.regex for g in final if not g.name_only and not g.negated]
    names = [g.regex for g in final if g.name_only]
    if whole:
        keep = keep & ~F.rlike(path, F.lit(_full(whole)))
    if names:
        keep = keep & ~F.rlike(base_name(path), F.lit(_full(names)))
    for g in final:
        if g.negated:
            keep = keep & F.rlike(path, F.lit(_full([g.regex])))
    return keep
