import pytest

from corpusloom.functions import globs
from tests.helpers import column

# pattern, path, excluded by the walk from the project root
WALK = [
    ("**/*.min.*", "a/b.min.js", True),
    ("**/*.min.*", "b.min.js", True),
    ("**/*.min.*", "a/bmin.js", False),
    ("**/node_modules/**", "node_modules/x/y.js", True),
    ("**/node_modules/**", "a/node_modules/y.js", True),
    ("**/node_modules/**", "a/node_modules", False),
    ("**/dist/**", "mydist/a.js", False),
    ("dist", "a/dist/x.js", True),
    ("dist", "dist", True),
    ("dist", "a/dist.js", False),
    ("*.lock", "a/b/yarn.lock", True),
    ("/dist", "dist/x", False),
    ("src/*", "src/a/b.ts", True),
    ("src/*.ts", "src/a/b.ts", False),
    ("src/**/b.ts", "src/b.ts", True),
    ("src/**/b.ts", "src/x/y/b.ts", True),
    ("src/**", "src", False),
    ("**/*.{png,jpg}", "a/b.jpg", True),
    ("**/*.{png,jpg}", "a/b.gif", False),
    ("v{1..3}.txt", "v2.txt", True),
    ("a?c", "abc", True),
    ("a?c", "a/c", False),
    ("[a-c]x", "bx", True),
    ("[!a-c]x", "bx", False),
    ("[!a-c]x", "dx", True),
    ("*", ".hidden", True),
    ("*.ts", ".ts", True),
    ("@(a|b).js", "b.js", True),
    ("!(a|b).js", "b.js", False),
    ("!(a|b).js", "c.js", True),
    ("+(ab).js", "abab.js", True),
    ("\\*.js", "*.js", True),
    ("\\*.js", "a.js", False),
    ("a.b", "axb", False),
    ("#x", "#x", False),
    ("A.ts", "a.ts", False),
    ("a{b", "a{b", True),
]


def test_walk_table(spark):
    wanted = {}
    for pattern, path, hit in WALK:
        wanted.setdefault(pattern, []).append((path, hit))
    for pattern, cases in wanted.items():
        got = column(spark, [path for path, _ in cases], lambda v: globs.excluded(v, [pattern]))
        assert (pattern, got) == (pattern, [hit for _, hit in cases])


def test_scan_root_is_exempt_but_folders_below_are_not(spark):
    paths = ["src/en/a.ts", "src/en/en/b.ts", "src/en/x/c.ts"]
    test = lambda patterns: column(spark, paths, lambda v: globs.excluded(v, patterns, "src/en"))
    assert test(["en"]) == [False, True, False]
    assert test(["src/en"]) == [False, False, False]
    assert test(["src/en/x"]) == [False, False, True]
    assert test(["src/*/*.ts"]) == [True, False, False]


def test_negated_exclude_keeps_only_what_matches(spark):
    paths = ["a.ts", "b.js", "d/a.ts"]
    # The walk tests folders too, so d itself is excluded, as it is not a .ts name.
    assert column(spark, paths, lambda v: globs.excluded(v, ["!**/*.ts"])) == [False, True, True]


def test_pattern_scan_differs_from_the_walk(spark):
    paths = ["a/dist/x.js", "dist/x.js", "tools/build", "x.json", "a/x.json", ".env"]
    listed = lambda patterns, exclude=(): [
        p for p, ok in zip(paths, column(spark, paths, lambda v: globs.listed(v, patterns, exclude))) if ok]
    # A bare name excludes by folder in a walk, but only by the last name here.
    assert listed(["**/*.js"], ["dist"]) == ["a/dist/x.js"]
    assert listed(["**"], ["**/build/**", "**/*.js"]) == ["x.json", "a/x.json", ".env"]
    assert listed(["*.json"]) == ["x.json"]
    assert listed(["./*.json", "!x.json"]) == []
    assert listed(["**/*.json", "!a/**"]) == ["x.json"]
    assert listed(["!a/**"]) == []
    assert listed(["**/*.json"], ["x.json"]) == []


def test_expand_braces():
    assert globs.split_braces("a{b,c{1..2}}d") == ["a{b,c{1..2}}d"]
    assert globs.split_braces("x/{a/b,c}/{d,e}") == ["x/a/b/{d,e}", "x/c/{d,e}"]
    assert globs.split_braces("{a,*}") == ["a", "*"]


@pytest.mark.parametrize("glob, yes, no", [
    ("a{b,c{1..2}}d", ["abd", "ac1d", "ac2d"], ["ad", "ac3d", "acd"]), ("a{b}", ["a{b}"], ["ab"]),
    ("{a,b}{c,d}", ["ac", "bd"], ["ab"]), ("n{1..20000}{0..9}", ["n199993"], ["n30000a"]), ("{a,}b", ["ab", "b"], ["a"]),
    ("\\{a,b}", ["{a,b}"], ["a"]), ("{a", ["{a"], ["a"]), ("x{*.md,?}", ["xa.md", "xy"], ["xyz"])])
def test_braces_are_alternations(spark, glob, yes, no):
    assert column(spark, yes + no, lambda v: globs.listed(v, [glob])) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("text", ["[z-a]", "[]", "[]a]", "[[:alpha:]x]", "[[:none:]]", "[!]", "[a", "[\\]]", "[a-]", "[&&b]", "[^^]", "[--/]"])
def test_any_class_compiles(spark, text):
    found = column(spark, ["a", "z", "-", "]", "x/y"], lambda v: globs.listed(v, [text, "q" + text]))
    assert not any(found[-1:]) and column(spark, ["a"], lambda v: globs.excluded(v, [text])) in ([True], [False])
