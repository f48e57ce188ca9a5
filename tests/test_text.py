import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import paths, text
from tests.helpers import column

JS_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def one(spark, value, expr):
    return column(spark, [value], expr)[0]


def test_extension(spark):
    names = ["a.ts", "a.d.ts", ".bashrc", "..a.b", "x.", "q/.a.ts", "noext", "a.b/c", "A.TS"]
    assert column(spark, names, paths.extension) == [".ts", ".ts", "", ".b", ".", ".ts", "", "", ".TS"]


def test_parent_and_prefixes(spark):
    assert column(spark, ["a/b/c", "a", ""], paths.parent_dir) == ["a/b", "", ""]
    assert one(spark, "a/b/c", paths.prefixes) == ["a", "a/b", "a/b/c"]


def test_resolve_path(spark):
    def at(base):
        return lambda v: paths.resolve_path(v, F.lit(base))
    targets = ["./x", "../x", "../../x", "../../../x", "x/../y", "/r/./s", "..", "."]
    assert column(spark, targets, at("a/b")) == ["a/b/x", "a/x", "x", None, "a/b/y", "r/s", "a", "a/b"]
    assert column(spark, ["./x", "../x"], at("")) == ["x", None]


def test_clean_root():
    assert [paths.clean_root(r) for r in ("./", "", "src/", "./src/../lib", "../x", "/abs")] == ["", "", "src", "lib", None, None]


def test_language(spark):
    assert column(spark, ["a.TSX", "b.mjs", "c.htm", "d.less", "e.py", "f.bash", "g.rs"], text.language) == [
        "typescript", "javascript", "html", "css", "python", "shell", "plaintext"]


def test_strip_c(spark):
    source = '// a\nlet u = "http://x"; // b\n/* c\nd */e:///f\n'
    expected = re.sub(r"(^|[^:])//[^\n]*", r"\1", re.sub(r"/\*[\s\S]*?\*/", "", source))
    assert one(spark, source, text.strip_c_comments) == expected


def test_strip_patterns_against_their_plain_form(spark):
    """The fast forms must agree with the textbook ones on random texts."""
    rng = random.Random(7)
    values = ["".join(rng.choice(["/", "/", ":", "#", " ", "\n", "a", "*", "\xa0"]) for _ in range(30)) for _ in range(300)]
    blocks = [re.sub(r"/\*[\s\S]*?\*/", "", v) for v in values]
    assert column(spark, values, text.strip_c_comments) == [re.sub(r"(\A|[^:])//[^\n]*", r"\1", b) for b in blocks]
    space = "[" + JS_SPACE + "]"
    assert column(spark, values, text.strip_hash_comments) == [re.sub(rf"(\A|{space})#[^\n]*", r"\1", v) for v in values]


def test_large_block_comment(spark):
    body = "x" * 4_000_000
    assert one(spark, f"a/*{body}\n{body}*/b", text.strip_c_comments) == "ab"


def test_strip_html(spark):
    assert one(spark, "a<!-- x\ny -->b<!---->c", text.strip_html_comments) == "abc"


def test_license_header(spark):
    values = ["// MIT LICENSE\n\nx", "/* license */x", "/* other */x", "x // license\n", "# license\n", "/* open license", "// license"]
    assert column(spark, values, text.license_header) == ["// MIT LICENSE\n\n\n", "/* license */\n", "", "", "", "", ""]


def stripped(lang):
    return lambda v: text.put_back(text.license_header(v), text.strip_comments(v, F.lit(lang)))


def test_license_is_put_back(spark):
    assert one(spark, "/* license */\nx", stripped("typescript")) == "/* license */\n\nx"
    # Not stripped there, so it would be doubled unless a line feed follows the comment.
    assert one(spark, "/* license */\nx", stripped("markdown")) == "/* license */\nx"
    assert one(spark, "/* license */x", stripped("markdown")) == "/* license */\n/* license */x"


def test_strip_imports(spark):
    source = ('import a from "a";\nimport {\n b\n} from \'b\'\n  import d from "d";\nimport "c";\n'
              'const e = require("e");\nvar f = 1, g = require(\'g\')\nlet h = 2;\n')
    assert one(spark, source, text.strip_import_lines) == '\n\n  import d from "d";\n\n\n\nlet h = 2;\n'
    # A side-effect import swallows what follows up to a later from.
    assert one(spark, 'import "x";\nlet y;\nimport z from "z";\n', text.strip_import_lines) == "\n"


def test_line_starts_are_those_of_javascript(spark):
    for mark, starts in (("\u2028", True), ("\r", True), ("\x85", False)):
        source = f'x{mark}import "a";'
        assert (one(spark, source, text.strip_import_lines) != source) is starts


def test_collapse_and_trim(spark):
    assert one(spark, "a\n\n\n\nb\n\nc", text.collapse_blank) == "a\n\nb\n\nc"
    for ch in JS_SPACE:
        assert one(spark, f"{ch}a{ch}b{ch}", text.trim_lines) == f"a{ch}b"
    assert one(spark, "a \t\r\n b\x85\n\n\n", text.trim_lines) == "a\n b\x85"
    assert one(spark, " \n ", text.trim_lines) == ""


def test_trim_of_long_inner_runs_is_linear(spark):
    run = " " * 400_000
    assert one(spark, f"a{run}b{run}\nc", text.trim_lines) == f"a{run}b\nc"


def numbers(v):
    return text.line_numbers(F.split(v, "\n", -1))


def test_line_numbers(spark):
    assert one(spark, "\n".join("x" * 9), numbers).startswith("1 | x\n2 | x")
    assert one(spark, "\n".join("x" * 10), numbers).startswith(" 1 | x\n 2 | x")
    assert one(spark, "", numbers) == "1 | "


def test_wrap_takes_paths_literally(spark):
    def wrapped(reason):
        return lambda v: text.wrap(F.lit("body"), v, F.lit(reason), "<{path}{path}>", "</{path}>")
    assert one(spark, "a$&b", wrapped("why")) == "<a$&ba$&b>\n// Reason: why\nbody\n</a$&b>"
    assert one(spark, "p", wrapped("")) == "<pp>\nbody\n</p>"


def test_tokens_count_utf16_units(spark):
    values = ["", "abcd", "abcde", "a\U0001F600é", "é" * 4, "\U0001F600" * 3]
    assert column(spark, values, text.tokens) == [0, 1, 2, 1, 1, 2]


def test_read_text(spark):
    values = [bytearray(b"a\xffb"), bytearray("é".encode()), bytearray(b"")]
    assert column(spark, values, text.read_text, "v binary") == ["a\ufffdb", "é", ""]
    assert column(spark, [bytearray("é\U0001F600".encode("utf-16-le"))],
                  lambda v: text.read_text(v, "utf16le"), "v binary") == ["é\U0001F600"]
    assert column(spark, [bytearray(b"\xe9")], lambda v: text.read_text(v, "latin1"), "v binary") == ["é"]


def test_utf16_with_halves_and_odd_bytes(spark):
    rng = random.Random(2)
    units = [0x41, 0xD8, 0xD800, 0xDBFF, 0xDC00, 0xDFFF, 0xD83D, 0xDE00, 0x0D8D, 0x8DD8, 0xFFFE, 0x0A]
    values = [b"", b"A", b"\x00\xd8", *(b"".join(rng.choice(units).to_bytes(2, "little") for _ in range(rng.randrange(30))) + rng.choice([b"", b"x"]) for _ in range(200))]
    want = [v[:len(v) // 2 * 2].decode("utf-16-le", "surrogatepass").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for v in values]
    assert column(spark, list(map(bytearray, values)), lambda v: text.read_text(v, "utf16le"), "v binary") == want
    long = ("日本\U0001F600 " * 60_000).encode("utf-16-le")
    assert column(spark, [bytearray(long)], lambda v: text.read_text(v, "ucs2"), "v binary") == [long.decode("utf-16-le")]
