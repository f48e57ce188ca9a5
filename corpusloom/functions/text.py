"""Per-file text steps as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.paths import extension

# File extension -> language; everything else is plaintext.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".cjs": "javascript", ".mjs": "javascript",
    ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "css", ".less": "css",
    ".py": "python",
    ".json": "json",
    ".md": "markdown",
    ".sh": "shell", ".bash": "shell",
}

# The white space of ECMAScript (\s and trim agree on it); Java's \s is ASCII only.
_BLANKS = [0x09, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
           0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
WHITESPACE = "\n" + "".join(map(chr, _BLANKS))
BLANK_CLASS = "".join(f"\\x{{{code:X}}}" for code in _BLANKS)
WS = f"[\\n{BLANK_CLASS}]"
_BREAKS = r"\n\r\x{2028}\x{2029}"
# Start of a line. Java also counts U+0085 as a line end, ECMAScript does not.
_LINE_START = r"(?m)^(?<!\x85)"
# The white space within a line as Java sees it: \p{Z} has all of it but five control
# characters and the byte order mark, and tests faster than a list of ranges.
_BLANK = r"[\t\x0B\f\r\p{Z}\x{FEFF}]"

def _utf16(content: Column) -> Column:
    """UTF-16LE to text. The built-in decoder stops at half a surrogate pair, so these become U+FFFD first: the hexadecimal digits
    are cut into pairs and single units, and what is left alone with a D8 to DF in its high byte is replaced. Few texts
    have any such byte; the others are decoded as they are. A last odd byte is left out."""
    whole = F.substring(content, F.lit(1), F.length(content) - F.length(content) % 2)
    digits = F.hex(whole)
    units = F.regexp_extract_all(digits, F.lit("..D[89AB]..D[C-F]|...."), F.lit(0))
    mended = F.array_join(F.transform(units, lambda u: F.when((F.length(u) == 4) & F.rlike(u, F.lit("^..D[89A-F]")), "FDFF").otherwise(u)), "")
    return F.when(F.rlike(digits, F.lit("D[89A-F]")), F.decode(F.unhex(mended), "UTF-16LE")).otherwise(F.decode(whole, "UTF-16LE"))


def read_text(content: Column, encoding: str = "utf8") -> Column:
    """Bytes to text; wrong bytes become U+FFFD instead of failing the row."""
    name = encoding.lower().replace("-", "").replace("_", "")
    if name in ("utf8", ""):
        return F.make_valid_utf8(content.cast("string"))
    if name in ("latin1", "binary"):
        return F.decode(content, "ISO-8859-1")
    if name == "ascii":
        # Only seven bits of a byte count. A zero would mean "leave out" to translate, so it goes apart.
        high, low = "".join(map(chr, range(0x81, 0x100))), "".join(map(chr, range(0x01, 0x80)))
        return F.translate(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\x80"), F.lit("\0")), high, low)
    if name not in ("utf16le", "ucs2"):
        raise ValueError(f"encoding {encoding!r} is not supported")
    return _utf16(content)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(LANGUAGES.items())])
    return F.coalesce(F.try_element_at(table, F.lower(extension(path))), F.lit("plaintext"))


def strip_c_comments(text: Column) -> Column:
    # The literal comes first and the look-behind after it: that is tested at few places only.
    no_blocks = F.regexp_replace(text, r"/\*[\s\S]*?\*/", "")
    return F.regexp_replace(no_blocks, r"//(?<!://)[^\n]*", "")


def strip_hash_comments(text: Column) -> Column:
    return F.regexp_replace(text, f"#(?<=(?:\\A|{WS})#)[^\\n]*", "")


def strip_html_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"<!--[\s\S]*?-->", "")


def license_header(text: Column) -> Column:
    """The leading comment plus a line feed if it speaks of a license, else ''."""
    lead = F.regexp_extract(text, r"\A(/\*[\s\S]*?\*/|//[^\n]*\n+)", 0)
    starts = F.substring(text, 1, 2).isin("/*", "//")
    return F.when(starts & F.contains(F.lower(lead), F.lit("license")),
                  F.concat(lead, F.lit("\n"))).otherwise(F.lit(""))


def strip_comments(text: Column, lang: Column) -> Column:
    return (
        F.when(lang.isin("typescript", "javascript", "css"), strip_c_comments(text))
        .when(lang.isin("python", "shell"), strip_hash_comments(text))
        .when(lang == "html", strip_html_comments(text))
        .otherwise(text)
    )


def put_back(header: Column, stripped: Column) -> Column:
    """The license header in front again, unless the text still starts with it."""
    return F.when((header != "") & ~F.startswith(stripped, header),
                  F.concat(header, stripped)).otherwise(stripped)


def strip_import_lines(text: Column) -> Column:
    for pattern in (
        f"{_LINE_START}import{WS}+[\\s\\S]*?from{WS}+['\"][^'\"]+['\"];?",
        f"{_LINE_START}import{WS}+['\"][^'\"]+['\"];?",
        f"{_LINE_START}(const|let|var){WS}+[^{_BREAKS}]*={WS}*require\\(['\"][^'\"]+['\"]\\);?",
    ):
        text = F.regexp_replace(text, pattern, "")
    return text


def strip_imports(text: Column, lang: Column) -> Column:
    return F.when(lang.isin("typescript", "javascript"), strip_import_lines(text)).otherwise(text)


def collapse_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def trim_lines(text: Column) -> Column:
    """Trim the end of every line, then the whole text.

    A long run of blanks inside a line is matched as a whole and put back, so that it costs
    linear, not quadratic, time.
    """
    per_line = F.regexp_replace(text, f"{_BLANK}++(?=\\n|\\z)|({_BLANK}{{16}}{_BLANK}*+)", "$1")
    return F.btrim(per_line, F.lit(WHITESPACE))


def line_numbers(lines: Column) -> Column:
    """Numbered text of a column that holds the lines; it is used twice, so it should not be a split."""
    width = F.length(F.size(lines).cast("string"))
    numbered = F.transform(
        lines, lambda line, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" | "), line)
    )
    return F.array_join(numbered, "\n")


def wrap(text: Column, path: Column, reason: Column, header: str, footer: str) -> Column:
    top = F.replace(F.lit(header), F.lit("{path}"), path)
    with_reason = F.when(F.coalesce(reason, F.lit("")) != "",
                         F.concat(top, F.lit("\n// Reason: "), reason)).otherwise(top)
    bottom = F.replace(F.lit(footer), F.lit("{path}"), path)
    return F.concat_ws("\n", with_reason, text, bottom)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; pure ASCII texts skip the re-encoding."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text).cast("long")).otherwise(
        (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"))


def tokens_of_length(units: Column) -> Column:
    return F.ceil(units / 4).cast("long")


def tokens(text: Column) -> Column:
    return tokens_of_length(utf16_length(text))
