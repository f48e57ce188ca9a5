"""Main text of web pages: subtrees that recur on many pages of a host are template, and go."""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import map_slices
from corpusloom.staging import stage, stage_clustered

MIN_PAGES = 5
# An element with its texts is template on a hundredth of a host's pages; prose, and elements known by their tags and
# attributes alone, on more than half of them.
LEAST_SHARE, PROSE_SHARE = 0.01, 0.5
EXACT, PROSE_TEXT, SHAPE = 0, 1, 2
# Rows that are found again by their number come in blocks of up to 2 ** BLOCK.
BLOCK_BITS = 6
_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([A-Za-z][^\s/>]*)")
_IN_TAG = re.compile(r"[>]|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[^\s=/\"'>]+(?=\s*=)")
_BLANK = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "xmp"))
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead tr ul""".split())
# Never part of the main text.
DROPPED = frozenset("""aside audio button canvas datalist dialog embed footer form head iframe input label map menu nav
noscript object script select style svg template textarea title video""".split())
# Words of a class, id or role that name what is not main text, and words that may stand beside them: a name counts only if it
# consists of both, so a share price is no share button.
NAMED = frozenset("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent
contentinfo cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice
notices pagination popup promo promotion related reply replies search share sharing sidebar signup skip social sponsor
sponsored subscribe toolbar widget""".split())
BESIDE = frozenset("""area bar block body bottom box button buttons container form global group head icons inner item items left link
links list main of page panel right row section site slot small text the to top unit widget wrap""".split())
READERS = frozenset("comment comments disqus reply replies".split())
MAIN = frozenset(("article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
# Elements whose tag alone tells nothing of what they are for.
_PLAIN = frozenset("center div dl ol section table tbody td tfoot th thead tr ul".split())
# Prose that menus are made of too.
_LISTED = frozenset("li dt dd td th figcaption".split())
# An opening tag ends these open ones (up to the named limits).
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
         "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody")}
_LIMITS = frozenset(("ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body"))




def _tag_end(page: str, at: int, dead: set[int], missing: dict[str, bool]) -> tuple[int, int]:
    """(end of the attributes, end of the tag) for a tag whose name ends at `at`; (-1, -1) if it never ends.

    A quote counts behind an equals sign; one that is never closed counts for nothing, and the tag ends at its first '>'. Where
    such a search has failed, dead and missing spare the next one.
    """
    here = at
    while here not in dead and not missing.get("all"):
        found = _IN_TAG.search(page, here)
        if found is None:
            missing["all"] = True
            break
        if found[1] is None:
            return found.start(), found.end()
        close = -1 if missing.get(found[1]) else page.find(found[1], found.end())
        if close < 0:
            missing[found[1]] = True
            dead.add(here)
            break
        here = close + 1
    dead.add(at)
    end = -1 if missing.get(">") else page.find(">", at)
    if end < 0:
        missing[">"] = True
        return -1, -1
    return end, end + 1


class Page:
    """The elements of a page in document order, each with the number of its parent, and the pieces of text between tags.

    Tags that are never closed end where HTML says or with their parent. All walks are loops over these lists, so a page
    may be nested to any depth.
    """

    def __init__(self, page: str):
        self.tags, self.attributes, self.parents = ["#root"], [""], [-1]
        # (element, block, text); a block is a run of text without a block element's border in it.
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        self._parse(page)
        self._measure()

    def _parse(self, page: str) -> None:
        stack, open_at, open_blocks = [0], {}, []
        dead, missing = set(), {}
        tags, pieces = self.tags, self.pieces
        at, kept, n = 0, 0, len(page)

        def drop_to(size: int) -> None:
            while len(stack) > size:
                tag = tags[stack.pop()]
                open_at[tag].pop()
                if open_blocks and open_blocks[-1] == len(stack):
                    open_blocks.pop()
                    self.block += 1

        def add(tag: str, attributes: str, opens: bool) -> None:
            tags.append(tag)
            self.attributes.append(attributes)
            self.parents.append(stack[-1])
            block = tag in BLOCK
            self.block += block
            if opens:
                if block:
                    open_blocks.append(len(stack))
                open_at.setdefault(tag, []).append(len(stack))
                stack.append(len(tags) - 1)
            else:
                self.block += block

        def text(end: int) -> None:
            if end > kept:
                pieces.append((stack[-1], self.block, page[kept:end]))

        while (token := _OPEN.search(page, at)) is not None:
            start, name = token.start(), token[2]
            if name is None:
                mark = token[0]
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(mark, ">")
                end = page.find(close, token.end())
                after = n if end < 0 else end + len(close)
            else:
                attributes_end, after = _tag_end(page, token.end(), dead, missing)
                if after < 0:
                    at = token.end()
                    continue
            text(start)
            at = kept = after
            if name is None:
                continue
            tag = name.lower()
            if token[1]:
                if open_at.get(tag):
                    drop_to(open_at[tag][-1])
                elif tag == "p":
                    add("p", "", False)
                continue
            if tag in BLOCK and open_blocks:
                # A block ends an open paragraph, with the inline tags inside; a heading an open heading.
                near = tags[stack[open_blocks[-1]]]
                if near == "p" or near in PROSE and near[0] == "h" and tag[0] == "h" and tag in PROSE:
                    drop_to(open_blocks[-1])
            if tag in _ENDS:
                last = max((open_at[t][-1] for t in _ENDS[tag] if open_at.get(t)), default=0)
                if last > max((open_at[t][-1] for t in _LIMITS if open_at.get(t)), default=0):
                    drop_to(last)
            if tag == "br":
                pieces.append((stack[-1], self.block, " "))
            add(tag, page[token.end():attributes_end], tag not in VOID and tag not in RAW)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, after)
                end = -1 if close is None else page.find(">", close.end())
                pieces.append((len(tags) - 1, self.block, page[after:close.start() if close else n]))
                at = kept = n if end < 0 else end + 1
        text(n)

    def _measure(self) -> None:
        """Per element, with all below it: letters, those in links and in prose, and whether it holds main or prose elements."""
        n, tags, parents = len(self.tags), self.tags, self.parents
        self.letters, self.linked, self.within = [0] * n, [0] * n, [0] * n
        self.has_main, self.has_prose, self.has_title = bytearray(n), bytearray(n), bytearray(n)
        for node, _, text in self.pieces:
            self.letters[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            tag, up = tags[i], parents[i]
            if tag in PROSE:
                self.within[i] = self.letters[i]
            self.letters[up] += self.letters[i]
            self.linked[up] += self.letters[i] if tag == "a" else self.linked[i]
            self.within[up] += self.within[i]
            self.has_main[up] |= self.has_main[i] | (tag in MAIN)
            self.has_prose[up] |= self.has_prose[i] | (tag in PROSE and tag not in _LISTED)
            self.has_title[up] |= self.has_title[i] | (tag in ("h1", "h2"))

    def _names(self, i: int) -> tuple[bool, bool]:
        """Whether a class, id or role of an element says that it is no main text, and that it is by readers."""
        out = readers = False
        for name, value in _ATTRIBUTE.findall(self.attributes[i]):
            name = name.lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                out = True
            elif name != "style" and self.tags[i] not in PROSE:
                for word in value.strip("\"'").split():
                    words = {w.lower() for w in _WORDS.findall(word)}
                    if words & NAMED and words <= NAMED | BESIDE:
                        out, readers = True, readers or bool(words & READERS)
        return out, readers

    def candidates(self) -> list[tuple[int, int, int]]:
        """(element, hash, kind) of every element that is template if it recurs: with its texts, or for what holds no prose
        by its tags, classes and names of attributes alone.

        Pieces of prose are none. Prose may recur with reason: inside of an article only what is mostly links counts, outside what holds no article.
        """
        n, tags, parents = len(self.tags), self.tags, self.parents
        children: list[list] = [[] for _ in range(n)]
        # The pieces and elements of a parent in order: an element comes before what is inside it.
        own = iter(self.pieces)
        for i in range(1, n):
            children[parents[i]].append((i, None))
        texts: list[list[str]] = [[] for _ in range(n)]
        for node, _, text in own:
            if text := _BLANK.sub(" ", text).strip():
                texts[node].append(text)
        exact, shapes = [b""] * n, [""] * n
        for i in range(n - 1, 0, -1):
            below = [exact[c] for c, _ in children[i]]
            exact[i] = xxhash.xxh3_128_digest(b"\0".join(
                (tags[i].encode(), _BLANK.sub(" ", self.attributes[i]).strip().encode(), *below, *(t.encode() for t in texts[i]))))
            kept = [shapes[c] for c, _ in children[i]]
            shapes[i] = self._label(i) + "[" + " ".join(k for k, before in zip(kept, [None, *kept]) if k != before) + "]"
            if len(shapes[i]) > 200:
                shapes[i] = f"#{xxhash.xxh3_64_intdigest(shapes[i])}"
        main_inside, prose_inside = bytearray(n), bytearray(n)
        found, body = [], self.letters[0]
        for i in range(1, n):
            up, tag = parents[i], tags[i]
            main_inside[i] = main_inside[up] | (tags[up] in MAIN)
            prose_inside[i] = prose_inside[up] | (tags[up] in PROSE and tags[up] not in _LISTED)
            if tag in ("html", "body", *MAIN) or self.has_main[i] or prose_inside[i]:
                continue
            bare = tag not in PROSE and not self.has_prose[i]
            links = 2 * self.linked[i] > self.letters[i]
            if main_inside[i] and not (bare and links):
                continue
            in_prose = tag in PROSE or 0 < self.letters[i] < 2 * self.within[i]
            found.append((i, int.from_bytes(exact[i][:8], "little", signed=True), PROSE_TEXT if in_prose and not links else EXACT))
            if bare and tag in BLOCK and (links or tag not in _PLAIN or "." in shapes[i][:len(tag) + 1]) and 2 * self.letters[i] < body and 2 * self.within[0] > body - self.linked[0]:
                found.append((i, xxhash.xxh3_64_intdigest(shapes[i], 1) - (1 << 63), SHAPE))
        return found

    def _label(self, i: int) -> str:
        if not self.attributes[i].strip():
            return self.tags[i]
        named = sorted(f"{n.lower()}={v.strip(chr(34) + chr(39))}" for n, v in _ATTRIBUTE.findall(self.attributes[i]) if n.lower() in ("class", "id", "role"))
        return f"{self.tags[i]}.{','.join(named)}:{','.join(sorted(x.lower() for x in _NAME.findall(self.attributes[i])))}"

    def main_pieces(self) -> list[tuple[int, int, str]]:
        """(element, block, text) of the pieces of the main text, templates left in: those of the articles (else of main, else of the
        body), without elements that are never main text by their tag, or by a name."""
        n, tags, parents = len(self.tags), self.tags, self.parents
        by_name, by_readers = bytearray(n), bytearray(n)
        for i in range(1, n):
            if self.attributes[i] and tags[i] not in ("html", "body"):
                by_name[i], by_readers[i] = self._names(i)
        dropped = bytearray(tags[i] in DROPPED or tags[i] == "header" and not self.has_title[i] for i in range(n))

        def tops(tag: str, strict: bool) -> list[int]:
            out, inside, found = bytearray(n), bytearray(n), []
            for i in range(1, n):
                up = parents[i]
                # A wrapper may be called after the sidebar next to what it wraps; an article by readers is none.
                gone = by_name[i] and (strict or not self.has_main[i]) if tags[i] not in MAIN else by_readers[i]
                out[i] = out[up] | dropped[i] | bool(gone)
                inside[i] = inside[up]
                if tags[i] == tag and not out[i] and not inside[i]:
                    inside[i] = 1
                    found.append(i)
            return found

        roots: list[int] = []
        for strict in (True, False):
            roots = roots or tops("article", strict) or tops("main", strict)
        whole = not roots
        taken, out = bytearray(n), bytearray(n)
        for i in roots or [0]:
            taken[i] = 1
        for i in range(1, n):
            up = parents[i]
            # Without an article what holds most of the text is not dropped for its name.
            gone = by_name[i] and not (whole and 2 * self.letters[i] > self.letters[0]) if tags[i] not in MAIN else by_readers[i] and not taken[i]
            out[i] = out[up] if not taken[i] else 0
            out[i] |= dropped[i] | bool(gone and not (taken[i]))
            taken[i] |= taken[up]
        return [p for p in self.pieces if taken[p[0]] and not out[p[0]]]


def _joined(pieces: list[tuple[int, str]]) -> str:
    """Blocks joined by line feeds, white space inside a block being one blank."""
    blocks: dict[int, list[str]] = {}
    for block, text in pieces:
        blocks.setdefault(block, []).append(text)
    return "\n".join(filter(None, (_BLANK.sub(" ", "".join(b)).strip() for b in blocks.values())))


def _under(page: Page, found: list[tuple[int, int, int]]) -> list[list[int]]:
    """For each element the last entry of found for it or what it is in, and for each entry the one around it, as (first, up)."""
    own: dict[int, list[int]] = {}
    for k, (i, _, _) in enumerate(found):
        own.setdefault(i, []).append(k)
    near = [-1] * len(page.tags)
    up = [-1] * len(found)
    for i in range(1, len(page.tags)):
        near[i] = near[page.parents[i]]
        for k in own.get(i, ()):
            up[k], near[i] = near[i], k
    return [near, up]


def main_text(page: str, template: set[int]) -> str:
    """The main text of a page without the subtrees whose hash is in template."""
    tree = Page(page)
    found = tree.candidates() if template else []
    near, up = _under(tree, found)
    gone = _gone([h for _, h, _ in found], up, template)
    return _joined([(b, html.unescape(t)) for i, b, t in tree.main_pieces() if near[i] < 0 or not gone[near[i]]])


def _gone(hashes: list[int], up: list[int], template: set[int]) -> list[bool]:
    gone: list[bool] = []
    for k, h in enumerate(hashes):
        gone.append(h in template or up[k] >= 0 and gone[up[k]])
    return gone


def _page(raw: bytes | None) -> str:
    return (raw or b"").decode(errors="replace")


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_PARTS = ("_at long, page_no long, host string, page_id {id}, url string, hashes array<long>, kinds array<int>, up array<int>, "
          "under array<int>, blocks array<int>, texts array<string>")


def _parsed(pages: DataFrame) -> DataFrame:
    """Every page once: the hashes of what may be template, and the pieces of its main text with the innermost such element."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for raw in batch.column("html").to_pylist():
                page = Page(_page(raw))
                found, pieces = page.candidates(), page.main_pieces()
                near, up = _under(page, found)
                rows.append(([h for _, h, _ in found], [k for _, _, k in found], up, [near[i] for i, _, _ in pieces],
                             [b for _, b, _ in pieces], [html.unescape(t) for _, _, t in pieces]))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            made = [pa.array([r[c] for r in rows], pa.list_(kind)) for c, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names)
        return each

    kept = ["_at", "page_no", "host", "page_id", "url"]
    names = [*kept, "hashes", "kinds", "up", "under", "blocks", "texts"]
    schema = _PARTS.format(id=pages.schema["page_id"].dataType.simpleString())
    return map_slices(pages.select(*kept, "html"), "html", schema, make)


def template_subtrees(parts: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash) from (page_no, host, hashes, kinds): what min_pages different pages of a host have, and a share of them: LEAST_SHARE
    or more if it is no prose and known with its texts, else more than PROSE_SHARE."""
    rows = parts.select("page_no", "host", F.inline_outer(F.arrays_zip("hashes", "kinds"))).select(
        "page_no", "host", F.col("hashes").alias("hash"), F.col("kinds").alias("kind"))
    totals = parts.groupBy("host").agg(F.count_distinct("page_no").alias("pages"))
    often = rows.where("hash is not null").groupBy("host", "hash").agg(
        F.count_distinct("page_no").alias("n"), F.max("kind").alias("kind")).where(F.col("n") >= min_pages)
    # Both sides are a row per host and subtree; a host may own most of them: a merge join, which Spark splits.
    return often.join(totals.hint("merge"), "host").where(F.when(F.col("kind") == EXACT, F.col("n") >= LEAST_SHARE * F.col("pages")).otherwise(
        F.col("n") > PROSE_SHARE * F.col("pages"))).select("host", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text): the main text of every page, empty if there is none.

    Element subtrees are hashed, their pages counted per host, and those on min_pages pages or more are
    deleted if they are on a share of the host's pages too, see template_subtrees. Null html is an empty page, pages without a url share one host. Copies of a page on its host
    count as one page, so that what is copied is not taken for template; all rows come back, repeated ones too. An empty
    table gives an empty result; other columns are not looked at. Each page is parsed once and its pieces stay where they are written: only hashes are
    shuffled, and what of them is template comes back to a block of rows.
    """
    numbered = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    numbered = numbered.withColumn("host", _host()).withColumn("page_no", F.xxhash64("host", "html")).withColumn("_at", F.monotonically_increasing_id())
    block = F.shiftright("_at", BLOCK_BITS).alias("_block")
    parts = stage_clustered(_parsed(numbered).withColumn("_block", block), ["_block"], sent=False)
    template = stage(template_subtrees(parts, min_pages))
    # A subtree of a large host is on very many pages: a plain merge join, whose large keys Spark splits.
    hits = (parts.select("_at", "host", F.explode("hashes").alias("hash")).join(template.hint("merge"), ["host", "hash"])
            .groupBy("_at").agg(F.collect_set("hash").alias("gone")))
    packed = hits.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("_at", "gone"))).alias("_gone"))
    met = parts.join(packed.hint("shuffle_hash"), "_block", "left").select(
        "page_id", "url", "hashes", "up", "under", "blocks", "texts", F.try_element_at("_gone", F.col("_at")).alias("gone"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = []
                for row in some.select(["hashes", "up", "under", "blocks", "texts", "gone"]).to_pylist():
                    gone = _gone(row["hashes"], row["up"], set(row["gone"] or ()))
                    texts.append(_joined([(b, t) for k, b, t in zip(row["under"], row["blocks"], row["texts"]) if k < 0 or not gone[k]]))
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return met.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
