"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of the page; what markup itself marks as no article text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers) leaves no line. Each line weighs as many
characters as it has, but a line that is all links weighs nothing unless it is a paragraph; where the page has an article or main element
with text, lines outside it weigh nothing. The sums of weights over sliding windows of WINDOW lines part the page: a run of windows
with text rises from nothing and dives to nothing again, and it is kept, with the links within, if any of its windows reaches SURGE (or the page's
greatest, if none does). Short lines at its ends so stay with it.

Defined results: a null or empty page, or one without text, has the empty text. Markup that is cut off at the end is closed
there. Repeated rows are extracted each on its own. Very long pages are read whole. An empty table gives no rows. Other columns stay; existing ones
that have a result's name are replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read_table, small_batches

WINDOW, SURGE = 3, 80

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav aside footer form script style noscript template svg canvas iframe object button select textarea menu dialog title map audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input area embed source track param col link meta base".split())
#: Words of class, id or role names that mark what isn't article text, if the whole name is made of such words.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies respond share sharing social related newsletter subscribe subscription login signup search contentinfo complementary toolbar pagination".split())
#: Such words only outside an article.
OUTER_MARKS = frozenset("header top topbar".split())
NEVER_MARKED = frozenset("html body article main".split())
#: Words that may stand beside those above; any other word in a name says that it names something else.
BESIDE = frozenset("area article bar block body box btn button buttons container content form group icon icons inner item items js left link links list main outer page panel post reader readers right section site slot the top unit user widget wrap wrapper".split())


def _marked(attributes: str, inside: bool) -> bool:
    if not attributes or not attributes.strip():
        return False
    bare = re.sub(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "=", attributes)
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", bare, re.I):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in next((v for v in values if v), "").split():
                words = [w.lower().strip("0123456789") for w in re.split(r"[_\-]+|(?<=[a-z])(?=[A-Z])", token)]
                found = [w in MARKS or not inside and w in OUTER_MARKS for w in words]
                if any(found) and all(f or not w or w in BESIDE for f, w in zip(found, words)):
                    return True
        elif name.lower() == "style" and re.search(r"display\s*:\s*none", next((v for v in values if v), ""), re.I):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, inside an article) for each block of the page that has text."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[tuple[str, bool]] = []
    inside = links = 0
    skipped, depth = "", 0
    at, paragraph = 0, False

    def flush():
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = len("".join("".join(t for t, in_link in parts if in_link).split()))
                lines.append((text, 0 if linked >= len(text.replace(" ", "")) and not paragraph else len(text), inside > 0))
            parts.clear()

    while m := _TOKEN.search(page, at):
        if m.start() > at and not skipped:
            parts.append((html.unescape(page[at : m.start()]), links > 0))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            if not skipped:
                flush()
            at = end.end() if end else len(page)
            continue
        if skipped:
            if skipped in ("p", "li") and tag not in INLINE:  # closed by the next block
                skipped = ""
                if closing and tag == "p":
                    continue
            elif tag == skipped:
                depth += -1 if closing else 1
                if depth <= 0:
                    skipped = ""
                continue
            else:
                if skipped == "head" and tag == "body":
                    skipped = ""
                continue
        if tag == "br":
            parts.append((" ", links > 0))
        elif tag == "a":
            links = 0 if closing else 1
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        drop = not closing and (tag in DROPPED or tag == "header" and not inside or tag not in NEVER_MARKED and _marked(attributes, inside > 0))
        if drop:
            if tag not in INLINE:
                flush()
            if not attributes.rstrip().endswith("/"):
                skipped, depth = tag, 1
            continue
        if tag not in INLINE:
            flush()
            links, paragraph = 0, tag == "p" and not closing
        if tag in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
    if at < len(page) and not skipped:
        parts.append((html.unescape(page[at:]), links > 0))
    flush()
    return lines


def main_text(page: str | None) -> str:
    """The lines of the runs of windows that surge, joined by blank lines."""
    lines = lines_of(page) if page else []
    if not lines:
        return ""
    article = any(inside for _, _, inside in lines)
    weights = [len(t) if article and inside else 0 if article else w for t, w, inside in lines]
    blocks = [sum(weights[k : k + WINDOW]) for k in range(len(lines))] + [0]
    least = min(SURGE, max(blocks))
    kept, begin = [], 0
    for k, block in enumerate(blocks):
        if not block:
            if k > begin and max(blocks[begin:k]) >= least:
                first = next(j for j in range(begin, k) if weights[j])
                kept += [t for t, _, inside in lines[first:k] if inside or not article]
            begin = k + 1
    return "\n\n".join(kept)


def extract(pages: DataFrame, *, html_col: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages without their markup column, with the main text and its length in code points; existing columns of these names are replaced."""
    small_batches(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, text, n_chars)]
    rows = pages.select(*(F.col(f"`{c}`") for c in others), F.col(html_col).alias("__gl_html"))
    schema = rows.select(*(F.col(f"`{c}`") for c in others), F.lit("").alias(text), F.lit(0).cast("long").alias(n_chars)).schema

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*others, text, n_chars])

    return rows.mapInArrow(run, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
