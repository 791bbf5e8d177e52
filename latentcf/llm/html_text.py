"""Main text of web pages by equivalence-class template deduction (operator 5).

Pages of a host come from a few templates. Every page is cut into tokens: its
block elements (by their path) and the texts of its blocks (by path and text).
A token's occurrence vector, how often it occurs on each page of the host, is
summed up by order-free hashes, so that tokens with equal vectors meet without
any list of pages. Tokens that share a vector form an equivalence class; a
class is valid if it is frequent (LEAST_PAGES pages, LEAST_SHARE of the host)
and has at least two tokens. Classes nest by the paths of their tokens: a path
whose block texts belong to valid classes on nearly all of its occurrences is
part of the template, one whose texts vary is a slot.

The slots are extracted: those under <article> or <main> if there are any,
else those of the block container that holds most of the remaining text.
Elements whose tag or name says that they are menus, headers, footers, notices,
adverts, forms, comments and the like are left out on every host. Names that
are sure (a class "comments", "ad", "newsletter"; not "has-comments") count
whatever the element holds, an <article> of comments included; the others do not
count on html, body, main and article, around <main> or the page's largest
<article>, or on what holds over half of the page's prose. An <article> inside
one that has prose of its own is a reader's. Of a <header> in the article its
headings are kept. Buttons and lists of choices in a line of text belong to it.
Paragraphs and headings directly in an article are always a slot, however often a text is
repeated, and where the template would leave nothing of an article, it is not
applied: copied articles are not boilerplate.

Nothing is gathered by host: vectors are aggregated by (host, token), the
template of a host holds paths in at least LEAST_SHARE of its pages (so their
number is bounded by the elements of a page over that share), and pages meet
their host's template in a join that Spark splits where a host is hot.

Defined cases: a null html gives an empty text; a null or odd url belongs to
the host ""; markup cut off at the end of a page is dropped, unclosed elements
end with their parent; repeated rows and rows sharing a page_id each give
their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import settle, table

LEAST_PAGES = 10
LEAST_SHARE = 0.02
#: share of a path's block texts that must belong to valid classes
FIXED_SHARE = 0.95

# Elements by their role.
RAW = frozenset("script style noscript template textarea title iframe annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option "
                  "p pre search section select summary table tbody td tfoot th thead tr ul button label".split())  # fmt: skip
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head nav footer aside form menu dialog select button search".split())
#: within a line of text they belong to it
CONTROLS = frozenset("button select option label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr option".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table tbody thead tr td th section".split())
#: words in a class, id or role that name something beside the article
BESIDE = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
                   "consent cookie cookies disclaimer discussion disqus footer gdpr header masthead menu modal nav navbar "
                   "navigation newsletter notice notices pager pagination popup promo promoted promotion related respond "
                   "share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget alert complementary "
                   "contentinfo search".split())  # fmt: skip

#: names of these mean what they say, however much the element holds, unless the class only speaks of them
SURE = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
                 "cookie cookies disqus footer gdpr masthead nav navbar navigation newsletter popup promo promoted respond "
                 "sponsor sponsored".split())  # fmt: skip
SPEAKS_OF = frozenset("has with without no non hide show open closed free enabled disabled allow single post page content main "
                      "article entry layout category tag".split())  # fmt: skip

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                     r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


#: elements whose names say nothing of what they hold (but an article that is a comment)
WHOLE = frozenset("html body main article".split())
#: blocks of fewer characters (menu entries, captions) are no prose
PROSE = 40
#: so many named elements (articles) inside one another decide; no text is lost by deeper ones
NOTED = 64


@lru_cache(maxsize=16_384)
def _signature(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Element's part of a path, whether its names say that it lies beside the article, and whether they are sure."""
    names = " ".join((m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attributes)) if attributes else ""
    names = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names)
    each = [_WORD.findall(token) for token in names.lower().split()]
    words = [w for token in each for w in token]
    sure = tag not in ("html", "body", "main") and any(not SURE.isdisjoint(t) and SPEAKS_OF.isdisjoint(t) for t in each)
    beside = tag not in WHOLE and any(w in BESIDE for w in words)
    return (f"{tag}.{'.'.join(words[:6])}" if words else tag), beside or sure, sure


class _Block(NamedTuple):
    path: str
    text: str
    left_out: bool
    named: tuple  # numbers of the elements around it whose names say that they lie beside the article
    mains: tuple  # (number, named) of the <main> and <article> elements around it
    articles: tuple


def _kept_names(found: list[_Block], sure: set[int]) -> set[int]:
    """Named elements that are not beside the article all the same: those around <main> or the page's
    largest <article>, and those with over half of its prose (of its articles' prose, where it has any).
    Sure names are kept only around the page's only articles."""
    mains, articles = set(), Counter()
    prose, inside = Counter(), Counter()  # by whether in an article, and by element too
    free = [b for b in found if not b.left_out and not any(e in sure for e in b.named)]
    if not any(b.mains or b.articles for b in free) and any(b.mains or b.articles for b in found if not b.left_out):
        free = [b for b in found if not b.left_out and (b.mains or b.articles)]
    for b in free:
        mains.update(b.mains)
        for a in b.articles:
            articles[a] += len(b.text)
        within = bool(b.mains or b.articles)
        size = len(b.text) if len(b.text) >= PROSE else 0
        prose[within] += size
        for e in b.named:
            inside[e, within] += size
    within = bool(mains or articles)  # where there are articles, only their prose counts
    kept = {e for (e, w), n in inside.items() if w == within and 2 * n > prose[w] and e not in sure}
    largest = max(articles.items(), key=lambda x: (x[1], -x[0][0]))[0] if articles and not mains else None
    for whole in (*mains, *([largest] if largest else ())):
        kept.update(whole[1])
    return kept


def _nested(found: list[_Block]) -> set[int]:
    """Articles inside an article that has prose of its own: what readers wrote below it."""
    own = Counter()
    for b in found:
        if b.articles and not b.left_out and not b.named:
            own[b.articles[-1][0]] += len(b.text) if len(b.text) >= PROSE else 0
    return {inner[0] for b in found for outer, inner in zip(b.articles, b.articles[1:]) if own[outer[0]]}


def blocks(html: str) -> list[tuple[str, str, bool]]:
    """(path, text, beside) of every block of a page, in page order; inline elements and line
    breaks do not end a block, block elements do."""
    out: list[_Block] = []
    text: list[str] = []
    # tag, path, left out, named elements, <main> and <article> elements (number, named elements around) it is in, in a header
    stack: list[tuple[str, str, bool, tuple, tuple, tuple, bool]] = []
    open_tags: dict[str, int] = defaultdict(int)
    sure: set[int] = set()
    elements = 0

    def flush():
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            path, left_out, named, mains, articles, header = stack[-1][1:] if stack else ("", False, (), (), (), False)
            # of a header in the article its headings are kept
            left_out = left_out or (header and not ((mains or articles) and stack[-1][0] in HEADINGS))
            out.append(_Block(path, joined, left_out, named, mains, articles))
        text.clear()

    def close_to(depth):
        for e in stack[depth:]:
            open_tags[e[0]] -= 1
        del stack[depth:]

    at, n = 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        if not m:
            text.append(html[at:])
            break
        text.append(html[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m.group().startswith("<![CDATA["):
            text.append(m.group()[9:].removesuffix("]]>"))
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag == "br" or tag not in BLOCK:
            if tag in ("br", "img", "input"):
                text.append(" ")
            continue
        if tag in CONTROLS and stack and stack[-1][0] in SINGLE and stack[-1][0] != tag:  # in a line of text
            text.append(" ")
            continue
        flush()
        if closing:
            if open_tags[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close_to(depth)
            continue
        if tag in SINGLE:  # an open element of the same kind, or a paragraph, ends here
            for depth in range(len(stack) - 1, -1, -1):
                open_ = stack[depth][0]
                if open_ == tag or open_ == "p" or (open_[0] == "h" and tag[0] == "h" and len(open_) == 2):
                    close_to(depth)
                    break
                if open_ not in SINGLE:
                    break
        elif stack and stack[-1][0] == "p":
            close_to(len(stack) - 1)
        if tag in VOID:
            continue
        part, beside, certain = _signature(tag, m[3])
        above, left_out, named, mains, articles, header = stack[-1][1:] if stack else ("", False, (), (), (), False)
        elements += 1
        if beside:
            named = (*named, elements) if len(named) < NOTED else named
            if certain:
                sure.add(elements)
        if tag == "main" and len(mains) < NOTED:
            mains = (*mains, (elements, named))
        if tag == "article" and len(articles) < NOTED:
            articles = (*articles, (elements, named))
        # very deep nesting stays on one path; the elements are kept apart all the same
        stack.append((tag, f"{above}/{part}" if len(above) < 2000 else above, left_out or tag in LEFT_OUT, named, mains, articles,
                      header or tag == "header"))
        open_tags[tag] += 1
    flush()
    kept = _kept_names(out, sure) if any(b.named for b in out) else set()
    inner = _nested(out) if any(len(b.articles) > 1 for b in out) else ()
    return [(b.path, b.text, b.left_out or any(e not in kept for e in b.named) or any(a[0] in inner for a in b.articles)) for b in out]


def _is_article(path: str) -> bool:
    return bool(re.search(r"/(?:article|main)(?=[./]|$)", path))


def _plain(path: str) -> bool:
    """Ordinary content elements right inside an article."""
    return _is_article(path) and all(p in CONTENT for p in re.split(r"/(?:article|main)[^/]*", path)[-1].split("/") if p)


def main_text(html: str, fixed=frozenset(), number=None) -> str:
    """The article of a page, given the fixed paths of its host's template."""
    kept = [(p, t) for p, t, beside in blocks(html) if not beside]
    article = [(p, t) for p, t in kept if _is_article(p)]
    if article:
        kept = article
    if fixed:
        kept = [(p, t) for p, t in kept if _plain(p) or number(p) not in fixed] or kept
    if not article and kept:
        # the container with most of the text: the deepest that holds over half of it
        total, here = sum(len(t) for _, t in kept), ""
        while True:
            below = Counter()
            for p, t in kept:
                if p.startswith(f"{here}/") and (rest := p[len(here) + 1 :]):
                    below[rest.split("/", 1)[0]] += len(t)
            if not below:
                break
            part, size = below.most_common(1)[0]
            if 2 * size <= total or part in CONTENT:
                break
            here = f"{here}/{part}"
        kept = [(p, t) for p, t in kept if p == here or p.startswith(f"{here}/")]
    return "\n".join(t for _, t in kept)


def _number(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode(), 5) - (1 << 63)


def host_of(url):
    """Host of an address, "" where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _token_task(batches):
    """host, page, html -> a row per token: path number, token number, occurrences, whether a block text."""
    import pyarrow as pa

    for b in batches:
        hosts, pages, paths, tokens, counts, texts = [], [], [], [], [], []
        for host, page, html in zip(*[b.column(i).to_pylist() for i in range(3)]):
            seen: Counter = Counter()
            for path, text, _ in blocks(html):
                seen[path, text] += 1
                for i, c in enumerate(path):
                    if c == "/" and i:
                        seen[path[:i], None] += 1
                seen[path, None] += 1
            seen["", None] = 1  # the page itself
            for (path, text), n in seen.items():
                hosts.append(host)
                pages.append(page)
                paths.append(_number(path))
                tokens.append(_number(path if text is None else f"{path}\n{text}"))
                counts.append(n)
                texts.append(text is not None)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(pages, pa.int64()), pa.array(paths, pa.int64()),
                                          pa.array(tokens, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.bool_())],
                                         names=["host", "page", "path", "token", "n", "is_text"])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, fixed): a hash of the host and the numbers of the paths that are part of its template.
    ``pages`` has host, page and html."""
    tokens = pages.select("host", "page", "html").mapInArrow(
        _token_task, "host long, page long, path long, token long, n long, is_text boolean")
    vectors = settle(tokens.groupBy("host", "path", "token", "is_text")
                     .agg(F.count("*").alias("pages"), F.sum("n").alias("n"),
                          F.bit_xor(F.xxhash64("page", "n")).alias("v1"),
                          F.bit_xor(F.xxhash64("n", "page", F.lit(1))).alias("v2")), "html-vectors")
    sizes = vectors.where((F.col("path") == _number("")) & ~F.col("is_text")).select("host", F.col("pages").alias("of"))
    frequent = (vectors.join(settle(sizes, "html-hosts"), "host")
                .where((F.col("pages") >= least_pages) & (F.col("pages") >= least_share * F.col("of"))))
    frequent = settle(frequent, "html-frequent")
    classes = (frequent.groupBy("host", "v1", "v2", "pages").agg(F.count("*").alias("members"))
               .where("members >= 2").drop("members"))
    fixed_texts = (frequent.where("is_text").join(settle(classes, "html-classes"), ["host", "v1", "v2", "pages"])
                   .groupBy("host", "path").agg(F.sum("n").alias("fixed")))
    all_texts = vectors.where("is_text").groupBy("host", "path").agg(F.sum("n").alias("n"))
    paths = (all_texts.join(settle(fixed_texts, "html-fixed"), ["host", "path"])
             .where(F.col("fixed") >= FIXED_SHARE * F.col("n")))
    return settle(paths.groupBy("host").agg(F.collect_set("path").alias("fixed")), "html-templates")


def _extract_task(batches):
    import pyarrow as pa

    for b in batches:
        html, fixed = b.column(2).to_pylist(), b.column(3).to_pylist()
        found = [main_text(h, frozenset(f or ()), _number) for h, f in zip(html, fixed)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()),
                                          pa.array([len(t) for t in found], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"host": F.xxhash64(host_of(F.col("url"))),
                             "page": F.xxhash64(F.isnull("page_id"), "page_id", "url", "html")})
    known = templates(rows, least_pages, least_share)
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "fixed")
    return joined.mapInArrow(_extract_task, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
