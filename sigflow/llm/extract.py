"""Main text of web pages: a template per host from classes of tokens with equal occurrence vectors, and its slots."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import cut, internal, split_by

PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
UNENDED = re.compile(r"<[!?].*", re.S)
NAME = re.compile(r"</?([A-Za-z][\w:-]*)")
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Element names of HTML by role, and words of class names that mark page furniture.
ENDS_ITSELF = frozenset("p li td th tr dt dd option".split())
ENDS_P = frozenset("div ul ol section table article footer blockquote nav aside form".split())
SCOPE = frozenset("ul ol table article section div dl".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav menu footer aside form head button select dialog".split())
FURNITURE_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice comment comments disqus reply replies newsletter subscribe share sharing social related popup modal widget toolbar pagination login search".split())
LAYOUT_WORDS = frozenset("area bar block bottom box center column container content footer form group header inner item items left link links list main outer panel right row section slot space top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())


def _furniture(name: str, tag: str, in_article: bool) -> int:
    """0: content; 1: page furniture by a class name or id; 2: by its element or role; 3: a form.

    A class name counts if all its words do, with words of layout beside them: "login-box" does, "login-howto" does not.
    """
    if name in FURNITURE or (name == "header" and not in_article):
        return 3 if name == "form" else 2
    marked = 0
    for key, *values in ATTR.findall(tag):
        names = "".join(values).lower().split()
        if key.lower() == "role":
            if ROLES.intersection(names):
                return 2
        elif any(FURNITURE_WORDS.intersection(w) and not w - FURNITURE_WORDS - LAYOUT_WORDS for w in (set(re.split(r"[_-]+", x)) for x in names)):
            marked = int(name not in ("body", "html", "article", "main"))
    return marked


def blocks(page: str) -> list[tuple[int, bool, int, str | None]]:
    """(path, in the article, page furniture, text) of each block element's start and end (text None) and text block in
    page order. Work and memory grow with the page alone, however deep its elements nest.

    A token's path is a hash over its block elements with their class names, so the same tag in two places has two
    roles; the end of an element has a path of its own. Names are hashed after a space, which no text starts with.
    Furniture is as _furniture() says; an article within a form is content.
    """
    out: list[tuple[int, bool, int, str | None]] = []
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # name, path, article, furniture
    opened: dict[str, list[int]] = {}  # places in the stack by name, of block elements, and of those that hold others' ends
    solid: list[int] = []
    scopes: list[int] = []
    text: list[str] = []
    at, last = 0, page.rfind(">")

    def close() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            out.append((*stack[-1][1:], line))
        text.clear()

    def pop() -> None:
        name, path, inside, aside = stack.pop()
        opened[name].pop()
        if name in BLOCK:
            solid.pop()
            if name in SCOPE:
                scopes.pop()
            out.append((token(path, " /"), inside, aside, None))

    def top(places: list[int] | None) -> int:
        return places[-1] if places else 0

    while at < len(page):
        m = (PIECE if at <= last else UNENDED).search(page, at)
        text.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at, tag = m.end(), m[0]
        got = NAME.match(tag)
        if got is None:
            continue
        name = got[1].lower()
        if tag[1] == "/":
            if name in BLOCK:
                close()
            place = top(opened.get(name))
            if place and (name in BLOCK or top(solid) < place):
                while len(stack) > place:
                    pop()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            text.append(" ")
        if name in VOID and name != "hr":
            continue
        if name in BLOCK:
            close()
            while name in ENDS_ITSELF and top(opened.get(name)) > top(scopes):
                for _ in range(len(stack) - opened[name][-1]):
                    pop()
            if name in ENDS_P or name.startswith("h") and name[1:].isdigit():
                while opened.get("p") and top(opened["p"]) == top(solid):
                    for _ in range(len(stack) - opened["p"][-1]):
                        pop()
            _, path, inside, aside = stack[-1]
            kind = "." + ".".join(sorted("".join(v) for k, *v in ATTR.findall(tag) if k.lower() == "class")) if "class" in tag else ""
            path = token(path, f" {name}{kind}")
            aside = max(0 if aside == 3 and name in ("article", "main") else aside, _furniture(name, tag, inside))
            inside = inside or name in ("article", "main")
            out.append((path, inside, aside, None))
            if name == "hr":
                continue
            solid.append(len(stack))
            if name in SCOPE:
                scopes.append(len(stack))
        else:
            _, path, inside, aside = stack[-1]
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, path, inside, aside))
    close()
    while len(stack) > 1:
        pop()
    return out


def token(path: int, text: str | None = None) -> int:
    return path if text is None else xxhash.xxh3_64_intdigest(f"{path}\0{text}") >> 1


def _tokens():
    """Partial sums per host and token: pages, a fingerprint of the occurrence vector, summed place in the page, words (0 for
    an element), and whether it is a text of the article.

    The fingerprint adds a hash of (page, occurrences) over the pages, so equal vectors have equal fingerprints
    however the pages are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def table() -> pa.RecordBatch:
            cols = list(zip(*((h, t, *v) for (h, t), v in held.items()))) or [()] * 7
            held.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "token", "pages", "vector", "place", "words", "inner"])

        for batch in batches:
            for host, page_key, page in zip(*(batch.column(k) for k in range(3))):
                host, page_key, found = host.as_py(), page_key.as_py(), blocks(page.as_py() or "")
                counts: dict[int, list] = {}
                for at, (path, article, _, text) in enumerate(found):
                    t = token(path, text)
                    if t in counts:
                        counts[t][0] += 1
                    else:
                        counts[t] = [1, at / len(found), len(text.split()) if text is not None else 0, article and text is not None]
                for t, (n, at, size, inner) in counts.items():
                    add = xxhash.xxh3_64_intdigest(f"{page_key}:{n}") % 2**40
                    old = held.get((host, t))
                    held[host, t] = [1, add, at, size, inner] if old is None else [old[0] + 1, (old[1] + add) % 2**40, old[2] + at, size, inner]
                if len(held) > 50_000:
                    yield table()
        yield table()

    return run


def evidence(html: Column) -> Column:
    """What tells pages apart: the article (or main) element with its content if there is one, else the page."""
    whole = F.regexp_extract(html, r"(?is)<(?:article|main)\b.*</(?:article|main)\s*>", 0)
    open_ = F.regexp_extract(html, r"(?is)<(?:article|main)\b.*", 0)
    return F.xxhash64(F.when(whole != "", whole).when(open_ != "", open_).otherwise(html))


def templates(pages: DataFrame, least_pages: int = 3, support: float = 0.5, least_tokens: int = 2, least_inside: int = 10, frame_support: float = 0.05) -> DataFrame:
    """host, template: the equivalence classes of each host's tokens, larger ones first. pages has host and html.

    Tokens (starts and ends of block elements by their path, texts of blocks by path and text) of a host that occur
    equally often on each of its pages are a class. A class is valid if it stands on least_pages different pages and on
    the share `support` of the host's (`frame_support` for its elements, which part slots but remove no text) and has
    least_tokens elements and words. Texts in articles count from least_inside pages on, and
    only in a class with an element (those that repeat by themselves are data). Tokens of a class stand in the order of their mean places.

    Pages with equal articles (see evidence()) are one page, that of the least hash, so copies of an article in other
    surroundings do not make it a template. Hosts without a valid class, and empty tables, have no row.
    """
    pages = pages.select("host", evidence(F.col("html")).alias("page_key"), F.xxhash64("html").alias("own"), "html")
    copies = cut(pages.groupBy("host", "page_key").agg(F.count(F.lit(1)).alias("rows"), F.min("own").alias("least")))
    # only pages with copies are moved to drop these
    several, single = split_by(pages, "page_key", copies.where("rows > 1"), "page_key")
    one = copies.select(F.col("host").alias("h"), F.col("page_key").alias("k"), "least")
    first = several.join(one, F.col("host").eqNullSafe(F.col("h")) & F.col("page_key").eqNullSafe(F.col("k")) & F.col("own").eqNullSafe(F.col("least"))).dropDuplicates(["host", "page_key"])
    used = single.select("host", "page_key", "html").unionByName(first.select("host", "page_key", "html"))
    sums = used.mapInArrow(_tokens(), "host string, token long, pages long, vector long, place double, words long, inner boolean")
    sums = sums.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.pmod(F.sum("vector"), F.lit(1 << 40)).alias("vector"), F.sum("place").alias("place"), F.max("words").alias("words"), F.max("inner").alias("inner"))
    sums = sums.where((F.col("pages") >= least_pages) & (~F.col("inner") | (F.col("pages") >= least_inside)))
    sizes = copies.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    found = sums.join(sizes, "host").where(F.col("pages") >= F.when(F.col("words") == 0, F.lit(frame_support)).otherwise(F.lit(support)) * F.col("all"))
    # places in steps, so that the order does not hang on how the sums were added up
    place = F.round(F.col("place") / F.col("pages"), 6)
    classes = found.groupBy("host", "vector", "pages").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "token"))).alias("frame"), F.sum(F.greatest("words", F.lit(1))).alias("words"), F.min("words").alias("least"), F.max("inner").alias("inner"))
    classes = classes.where((F.col("words") >= least_tokens) & ((F.col("least") == 0) | ~F.col("inner")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.size("frame")).alias("size"), "vector", "pages", F.col("frame.token").alias("tokens"))))
    return classes.groupBy("host").agg(ordered["tokens"].alias("template"))


def _part(slot: list[int], run: list[int], fresh: int) -> int:
    """The gaps between the events of a run become slots, within the slot that the run stands in."""
    for a, b in zip(run[:-1], run[1:]):
        if b > a + 1:
            outer = slot[a]
            for k in range(a + 1, b):
                if slot[k] == outer:
                    slot[k] = fresh
            fresh += 1
    return fresh


def slots(events: list[int], template: list[list[int]], own: list[int] | None = None) -> tuple[list[int], set[int]]:
    """The slot of each event of a page, and the events that are template.

    Classes come larger ones first. A class holds on a page if its tokens stand there in its order, whole runs of them
    one after the other, and if each run lies within one slot of the classes before: it nests there, and the gaps
    between its tokens become slots of their own. Tokens of classes that do not hold are data. Last, the events `own`
    (elements that a page has once) part the slots they stand in.
    """
    slot, fixed, fresh = [0] * len(events), set(), 1
    where: dict[int, list[int]] = {}
    for k, t in enumerate(events):
        where.setdefault(t, []).append(k)
    for tokens in template:
        times = {len(where.get(t, ())) for t in tokens}
        if len(times) != 1 or times == {0}:
            continue
        order = sorted(range(len(tokens)), key=lambda j: where[tokens[j]][0])
        runs = list(zip(*(where[tokens[j]] for j in order)))
        flat = [k for run in runs for k in run]
        if flat != sorted(flat) or any(len({slot[k] for k in run}) > 1 for run in runs):
            continue
        for run in runs:
            fresh = _part(slot, run, fresh)
        fixed.update(flat)
    inside: dict[int, list[int]] = {}
    for k in own or ():
        if k not in fixed and len(where[events[k]]) == 1:
            inside.setdefault(slot[k], []).append(k)
    for run in inside.values():
        fresh = _part(slot, run, fresh)
    return slot, fixed


def main_text(page: str, template: list[list[int]] | None, share: float = 0.25) -> str:
    """The data of a page's content slots, each slot whole but for page furniture by element or role.

    The template parts the page into slots, and elements that the page has once part them further; a page of a host
    without a template (None) has these alone, and an empty template leaves one slot, the page. Of the slots with text

    - those with most of their words in an article or main element are preferred, if they hold `share` of the words
      of the largest slot;
    - those whose words all have a class name or id of page furniture give way to others; alone, they are the text.
    """
    found = blocks(page)
    own = None if template is not None and not template else [k for k, f in enumerate(found) if f[3] is None]
    slot, fixed = slots([token(path, text) for path, _, _, text in found], template or [], own)
    data = [k for k, (_, _, aside, text) in enumerate(found) if text is not None and aside < 2 and k not in fixed]
    words: dict[int, list[int]] = {}  # of each slot: all, those in an article, those without a mark
    for k in data:
        n, of = len(found[k][3].split()), words.setdefault(slot[k], [0, 0, 0])
        of[0] += n
        of[1] += n * found[k][1]
        of[2] += n * (found[k][2] == 0)
    chosen = set(words)
    inner = {x for x in chosen if 2 * words[x][1] > words[x][0]}
    if inner and sum(words[x][0] for x in inner) >= share * max(w[0] for w in words.values()):
        chosen = inner
    chosen = {x for x in chosen if words[x][2]} or chosen
    return "\n\n".join(found[k][3] for k in data if slot[k] in chosen)


def _extract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 2
            texts = [main_text(page.as_py() or "", template.as_py()) for page, template in zip(batch.column(k), batch.column(k + 1))]
            yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(k)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return run


def extract(pages: DataFrame, html: str = "html", url: str = "url", least_pages: int = 3, support: float = 0.5, most_tokens: int = 1_000_000) -> DataFrame:
    """pages without html, with text (the main text) and n_chars (its code points).

    Each host's pages give a template: equivalence classes of tokens, ordered and nested (see templates() and slots()).
    What stands in its content slots is the text (see main_text()); the pages of a host with too few pages for one
    have the slots that their own single elements make. Character references are decoded, white space in a block becomes one space, blocks are joined by
    two line ends in page order. Null html and pages without text give ''. Pages without a host form one group.
    Repeated rows are treated alike. An empty table gives an empty table; columns named text or n_chars are replaced.

    Templates are broadcast only while they hold most_tokens tokens or fewer (8 bytes each), else joined.
    """
    pages = pages.drop("text", "n_chars")
    host, page, template = (internal(pages, x) for x in ("_host", "_page", "_template"))
    keep = [c for c in pages.columns if c != html]
    at = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    own = pages.select(at.alias("host"), F.col(html).alias("html"))
    found = cut(templates(own, least_pages, support).select(F.col("host").alias(host), F.col("template").alias(template)))
    small = (found.agg(F.sum(F.size(F.flatten(template)))).first()[0] or 0) <= most_tokens
    rows = pages.select(*keep, at.alias(page), html)
    joined = rows.join(F.broadcast(found) if small else found, F.col(page) == F.col(host), "left").select(*keep, html, template)
    fields = ", ".join(f"`{pages.schema[c].name}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(_extract([*keep, "text", "n_chars"]), f"{fields}, text string, n_chars long")
