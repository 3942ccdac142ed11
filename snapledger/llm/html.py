"""Main text of web pages by equivalence-class template deduction.

1. Tokens. A page is a sequence of tags and text runs. A tag's role is its name, its naming attributes (class, id, role)
   and the names of its open ancestors, so equal tags in different places are different tokens.
2. Classes. The occurrence vector of a token says how often it is on each page of a host. Vectors are never gathered:
   each is folded into a count of pages and two sums of page hashes times counts, which add up map-side, so a host with a
   third of all pages is no larger a group than another. Tokens of equal folded vectors form a class. A class is valid
   if it is on at least `PAGES` pages and half the host's, and every one of its tokens occurs once per occurrence of the
   class, with its opening and closing tags paired.
3. Template. Valid classes nest by their paths; the host's template is the set of their roles, each with the text runs
   that are constant (headings of menus, notices): on nearly all pages that hold their element, so pages of another
   layout and a run repeated on a page don't count against them. It is as large as the host's layouts, whatever the pages.
4. Slots. What stands between template tokens of a page is a slot, named by the innermost template container around it.
   The characters of a slot on all pages of the host, and those of them in links and in constant runs, add up in the
   same folded rows; `verdicts` then keeps or drops it: a slot of mostly links or constants goes, also inside an article;
   one that holds much of the host's varying text stays, also beside an article; where every other slot is dropped,
   the one with most of the varying text stays whatever it is named.
5. Fallback. Only where the slots leave it open (no template, or a slot of little text) the page's own tags decide:
   furniture (menu, header, footer, sidebar, form, advert, notice, comments ...) is dropped, and text outside of
   `article` or `main` where the page has text inside. Constant runs outside the article are dropped.

Block tags end a block; inline tags don't. White space inside a block becomes one space, blocks are joined by one space,
character references are decoded, and nothing else is dropped or cut.

Edge cases: null and empty html give an empty text; pages without a host form one site; unclosed and stray tags nest
as far as they go; comments, doctype, script, style and template bodies are never text; equal pages count each;
repeated rows give a row each; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import cut, slices, worker_memo

PAGES = 3
CONSTANT = 0.8  # of the pages with an element hold its constant run
RARE = 100  # an element on less than one of so many pages of a host has no constant runs
MOSTLY = 0.5  # a slot with less of its text varying and outside links is no text
MUCH = 0.25  # of a host's varying text: such a slot is text beside an article, too

# Element names of the public HTML vocabulary, by what they mean here.
BLOCK = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math textarea title xmp noembed noframes".split())
# Elements that hold a part of a page; what lies in others (paragraphs, headings, entries) belongs to the one around it.
CONTAINERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form main menu nav ol section select table td th ul".split())
FURNITURE = frozenset("nav header footer aside form button select dialog menu head".split())
ARTICLE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|"
    r"side-?bar\w*|aside|widget\w*|related|share|sharing|social|cookie\w*|consent|notice|popup|modal|overlay|newsletter|"
    r"subscri\w*|comments?|comment-?list|respond|disqus|login|signup|search|skip-?link|pagination|pager)(?=$|[-_\s])", re.I)
# Tags that end an open element of their kind when they begin.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_QUOTED = re.compile(r"""</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>""")
_NAMING = re.compile(r"\s(?:class|id|role|hidden|aria-hidden)\b", re.I)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\s(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_NUMBERS = re.compile(r"\d+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"


class Node:
    """An open element: its role, and whether it or one around it is furniture or an article."""

    __slots__ = ("article", "below", "furniture", "link", "name", "path", "role", "up")

    def __init__(self, name: str, attributes: str, up: Node | None):
        own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        self.name, self.up, self.below = name, up, {}
        self.role = name + ("" if not own else "." + _NUMBERS.sub("0", " ".join(f"{k}={own[k]}" for k in sorted(own))).replace("/", "|"))
        self.path = f"{up.path}/{self.role}" if up else ""
        self.link = name == "a" or bool(up and up.link)
        self.article = name in ARTICLE or bool(up and up.article)
        # A heading block inside an article belongs to it.
        self.furniture = bool(up and up.furniture) or (name in FURNITURE and not (name == "header" and self.article))
        if own:
            kind = own.get("role", "").lower()
            named = f"{own.get('class', '')} {own.get('id', '')}" if name not in ("body", "html", "article", "main") else ""
            self.article |= kind in ("main", "article")
            self.furniture |= kind in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or bool(NAMES.search(named))


    def child(self, name: str, token: str) -> Node:
        """The element that `token` opens here; equal ones are made once and shared by all pages of a task."""
        key = token if _NAMING.search(token) else name
        node = self.below.get(key)
        if node is None:
            if len(self.below) >= 1000:
                self.below.clear()
            node = self.below[key] = Node(name, token[len(name) + 1 : -1] if key is token else "", self)
        return node


def _end(page: str, at: int) -> int:
    """Where the markup that begins at `at` ends, or -1 if that `<` is text."""
    follows = page[at + 1 : at + 2]
    if follows == "!" or follows == "?":
        close = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
        return len(page) if close < 2 else close + 1
    if not (follows.isalpha() or follows == "/" and page[at + 2 : at + 3].isalpha()):
        return -1
    end = page.find(">", at)
    if end < 0:
        return -1
    if '"' in (token := page[at:end]) or "'" in token:
        m = _QUOTED.match(page, at)
        return m.end() if m else end + 1
    return end + 1


def parsed(page: str) -> Iterator[tuple[str, Node | None, str, bool]]:
    """(kind, element, text, block) of every token: kind is open, close or text; block: a block ends here."""
    root, open_ = _root(), []
    at, n, begin = 0, len(page), 0
    while at < n:
        tag = page.find("<", at)
        end = _end(page, tag) if tag >= 0 else n
        if end < 0:
            at = tag + 1
            continue
        stop = tag if tag >= 0 else n
        if stop > begin:
            yield "text", open_[-1] if open_ else None, page[begin:stop], False
        if tag < 0:
            return
        at = begin = end
        token = page[tag:end]
        if token[1] in "!?":
            continue
        if token[1] == "/":
            name = _NAME.match(token)[1].lower()
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].name == name:
                    node = open_[k]
                    del open_[k:]
                    yield "close", node, "", name in BLOCK
                    break
            else:
                yield "close", None, "", name in BLOCK
            continue
        name = _NAME.match(token)[1].lower()
        if open_ and (name in ENDS_P or name in CLOSES):
            ended = CLOSES.get(name, ())
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].name in ended or name in ENDS_P and open_[k].name == "p":
                    del open_[k:]
                    break
                if open_[k].name in ("ul", "ol", "dl", "table", "div", "article", "section", "td", "body"):
                    break
        node = (open_[-1] if open_ else root).child(name, token)
        yield "open", node, "", name in BLOCK
        if name in VOID or token.endswith("/>"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = begin = close.end() if close else n
            continue
        open_.append(node)
    if n > begin:
        yield "text", open_[-1] if open_ else None, page[begin:], False


def _root() -> Node:
    memo = worker_memo("html")
    if "root" not in memo:
        memo["root"] = Node("", "", None)
    return memo["root"]


def _text_role(node: Node | None, text: str) -> str:
    return f"{node.path if node else ''}#{xxhash.xxh3_64_hexdigest(text)}"


def tokens(page: str) -> dict[str, list]:
    """The tokens of a page: opening tags `+path`, closing tags `-path`, and text runs under their path.

    Each with how often it is there, the characters of its text, those of them in links, the element of a run, and
    what its tags say (1: article, 2: furniture, 3: both).
    """
    out: dict[str, list] = {}

    def entry(token: str, node: Node) -> list:
        if token not in out:
            out[token] = [0, 0, 0, "", node.article + 2 * node.furniture]
        return out[token]

    for kind, node, text, _ in parsed(page):
        if kind == "text":
            run = " ".join(text.split()) if node is not None else ""
            if not run:
                continue
            own = entry("+" + node.path, node)
            own[1] += len(run)
            own[2] += len(run) * node.link
            # Inside an article a constant run changes nothing, so it needs no vector; links are counted as such.
            if not (node.article or node.furniture and node.link):
                own = entry(_text_role(node, run), node)
                own[0] += 1
                own[1] += len(run) * (not node.link)
                own[3] = "+" + node.path
        elif node is not None:
            entry(("+" if kind == "open" else "-") + node.path, node)[0] += 1
    return out


def _hashed(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def vectors(pages: DataFrame) -> DataFrame:
    """site, token and its folded occurrence vector: pages, occurrences, most on one page, two sums of page hashes.

    Also the sums of its characters and of those in links, the token of the element that a run is in, and what tags say.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            folded: dict[tuple[str, int], list[int]] = {}
            text: dict[tuple[str, int], str] = {}
            home: dict[tuple[str, int], int] = {}
            for site, page_id, page in zip(*(c.to_pylist() for c in batch.columns)):
                if not page:
                    continue
                seed = xxhash.xxh3_64_intdigest(f"{page_id}\0{page}")
                one, two = seed & 0x7FFFFFFF, seed >> 33
                for token, (n, chars, link, around, kind) in tokens(page).items():
                    key = (site, _hashed(token))
                    if around:
                        home[key] = _hashed(around)
                    else:
                        text[key] = token
                    entry = folded.setdefault(key, [0, 0, 0, 0, 0, 0, 0, kind])
                    entry[0] += 1
                    entry[1] += n
                    entry[2] = max(entry[2], n)
                    entry[3] += one * n
                    entry[4] += two * n
                    entry[5] += chars
                    entry[6] += link
            keys = list(folded)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([text.get(k) for k in keys], pa.string())]
            columns += [pa.array([folded[k][i] for k in keys], pa.int64()) for i in range(8)] + [pa.array([home.get(k) for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["site", "token", "tag", "pages", "n", "most", "one", "two", "chars", "link", "kind", "home"])

    schema = "site string, token long, tag string, pages long, n long, most long, one long, two long, chars long, link long, kind long, home long"
    counted = pages.select("site", "page_id", "html").mapInArrow(count, schema)
    return counted.groupBy("site", "token").agg(
        F.first("tag", ignorenulls=True).alias("tag"), F.sum("pages").alias("pages"), F.sum("n").alias("n"),
        F.max("most").alias("most"), F.sum("one").alias("one"), F.sum("two").alias("two"),
        F.sum("chars").alias("chars"), F.sum("link").alias("link"), F.max("kind").alias("kind"), F.max("home").alias("home"))


def templates(pages: DataFrame) -> DataFrame:
    """Of every site with a template: site, roles (the template's opening tags), constants (hashes of its text runs) and
    parts (its slots with what their tags say, and their characters: all, in links, in constants)."""
    # A token on one page of a slice can still be on many pages; only the sums over all slices decide.
    found = cut(vectors(pages).where((F.col("pages") >= PAGES) | F.col("tag").startswith("+") & (F.col("chars") > 0)))
    sizes = pages.where(F.length("html") > 0).groupBy("site").agg(F.count("*").alias("site_pages"))
    frequent = cut(found.where(F.col("pages") >= PAGES).join(sizes, "site").where((F.col("pages") * 2 >= F.col("site_pages"))))
    vector = ["site", "pages", "n", "one", "two"]
    # Ordered tags: a class holds as many closing as opening tags unless the elements are void or never closed.
    classes = frequent.where("tag is not null").groupBy(*vector).agg(
        F.collect_set(F.when(F.col("tag").startswith("+"), F.substring(F.col("tag"), F.lit(2), F.length("tag")))).alias("opens"),
        F.max("most").alias("most"))
    # Repeated tags (list entries, paragraphs) vary between pages and carry no layout of their own.
    valid = classes.where((F.col("most") * F.col("pages") == F.col("n")) & (F.size("opens") > 0))
    roles = cut(valid.groupBy("site").agg(F.flatten(F.collect_list("opens")).alias("roles")))
    around = found.where(F.col("tag").startswith("+")).select("site", F.col("token").alias("home"), F.col("pages").alias("home_pages"))
    runs = found.where("tag is null").join(around, ["site", "home"]).join(sizes, "site")
    constant = cut(runs.where((F.col("pages") >= CONSTANT * F.col("home_pages")) & (F.col("home_pages") * RARE >= F.col("site_pages"))).select("site", "token", "home", "chars"))
    constants = constant.groupBy("site").agg(F.collect_set("token").alias("constants"))
    return roles.join(constants, "site", "full").join(_parts(found, roles, constant), "site", "left")


def _parts(found: DataFrame, roles: DataFrame, constant: DataFrame) -> DataFrame:
    """(site, parts): the slots of every template with their sums. Every text belongs to the innermost container around it."""
    name = lambda role: F.split(F.element_at(F.split(role, "/"), -1), r"\.")[0]
    holding = roles.select("site", F.filter("roles", lambda r: name(r).isin(*sorted(CONTAINERS))).alias("holding"))
    elements = found.where(F.col("tag").startswith("+")).withColumn("path", F.substring(F.col("tag"), F.lit(2), F.length("tag")))
    # Those around a path are beginnings of each other, so the innermost is the greatest.
    around = F.array_max(F.filter("holding", lambda r: (F.col("path") == r) | F.startswith(F.col("path"), F.concat(r, F.lit("/")))))
    placed = cut(elements.join(holding, "site").withColumn("slot", around).where("slot is not null").select("site", "token", "path", "slot", "chars", "link", "kind"))
    same = constant.select("site", F.col("home").alias("token"), F.col("chars").alias("same")).join(placed.select("site", "token", "slot"), ["site", "token"])
    none = F.lit(0).cast("long")
    sums = placed.select("site", "slot", F.when(F.col("path") == F.col("slot"), F.col("kind")).alias("kind"), "chars", "link", none.alias("same")).unionByName(
        same.select("site", "slot", F.lit(None).cast("long").alias("kind"), none.alias("chars"), none.alias("link"), "same"))
    summed = sums.groupBy("site", "slot").agg(F.max("kind").alias("kind"), F.sum("chars").alias("chars"), F.sum("link").alias("link"), F.sum("same").alias("same"))
    return summed.groupBy("site").agg(F.collect_list(F.struct("slot", "kind", "chars", "link", "same")).alias("parts"))


def verdicts(parts: list[tuple]) -> dict[str, bool]:
    """Which slots of a host are text and which are not, as far as their sums tell. parts: (slot, kind, chars, link, same)."""
    varying = {slot: chars - link - same for slot, _, chars, link, same in parts}
    text = {slot for slot, _, chars, _, _ in parts if chars and varying[slot] >= MOSTLY * chars}
    if not text:
        return {}
    total = sum(varying[slot] for slot in text)
    out = {slot: False for slot, _, chars, _, _ in parts if chars and slot not in text}
    # Of a slot that holds none of its own text the kind is unknown; its tags decide.
    plain = {slot for slot, kind, *_ in parts if slot in text and kind in (0, 1)}
    out |= {slot: True for slot in plain if varying[slot] >= MUCH * total}
    if not plain:
        out |= {slot: True for slot in text if varying[slot] >= MOSTLY * total}
    return out


def slots(page: str, roles: frozenset) -> Iterator[tuple[Node | None, Node | None, str, bool]]:
    """(slot, element, text, block) of a page: each text run with the innermost template container around it.

    block: a block ends here, and there is no text.
    """
    for kind, node, text, block in parsed(page):
        if kind == "text":
            slot = node
            while slot is not None and (slot.name not in CONTAINERS or slot.path not in roles):
                slot = slot.up
            yield slot, node, text, False
        elif block:
            yield None, node, "", True


def main_text(page: str, roles: frozenset, constants: frozenset, judged: dict[str, bool] | None = None) -> str:
    """The text of a page's main slots, given its site's template and what its sums say of its slots."""
    blocks: dict[bool, list[str]] = {True: [], False: []}  # inside a main slot or the article, and elsewhere outside of furniture
    runs: dict[bool, list[str]] = {True: [], False: []}

    def close() -> None:
        for inside in (True, False):
            if runs[inside]:
                block = " ".join(entities.unescape("".join(runs[inside])).split())
                if block:
                    blocks[inside].append(block)
                runs[inside].clear()

    for slot, node, text, ends in slots(page, roles):
        if ends:
            close()
            continue
        verdict = judged.get(slot.path) if judged and slot is not None else None
        if verdict is False or node is not None and node.furniture and not (verdict and slot.furniture):
            continue
        inside = node is not None and node.article
        if inside or not (constants and _hashed(_text_role(node, " ".join(text.split()))) in constants):
            runs[bool(inside or verdict)].append(text)
    close()
    return " ".join(blocks[True] or blocks[False])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    sited = pages.select("page_id", "url", "html", host(F.col("url")).alias("site"))
    template = cut(templates(sited))
    with_template = sited.join(template, "site", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, frozenset(), frozenset(), {})
        for batch in slices(batches, "html"):
            columns = {n: batch.column(n).to_pylist() for n in ("html", "site")}
            roles, constants, parts = batch.column("roles"), batch.column("constants"), batch.column("parts")
            texts = []
            for i, (page, site) in enumerate(zip(columns["html"], columns["site"])):
                if last[0] != site:
                    last = (site, frozenset(roles[i].as_py() or ()), frozenset(constants[i].as_py() or ()), verdicts([tuple(p.values()) for p in parts[i].as_py() or ()]))
                texts.append(main_text(page or "", *last[1:]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return with_template.mapInArrow(extract, "page_id long, url string, text string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# The given pages have one article each and few kinds of references; for these SQL can say what the text must be.
OP1_SQL = r"""
with inner_ as (
  select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') as x from pages
), decoded as (
  select page_id, url, replace(replace(replace(
    regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', chr(10), 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&') as x
  from inner_
), spaced as (select page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) as text from decoded)
select page_id, url, text, length(text) as n_chars from spaced
"""
