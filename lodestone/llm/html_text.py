"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: its structural tags, each named by the structural tags around it, and its blocks of text, each with the
block tag and the structural tags around it. Tokens of a host's pages that share one occurrence vector (the counts in page 1, page 2, ...)
form an equivalence class. A class of CLASS tokens or more that come once in each page that has them, and that hang together (all of them
in one part of another such class), is a frame; a host may have several, as pages follow several templates, and they nest. What stands in
a part of a frame is a slot. From the page down, the way leads to the slot that holds most of the text around it that varies from page to
page, and at least twice that of each slot beside it; where none does, a slot that is an article by its tag is taken if it is no small
one. The way ends in a slot with texts of its own, and tags choose among the slots on it. A page's text is that of its first slot, without
the texts that the template repeats in it. Names of tags and classes also decide on parts inside a slot of whose text the template says
nothing: adverts, comments, notices.
Vectors are compared by a sum of page-wise random numbers times counts, so no task holds a host's pages.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# fixed values: HTML element names by role
STRUCTURE = frozenset("html body div section article main nav header footer aside ul ol table form dl figure".split())
BLOCKS = STRUCTURE | frozenset("address blockquote caption center dd details dialog dt fieldset figcaption h1 h2 h3 h4 h5 h6 hr legend li p pre summary tbody td tfoot th thead title tr".split())
DROPPED = frozenset("nav footer aside form head".split())
RAW = "script|style|noscript|template|iframe|object|svg|math|select|textarea|button|video|audio|canvas|head"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: parts of class, id and role names of what is no article
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Characters of all templates up to which they are sent to every task; beyond it, tasks that share a host's pages.
BROADCAST, SALTS = 16_000_000, 64
NAMES_OF_TOKENS = ("key", "parent", "tag", "n", "place", "held", "kind")
#: A token is looked at if this share of a host's pages has it; pages of rarer templates are read by the names of their parts alone.
SUPPORT = 0.02
#: Tokens of a class that is a frame, at least; share of its pages' text with which a slot counts in spite of noisy names around it, at
#: least; the same for an article or main part, and its share of the text of the slot around it, at least.
CLASS, MOST, TOLD = 3, 0.8, 0.3
#: Share of the varying text of the slot around it that a slot on the way holds, at least, and how many times that of a slot beside it;
#: share of text outside all inner slots from which on a slot is no mere layout.
HALF, TWICE, OWN = 0.5, 2, 0.05
#: fixed values: tags that lay out a page, and those of them that are never an article
LAYOUT = frozenset("html body div section article main".split())
WHOLE = frozenset("page html body".split())
#: A text is the template's if so many pages have it, at least (fewer may be copies of one article), and this share of those with its place.
TEXT_PAGES, TEXT_SHARE = 3, 0.5


def names_of(attrs: str | None) -> list[str]:
    return sorted({w for g in NAMES.findall(attrs) for w in "".join(g).lower().split()}) if attrs else []


def named(name: str, attrs: str | None) -> str:
    return name + "".join("." + re.sub(r"\d+", "0", w) for w in names_of(attrs))


def key_of(*parts: str) -> str:
    return hashlib.blake2b("\t".join(parts).encode("utf-8", "replace"), digest_size=8).hexdigest()


class Part(NamedTuple):
    """A structural tag on the way to a place: its tag, its key (of its name and all around it), and whether its own name is noise."""

    tag: str
    key: str
    noise: bool


ROOT = Part("page", "page", False)


def walk(page: str) -> Iterator[tuple[tuple[Part, ...], str | None, bool, str]]:
    """(parts around it, text, in a link, block tag) of each block of text, and (parts, None, ...) at each structural tag, in page order.

    A block's text has its character references decoded and its white space turned into one blank. Unclosed tags end with what holds them.
    """
    stack: tuple[Part, ...] = (ROOT,)
    parts: list[str] = []
    linked, links, holder = 0, 0, ""
    end = page.rfind(">") + 1
    tail = page[end:]
    cut_off = tail.find("<") if re.match(r"[^<]*<[a-zA-Z/!?]", tail) else -1  # a tag that the page's end cuts off
    page = page[: end + cut_off] if cut_off >= 0 else page

    def block():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        found = (stack, text, linked * 2 > len(text), holder)
        parts, linked = [], 0
        return found if text else None

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            text = html_lib.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) * (links > 0)
            continue
        name = (m["name"] or "").lower()
        if name == "a":
            links = max(0, links - 1) if m["close"] else 1
        elif name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            continue
        if (found := block()) is not None:
            yield found
        if name not in STRUCTURE:
            holder = "" if m["close"] else named(name, m["attrs"])
            continue
        holder = ""
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if at:
                stack = stack[:at]
        else:
            names = names_of(m["attrs"])
            inside = any(x.tag in ("article", "main") for x in stack)
            noise = name in DROPPED or (name == "header" and not inside) or any(p in NOISE for w in names for p in re.split(r"[^a-z]+", w))
            if name in ("body", "html", "article", "main"):
                noise = False
            stack = (*stack, Part(name, key_of(stack[-1].key, named(name, m["attrs"])), noise))
            yield (stack, None, False, "")
    if (found := block()) is not None:
        yield found


def noisy(parts: tuple[Part, ...], above: int = 0) -> bool:
    """Whether a part beyond the first ``above`` ones is noise by its name."""
    return any(part.noise for part in parts[above:])


def tokens(page: str) -> list[tuple[str, str, str, int, int, int, int]]:
    """(key, key of the part around it, tag, count, first place, thousandths of the page's unlinked text in it, kind) of a page's
    tokens, the page first. Texts have no tag. Kind is 0 for what can be no slot, 1 for what is in a part that is noise by name, 2 for all
    others; what a part of kind 2 holds is its text of kind 2."""
    found: dict[str, list] = {"page": ["", "page", 1, 0, 0, 2]}
    total = 0
    for parts, text, link, holder in walk(page):
        noise = noisy(parts)
        kind = 0 if any(x.tag in DROPPED for x in parts) else 1 if noise else 2
        if text is None:
            found.setdefault(parts[-1].key, [parts[-2].key, parts[-1].tag, 0, len(found), 0, kind])[2] += 1
            continue
        token = found.setdefault(key_of(parts[-1].key, holder, text), [parts[-1].key, "", 0, len(found), 0, kind])
        token[2] += 1
        if not link:
            total += len(text)
            token[4] += len(text)
            for part in parts:
                if not noise or found[part.key][5] < 2:
                    found[part.key][4] += len(text)
    total = max(1, total)
    return [(k, parent, tag, n, place, held * 1000 // total, kind) for k, (parent, tag, n, place, held, kind) in found.items()]


def deduce(found: list[dict]) -> dict:
    """A host's template from its tokens' statistics: the keys of the articles' slots, the best first, and those of the covered texts."""
    tokens_ = {t["key"]: t for t in found}
    by_vector: dict[int, list[dict]] = {}
    for t in found:
        by_vector.setdefault(t["vector"], []).append(t)

    def around(key: str) -> list[str]:
        out = []
        while key := tokens_[key]["parent"]:
            out.append(key)
        return out

    frame: set[str] = set()
    for members in by_vector.values():
        keys = {t["key"] for t in members}
        if len(keys) < CLASS or any(t["n"] != t["pages"] for t in members):
            continue
        holders = {next((k for k in around(t["key"]) if k not in keys), "") for t in members}
        if len(holders) == 1:
            frame |= keys
    texts = [t for t in found if not t["tag"] and t["pages"] >= TEXT_PAGES and t["pages"] >= TEXT_SHARE * tokens_[t["parent"]]["pages"]]
    varying = {t["key"]: t["held"] for t in found}
    for t in texts:
        for key in around(t["key"]):
            if t["kind"] == 2 or tokens_[key]["kind"] < 2:
                varying[key] -= t["held"]
    if varying["page"] <= 0 and tokens_["page"]["held"]:  # copies of one page
        varying = {t["key"]: t["held"] for t in found}
    share = lambda key: varying[key] / tokens_[key]["pages"]
    inner: dict[str, list[str]] = {}
    for t in found:
        if t["tag"] and t["key"] in frame and t["key"] != "page":
            inner.setdefault(next((k for k in around(t["key"]) if k in frame), "page"), []).append(t["key"])

    def told(key: str) -> bool:
        return tokens_[key]["tag"] in ("article", "main")

    meet = lambda a, b, of: tokens_[a]["pages"] + tokens_[b]["pages"] > tokens_[of]["pages"]
    clear = [k for k in frame if told(k) and tokens_[k]["kind"] == 2 and varying[k]]

    def beside(key: str) -> list[str]:
        """The slots next below ``key`` that may hold the article. Names hide those that hold too little, and what is untagged beside an
        article or main part that they do not hide."""
        out = []
        for k in inner.get(key, []):
            held = tokens_[k]["held"] / 1000 / tokens_[k]["pages"] + 0.01  # thousandths are rounded down
            if tokens_[k]["kind"] == 2 and not varying[k]:  # all that it holds is noise by name
                out += beside(k)
            elif tokens_[k]["kind"] == 2 or tokens_[k]["kind"] == 1 and (tokens_[key]["kind"] == 1 or held >= (TOLD if told(k) else MOST) and (told(k) or not any(meet(k, x, "page") for x in clear))):
                out.append(k)
            else:
                out += [x for x in beside(k) if told(x) and tokens_[x]["held"] >= TOLD * 1000 * tokens_[x]["pages"]]
        return [k for k in out if tokens_[k]["tag"] in LAYOUT and tokens_[k]["kind"]]

    def below(key: str) -> list[str]:
        """The next slots on the way: those of different templates are on different pages."""
        near = beside(key)
        if tokens_[key]["tag"] not in WHOLE and varying[key] - sum(varying[k] for k in inner.get(key, [])) > OWN * varying[key]:
            near = [k for k in near if told(k)]
        met = lambda a, b: meet(a, b, key)
        best = [k for k in near if share(k) >= HALF * share(key) and share(k) and all(share(k) >= TWICE * share(x) for x in near if x != k and met(k, x))]
        tagged = [k for k in near if told(k) and k not in best and share(k) >= TOLD * share(key) and share(k) and not any(met(k, x) for x in best)]
        order = sorted(tagged, key=lambda k: (tokens_[k]["tag"] != "article", -share(k), k))
        return best + [k for i, k in enumerate(order) if not any(met(k, x) for x in order[:i])]

    slots, open_ = [], [("page",)]
    while open_:
        way = open_.pop()
        if further := below(way[-1]):
            open_ += [(*way, k) for k in further]
        elif len(way) > 1:
            slots.append(next((k for tag in ("article", "main") for k in way if tokens_[k]["tag"] == tag), way[-1]))
    order = sorted(set(slots) - {"page"}, key=lambda k: (tokens_[k]["tag"] != "article", tokens_[k]["tag"] != "main", -len(around(k)), -share(k), k))
    return {"slots": [k for k in order if tokens_[k]["tag"] not in WHOLE], "covered": sorted(t["key"] for t in texts)}


def extract(page: str, template: dict) -> str:
    """The text blocks of the page's best slot, one a line; of all that names do not drop where it has none of the template's slots.

    Names do not drop what holds the slot. A page without a slot keeps its own article or main part in spite of names, if these drop more
    than they leave. Texts that the template covers are left out, unless nothing else is there: then most pages of the host are copies of
    one another.
    """
    blocks, there = [], set()
    for parts, text, _, holder in walk(page):
        if text is None:
            there.add(parts[-1].key)
        else:
            blocks.append((parts, text, holder))
    slot = next((k for k in template["slots"] if k in there), None)
    if slot is not None:
        found = [(x, at) for x in blocks if (at := next((i for i, part in enumerate(x[0]) if part.key == slot), None)) is not None]
        found = [x for x, at in found if not noisy(x[0], at + 1)]
    else:
        own = [(x, next((i for i, part in enumerate(x[0]) if part.tag in ("article", "main")), None)) for x in blocks]
        rest = [x for x in blocks if not noisy(x[0])]
        whole = [x for x, at in own if not noisy(x[0], 0 if at is None else at + 1)]
        size = lambda found: sum(len(x[1]) for x in found)
        found = whole if size(whole) > 2 * size(rest) else rest
    covered = set(template["covered"])
    return "\n".join([text for parts, text, holder in found if key_of(parts[-1].key, holder, text) not in covered] or [x[1] for x in found])


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, random number of the page and statistics of every token of every page."""
    import pandas as pd

    def run(batches):
        for texts in batches:
            yield pd.Series([[dict(zip(NAMES_OF_TOKENS, t, strict=True)) for t in tokens(x)] for x in texts])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    found = F.pandas_udf(run, "array<struct<key string, parent string, tag string, n long, place long, held long, kind long>>")
    return pages.select("host", F.xxhash64(F.lit("page"), F.col("page_id"), F.length("html")).alias("random"), F.explode(found("html")).alias("t")).select("host", "random", "t.*")


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON): one row a host."""
    import pandas as pd

    small = F.shiftrightunsigned("random", 24)  # 40 bits, so that sums stay exact in 38 digits
    stats = cut(
        page_tokens(pages)
        .groupBy("host", "key")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum((small * F.col("n")).cast("decimal(38,0)")).alias("vector"),
            F.sum("n").alias("n"),
            F.sum("held").alias("held"),
            F.min("parent").alias("parent"),
            F.min("tag").alias("tag"),
            F.min("kind").alias("kind"),
        )
    )
    size = stats.where("key = 'page'").select("host", F.col("pages").alias("size"))
    common = stats.join(size, "host").where((F.col("pages") >= SUPPORT * F.col("size")) & ((F.col("tag") != "") | (F.col("pages") >= TEXT_PAGES)))  # no more of these than 1 / SUPPORT pages' tokens
    listed = common.groupBy("host").agg(F.collect_list(F.struct("key", "parent", "tag", "pages", "n", "held", "kind", F.xxhash64("vector").alias("vector"))).alias("found"))

    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(deduce(list(x))) for x in lists])

    run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return listed.select("host", F.pandas_udf(run, "string")("found").alias("template"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null html counts as empty and gives an empty text; rows without a readable host in ``url`` form one host. A page that has none of its
    host's article slots gives all text outside menus and the like. Texts of the template are left out. Very long and deep pages are read
    whole. Repeated rows give equal rows; an empty table gives an empty result; other columns are not read.
    """
    import pandas as pd

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))

    def run(texts: pd.Series, known: pd.Series) -> pd.Series:
        read = {t: json.loads(t) for t in known.unique()}
        return pd.Series([extract(x, read[t]) for x, t in zip(texts, known, strict=True)])

    run.__annotations__ = {"texts": pd.Series, "known": pd.Series, "return": pd.Series}
    known = cut(templates(base))
    size = known.agg(F.coalesce(F.sum(F.length("template")), F.lit(0))).first()[0]
    if size <= BROADCAST:
        with_template = base.join(F.broadcast(known), "host")
    else:  # a host's pages go to many tasks
        place = F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int")
        with_template = base.withColumn("salt", place).join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"])
    out = with_template.select("page_id", "url", F.pandas_udf(run, "string")("html", "template").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
