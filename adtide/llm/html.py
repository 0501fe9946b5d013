"""Main text of web pages: a template per host from equivalence classes of tokens, then the slots it leaves."""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtide.llm.staging import settle, ship

#: Fixed values of HTML: elements whose content is no text, elements that start a block, elements without content.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "select", "object", "canvas", "head", "title")
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand in the path of a token.  Others (p, li, b ...) are often left open and say little about the layout.
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table figure blockquote details dialog menu fieldset td".split())
#: Parts of a page that are never its main text, by element and by words of class, id and role.
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
OUTSIDE_WORDS = re.compile(
    r"(^|[^a-z])(ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumb\w*|sidebar|side|widget|footer|foot|header|masthead|cookie\w*|consent|notice|popup|modal"
    r"|newsletter|subscribe|signup|login|share|social|related|recommend\w*|comment\w*|discussion|disqus|reply|replies|respond|search|pagination|pager|toolbar|skip|legal|copyright|complementary|contentinfo|navigation)([^a-z]|$)"
)
MAIN = frozenset(("article", "main"))
MAIN_WORDS = re.compile(r"(^|[^a-z])(article|post|entry|story|main|content)([^a-z]|$)")
#: A class of the template stands on at least this share of a host's different pages, on at least so many, and has at least so many words.
TEMPLATE_SHARE = 0.5
TEMPLATE_PAGES = 2
CLASS_WORDS = 3
#: A template text in a container that also holds texts of single pages stands on so many pages at least, which
#: have so many words of their own there for each of its words.
BESIDE_PAGES = 5
OWN_BESIDE = 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[\u3040-\u9fff\uac00-\ud7af]|[^\W\u3040-\u9fff\uac00-\ud7af]+")
_WITH = re.compile(r"\b(has|with|without|no|is)-[\w-]+")
#: Words that also inside of a main part name what is no text of it; others there may well name sections of an article.
_NOT_OF_MAIN = re.compile(
    r"(^|[^a-z])(ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumb\w*|sidebar|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|signup|login"
    r"|share|sharing|comments?|disqus|pagination|pager|toolbar)([^a-z]|$)"
)
_NO_ARTICLE = re.compile(r"(^|[^a-z])(ad|ads|advert\w*|sponsor\w*|promo\w*|comment\w*|reply|related|teaser)([^a-z]|$)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


def _mark(name: str, names: str, stack: list[str]) -> str:
    """``-`` for an element outside of the main text, ``+`` for a main one, else nothing."""
    if name in ("html", "body"):
        return ""
    names = _WITH.sub("", names)
    if name in MAIN:
        return "-" if _NO_ARTICLE.search(names) else "+"
    inside = any(s[0] == "+" for s in stack)
    if (_NOT_OF_MAIN if inside else OUTSIDE_WORDS).search(names):
        return "-"
    if name == "header" and inside:
        return ""  # it heads the article
    return "-" if name in OUTSIDE else "+" if MAIN_WORDS.search(names) else ""


def blocks(page: str) -> Iterator[tuple[str, str]]:
    """(path, text) of each block of a page in order: references decoded, white space made one space.

    The path names the containers around the block; a part that is outside by
    its element or its names starts with ``-``, one that is main with ``+``.
    """
    stack: list[str] = []
    tags: list[str] = []
    text: list[str] = []
    at, size, path, own = 0, len(page), "", ""

    def flush() -> str:
        out = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        return out

    while at < size:
        lt = page.find("<", at)
        if lt != at:
            text.append(entities.unescape(page[at : lt if lt >= 0 else size]))
            if lt < 0:
                break
        m = _TOKEN.match(page, lt)
        if not m and page[lt + 1 : lt + 3].lstrip("/")[:1].isalpha():  # a tag with a quote left open
            at = page.find(">", lt) + 1
            if not at:
                break
            continue
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[4]:
            break  # a tag cut off by the end of the page
        closing, empty = bool(m[1]), m[3].rstrip().endswith("/")
        if name in RAW:
            end = None if closing or empty else _RAW_END[name].search(page, at)
            if name == "head":
                flush()
            elif not closing and not empty and end is None:
                break  # never closed: the rest is its content
            at = end.end() if end else at
            continue
        if name in BLOCKS:
            if out := flush():
                yield path + own, out
            own = ""
        names = "" if closing else " ".join(v for a in _ATTRIBUTE.findall(m[3]) for v in a[1:] if v).lower()
        if name in CONTAINERS:
            if closing:
                if name in tags:
                    while tags.pop() != name:
                        stack.pop()
                    stack.pop()
            elif not empty:
                mark = _mark(name, names, stack)
                tags.append(name)
                stack.append(mark + name + ("." + names.replace(" ", ".") if names else ""))
            path = ">".join(stack)
        elif name in BLOCKS and names and (_NOT_OF_MAIN if any(s[0] == "+" for s in stack) else OUTSIDE_WORDS).search(_WITH.sub("", names)):
            own = f">-{name}"  # this block alone
    if out := flush():
        yield path + own, out


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _tokens(pages: DataFrame, url: str, page: str) -> DataFrame:
    """``(host, page, layout, tokens, seq)``: a row per different page with text: its tokens (a block's path and text,
    from all parts of the page) with their words and counts, and their order as places in ``tokens``; ``layout`` is a
    hash of its container paths."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("token", pa.string()), ("words", pa.int32()), ("times", pa.int64())])), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(blocks(body or ""))
                if not found:
                    continue
                place: dict[str, int] = {}
                tokens, seq = [], []
                for path, text in found:
                    token = f"{path}|{_text_token(text)}"
                    if (n := place.setdefault(token, len(tokens))) == len(tokens):
                        tokens.append({"token": token, "words": len(_WORD.findall(text)), "times": 0})
                    tokens[n]["times"] += 1
                    seq.append(n)
                # pages of one host with the same unmarked and main text are copies: they say the same once
                out.append((host, _hash("\n".join(t for p, t in found if "-" not in _marks(p))), _hash("\n".join(tokens[n]["token"] for n in seq)), _hash("\n".join(sorted({p for p, _ in found}))), tokens, seq))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "page", "copy", "layout", "tokens", "seq"])

    found = pages.select(_host(url).alias("host"), F.col(page).alias("html")).mapInArrow(
        run, "host string, page long, copy long, layout long, tokens array<struct<token:string,words:int,times:long>>, seq array<int>"
    )
    return found.groupBy("host", "page").agg(F.min_by(F.struct("layout", "tokens", "seq"), "copy").alias("one")).select("host", "page", "one.*")


def _text_token(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    return f"{zlib.crc32(data):08x}{len(data):x}"


def _marks(path: str) -> str:
    return "".join(s[0] for s in path.split(">") if s[:1] in ("+", "-"))


def _places(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """``(host, a, b, low, high)``: for classes of a host that meet on a page, in which gap of class ``a`` the first
    and the last token of ``b`` stand there; for ``a`` = ``b``, a hash of the class's tokens in order."""
    known = classes.groupBy("host").agg(F.collect_list(F.struct("token", "vector")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple] = set()
            for host, tokens, seq, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vector = {k["token"]: k["vector"] for k in known}
                order = [(vector[t], t) for t in (tokens[n]["token"] for n in seq) if t in vector]
                at: dict[int, list[int]] = {}
                for n, (v, _) in enumerate(order):
                    at.setdefault(v, []).append(n)
                for a, own in at.items():
                    mark = _hash("\n".join(order[n][1] for n in own))
                    out.add((host, a, a, mark, mark))
                    out |= {(host, a, b, sum(n < other[0] for n in own), sum(n < other[-1] for n in own)) for b, other in at.items() if a != b}
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "a", "b", "low", "high"])

    return pages.join(known, "host").select("host", "tokens", "seq", "known").mapInArrow(run, "host string, a long, b long, low long, high long")


def templates(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``(host, fixed)``: each host's template texts ``path|token``.

    Hosts of one different page are taken together with those of the same
    layout (set of container paths), and "host" means this group below.  A token's occurrence vector says how often it stands on each page of the
    host.  Tokens with equal vectors form an equivalence class; vectors are
    compared by two hashes of all pages and counts, so a class is a group of an
    aggregate and no vector is ever built.  A class is valid if it has enough
    words, stands on enough different pages, has its tokens in one order on all
    of them, and is nested: where two classes meet, one stands in the same gap of
    the other each time; else the rarer, then smaller one is left out.  Valid
    classes make up the template; what it does not hold are its slots.

    Every page of every host is counted.  Pages with one main text (copies)
    count once.  Near copies would make a template of the article they share, so a text
    is template only if the pages it stands on have as many words in texts of
    their own (that no other page of the host has) in all, and if its own container holds
    such texts, ``OWN_BESIDE`` times as many there on ``BESIDE_PAGES`` pages.  Inside of an article no text is template; in
    another main part only one that all pages have, of three on.  The number of a
    host's template texts is at most about twice the mean number of texts on its
    pages, as each stands on half of them.
    """
    rows = settle(_tokens(pages, url, page), "pages")
    groups = rows.groupBy("host").agg(F.count(F.lit(1)).alias("all"), F.min("layout").alias("layout"))
    alone = F.concat(F.lit("layout "), F.col("layout").cast("string"))
    groups = settle(groups.select("host", (F.col("all") == 1).alias("alone"), F.when(F.col("all") > 1, F.concat(F.lit("host "), F.col("host"))).otherwise(alone).alias("group")), "groups")
    rows = rows.join(groups, "host").select(F.col("group").alias("host"), "alone", "page", "tokens", "seq")
    mirrors = rows.filter("alone").groupBy("host", "page").agg(F.min(F.struct("tokens", "seq")).alias("one")).select("host", "page", "one.*")
    rows = settle(rows.filter("not alone").select("host", "page", "tokens", "seq").unionByName(mirrors), "grouped-pages")
    each = rows.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    number = rows.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    marks = [F.bit_xor(F.xxhash64("page", "times", F.lit(n))).alias(f"mark{n}") for n in (1, 2)]
    seen = settle(each.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.max("words").alias("words"), F.sum(F.col("words") * F.col("times")).alias("sum"), F.min("page").alias("page"), *marks), "page-tokens")
    path = F.regexp_replace("token", r"\|[^|]*$", "")
    alone = seen.filter((F.col("pages") == 1) & ~F.col("token").rlike(r"(^|>)-")).groupBy("host", "page", path.alias("path")).agg(F.sum("sum").alias("own"))
    alone = settle(alone.withColumn("any", F.sum("own").over(Window.partitionBy("host", "page"))), "own-words")  # a row per container of a page
    often = seen.filter(F.col("pages") >= TEMPLATE_PAGES).join(number, "host").filter(F.col("pages") >= TEMPLATE_SHARE * F.col("all"))
    often = settle(often.select("host", "token", "pages", "words", (F.col("pages") == F.col("all")).alias("everywhere"), F.xxhash64("mark1", "mark2").alias("vector")), "often")
    own = each.select("host", "page", "token").join(often.select("host", "token"), ["host", "token"]).withColumn("path", path)
    around = own.join(alone.select("host", "page", "path", "own"), ["host", "page", "path"], "left").join(alone.groupBy("host", "page").agg(F.max("any").alias("any")), ["host", "page"], "left")
    around = around.groupBy("host", "token").agg(F.coalesce(F.sum("own"), F.lit(0)).alias("beside"), F.coalesce(F.sum("any"), F.lit(0)).alias("around"))
    mixed = (F.col("beside") > 0) & ((F.col("pages") < BESIDE_PAGES) | (F.col("beside") < OWN_BESIDE * F.col("words")))
    often = settle(often.join(around, ["host", "token"]).filter((F.col("around") >= F.col("words")) & ~mixed), "tokens")
    sizes = often.groupBy("host", "vector").agg(F.max("pages").alias("support"), F.sum("words").alias("size")).filter(F.col("size") >= CLASS_WORDS)
    classes = settle(often.join(sizes, ["host", "vector"]), "classes")
    places = _places(rows, classes).groupBy("host", "a", "b").agg(*[f(c).alias(f"{n}_{c}") for c in ("low", "high") for n, f in (("min", F.min), ("max", F.max))])
    places = settle(places.withColumn("steady", F.expr("min_low = max_low and min_high = max_high and min_low = min_high")), "places")
    ordered = settle(places.filter("a = b and steady").select("host", F.col("a").alias("vector")).join(sizes, ["host", "vector"]), "ordered")
    one, two = (ordered.select("host", F.col("vector").alias(c), F.struct("support", "size", "vector").alias("rank_" + c)) for c in "ab")
    pairs = places.filter("a <> b").select("host", "a", "b", "steady").join(one, ["host", "a"]).join(two, ["host", "b"])
    pairs = pairs.select("host", F.least("rank_a", "rank_b").alias("less"), F.greatest("rank_a", "rank_b").alias("more"), "steady")
    crossed = pairs.groupBy("host", "less", "more").agg(F.max("steady").alias("nested")).filter(~F.col("nested")).select("host", F.col("less.vector").alias("vector")).distinct()
    valid = ordered.select("host", "vector").join(crossed, ["host", "vector"], "left_anti")
    article, main = (F.col("token").rlike(r"(^|>)\+" + part) for part in (r"article[.>|]", ""))
    sure = ~main | (~article & F.col("everywhere") & (F.col("pages") > 2))
    fixed = classes.join(valid, ["host", "vector"]).filter(sure).groupBy("host").agg(F.collect_set("token").alias("fixed"))
    return groups.join(settle(fixed, "fixed").withColumnRenamed("host", "group"), "group").select("host", "fixed")


def main_text(page: str, fixed: frozenset[str] | set[str]) -> str:
    """Blocks of the page's main slots, joined by line breaks.

    What the template ``fixed`` leaves are slots.  Where the page has a main part,
    its slots are the main text; else all that are not outside by name.
    """
    found = [(p, t) for p, t in blocks(page) if "-" not in _marks(p)]
    found = [(p, t) for p, t in found if not fixed or f"{p}|{_text_token(t)}" not in fixed]
    return "\n".join([t for p, t in found if "+" in _marks(p)] or [t for _, t in found])


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` to ``pages`` (columns of these names are replaced).

    Hosts' templates are a small table (a row per host) that is joined by host;
    pages of a host with a third of all rows are split by adaptive execution or
    not moved at all.  A null or empty page has an empty text; pages with a null
    or odd url share the template of the host ``''``; repeated rows get equal
    results; an empty table stays empty.  The row travels as one struct, so no name can clash.
    """
    ship(pages.sparkSession)
    table = settle(templates(pages, url, page), "templates")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("doc"), _host(url).alias("host")).join(table, "host", "left").select("doc", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, fixed = batch.column(0).field(page), batch.column(1)
            texts = [main_text(bodies[i].as_py() or "", frozenset(fixed[i].as_py() or ())) for i in range(batch.num_rows)]
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "text", "n_chars"])

    schema = T.StructType([rows.schema["doc"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col("doc")[c].alias(c) for c in pages.columns if c not in ("text", "n_chars")], "text", "n_chars")
