"""Element access for HTML columns: a small tree per page inside Arrow batches, results as arrays of structs.

Only what needs the element tree happens here; titles, dates, links and scores
are Column expressions on the result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# a tag and the open tags it closes, as browsers do for unclosed markup
CLOSES = {
    "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    **{t: {"p"} for t in "p div ul ol table section article h1 h2 h3 h4 h5 h6 form pre blockquote header footer nav aside main".split()},
}
SCOPES = frozenset({"ul", "ol", "table", "body", "html", "dl", "select"})

# Page areas that are not content, and where content usually sits, in order.
BOILERPLATE = (
    "script, style, noscript, iframe, nav, header, footer, .ad, .ads, .advertisement, .banner, .sidebar, .related, .related-posts, "
    ".related-articles, .recommended, .comments, .comment, .share, .social, .author-bio, .newsletter, .subscribe, [class*=ad-], "
    "[class*=ads-], [id*=ad-], [id*=ads-]"
)
CONTENT = (
    "article, [role=main], main, .article-content, .article-body, .post-content, .post-body, .entry-content, .content-body, "
    ".story-content, .blog-content, .news-content, .text-content, #content, #article, #post, .content, .post, .article"
)
HARD_STRIP = (
    "head, nav, aside, footer, header, iframe, noscript, svg, [role=navigation], [role=complementary], [role=banner], [role=contentinfo], "
    "[role=dialog], [aria-modal=true], [id*=modal], [id*=Modal], [class*=modal], [class*=Modal], [style*=display: none], "
    "[style*=display:none], form, [id*=subscribe], [class*=subscribe], [id*=login], [class*=login], script, style, [id*=sidebar], "
    "[id*=side-], [class*=sidebar], [class*=side-bar], [id*=widget], [class*=widget], [id*=banner], [class*=banner], "
    "[id*=advertisement], [class*=advertisement], [class*=ad-], [id*=ad-]"
)
LIGHT_STRIP = "head, script, style, iframe, noscript, svg"
CHROME = "nav, header, footer, aside, [role=navigation], [role=banner], [role=contentinfo]"
# Selectors of list pages by strategy.
LISTS = {
    "static": {
        "item": "article, .article, .post, .item, .card, .list-item", "title": "h2, h3, h1, .title, .headline", "link": "a", "thumb": "img",
        "author": ".author, .writer, .byline, .name", "date": ".date, time, .time, .published, .datetime",
    },
    "stibee": {
        "item": ".archive-list-item, .letter-item, article", "title": ".archive-list-title, .title, h2, h3", "link": "a",
        "date": ".archive-list-date, .date, time",
    },
    "substack": {
        "item": ".post-preview, .post-item, article.post", "title": ".post-preview-title, .post-title, h2", "link": "a", "thumb": "img",
        "author": ".author-name, .pencraft .profile-hover-card-target", "date": ".post-date, time, .pencraft",
    },
    "mailchimp": {
        "item": ".campaign, .archive-list-item, li.campaign-item", "title": ".campaign-title, h2, h3, .title", "link": "a",
        "date": ".campaign-date, .date, time",
    },
    "newsletter": {
        "item": "article, .post, .newsletter-item, .archive-item, li", "title": "h2, h3, .title, a", "link": "a", "thumb": "img",
        "date": ".date, time, .datetime, .published",
    },
    "brunch_author": {
        "item": ".list_article li, .wrap_article_list li, article.card", "title": ".tit_article, .title, h2", "link": "a", "thumb": "img",
        "date": ".publish_time, .date, time",
    },
    "brunch_magazine": {
        "item": ".list_magazine_article li, .article_item, article", "title": ".tit_article, .title, h3", "link": "a", "thumb": "img",
        "author": ".author, .writer", "date": ".date, time",
    },
    "brunch": {
        "item": "article, .wrap_article, .card_article, li.list_item", "title": ".tit_article, .title, h2, h3", "link": "a[href*=/@]",
        "thumb": "img", "author": ".name_author, .author", "date": ".date, time, .publish_time",
    },
    "naver": {
        "item": ".blog-list-item | .post-item | .lst_tit a | #listTopForm tr | .blog2_post", "title": ".title, .tit, h2, h3, .post_tit",
        "link": "a", "date": ".date, .datetime, time",
    },
}
TITLE_ORDER = ["h1", "h2", "h3", "h4", "h5", "h6", ".title", ".subject", ".tit", ".headline", "[class*=title]", "[class*=subject]", "a"]
DATE_ORDER = ["time[datetime]", "time", ".date", ".time", ".datetime", ".published", "[class*=date]", "[class*=time]"]
DATE_TEXT = re.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[./-]\d{1,2}|\d+[시간일주월년]|ago|전")


class Node:
    __slots__ = ("tag", "attrs", "classes", "kids", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent
        self.classes = attrs.get("class", "").split()

    def walk(self) -> Iterator["Node"]:
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self) -> str:
        out, stack = [], list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, Node):
                stack.extend(reversed(k.kids))
            else:
                out.append(k)
        return "".join(out)

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.kids = [k for k in self.parent.kids if k is not self]


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.comments: list[str] = []

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag)
        if closes:
            n = self.at
            while n is not self.root and n.tag not in SCOPES:
                if n.tag in closes:
                    self.at = n.parent
                    break
                n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)

    def handle_comment(self, data):
        self.comments.append(data)


def parse(html: str | None) -> TreeBuilder:
    b = TreeBuilder()
    b.feed(html or "")
    b.close()
    return b


PART = re.compile(r"([\w-]+)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^]?)=([^\]]*))?\]")


def matches_one(n: Node, compound: tuple) -> bool:
    for tag, cls, id_, attr, op, val in compound:
        if tag and n.tag != tag or cls and cls not in n.classes or id_ and n.attrs.get("id") != id_:
            return False
        if attr:
            have = n.attrs.get(attr)
            if have is None or (op == "*" and val not in have) or (op == "^" and not have.startswith(val)) or (val and not op and have != val):
                return False
    return True


def split_path(one: str) -> list[str]:
    """Compounds of a selector, outermost first; blanks inside brackets do not split."""
    return re.findall(r"(?:[^\s\[]+|\[[^\]]*\])+", one.strip())


@functools.lru_cache(4096)
def compiled(selector: str) -> tuple:
    """(outer compounds, innermost first; last compound) of each alternative, read once for all nodes and pages of a worker."""
    paths = [[tuple(PART.findall(c)) for c in split_path(one)] for one in selector.split(",")]
    return tuple((tuple(reversed(outer)), last) for *outer, last in paths)


def matches(n: Node, selector: str) -> bool:
    for outer, last in compiled(selector):
        if not matches_one(n, last):
            continue
        up = n.parent
        for want in outer:
            while up is not None and not matches_one(up, want):
                up = up.parent
            if up is None:
                break
            up = up.parent
        else:
            return True
    return False


def find(n: Node, selector: str) -> list[Node]:
    return [k for k in n.walk() if matches(k, selector)]


def first(n: Node, selector: str) -> Node | None:
    return next((k for k in n.walk() if matches(k, selector)), None)


def strip(root: Node, selector: str) -> None:
    for k in find(root, selector):
        k.drop()


def squeezed(s: str) -> str:
    return " ".join(s.replace("﻿", " ").split())


def body_of(root: Node) -> Node:
    return first(root, "body") or root


def to_html(n: Node) -> str:
    """Markup of a tree again (attribute values quoted, text escaped outside scripts)."""
    out: list[str] = []
    stack: list = [n]
    while stack:
        k = stack.pop()
        if isinstance(k, tuple):
            out.append(k[0])
        elif isinstance(k, str):
            out.append(k.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        else:
            if k.tag != "#root":
                attrs = "".join(f' {a}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for a, v in k.attrs.items())
                out.append(f"<{k.tag}{attrs}>")
                if k.tag in VOID:
                    continue
                stack.append((f"</{k.tag}>",))
            raw = k.tag in ("script", "style")
            stack.extend((c,) if raw and isinstance(c, str) else c for c in reversed(k.kids))
    return "".join(out)


def main_text(html: str | None, own: str | None = None, min_chars: int = 100) -> str:
    root = parse(html).root
    strip(root, BOILERPLATE)
    for sel in ([own] if own else []) + CONTENT.split(", "):
        hit = first(root, sel)
        if hit is not None:
            t = squeezed(hit.text())
            if len(t) > min_chars:
                return t
    return squeezed(body_of(root).text())


def extraction_markup(html: str | None, cap: int = 30000, min_text: int = 500) -> str:
    for sel in (HARD_STRIP, LIGHT_STRIP):
        root = parse(html).root
        strip(root, sel)
        if sel is LIGHT_STRIP or len(squeezed(root.text())) >= min_text:
            break
    return re.sub(r"\n{3,}", "\n\n", to_html(root)).strip()[:cap]


def attr(n: Node | None, *names: str) -> str | None:
    if n is not None:
        for a in names:
            if n.attrs.get(a):
                return n.attrs[a]
    return None


def said(n: Node | None) -> str | None:
    return (n.text().strip() or None) if n is not None else None


def read_item(el: Node, sel: dict) -> dict | None:
    a = first(el, "a") if el.tag != "a" else el
    title = said(first(el, sel["title"])) or said(a)
    link = first(el, sel["link"]) or a
    href = attr(link, "href") or attr(el, "href") or attr(a, "href")
    if not title or not href:
        return None
    date = first(el, sel["date"]) if sel.get("date") else None
    return {
        "title": title, "href": href, "onclick": attr(link, "onclick") or attr(el, "onclick") or attr(a, "onclick"),
        "thumb": attr(first(el, sel["thumb"]), "src", "data-src", "data-lazy-src") if sel.get("thumb") else None,
        "author": said(first(el, sel["author"])) if sel.get("author") else None,
        "date": attr(date, sel.get("date_attr") or "datetime", "content") or said(date), "text": el.text(),
    }


def inside(n: Node, selectors: list[str]) -> bool:
    while n is not None:
        if any(matches(n, s) for s in selectors):
            return True
        n = n.parent
    return False


def list_items(html: str | None, sel: dict, container: str | None = None, exclude: list[str] | None = None) -> list[dict]:
    return items_of(body_of(parse(html).root), sel, container, exclude)


def items_of(body: Node, sel: dict, container: str | None = None, exclude: list[str] | None = None) -> list[dict]:
    root = (first(body, container) if container else None) or body
    for choice in sel["item"].split("|"):
        got = [read_item(el, sel) for el in find(root, choice) if not (exclude and inside(el, exclude))]
        got = [g for g in got if g]
        if got:
            return got
    return []


def has_date(el: Node) -> bool:
    for s in DATE_ORDER:
        d = first(el, s)
        if d is not None and (d.attrs.get("datetime") or DATE_TEXT.search(d.text())):
            return True
    return False


def has_title(el: Node) -> bool:
    return any(t is not None and len(t.text().strip()) > 2 for t in (first(el, s) for s in TITLE_ORDER))


def repeated_elements(html: str | None) -> list[dict]:
    """Every linked row, list item or classed block with the group it belongs to, for counting in Spark."""
    root = parse(html).root
    strip(root, CHROME)
    out = []

    def add(kind: str, group: str, el: Node, seq: int) -> None:
        if first(el, "a[href]") is not None:
            out.append({
                "kind": kind, "grp": group, "seq": seq, "tag": el.tag, "title": has_title(el), "date": has_date(el),
                "thumb": any(attr(i, "src", "data-src", "data-lazy-src") for i in find(el, "img")),
            })

    for i, n in enumerate(root.walk()):
        if n.tag == "tr" and first(n, "th") is None:
            up = n.parent
            while up is not None and up.tag != "table":
                up = up.parent
            if up is not None:
                add("table", f"table@{id(up)}", n, i)
        if n.tag == "li" and n.parent is not None and n.parent.tag in ("ul", "ol"):
            add("list", f"list@{id(n.parent)}", n, i)
        if n.tag in ("div", "article", "section", "li") and n.attrs.get("class", "").split():
            add("class", f"{n.tag}.{n.attrs['class'].split()[0]}", n, i)
    # stable group names: the place of first appearance instead of the object id
    names: dict[str, str] = {}
    for o in out:
        if "@" in o["grp"]:
            o["grp"] = names.setdefault(o["grp"], f"{o['kind']}@{o['seq']}")
    return out


def signals(html: str | None) -> dict:
    b = parse(html)
    root = b.root
    body = squeezed(body_of(root).text())
    links = find(root, "a[href]")
    scripts = find(root, "script")
    srcs = " ".join(s.attrs.get("src", "") for s in scripts)
    inline = "".join(s.text() for s in scripts if "src" not in s.attrs)
    both = srcs + inline
    canon = attr(first(root, "link[rel=canonical]"), "href") or attr(first(root, "base"), "href") or ""
    named = [n for n in root.walk() if n.attrs.get("id")]
    elems = lambda n: [k for k in n.kids if isinstance(k, Node)]
    return {
        "body_chars": len(body), "dense_chars": len(re.sub(r"\s", "", body)), "links": len(links),
        "script_chars": len(re.sub(r"\s", "", "".join(s.text() for s in scripts))),
        "js_links": sum(n.attrs["href"].startswith("javascript:") for n in links),
        "nav_clicks": sum(bool(re.search(r"go[A-Z_]|fn[A-Z_]|moveToPage|goToPage|pageMove", n.attrs.get("onclick", ""), re.I)) for n in root.walk()),
        "has_noscript": first(root, "noscript") is not None, "has_root": first(root, "#root, #app, #__next") is not None,
        "vue_ssr": first(root, "[data-server-rendered=true]") is not None,
        "framework": bool(
            re.search(r"vue|vuex|vue-router|nuxt", both, re.I) or re.search(r"react|react-dom|next\.js|webpack|chunk|bundle|app\.[a-f0-9]{8}\.js", srcs, re.I)
            or re.search(r"angular|ng-|@angular", both, re.I)),
        "public_portal": bool(re.search(r"\.go\.kr|\.or\.kr", canon, re.I)),
        "comment_trace": any(re.search(r"(Surfit|created by|built with|powered by).*(Vue|React|Next|Nuxt)", c, re.I | re.S) for c in b.comments),
        "empty_tbody": sum(first(n, "tr") is None for n in find(root, "tbody")),
        "empty_lists": sum(not any(k.tag == "li" for k in elems(n)) for n in named if n.tag in ("ul", "ol")),
        "empty_blocks": sum(
            bool(re.search(r"list|board|body|content|data|result|item", n.attrs["id"], re.I)) and not elems(n) for n in named if n.tag in ("div", "section")),
        "articles": len(find(root, "article")), "nested_articles": len(find(root, "main article, section article")),
    }


# --- Arrow UDFs ----------------------------------------------------------------

ITEM = "array<struct<title:string,href:string,onclick:string,thumb:string,author:string,date:string,text:string>>"
ELEMENT = "array<struct<kind:string,grp:string,seq:int,tag:string,title:boolean,date:boolean,thumb:boolean>>"
SIGNALS = (
    "struct<body_chars:int,dense_chars:int,links:int,script_chars:int,js_links:int,nav_clicks:int,has_noscript:boolean,has_root:boolean,"
    "vue_ssr:boolean,framework:boolean,public_portal:boolean,comment_trace:boolean,empty_tbody:int,empty_lists:int,empty_blocks:int,"
    "articles:int,nested_articles:int>"
)


def page_text(html: Column, own: str | None = None) -> Column:
    """Main text of a page: boilerplate dropped, first content area over 100 characters, else the body."""

    @F.pandas_udf("string")
    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: main_text(x, own))

    return run(html)


def extraction_html(html: Column, cap: int = 30000) -> Column:
    @F.pandas_udf("string")
    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: extraction_markup(x, cap))

    return run(html)


def page_items(html: Column, strategy: str | dict = "static", container: str | None = None, exclude: list[str] | None = None) -> Column:
    """Raw list items of a page by a named strategy or own selectors laid over the static ones."""
    sel = LISTS[strategy] if isinstance(strategy, str) else {**LISTS["static"], **strategy}

    @F.pandas_udf(ITEM)
    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: list_items(x, sel, container, exclude))

    return run(html)


def page_lists(html: Column, strategies: list[str]) -> Column:
    """Raw list items of a page by each of the named strategies, in their order; the page is parsed once."""

    @F.pandas_udf(f"array<{ITEM}>")
    def run(h: pd.Series) -> pd.Series:
        bodies = (body_of(parse(x).root) for x in h)
        return pd.Series([[items_of(b, LISTS[s]) for s in strategies] for b in bodies], dtype=object)

    return run(html)


def page_elements(html: Column) -> Column:
    @F.pandas_udf(ELEMENT)
    def run(h: pd.Series) -> pd.Series:
        return h.map(repeated_elements)

    return run(html)


def page_signals(html: Column) -> Column:
    @F.pandas_udf(SIGNALS)
    def run(h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signals(x) for x in h])

    return run(html)
