"""Rows from forum pages: threads of a listing, posts of a topic, attributes of a profile, page addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_VOID = {"br", "img", "input", "hr", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class Node:
    """An element: its tag, attributes and children (nodes and strings)."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def all(self, tag: str | None = None, css: str | None = None, outside: str | None = None) -> Iterator[Node]:
        """Elements below with a tag and a class, but not inside of elements with the tag outside."""
        for child in self.children:
            if isinstance(child, Node):
                if child.tag == outside:
                    continue
                if (tag is None or child.tag == tag) and (css is None or css in child.attributes.get("class", "").split()):
                    yield child
                yield from child.all(tag, css, outside)

    def first(self, tag: str | None = None, css: str | None = None, outside: str | None = None) -> Node | None:
        return next(self.all(tag, css, outside), None)

    def text(self, skip: tuple[str, ...] = ()) -> str:
        """The text below, white space squeezed, without elements that have a tag or class in skip."""
        parts: list[str] = []

        def walk(node: Node) -> None:
            for child in node.children:
                if isinstance(child, str):
                    parts.append(child)
                elif child.tag not in skip and not set(child.attributes.get("class", "").split()) & set(skip):
                    walk(child)

        walk(self)
        return " ".join(" ".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _number(text: str) -> int | None:
    digits = "".join(str(int(c)) for c in text if c.isdigit())
    return int(digits) if digits else None


def topic_posts(html: str, page: int) -> list[dict]:
    """The posts of a topic's page in order."""
    out = []
    for i, article in enumerate(tree(html).all("article")):
        found = re.search(r"(\d+)", article.attributes.get("id", "")) or re.search(r"postId=(\d+)", html if not article.attributes.get("id") else "")
        part = lambda css, **kw: (n.text(**kw) if (n := article.first(css=css, outside="blockquote")) else None)  # noqa: B023, E731
        like = article.first(css="like-count")
        quote = article.first("blockquote")
        answers = re.search(r"(\d+)", quote.attributes.get("data-post", "") or quote.attributes.get("id", "")) if quote else None
        likes = _number(like.attributes.get("data-like-count") or like.text()) if like else None
        out.append({"post_id": found.group(1) if found else None, "author": part("nickname"), "posted_at": part("date"), "content": part("post-message", skip=("signature", "blockquote")), "likes": likes or 0, "user_post_count": _number(part("post-count") or ""), "reply_to": answers.group(1) if answers else None, "is_starter": i == 0 and page == 1})
    return out


def listing_threads(html: str, least_replies: int = 0) -> list[dict]:
    """thread_id, title and replies of a listing's threads with enough replies."""
    out = []
    for subject in tree(html).all(css="topic_subject"):
        link = subject.first("a") or (subject.parent if subject.parent and subject.parent.tag == "a" else None)
        found = re.search(r"/topic/(\d+)", link.attributes.get("href", "")) if link else None
        holder, count = subject.parent, None
        while holder is not None and count is None:
            number = holder.first(css="topic_number")
            count, holder = (_number(number.text()) if number else None), holder.parent
        if found and (count or 0) >= least_replies:
            out.append({"thread_id": found.group(1), "title": subject.text(), "replies": count or 0})
    return out


# Class tokens that mark a woman's or a man's profile, and the words for them.
WOMAN_TOKENS = ("is-woman", "iconwoman", "icon-woman", "woman", "female")
MAN_TOKENS = ("is-user", "iconuser-01", "iconuser-1", "iconuser", "icon-user", "iconman", "icon-man", "man", "male")
WOMAN, MAN = "زن", "مرد"
_MARKED = ("woman", "user", "man")


def _spans_after(root: Node) -> dict[int, Node]:
    """For each element, by its identity, the next span in the document's order."""
    order = list(root.all())
    after: dict[int, Node] = {}
    coming: Node | None = None
    for node in reversed(order):
        if coming is not None:
            after[id(node)] = coming
        if node.tag == "span":
            coming = node
    return after


def profile_gender(html: str) -> tuple[str, int, str]:
    """(word, code, source): the word near a marked element, else class tokens of one kind only, else ('unknown', -1, 'unresolved').

    Near is the element's own text with that of the next span. What isn't marked a woman's profile is not taken for a man's.
    """
    root = tree(html)
    after = _spans_after(root)
    tokens: set[str] = set()
    for node in root.all():
        held = node.attributes.get("class", "")
        tokens |= {t.lower() for t in held.split()}
        if any(mark in held for mark in _MARKED):
            near = f"{node.text()} {after[id(node)].text() if id(node) in after else ''}"
            for word, code, source in ((WOMAN, 1, "explicit_text_female"), (MAN, 0, "explicit_text_male")):
                if word in near:
                    return word, code, source
    woman, man = sorted(tokens & set(WOMAN_TOKENS)), sorted(tokens & set(MAN_TOKENS))
    if bool(woman) == bool(man):
        return "unknown", -1, "unresolved"
    return (WOMAN, 1, f"class_marker:{woman[0]}") if woman else (MAN, 0, f"class_marker:{man[0]}")


# The icons before a profile's fields, and the word for the day of joining.
_ICONS = {"iconbirthday-stroke": "age", "iconeducation": "education", "iconinfant": "status", "iconsignature": "signature"}
_JOINED = "عضویت"


def profile_fields(html: str) -> dict:
    """username, gender, gender_code, gender_source, join_date, age, education, status, children_count, signature of a profile page; '' where it has none."""
    root = tree(html)
    after = _spans_after(root)
    holder = next((n for n in root.all("div", "profile__name")), None)
    head = holder.first("h4") if holder else None
    out = {"username": head.text() if head else "", **dict.fromkeys(_ICONS.values(), ""), "join_date": "", "children_count": 0}
    out["gender"], out["gender_code"], out["gender_source"] = profile_gender(html)
    for icon, field in _ICONS.items():
        node = root.first("i", icon)
        if node is not None and id(node) in after:
            out[field] = after[id(node)].text()
    calendar = root.first("i", "iconcalender")
    spans = [c for c in calendar.parent.children if isinstance(c, Node) and c.tag == "span"] if calendar and calendar.parent else []
    for label, value in zip(spans, spans[1:]):
        if _JOINED in label.text():
            out["join_date"] = value.text()
            break
    return out


_PROFILE = "url string, username string, gender string, gender_code int, gender_source string, join_date string, age string, education string, status string, children_count int, signature string"
_THREAD = "page_url string, thread_id string, title string, replies long"


def profiles_of_pages(df: DataFrame, html: str, url: str) -> DataFrame:
    """A row a profile page with its fields; a page with a null html gives none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"url": u, **profile_fields(h)} for h, u in zip(batch["html"], batch["url"]) if h], columns=[c.split()[0] for c in _PROFILE.split(", ")])

    return df.select(F.col(html).alias("html"), F.col(url).alias("url")).mapInPandas(parse, _PROFILE)


def threads_of_pages(df: DataFrame, html: str, url: str, least_replies: int = 0) -> DataFrame:
    """The threads of listing pages that have enough replies; each thread once, from the page that comes first by its address."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"page_url": u, **t} for h, u in zip(batch["html"], batch["url"]) if h for t in listing_threads(h, least_replies)], columns=[c.split()[0] for c in _THREAD.split(", ")])

    found = df.select(F.col(html).alias("html"), F.col(url).alias("url")).mapInPandas(parse, _THREAD)
    return found.groupBy("thread_id").agg(F.min_by(F.struct("page_url", "title", "replies"), F.struct("page_url", "title", "replies")).alias("x")).select("thread_id", "x.*")


def listing_pages(sections: DataFrame, url: str, requested: str, discovered: str, cap: int) -> DataFrame:
    """page_url, page of every page to read of each section, up to the least of the pages requested, those discovered and the cap; comments and placeholders are skipped."""
    good = sections.where(~F.coalesce(F.trim(url).startswith("#") | F.col(url).contains("REPLACE_ME") | (F.trim(url) == ""), F.lit(True)))
    last = F.least(F.coalesce(F.col(requested), F.lit(cap)), F.coalesce(F.col(discovered), F.lit(1)), F.lit(cap))
    pages = good.where(last >= 1).withColumn("page", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    return pages.select(with_page(F.trim(url), F.col("page")).alias("page_url"), "page").distinct()


_POST = "page_no long, post_id string, author string, posted_at string, content string, likes long, user_post_count long, reply_to string, is_starter boolean"


def posts_of_pages(df: DataFrame, html: str, page: str) -> DataFrame:
    """The posts of topic pages; a page without posts or with a null html gives none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_no": n, **post} for h, n in zip(batch["html"], batch["page"]) if h for post in topic_posts(h, n)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _POST.split(", ")])

    return df.select(F.col(html).alias("html"), F.col(page).cast("long").alias("page")).mapInPandas(parse, _POST)


def with_page(url: Column, page: Column) -> Column:
    """The address of a page of a listing or topic: page 1 is the address as it is, any other has page as its query's last part."""
    bare = F.regexp_replace(F.regexp_replace(url, r"([?&])page=[0-9]+(&|$)", "$1"), "[?&]$", "")
    return F.when(page <= 1, url).otherwise(F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("page="), page.cast("string")))


def last_page(html: Column) -> Column:
    """The largest page number among the links of a page, 1 at least; numbers outside of links don't count."""
    links = F.coalesce(F.regexp_extract_all(html, F.lit("""href\\s*=\\s*["'][^"']*[?&]page=([0-9]+)"""), F.lit(1)), F.array().cast("array<string>"))
    return F.greatest(F.coalesce(F.array_max(F.transform(links, lambda x: x.try_cast("int"))), F.lit(1)), F.lit(1))
