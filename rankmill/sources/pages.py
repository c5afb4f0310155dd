"""Pages to rows, with JVM regular expressions over whole pages; one page is one row, so nothing is collected."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill import functions as fn



def block(tag: str, css: str) -> str:
    """Pattern of a start tag that has the class, in either kind of quotes."""
    return rf"""<{tag}\b[^>]*?\bclass\s*=\s*(?:"(?:[^"]*\s)?{css}(?:\s[^"]*)?"|'(?:[^']*\s)?{css}(?:\s[^']*)?')[^>]*>"""


LIST, ITEM, NO_DATA = block("ul", "list"), block("li", "item"), block("div", "no_data")
DL = r"(?s)<dl[^>]*>(.*?)</dl>"
DT = r"(?s)<dt[^>]*>(.*?)</dt>"
DD = r"(?s)<dd[^>]*>(.*?)</dd>"
DD_CLASS = r'<dd[^>]*class="([^"]*)"'
DD_NAME = r'<dd[^>]*data-charactername="([^"]*)"'
ALL = 1 << 30  # longer than any array
LINK_ITEM = r'<li><a href="([^"]*)">([^<]*)</a></li>'
TITLE_LINK = r'(?s)<a[^>]*class="(?:[^"]* )?title(?: [^"]*)?"[^>]*>.*?</a>'

# Character references and the character they stand for; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """References replaced; the text is named once, as a second mention would run the patterns below it again."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def no_data(html: Column) -> Column:
    return html.rlike(NO_DATA)


def item_markup(html: Column) -> Column:
    """The items of the ranking list, each up to the next item's start tag, so lists inside an item stay whole; null without a list."""
    listed = F.get(F.split(html, LIST, 2), F.lit(1))
    return F.slice(F.split(listed, ITEM), 2, ALL)


def text_of(html: Column) -> Column:
    """Text of a piece of markup: tags removed, blanks stripped."""
    return fn.clean_text(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", "")))


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _found(html: Column, pattern: str) -> Column:
    """First group of the first match, or null when the pattern does not occur."""
    return F.get(_all(html, pattern), F.lit(0))


def list_items(html: Column) -> Column:
    """The items of a ranking list page as an array of structs; a missing part is null.

    Everything happens inside one expression per page: the parts of an item are
    lambda variables, so no pattern runs twice on the same text.
    """

    def parts(cells: Column) -> Column:
        cell = [F.get(cells, F.lit(i)) for i in range(5)]
        return F.struct(
            text_of(_found(cell[0], DT)).alias("rank"),
            text_of(_found(cell[0], DD)).alias("shown_change"),
            F.coalesce(_found(cell[0], DD_CLASS), F.lit("")).alias("css"),
            text_of(_found(cell[1], DD)).alias("server"),
            fn.clean_text(unescape(_found(cell[2], DD_NAME))).alias("character"),
            text_of(_found(cell[3], DD)).alias("class"),
            text_of(_found(cell[4], DD)).alias("power"),
        )

    items = F.when(~no_data(html), item_markup(html))
    return F.transform(F.transform(items, lambda item: _all(item, DL)), parts)


def item_rows(pages: DataFrame, others: list[str], items: Column, change_rule: str = "digits") -> DataFrame:
    """One row per well-formed item of an array made by `list_items`; the placeholder name is left out.

    The array is exploded where it is made: of one that has a name Spark first filters the empty ones, and for
    that makes it, and what it is made of, once more for each condition.
    """
    rows = pages.select(*others, F.posexplode(items).alias("pos", "_item")).select(*others, "pos", "_item.*")
    rows = rows.dropna(subset=["rank", "shown_change", "server", "character", "class", "power"])
    named = rows.filter(F.col("character") != fv.PLACEHOLDER_NAME)
    mode = "batch" if change_rule == "text" else "service"
    kind = fn.change_type_of(F.col("css"), mode)
    shown = F.col("shown_change")
    change = {
        "digits": fn.parse_change_digits(shown).cast("string"),
        "text": shown,
        "isdigit": fn.parse_change_isdigit(shown, kind).cast("string"),
    }[change_rule]
    plain = [c for c in named.columns if c not in ("shown_change", "css")]
    return named.select(*plain, change.alias("change"), kind.alias("change_type"))


def extract_list_items(pages: DataFrame, change_rule: str = "digits") -> DataFrame:
    """Ranking list page -> one row per item.

    change_rule: `digits` reads the first digits and knows up/down/none, `text`
    keeps the change as shown and knows up and else down, `isdigit` takes whole
    digit texts only.
    """
    others = [c for c in pages.columns if c != "html"]
    return item_rows(pages, others, list_items(F.col("html")), change_rule)


def extract_links(pages: DataFrame) -> DataFrame:
    """Flat list links of any page: (position, href, text)."""
    pairs = F.arrays_zip(
        _all(F.col("html"), LINK_ITEM, 1).alias("href"), _all(F.col("html"), LINK_ITEM, 2).alias("text")
    )
    rows = pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(pairs).alias("pos", "_link"))
    return rows.select(
        *[c for c in pages.columns if c != "html"],
        "pos",
        F.col("_link.href").alias("href"),
        fn.clean_text(unescape(F.col("_link.text"))).alias("text"),
    )


def link_titles(html: Column) -> Column:
    """Titles of a page's flat list links, in order, as an array."""
    return F.transform(_all(html, LINK_ITEM, 2), lambda t: fn.clean_text(unescape(t)))


def extract_titles(pages: DataFrame) -> DataFrame:
    """Article list page -> (position, title, id); links without an id are left out."""
    rows = pages.select(
        *[c for c in pages.columns if c != "html"],
        F.posexplode(_all(F.col("html"), TITLE_LINK, 0)).alias("pos", "_a"),
    )
    call = _found(F.col("_a"), r'onclick="([^"]*)"')
    return rows.select(
        *[c for c in rows.columns if c != "_a"],
        text_of(F.col("_a")).alias("title"),
        fn.id_from_call(unescape(call)).alias("id"),
    ).filter("id is not null")


# Where an article's parts are found, per page layout.
LAYOUTS = {
    "board": {
        "title": r'(?s)<div[^>]*class="title"[^>]*>\s*<[^>]*data-blockcontent[^>]*>(.*?)</',
        "date": r'(?s)<div[^>]*class="date"[^>]*>\s*<span[^>]*>(.*?)</span>',
        "content": r'(?s)<div[^>]*class="content"[^>]*data-blockcontent[^>]*>(.*)</div>\s*<!-- /content -->',
        "files": r'(?s)<div[^>]*class="(?:board-files|attach-file)"[^>]*>(.*?)</div>',
    },
    "article": {
        "title": r"(?s)<h1[^>]*>(.*?)</h1>",
        "date": r"(?s)<time[^>]*>(.*?)</time>",
        "content": r"(?s)<article[^>]*>(.*?)</article>",
        "files": r"(?s)<nav[^>]*>(.*?)</nav>",
    },
}
ANCHOR = r'(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
FRAME = r'(?s)<iframe[^>]*src="([^"]*)"'


def extract_article(
    pages: DataFrame, *, base_url: Column | str, scraped_at: datetime | Column, layout: str = "article"
) -> DataFrame:
    """Page -> article record: title, date, body, attachments, videos. A bad or missing date becomes `scraped_at`."""
    parts = LAYOUTS[layout]
    html = F.col("html")
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    content = fn.clean_text(F.coalesce(_found(html, parts["content"]), F.lit("")))
    blocks = F.array_join(_all(html, parts["files"]), "")
    links = F.arrays_zip(_all(blocks, ANCHOR, 1).alias("href"), _all(blocks, ANCHOR, 2).alias("name"))

    def attachment(link: Column) -> Column:
        href = link["href"]
        url = F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(base, href))
        return F.struct(text_of(link["name"]).alias("name"), url.alias("url"))

    date = fn.parse_datetime_or(text_of(F.coalesce(_found(html, parts["date"]), F.lit(""))), scraped_at)
    return pages.select(
        F.col("page_id").alias("id"),
        F.coalesce(text_of(_found(html, parts["title"])), F.lit("")).alias("title"),
        fn.iso_local(date).alias("post_date"),
        "url",
        content.alias("content_html"),
        F.transform(links, attachment).alias("attachments"),
        F.filter(_all(content, FRAME), lambda src: src != "").alias("videos"),
        fn.iso_local(fn.moment(scraped_at)).alias("scraped_at"),
    )


def extract_paging(pages: DataFrame) -> DataFrame:
    """Total count, shown range, current page and number of pages; 0, '' and 1 where they are missing."""
    html = F.col("html")
    total = F.coalesce(_found(html, r'data-totalcount="([0-9]+)"').try_cast("bigint"), F.lit(0))
    shown = fn.clean_text(
        F.coalesce(_found(html, r'(?s)class="current_range"[^>]*>\s*<span[^>]*>(.*?)</span>'), F.lit(""))
    )
    page = F.coalesce(_found(html, r'<li[^>]*class="on"[^>]*>\s*([0-9]+)\s*</li>').try_cast("int"), F.lit(1))
    bounds = fn.rank_range(shown)
    return pages.select(
        *[c for c in pages.columns if c != "html"],
        total.cast("bigint").alias("total_count"),
        shown.alias("current_range"),
        bounds["lo"].alias("range_lo"),
        bounds["hi"].alias("range_hi"),
        page.alias("current_page"),
        fn.total_pages(total).alias("total_pages"),
    )


def list_fingerprints(list_pages: DataFrame) -> DataFrame:
    """md5 of each saved list version's titles in order."""
    return list_pages.select("list_key", "page_id", fn.ordered_fingerprint(link_titles(F.col("html"))).alias("fingerprint"))
