"""Sources, sinks (written by Spark to the shared folder and read back) and page extraction."""

from datetime import timedelta

from pyspark.sql import functions as F

from rankmill.catalog.aggregate_queries import SHARES, shares
from rankmill.catalog.join_queries import changes_since, state_before
from rankmill.catalog.mutation_queries import DOOMED, doomed
from rankmill.catalog.registry import query
from rankmill.operators import mutations
from rankmill.plans import jobs
from rankmill.schemas import RANKING
from rankmill.session import work_path
from rankmill.sources import pages as page_source
from rankmill.sources import readers, sinks


@query("scan_ranking", "SELECT * FROM ranking")
def _(i):
    path = work_path(i.spark, "ranking")
    i.ranking.select(*RANKING.fieldNames()).write.parquet(path)
    return readers.scan_ranking(i.spark, path)


@query("scan_staging_tsv", "SELECT rank_position, change_amount, change_type, server_name, character_name, class_name, power_value, div, retrieved_at, CAST(NULL AS VARCHAR) AS corrupt_record FROM obs")
def _(i):
    path = work_path(i.spark, "staging")
    sinks.sink_staging_tsv(i.obs, path)
    return readers.scan_staging_tsv(i.spark, path)


@query("scan_pages", "SELECT * FROM pages")
def _(i):
    return readers.scan_pages(i.spark, f"{i.sf_dir}/pages.parquet")


@query("sink_upsert_ranking", "SELECT * FROM ranking")
def _(i):
    root = work_path(i.spark, "state")
    order = [F.desc("retrieved_at"), F.desc("obs_id")]
    sinks.sink_upsert_ranking(state_before(i), root, schema=RANKING, order_by=[F.lit(0)], buckets=16)
    return sinks.sink_upsert_ranking(changes_since(i), root, schema=RANKING, order_by=order)


@query("sink_upsert_ranking_event_time", "SELECT * FROM ranking")
def _(i):
    """The changes first, and then the older state, which mustn't overwrite them."""
    root = work_path(i.spark, "state-by-time")
    order = [F.desc("retrieved_at"), F.desc("obs_id")]
    options = {"schema": RANKING, "event_time": "retrieved_at", "buckets": 16}
    sinks.sink_upsert_ranking(changes_since(i), root, order_by=order, **options)
    return sinks.sink_upsert_ranking(state_before(i), root, order_by=[F.lit(0)], **options)


@query(
    "sink_snapshot",
    """SELECT s.*, CASE WHEN class_name = 'all' THEN as_of ELSE as_of + INTERVAL 1 DAY END AS retrieved_at FROM snapshots s, now_at""",
)
def _(i):
    path = work_path(i.spark, "snapshots")
    sinks.sink_snapshot(i.snapshots.filter("class_name = 'all'"), path, i.as_of)
    sinks.sink_snapshot(i.snapshots, path, i.as_of + timedelta(days=1))
    schema = ", ".join(f"{c} {t}" for c, t in i.snapshots.dtypes) + ", retrieved_at timestamp_ntz"
    return i.spark.read.schema(schema).parquet(path).select(*i.snapshots.columns, "retrieved_at")


ENTITIES = "trim(replace(replace(replace(replace(replace(replace(%s, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))"
ARTICLE_SQL = f"""
    SELECT id, title, strftime(as_of, '%Y-%m-%dT%H:%M:%S+09:00') AS post_date, url, content_html,
           list_transform(list_zip(regexp_extract_all(nav, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1),
                                   regexp_extract_all(nav, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)),
                          lambda p: {{'name': {ENTITIES % "p[2]"}, 'url': CASE WHEN starts_with(p[1], 'http') THEN p[1] ELSE base || p[1] END}}) AS attachments,
           CAST([] AS VARCHAR[]) AS videos, strftime(as_of, '%Y-%m-%dT%H:%M:%S+09:00') AS scraped_at
    FROM article_titles, now_at"""


def articles(i):
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    return page_source.extract_article(i.table("pages"), base_url=base, scraped_at=i.as_of)


@query(
    "sink_articles_json",
    f"""SELECT id, title, post_date, CAST(to_json({{'id': id, 'title': title, 'post_date': post_date, 'url': url, 'content_html': content_html,
               'attachments': attachments, 'videos': videos, 'scraped_at': scraped_at}}) AS VARCHAR) AS contents_json, (SELECT as_of FROM now_at) AS scraped_at
        FROM ({ARTICLE_SQL})""",
)
def _(i):
    path = work_path(i.spark, "articles")
    rows = articles(i)
    for _ in range(2):  # a job that runs again writes its rows once
        sinks.sink_articles_json(rows, path, i.as_of, run="crawl")
    schema = "id bigint, title string, post_date string, contents_json string, scraped_at timestamp_ntz"
    return sinks.read_runs(i.spark, path, schema).drop("run")


@query(
    "sink_audit",
    f"""SELECT 'DELETE' AS operation_type, 'ranking' AS object_type, server_name AS object_id,
               'deleted ' || strftime(max(as_of), '%Y-%m-%d %H:%M:%S') AS details, CAST(count(*) AS INTEGER) AS count,
               [character_name] AS character_list, max(as_of) AS created_at
        FROM before_2000 SEMI JOIN ({DOOMED}) USING (server_name, character_name), now_at GROUP BY server_name, character_name""",
)
def _(i):
    path = work_path(i.spark, "history")
    rows = mutations.deleted_names(state_before(i), doomed(i))
    for _ in range(2):
        sinks.sink_audit(rows, path, i.as_of, run="cleanup")
    schema = (
        "operation_type string, object_type string, object_id string, details string, count int, "
        "character_list array<string>, created_at timestamp_ntz"
    )
    return sinks.read_runs(i.spark, path, schema).drop("run")


@query("scan_log_lines", "SELECT row_number() OVER (ORDER BY line_no) AS line_no, line FROM log_lines")
def _(i):
    path = work_path(i.spark, "log")
    sinks.sink_log(i.log_lines, path)
    return readers.scan_log_lines(i.spark, path)


@query(
    "report_rows",
    f"""SELECT row_number() OVER (ORDER BY population DESC, class_name) AS idx, class_name, population,
               format('{{:,}}', population) || '@PERSON_SUFFIX@' AS population_formatted, percentage, total_population FROM ({SHARES})""",
)
def _(i):
    return jobs.report_rows(shares(i))


ROWS = """
    FROM scraped s JOIN page_heads p USING (page_seq)
    WHERE p.kind = 'rows' AND character <> '@PLACEHOLDER_NAME@'"""


@query(
    "extract_list_items",
    f"""SELECT page_seq, p.div, pos, rank, trim(server) AS server, character, trim(class, chr(9) || ' ') AS class, power,
               CASE WHEN change IN ('-', 'new') THEN '0' ELSE coalesce(nullif(regexp_extract(change, '([0-9]+)', 1), ''), '0') END AS change,
               change_type {ROWS}""",
)
def _(i):
    pages = i.rank_pages.select("page_seq", "div", "html")
    return page_source.extract_list_items(pages)


@query(
    "extract_list_items_text",
    f"""SELECT page_seq, pos, rank, change, CASE WHEN change_type = 'up' THEN 'up' ELSE 'down' END AS change_type {ROWS}""",
)
def _(i):
    rows = page_source.extract_list_items(i.rank_pages.select("page_seq", "html"), "text")
    return rows.select("page_seq", "pos", "rank", "change", "change_type")


@query(
    "extract_links",
    f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, href, {ENTITIES % 't'} AS text FROM (
          SELECT page_id, unnest(h) AS href, unnest(x) AS t, generate_subscripts(h, 1) - 1 AS pos FROM (
            SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h,
                   regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS x FROM pages))""",
)
def _(i):
    return page_source.extract_links(i.table("pages").select("page_id", "html"))


@query("extract_article", ARTICLE_SQL)
def _(i):
    return articles(i)


@query(
    "extract_article_board",
    """SELECT page_id AS id, 'News & more ' || page_id AS title,
              CASE WHEN page_id % 5 = 0 THEN strftime(as_of, '%Y-%m-%dT%H:%M:%S+09:00')
                   ELSE '2025-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-15T09:' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || ':00+09:00' END AS post_date,
              CASE WHEN page_id % 3 = 0 THEN ['https://v.example/' || page_id] ELSE CAST([] AS VARCHAR[]) END AS videos,
              CASE WHEN page_id % 2 = 0 THEN [{'name': 'File ' || page_id, 'url': 'https://b.example/f' || page_id || '.zip'},
                                              {'name': 'Other', 'url': 'http://o.example/g.zip'}]
                   ELSE CAST([] AS STRUCT(name VARCHAR, url VARCHAR)[]) END AS attachments
       FROM pages, now_at""",
)
def _(i):
    """The board layout, rendered from the page numbers: dates (every fifth one broken), videos and attachments."""
    page = F.col("page_id")
    number = page.cast("string")
    month = F.lpad((page % 12 + 1).cast("string"), 2, "0")
    minute = F.lpad((page % 60).cast("string"), 2, "0")
    date = F.when(page % 5 == 0, "soon").otherwise(F.concat(F.lit("2025."), month, F.lit(".15 09:"), minute))
    video = F.when(page % 3 == 0, F.concat(F.lit('<iframe src="https://v.example/'), number, F.lit('"></iframe>'))).otherwise("")
    files = F.when(
        page % 2 == 0,
        F.concat(
            F.lit('<div class="board-files"><a href="/f'), number, F.lit('.zip">File '), number,
            F.lit('</a><a href="http://o.example/g.zip">Other</a></div>'),
        ),
    ).otherwise("")
    html = F.concat(
        F.lit('<div class="title"> <span data-blockcontent>News &amp; more '), number,
        F.lit('</span></div><div class="date"><span>'), date,
        F.lit('</span></div><div class="content" data-blockcontent><p>body</p>'), video,
        F.lit('<iframe src=""></iframe></div><!-- /content -->'), files,
    )
    rendered = i.table("pages").select("page_id", "url", html.alias("html"))
    found = page_source.extract_article(rendered, base_url="https://b.example", scraped_at=i.as_of, layout="board")
    return found.select("id", "title", "post_date", "videos", "attachments")


@query(
    "extract_titles",
    f"""SELECT list_key, CAST(pos AS INTEGER) AS pos, title, id FROM (
          SELECT *, row_number() OVER (PARTITION BY list_key, b ORDER BY id_no) - 1 AS pos FROM (
            SELECT list_key, page_id // 20 AS b, page_id AS id_no, CAST(page_id AS VARCHAR) AS id, title
            FROM list_pages JOIN (SELECT id AS page_id, title FROM article_titles) USING (page_id)))""",
)
def _(i):
    """List pages of up to 20 titles are rendered from the articles first, then read."""
    listed = articles(i).select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("list_key"), "id", "title"
    )
    link = F.transform(
        F.array_sort(F.collect_list(F.struct("id", "title"))),
        lambda a: F.concat(
            F.lit('<li class="item"><a class="title" onclick="detail('),
            a["id"].cast("string"),
            F.lit(', 1)"> '),
            F.replace(F.replace(F.replace(a["title"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")),
            F.lit("</a></li>"),
        ),
    )
    rendered = listed.groupBy("list_key", F.floor(F.col("id") / 20).alias("b")).agg(
        F.concat(F.lit('<ul class="list">'), F.array_join(link, ""), F.lit("</ul>")).alias("html")
    )
    return page_source.extract_titles(rendered.select("list_key", "html"))


@query(
    "extract_paging",
    """SELECT page_seq, CASE WHEN kind = 'rows' THEN page_seq * 20 + 1007 ELSE 0 END AS total_count,
              CASE WHEN kind = 'rows' THEN format('{:,}', page_seq * 20 + 1) || '위 ~ ' || format('{:,}', page_seq * 20 + n_rows) || '@RANK_SUFFIX@' ELSE '' END AS current_range,
              CASE WHEN kind = 'rows' THEN page_seq * 20 + 1 END AS range_lo, CASE WHEN kind = 'rows' THEN page_seq * 20 + n_rows END AS range_hi,
              CAST(CASE WHEN kind = 'rows' THEN page_seq % 10 + 1 ELSE 1 END AS INTEGER) AS current_page,
              CASE WHEN kind = 'rows' THEN (page_seq * 20 + 1007 + 19) // 20 ELSE 0 END AS total_pages
       FROM page_heads""",
)
def _(i):
    return page_source.extract_paging(i.rank_pages.select("page_seq", "html"))
