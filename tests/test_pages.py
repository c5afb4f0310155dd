"""Pages of each kind."""

from datetime import datetime

from pyspark.sql import functions as F

from rankmill.operators import filters
from rankmill.sources import pages as ps

NOW = datetime(2024, 5, 2, 12, 0, 0)


def item(rank="1위", css="", change="-", name="Ann", blocks=5):
    cells = [
        f'<dl>\n<dt> {rank} </dt><dd class="{css}"><span>{change}</span></dd></dl>',
        "<dl><dt>server</dt><dd> S1 </dd></dl>",
        f'<dl><dd data-charactername="{name}">shown</dd></dl>',
        "<dl><dd>A &amp; B</dd></dl>",
        "<dl><dd>98,765</dd></dl>",
    ]
    return f'<li class="item first"><div>{"".join(cells[:blocks])}</div></li>'


def page(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def listed(*items, extra=""):
    return f'<ul class="list">{"".join(items)}</ul>{extra}'


MODAL = (
    '<div class="modal_inner"><div class="modal_header"><div class="logo"></div></div><div class="modal_body">'
    '<div class="message">입력한 캐릭터명의\n랭킹 정보를 찾을 수 없습니다</div></div>'
    '<div class="button_area"><button class="confirm_button">OK</button></div></div>'
)


def test_items(spark):
    html = listed(
        item(css="change up", change="1,234"), item("2위", "down", "3", "Bob"), item("3위", "", "new", "Cid"),
        item(name="알수없음"), item(blocks=4), item("1,234위", "up", "", "Dan"),
    )
    rows = ps.extract_list_items(page(spark, html)).orderBy("pos").collect()
    assert [(r["rank"], r["change"], r["change_type"], r["character"]) for r in rows] == [
        ("1위", "1", "up", "Ann"), ("2위", "3", "down", "Bob"), ("3위", "0", "none", "Cid"), ("1,234위", "0", "up", "Dan"),
    ]
    assert {(r["server"], r["class"], r["power"]) for r in rows} == {("S1", "A & B", "98,765")}
    text = ps.extract_list_items(page(spark, html), "text").orderBy("pos").collect()
    assert [(r["change"], r["change_type"]) for r in text] == [("1,234", "up"), ("3", "down"), ("new", "down"), ("", "up")]
    digits = ps.extract_list_items(page(spark, html), "isdigit").orderBy("pos").collect()
    assert [r["change"] for r in digits] == ["0", "-3", "0", "0"]
    assert ps.extract_list_items(page(spark, listed(item(), extra='<div class="no_data"></div>'))).count() == 0


def test_kinds(spark):
    pages = page(
        spark, listed(item()), listed(extra='<div class="no_data"></div>'), MODAL, listed(),
        listed(item(), extra=MODAL), MODAL.replace("confirm_button", "other"),
    )
    kinds = pages.select("page_id", filters.page_kind(F.col("html")).alias("k")).orderBy("page_id").collect()
    assert [r["k"] for r in kinds] == ["rows", "no_data", "not_found", "empty", "rows", "empty"]


def test_challenge(spark):
    pages = page(spark, "<title>Just a moment...</title>" + listed(), listed(), "<p>RANKING List</p>", "<p>x</p>")
    out = pages.select("page_id", filters.challenge_page(F.col("html")).alias("c")).orderBy("page_id").collect()
    assert [r["c"] for r in out] == [True, False, False, True]


def test_paging(spark):
    full = (
        '<div class="pager" data-mm-paging data-totalcount="1041"><div class="current_range"><span> 1,001위 ~ 1,020위 </span></div>'
        '<ul class="pagination"><li>50</li><li class="on"> 51 </li></ul></div>'
    )
    rows = ps.extract_paging(page(spark, full, "<p></p>")).orderBy("page_id").collect()
    assert tuple(rows[0])[1:] == (1041, "1,001위 ~ 1,020위", 1001, 1020, 51, 53)
    assert tuple(rows[1])[1:] == (0, "", None, None, 1, 0)


def test_titles_and_fingerprints(spark):
    html = listed(
        '<li class="item"><a href="#" class="title" onclick="detail(2954, 1)"> Patch <b>one</b> </a></li>',
        '<li class="item"><a class="title">no id</a></li>',
    )
    rows = ps.extract_titles(page(spark, html)).collect()
    assert [(r["pos"], r["title"], r["id"]) for r in rows] == [(0, "Patch one", "2954")]
    lists = [["a", "b"], ["a", "b"], ["b", "a"], ["a", "b", "c"], [], ["a", "", "b"]]
    frame = spark.createDataFrame(
        [("k", n, "".join(f'<li><a href="/x">{t}</a></li>' for t in titles)) for n, titles in enumerate(lists)],
        "list_key string, page_id long, html string",
    )
    prints = [r["fingerprint"] for r in ps.list_fingerprints(frame).orderBy("page_id").collect()]
    assert prints[0] == prints[1] == prints[5] and len(set(prints)) == 4
    assert prints[4] == "d41d8cd98f00b204e9800998ecf8427e"


def test_article(spark):
    board = """<section class="view_header_wrap"><div class="title_box"><div class="title"> <span data-blockcontent>News &amp; more</span></div></div>
      <div class="date"><span>2025.05.15 09:40</span></div></section>
      <div class="content" data-blockcontent><p>body</p><iframe src="https://v/1"></iframe><iframe src=""></iframe></div><!-- /content -->
      <div class="board-files"><a href="/f.zip">File</a><a href="http://o/g.zip">Other</a></div>"""
    frame = spark.createDataFrame([(1, "u", board), (2, "u", "<p>none</p>")], "page_id long, url string, html string")
    first, second = (
        ps.extract_article(frame, base_url="https://b.example", scraped_at=NOW, layout="board").orderBy("id").collect()
    )
    assert (first["title"], first["post_date"]) == ("News & more", "2025-05-15T09:40:00+09:00")
    assert [tuple(a) for a in first["attachments"]] == [("File", "https://b.example/f.zip"), ("Other", "http://o/g.zip")]
    assert first["videos"] == ["https://v/1"]
    assert (second["title"], second["post_date"], second["content_html"], second["attachments"]) == ("", "2024-05-02T12:00:00+09:00", "", [])


def test_not_found_pages_remove_only_what_came_before(spark):
    from rankmill.plans import jobs
    from rankmill.schemas import RANKING

    found = listed(item("2위", "up", "3", "Ann"), item("3위", "up", "x", "Zed", blocks=5).replace("98,765", "n/a"))
    schema = "page_seq long, div int, search_server string, search_name string, page_time timestamp_ntz, html string"
    state = spark.createDataFrame(
        [(9, 0, "none", "S1", "Ann", "c", 5, 2, datetime(2024, 1, 1)), (9, 0, "none", "S1", "Bob", "c", 5, 1, datetime(2024, 1, 1))], RANKING
    )
    missing = (2, 1, "S1", "Ann", NOW, MODAL)
    for order, names, count in (((1, 3), [("Ann", 1), ("Bob", 1)], 1), ((3, 1), [("Bob", 1)], 2)):
        gone_at, found_at = order
        pages = spark.createDataFrame(
            [(gone_at, *missing[1:]), (found_at, 1, "S1", "Ann", NOW, found)], schema
        )
        final, report, audit, quarantine = jobs.ingest_pages(pages, state, NOW)
        assert sorted((r["character_name"], r["div"]) for r in final.collect()) == names
        assert [(r["character_list"], r["count"]) for r in audit.collect()] == [(["Ann"], count)]
        assert [(r["given"], r["saved"]) for r in report.collect()] == [(1, 1)]
        assert [r["character_name"] for r in quarantine.collect()] == ["Zed"]


def test_page_tests_are_strict(spark):
    nested = item().replace("<dl><dd>A &amp; B</dd></dl>", "<dl><dd>A<ul><li>x</li></ul></dd></dl>")
    single = listed(item(), extra="<div class='box no_data'>none</div>")
    outside = MODAL.replace("랭킹 정보를 찾을 수 없습니다", "") + "<p>랭킹 정보를 찾을 수 없습니다</p>"
    reordered = '<button class="confirm_button">OK</button>' + MODAL.replace("confirm_button", "other")
    loose = f'<div class="other">{item()}</div>'
    pages = page(
        spark, listed(nested, item("2위", name="Bob")), single, outside, reordered, loose, MODAL.replace('"', "'"),
        listed(item()).replace('"', "'").replace("'list'", "'big list'"), listed(item(), extra='<div class="no_data_x"></div>'),
    )
    kinds = pages.select("page_id", filters.page_kind(F.col("html")).alias("k")).orderBy("page_id").collect()
    assert [r["k"] for r in kinds] == ["rows", "no_data", "empty", "empty", "empty", "not_found", "rows", "rows"]
    rows = ps.extract_list_items(pages).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["character"], r["class"], r["power"]) for r in rows][:2] == [(0, "Ann", "Ax", "98,765"), (0, "Bob", "A & B", "98,765")]
    assert {r["page_id"] for r in rows} <= {0, 6, 7}


def test_answers_name_what_was_not_found(spark):
    from rankmill.plans import jobs
    from rankmill.schemas import RANKING

    old = datetime(2024, 5, 2, 11, 55)
    rows = [(d, d, "up", "S", "full", f"c{d}", 10 * d, d, old) for d in (1, 2, 3)] + [(5, 1, "down", "S", "part", "z", 7, 1, old)]
    source = [(6, -1, "down", "S", "part", "b", 8, 1, NOW), (7, 0, "none", "S", "part", "a", 9, 2, NOW)]
    asked = spark.createDataFrame([("S", "full"), ("S", "part"), ("S", "none")], "server_name string, character_name string")
    answers = jobs.character_answer(spark.createDataFrame(rows, RANKING), spark.createDataFrame(source, RANKING), NOW, asked=asked)
    got = {r["character_name"]: r.asDict() for r in answers.collect()}
    assert (got["full"]["from_cache"], got["full"]["rank_2"], got["full"]["class_3"], got["full"]["change_3"]) == (True, "2위", "c3", 3)
    assert (got["part"]["success"], got["part"]["from_cache"], got["part"]["class_1"], got["part"]["class_2"]) == (True, False, "b", "a")
    assert (got["part"]["rank_3"], got["part"]["retrieved_at_1"]) == (None, NOW)
    assert (got["none"]["success"], got["none"]["message"]) == (False, "캐릭터 'none'을(를) 서버 'S'에서 찾을 수 없습니다.")


def test_items_are_taken_out_once(spark, small):
    from rankmill import views

    pages = views.rank_pages(spark, small).select("page_seq", "html")
    plan = ps.extract_list_items(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(ps.DL) == plan.count(ps.DT) == 1
    assert plan.count("<html>") == 1  # the page isn't made again for each condition on its items


def test_pages_come_in_all_parts(spark, small):
    from rankmill import views

    pages = views.rank_pages(spark, small)
    assert pages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
