"""Column functions over whole views."""

from pyspark.sql import functions as F

from rankmill import functions as fn
from rankmill.catalog.registry import query

PARSED = "TRY_CAST(replace(replace({0}, ',', ''), '@RANK_SUFFIX@', '') AS {1})"
DIGITS = "coalesce(TRY_CAST(regexp_extract({0}, '([0-9]+)', 1) AS INTEGER), 0)"
THOUSANDS = "format('{:,}', %s)"


def half_even(top: str, bottom: str) -> str:
    """Whole-number division rounded half-even, in SQL on wide integers."""
    top, bottom = f"CAST({top} AS HUGEINT)", f"CAST({bottom} AS HUGEINT)"
    whole, rest = f"({top} // {bottom})", f"({top} % {bottom})"
    return (
        f"CAST({whole} + CASE WHEN {rest} * 2 > {bottom} OR ({rest} * 2 = {bottom} AND {whole} % 2 = 1) "
        f"THEN 1 ELSE 0 END AS BIGINT)"
    )


@query(
    "parse_rank_power",
    f"SELECT obs_id, {PARSED.format('rank', 'INTEGER')} AS rank_position, "
    f"{PARSED.format('power', 'BIGINT')} AS power_value FROM scraped",
)
def _(i):
    return i.scraped.select(
        "obs_id",
        fn.parse_rank_power(F.col("rank"), "int").alias("rank_position"),
        fn.parse_rank_power(F.col("power")).alias("power_value"),
    )


@query(
    "parse_change_digits",
    f"SELECT obs_id, CASE WHEN change IN ('-', 'new') THEN 0 ELSE {DIGITS.format('change')} END AS change_amount FROM scraped",
)
def _(i):
    return i.scraped.select("obs_id", fn.parse_change_digits(F.col("change")).alias("change_amount"))


@query(
    "parse_change_plain",
    "SELECT obs_id, CASE WHEN change = '-' THEN 0 ELSE TRY_CAST(replace(change, ',', '') AS INTEGER) END AS change_amount FROM scraped",
)
def _(i):
    return i.scraped.select("obs_id", fn.parse_change_plain(F.col("change")).alias("change_amount"))


@query(
    "parse_change_isdigit",
    """SELECT obs_id, CASE WHEN NOT regexp_matches(change, '^[0-9]+$') THEN 0
              WHEN change_type = 'up' THEN CAST(TRY_CAST(change AS INTEGER) AS INTEGER)
              WHEN change_type = 'down' THEN -TRY_CAST(change AS INTEGER) ELSE 0 END AS change_amount FROM scraped""",
)
def _(i):
    return i.scraped.select(
        "obs_id", fn.parse_change_isdigit(F.col("change"), F.col("change_type")).alias("change_amount")
    )


@query(
    "signed_change",
    """SELECT obs_id, CASE WHEN change_type = 'down' THEN -abs(n) ELSE n END AS service_change,
              CASE WHEN change_type = 'down' THEN -n ELSE abs(n) END AS batch_change
       FROM (SELECT obs_id, change_type, CASE WHEN change = '-' THEN 0
                    ELSE TRY_CAST(replace(change, ',', '') AS INTEGER) END AS n FROM scraped)""",
)
def _(i):
    n, kind = fn.parse_change_plain(F.col("change")), F.col("change_type")
    return i.scraped.select(
        "obs_id",
        fn.signed_change(n, kind).alias("service_change"),
        fn.signed_change(n, kind, "batch").alias("batch_change"),
    )


@query(
    "change_type_of",
    """SELECT obs_id, CASE WHEN css LIKE '% up' THEN 'up' WHEN css LIKE '% down' THEN 'down' ELSE 'none' END AS service_type,
              CASE WHEN css LIKE '% up' THEN 'up' ELSE 'down' END AS batch_type FROM scraped""",
)
def _(i):
    css = F.col("css")
    return i.scraped.select(
        "obs_id", fn.change_type_of(css).alias("service_type"), fn.change_type_of(css, "batch").alias("batch_type")
    )


@query(
    "thousands",
    f"SELECT obs_id, {THOUSANDS % 'rank_position'} || '@RANK_SUFFIX@' AS rank, {THOUSANDS % 'power_value'} AS power, "
    f"{THOUSANDS % 'power_value'} || '@PERSON_SUFFIX@' AS persons FROM obs",
)
def _(i):
    return i.obs.select(
        "obs_id",
        fn.thousands(F.col("rank_position"), "위").alias("rank"),
        fn.thousands(F.col("power_value")).alias("power"),
        fn.thousands(F.col("power_value"), " 명").alias("persons"),
    )


_TENTHS = half_even("v", "100000")
_KILO = half_even("v", "1000")


@query(
    "abbrev_km",
    f"""SELECT obs_id, CASE WHEN v >= 1000000 THEN CAST({_TENTHS} // 10 AS VARCHAR) || '.' || CAST({_TENTHS} % 10 AS VARCHAR) || 'M'
              WHEN v >= 1000 THEN CAST({_KILO} AS VARCHAR) || 'K' ELSE CAST(v AS VARCHAR) END AS short
        FROM (SELECT obs_id, power_value * (obs_id % 9) + obs_id % 900 AS v FROM obs)""",
)
def _(i):
    value = F.col("power_value") * (F.col("obs_id") % 9) + F.col("obs_id") % 900
    return i.obs.select("obs_id", fn.abbrev_km(value).alias("short"))


@query(
    "relative_age",
    """SELECT obs_id, CASE WHEN t IS NULL THEN '@NO_TIME_LABEL@' WHEN age < 60 THEN CAST(age AS VARCHAR) || '@SECONDS_AGO@'
              WHEN age < 3600 THEN CAST(age // 60 AS VARCHAR) || '@MINUTES_AGO@' ELSE CAST(age // 3600 AS VARCHAR) || '@HOURS_AGO@' END AS age
       FROM (SELECT obs_id, t, CAST(epoch(as_of) - epoch(t) AS BIGINT) AS age
             FROM (SELECT obs_id, CASE WHEN change_type <> 'none' THEN retrieved_at END AS t FROM obs), now_at)""",
)
def _(i):
    then = F.when(F.col("change_type") != "none", F.col("retrieved_at"))
    return i.obs.select("obs_id", fn.relative_age(then, i.as_of).alias("age"))


@query(
    "ellipsize",
    """SELECT obs_id, CASE WHEN length(n) > 18 THEN substring(n, 1, 15) || '...' ELSE n END AS name
       FROM (SELECT obs_id, CASE WHEN div = 1 THEN character_name ELSE character_name || class_name END AS n FROM obs)""",
)
def _(i):
    name = F.when(F.col("div") == 1, F.col("character_name")).otherwise(F.concat("character_name", "class_name"))
    return i.obs.select("obs_id", fn.ellipsize(name).alias("name"))


@query(
    "left_n",
    "SELECT page_id, substring(html, 1, 50) AS h50, substring(html, 1, 100) AS h100, substring(html, 1, 200) AS h200 FROM pages",
)
def _(i):
    html = F.col("html")
    return i.table("pages").select(
        "page_id", *[fn.left_n(html, n).alias(f"h{n}") for n in (50, 100, 200)]
    )


@query(
    "parse_datetime_or",
    """SELECT obs_id, coalesce(try_strptime(t, '%Y.%m.%d %H:%M'), try_strptime(t, '%Y-%m-%d %H:%M:%S'), as_of) AS parsed
       FROM (SELECT obs_id, CASE div WHEN 1 THEN retrieved_text WHEN 2 THEN strftime(CAST(retrieved_text AS TIMESTAMP), '%Y.%m.%d %H:%M')
                    ELSE 'soon' END AS t FROM scraped), now_at""",
)
def _(i):
    stamp = F.col("retrieved_text")
    dotted = F.date_format(stamp.cast("timestamp_ntz"), "yyyy.MM.dd HH:mm")
    text = F.when(F.col("div") == 1, stamp).when(F.col("div") == 2, dotted).otherwise("soon")
    return i.scraped.select("obs_id", fn.parse_datetime_or(text, i.as_of).alias("parsed"))


@query(
    "to_local_zone",
    """SELECT obs_id, retrieved_at + INTERVAL 9 HOUR AS from_utc,
              CASE WHEN div = 1 THEN retrieved_at WHEN div = 2 THEN retrieved_at + INTERVAL 9 HOUR ELSE retrieved_at + INTERVAL 11 HOUR END AS parsed,
              CASE WHEN div = 1 THEN NULL WHEN div = 2 THEN retrieved_at + INTERVAL 9 HOUR ELSE retrieved_at + INTERVAL 11 HOUR END AS parsed_strict
       FROM obs""",
)
def _(i):
    stamp = F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("div") == 1, "").when(F.col("div") == 2, "+00:00").otherwise("-02:00")
    text = F.concat(stamp, zone)
    return i.obs.select(
        "obs_id",
        fn.to_local_zone(F.col("retrieved_at")).alias("from_utc"),
        fn.parse_to_local(text).alias("parsed"),
        fn.parse_to_local(text, strict=True).alias("parsed_strict"),
    )


@query(
    "day_start",
    "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_start FROM events",
)
def _(i):
    return i.table("events").select("event_id", fn.day_start(F.col("ts")).alias("day_start"))


@query(
    "rank_range",
    """SELECT page_seq, page_seq * 20 + 1 AS lo, page_seq * 20 + n_rows AS hi FROM page_heads WHERE kind = 'rows'
       UNION ALL SELECT page_seq, NULL, NULL FROM page_heads WHERE kind <> 'rows'""",
)
def _(i):
    bounds = fn.rank_range(F.col("html"))
    return i.rank_pages.select("page_seq", bounds["lo"].alias("lo"), bounds["hi"].alias("hi"))


@query(
    "id_from_call",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS id FROM events""",
)
def _(i):
    user = F.col("user_id").cast("string")
    call = F.when(F.col("event_type") == "view", F.concat(F.lit("open("), user, F.lit(")"))).otherwise(
        F.concat(F.lit("detail("), user, F.lit(", 'x')"))
    )
    return i.table("events").select("event_id", fn.id_from_call(call).alias("id"))


@query(
    "total_pages",
    """SELECT server_name, count(*) AS rows, CAST((count(*) + 19) // 20 AS BIGINT) AS pages FROM ranking GROUP BY server_name""",
)
def _(i):
    counts = i.ranking.groupBy("server_name").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("pages", fn.total_pages(F.col("rows")))


@query(
    "absolute_url",
    r"""SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://site.example' || href END AS url
        FROM (SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos
              FROM (SELECT page_id, list_concat([url], regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1)) AS hrefs FROM pages))""",
)
def _(i):
    found = F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">[^<]*</a></li>'), F.lit(1))
    links = i.table("pages").select("page_id", F.posexplode(F.concat(F.array("url"), found)).alias("pos", "href"))
    return links.select("page_id", "pos", fn.absolute_url(F.col("href"), "https://site.example").alias("url"))


@query(
    "json_roundtrip",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'broken ' || props ELSE CAST(json(props) AS VARCHAR) END AS text FROM events",
)
def _(i):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), "props")).otherwise(F.col("props"))
    return i.table("events").select("event_id", fn.json_roundtrip(text).alias("text"))


@query(
    "json_path_default",
    """SELECT request_id, coalesce(json_extract_string(result, '$.data.k'), '-') AS k,
              coalesce(json_extract_string(result, '$.message'), '') AS message
       FROM requests WHERE result IS NOT NULL""",
)
def _(i):
    result = F.col("result")
    return i.requests.filter(result.isNotNull()).select(
        "request_id",
        fn.json_path_default(result, "$.data.k", "-").alias("k"),
        fn.json_path_default(result, "$.message", "").alias("message"),
    )


@query(
    "status_symbol",
    """SELECT server_name, status, CASE status WHEN 'running' THEN '@STATUS_SYMBOLS.running@' WHEN 'waiting' THEN '@STATUS_SYMBOLS.waiting@' WHEN 'error' THEN '@STATUS_SYMBOLS.error@' ELSE '❓' END AS symbol,
              '❓' AS other FROM crawler_status""",
)
def _(i):
    from rankmill.plans.jobs import crawler_status

    return crawler_status(i.activity).select(
        "server_name",
        "status",
        fn.status_symbol(F.col("status")).alias("symbol"),
        fn.status_symbol(F.col("server_name")).alias("other"),
    )


@query(
    "normalize_change",
    f"""SELECT obs_id, CASE WHEN change = '-' OR lower(change) = 'new' THEN 0 ELSE {DIGITS.format('change')} END AS change,
               coalesce(CASE WHEN change_type <> 'none' THEN change_type END, 'none') AS change_type FROM scraped""",
)
def _(i):
    kind = F.when(F.col("change_type") != "none", F.col("change_type"))
    return i.scraped.select(
        "obs_id",
        fn.normalize_change(F.col("change")).alias("change"),
        fn.normalize_change_type(kind).alias("change_type"),
    )


@query(
    "compose_key",
    "SELECT obs_id, server_name || '_' || character_name || '_' || CAST(div AS VARCHAR) AS character_key FROM obs",
)
def _(i):
    return i.obs.select(
        "obs_id", fn.compose_key(F.col("server_name"), F.col("character_name"), F.col("div")).alias("character_key")
    )


@query(
    "blank_cells",
    """SELECT page_id, replace('<tr><td></td><td>' || url || '</td><td></td></tr>', '<td></td>', '<td>&nbsp;</td>') AS html FROM pages""",
)
def _(i):
    row = F.concat(F.lit("<tr><td></td><td>"), "url", F.lit("</td><td></td></tr>"))
    return i.table("pages").select("page_id", fn.blank_cells(row).alias("html"))


@query(
    "hms",
    """SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0')
              || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed
       FROM (SELECT event_id, CAST(floor(value * 97) AS BIGINT) AS s FROM events)""",
)
def _(i):
    return i.table("events").select("event_id", fn.hms(F.floor(F.col("value") * 97)).alias("elapsed"))


@query(
    "clean_text",
    "SELECT obs_id, trim(server) AS server, trim(class, chr(9) || ' ') AS class FROM scraped",
)
def _(i):
    return i.scraped.select(
        "obs_id", fn.clean_text(F.col("server")).alias("server"), fn.clean_text(F.col("class")).alias("class")
    )


@query(
    "round2_even",
    f"""SELECT server_name, class_name, {half_even('n * 10000', 't')} / 100.0 AS pct, {half_even('n * 1000', 't')} AS persons
        FROM (SELECT server_name, class_name, count(*) AS n, sum(count(*)) OVER () AS t FROM ranking GROUP BY ALL)""",
)
def _(i):
    counts = i.ranking.groupBy("server_name", "class_name").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("t", i.ranking.agg(F.count(F.lit(1))).scalar())
    return counts.select(
        "server_name",
        "class_name",
        fn.percent_half_even(F.col("n"), F.col("t")).alias("pct"),
        fn.rescale_half_even(F.col("n"), F.col("t"), F.lit(1000)).alias("persons"),
    )


@query(
    "format_ts",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' KST' AS stamp, strftime(ts, '%Y%m%d') AS compact FROM events""",
)
def _(i):
    ts = F.col("ts")
    return i.table("events").select(
        "event_id", fn.format_ts(ts).alias("stamp"), fn.compact_date(ts).alias("compact")
    )


@query(
    "midnight_minutes",
    """SELECT obs_id, CAST((epoch(date_trunc('day', retrieved_at) + INTERVAL 1 DAY) - epoch(retrieved_at)) // 60 AS BIGINT) AS minutes FROM obs""",
)
def _(i):
    return i.obs.select("obs_id", fn.midnight_minutes(F.col("retrieved_at")).alias("minutes"))


@query(
    "weekly_slot",
    """SELECT obs_id, isodow(retrieved_at) = 3 AND hour(retrieved_at) = 18 AND minute(retrieved_at) = 30 AS due,
              isodow(retrieved_at) = 3 AND hour(retrieved_at) = 18 AND minute(retrieved_at) = 30
              AND coalesce(CAST(done AS DATE) <> CAST(retrieved_at AS DATE), true) AS due_not_done
       FROM (SELECT obs_id, retrieved_at, CASE div WHEN 1 THEN retrieved_at WHEN 2 THEN retrieved_at - INTERVAL 1 DAY END AS done FROM obs)""",
)
def _(i):
    at = F.col("retrieved_at")
    done = F.when(F.col("div") == 1, at).when(F.col("div") == 2, at - F.expr("INTERVAL 1 DAY"))
    return i.obs.select(
        "obs_id", fn.weekly_slot(at).alias("due"), fn.weekly_slot(at, done).alias("due_not_done")
    )
