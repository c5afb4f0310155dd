"""The ranking data sets, derived lazily from the given tables.

No view sorts or numbers a whole group: an observation carries the rank the
list showed, as a scraped row does, so a view costs the joins it needs and
nothing else. SQL twins are in rankmill/catalog/sql_views.py.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill.functions import instant_of, seconds, thousands
from rankmill.operators.aggregates import population_cube
from rankmill.operators.windows import distinct_on_key
from rankmill.schemas import RANKING_KEY, TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """The same table as a file stream; the path pattern takes one file or a folder of files."""
    reader = spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def observed_at() -> Column:
    """Order date with a minute of the day, so that a day holds more than one point."""
    return F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))


def latest_observation(spark: SparkSession, sf_dir: str) -> datetime:
    """as_of of obs and of everything built on it: one aggregate over two columns."""
    return table(spark, sf_dir, "orders").agg(F.max(observed_at())).first()[0]


def latest_event(spark: SparkSession, sf_dir: str) -> datetime:
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer x nation x region: who is ranked, on which server, in which class."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_nationkey", "r_name", "c_mktsegment", "c_name")
    )


def observe(orders: DataFrame, people: DataFrame) -> DataFrame:
    """Orders as scraped observations; also used on a stream of orders."""
    change = (F.col("o_orderkey") % 7 - 3).cast("int")
    power = F.floor("o_totalprice").cast("bigint")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("obs_id"),
        F.greatest(F.lit(1), F.floor((600000 - power) / 100)).cast("int").alias("rank_position"),
        change.alias("change_amount"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("none").alias("change_type"),
        F.col("r_name").alias("server_name"),
        F.col("c_name").alias("character_name"),
        F.col("c_mktsegment").alias("class_name"),
        power.alias("power_value"),
        (1 + F.col("o_orderkey") % 3).cast("int").alias("div"),
        observed_at().alias("retrieved_at"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe(table(spark, sf_dir, "orders"), characters(spark, sf_dir))


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_state(obs(spark, sf_dir))


def latest_state(observations: DataFrame) -> DataFrame:
    return distinct_on_key(
        observations, RANKING_KEY, [F.desc("retrieved_at"), F.desc("obs_id")]
    ).drop("obs_id")


def scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as the page shows them: text with separators, blanks, gaps and broken cells."""
    key = F.col("obs_id")
    amount = F.abs("change_amount").cast("string")
    change = (
        F.when(key % 11 == 0, "-")
        .when(key % 11 == 1, "new")
        .when(key % 11 == 2, "1,234")
        .when(key % 101 == 3, "abc")
        .otherwise(amount)
    )
    css = (
        F.when(F.col("change_type") == "up", "change up")
        .when(F.col("change_type") == "down", "change down")
        .otherwise("change")
    )
    return obs(spark, sf_dir).select(
        "obs_id",
        (F.floor(key / 60) * 3 + key % 3).alias("page_seq"),
        F.floor(key % 60 / 3).cast("int").alias("pos"),
        F.when(key % 53 == 0, "n/a").otherwise(thousands("rank_position", fv.RANK_SUFFIX)).alias("rank"),
        change.alias("change"),
        css.alias("css"),
        "change_type",
        F.concat(F.lit(" "), F.col("server_name"), F.lit("  ")).alias("server"),
        F.when(key % 97 == 0, fv.PLACEHOLDER_NAME).otherwise(F.col("character_name")).alias("character"),
        F.concat(F.lit("\t"), F.col("class_name")).alias("class"),
        thousands("power_value").alias("power"),
        "div",
        F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss").alias("retrieved_text"),
    )


def _block(tag: str, css: str, *inner: Column) -> Column:
    return F.concat(F.lit(f'<{tag} class="{css}">'), *inner, F.lit(f"</{tag}>"))


def _item_markup(row: Column) -> Column:
    def dl(*inner: Column) -> Column:
        return F.concat(F.lit("<dl>"), *inner, F.lit("</dl>"))

    def dd(text: Column) -> Column:
        return F.concat(F.lit("<dd>"), text, F.lit("</dd>"))

    change = F.concat(F.lit('<dd class="'), row["css"], F.lit('">'), row["change"], F.lit("</dd>"))
    named = F.concat(F.lit('<dd data-charactername="'), row["character"], F.lit('">'), row["character"], F.lit("</dd>"))
    cells = [
        dl(F.lit("<dt>"), row["rank"], F.lit("</dt>"), change),
        dl(dd(row["server"])),
        dl(named),
        dl(dd(row["class"])),
        dl(dd(row["power"])),
    ]
    return _block("li", "item", F.lit("<div>"), *cells, F.lit("</div>"))


def rank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped rows rendered back into saved list pages of at most 20 rows of one rank type.

    Some pages are of the other kinds: no data, name not found, empty, interstitial.
    """
    row = F.struct("pos", "rank", "change", "css", "server", "character", "class", "power")
    # in as many parts as the session asks for: merged by their few bytes, they'd leave the work on the pages to few tasks
    rows = scraped(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_seq")
    pages = rows.groupBy("page_seq").agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.min_by("character", "pos").alias("search_name"),
        F.trim(F.min_by("server", "pos")).alias("search_server"),
        F.max("retrieved_text").alias("page_time"),
    )
    seq = F.col("page_seq")
    low, high = (seq * 20 + 1), (seq * 20 + F.size("rows"))
    pager = F.concat(
        F.lit('<div class="pager" data-mm-paging data-totalcount="'),
        (seq * 20 + 1007).cast("string"),
        F.lit('"><div class="current_range"><span> '),
        thousands(low),
        F.lit("위 ~ "),
        thousands(high),
        F.lit('위 </span></div><ul class="pagination"><li>1</li><li class="on">'),
        (seq % 10 + 1).cast("string"),
        F.lit("</li></ul></div>"),
    )
    listed = F.array_join(F.transform("rows", _item_markup), "")
    modal = _block(
        "div",
        "modal_inner",
        F.lit('<div class="modal_header"><div class="logo"></div></div><div class="modal_body"><div class="message">'),
        F.lit(" ".join(fv.NOT_FOUND_PHRASES)),
        F.lit('</div></div><div class="button_area"><button class="confirm_button">OK</button></div>'),
    )
    body = (
        F.when(seq % 50 == 7, F.lit('<ul class="list"></ul><div class="no_data">none</div>'))
        .when(seq % 50 == 13, modal)
        .when(seq % 50 == 21, F.lit('<ul class="list"></ul>'))
        .when(seq % 50 == 33, F.lit("<p>checking</p>"))
        .otherwise(F.concat(_block("ul", "list", listed), pager))
    )
    title = F.when(seq % 50 == 33, fv.CHALLENGE_TITLES[1]).otherwise("Ranking")
    return pages.select(
        "page_seq",
        (1 + seq % 3).cast("int").alias("div"),
        "search_server",
        "search_name",
        F.col("page_time").cast("timestamp_ntz").alias("page_time"),
        F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), body, F.lit("</body></html>")).alias(
            "html"
        ),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One population snapshot per month of observations."""
    monthly = obs(spark, sf_dir).select(
        F.trunc("retrieved_at", "month").alias("date"), "server_name", "class_name"
    )
    return population_cube(monthly, extra_keys=["date"])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(table(spark, sf_dir, "events"))


# event type -> request state, and user number -> server
EVENT_STATUS = {
    "click": "pending",
    "view": "processing",
    "purchase": "completed",
    "error": "failed",
    "signup": "timeout",
}
REQUEST_SERVERS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def as_requests(events: DataFrame) -> DataFrame:
    """Events as request records; also used on a stream of events."""
    key = F.col("event_id")
    status = F.lit(None).cast("string")
    for event_type, state in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == event_type, state).otherwise(status)
    took = F.floor("value").cast("int")
    ended = F.col("ts") + seconds(took * 2)
    base = events.select(
        F.concat(F.lit("req-"), F.lpad(key.cast("string"), 12, "0")).alias("request_id"),
        F.element_at(F.array(*map(F.lit, REQUEST_SERVERS)), (F.col("user_id") % 5 + 1).cast("int")).alias("server"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("character_name"),
        status.alias("status"),
        (key % 10).cast("int").alias("priority"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + seconds(took)).alias("begun"),
        ended.alias("ended"),
        F.when(key % 4 == 0, F.col("props")).otherwise(
            F.concat(
                F.lit('{"success": true, "message": "found", "from_cache": '),
                F.when(key % 3 == 0, "true").otherwise("false"),
                F.lit(', "data": '),
                F.when(key % 8 == 1, "null").otherwise(F.col("props")),
                F.lit("}"),
            )
        ).alias("answer"),
        (key % 2 == 0).alias("retried_out"),
        (key % 5).cast("int").alias("retry_count"),
    )
    state = F.col("status")
    return base.select(
        "request_id",
        "server",
        "character_name",
        "status",
        "priority",
        "created_at",
        F.when(state.isin("processing", "completed", "timeout"), F.col("begun")).alias("started_at"),
        F.when(
            state.isin("completed", "timeout") | ((state == "failed") & ~F.col("retried_out")), F.col("ended")
        ).alias("completed_at"),
        F.when(state == "completed", F.col("answer")).alias("result"),
        F.when(state == "failed", "No result returned").alias("error_message"),
        "retry_count",
        F.lit(3).alias("max_retries"),
        F.lit(fv.PROCESSING_SECONDS).alias("timeout_seconds"),
    )


def with_event_time(frame: DataFrame, column: str, name: str = "event_time") -> DataFrame:
    """Adds the instant of a local wall-clock column, as watermarks need it."""
    return frame.withColumn(name, instant_of(F.col(column)))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages with the list they belong to (their host)."""
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("list_key"), "page_id", "url", "html"
    )


def log_events(events: DataFrame) -> DataFrame:
    """Events as log lines with a level; some warning lines mention both levels."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING")
    level = F.coalesce(level, F.lit("INFO"))
    note = F.when((level == "WARNING") & (F.col("event_id") % 7 == 0), " after ERROR").otherwise("")
    return events.select(
        F.col("event_id").alias("line_no"),
        F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.lit(" - "),
            level,
            F.lit(" - "),
            F.col("event_type"),
            F.lit(" user "),
            F.col("user_id").cast("string"),
            note,
        ).alias("line"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(table(spark, sf_dir, "events"))


def observe_activity(orders: DataFrame, people: DataFrame) -> DataFrame:
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("task_id"),
        F.concat(F.lit("worker-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("worker_id"),
        F.col("r_name").alias("server_name"),
        F.col("c_name").alias("character_name"),
        F.floor(F.col("o_orderkey") / 200).alias("batch_id"),
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "P", "pending")
        .otherwise("saved")
        .alias("outcome"),
        observed_at().alias("logged_at"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl activity: which worker handled which name, in which batch and with what outcome."""
    return observe_activity(table(spark, sf_dir, "orders"), characters(spark, sf_dir))
