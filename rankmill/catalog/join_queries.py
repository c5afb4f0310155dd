"""Joins and set operations over whole views."""

from pyspark.sql import functions as F

from rankmill import views
from rankmill.catalog.registry import query
from rankmill.operators import joins, sets
from rankmill.sources import pages as page_source

def cutoff():
    return F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")

BOTTOM = """
    FROM ranking r JOIN (SELECT server_name, max(rank_position) AS m FROM ranking GROUP BY server_name) x
    ON r.server_name = x.server_name AND rank_position = m"""


def state_before(i):
    return views.latest_state(i.obs.filter(F.col("retrieved_at") < cutoff()))


def changes_since(i):
    return i.obs.filter(F.col("retrieved_at") >= cutoff())


@query("bottom_per_server", f"SELECT r.* {BOTTOM}")
def _(i):
    return joins.bottom_per_server(i.ranking)


@query(
    "stale_not_in",
    """SELECT r.server_name, r.character_name, max(retrieved_at) AS last_retrieved FROM ranking r, now_at
       WHERE character_name NOT IN (SELECT character_name FROM ranking s, now_at n
                                    WHERE s.server_name = r.server_name AND s.retrieved_at >= date_trunc('day', n.as_of))
       GROUP BY ALL""",
)
def _(i):
    return joins.stale_not_in(i.ranking, i.as_of)


def _articles(i):
    return page_source.extract_article(
        i.table("pages"), base_url=F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), scraped_at=i.as_of
    )


def _is_stored():
    return F.startswith("url", F.lit("https:"))


@query(
    "new_titles",
    """SELECT id, title FROM article_titles WHERE title NOT IN (SELECT title FROM article_titles WHERE starts_with(url, 'https:'))""",
)
def _(i):
    articles = _articles(i)
    return joins.new_titles(articles, articles.filter(_is_stored())).select("id", "title")


@query(
    "decode_dims",
    """SELECT c_custkey, c_nationkey,
              CASE c_nationkey WHEN 1 THEN '데이안' WHEN 2 THEN '아이라' WHEN 3 THEN '던컨' WHEN 4 THEN '알리사'
                   WHEN 5 THEN '메이븐' WHEN 6 THEN '라사' WHEN 7 THEN '칼릭스' ELSE '데이안' END AS decoded_server,
              CASE WHEN c_nationkey BETWEEN 1 AND 7 THEN c_nationkey END AS decoded_server_id,
              CASE t WHEN 1 THEN '@RANK_TYPE_NAMES.1@' WHEN 2 THEN '@RANK_TYPE_NAMES.2@' WHEN 3 THEN '@RANK_TYPE_NAMES.3@' ELSE '타입' || CAST(t AS VARCHAR) END AS rank_type_name,
              CASE WHEN t BETWEEN 1 AND 3 THEN t END AS decoded_div
       FROM (SELECT c_custkey, c_nationkey, CAST(c_custkey % 5 AS INTEGER) AS t FROM customer)""",
)
def _(i):
    from rankmill import fixed_values as fv
    from rankmill.functions import lookup

    people = i.table("customer").select(
        "c_custkey",
        "c_nationkey",
        F.coalesce(lookup(fv.SERVER_NAMES, F.col("c_nationkey")), F.lit("elsewhere")).alias("shown"),
        (F.col("c_custkey") % 5).cast("int").alias("t"),
    )
    return joins.decode_dims(people, "c_nationkey", "shown", "t").drop("shown", "t")


@query(
    "updated_today_semi",
    """SELECT DISTINCT server_name, character_name FROM ranking r, now_at WHERE EXISTS (
         SELECT 1 FROM ranking s, now_at n WHERE s.server_name = r.server_name AND s.character_name = r.character_name
         AND s.retrieved_at >= date_trunc('day', n.as_of))""",
)
def _(i):
    keys = i.ranking.select("server_name", "character_name").distinct()
    return joins.updated_today_semi(keys, i.ranking, i.as_of)


@query(
    "open_request_within_5min",
    """SELECT a.request_id, a.server, a.character_name, a.created_at,
              arg_max(b.request_id, {'t': b.created_at, 'r': b.request_id}) AS open_request_id
       FROM requests a LEFT JOIN requests b ON a.server = b.server AND a.character_name = b.character_name
            AND b.status IN ('pending', 'processing') AND b.created_at > a.created_at - INTERVAL 5 MINUTE
            AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.request_id < a.request_id))
       GROUP BY ALL""",
)
def _(i):
    return joins.open_request_within(i.requests, i.requests)


@query(
    "population_by_recheck",
    """SELECT b.server_name, b.character_name, least(b.rank_position, coalesce(f.rank_position, b.rank_position)) AS population
       FROM (SELECT r.* FROM before_2000 r JOIN (SELECT server_name, max(rank_position) AS m FROM before_2000 GROUP BY server_name) x
             ON r.server_name = x.server_name AND rank_position = m) b
       LEFT JOIN (SELECT server_name, character_name, min(rank_position) AS rank_position FROM since_2000 GROUP BY ALL) f
       ON b.server_name = f.server_name AND b.character_name = f.character_name""",
)
def _(i):
    return joins.population_by_recheck(joins.bottom_per_server(state_before(i)), changes_since(i))


@query(
    "reconcile_saved",
    """SELECT batch_id, count(*) AS given, count(*) FILTER (r.retrieved_at >= o.batch_time - INTERVAL 60 SECOND) AS saved,
              count(*) <> count(*) FILTER (r.retrieved_at >= o.batch_time - INTERVAL 60 SECOND) AS mismatch
       FROM (SELECT character_name, server_name, div, CAST(obs_id // 1000 AS BIGINT) AS batch_id,
                    retrieved_at + INTERVAL 30 DAY AS batch_time FROM obs) o
       LEFT JOIN ranking r USING (character_name, server_name, div) GROUP BY batch_id""",
)
def _(i):
    given = i.obs.select(
        "character_name",
        "server_name",
        "div",
        F.floor(F.col("obs_id") / 1000).alias("batch_id"),
        (F.col("retrieved_at") + F.expr("INTERVAL 30 DAYS")).alias("batch_time"),
    )
    return joins.reconcile_saved(given, i.ranking)


@query(
    "class_category",
    """SELECT character_name, class_name, CASE WHEN class_name = '궁수' THEN 'archer' WHEN class_name = '전사' THEN 'melee' ELSE 'none' END AS category,
              CASE WHEN class_name = '궁수' THEN '#7DCFA9' WHEN class_name = '전사' THEN '#F5B5B0' ELSE '#607D8B' END AS colour
       FROM (SELECT character_name, CASE class_name WHEN 'MACHINERY' THEN '궁수' WHEN 'BUILDING' THEN '전사' ELSE class_name END AS class_name FROM ranking)""",
)
def _(i):
    name = F.col("class_name")
    rows = i.ranking.select(
        "character_name",
        F.when(name == "MACHINERY", "궁수").when(name == "BUILDING", "전사").otherwise(name).alias("class_name"),
    )
    return joins.class_category(rows)


@query("latest_date_rows", "SELECT * FROM snapshots WHERE date = (SELECT max(date) FROM snapshots)")
def _(i):
    return joins.latest_date_rows(i.snapshots)


@query(
    "prefer_source",
    """WITH complete AS (SELECT server_name, character_name FROM before_2000 GROUP BY ALL HAVING count(DISTINCT div) = 3)
       SELECT p.*, 'primary' AS source FROM before_2000 p SEMI JOIN complete USING (server_name, character_name)
       UNION ALL BY NAME
       SELECT s.*, 'secondary' AS source FROM ranking s ANTI JOIN complete USING (server_name, character_name)
       WHERE class_name <> 'HOUSEHOLD'""",
)
def _(i):
    unknown = i.characters.filter("c_mktsegment = 'HOUSEHOLD'").select(
        F.col("r_name").alias("server_name"), F.col("c_name").alias("character_name")
    )
    return joins.prefer_source(state_before(i), i.ranking, unknown)


@query(
    "batch_first_seen",
    """SELECT s.obs_id, s.server_name || '_' || s.character_name || '_' || CAST(s.div AS VARCHAR) AS character_key FROM since_2000 s
       WHERE NOT EXISTS (SELECT 1 FROM before_2000 b WHERE b.server_name = s.server_name AND b.character_name = s.character_name AND b.div = s.div)""",
)
def _(i):
    return joins.batch_first_seen(changes_since(i), state_before(i)).select("obs_id", "character_key")


@query("union_rollups", "SELECT * FROM cube_rows")
def _(i):
    return sets.union_rollups(i.ranking)


@query(
    "fan_in_rank_types",
    """SELECT *, CASE div WHEN 1 THEN '@RANK_TYPE_NAMES.1@' WHEN 2 THEN '@RANK_TYPE_NAMES.2@' ELSE '@RANK_TYPE_NAMES.3@' END AS rank_type FROM ranking""",
)
def _(i):
    return sets.tag_rank_types(i.ranking)


@query("distinct_rows", "SELECT DISTINCT character_name, server_name, class_name, change_amount, div FROM obs")
def _(i):
    return sets.distinct_rows(i.obs.select("character_name", "server_name", "class_name", "change_amount", "div"))


@query(
    "title_difference",
    """SELECT title FROM article_titles EXCEPT SELECT title FROM article_titles WHERE starts_with(url, 'https:')""",
)
def _(i):
    articles = _articles(i)
    return sets.title_difference(articles, articles.filter(_is_stored()))
