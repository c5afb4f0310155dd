"""Mutations: the state is what was observed before 2000, the changes are what came after."""

from pyspark.sql import functions as F

from rankmill.catalog.join_queries import changes_since, cutoff, state_before
from rankmill.catalog.registry import query
from rankmill.operators import mutations, ordering
from rankmill.operators.windows import first_per_key
from rankmill.plans.jobs import crawler_status
from rankmill.schemas import CHARACTER_KEY, RANKING_KEY, SNAPSHOT_KEY

def newest():
    return [F.desc("retrieved_at"), F.desc("obs_id")]

COLUMNS = "rank_position, change_amount, change_type, server_name, character_name, class_name, power_value, div, retrieved_at"


@query("upsert_latest", "SELECT * FROM ranking")
def _(i):
    return mutations.upsert_latest(state_before(i), changes_since(i), order_by=newest())


@query("upsert_event_time", "SELECT * FROM ranking")
def _(i):
    """Newer rows as the state and older ones arriving late: the late rows must not win."""
    newer = first_per_key(changes_since(i), RANKING_KEY, newest()).drop("obs_id")
    late = i.obs.filter(F.col("retrieved_at") < cutoff())
    return mutations.upsert_latest(newer, late, order_by=newest(), event_time="retrieved_at")


@query(
    "upsert_arrival_wins",
    f"""WITH late AS (SELECT {COLUMNS} FROM before_2000),
             newer AS (SELECT {COLUMNS} FROM since_2000 QUALIFY row_number() OVER (
                       PARTITION BY character_name, server_name, div ORDER BY retrieved_at DESC, obs_id DESC) = 1)
        SELECT * FROM late UNION ALL SELECT * FROM newer ANTI JOIN late USING (character_name, server_name, div)""",
)
def _(i):
    newer = first_per_key(changes_since(i), RANKING_KEY, newest()).drop("obs_id")
    late = i.obs.filter(F.col("retrieved_at") < cutoff())
    return mutations.upsert_latest(newer, late, order_by=newest())


@query(
    "insert_if_absent",
    """SELECT date, server_name, class_name, population, div FROM snapshots WHERE class_name = 'all'
       UNION ALL SELECT date, server_name, class_name, -population, div FROM snapshots WHERE class_name <> 'all'""",
)
def _(i):
    columns = [*SNAPSHOT_KEY, "population"]
    state = i.snapshots.filter("class_name = 'all'").select(*columns)
    again = i.snapshots.withColumn("population", -F.col("population")).select(*columns)
    return mutations.insert_if_absent(state, again, SNAPSHOT_KEY)


DOOMED = "SELECT DISTINCT server_name, character_name FROM since_2000 WHERE class_name = 'FURNITURE'"


def doomed(i):
    return changes_since(i).filter("class_name = 'FURNITURE'")


@query("delete_key", f"SELECT * FROM before_2000 ANTI JOIN ({DOOMED}) USING (server_name, character_name)")
def _(i):
    return mutations.delete_key(state_before(i), doomed(i), CHARACTER_KEY)[0]


@query(
    "delete_key_count",
    f"SELECT count(*) AS deleted FROM before_2000 SEMI JOIN ({DOOMED}) USING (server_name, character_name)",
)
def _(i):
    return mutations.delete_key(state_before(i), doomed(i), CHARACTER_KEY)[1]


@query(
    "update_by_key",
    """WITH c AS (SELECT * FROM since_2000 QUALIFY row_number() OVER (PARTITION BY server_name, character_name ORDER BY retrieved_at DESC, obs_id DESC) = 1)
       SELECT coalesce(c.rank_position, b.rank_position) AS rank_position, coalesce(c.change_amount, b.change_amount) AS change_amount,
              coalesce(c.change_type, b.change_type) AS change_type, b.server_name, b.character_name,
              coalesce(c.class_name, b.class_name) AS class_name, coalesce(c.power_value, b.power_value) AS power_value, b.div,
              CASE WHEN c.obs_id IS NULL THEN b.retrieved_at ELSE as_of END AS retrieved_at
       FROM before_2000 b LEFT JOIN c ON b.server_name = c.server_name AND b.character_name = c.character_name, now_at""",
)
def _(i):
    return mutations.update_by_key(state_before(i), changes_since(i), as_of=i.as_of, order_by=newest())


REQUEST_REST = "server, character_name, priority, created_at"


@query(
    "claim_request",
    f"""WITH chosen AS (SELECT request_id FROM requests WHERE status = 'pending'
                        QUALIFY row_number() OVER (PARTITION BY server ORDER BY priority, created_at, request_id) = 1)
        SELECT r.request_id, {REQUEST_REST}, CASE WHEN c.request_id IS NULL THEN status ELSE 'processing' END AS status,
               CASE WHEN c.request_id IS NULL THEN started_at ELSE as_of END AS started_at
        FROM requests r LEFT JOIN chosen c ON r.request_id = c.request_id, event_now""",
)
def _(i):
    claimed = mutations.claim_request(i.requests, ordering.next_per_server(i.requests), as_of=i.event_as_of)
    return claimed.select(
        "request_id", "server", "character_name", "priority", "created_at", "status", "started_at"
    )


@query(
    "complete_request",
    """SELECT request_id, CASE WHEN status = 'processing' THEN 'completed' ELSE status END AS status,
              CASE WHEN status = 'processing' THEN as_of ELSE completed_at END AS completed_at,
              CASE WHEN status = 'processing' THEN '{"success":true,"character":"' || character_name || '","rank":' || CAST(priority AS VARCHAR) || '}' ELSE result END AS result
       FROM requests, event_now""",
)
def _(i):
    answer = F.struct(F.lit(True).alias("success"), F.col("character_name").alias("character"), F.col("priority").alias("rank"))
    results = i.requests.filter("status = 'processing'").select("request_id", answer.alias("result"))
    done = mutations.complete_request(i.requests, results, as_of=i.event_as_of)
    return done.select("request_id", "status", "completed_at", "result")


@query(
    "fail_or_retry",
    """SELECT request_id,
              CASE WHEN status <> 'processing' THEN status WHEN nf THEN 'completed' WHEN NOT again THEN 'failed'
                   WHEN retry_count < max_retries THEN 'pending' ELSE 'failed' END AS status,
              CASE WHEN status = 'processing' AND again AND NOT nf THEN retry_count + 1 ELSE retry_count END AS retry_count,
              CASE WHEN status = 'processing' AND NOT nf THEN 'E' || CAST(priority AS VARCHAR) ELSE error_message END AS error_message,
              CASE WHEN status = 'processing' AND again AND NOT nf THEN NULL ELSE started_at END AS started_at,
              CASE WHEN status = 'processing' AND NOT (again AND NOT nf) THEN as_of ELSE completed_at END AS completed_at,
              CASE WHEN status = 'processing' AND nf THEN '{"success":false,"message":"E' || CAST(priority AS VARCHAR)
                   || '","error_code":"CHARACTER_NOT_FOUND","from_cache":false}' ELSE result END AS result
       FROM (SELECT *, priority >= 5 AS again, priority % 4 = 0 AS nf FROM requests), event_now""",
)
def _(i):
    priority = F.col("priority")
    failures = i.requests.filter("status = 'processing'").select(
        "request_id",
        F.concat(F.lit("E"), priority.cast("string")).alias("error_message"),
        (priority >= 5).alias("retry"),
        (priority % 4 == 0).alias("not_found"),
    )
    after = mutations.fail_or_retry(i.requests, failures, as_of=i.event_as_of)
    return after.select(
        "request_id", "status", "retry_count", "error_message", "started_at", "completed_at", "result"
    )


LATE_TEST = "status = 'processing' AND started_at < as_of - INTERVAL 600 SECOND"
SWEPT = f"""
    SELECT request_id, created_at, started_at, CASE WHEN {LATE_TEST} THEN 'timeout' ELSE status END AS status,
           CASE WHEN {LATE_TEST} THEN '@TIMEOUT_MESSAGE@' ELSE error_message END AS error_message,
           CASE WHEN {LATE_TEST} THEN as_of ELSE completed_at END AS completed_at
    FROM requests, event_now"""


@query("sweep_timeouts", SWEPT)
def _(i):
    swept = mutations.sweep_timeouts(i.requests, as_of=i.event_as_of)
    return swept.select("request_id", "created_at", "started_at", "status", "error_message", "completed_at")


@query(
    "retention_delete",
    """SELECT r.* FROM requests r, event_now WHERE NOT coalesce(status IN ('completed', 'failed', 'timeout')
       AND completed_at < as_of - INTERVAL 7 DAY, false)""",
)
def _(i):
    return mutations.retention_delete(i.requests, as_of=i.event_as_of)


@query(
    "tag_insert_update",
    """SELECT obs_id, CASE WHEN b.div IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action
       FROM since_2000 s LEFT JOIN before_2000 b USING (character_name, server_name, div)""",
)
def _(i):
    tagged, _ = mutations.tag_insert_update(state_before(i), changes_since(i))
    return tagged.select("obs_id", "action")


def unnamed(i):
    """Changes of which some have lost their name."""
    name = F.when(F.col("obs_id") % 17 != 0, F.col("character_name"))
    return changes_since(i).withColumn("character_name", name)


@query(
    "tag_insert_update_counts",
    "SELECT count(*) FILTER (obs_id % 17 <> 0) AS succeeded, count(*) FILTER (obs_id % 17 = 0) AS failed FROM since_2000",
)
def _(i):
    return mutations.tag_insert_update(state_before(i), unnamed(i))[1]


@query(
    "key_violations",
    """SELECT name AS character_name, server_name, div, count(*) AS rows, CASE WHEN name IS NULL THEN 'not_null' ELSE 'unique' END AS rule
       FROM (SELECT *, CASE WHEN obs_id % 17 <> 0 THEN character_name END AS name FROM obs) GROUP BY ALL HAVING count(*) > 1 OR name IS NULL""",
)
def _(i):
    name = F.when(F.col("obs_id") % 17 != 0, F.col("character_name"))
    return mutations.key_violations(i.obs.withColumn("character_name", name), RANKING_KEY)


@query(
    "patch_non_null",
    """WITH p AS (SELECT server_name, CASE WHEN max(retrieved_at) > TIMESTAMP '2001-07-25 00:00:00' THEN 'waiting' END AS status,
                         CAST(count(*) AS INTEGER) AS errors_count FROM since_2000 WHERE server_name <> 'ASIA' GROUP BY ALL)
       SELECT s.server_name, worker_id, coalesce(p.status, s.status) AS status, current_character, characters_processed, characters_remaining,
              CASE WHEN p.server_name IS NULL THEN last_update ELSE as_of END AS last_update,
              coalesce(p.errors_count, s.errors_count) AS errors_count, start_time
       FROM crawler_status s LEFT JOIN p ON s.server_name = p.server_name, now_at""",
)
def _(i):
    late = F.max("retrieved_at") > F.lit("2001-07-25 00:00:00").cast("timestamp_ntz")
    patch = (
        changes_since(i)
        .filter("server_name <> 'ASIA'")
        .groupBy("server_name")
        .agg(F.when(late, "waiting").alias("status"), F.count(F.lit(1)).cast("int").alias("errors_count"))
    )
    return mutations.patch_non_null(crawler_status(i.activity), patch, ["server_name"], as_of=i.as_of)


DEDUP = """
    WITH RECURSIVE r AS (
        SELECT *, row_number() OVER (PARTITION BY server, character_name ORDER BY created_at, request_id) AS rn FROM requests),
    walk AS (
        SELECT server, character_name, rn, request_id, true AS kept,
               CASE WHEN status IN ('pending', 'processing') THEN created_at END AS last_open
        FROM r WHERE rn = 1
        UNION ALL
        SELECT server, character_name, rn, request_id, ok,
               CASE WHEN ok AND status IN ('pending', 'processing') THEN created_at ELSE last_open END
        FROM (SELECT r.server, r.character_name, r.rn, r.request_id, r.status, r.created_at, w.last_open,
                     w.last_open IS NULL OR w.last_open <= r.created_at - INTERVAL '%s' AS ok
              FROM walk w JOIN r ON r.server = w.server AND r.character_name = w.character_name AND r.rn = w.rn + 1))
    SELECT q.* FROM requests q JOIN walk w ON q.request_id = w.request_id WHERE w.kept"""


@query("enqueue_dedup", DEDUP % "5 minutes")
def _(i):
    return mutations.enqueue_dedup(i.requests)


@query("enqueue_dedup_12h", DEDUP % "12 hours")
def _(i):
    return mutations.enqueue_dedup(i.requests, window=12 * 3600)


@query(
    "seed_missing",
    """WITH s AS (SELECT * FROM crawler_status WHERE errors_count > (SELECT min(errors_count) FROM crawler_status))
       SELECT * FROM s UNION ALL BY NAME
       SELECT r_name AS server_name, 'stopped' AS status, CAST(0 AS INTEGER) AS characters_processed,
              CAST(0 AS INTEGER) AS characters_remaining, CAST(0 AS INTEGER) AS errors_count FROM region WHERE r_name NOT IN (SELECT server_name FROM s)""",
)
def _(i):
    status = crawler_status(i.activity)
    fewest = status.agg(F.min("errors_count")).scalar()
    known = i.table("region").select(F.col("r_name").alias("server_name"))
    zero = F.lit(0)
    defaults = {
        "status": F.lit("stopped"),
        "characters_processed": zero,
        "characters_remaining": zero,
        "errors_count": zero,
    }
    return mutations.seed_missing(status.filter(F.col("errors_count") > fewest), known, "server_name", defaults)


@query(
    "skip_if_fresh",
    """SELECT obs_id, coalesce(b.retrieved_at > TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 200 DAY, false) AS from_cache
       FROM since_2000 s LEFT JOIN before_2000 b USING (character_name, server_name, div)""",
)
def _(i):
    tagged = mutations.skip_if_fresh(changes_since(i), state_before(i), as_of="2000-01-01 00:00:00", ttl=200 * 86_400)
    return tagged.select("obs_id", "from_cache")
