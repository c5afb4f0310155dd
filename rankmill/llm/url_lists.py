"""URL filtering by dated lists: an as-of join of captures with validity intervals, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_DAYS = 30
ADDRESS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ADDRESS, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, ADDRESS, 2)


def patterns_of(url: Column, labels_from: int = 1, labels_to: int | None = None, steps_to: int | None = None) -> Column:
    """All (kind, pattern) that an address can be listed under: its host, the domains above it, its path prefixes.

    Domains have from `labels_from` to `labels_to` labels and prefixes up to `steps_to` steps: what the lists have. So a
    very long address makes no more than they can match.
    """
    host = url_host(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(url_path(url), "/"), lambda s: s != "")

    def entry(kind: str, pattern: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))

    def upto(first: Column, last: Column) -> Column:
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    n = F.size(labels)
    most = n if labels_to is None else F.least(n, F.lit(labels_to))
    domains = F.transform(
        F.reverse(upto(F.lit(labels_from), most)),
        lambda k: entry("domain", F.array_join(F.slice(labels, n - k + 1, k), ".")),
    )
    prefixes = upto(F.lit(1), F.size(steps) if steps_to is None else F.least(F.size(steps), F.lit(steps_to)))
    prefixes = F.transform(
        prefixes, lambda i: entry("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    )
    return F.when(host != "", F.concat(F.array(entry("host", host)), domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries -> intervals [valid_from, valid_to): an entry holds until the next one of its list and pattern.

    Of several entries of one moment the last by action holds, so `remove` wins
    over `block` and `block` over `allow`. Entries with a null are dropped: they
    match nothing or were never in force. Actions other than allow and block end
    what was before.
    """
    known = entries.select("list_name", "kind", "pattern", "action", "listed_at").na.drop()
    key = ["list_name", "kind", "pattern"]
    known = known.groupBy(*key, "listed_at").agg(F.max("action").alias("action"))
    following = F.lead("listed_at").over(Window.partitionBy(*key).orderBy("listed_at"))
    spans = known.withColumn("valid_to", following).withColumnRenamed("listed_at", "valid_from")
    return spans.where(F.col("action").isin("allow", "block"))


def filter_captures(captures: DataFrame, entries: DataFrame, *, slot_days: int = SLOT_DAYS) -> DataFrame:
    """Evaluates every capture against the list entries in force when it was fetched.

    captures: `url`, `fetched_at` (timestamp_ntz) and any other columns; entries:
    `list_name`, `kind` (host, domain, prefix), `pattern`, `action` (allow, block,
    or anything else to end the one before), `listed_at`. Returns the captures
    with `n_active` (entries that match and are in force), `rule` (the one that
    decides: the longest pattern, then allow before block, then kind and list by
    name) and `blocked`. Without a rule nothing is blocked; so are null, empty or
    relative addresses and captures without a time. Repeated rows stay. Columns of
    the captures with these names are replaced; any others may have any names.

    Both sides carry a time slot, so a capture only meets entries of its pattern
    that held in its slot. Verdicts are made once per distinct (url, fetched_at).
    """
    def slot(t: Column) -> Column:
        return F.floor(F.datediff(t, F.lit("1970-01-01").cast("date")) / slot_days).cast("int")

    spans = validity(entries)
    # the captures' own columns are in one struct, so names made here can't be theirs
    given = [F.col(f"`{c}`") for c in captures.columns if c not in ("n_active", "rule", "blocked")]
    rows = captures.select(F.struct(*given).alias("given"), F.col("url").alias("url"), F.col("fetched_at").alias("at"))
    seen = rows.select("url", "at").distinct()
    labels = F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))
    steps = F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)
    labels_from, labels_to, steps_to = spans.agg(F.min(labels), F.max(labels), F.max(steps)).first()
    newest = captures.agg(F.max(slot(F.col("fetched_at")))).first()[0]
    last = F.lit(newest).cast("int")
    upto = F.least(slot(F.col("valid_to")), last)  # open intervals end with the newest capture
    held = spans.where(slot(F.col("valid_from")) <= last).withColumn(
        "slot", F.explode(F.sequence(slot(F.col("valid_from")), upto))
    )
    patterns = patterns_of(F.col("url"), labels_from or 1, labels_to or 0, steps_to or 0)
    wanted = seen.withColumn("p", F.explode(patterns)).select(
        "url", "at", slot(F.col("at")).alias("slot"), "p.kind", "p.pattern"
    )
    hits = wanted.join(held, ["kind", "pattern", "slot"]).where(
        (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    )
    order = F.struct(-F.length("pattern"), F.col("action"), F.col("kind"), F.col("list_name"), F.col("pattern"))
    told = F.concat_ws(":", "list_name", "kind", "pattern", "action")
    verdicts = hits.groupBy("url", "at").agg(
        F.count(F.lit(1)).alias("n_active"), F.min_by(told, order).alias("rule"), F.min_by("action", order).alias("action")
    )
    return rows.join(verdicts, ["url", "at"], "left").select(
        "given.*",
        F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
        "rule",
        F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"),
    )
