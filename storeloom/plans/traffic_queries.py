"""Message queue, rate limits, privacy and operations data on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.functions.clock import minutes
from storeloom.operators import claims, identity, ops, outbox, privacy, rates
from storeloom.plans.fixtures import ntz, some_without, table
from storeloom.plans.registry import query
from storeloom.session import work_folder
from storeloom.sources.payloads import payload_fields


@query(
    "outbox_claim",
    """
    SELECT event_id, ts, event_type, worker, turn FROM (
        SELECT event_id, ts, event_type, event_id % 4 AS worker,
               row_number() OVER (PARTITION BY event_id % 4 ORDER BY ts, event_id) AS turn
        FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-15 00:00:00')
    WHERE turn <= 100
    """,
)
def outbox_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return outbox.claim(
        queue, ntz("2024-01-15 00:00:00"), 4, 100, "event_id", "ts", "event_type", "signup"
    )


# Runs of the next query: when, and which messages were sent before it.
RUNS = ["2024-01-15 00:00:00", "2024-01-15 12:00:00", "2024-01-16 06:00:00"]
SENT = "event_id % 3 = 0"


def _runs_sql() -> str:
    """Each run spelled out: what earlier runs hold and what is sent is not claimed."""
    parts, earlier = [], "SELECT NULL::BIGINT AS event_id, NULL::TIMESTAMP AS expires_at, 0 AS attempt WHERE false"
    for n, at in enumerate(RUNS):
        parts.append(f"""run{n} AS (
            SELECT event_id, worker, turn, attempt, TIMESTAMP '{at}' AS claimed_at,
                   TIMESTAMP '{at}' + INTERVAL 1 DAY AS expires_at, {n} AS run FROM (
                SELECT event_id, event_id % 4 AS worker, coalesce(attempt, 0) + 1 AS attempt,
                       row_number() OVER (PARTITION BY event_id % 4 ORDER BY ts, event_id) AS turn
                FROM events LEFT JOIN (SELECT event_id, max(expires_at) AS until, max(attempt) AS attempt
                                       FROM ({earlier}) GROUP BY event_id) USING (event_id)
                WHERE event_type = 'signup' AND ts <= TIMESTAMP '{at}'
                  AND (until IS NULL OR until <= TIMESTAMP '{at}')
                  AND ({n} = 0 OR NOT ({SENT}))) WHERE turn <= 20)""")  # fmt: skip
        earlier = " UNION ALL ".join(f"SELECT event_id, expires_at, attempt FROM run{i}" for i in range(n + 1))
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM run{n}" for n in range(len(RUNS)))


@query("outbox_claim_runs", _runs_sql())
def outbox_claim_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs: the second finds the first one's messages taken, the third finds them free."""
    queue = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    runs = claims.ClaimTable(work_folder(spark, "claims"), "event_id", queue.schema["event_id"].dataType, 86400)
    sent = queue.filter(SENT)
    held = [
        runs.run(queue, n, ntz(at), 4, 20, "ts", "event_type", "signup", sent if n else None)
        for n, at in enumerate(RUNS)
    ]
    return reduce(DataFrame.unionByName, held)


@query(
    "outbox_backlog",
    """
    SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS attempts,
           count(*) AS n, count(*) FILTER (ts <= TIMESTAMP '2024-01-15 00:00:00') AS n_due,
           min(ts) AS oldest_due,
           CAST(DATE '2024-01-15' - CAST(min(ts) AS DATE) AS INTEGER) AS oldest_age_days
    FROM events GROUP BY 1, 2
    """,
)
def outbox_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts", "props")
    queue = payload_fields(events, "props", {"k": ("$.k", "bigint")}).withColumn(
        "attempts", F.col("k") % 4
    )
    return outbox.backlog(queue, ntz("2024-01-15 00:00:00"), "ts", "event_type", "attempts")


@query(
    "drain_plan",
    """
    SELECT event_id, user_id, ts,
           CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS BIGINT)
               AS slot
    FROM events
    """,
)
def drain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    minute = minutes(requests, "ts")
    return outbox.drain_plan(requests, "user_id", ["ts", "event_id"], minute, 5)


@query(
    "drain_plan_hot",
    """
    SELECT event_id, user_id, ts, CAST((row_number() OVER (
               PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) - 1) // 5 AS BIGINT) AS slot
    FROM (SELECT * REPLACE (CASE WHEN event_id % 10 > 0 THEN ts END AS ts) FROM events)
    """,
)
def drain_plan_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user cut into buckets, some requests without a time."""
    events = some_without(table(spark, sf_dir, "events"), "ts", "event_id")
    requests = events.select("event_id", "user_id", "ts")
    minute = minutes(requests, "ts")
    return outbox.drain_plan(requests, "user_id", ["ts", "event_id"], minute, 5, hot_rows=1)


LEVELS = (
    rates.Level("shop", "user_id", 1, 633),
    rates.Level("ip", "event_type", 5, 133),
    rates.Level("app", "app", 20, 533),
)


@query(
    "rate_tumbling",
    """
    WITH e AS (SELECT date_trunc('hour', ts) AS window_start, user_id, event_type FROM events),
    counted AS (
        SELECT 'shop' AS level, CAST(user_id AS VARCHAR) AS key, window_start,
               count(*) AS requests, 1 AS max_requests, 633 AS code FROM e GROUP BY 1, 2, 3
        UNION ALL SELECT 'ip', event_type, window_start, count(*), 5, 133 FROM e GROUP BY 1, 2, 3
        UNION ALL SELECT 'app', 'all', window_start, count(*), 20, 533 FROM e GROUP BY 1, 2, 3
    )
    SELECT level, key, window_start, requests, max_requests,
           CASE WHEN requests > max_requests THEN code END AS breach_code
    FROM counted
    """,
)
def rate_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").withColumn("app", F.lit("all"))
    return rates.rate_tumbling(requests, "ts", LEVELS, "1 hour")


ROLLING_ORACLE = """
    SELECT event_id, ts, in_window, in_window > {limit} AS breached FROM (
        SELECT event_id, ts, count(*) OVER ({part} ORDER BY ts
            RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS in_window
        FROM events)
"""


@query("rate_rolling", ROLLING_ORACLE.format(limit=20, part=""))
def rate_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.rate_rolling(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 3600, 20)


@query(
    "rate_rolling_per_key", ROLLING_ORACLE.format(limit=5, part="PARTITION BY event_type")
)
def rate_rolling_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return rates.rate_rolling(requests, "ts", 3600, 5, "event_type").drop("event_type")


OPTOUT_WORDS = ("the", "of", "to")
REFUSED = r"""regexp_extract(regexp_replace(lower(text), '^[^\p{L}\p{N}]+', ''),
    '^[\p{L}\p{N}]+') IN ('the', 'of', 'to')"""


@query(
    "optout_detect",
    f"""
    SELECT conv_id, min(turn) AS first_refusal, count(*) AS n_refusals
    FROM conversations WHERE role = 'user' AND {REFUSED} GROUP BY conv_id
    """,
)
def optout_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return privacy.optouts(messages, "conv_id", "text", "turn", OPTOUT_WORDS, "first_token")


@query(
    "optout_erase",
    """
    SELECT event_id, user_id, ts, CASE WHEN NOT gone THEN value END AS value,
           CASE WHEN NOT gone THEN props END AS props
    FROM (SELECT *, user_id IN (SELECT user_id FROM events
                                WHERE event_type = 'error' AND contains(props, '40')) AS gone
          FROM events)
    """,
)
def optout_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").drop("event_type")
    people = table(spark, sf_dir, "events").filter(
        (F.col("event_type") == "error") & F.col("props").contains("40")
    )
    return privacy.erase(events, people, "user_id", ["value", "props"])


# People are known by document and phone: three customers share a phone, and some orders
# carry the document of one group of three and the phone of the next.
PEOPLE = {
    "customers": ("customer", "c_custkey", "c_custkey", "c_custkey // 3", "c_name"),
    "leads": (
        "orders",
        "o_orderkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END",
        "CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) // 3 END",
        "CAST(CAST(o_totalprice AS DECIMAL(10, 2)) AS VARCHAR)",
    ),
    "messages": (
        "events",
        "event_id",
        "CASE WHEN event_id % 2 = 0 THEN user_id END",
        "CASE WHEN event_id % 3 = 0 THEN user_id // 3 END",
        "props",
    ),
}
REFUSERS = "event_type = 'error' AND contains(props, ': 40}')"
_PEOPLE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS source, {row_id} AS row_id, {doc} AS document, {phone} AS phone, {what} AS personal"
    f" FROM {source}"
    for name, (source, row_id, doc, phone, what) in PEOPLE.items()
)


@query(
    "erase_everywhere",
    f"""
    WITH RECURSIVE people AS ({_PEOPLE_SQL}),
    pairs AS (SELECT DISTINCT 'd' || document AS a, 'p' || phone AS b FROM people
              WHERE document IS NOT NULL AND phone IS NOT NULL),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    gone(id) AS (
        SELECT DISTINCT 'd' || user_id FROM events WHERE {REFUSERS}
        UNION SELECT b FROM gone JOIN links ON a = id)
    SELECT source, row_id, document, phone,
           CASE WHEN coalesce('d' || document IN (SELECT id FROM gone), false)
                  OR coalesce('p' || phone IN (SELECT id FROM gone), false)
                THEN NULL ELSE personal END AS personal
    FROM people
    """,
)
def erase_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {}
    for name, (source, row_id, doc, phone, what) in PEOPLE.items():
        columns = [row_id, doc.replace("//", "div"), phone.replace("//", "div"), what.replace("VARCHAR", "STRING")]
        names = ["row_id", "document", "phone", "personal"]
        rows = table(spark, sf_dir, source).select(
            F.lit(name).alias("source"), *[F.expr(c).alias(n) for c, n in zip(columns, names)]
        )
        known = {"document": F.col("document"), "phone": F.col("phone")}
        tables[name] = identity.Personal(rows, known, ["personal"])
    people = table(spark, sf_dir, "events").filter(REFUSERS)
    erased = identity.erase_everywhere(tables, people, "document", "user_id")
    return reduce(DataFrame.unionByName, erased.values())


@query(
    "inactive_scrub",
    """
    SELECT c_custkey AS id, CASE WHEN NOT inactive THEN c_name END AS phone,
           CASE WHEN NOT inactive THEN c_mktsegment END AS raw, c_nationkey AS company,
           captured, inactive
    FROM (
        SELECT c.*, TIMESTAMP '1996-01-01 00:00:00' AS captured,
               greatest(last, TIMESTAMP '1996-01-01 00:00:00')
                   < TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAY AS inactive
        FROM customer c
        LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
          ON o_custkey = c_custkey)
    """,
)
def inactive_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("phone"),
        F.col("c_mktsegment").alias("raw"),
        F.col("c_nationkey").alias("company"),
        ntz("1996-01-01 00:00:00").alias("captured"),
    )
    activity = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("active_at")
    )
    as_of = ntz("2001-08-01 00:00:00")
    return privacy.scrub_inactive(
        leads, activity, "id", "captured", "active_at", as_of, ["phone", "raw"]
    )


@query(
    "pii_residue",
    f"""
    SELECT 'not_erased' AS check_name, 'source' AS column_name,
           count(*) FILTER (toxic = 1 AND source IS NOT NULL) AS n_rows
    FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'email_in_text', 'text',
           count(*) FILTER (regexp_matches(text, '{privacy.EMAIL}')) FROM documents
    UNION ALL SELECT 'phone_in_text', 'text',
           count(*) FILTER (regexp_matches(text, '{privacy.PHONE}')) FROM documents
    """,
)
def pii_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Texts are searched where they lie; only the narrow columns meet the labels.
    in_text = privacy.pii_residue(docs, text_cols=["text"])
    labelled = docs.select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    erased = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return privacy.pii_residue(labelled, erased, ["source"]).unionByName(in_text)


@query(
    "failure_match",
    """
    SELECT user_id, count(*) AS n FROM events
    WHERE event_type = 'error' AND contains(props, '40') GROUP BY user_id
    """,
)
def failure_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return ops.failure_counts(errors, "user_id", "props", "40")


@query(
    "prune_history",
    """
    SELECT event_id, ts, event_type FROM events
    WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY
    ORDER BY ts DESC, event_id DESC LIMIT 2000
    """,
)
def prune_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return ops.prune(history, "ts", "event_id", ntz("2024-01-31 00:00:00"), max_rows=2000)


LOG_LINE = """CASE event_type
    WHEN 'error' THEN 'acme: error: 429, retry after ' || {stamp} || ' UTC: see docs'
    WHEN 'click' THEN 'too many certificates issued for shop ' || user_id
    WHEN 'view' THEN 'Rate Limit reached'
    ELSE 'served ' || event_id END"""


@query(
    "log_rate_limits",
    f"""
    WITH lines AS (
        SELECT user_id, event_id, event_type,
               {LOG_LINE.format(stamp="strftime(ts, '%Y-%m-%d %H:%M:%S')")} AS line,
               date_trunc('second', ts) AS said_at
        FROM events WHERE event_type IN ('error', 'click', 'view')
    ), last AS (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n_lines
        FROM lines
    )
    SELECT user_id, n_lines, CASE WHEN event_type = 'error' THEN said_at END AS retry_at_utc,
           CASE WHEN event_type = 'error'
                THEN strftime(said_at - INTERVAL 3 HOUR, '%d/%m/%Y às %H:%M:%S') END AS retry_local,
           CASE event_type WHEN 'click' THEN line WHEN 'view' THEN 'Bloqueio ACME 429' END
               AS reason
    FROM last WHERE rn = 1
    """,
)
def log_rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
    lines = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.expr(LOG_LINE.format(stamp=stamp)).alias("line")
    )
    return ops.rate_limit_log(lines, "user_id", "event_id", "line")
