"""Versioned-catalogue operators on the driver's tables (parts as catalogue entries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.operators import catalog
from storeloom.plans.fixtures import table
from storeloom.plans.registry import query

# SQL both engines read: a part as an entry with dated, preview and stable ids.
ITEM_ID = """replace(p_name, ' ', '-') || '-' || replace(p_brand, 'Brand#', '') ||
    CASE p_type WHEN 'PROMO' THEN '-preview'
                WHEN 'LARGE' THEN '-2024-05-' || lpad(CAST(p_size AS VARCHAR), 2, '0')
                WHEN 'SMALL' THEN '-001' ELSE '' END"""
SUFFIXES = ("-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "-(preview|001|002)$")
CANONICAL = f"""regexp_replace(regexp_replace({ITEM_ID}, '{SUFFIXES[0]}', ''), '{SUFFIXES[1]}', '')"""


def spark_sql(sql: str):
    return F.expr(sql.replace("VARCHAR", "STRING"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("id", spark_sql(ITEM_ID))


@query(
    "catalog_filter",
    f"""
    SELECT p_partkey, {ITEM_ID} AS id FROM part
    WHERE (regexp_matches({ITEM_ID}, '^(red|blue|old)') OR regexp_matches({ITEM_ID}, '-0?1$'))
      AND NOT regexp_matches({ITEM_ID}, 'ring|widget') AND NOT regexp_matches({ITEM_ID}, 'preview$')
      AND p_brand NOT IN ('Brand#1', 'Brand#2')
      AND (contains(p_type, 'M') OR contains(p_name, 'M'))
    """,
)
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("able", F.array("p_type", "p_name"))
    return catalog.filter_catalog(
        items,
        "id",
        include=["^(red|blue|old)", "-0?1$"],
        exclude=["ring|widget", "preview$"],
        owner="p_brand",
        not_owners=["Brand#1", "Brand#2"],
        needs={"able": "M"},
    ).select("p_partkey", "id")


CLASS_RULES = (
    ("ring|rod", "metal"),
    ("^red|^hot", "warm"),
    ("widget|gizmo", "gadget"),
    ("preview", "upcoming"),
)


@query(
    "catalog_classify",
    "SELECT p_partkey, CASE "
    + " ".join(f"WHEN regexp_matches({ITEM_ID}, '{p}') THEN '{c}'" for p, c in CLASS_RULES)
    + " ELSE 'plain' END AS category FROM part",
)
def catalog_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = catalog.classify(F.col("id"), CLASS_RULES, "plain")
    return _items(spark, sf_dir).select("p_partkey", category.alias("category"))


@query("catalog_canonical", f"SELECT p_partkey, {CANONICAL} AS canonical FROM part")
def catalog_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = catalog.canonical(F.col("id"), SUFFIXES)
    return _items(spark, sf_dir).select("p_partkey", canonical.alias("canonical"))


@query(
    "prefer_alias",
    f"""
    SELECT canonical, p_partkey, p_type FROM (
        SELECT *, row_number() OVER (PARTITION BY canonical
            ORDER BY CASE WHEN id = canonical THEN 0 ELSE 1 END, p_partkey) AS rn
        FROM (SELECT *, {ITEM_ID} AS id, {CANONICAL} AS canonical FROM part))
    WHERE rn = 1
    """,
)
def prefer_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = (
        _items(spark, sf_dir)
        .withColumn("canonical", catalog.canonical(F.col("id"), SUFFIXES))
        .select("canonical", "p_partkey", "p_type", (F.col("id") == F.col("canonical")).alias("a"))
    )
    return catalog.pick_preferred(items, "canonical", "a", "p_partkey").drop("a")


@query(
    "latest_line",
    """
    WITH newest AS (
        SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type
            ORDER BY p_size DESC, p_partkey DESC) AS rn
        FROM part
    )
    SELECT p_partkey, p_type, p_brand, p_size FROM part
    JOIN (SELECT p_type, p_brand FROM newest WHERE rn = 1) USING (p_type, p_brand)
    """,
)
def latest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return catalog.latest_line(parts, "p_type", "p_brand", "p_size", "p_partkey")


VERSIONED = """CASE p_type
    WHEN 'PROMO' THEN 'line-' || (p_size % 7) || '.' || replace(p_brand, 'Brand#', '')
    WHEN 'LARGE' THEN 'line-' || p_size || '-' || replace(p_brand, 'Brand#', '')
    WHEN 'SMALL' THEN 'line-' || p_size
    ELSE replace(p_name, ' ', '-') END"""
VERSION_PATTERNS = ("([0-9]+\\.[0-9]+)", "-([0-9]+)-", "-([0-9]+)$")
VERSION = (
    "CAST(coalesce("
    + ", ".join(f"nullif(regexp_extract({VERSIONED}, '{p}', 1), '')" for p in VERSION_PATTERNS)
    + ", '1.0') AS DOUBLE)"
)


@query(
    "latest_numeric",
    f"""
    SELECT p_partkey, p_name, id, version FROM (
        SELECT *, max(version) OVER (PARTITION BY p_name) AS newest
        FROM (SELECT p_partkey, p_name, {VERSIONED} AS id, {VERSION} AS version FROM part))
    WHERE version = newest
    """,
)
def latest_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", spark_sql(VERSIONED).alias("id")
    )
    versioned = items.withColumn("version", catalog.numeric_version(F.col("id"), VERSION_PATTERNS))
    return catalog.latest_numeric(versioned, "p_name", "version")


@query(
    "capability_tags",
    """
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(
        ['chat', 'tools', CASE WHEN p_size > 25 THEN 'vision' END,
         CASE WHEN p_size > 25 THEN 'image' END,
         CASE WHEN regexp_matches(p_name, '^hot') THEN 'reasoning' END, lower(p_type)],
        lambda t: t IS NOT NULL AND t <> 'medium'))), ', ') AS tags
    FROM part
    """,
)
def capability_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = catalog.tags(
        [
            (True, ["chat", "tools"]),
            (F.col("p_size") > 25, ["vision", "image"]),
            (F.col("p_name").rlike("^hot"), ["reasoning"]),
        ],
        lists=[F.array(F.lower("p_type"))],
        drop=["medium"],
    )
    return table(spark, sf_dir, "part").select("p_partkey", tags.alias("tags"))


@query(
    "free_tier",
    """
    SELECT p_partkey, (p_size < 5 AND p_brand = 'Brand#3') OR regexp_matches(p_name, 'rod|gizmo')
        AS free
    FROM part
    """,
)
def free_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.when(F.col("p_size") < 5, "0").otherwise(F.col("p_size").cast("string"))
    completion = F.when(F.col("p_brand") == "Brand#3", "0").otherwise("0.0")
    free = catalog.free_tier(prompt, completion, F.col("p_name"), ["rod|gizmo"])
    return table(spark, sf_dir, "part").select("p_partkey", free.alias("free"))


@query(
    "catalog_union",
    """
    SELECT c_custkey AS id, c_name AS name, 'customer' AS source, c_mktsegment AS segment
    FROM customer
    UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier
    """,
)
def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit("customer").alias("source"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("source")
    )
    silent = customers.filter(F.lit(False))
    return catalog.unify([customers, silent, suppliers])


ROUTES = (
    catalog.Source("MISSING", ("rod$",)),
    catalog.Source("PROMO", ("golden$", "rod$"), prefix="promo"),
    catalog.Source("LARGE", ("rod$",), newest=True),
)


@query(
    "route_priority",
    """
    SELECT 'promo/' || p_name || '-' || p_partkey AS target
    FROM (SELECT * FROM part WHERE p_type = 'PROMO' AND p_name LIKE '%rod'
          ORDER BY p_size DESC, p_partkey LIMIT 1)
    """,
)
def route_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("earlier", -F.col("p_partkey"))
    target = catalog.route(
        parts.withColumn("created", F.col("p_size")),
        "p_name",
        "p_type",
        "created",
        ["p_size", "earlier"],
        ROUTES,
        "none",
        shown=F.concat_ws("-", "p_name", "p_partkey"),
    )
    return target


@query(
    "publish_diff",
    """
    WITH old AS (
        SELECT p_partkey, p_name, CAST(p_retailprice AS DECIMAL(10,2)) AS price
        FROM part
    ), new AS (
        SELECT CASE WHEN p_type = 'LARGE' THEN -p_partkey - 1 ELSE p_partkey END AS p_partkey, p_name, CAST(p_retailprice AS DECIMAL(10,2))
            + CASE WHEN p_brand = 'Brand#7' THEN 1 ELSE 0 END AS price
        FROM part
    )
    SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey,
           CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed'
                ELSE 'changed' END AS change
    FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey
    WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.price <> n.price
    """,
)
def publish_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    raised = F.col("p_retailprice") + F.when(F.col("p_brand") == "Brand#7", 1).otherwise(0)
    price = F.col("p_retailprice").cast("decimal(11,2)").alias("price")
    old = parts.select("p_partkey", "p_name", price)
    # Large parts get a new number: one entry removed and one added.
    key = F.when(F.col("p_type") == "LARGE", -F.col("p_partkey") - 1).otherwise(F.col("p_partkey"))
    new = parts.select(
        key.alias("p_partkey"), "p_name", raised.cast("decimal(11,2)").alias("price")
    )
    return catalog.publish_diff(old, new, ["p_partkey"])


@query(
    "purge_failing",
    """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (
        SELECT user_id FROM events WHERE event_type = 'error' AND contains(props, '40'))
    """,
)
def purge_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    reports = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return catalog.purge(entries, reports, "c_custkey", "user_id", "props", "40")


@query(
    "catalog_listing",
    """
    SELECT p_type, p_partkey, p_size FROM part
    ORDER BY p_type, p_size DESC, p_partkey DESC
    """,
)
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size")
    return catalog.listing(parts, "p_type", "p_size", ["p_partkey"])


@query(
    "catalog_render",
    """
    SELECT id, provider || '/' || CASE WHEN free THEN 'FREE-' ELSE '' END || id AS model_name,
           provider || '/' || id AS model,
           '"' || CASE WHEN free THEN '🟢 FREE: ' || id ELSE id END || '"' AS name,
           '"Say \\"' || p_name || '\\""' AS description,
           '["chat","' || p_type || '","' || CASE WHEN free THEN 'grátis' ELSE 'pago' END || '"]'
               AS tags
    FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS id, p_size < 10 AS free,
                 CASE p_type WHEN 'PROMO' THEN 'gemini' ELSE p_type END AS provider
          FROM part)
    """,
)
def catalog_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("p_type") == "PROMO", "google").otherwise(F.col("p_type"))
    entries = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        provider.alias("provider"),
        F.concat_ws(", ", F.lit("chat"), "p_type").alias("category"),
        F.concat(F.lit('Say "'), "p_name", F.lit('"')).alias("description"),
        (F.col("p_size") < 10).alias("free"),
    )
    return catalog.render(entries, "id", "provider", "category", "description", "free")


@query(
    "catalog_lines",
    f"""
    SELECT p_partkey,
           coalesce(nullif(regexp_extract({ITEM_ID}, '^(red|blue)', 1), ''),
                    nullif(regexp_extract({ITEM_ID}, '^([a-z])[a-z]+-ro', 1), ''),
                    split_part({ITEM_ID}, '-', 1)) AS line,
           coalesce(nullif(regexp_extract({ITEM_ID}, '^([a-z]+-[a-z]+-[0-9]+)', 1), ''), 'other')
               AS version_prefix
    FROM part
    """,
)
def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("id")
    line = catalog.derive_line(
        item, ["^(red|blue)", "^([a-z])[a-z]+-ro"], F.split(item, "-").getItem(0)
    )
    prefix = catalog.derive_line(item, ["^([a-z]+-[a-z]+-[0-9]+)"], F.lit("other"))
    return _items(spark, sf_dir).select(
        "p_partkey", line.alias("line"), prefix.alias("version_prefix")
    )
