"""The catalogue sync on documents that Spark builds from the parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.operators import catalog
from storeloom.plans import catalog_sync
from storeloom.plans.catalog_queries import spark_sql
from storeloom.plans.fixtures import table
from storeloom.plans.registry import query

WORD1, WORD2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
# SQL both engines read: the ids and prices a source lists for a part.
OPENAI_ID = f"""CASE WHEN p_type IN ('ECONOMY', 'LARGE')
        THEN 'gpt-' || (p_size % 3 + 4) || '.' || (p_size % 2) || '-' || {WORD2}
    WHEN p_type = 'SMALL' THEN 'o' || (p_size % 4 + 1) || '-' || {WORD1}
    WHEN p_type = 'MEDIUM' THEN {WORD1} || '-' || {WORD2}
    ELSE {WORD1} || '-tts' END
    || CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
        THEN '-2024-05-' || lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE '' END"""
OPENAI_OWNER = "CASE WHEN p_brand = 'Brand#9' THEN 'openai-internal' ELSE 'system' END"
GOOGLE_NAME = f"""'models/' || CASE WHEN p_type = 'PROMO' THEN 'gemma-' ELSE 'gemini-' END
    || CASE WHEN p_size % 2 = 0 THEN (p_size % 3 + 1) || '.' || (p_size % 5)
            ELSE CAST(p_size % 3 + 1 AS VARCHAR) END
    || CASE WHEN p_type = 'LARGE' THEN '-pro' WHEN p_type = 'SMALL' THEN '-flash-lite'
            WHEN p_type = 'ECONOMY' THEN '-flash' WHEN p_type = 'MEDIUM' THEN '-tts'
            WHEN p_type = 'PROMO' THEN '-' || {WORD2} ELSE '' END
    || CASE p_brand WHEN 'Brand#1' THEN '-preview' WHEN 'Brand#2' THEN '-001'
            WHEN 'Brand#3' THEN '-002' WHEN 'Brand#4' THEN '-preview-05' ELSE '' END"""
ANTHROPIC_ID = """'claude-' || CASE p_type WHEN 'ECONOMY' THEN 'opus-' WHEN 'SMALL' THEN 'sonnet-'
        WHEN 'MEDIUM' THEN 'haiku-' WHEN 'LARGE' THEN '' ELSE 'sonnet-' END
    || (p_size % 4 + 1) || CASE WHEN p_size % 2 = 0 THEN '.' || (p_size % 3) ELSE '' END
    || CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
            THEN '-2025' || lpad(CAST(p_size AS VARCHAR), 4, '0')
            WHEN p_brand = 'Brand#7' THEN '-latest' ELSE '' END"""
ANTHROPIC_AT = "'2024-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '-01T00:00:00Z'"
DEEPSEEK_ID = f"""CASE WHEN p_type = 'PROMO' THEN 'deepseek-v' || p_size
    WHEN p_type = 'LARGE' THEN 'deepseek-latest' ELSE 'deepseek-' || {WORD2} END"""
ROUTER_ID = f"{WORD1} || '-' || {WORD2} || CASE WHEN p_type = 'PROMO' THEN ':free' ELSE '' END"
ROUTER_PROMPT = "CASE WHEN p_size < 20 THEN '0' ELSE CAST(p_size AS VARCHAR) END"
ROUTER_COMPLETION = "CASE WHEN p_size % 2 = 0 THEN '0' ELSE '0.0' END"


CURRENT = f"""
openai AS (
    SELECT *, regexp_replace(id, '-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', '') AS canonical
    FROM (SELECT p_partkey AS pos, p_size AS created, {OPENAI_ID} AS id, {OPENAI_OWNER} AS owner
          FROM part)
    WHERE owner <> 'openai-internal' AND NOT contains(id, 'tts')
), openai_named AS (
    SELECT *, CASE WHEN starts_with(id, 'gpt') THEN 'gpt' WHEN regexp_matches(id, '^o[0-9]')
                  THEN 'o' ELSE split_part(id, '-', 1) END AS line,
           CASE WHEN starts_with(id, 'gpt') THEN regexp_extract(id, '^gpt-[0-9]+(\\.[0-9]+)?')
                WHEN regexp_matches(id, '^o[0-9]') THEN regexp_extract(id, '^o[0-9]+')
                ELSE split_part(canonical, '-', 1) END AS version
    FROM openai
    QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY id <> canonical, pos) = 1
), openai_newest AS (
    SELECT line, version FROM openai_named
    QUALIFY row_number() OVER (PARTITION BY line ORDER BY created DESC, canonical DESC) = 1
), google AS (
    SELECT *, regexp_replace(regexp_replace(id, '-(preview|001|002)$', ''), '-preview-.*$', '')
                  AS canonical,
           coalesce(nullif(regexp_replace(regexp_replace(id,
               '^(gemini|gemma)-[0-9]+(\\.[0-9]+)?-?', ''), '-(preview|001|002).*$', ''), ''),
               'base') AS tier,
           CAST(coalesce(nullif(regexp_extract(id, '[0-9]+\\.[0-9]+'), ''),
               nullif(regexp_extract(id, '-([0-9]+)-', 1), ''),
               nullif(regexp_extract(id, '-([0-9]+)$', 1), ''), '1.0') AS DOUBLE) AS version,
           NOT regexp_matches(id, 'preview|001') AS stable
    FROM (SELECT p_partkey AS pos, p_size, p_name, p_brand,
                 replace({GOOGLE_NAME}, 'models/', '') AS id FROM part)
    WHERE NOT contains(id, 'tts') AND p_brand <> 'Brand#8'
), google_named AS (
    SELECT * FROM google
    QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY NOT stable, pos) = 1
), google_newest AS (SELECT tier, max(version) AS version FROM google_named GROUP BY tier),
anthropic AS (
    SELECT *, regexp_replace(id, '-[0-9]{{8}}$', '') AS canonical,
           coalesce(nullif(regexp_extract(id, '^claude-([a-z]+)', 1), ''), 'other') AS tier
    FROM (SELECT *, p_partkey AS pos, {ANTHROPIC_ID} AS id,
                 CAST({ANTHROPIC_AT} AS TIMESTAMP) AS created FROM part)
    WHERE NOT regexp_matches(id, 'latest$')
), anthropic_named AS (
    SELECT *, coalesce(nullif(regexp_extract(canonical,
                  '^claude-[a-z]+-[0-9]+([.-][0-9]+)?'), ''), canonical) AS version
    FROM anthropic
    QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY id <> canonical, pos) = 1
), anthropic_newest AS (
    SELECT tier, version FROM anthropic_named
    QUALIFY row_number() OVER (PARTITION BY tier ORDER BY created DESC, canonical DESC) = 1
)
"""
ENTRIES = f"""
SELECT canonical AS "ID", version AS "Family", 'openai' AS "Provider",
       CASE WHEN regexp_matches(canonical, 'gpt-4|gpt-5') THEN 'chat, image, tools, vision'
            WHEN line = 'o' THEN 'chat, reasoning, tools' ELSE 'chat, tools' END AS "Category",
       'Modelo Oficial OpenAI: ' || canonical AS "Description", false AS "Free",
       CAST(created AS BIGINT) AS "Created", id = canonical AS "Alias"
FROM openai_named JOIN openai_newest USING (line, version)
UNION ALL
SELECT canonical, tier, 'anthropic',
       'chat' || CASE WHEN p_size > 25 THEN ', image' ELSE '' END
           || CASE WHEN p_brand <> 'Brand#5' AND p_size % 3 = 0 THEN ', pdf_analysis' ELSE '' END
           || CASE WHEN p_size % 2 = 0 THEN ', reasoning' ELSE '' END || ', tools'
           || CASE WHEN p_size > 25 THEN ', vision' ELSE '' END,
       CASE WHEN p_brand = 'Brand#6' THEN p_name ELSE 'Modelo Anthropic ' || canonical END, false,
       CAST(epoch(created) AS BIGINT), id = canonical
FROM anthropic_named JOIN anthropic_newest USING (tier, version)
UNION ALL
SELECT id, CASE WHEN starts_with(id, 'gemma') THEN 'gemma-' ELSE 'gemini-' END || tier, 'google',
       CASE WHEN NOT contains(id, 'gemini')
                THEN CASE WHEN p_size > 25 THEN 'chat, reasoning, tools' ELSE 'chat, tools' END
            WHEN p_size > 25 THEN 'audio, chat, image, reasoning, tools, video, vision'
            ELSE 'audio, chat, image, tools, video, vision' END,
       CASE WHEN p_brand = 'Brand#5' THEN p_name ELSE 'Modelo multimodal Google Gemini' END,
       regexp_matches(id, 'gemma|flash'), 0, stable
FROM google_named JOIN google_newest USING (tier, version)
UNION ALL
SELECT id, coalesce(nullif(regexp_extract(id, '^deepseek-v[0-9]+'), ''), 'deepseek'), 'deepseek',
       'chat, tools, reasoning',
       'Modelo Oficial DeepSeek ' || id || ' (Suporte a Raciocínio CoT e Function Calling)',
       false, 0, true
FROM (SELECT {DEEPSEEK_ID} AS id FROM part) WHERE NOT regexp_matches(id, 'latest$')
UNION ALL
SELECT replace(id, ':free', ''), split_part(replace(id, ':free', ''), '-', 1), 'openrouter',
       CASE WHEN p_type = 'LARGE' THEN 'chat, image, tools' ELSE 'chat, image' END, p_name, true,
       p_size, true
FROM (SELECT *, {ROUTER_ID} AS id FROM part)
WHERE {ROUTER_PROMPT} = '0' AND {ROUTER_COMPLETION} = '0'
"""
ORACLE = f"WITH {CURRENT} {ENTRIES}"
FREE_ONLY = ORACLE.replace(
    "p_brand <> 'Brand#8'\n", "p_brand <> 'Brand#8' AND regexp_matches(id, 'gemma|flash')\n"
)


def _documents(parts: DataFrame, path: str, **fields: Column) -> DataFrame:
    """One page per part, listing one entry."""
    entry = F.struct(*[value.alias(name) for name, value in fields.items()])
    doc = F.to_json(F.struct(F.array(entry).alias(path)))
    return parts.select(F.col("p_partkey").alias("page"), doc.alias("doc"))


def part_documents(
    spark: SparkSession, sf_dir: str, parts: DataFrame | None = None
) -> dict[str, DataFrame]:
    parts = table(spark, sf_dir, "part") if parts is None else parts
    brand, size = F.col("p_brand"), F.col("p_size")
    method = F.when(brand == "Brand#8", "embedContent").otherwise("generateContent")
    price = F.struct(
        spark_sql(ROUTER_PROMPT).alias("prompt"), spark_sql(ROUTER_COMPLETION).alias("completion")
    )
    inputs = F.struct(F.array(F.lit("text"), F.lit("image")).alias("input_modalities"))
    params = F.when(F.col("p_type") == "LARGE", F.array(F.lit("tools")))
    return {
        "openai": _documents(
            parts,
            "data",
            id=spark_sql(OPENAI_ID),
            owned_by=spark_sql(OPENAI_OWNER),
            created=size.cast("bigint"),
        ),
        "anthropic": _documents(
            parts,
            "data",
            id=spark_sql(ANTHROPIC_ID),
            display_name=F.when(brand == "Brand#6", F.col("p_name")),
            created_at=spark_sql(ANTHROPIC_AT),
            capabilities=F.struct(
                F.struct((size > 25).alias("supported")).alias("image_input"),
                F.struct((size % 2 == 0).alias("supported")).alias("thinking"),
                F.when(brand != "Brand#5", F.struct((size % 3 == 0).alias("supported"))).alias(
                    "pdf_input"
                ),
            ),
        ),
        "google": _documents(
            parts,
            "models",
            name=spark_sql(GOOGLE_NAME),
            description=F.when(brand == "Brand#5", F.col("p_name")),
            supportedGenerationMethods=F.array(method),
            thinking=size > 25,
        ),
        "deepseek": _documents(parts, "data", id=spark_sql(DEEPSEEK_ID)),
        "openrouter": _documents(
            parts,
            "data",
            id=spark_sql(ROUTER_ID),
            description=F.col("p_name"),
            created=size.cast("bigint"),
            pricing=price,
            architecture=inputs,
            supported_parameters=params,
        ),
    }


@query("catalog_sync", ORACLE)
def catalog_sync_(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = catalog_sync.sync(part_documents(spark, sf_dir))
    return entries.select(*catalog_sync.UNIFIED)


@query("catalog_sync_free", FREE_ONLY)
def catalog_sync_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what costs nothing of the source that has both."""
    entries = catalog_sync.sync(part_documents(spark, sf_dir), free_only=True)
    return entries.select(*catalog_sync.UNIFIED)


# What is asked for when the sources before it in the router's order did not answer.
TARGETS = f"""
WITH {CURRENT}, g AS (SELECT * FROM google_named JOIN google_newest USING (tier, version)),
a AS (SELECT * FROM anthropic_named JOIN anthropic_newest USING (tier, version)),
o AS (SELECT * FROM openai_named JOIN openai_newest USING (line, version)),
d AS (SELECT p_partkey AS pos, {DEEPSEEK_ID} AS id FROM part)
SELECT 'google' AS first_source, 'gemini/' || (SELECT id FROM g ORDER BY
    CASE WHEN regexp_matches(id, '-flash$') THEN 0 WHEN regexp_matches(id, '-flash-lite$') THEN 1
         ELSE 2 END, version DESC, tier DESC, canonical DESC LIMIT 1) AS target
UNION ALL SELECT 'deepseek', 'deepseek/' || (SELECT id FROM d WHERE NOT regexp_matches(id, 'latest$')
    ORDER BY CASE WHEN contains(id, 'flash') THEN 0 ELSE 1 END, pos LIMIT 1)
UNION ALL SELECT 'anthropic', 'anthropic/' || coalesce(
    (SELECT canonical FROM a WHERE contains(canonical, 'sonnet')
     ORDER BY created DESC, tier, canonical LIMIT 1),
    (SELECT canonical FROM a ORDER BY created DESC, tier DESC, canonical DESC LIMIT 1))
UNION ALL SELECT 'openai', 'openai/' || coalesce(
    (SELECT canonical FROM o WHERE contains(canonical, 'luna')
     ORDER BY created DESC, line, canonical LIMIT 1),
    (SELECT canonical FROM o ORDER BY created DESC, line DESC, canonical DESC LIMIT 1))
UNION ALL SELECT 'openrouter', 'openrouter/free'
"""


@query("catalog_target", TARGETS)
def catalog_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where requests go: the sources fall silent one after the other."""
    entries = catalog_sync.sync(part_documents(spark, sf_dir))
    order = [s.name for s in catalog_sync.ROUTES] + ["openrouter"]
    return reduce(
        DataFrame.unionByName,
        [
            catalog_sync.target(entries.filter(F.col("Provider").isin(order[n:]))).select(
                F.lit(name).alias("first_source"), "target"
            )
            for n, name in enumerate(order)
        ],
    )


PUBLISHED = """
SELECT "ID" AS id, CASE "Provider" WHEN 'google' THEN 'gemini' ELSE "Provider" END || '/'
           || CASE WHEN "Free" THEN 'FREE-' ELSE '' END || "ID" AS model_name,
       CASE "Provider" WHEN 'google' THEN 'gemini' ELSE "Provider" END || '/' || "ID" AS model,
       CAST(to_json(CASE WHEN "Free" THEN '🟢 FREE: ' ELSE '' END || "ID") AS VARCHAR) AS name,
       CAST(to_json("Description") AS VARCHAR) AS description,
       CAST(to_json(list_append(string_split("Category", ', '),
           CASE WHEN "Free" THEN 'grátis' ELSE 'pago' END)) AS VARCHAR) AS tags
FROM (ENTRIES)
"""


def _published_sql(parts: str) -> str:
    entries = f"WITH {CURRENT} {ENTRIES}".replace("FROM part", f"FROM {parts}")
    return PUBLISHED.replace("ENTRIES", entries)


@query("catalog_published", _published_sql("part"))
def catalog_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_sync.published(catalog_sync.sync(part_documents(spark, sf_dir)))


def _states_sql(parts: str) -> str:
    return f"""SELECT model_name, list(row(name, description, tags) ORDER BY name, description, tags)
        AS shown FROM ({_published_sql(parts)}) GROUP BY model_name"""


@query(
    "catalog_sync_diff",
    f"""
    WITH before AS (SELECT * FROM part WHERE p_partkey % 10 <> 0),
    old AS ({_states_sql("before")}), new AS ({_states_sql("part")})
    SELECT model_name, CASE WHEN old.shown IS NULL THEN 'added' WHEN new.shown IS NULL
               THEN 'removed' ELSE 'changed' END AS change
    FROM old FULL JOIN new USING (model_name)
    WHERE old.shown IS DISTINCT FROM new.shown
    """,
)
def catalog_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync changes against the one before, when a tenth of the parts was not listed.

    A name that several entries share is compared with all it stands for.
    """
    parts = table(spark, sf_dir, "part")
    states = []
    for listed in (parts.filter("p_partkey % 10 <> 0"), parts):
        documents = part_documents(spark, sf_dir, listed)
        shown = catalog_sync.published(catalog_sync.sync(documents))
        entry = F.struct("name", "description", "tags")
        states.append(shown.groupBy("model_name").agg(F.sort_array(F.collect_list(entry)).alias("shown")))
    return catalog.publish_diff(*states, ["model_name"])
