"""The daily catalogue sync: five sources, reduced to their current entries.

Each source's answer comes in as a DataFrame of JSON documents (column ``doc``), one per
page of the answer, with the page's number in ``page`` if there are several.  What comes
out has one schema (``UNIFIED``) plus the place columns that tell the listing order,
highest first.  A source that did not answer is simply not passed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.functions.text import some_contains, strip_all
from storeloom.operators import catalog
from storeloom.sources.payloads import explode_list

UNIFIED = ("ID", "Family", "Provider", "Category", "Description", "Free", "Created", "Alias")
PLACE = ("place_number", "place_line", "place_key", "place_pos")

# Where each source keeps its list, and the fields read from it.
LISTS = {
    "openai": ("data", "id STRING, owned_by STRING, created BIGINT"),
    "anthropic": (
        "data",
        "id STRING, display_name STRING, created_at STRING, capabilities STRUCT<"
        "image_input: STRUCT<supported: BOOLEAN>, thinking: STRUCT<supported: BOOLEAN>, "
        "pdf_input: STRUCT<supported: BOOLEAN>>",
    ),
    "google": (
        "models",
        "name STRING, description STRING, supportedGenerationMethods ARRAY<STRING>, "
        "thinking BOOLEAN",
    ),
    "deepseek": ("data", "id STRING, created BIGINT"),
    "openrouter": (
        "data",
        "id STRING, description STRING, created BIGINT, "
        "pricing STRUCT<prompt: STRING, completion: STRING>, "
        "architecture STRUCT<input_modalities: ARRAY<STRING>>, "
        "supported_parameters ARRAY<STRING>",
    ),
}

# Categories of an id, the first match counting.
CATEGORIES = (
    ("embedding", "embedding"),
    ("moderation", "moderation"),
    ("tts|audio", "audio"),
    ("transcribe|whisper", "transcription"),
    ("realtime", "realtime"),
    ("image|dall-e|sora", "media"),
    ("search", "search"),
)
# Ids that are left out, per source.
EXCLUDED = {
    "openai": (
        "^(ra-|ft:|user-|system-)",
        r"gpt-3\.5|babbage|davinci|instruct|codex",
        "latest$",
    ),
    "anthropic": ("latest$",),
    "google": (
        "embedding|lyria|robotics|aqa|computer-use|antigravity|deep-research|imagen|veo|tts"
        "|-latest$|nano-banana",
    ),
    "deepseek": ("latest$", "embedding|moderation"),
    "openrouter": ("openrouter/free|content-safety|guardrail|lyria|embedding|moderation",),
}
# Decorations that are not part of the canonical id.
DECORATIONS = {
    "openai": ("-[0-9]{4}-[0-9]{2}-[0-9]{2}$",),
    "anthropic": ("(-[0-9]{8}|-[0-9]{4}-[0-9]{2}-[0-9]{2})$",),
    "google": ("-(preview|001|002)$", "-preview-.*$"),
    "openrouter": (":free$",),
}
# Product lines, tiers and versions within an id.
OPENAI_LINES = ("^(gpt)", "^(o)[0-9]")
OPENAI_VERSIONS = (r"^(gpt-[0-9]+(?:\.[0-9]+)?)", "^(gpt-4o)", "^(o[0-9]+)")
ANTHROPIC_TIERS = ("^claude-([a-z]+)",)
ANTHROPIC_VERSIONS = ("^(claude-[a-z]+-[0-9]+(?:[.-][0-9]+)?)",)
GOOGLE_PREFIX = "^models/"
GOOGLE_METHOD = "generateContent"
GOOGLE_VERSIONS = (r"([0-9]+\.[0-9]+)", "-([0-9]+)-", "-([0-9]+)$")
GOOGLE_TIER_NOISE = (
    r"^(gemini|gemma)-[0-9]+(\.[0-9]+)?-?",
    "-(preview|001|002|customtools).*$",
)
GOOGLE_UNSTABLE = "preview|001"
GOOGLE_FREE = "gemma|flash"
DEEPSEEK_FAMILIES = ("^(deepseek-v[0-9]+)",)
DEEPSEEK_CATEGORY = "chat, tools, reasoning"

# How an entry without a description of its own is described.
DESCRIPTIONS = {
    "openai": "Modelo Oficial OpenAI: ",
    "anthropic": "Modelo Anthropic ",
    "google": "Modelo multimodal Google Gemini",
    "deepseek": ("Modelo Oficial DeepSeek ", " (Suporte a Raciocínio CoT e Function Calling)"),
    "openrouter": "Modelo agregado via OpenRouter",
}

# Which source requests go to first, which of its entries, and the default.
ROUTES = (
    catalog.Source("google", ("-flash$", "-flash-lite$"), prefix="gemini"),
    catalog.Source("deepseek", ("flash",), newest=True),
    catalog.Source("anthropic", ("sonnet",), newest=True),
    catalog.Source("openai", ("luna",), newest=True),
)
DEFAULT_ROUTE = "openrouter/free"


def _unified(
    df: DataFrame,
    provider: str,
    values: Mapping[str, Column],
    place: tuple[Column, Column, Column, Column],
) -> DataFrame:
    number, line, key, pos = place
    shaped = {**values, "Provider": F.lit(provider)}
    return df.select(
        *[shaped[name].alias(name) for name in UNIFIED],
        number.cast("double").alias(PLACE[0]),
        line.cast("string").alias(PLACE[1]),
        key.cast("string").alias(PLACE[2]),
        pos.cast("double").alias(PLACE[3]),
    )


def openai_entries(items: DataFrame) -> DataFrame:
    chat = catalog.filter_catalog(
        items, "id", exclude=EXCLUDED["openai"], owner="owned_by", not_owners=["openai-internal"]
    ).filter(catalog.classify(F.col("id"), CATEGORIES, "chat") == "chat")
    named = chat.withColumn("canonical", catalog.canonical(F.col("id"), DECORATIONS["openai"]))
    lined = named.withColumns(
        {
            "is_alias": F.col("id") == F.col("canonical"),
            "line": catalog.derive_line(F.col("id"), OPENAI_LINES, F.split("id", "-").getItem(0)),
            "version": catalog.derive_line(
                F.col("id"), OPENAI_VERSIONS, F.split("canonical", "-").getItem(0)
            ),
        }
    )
    one_each = catalog.pick_preferred(lined, "canonical", "is_alias", "pos")
    current = catalog.latest_line(one_each, "line", "version", "created", "canonical")
    ident = F.col("canonical")
    return _unified(
        current,
        "openai",
        {
            "ID": ident,
            "Family": F.col("version"),
            "Category": catalog.tags(
                [
                    (True, ["chat", "tools"]),
                    (ident.rlike("gpt-4|gpt-5"), ["image", "vision"]),
                    (ident.rlike("^o[0-9]"), ["reasoning"]),
                ]
            ),
            "Description": F.concat(F.lit(DESCRIPTIONS["openai"]), ident),
            "Free": F.lit(False),
            "Created": F.col("created"),
            "Alias": F.col("is_alias"),
        },
        (F.col("created"), F.col("line"), ident, F.lit(0)),
    )


def anthropic_entries(items: DataFrame) -> DataFrame:
    kept = catalog.filter_catalog(items, "id", exclude=EXCLUDED["anthropic"])
    named = kept.withColumn("canonical", catalog.canonical(F.col("id"), DECORATIONS["anthropic"]))
    lined = named.withColumns(
        {
            "is_alias": F.col("id") == F.col("canonical"),
            "line": catalog.derive_line(F.col("id"), ANTHROPIC_TIERS, F.lit("other")),
            "version": catalog.derive_line(
                F.col("canonical"), ANTHROPIC_VERSIONS, F.col("canonical")
            ),
        }
    )
    one_each = catalog.pick_preferred(lined, "canonical", "is_alias", "pos")
    current = catalog.latest_line(one_each, "line", "version", "created_at", "canonical")
    ident = F.col("canonical")
    created = F.unix_timestamp(F.try_to_timestamp("created_at"))

    def able(name: str) -> Column:
        return F.col(f"capabilities.{name}.supported")

    return _unified(
        current,
        "anthropic",
        {
            "ID": ident,
            "Family": F.col("line"),
            "Category": catalog.tags(
                [
                    (True, ["chat", "tools"]),
                    (able("image_input"), ["image", "vision"]),
                    (able("thinking"), ["reasoning"]),
                    (able("pdf_input"), ["pdf_analysis"]),
                ]
            ),
            "Description": F.coalesce(
                "display_name", F.concat(F.lit(DESCRIPTIONS["anthropic"]), ident)
            ),
            "Free": F.lit(False),
            "Created": created,
            "Alias": F.col("is_alias"),
        },
        (created, F.col("line"), ident, F.lit(0)),
    )


def google_entries(items: DataFrame, free_only: bool = False) -> DataFrame:
    kept = catalog.filter_catalog(
        items,
        "name",
        include=[GOOGLE_FREE] if free_only else (),
        exclude=EXCLUDED["google"],
        needs={"supportedGenerationMethods": GOOGLE_METHOD},
    )
    named = kept.withColumn("id", strip_all(F.col("name"), [GOOGLE_PREFIX]))
    ident = F.col("id")
    tier = strip_all(ident, GOOGLE_TIER_NOISE)
    lined = named.withColumns(
        {
            "canonical": catalog.canonical(ident, DECORATIONS["google"]),
            "version": catalog.numeric_version(ident, GOOGLE_VERSIONS),
            "tier": F.coalesce(F.nullif(tier, F.lit("")), F.lit("base")),
            "is_stable": ~ident.rlike(GOOGLE_UNSTABLE),
        }
    )
    one_each = catalog.pick_preferred(lined, "canonical", "is_stable", "pos")
    current = catalog.latest_numeric(one_each, "tier", "version")
    maker = F.when(ident.rlike("^gemma"), "gemma-").otherwise("gemini-")
    return _unified(
        current,
        "google",
        {
            "ID": ident,
            "Family": F.concat(maker, F.col("tier")),
            "Category": catalog.tags(
                [
                    (True, ["chat", "tools"]),
                    (ident.rlike("gemini"), ["image", "vision", "audio", "video"]),
                    (F.col("thinking"), ["reasoning"]),
                ]
            ),
            "Description": F.coalesce("description", F.lit(DESCRIPTIONS["google"])),
            "Free": catalog.free_tier(name=ident, patterns=[GOOGLE_FREE]),
            "Created": F.lit(0).cast("bigint"),
            "Alias": F.col("is_stable"),
        },
        (F.col("version"), F.col("tier"), F.col("canonical"), F.lit(0)),
    )


def deepseek_entries(items: DataFrame) -> DataFrame:
    kept = catalog.filter_catalog(items, "id", exclude=EXCLUDED["deepseek"])
    ident = F.col("id")
    return _unified(
        kept,
        "deepseek",
        {
            "ID": ident,
            "Family": catalog.derive_line(ident, DEEPSEEK_FAMILIES, F.lit("deepseek")),
            "Category": F.lit(DEEPSEEK_CATEGORY),
            "Description": F.concat(
                F.lit(DESCRIPTIONS["deepseek"][0]),
                ident,
                F.lit(DESCRIPTIONS["deepseek"][1]),
            ),
            "Free": F.lit(False),
            "Created": F.coalesce("created", F.lit(0)),
            "Alias": F.lit(True),
        },
        (-F.col("pos"), F.lit(""), F.lit(""), F.lit(0)),
    )


def openrouter_entries(items: DataFrame) -> DataFrame:
    free = catalog.free_tier(F.col("pricing.prompt"), F.col("pricing.completion"))
    kept = catalog.filter_catalog(
        items.withColumn("free", free).filter("free"), "id", exclude=EXCLUDED["openrouter"]
    )
    ident = strip_all(F.col("id"), DECORATIONS["openrouter"])
    params = F.col("supported_parameters")
    return _unified(
        kept,
        "openrouter",
        {
            "ID": ident,
            "Family": F.split(ident, "-").getItem(0),
            "Category": catalog.tags(
                [
                    (True, ["chat"]),
                    (some_contains(params, "tools"), ["tools"]),
                    (some_contains(params, "reasoning"), ["reasoning"]),
                ],
                lists=[F.col("architecture.input_modalities")],
                drop=["text"],
            ),
            "Description": F.coalesce("description", F.lit(DESCRIPTIONS["openrouter"])),
            "Free": F.col("free"),
            "Created": F.col("created"),
            "Alias": F.lit(True),
        },
        (F.col("created"), F.lit(""), F.lit(""), F.col("pos")),
    )


ENTRIES = {
    "openai": openai_entries,
    "anthropic": anthropic_entries,
    "google": google_entries,
    "deepseek": deepseek_entries,
    "openrouter": openrouter_entries,
}


PAGE_ENTRIES = 1 << 32


def entries_of(name: str, documents: DataFrame) -> DataFrame:
    """The list entries of a source's documents, ``pos`` counting on from page to page."""
    path, item_ddl = LISTS[name]
    page = F.col("page").cast("bigint") if "page" in documents.columns else F.lit(0)
    pages = documents.select(page.alias("_page"), "doc")
    items = explode_list(pages, "doc", path, item_ddl)
    return items.withColumn("pos", F.col("_page") * PAGE_ENTRIES + F.col("pos")).drop("_page")


def sync(documents: Mapping[str, DataFrame], free_only: bool = False) -> DataFrame:
    """Current entries of all sources that answered, in one schema.

    ``free_only`` leaves out what costs something at the source that lists both.
    """
    options = {"google": {"free_only": free_only}}
    parts = [
        entries(entries_of(name, documents[name]), **options.get(name, {}))
        for name, entries in ENTRIES.items()
        if name in documents
    ]
    if not parts:
        raise ValueError(f"no known source among {sorted(documents)}")
    return catalog.unify(parts)


def listed(entries: DataFrame) -> DataFrame:
    """Sources in name order, each newest first."""
    return entries.orderBy("Provider", *[F.desc(c) for c in PLACE])


def target(entries: DataFrame) -> DataFrame:
    """Where requests without a wish of their own go."""
    return catalog.route(entries, "ID", "Provider", "Created", PLACE, ROUTES, DEFAULT_ROUTE)


def published(entries: DataFrame) -> DataFrame:
    return catalog.render(entries, "ID", "Provider", "Category", "Description", "Free")
