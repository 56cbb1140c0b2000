import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from storeloom.operators import catalog
from storeloom.plans import catalog_sync


def test_filter_needs_a_substring_of_an_element(spark):
    df = spark.createDataFrame(
        [
            ("a", "x", ["streamGenerateContent2"]),
            ("b", "x", ["embed"]),
            ("c", "barred", ["GenerateContent"]),
            ("d", None, None),
            ("e", None, ["GenerateContent"]),
        ],
        "id STRING, owner STRING, can ARRAY<STRING>",
    )
    got = catalog.filter_catalog(
        df, "id", exclude=["^z"], owner="owner", not_owners=["barred"], needs={"can": "GenerateContent"}
    )
    assert {r.id for r in got.collect()} == {"a", "e"}


def test_classify_takes_the_first_match(spark):
    df = spark.createDataFrame([("tts-search",), ("search",), ("plain",)], "id STRING")
    got = df.select(catalog.classify(F.col("id"), [("tts", "audio"), ("search", "search")], "chat"))
    assert [r[0] for r in got.collect()] == ["audio", "search", "chat"]


def test_pick_preferred_by_flag_then_position(spark):
    df = spark.createDataFrame(
        [("k", False, 0), ("k", True, 2), ("k", True, 1), ("m", None, 4), ("m", False, 3)],
        "key STRING, alias BOOLEAN, pos INT",
    )
    got = catalog.pick_preferred(df, "key", "alias", "pos")
    assert rows(got) == [("k", True, 1), ("m", False, 3)]


def test_latest_line_keeps_all_rows_of_the_newest_version(spark):
    df = spark.createDataFrame(
        [
            ("gpt", "gpt-4", 10, "a"),
            ("gpt", "gpt-5", 20, "b"),
            ("gpt", "gpt-5", 5, "c"),
            ("gpt", "gpt-6", 20, "aa"),
            (None, "v", 1, "z"),
        ],
        "line STRING, version STRING, created INT, id STRING",
    )
    got = {r.id for r in catalog.latest_line(df, "line", "version", "created", "id").collect()}
    # b and aa tie on created; the higher id counts as the last.
    assert got == {"b", "c", "z"}


def test_numeric_versions_by_fallback(spark):
    ids = ["gemini-2.5-pro", "gemini-3-pro", "imagen-4", "plain", "x-10"]
    df = spark.createDataFrame([(i,) for i in ids], "id STRING")
    version = catalog.numeric_version(F.col("id"), catalog_sync.GOOGLE_VERSIONS)
    got = df.select("id", version.alias("v"))
    assert [r.v for r in got.collect()] == [2.5, 3.0, 4.0, 1.0, 10.0]
    newest = catalog.latest_numeric(got.withColumn("tier", F.lit("t")), "tier", "v")
    assert [r.id for r in newest.collect()] == ["x-10"]


def test_tags_are_a_sorted_set(spark):
    df = spark.createDataFrame([(True, ["text", "image", "chat"]), (None, None)], "f BOOLEAN, m ARRAY<STRING>")
    tags = catalog.tags([(True, ["chat"]), (F.col("f"), ["tools"])], [F.col("m")], ["text"])
    assert [r[0] for r in df.select(tags).collect()] == ["chat, image, tools", "chat"]


def test_free_means_the_text_zero(spark):
    df = spark.createDataFrame([("0", "0"), ("0.0", "0"), (None, "0")], "p STRING, c STRING")
    got = df.select(catalog.free_tier(F.col("p"), F.col("c")))
    assert [r[0] for r in got.collect()] == [True, False, False]


ROUTES = (
    catalog.Source("a", ("-flash$", "-lite$")),
    catalog.Source("b", ("flash",), newest=True, prefix="bb"),
)


@pytest.mark.parametrize(
    "entries, want",
    [
        ([], "default"),
        ([("c", "x", 1, 9)], "default"),
        ([("a", "x", 1, 5), ("a", "y-lite", 1, 1), ("b", "flash", 9, 9)], "a/y-lite"),
        ([("a", "x-flash", 1, 1), ("a", "y-flash", 1, 2), ("a", "z-lite", 1, 9)], "a/y-flash"),
        ([("a", "x", 1, 1), ("a", "y", 1, 2)], "a/y"),
        ([("b", "flash-1", 5, 9), ("b", "flash-2", 7, 1), ("b", "zz", 9, 99)], "bb/flash-2"),
        # Equally new: the one listed last.
        ([("b", "flash-1", 7, 9), ("b", "flash-2", 7, 1)], "bb/flash-2"),
        ([("b", "x", 7, 9), ("b", "y", 9, 1)], "bb/x"),
    ],
)
def test_route(spark, entries, want):
    df = spark.createDataFrame(entries, "src STRING, id STRING, created INT, place INT")
    got = catalog.route(df, "id", "src", "created", ["place"], ROUTES, "default")
    assert [r.target for r in got.collect()] == [want]


def test_publish_only_on_change(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id INT, v STRING")
    new = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "id INT, v STRING")
    assert rows(catalog.publish_diff(old, new, ["id"])) == [(1, "changed"), (3, "removed"), (4, "added")]
    path = str(tmp_path / "out")
    assert not catalog.publish_if_changed(old, old, ["id"], path)
    assert catalog.publish_if_changed(old, new, ["id"], path)
    assert not catalog.publish_if_changed(spark.read.parquet(path), new, ["id"], path + "2")


def test_unify_with_a_silent_source(spark):
    a = spark.createDataFrame([(1, "x")], "id INT, only_a STRING")
    b = spark.createDataFrame([], "id INT")
    c = spark.createDataFrame([(1,), (1,)], "id INT")
    assert rows(catalog.unify([a, b, c])) == [(1, "x"), (1, None), (1, None)]


def test_purge(spark):
    df = spark.createDataFrame([("m1",), ("m2",)], "id STRING")
    failures = spark.createDataFrame([("m1", "404"), ("m1", "404"), ("m2", "500")], "m STRING, e STRING")
    once = catalog.purge(df, failures, "id", "m", "e", "404")
    assert rows(once) == [("m2",)]
    assert rows(catalog.purge(once, failures, "id", "m", "e", "404")) == [("m2",)]


def test_render_quotes_and_marks(spark):
    df = spark.createDataFrame(
        [("g-1", "google", "chat, tools", 'say "é"\n', True), ("o", "openai", "chat", "d", False)],
        "id STRING, p STRING, c STRING, d STRING, f BOOLEAN",
    )
    a, b = catalog.render(df, "id", "p", "c", "d", "f").collect()
    assert (a.model_name, a.model) == ("gemini/FREE-g-1", "gemini/g-1")
    assert json.loads(a.name) == "🟢 FREE: g-1"
    assert a.description == '"say \\"é\\"\\n"'
    assert json.loads(a.tags) == ["chat", "tools", "grátis"]
    assert (b.model_name, b.name, b.tags) == ("openai/o", '"o"', '["chat","pago"]')


def docs(spark, *answers):
    return spark.createDataFrame(
        [(i, a if isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)],
        "page INT, doc STRING",
    )


@pytest.fixture(scope="module")
def answers(spark):
    openai = [
        {"id": "gpt-4o-2024-08-06", "owned_by": "system", "created": 100},
        {"id": "gpt-5.1-2025-11-13", "owned_by": "system", "created": 300},
        {"id": "gpt-5.1", "owned_by": "system", "created": 290},
        {"id": "gpt-5.1-mini", "owned_by": "system", "created": 250},
        {"id": "gpt-5", "owned_by": "system", "created": 200},
        {"id": "o3-2025-04-16", "owned_by": "system", "created": 150},
        {"id": "o3-mini", "owned_by": "system", "created": 120},
        {"id": "o1", "owned_by": "system", "created": 110},
        {"id": "gpt-9", "owned_by": "openai-internal", "created": 999},
        {"id": "gpt-4o-audio-preview", "owned_by": "system", "created": 999},
        {"id": "chatgpt-4o-latest", "owned_by": "system", "created": 999},
        {"id": "text-embedding-3", "owned_by": "system", "created": 999},
    ]
    anthropic = [
        {
            "id": "claude-sonnet-4-5-20250929",
            "display_name": "Sonnet 4.5",
            "created_at": "2025-09-29T00:00:00Z",
            "capabilities": {"image_input": {"supported": True}, "thinking": {"supported": False}},
        },
        {"id": "claude-sonnet-4-20250514", "created_at": "2025-05-22T00:00:00Z"},
        {"id": "claude-3-opus-20240229", "created_at": "2024-02-29T00:00:00Z"},
        {"id": "claude-haiku-latest", "created_at": "2026-01-01T00:00:00Z"},
    ]
    can = ["generateContent", "countTokens"]
    google = [
        {"name": "models/gemini-2.5-flash", "supportedGenerationMethods": can, "thinking": True},
        {"name": "models/gemini-2.5-flash-002", "supportedGenerationMethods": can},
        {"name": "models/gemini-2.0-flash-001", "supportedGenerationMethods": can},
        {"name": "models/gemini-2.0-flash", "supportedGenerationMethods": can},
        {"name": "models/gemini-3-pro-preview", "supportedGenerationMethods": can, "description": "Pro"},
        {"name": "models/gemma-3-27b-it", "supportedGenerationMethods": can},
        {"name": "models/embedding-001", "supportedGenerationMethods": ["embedContent"]},
        {"name": "models/gemini-2.5-flash-preview-tts", "supportedGenerationMethods": can},
    ]
    router = [
        {
            "id": "meta/llama-4:free",
            "created": 5,
            "pricing": {"prompt": "0", "completion": "0"},
            "architecture": {"input_modalities": ["text", "image"]},
            "supported_parameters": ["tools", "include_reasoning"],
        },
        {"id": "paid/x", "created": 9, "pricing": {"prompt": "0.1", "completion": "0"}},
    ]
    return {
        "openai": docs(spark, {"data": openai[:5]}, {"data": openai[5:]}),
        "anthropic": docs(spark, {"data": anthropic}),
        "google": docs(spark, {"models": google}),
        "deepseek": docs(spark, {"data": [{"id": "deepseek-v3-flash"}, {"id": "deepseek-chat", "created": 4}]}),
        "openrouter": docs(spark, {"data": router}),
    }


def test_sync_of_five_sources(answers):
    got = catalog_sync.listed(catalog_sync.sync(answers)).collect()
    shown = [(r.Provider, r.ID, r.Family, r.Category, r.Free, r.Created, r.Alias) for r in got]
    assert shown == [
        ("anthropic", "claude-sonnet-4-5", "sonnet", "chat, image, tools, vision", False, 1759104000, False),
        ("anthropic", "claude-3-opus", "other", "chat, tools", False, 1709164800, False),
        ("deepseek", "deepseek-v3-flash", "deepseek-v3", "chat, tools, reasoning", False, 0, True),
        ("deepseek", "deepseek-chat", "deepseek", "chat, tools, reasoning", False, 4, True),
        ("google", "gemini-3-pro-preview", "gemini-pro", "audio, chat, image, tools, video, vision", False, 0, False),
        ("google", "gemma-3-27b-it", "gemma-27b-it", "chat, tools", True, 0, True),
        (
            "google",
            "gemini-2.5-flash",
            "gemini-flash",
            "audio, chat, image, reasoning, tools, video, vision",
            True,
            0,
            True,
        ),
        ("openai", "gpt-5.1", "gpt-5.1", "chat, image, tools, vision", False, 290, True),
        ("openai", "gpt-5.1-mini", "gpt-5.1", "chat, image, tools, vision", False, 250, True),
        ("openai", "o3", "o3", "chat, reasoning, tools", False, 150, False),
        ("openai", "o3-mini", "o3", "chat, reasoning, tools", False, 120, True),
        ("openrouter", "meta/llama-4", "meta/llama", "chat, image, reasoning, tools", True, 5, True),
    ]


def test_route_over_the_sources(spark, answers):
    def target(names):
        return catalog_sync.target(catalog_sync.sync({n: answers[n] for n in names})).first()[0]

    assert target(answers) == "gemini/gemini-2.5-flash"
    assert target(["deepseek", "anthropic"]) == "deepseek/deepseek-v3-flash"
    assert target(["anthropic", "openai"]) == "anthropic/claude-sonnet-4-5"
    assert target(["openai"]) == "openai/gpt-5.1"
    assert target(["openrouter"]) == "openrouter/free"


def test_broken_and_empty_answers_do_no_harm(spark, answers):
    broken = {**answers, "openai": docs(spark, "not json", {"data": []}, {"error": 1})}
    got = catalog_sync.sync(broken)
    assert {r.Provider for r in got.select("Provider").distinct().collect()} == set(answers) - {"openai"}
    with pytest.raises(ValueError):
        catalog_sync.sync({})


def test_free_only_google(spark, answers):
    items = catalog_sync.entries_of("google", answers["google"])
    assert {r.ID for r in catalog_sync.google_entries(items, free_only=True).collect()} == {
        "gemini-2.5-flash",
        "gemma-3-27b-it",
    }


def test_published_twice_is_no_change(answers):
    entries = catalog_sync.sync(answers)
    shown = catalog_sync.published(entries)
    assert catalog.publish_diff(shown, catalog_sync.published(entries), ["model_name"]).isEmpty()
    assert "gemini/FREE-gemini-2.5-flash" in {r.model_name for r in shown.collect()}
