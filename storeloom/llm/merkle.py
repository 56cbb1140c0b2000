"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.llm.common import LOWEST, body, saved

# A paragraph is cut into runs that end with sentence marks; together they are all of it.
SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"
# A section ends after an empty paragraph and after one whose node begins with this digit
# (one in sixteen), so that an edit moves no section border but its own.
BORDER = "0"
EMPTY_NODE = "d41d8cd98f00b204e9800998ecf8427e"  # fixed value: MD5 of nothing

# Bits that are cut off an id level by level to find its neighbour; what is left are 17.
SHIFTS = (12, 18, 17)


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add the levels of the tree over a text column that has no nulls.

    ``<prefix>leaves``: distinct hashes of the sentences; ``<prefix>branches``: for each section
    its paragraphs' nodes, one behind the other; ``<prefix>sections``: the sections' nodes;
    ``<prefix>root``.  A node is the hash of its children's hashes, so equal roots mean equal
    texts, and below unequal nodes the unequal children say where the texts differ.
    """
    sentences = F.transform(
        F.split(text, "\n"),
        lambda p: F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), F.md5),
    )
    paragraphs = F.transform(f"{prefix}_sentences", lambda s: F.md5(F.array_join(s, "")))
    marked = F.array_join(
        F.transform(
            f"{prefix}_paragraphs",
            lambda n: F.when(n.startswith(BORDER) | (n == EMPTY_NODE), F.concat(n, F.lit("|")))
            .otherwise(n),
        ),
        "",
    )
    return (
        df.withColumn(f"{prefix}_sentences", sentences)
        .withColumns(
            {
                f"{prefix}_paragraphs": paragraphs,
                f"{prefix}leaves": F.array_distinct(
                    F.transform(F.flatten(f"{prefix}_sentences"), lambda s: F.xxhash64(s))
                ),
            }
        )
        .withColumn(f"{prefix}branches", F.split(marked, r"\|"))
        .drop(f"{prefix}_sentences", f"{prefix}_paragraphs")
        .withColumn(f"{prefix}sections", F.transform(f"{prefix}branches", F.md5))
        .withColumn(f"{prefix}root", F.sha2(F.array_join(f"{prefix}sections", ""), 256))
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of the leaves of two trees that both have, from 0 to 1; 1 without any leaves."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    total = (F.size(a) + F.size(b)).cast("double")
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * both / total)


NODE = 32  # digits of a node


def _apart(a: Column, b: Column) -> Column:
    """The first place, from 0, at which two lists differ; -1 for equal ones."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return (F.array_position(same, False) - 1).cast("int")


def _children(branch: Column) -> Column:
    """The paragraph nodes of a section."""
    places = F.sequence(F.lit(0), (F.length(branch) / NODE).cast("int") - 1)
    nodes = F.transform(places, lambda i: F.substring(branch, i * NODE + 1, F.lit(NODE)))
    return F.when(F.length(branch) > 0, nodes).otherwise(F.array().cast("array<string>"))


def _equal_paragraphs(one: list[Column], two: list[Column], turn: Callable[[Column], Column]) -> Column:
    """Paragraphs before the first that differs: those of the equal sections, and the equal
    ones of the section whose nodes differ, the only one whose children are compared.

    ``one`` and ``two`` have sections and branches; ``turn`` is how lists are looked at.
    """
    sections, branches, other_sections, other_branches = map(turn, [*one, *two])
    at = _apart(sections, other_sections)
    before = F.length(F.array_join(F.slice(branches, 1, F.greatest(at, F.lit(0))), "")) / NODE
    own, other = (turn(_children(F.get(b, at))) for b in (branches, other_branches))
    below = _apart(own, other)
    return (before + below).cast("long")


def edit_span(a: str, b: str) -> Column:
    """(from, to): the paragraphs of tree ``a``, ``to`` not included, that differ from tree ``b``.

    ``a`` and ``b`` are prefixes given to ``with_tree``.  Unequal roots lead to the first and the
    last section whose nodes differ, those to their paragraphs.  A section ends by its own
    content, so no equal paragraphs lie beyond a section that differs.  Null for equal roots.
    """
    one, two = ([F.col(f"{p}{level}") for level in ("sections", "branches")] for p in (a, b))
    n = (F.length(F.array_join(one[1], "")) / NODE).cast("long")
    head = _equal_paragraphs(one, two, lambda nodes: nodes)
    tail = _equal_paragraphs(one, two, F.reverse)
    span = F.struct(head.alias("from"), F.greatest(head, n - tail).alias("to"))
    return F.when(F.col(f"{a}root") != F.col(f"{b}root"), span)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_chars``, ``n_sections``, ``n_paragraphs``, ``fingerprint``.

    A null text is an empty one: one empty paragraph.  Rows that repeat stay as they are;
    other columns are not looked at.  No shuffle.
    """
    rows = docs.select(F.col(id_col), body(text_col).alias("_text"))
    return with_tree(rows, "_text", "_").select(
        id_col,
        F.length("_text").cast("long").alias("n_chars"),
        F.size("_sections").cast("long").alias("n_sections"),
        (F.length(F.array_join("_branches", "")) / NODE).cast("long").alias("n_paragraphs"),
        F.col("_root").alias("fingerprint"),
    )


def following(ids: DataFrame, shifts: Sequence[int] = SHIFTS) -> DataFrame:
    """(_id, _next) for distinct longs ``_id``: the next lower one, after the lowest the highest.

    Ids are grouped by their upper bits, so a window holds at most 2^12 of them whatever
    their distribution; the last of a group goes on at the top of the next group, which is
    found the same way, level by level.  The uppermost window has at most 2^17 rows.
    """
    down = F.col("_id").desc()
    if not shifts:
        alone = Window.orderBy(down)
        whole = alone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        follower = F.coalesce(F.lead("_id").over(alone), F.first("_id").over(whole))
        return ids.select("_id", follower.alias("_next"))
    grouped = ids.withColumn("_group", F.shiftright("_id", shifts[0]))
    groups = grouped.groupBy("_group").agg(F.max("_id").alias("_top"))
    order = following(groups.select(F.col("_group").alias("_id")), shifts[1:])
    tops = order.join(
        groups.select(F.col("_group").alias("_next"), "_top"), "_next"
    ).select(F.col("_id").alias("_group"), "_top")
    inside = Window.partitionBy("_group").orderBy(down)
    return (
        grouped.withColumn("_next", F.lead("_id").over(inside))
        .join(tops, "_group")
        .select("_id", F.coalesce("_next", "_top").alias("_next"))
    )


def edit_trace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against an edited form of it and against the next document's text.

    The edit replaces the last third of the code points (rounded down) by as many from the
    start of the next document, or all it has; the next document is the one with the next
    lower id, after the lowest the highest.  Per row: id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``, ``edit_from`` and
    ``edit_to`` (the paragraphs, from 0, that the edit has touched; null for none).

    A null text is empty; rows without an id come last and share one place; of several rows
    with one id the one with the smallest fingerprint is the one that others look at.

    The text is exchanged once, by id, and used on both sides; what moves besides is the
    asked-for start of each next document and its leaves.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_id"),
        body(text_col).alias("_text"),
    )
    third = F.floor(F.length("_text") / 3).cast("int")
    ids = saved(rows.groupBy("_id").agg(F.max(third).alias("_third")), "merkle-ids")
    wanted = (
        following(ids.select("_id"))
        .join(ids, "_id")
        .select(F.col("_id").alias("_asker"), F.col("_next").alias("_id"), "_third")
    )
    offered = (
        with_tree(rows.join(wanted, "_id"), "_text", "_")
        .groupBy(F.col("_asker").alias("_id"))
        .agg(
            F.min(
                F.struct(
                    F.col("_root").alias("root"),
                    F.substring("_text", F.lit(1), F.col("_third")).alias("start"),
                    F.col("_leaves").alias("leaves"),
                )
            ).alias("_after")
        )
    )
    edited = F.concat(
        F.substring("_text", F.lit(1), F.length("_text") - third),
        F.substring(F.col("_after.start"), F.lit(1), third),
    )
    both = rows.join(offered, "_id").withColumn("_edit", edited)
    both = with_tree(with_tree(both, "_text", "_"), "_edit", "_e_")
    return both.select(
        F.nullif("_id", F.lit(LOWEST)).alias(id_col),
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2("_edit", 256).alias("edited_sha256"),
        F.col("_root").alias("fingerprint"),
        F.col("_e_root").alias("edited_fingerprint"),
        likeness(F.col("_leaves"), F.col("_e_leaves")).alias("near_edited"),
        likeness(F.col("_leaves"), F.col("_after.leaves")).alias("near_next"),
        edit_span("_", "_e_").alias("_span"),
    ).select("*", F.col("_span.from").alias("edit_from"), F.col("_span.to").alias("edit_to")).drop(
        "_span"
    )
