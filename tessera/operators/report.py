"""Roll-ups for reports: scopes, per-class summaries, grouped lists, text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def scopes(nodes: DataFrame, encounters: list[str], shared: str) -> DataFrame:
    """Every class and own tab with every stated encounter."""
    tabs = nodes.filter(F.col("tab") != F.lit(shared)).select("cls", "tab").distinct()
    return tabs.withColumn("encounter", F.explode(F.array(*[F.lit(e) for e in encounters])))


def class_summary(results: DataFrame) -> DataFrame:
    """Per class the number of tabs and the best one by index, ties to the first name."""
    best = F.min_by(F.struct("tab", "index"), F.struct((-F.col("index")).alias("i"), "tab"))
    return results.groupBy("cls").agg(F.count_distinct("tab").alias("tabs"), best.alias("_b")).select("cls", "tabs", F.col("_b.tab").alias("best_tab"), F.col("_b.index").alias("best_index"))


def warnings(nodes: DataFrame, metadata: DataFrame, scopes: DataFrame, shared: tuple[str, ...], pool: str = "Class", full_level: int = 60) -> DataFrame:
    """(cls, warning, detail): stated tabs that have no nodes, and classes whose pool says nothing of levels below the full one.

    nodes: cls, tab_id, tab, availability; metadata: cls, tab_id, tab; scopes:
    cls, level. A tab is one of its class, id and name; ``shared`` tabs are not
    asked for. The pool's warning goes by two names.
    """
    key = ["cls", "tab_id", "tab"]
    empty = metadata.filter(~F.col("tab").isin(*shared)).select(*key).distinct().join(nodes.select(*key).distinct(), key, "left_anti")
    unknown = nodes.filter((F.col("tab") == F.lit(pool)) & F.col("availability").isNull()).select("cls").distinct()
    early = scopes.filter(F.col("level") < full_level).select("cls").distinct().join(unknown, "cls", "left_semi")
    both = F.explode(F.array(F.lit("class_pool_level_gating_incomplete"), F.lit("shared_class_level_gating_incomplete")))
    out = empty.select("cls", F.lit("metadata_tab_has_no_nodes").alias("warning"), F.col("tab").alias("detail"))
    return out.unionByName(early.select("cls", both.alias("warning"), F.lit(None).cast("string").alias("detail")))


def ordered_distinct(*lists: Column) -> Column:
    """All entries of the lists, each once, where it first stands; a null list is empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def nested(rows: DataFrame, outer: list[str], inner: list[str], name: str) -> DataFrame:
    """Groups with their rows as a sorted array of structs, for a nested sink."""
    return rows.groupBy(*outer).agg(F.sort_array(F.collect_list(F.struct(*inner))).alias(name))


def explain(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Per build and tab the selected nodes with scores as text, best first."""
    joined = members.join(scores, "node", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node"))), lambda x: F.concat_ws(":", x["node"].cast("string"), F.format_string("%.2f", -x["s"])))
    return joined.groupBy("build", "tab").agg(F.array_join(lines, ",").alias("nodes"))


def spoken_list(items: Column) -> Column:
    """"A", "A and B", "A, B, and C"."""
    n = F.size(items)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, 0))
        .when(n == 2, F.concat(F.get(items, 0), F.lit(" and "), F.get(items, 1)))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(items, -1)))
    )


def priority_lines(actions: DataFrame) -> DataFrame:
    """``actions+=/key,if=condition  # note`` lines; the first of the notes, if there are any."""
    condition = F.when(F.coalesce("condition", F.lit("")) != "", F.concat(F.lit(",if="), "condition")).otherwise("")
    note = F.when(F.size("notes") > 0, F.concat(F.lit("  # "), F.get("notes", 0))).otherwise("") if "notes" in actions.columns else F.lit("")
    return actions.withColumn("line", F.concat(F.lit("actions+=/"), "key", condition, note))


# What a guide says of an ability in each section; of maintenance there is a second form.
SENTENCES = {
    "opener": "Open with {}.",
    "core_loop": "Use {} as part of the repeatable core loop.",
    "maintenance": "Maintain {}.",
    "cooldown": "Use {} during planned burst windows.",
    "defensive": "Use {} before heavy damage or dangerous pulls.",
    "healing": "Use {} when allies need recovery.",
    "support": "Keep {} aligned with group damage windows.",
    "aoe": "Use {} when fighting multiple targets.",
    "procs": "Use {} when its proc or status condition is active.",
}
KEEP_ACTIVE, ANY_SECTION = "Keep {} active.", "Use {} when it is available."


def rule_sentence(section: Column, ability: Column, condition: Column) -> Column:
    """The guide's sentence for an ability in a section."""
    said = lambda text: F.replace(F.lit(text), F.lit("{}"), ability)
    out = F.when((section == "maintenance") & (F.coalesce(condition, F.lit("")) != ""), said(KEEP_ACTIVE))
    for name, text in SENTENCES.items():
        out = out.when(section == name, said(text))
    return out.otherwise(said(ANY_SECTION))


# The sentences of the loop, each for the categories that it needs.
LOOP_SENTENCES = {
    "maintenance": "Keep {} active before moving into your damage loop.",
    "both": ("Build with {} until your spender window is ready.", "Spend with {} before you overcap or during burst windows."),
    "spender": "Use {} whenever the condition is met.",
    "builder": "Use {} as your repeatable builder or main filler.",
    "filler": "Fill empty globals with {}.",
}
OPENER_SENTENCE, COOLDOWN_SENTENCE = "Open with {} to set up the pull.", "Use {} during your main damage or recovery window."


def loop_sentences(actions: DataFrame) -> DataFrame:
    """(build, opener, core_loop, cooldowns): sentences of how a build is played, each a list.

    actions: build, category, name, priority, key. Names of a category stand in
    the order of the actions, each once, as a spoken list.
    """
    order = F.struct("priority", "key", "name")
    names = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, order))), lambda x: x["name"]))
    each = actions.groupBy("build").agg(*[names(c).alias(f"_{c}") for c in ("maintenance", "cooldown", "builder", "spender", "filler")])
    has = lambda c: F.size(f"_{c}") > 0
    said = lambda text, c: F.replace(F.lit(text), F.lit("{}"), spoken_list(F.col(f"_{c}")))
    both = has("builder") & has("spender")
    lines = [
        F.when(has("maintenance"), said(LOOP_SENTENCES["maintenance"], "maintenance")),
        F.when(both, said(LOOP_SENTENCES["both"][0], "builder")),
        F.when(both, said(LOOP_SENTENCES["both"][1], "spender")).when(has("spender"), said(LOOP_SENTENCES["spender"], "spender")).when(has("builder"), said(LOOP_SENTENCES["builder"], "builder")),
        F.when(has("filler"), said(LOOP_SENTENCES["filler"], "filler")),
    ]
    one_each = lambda text: lambda name: F.replace(F.lit(text), F.lit("{}"), name)
    return each.select("build", F.transform(F.slice("_cooldown", 1, 2), one_each(OPENER_SENTENCE)).alias("opener"), F.array_compact(F.array(*lines)).alias("core_loop"), F.transform("_cooldown", one_each(COOLDOWN_SENTENCE)).alias("cooldowns"))


# The sections of a rotation in their order, the categories of the loop, and the roles whose other actions are of the defence.
SECTIONS = ("opener", "maintenance", "cooldowns", "builder_spender", "defensive_support")
LOOP = ("builder", "spender", "filler", "execute", "aoe")
DEFENSIVE_ROLES = ("tank", "healer", "support")


def rotation_sections(actions: DataFrame) -> DataFrame:
    """(build, at, section, actions): the actions of each section in their order, sections without any left out.

    actions: build, role, category, name, condition, confidence, priority, order, key.
    """
    category, role = F.col("category"), F.col("role")
    section = (
        F.when(category == "maintenance", "maintenance")
        .when(category == "cooldown", "cooldowns")
        .when(category.isin(*LOOP), "builder_spender")
        .when((category == "utility") | role.isin(*DEFENSIVE_ROLES), "defensive_support")
        .otherwise("opener")
    )
    item = F.struct("priority", "order", "name", "key", F.coalesce("condition", F.lit("")).alias("condition"), F.coalesce("confidence", F.lit("low")).alias("confidence"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["name"].alias("name"), x["condition"].alias("condition"), x["confidence"].alias("confidence")))
    out = actions.withColumn("section", section).groupBy("build", "section").agg(listed.alias("actions"))
    return out.select("build", F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int").alias("at"), "section", "actions")


def share_of_best(rows: DataFrame, scope: str) -> DataFrame:
    return rows.withColumn("share_of_best", F.round(F.try_divide(F.col("score"), F.max("score").over(Window.partitionBy(scope))), 6))
