"""The report of all scopes as one plan: search, index, actions, diverse choice, roles, trust, gear and warnings.

A scope is a class and tab with an encounter, a level and budgets. All scopes go
through every step together; what several steps need (the nodes of the builds
found, their matched rules, their actions) is written once and shared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import engine_role
from tessera.operators import builds as bd
from tessera.operators import report, rules, score, similarity
from tessera.session import materialize


@dataclass(frozen=True)
class Catalogue:
    """What reports are made of.

    nodes: node, cls, tab, name, text, tags, schools, resources, type, kind,
    passive, rank, level, ae, te, availability (null where it is not known);
    needs: node, required; weights: kind, key, weight; sets: names, weight;
    rules: as in ``rules.matches``, with confidence, template and place (their
    order); items: item, weapon_type, armor_type, confidence, stats; stats:
    role, stat, weight; watch: severity, cls_pattern, tab_pattern, role_pattern.
    """

    nodes: DataFrame
    needs: DataFrame
    weights: DataFrame
    sets: DataFrame
    rules: DataFrame
    items: DataFrame
    stats: DataFrame
    watch: DataFrame


@dataclass(frozen=True)
class Effort:
    """How many builds a scope gets, how widely they are searched, and the share of the budget they have to spend."""

    top: int = 3
    beam: int = 5
    branch: int = 10
    rounds: int = 12
    least_fraction: float = 0.7

    @property
    def candidates(self) -> int:
        return max(self.top * 5, 12)


def found_builds(catalogue: Catalogue, scopes: DataFrame, shared: str, effort: Effort) -> DataFrame:
    """(scope, build, nodes, spend, warning): the best states of a search in each scope."""
    eligible = rules.in_scope(catalogue.nodes, scopes, shared).join(catalogue.nodes, "node")
    paid = eligible.filter("ae + te > 0").select("scope", "node", "ae", "te", "level", (F.col("ae") + F.col("te")).cast("double").alias("score"))
    none = F.array().cast(f"array<{catalogue.nodes.schema['node'].dataType.simpleString()}>")
    start = scopes.select(F.lit("").alias("state"), "scope", "level", F.col("max_ae").alias("ae_left"), F.col("max_te").alias("te_left"), none.alias("nodes"), F.lit(0).alias("spend"))
    best = bd.best_states(start, materialize(paid, "eligible"), catalogue.needs, effort.rounds, effort.branch, effort.beam, effort.least_fraction, effort.candidates)
    return best.select("scope", F.concat_ws("/", "scope", "state").alias("build"), "nodes", "spend", F.when(F.col("warning").isNotNull(), "budget_floor_unreachable_with_current_gates").alias("warning"))


def scope_roles(catalogue: Catalogue, scopes: DataFrame) -> DataFrame:
    """(scope, role, role_source, role_confidence, evidence) from the nodes of the scope's own tab and what is configured."""
    own = catalogue.nodes.join(scopes.select("scope", "cls", "tab"), ["cls", "tab"])
    seen = score.infer_role(score.role_scores(own, "scope", "text", "tags", "name"), "scope").withColumnsRenamed({"role": "inferred_role", "confidence": "inferred_confidence"})
    return score.configured_role(scopes.select("scope", "configured").join(seen, "scope", "left")).select("scope", "role", "role_source", "role_confidence", "evidence")


def build_actions(members: DataFrame, catalogue: Catalogue, builds: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Actions of each build from the rules its nodes match, and (build, action_warnings).

    A rule is matched with a node once, however many builds have the node.
    """
    used = catalogue.nodes.join(members.select("node").distinct(), "node", "left_semi")
    allowed = catalogue.rules.filter(F.col("category").isin(*categories))
    found = rules.rule_actions(rules.matches(used, allowed))
    condition = rules.fill_template(F.coalesce("template", F.lit("")), {"action_key": F.col("key")})
    each = found.select("node", "name", "key", "rule", "category", "priority", "confidence", condition.alias("condition"), "evidence", "inferred", rules.category_place(F.col("category")).alias("order"), F.col("place").alias("rule_place"))
    matched = materialize(members.select(F.col("build").alias("scope"), "node").join(each, "node"), "matched-rules")
    kept = materialize(rules.dedupe_actions(matched, ("priority", "order", "name", "rule_place", "node")), "actions")
    counted = builds.select(F.col("build").alias("scope"), F.size("nodes").alias("nodes"))
    told = rules.action_warnings(counted, matched, kept, categories)
    return kept.withColumnRenamed("scope", "build"), told.withColumnRenamed("scope", "build")


def build_scores(members: DataFrame, catalogue: Catalogue, builds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexes of the builds with their bands, and the breakdown of each; a node is scored once, whatever builds have it."""
    used = catalogue.nodes.join(members.select("node").distinct(), "node", "left_semi")
    parts = members.select("build", "node").join(score.node_components(used, catalogue.weights), "node").drop("node")
    parts = materialize(parts.unionByName(score.synergy_components(members, catalogue.sets)), "components")
    bare = F.count_if((F.size("tags") == 0) & (F.size("schools") == 0) & (F.size("resources") == 0))
    counted = builds.select("build").join(members.groupBy("build").agg(F.count("*").alias("nodes"), bare.alias("bare")), "build", "left").fillna(0)
    return score.build_index(parts, counted), score.breakdown(parts)


def spec_builds(catalogue: Catalogue, scopes: DataFrame, shared: str, categories: list[str], effort: Effort = Effort()) -> tuple[DataFrame, DataFrame]:
    """(builds of the report, all builds found): the first has one row per scope and place with all that is said of the build.

    scopes: scope, cls, tab, encounter, level, max_ae, max_te, configured.
    Places are those of ``similarity.select_diverse``: the best reliable build
    within the scope's band, then those that differ enough from it.
    """
    found = materialize(found_builds(catalogue, scopes, shared, effort), "builds")
    members = materialize(found.select("scope", "build", F.explode("nodes").alias("node")).join(catalogue.nodes.drop("cls"), "node"), "build-nodes")
    roles = materialize(scope_roles(catalogue, scopes), "scope-roles")
    index, broken = build_scores(members, catalogue, found)
    actions, told = build_actions(members, catalogue, found, categories)
    builds = found.select("scope", "build").join(roles, "scope").join(index.withColumnsRenamed({"index": "score"}), "build").join(told, "build")
    builds = materialize(builds.withColumnRenamed("action_warnings", "warnings"), "scored-builds")
    sure = score.build_reliability(builds.select("build", "role", "warnings"), members, actions).withColumnsRenamed({"score": "reliability", "label": "reliability_label"})
    prints = similarity.fingerprints(builds.select("scope", "build", "role", "score"), members, actions)
    played = similarity.signatures(builds.select("build", "role"), actions).drop("role").join(actions.select("build").distinct().withColumn("played", F.lit(True)), "build", "left").fillna(False, ["played"])
    prints = prints.join(played, "build").join(sure, "build")
    eligible = similarity.in_band(prints.select("scope", "build", "score", "reliability"), "scope")
    chosen = similarity.select_diverse(eligible, lambda some: prints.join(some.select("build"), "build", "left_semi"), "scope", "build", effort.top, measure=similarity.blended_distance)
    chosen = materialize(chosen, "chosen-builds")

    few = chosen.join(builds.drop("scope"), "build").join(sure, "build").join(scopes.select("scope", "cls", "tab", "encounter"), "scope")
    few = few.withColumn("engine_role", engine_role(F.col("role")))
    hits = rules.watchlist(few, catalogue.watch, {"role": "role_pattern", "cls": "cls_pattern", "tab": "tab_pattern"}).select("build", "severity")
    trusted = score.trust(few.select("build", "role_source", "role_confidence", "warnings", F.col("reliability_label").alias("reliability"), F.lit(0).alias("unsupported_conditions"), F.lit(0).alias("unsupported_effects")), hits)
    gear = score.gear_report(catalogue.items, catalogue.stats, few.select("role", "engine_role").distinct())
    selected = members.join(chosen.select("build"), "build", "left_semi").groupBy("build").agg(F.array_sort(F.collect_list(F.struct("node", "name"))).alias("selected_nodes"))
    summary = report.rotation_sections(actions.join(chosen.select("build"), "build", "left_semi").join(builds.select("build", "role"), "build")).groupBy("build").agg(F.sort_array(F.collect_list(F.struct("at", "section", "actions"))).alias("sections"))
    labels = prints.join(chosen.select("build"), "build", "left_semi").select("build", F.col("label").alias("playstyle"), "resource_loop", "burst")
    what = score.objective(F.col("role"))
    out = few.join(trusted.select("build", F.col("score").alias("trust_score"), F.col("label").alias("trust")), "build").join(gear, ["role", "engine_role"], "left").join(selected, "build", "left").join(summary, "build", "left").join(labels, "build").join(broken, "build", "left")
    out = out.withColumns({"objective": what["id"], "objective_label": what["label"], "index": F.col("score"), "warnings": report.ordered_distinct(F.col("warnings"), F.col("gear_warnings"))})
    return out.drop("score", "gear_warnings"), found


def scope_results(built: DataFrame, found: DataFrame, scopes: DataFrame, nodes: DataFrame, shared: str, full_level: int = 60) -> DataFrame:
    """(scope, builds, best_index, warnings): every scope, with its builds counted and what is to be said of it.

    First that levels below the full one are not known in the class's shared
    pool (both names of that warning), then that the budget could not be spent,
    then that no valid build was found.
    """
    pool = nodes.filter((F.col("tab") == F.lit(shared)) & F.col("availability").isNull()).select("cls").distinct().withColumn("_open", F.lit(True))
    floor = found.groupBy("scope").agg(F.first("warning", ignorenulls=True).alias("_floor"))
    best = built.groupBy("scope").agg(F.count("*").alias("builds"), F.max("index").alias("best_index"))
    out = scopes.join(pool, "cls", "left").join(floor, "scope", "left").join(best, "scope", "left")
    early = F.coalesce(F.col("_open"), F.lit(False)) & (F.col("level") < full_level)
    lines = [F.when(early, "class_pool_level_gating_incomplete"), F.when(early, "shared_class_level_gating_incomplete"), F.col("_floor"), F.when(F.col("builds").isNull(), "no_valid_builds_found")]
    return out.select("scope", F.coalesce("builds", F.lit(0)).alias("builds"), "best_index", F.array_compact(F.array(*lines)).alias("warnings"))


def flat_lines(built: DataFrame) -> DataFrame:
    """The builds as one line each, for a flat sink."""
    names = F.coalesce(F.transform("selected_nodes", lambda n: n["node"].cast("string")), F.array().cast("array<string>"))
    sections = F.transform("sections", lambda s: F.concat(s["section"], F.lit("="), F.array_join(F.transform(s["actions"], lambda a: a["name"]), "+")))
    line = F.format_string(
        "#%d %s %s %.2f (%s) %s %s trust %s gear %s/%s [%s] nodes %s; %s", "place", "role", "objective_label", "index", "confidence", "playstyle", "reliability_label", "trust",
        F.array_join("best_weapon_types", "+"), F.array_join("best_armor_types", "+"), F.array_join("warnings", ","), F.array_join(names, "+"), F.coalesce(F.array_join(sections, ";"), F.lit("")),
    )
    return built.select("scope", "place", "build", line.alias("line"))


def nested(built: DataFrame, results: DataFrame, scopes: DataFrame) -> DataFrame:
    """Classes with their scopes, each with its warnings and its builds in order, for a nested sink."""
    inner = [c for c in built.columns if c not in ("scope", "place", "cls", "tab", "encounter", "sections", "selected_nodes")]
    listed = built.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("place", *inner))).alias("top_builds"))
    each = results.join(scopes.select("scope", "cls", "tab", "encounter", "level"), "scope").join(listed, "scope", "left")
    spec = F.struct("tab", "encounter", "level", "scope", F.col("builds").alias("n_builds"), "warnings", "top_builds")
    return each.groupBy("cls").agg(F.sort_array(F.collect_list(spec)).alias("specs"))
