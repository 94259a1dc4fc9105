"""Rule tables: record checks, match predicates, conditions over state snapshots, actions from matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import stated, stated_rows
from tessera.session import materialize


def violations(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, code) for every rule (SQL that is true where a row is bad) that a row breaks; one scan for all rules."""
    codes = F.array_compact(F.array(*[F.when(F.expr(bad), F.lit(code)) for code, bad in rules.items()]))
    return rows.select(key, F.explode(codes).alias("code"))


def validation_summary(rows: DataFrame, rules: dict[str, str], warnings: tuple[str, ...] = ()) -> DataFrame:
    """Counts per rule, and whether it is a failure or a warning."""
    aggs = [F.count_if(F.expr(bad)).alias(code) for code, bad in rules.items()]
    one = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n"), F.lit("warning" if code in warnings else "failure").alias("level")) for code in rules])
    return one.select(F.inline(each)).filter("n > 0")


def in_scope(nodes: DataFrame, scopes: DataFrame, shared: str) -> DataFrame:
    """(scope, node) for nodes of the scope's class and tab, or of the shared tab, up to its level."""
    s = scopes.withColumnsRenamed({"tab": "scope_tab", "level": "scope_level"})
    return nodes.join(s, "cls").filter(F.expr("level <= scope_level") & ((F.col("tab") == F.col("scope_tab")) | (F.col("tab") == F.lit(shared)))).select("scope", "node")


#: Lists of a rule of which a node has to have one, and the node's column.
ANY_OF = {"tags_any": "tags", "schools_any": "schools", "resources_any": "resources", "types_in": "type", "kinds_in": "kind"}
NO_TOKEN = "*"


def rule_index(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule, need) and the postings (column, token, rule, part) of stated rules.

    A rule's parts are its lists of which a node needs one (one part each, with
    a posting per token) and each of its ``tags_all`` (a part of its own); it
    asks for ``need`` parts. A rule without any has the token that every node has.
    """
    have = [c for c in ANY_OF if c in rules.columns]
    entry = lambda column, token, part: F.struct(F.lit(column).alias("column"), token.alias("token"), part.alias("part"))
    none = F.array().cast("array<struct<column: string, token: string, part: string>>")
    postings = lambda c: F.transform(F.array_distinct(c), lambda t: entry(ANY_OF[c], t, F.lit(c)))
    lists = [F.coalesce(postings(c), none) for c in have]
    every = F.coalesce(F.transform(F.array_distinct("tags_all"), lambda t: entry("tags", t, F.concat(F.lit("tags_all:"), t))), none)
    need = sum((F.col(c).isNotNull().cast("int") for c in have), F.coalesce(F.size(F.array_distinct("tags_all")), F.lit(0)))
    r = stated(rules).withColumn("need", need)
    free = F.array(entry(NO_TOKEN, F.lit(NO_TOKEN), F.lit(NO_TOKEN)))
    postings = r.select("rule", F.explode(F.when(F.col("need") == 0, free).otherwise(F.concat(*lists, every))).alias("p")).select("rule", "p.*")
    return r.withColumn("need", F.greatest("need", F.lit(1))), postings


def matches(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes with the rules of which every stated operator is met; a null operator is met, an empty list never.

    nodes: node, name, text, tags, schools, resources, type, kind, passive,
    rank. rules: rule, category, priority and the nullable arrays tags_any,
    tags_all, schools_any, resources_any, types_in, kinds_in, name_any (parts
    of names in any case), text_any (patterns in any case), and the nullable
    active_only, passive_only, rank_least.

    The rules are an inverted index: a node's tokens are joined with it, the
    parts met are counted against those asked for, and only rules that pass
    are tested by flags, names and, last, patterns. The index is of a stated
    set and is broadcast; there is no nested loop.
    """
    asked, postings = rule_index(rules)
    token = lambda column, value: F.struct(F.lit(column).alias("column"), value.alias("token"))
    several = lambda c: F.transform(F.coalesce(F.array_distinct(c), F.array().cast("array<string>")), lambda t: token(c, t))
    held = [several(c) for c in ("tags", "schools", "resources")]
    held += [F.array(token(c, F.col(c))) for c in ("type", "kind") if c in nodes.columns]
    tokens = nodes.select("node", F.explode(F.concat(*held, F.array(token(NO_TOKEN, F.lit(NO_TOKEN))))).alias("t")).select("node", "t.*")
    met = tokens.join(F.broadcast(postings), ["column", "token"]).groupBy("node", "rule").agg(F.count_distinct("part").alias("met"))
    found = met.join(F.broadcast(asked), "rule").filter("met = need").drop("met", "need").join(nodes, "node")
    test = "(active_only IS NULL OR NOT active_only OR NOT passive) AND (passive_only IS NULL OR NOT passive_only OR passive) AND (rank_least IS NULL OR rank >= rank_least)"
    test += " AND (name_any IS NULL OR exists(name_any, p -> contains(lower(name), lower(p))))"
    test += " AND (text_any IS NULL OR exists(text_any, p -> coalesce(text, '') RLIKE concat('(?i)', p)))"
    return found.filter(test)


# The order of categories among actions of equal priority.
CATEGORY_ORDER = ("precombat", "maintenance", "cooldown", "execute", "aoe", "spender", "builder", "filler", "utility")


def category_place(category: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), category)
    return F.when(place > 0, place).otherwise(999)


def action_key(name: Column) -> Column:
    """The name as a key: lower case, apostrophes gone, anything else but letters, digits and underscores one underscore."""
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("'"), F.lit("")), r"[^a-z0-9_]+", "_"), F.lit("_"))


def rule_actions(matched: DataFrame) -> DataFrame:
    """Matched (node, rule) rows with ``key``, ``evidence`` and whether the condition is ``inferred``.

    The evidence is the node's tags that the rule names, last first, then the
    rule itself; a condition is inferred where the node has tags or the rule
    has patterns.
    """
    named = F.concat(F.coalesce("tags_any", F.array().cast("array<string>")), F.coalesce("tags_all", F.array().cast("array<string>")))
    tags = F.transform(F.reverse(F.filter("tags", lambda t: F.array_contains(named, t))), lambda t: F.concat(F.lit("tag:"), t))
    inferred = (F.size("tags") > 0) | F.coalesce(F.size("text_any") > 0, F.lit(False))
    return matched.withColumns({"key": action_key(F.col("name")), "evidence": F.concat(tags, F.array(F.concat(F.lit("profile_rule:"), "rule"))), "inferred": inferred})


def action_warnings(builds: DataFrame, matched: DataFrame, kept: DataFrame, categories: list[str]) -> DataFrame:
    """(scope, action_warnings): whether conditions were inferred, then the stated categories without an action, then the lack of a filler.

    builds: scope, nodes (how many are selected); matched and kept: scope and
    the actions before and after ``dedupe_actions``.
    """
    told = matched.groupBy("scope").agg(F.bool_or("inferred").alias("_inferred"))
    have = kept.groupBy("scope").agg(F.collect_set("category").alias("_have"))
    out = builds.join(told, "scope", "left").join(have, "scope", "left")
    some = F.coalesce("_have", F.array().cast("array<string>"))
    lines = [F.when(F.col("_inferred"), F.lit("condition inferred from normalized tooltip tags"))]
    lines += [F.when(~F.array_contains(some, c), F.lit(f"no action matched category:{c}")) for c in categories]
    lines += [F.when((F.col("nodes") > 0) & ~F.array_contains(some, "filler"), F.lit("selected build has active nodes but no filler action"))]
    return out.select("scope", F.array_compact(F.array(*lines)).alias("action_warnings"))


def dedupe_actions(actions: DataFrame, order: tuple[str, ...] = ("priority", "rule")) -> DataFrame:
    """One action per (scope, key, condition, category), the first by ``order``; filler goes where a specific action has the same key."""
    specific = F.max((F.col("category") != "filler").cast("int")).over(Window.partitionBy("scope", "key"))
    kept = actions.withColumn("_s", specific).filter("NOT (category = 'filler' AND _s = 1)").drop("_s")
    w = Window.partitionBy("scope", "key", "condition", "category").orderBy(*order)
    return kept.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def wildcard_match(pattern: Column, value: Column) -> Column:
    """``*``, ``*_dps`` or equality in any case."""
    return (pattern == "*") | ((pattern == "*_dps") & F.endswith(value, F.lit("_dps"))) | (F.lower(pattern) == F.lower(value))


def watchlist(rows: DataFrame, entries: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with the stated watch-list entries that match in every column.

    In the first column a row looks up the three patterns that can match its
    value, so entries are joined by equality; the others are tested on what is found.
    """
    (first, pattern), *rest = columns.items()
    value = F.lower(F.col(first))
    asked = F.array_distinct(F.array_compact(F.array(value, F.lit("*"), F.when(F.endswith(F.col(first), F.lit("_dps")), "*_dps"))))
    keyed = stated(entries).withColumn("_key", F.lower(F.col(pattern)))
    test = F.lit(True)
    for column, other in rest:
        test = test & wildcard_match(F.col(other), F.col(column))
    return rows.withColumn("_key", F.explode(asked)).join(F.broadcast(keyed), "_key").filter(test).drop("_key")


# The forms of conditions.
CONDITIONS = {
    "dot": r"^dot\.([a-z0-9_]+)\.remains<gcd$",
    "buff": r"^buff\.([a-z0-9_]+)\.down$",
    "cooldown": r"^cooldown\.([a-z0-9_]+)\.ready$",
    "enemies": r"^active_enemies>=(\d+)$",
    "health": r"^target\.health\.pct<(\d+(?:\.\d+)?)$",
    "resource": r"^([a-z0-9_]+)>=(\d+(?:\.\d+)?)$",
    "deficit": r"^([a-z0-9_]+)\.deficit>0$",
}


def condition_holds(condition: Column) -> Column:
    """Seven forms of condition over a snapshot row (maps debuffs, buffs, cooldowns, resources, max_resources; time_ms, gcd_ms, health_pct, enemies); null where the form is unknown."""
    c = F.trim(condition)
    part = {name: F.regexp_extract(c, p, 1) for name, p in CONDITIONS.items()}
    entry = lambda column, key: F.coalesce(F.try_element_at(column, key), F.lit(0.0))
    is_form = {name: F.regexp_like(c, F.lit(p)) for name, p in CONDITIONS.items()}
    return (
        F.when(F.coalesce(c, F.lit("")) == "", True)
        .when(is_form["dot"], entry(F.col("debuffs"), part["dot"]) < F.col("gcd_ms"))
        .when(is_form["buff"], entry(F.col("buffs"), part["buff"]) <= 0)
        .when(is_form["cooldown"], entry(F.col("cooldowns"), part["cooldown"]) <= F.col("time_ms"))
        .when(is_form["enemies"], F.col("enemies") >= part["enemies"].cast("double"))
        .when(is_form["health"], F.col("health_pct") < part["health"].cast("double"))
        .when(is_form["resource"], entry(F.col("resources"), part["resource"]) >= F.regexp_extract(c, CONDITIONS["resource"], 2).cast("double"))
        .when(is_form["deficit"], entry(F.col("max_resources"), part["deficit"]) - entry(F.col("resources"), part["deficit"]) > 0)
    )


def first_usable(snapshots: DataFrame, actions: DataFrame) -> DataFrame:
    """Per snapshot the first usable action, by priority and key; (snapshot, action, unsupported).

    Usable: its condition holds, and, where ``actions`` has these columns, it is
    off cooldown (``cooldowns`` of the snapshot under its key), it can be paid
    (``costs``: resource to amount), and it is known (``known``). ``unsupported``
    counts the actions whose condition has a form that is not known. The actions
    are a stated set of tens, written into one expression on the row: nothing
    is joined or shuffled.
    """
    first, odd = [], F.lit(0)
    for a in sorted(stated_rows(actions), key=lambda a: (a["priority"], a["key"])):
        holds = condition_holds(F.lit(a["condition"]).cast("string"))
        ok = F.coalesce(holds, F.lit(False))
        if "known" in actions.columns:
            ok = ok & F.lit(bool(a["known"]))
        if "costs" in actions.columns:
            ok = ok & (F.coalesce(F.try_element_at("cooldowns", F.lit(a["key"])), F.lit(0.0)) <= F.col("time_ms"))
            for resource, amount in (a["costs"] or {}).items():
                ok = ok & (F.coalesce(F.try_element_at("resources", F.lit(resource)), F.lit(0.0)) >= F.lit(amount))
        first.append(F.when(ok, F.lit(a["key"])))
        odd = odd + holds.isNull().cast("int")
    out = snapshots.select("snapshot", F.coalesce(*first, F.lit(None).cast("string")).alias("action"), odd.cast("long").alias("unsupported"))
    return out.filter("action IS NOT NULL")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


# A threshold in a condition, the categories whose actions may change places, and the factors.
THRESHOLD = r"\b([a-z0-9_]+)>=(\d+(?:\.\d+)?)\b"
REORDERABLE = ("builder", "spender", "filler", "maintenance", "execute", "aoe", "cooldown", "utility")
FACTORS = (0.75, 1.0, 1.25)


def plain_number(value: Column) -> Column:
    """Two decimals at most, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", F.bround(value, 2)), r"\.?0+$", "")


def threshold_changes(actions: DataFrame, factors=FACTORS, low: float = 0.0, high: float = 1000.0) -> DataFrame:
    """Ledger of variants that change the first threshold of one action: scaled, clamped, unchanged ones left out.

    actions: candidate, pos, key, category, condition, priority; the ledger has
    the same columns for the changed place, and mutation, note and ``nth``, the
    order of the variants.
    """
    name, number = F.regexp_extract("condition", THRESHOLD, 1), F.regexp_extract("condition", THRESHOLD, 2).try_cast("double")
    rows = actions.withColumns({"_name": name, "_n": number}).filter("_n IS NOT NULL")
    rows = rows.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("by")) for i, f in enumerate(factors)])))
    rows = rows.withColumn("_new", plain_number(F.greatest(F.lit(low), F.least(F.lit(high), F.col("_n") * F.col("_f.by"))))).filter(F.col("_new") != plain_number(F.col("_n")))
    # Only the first threshold changes: what stands before it has none.
    before = F.expr(f"substring(condition, 1, locate(concat(_name, '>=', regexp_extract(condition, r'{THRESHOLD}', 2)), condition) - 1)")
    old = F.concat("_name", F.lit(">="), F.regexp_extract("condition", THRESHOLD, 2))
    after = F.expr("substring(condition, length(_before) + length(_old) + 1)")
    rows = rows.withColumns({"_before": before, "_old": old}).withColumn("condition", F.concat("_before", "_name", F.lit(">="), "_new", after))
    note = F.concat_ws(":", F.lit("threshold"), "key", "_name", "_new")
    return rows.select("candidate", "pos", "key", "category", "condition", "priority", note.alias("mutation"), F.lit("").alias("note"), F.struct(F.lit(1).alias("kind"), F.format_string("%08d", "pos").alias("at"), F.col("_f.i").alias("i")).alias("nth"))


def reorder_changes(actions: DataFrame, categories=REORDERABLE) -> DataFrame:
    """Ledger of variants in which the actions of one category change places: reversed, and, from three on, moved up by one.

    Priorities stay where they are. Only the places whose action changes are in the ledger.
    """
    w = Window.partitionBy("candidate", "category")
    group = actions.filter(F.col("category").isin(*categories)).withColumns({"_i": F.row_number().over(w.orderBy("pos")) - 1, "_m": F.count("*").over(w)}).filter("_m > 1")
    slots = group.select("candidate", "category", F.col("_i").alias("_to"), "pos", "priority", F.col("key").alias("_key"), F.col("condition").alias("_condition"))
    moves = [("Reverse", 0, F.col("_m") - 1 - F.col("_i")), ("Rotate", 1, F.when(F.col("_m") > 2, F.pmod(F.col("_i") - 1, F.col("_m"))))]
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(what).alias("what"), F.lit(i).alias("i"), to.cast("int").alias("to")) for what, i, to in moves]), lambda x: x["to"].isNotNull()))
    moved = group.drop("pos", "priority").withColumn("_v", each).withColumn("_to", F.col("_v.to")).join(slots, ["candidate", "category", "_to"])
    changed = moved.filter("NOT (key = _key AND condition = _condition)")
    note = F.concat(F.col("_v.what"), F.lit(" "), "category", F.lit(" priority order."))
    return changed.select("candidate", "pos", "key", "category", "condition", "priority", F.concat(F.lit("reorder_group:"), "category").alias("mutation"), note.alias("note"), F.struct(F.lit(2).alias("kind"), F.col("category").alias("at"), F.col("_v.i").alias("i")).alias("nth"))


def _mark() -> Column:
    """A number of what stands at a place; sums of them tell lists apart, whatever the order of summing."""
    return F.xxhash64("pos", "key", "category", "condition", "priority").cast("decimal(38,0)")


#: Bytes of texts that a task digests for one list before its variants are dealt to several.
DIGESTED = 4 << 30


def _entry() -> Column:
    """An action as it stands in the text of its list."""
    return F.to_json(F.struct(F.col("key").alias("action_key"), "category", "condition", "priority"))


def variants(actions: DataFrame, digested: int = DIGESTED) -> DataFrame:
    """(candidate, mutation, note, nth, fingerprint) of the base and all its single changes, equal lists once.

    actions: candidate, pos (the order of the list), key, category, condition,
    priority. Variants are kept as ledgers of changed places. The mark of a
    variant is the base's less what is replaced plus what replaces it, so equal
    ones are found before any list is made; the SHA-1 is made of what is left.
    A variant of one place is the base's text, cut at that place, as it is
    digested: lists times places are never rows. The text goes to each slice of
    a list's variants, so that no task digests much more than ``digested`` bytes
    of a list.
    """
    base = materialize(actions.select("candidate", "pos", "key", "category", "condition", F.col("priority").cast("double").alias("priority")), "variant-base")
    ledger = materialize(threshold_changes(base).unionByName(reorder_changes(base)), "variant-ledger")
    size = F.octet_length(_entry()).cast("long")
    slices = F.greatest(F.lit(1), F.ceil(F.count("*") * F.sum(size + 1) / digested)).cast("int")
    whole = base.groupBy("candidate").agg(F.sum(_mark()).alias("_whole"), slices.alias("_slices"))
    before = Window.partitionBy("candidate").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    old = base.select("candidate", "pos", _mark().alias("_old"), size.alias("_length")).withColumn("_at", (F.coalesce(F.sum(F.col("_length") + 1).over(before), F.lit(0)) + 1).cast("int"))
    change = F.struct("_at", F.col("_length").cast("int").alias("_length"), _entry().alias("_new"))
    marks = ledger.withColumn("_mark", _mark()).join(old, ["candidate", "pos"]).groupBy("candidate", "mutation", "note", "nth").agg(F.sum(F.col("_mark") - F.col("_old")).alias("_by"), F.count("*").alias("_places"), F.min(change).alias("_c"))
    marks = marks.join(whole, "candidate").withColumn("_mark", F.col("_whole") + F.col("_by"))
    first = F.struct(F.lit(0).alias("kind"), F.lit("").alias("at"), F.lit(0).alias("i"))
    bases = whole.select("candidate", F.lit("base").alias("mutation"), F.lit("Generated APL unchanged.").alias("note"), first.alias("nth"), F.lit(0).cast("long").alias("_places"), F.struct(F.lit(0).alias("_at"), F.lit(0).alias("_length"), F.lit("").alias("_new")).alias("_c"), "_slices", F.col("_whole").alias("_mark"))
    every = marks.select(*bases.columns).unionByName(bases)
    once = every.groupBy("candidate", "_mark").agg(F.min(F.struct("nth", "mutation", "note", "_places", "_c", "_slices")).alias("v")).select("candidate", "v.*")
    once = materialize(once.withColumn("_slice", F.pmod(F.xxhash64("nth"), F.col("_slices")).cast("int")), "variants")
    # One place at most: the text on both sides of it, and what replaces it, as bytes.
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _entry().alias("e")))), lambda x: x["e"]), ","), F.lit("]"))
    texts = base.groupBy("candidate").agg(text.cast("binary").alias("_text"), slices.alias("_slices")).select("candidate", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"), "_text")
    cut = F.concat(F.expr("substring(_text, 1, _c._at)"), F.col("_c._new").cast("binary"), F.expr("substring(_text, _c._at + _c._length + 1)"))
    named = ("candidate", "mutation", "note", "nth")
    single = once.filter("_places < 2").join(texts.hint("merge"), ["candidate", "_slice"]).select(*named, F.sha1(cut).alias("fingerprint"))
    # Several places: the rows of the list, at most two variants a category.
    rows = once.filter("_places > 1").select(*named).join(base, "candidate").join(ledger.select("candidate", "nth", "pos", F.struct("key", "category", "condition", "priority").alias("_c")), ["candidate", "nth", "pos"], "left")
    entry = F.struct(*[F.coalesce(F.col(f"_c.{c}"), F.col(c)).alias(n) for n, c in (("action_key", "key"), ("category", "category"), ("condition", "condition"), ("priority", "priority"))])
    listed = rows.groupBy(*named).agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("_l"))
    return single.unionByName(listed.select(*named, F.sha1(F.to_json(F.transform("_l", lambda x: x["e"]))).alias("fingerprint")))


#: Categories of actions, or classes of catalogue actions, one of which a role needs.
ROLE_NEEDS = {"healer": ("healing", "heal"), "tank": ("defensive", "mitigation"), "support": ("support", "support")}


def candidate_validity(candidates: DataFrame, actions: DataFrame, catalogue: DataFrame, most: int = 20) -> DataFrame:
    """``candidates`` (candidate, role) with ``valid``.

    At most ``most`` actions, at least one of them in the catalogue (key,
    classification); of those not only cooldowns; and, for healers, tanks and
    supports, one with the category or the classification of the role. actions:
    candidate, key, category.
    """
    known = actions.join(catalogue.select("key", "classification").withColumn("_known", F.lit(True)), "key", "left")
    run = F.coalesce("_known", F.lit(False))
    sums = known.groupBy("candidate").agg(
        F.count("*").alias("_n"), F.collect_set(F.when(run, F.col("category"))).alias("_categories"), F.collect_set(F.when(run, F.col("classification"))).alias("_classes"), F.count_if(run).alias("_run")
    )
    fits = F.lit(True)
    for role, (category, classification) in ROLE_NEEDS.items():
        fits = F.when(F.lower("role") == role, F.array_contains("_categories", category) | F.array_contains("_classes", classification)).otherwise(fits)
    valid = (F.col("_n") <= most) & (F.col("_run") > 0) & (F.size(F.array_remove("_categories", "cooldown")) > 0) & fits
    return candidates.join(sums, "candidate", "left").withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_n", "_categories", "_classes", "_run")


# The checks of a catalogue row, SQL that is true where it fails. Wrong types are read as null.
ENTRY_RULES = {
    "missing_schema_version": "schema_version IS DISTINCT FROM '{version}'",
    "missing_class": "coalesce(class_name, '') = ''",
    "missing_tab": "coalesce(tab_name, '') = ''",
    "invalid_essence_kind": "coalesce(essence_kind, '') NOT IN ('ability', 'talent', 'unknown')",
    "unknown_essence_kind": "essence_kind = 'unknown'",
    "missing_name": "coalesce(name, '') = ''",
    "class_id_not_numeric": "class_id IS NULL",
    "tab_id_not_numeric": "tab_id IS NULL",
    "ae_cost_not_numeric": "ae_cost IS NULL",
    "te_cost_not_numeric": "te_cost IS NULL",
    "required_tab_ae_not_numeric": "required_tab_ae IS NULL",
    "required_tab_te_not_numeric": "required_tab_te IS NULL",
    "required_ids_not_numbers": "required_ids IS NULL OR exists(required_ids, x -> x IS NULL)",
    "connected_ids_not_numbers": "connected_node_ids IS NULL OR exists(connected_node_ids, x -> x IS NULL)",
    "tags_not_array": "tags IS NULL",
    "schools_not_array": "damage_schools IS NULL",
    "resources_not_array": "resources IS NULL",
    "missing_field_sources": "field_sources IS NULL",
    "missing_inferred": "inferred IS NULL",
    "missing_raw": "raw IS NULL",
    "invalid_source_category": "source_category NOT IN ('spec_tree', 'class_pool', 'trainer', 'misc_system', 'metadata_only', 'unknown')",
    "level_not_numeric": "availability IS NOT NULL AND availability.effective_required_level IS NULL",
    "invalid_level_confidence": "availability IS NOT NULL AND coalesce(availability.level_confidence, '') NOT IN ('high', 'medium', 'low')",
}
CLASS_RULES = {"class_missing_schema_version": "schema_version IS DISTINCT FROM '{version}'", "class_missing_name": "coalesce(class_name, '') = ''", "class_id_not_numeric": "class_id IS NULL", "class_tabs_not_array": "tabs IS NULL"}


def catalogue_faults(entries: DataFrame, classes: DataFrame, version: str, allow_unknown_kind: bool = False) -> DataFrame:
    """(code, n) of all that is wrong with a catalogue: its rows, its classes, and the two together; none if it may be published.

    Every row has to be of exactly the stated ``version``.
    """
    stamped = lambda rules: {k: v.replace("{version}", version.replace("'", "\\'")) for k, v in rules.items()}
    rules = {k: v for k, v in stamped(ENTRY_RULES).items() if not (allow_unknown_kind and k == "unknown_essence_kind")}
    rows = validation_summary(entries, rules).select("code", "n").unionByName(validation_summary(classes, stamped(CLASS_RULES)).select("code", "n"))
    have = entries.filter("coalesce(class_name, '') <> ''").select("class_name").distinct()
    empty = classes.filter("coalesce(class_name, '') <> ''").join(have, "class_name", "left_anti").agg(F.count("*").alias("n")).select(F.lit("class_without_entries").alias("code"), "n")
    none = lambda df, code: df.agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit(code).alias("code"), "n")
    return rows.unionByName(empty).unionByName(none(entries, "no_entries")).unionByName(none(classes, "no_classes")).filter("n > 0")


def catalogue_verdict(faults: DataFrame) -> DataFrame:
    """One row: pass or fail, the number of kinds of fault and of faults, and the kinds by name."""
    found = faults.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("faults"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return found.select(F.when(F.col("kinds") == 0, "pass").otherwise("fail").alias("verdict"), "kinds", "faults", "codes")


# What a rule table may hold.
RULE_CATEGORIES = ("precombat", "maintenance", "cooldown", "builder", "spender", "execute", "aoe", "filler", "utility")
RULE_CONFIDENCE = ("high", "medium", "low")
MATCH_OPERATORS = (
    "tags_any", "tags_all", "schools_any", "resources_any", "name_contains_any", "description_matches_any",
    "entry_type_in", "essence_kind_in", "active_only", "passive_only", "selected_rank_at_least",
)


# The fields that a rule table has to have, and the inputs that may not be asked for yet.
PROFILE_FIELDS = (
    "schema_version", "profile_id", "class_name", "spec_key", "role", "supported_encounters", "resources", "thresholds", "condition_templates", "rules", "branches", "assumptions",
)
FUTURE_INPUTS = ("combat_log_metrics", "saved_variables_snapshot", "sim_state")


def profile_faults(profiles: DataFrame, version: str) -> DataFrame:
    """(profile, id, code) of whole rule tables: fields that are missing, a version other than the stated one, and inputs of the future.

    profiles: profile, fields (names that are there), schema_version,
    required_inputs. ``id`` is the field or the input.
    """
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    entry = lambda code: lambda x: F.struct(x.alias("id"), F.lit(code).alias("code"))
    missing = F.transform(F.array_sort(F.array_except(listed(PROFILE_FIELDS), F.coalesce("fields", F.array().cast("array<string>")))), entry("missing_field"))
    future = F.transform(F.array_sort(F.array_intersect(F.coalesce("required_inputs", F.array().cast("array<string>")), listed(FUTURE_INPUTS))), entry("future_input_required"))
    wrong = F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), F.array(F.struct(F.lit("schema_version").alias("id"), F.lit("invalid_schema_version").alias("code")))).otherwise(F.array().cast("array<struct<id:string,code:string>>"))
    return profiles.select("profile", F.explode(F.concat(missing, wrong, future)).alias("f")).select("profile", "f.*")


# The largest plausible values of a node's fields, and the levels there are.
FIELD_BOUNDS = {"ae_cost": 500, "te_cost": 500, "required_tab_ae": 500, "required_tab_te": 500, "max_rank": 20, "row": 200, "col": 200}
MOST_LEVEL = 60


def bound_faults(nodes: DataFrame, key: str) -> DataFrame:
    """(key, code) of fields out of their bounds, and of required levels that are neither 0 nor 1 to 60; nulls were not decoded and pass."""
    have = {f: most for f, most in FIELD_BOUNDS.items() if f in nodes.columns}
    tests = {f"{f}_out_of_bounds": f"{f} NOT BETWEEN 0 AND {most}" for f, most in have.items()}
    if "required_level" in nodes.columns:
        tests["required_level_out_of_domain"] = f"required_level NOT BETWEEN 0 AND {MOST_LEVEL}"
    return violations(nodes, key, tests)


def rule_faults(rules: DataFrame, templates: DataFrame, branches: DataFrame, encounters: DataFrame) -> DataFrame:
    """(profile, id, code) for rule tables.

    rules: profile, rule, category, confidence, priority (text), template, match (map of operators); templates: profile,
    template; branches: profile, encounter, categories; encounters: profile, encounter.
    """
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    known = templates.select("profile", "template").distinct().withColumn("_t", F.lit(True))
    r = rules.join(known, ["profile", "template"], "left")
    codes = {
        "invalid_category": ~F.coalesce(F.array_contains(listed(RULE_CATEGORIES), F.col("category")), F.lit(False)),
        "invalid_confidence": F.col("confidence").isNotNull() & ~F.array_contains(listed(RULE_CONFIDENCE), F.col("confidence")),
        "priority_not_numeric": F.col("priority").isNotNull() & F.col("priority").try_cast("double").isNull(),
        "unknown_template": (F.coalesce("template", F.lit("")) != "") & F.col("_t").isNull(),
        "unsupported_operator": F.size(F.array_except(F.map_keys("match"), listed(MATCH_OPERATORS))) > 0,
    }
    out = r.select("profile", F.col("rule").alias("id"), F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in codes.items()]))).alias("code"))
    b = branches.join(encounters.select("profile", "encounter").distinct().withColumn("_e", F.lit(True)), ["profile", "encounter"], "left")
    wrong = F.array_compact(F.array(F.when(F.col("_e").isNull(), "unsupported_encounter"), F.when(F.size(F.array_except("categories", listed(RULE_CATEGORIES))) > 0, "unknown_branch_category")))
    return out.unionByName(b.select("profile", F.col("encounter").alias("id"), F.explode(wrong).alias("code")))
