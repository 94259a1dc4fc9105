"""Likeness of feature sets, performance bands, and greedy diverse selection within scopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, scratch


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 less intersection over union; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


# What in a text stands for a tag.
TEXT_TAGS = {
    "poison": ["poison", "venom"],
    "dot": ["damage over time", "periodic"],
    "cooldown": ["cooldown"],
    "heal": ["heal", "healing"],
    "summon": ["summon", "pet"],
    "defensive": ["armor", "shield", "mitigation", "defensive"],
}


def normalized(value: Column) -> Column:
    return F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))


def fingerprints(builds: DataFrame, nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """``builds`` (build, role) with the playstyle of each.

    nodes: build, node, name, text, tags, schools, resources, passive; actions:
    build, name, category, node. Tags are the nodes' own and what their texts
    stand for; the primary ones are the six most frequent, ties by name; the
    names are the first eight of active nodes in node order, then of actions.
    One aggregate per side, all with partial sums.
    """
    text = F.lower(F.concat_ws(" ", "name", "text"))
    told = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(text, F.lit(w)).cast("int") for w in words] + [F.lit(0)]) > 0, F.lit(tag)) for tag, words in TEXT_TAGS.items()]))
    own = F.array_distinct(F.filter(F.transform("tags", normalized), lambda t: t != ""))
    tagged = nodes.select("build", F.explode(F.concat(own, told)).alias("tag")).groupBy("build", "tag").agg(F.count("*").cast("int").alias("n"))
    tags = tagged.groupBy("build").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))).alias("_t"))
    tags = tags.select("build", F.transform(F.slice("_t", 1, 6), lambda x: x["tag"]).alias("primary"), F.map_from_entries(F.transform("_t", lambda x: F.struct(x["tag"], -x["n"]))).alias("tags"))
    sums = nodes.groupBy("build").agg(
        F.count("*").alias("_n"), F.count_if("passive").alias("_passive"), F.array_sort(F.collect_list(F.when(~F.col("passive"), F.struct("node", "name")))).alias("_names"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.transform("schools", normalized))))).alias("schools"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.transform("resources", normalized))))).alias("resources"),
    )
    acted = actions.groupBy("build").agg(
        F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "name")))).alias("_acted"),
        F.sort_array(F.collect_set(normalized(F.col("category")))).alias("categories"),
        F.count_if(normalized(F.col("category")) == "cooldown").alias("_cooldowns"),
    )
    out = builds.join(sums, "build", "left").join(tags, "build", "left").join(acted, "build", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("primary", "schools", "resources", "categories")})
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["name"]), none)
    every = F.concat(names("_names"), F.array_except(names("_acted"), names("_names")))
    count = lambda *tag: sum((F.coalesce(F.try_element_at("tags", F.lit(t)), F.lit(0)) for t in tag), F.lit(0)).cast("double")
    role = lambda test: F.coalesce(test.cast("double"), F.lit(0.0))
    r = F.col("role")
    poisons = F.size(F.filter(every, lambda x: F.contains(F.lower(x), F.lit("poison")) | F.contains(F.lower(x), F.lit("venom"))))
    return out.select(
        *builds.columns, "primary", F.slice(every, 1, 8).alias("names"), "schools", "resources", "categories",
        F.coalesce(F.round(F.col("_passive") / F.greatest(F.lit(1), F.col("_n")), 4), F.lit(0.0)).alias("passive_ratio"), F.coalesce(F.col("_n") - F.col("_passive"), F.lit(0)).alias("active"),
        (count("cooldown") + F.coalesce("_cooldowns", F.lit(0))).alias("cooldowns"), (count("dot") + poisons).alias("dots"), count("summon", "pet").alias("summons"), count("heal", "healing").alias("heals"),
        count("tank", "defensive", "mitigation").alias("defensives"), count("support", "utility", "aura", "buff").alias("supports"),
        (count("melee") + role(r == "melee_dps")).alias("melee"), (count("ranged") + role(F.contains(r, F.lit("ranged")))).alias("ranged"), (count("caster", "spell") + role(r == "caster_dps")).alias("caster"),
        playstyle_label(F.coalesce(F.map_keys("tags"), none), F.col("categories"), r, F.get("primary", 0)).alias("label"),
    )


def playstyle_label(tags: Column, categories: Column, role: Column, top: Column) -> Column:
    """The first playstyle whose tags, categories or role occur."""
    has = lambda *names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    does = lambda *names: F.arrays_overlap(categories, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(has("poison", "venom"), "poison DoT loop")
        .when(has("dot") | does("maintenance"), "DoT upkeep loop")
        .when(has("summon", "pet"), "pet setup window")
        .when(has("cooldown") | does("cooldown"), "burst cooldown cycle")
        .when((role == "tank") | has("tank", "defensive"), "defensive sustain")
        .when((role == "healer") | has("heal", "healing"), "healing cadence")
        .when((role == "support") | has("support", "aura", "utility"), "support uptime")
        .when(has("builder", "spender") | does("builder", "spender"), "builder-spender loop")
        .when(F.size(tags) > 0, F.concat(top, F.lit(" build")))
        .otherwise("generalist build")
    )


#: The small addend keeps exact halves from falling to either side by the order of the sum.
TIE = 1e-9


def distance(a: str, b: str) -> Column:
    """Distance of two fingerprints: names, primary tags, categories, schools and resources, numbers, and role."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = lambda name: jaccard_distance(c(a, name), c(b, name))
    delta = lambda x, y: F.least(F.lit(1.0), F.abs(x - y))
    number = lambda name: delta(c(a, name).cast("double"), c(b, name).cast("double"))
    helped = lambda side: c(side, "heals") + c(side, "defensives") + c(side, "supports")
    numbers = (number("passive_ratio") + number("cooldowns") + number("dots") + number("summons")) / 4
    roles = (number("melee") + number("ranged") + number("caster") + delta(helped(a), helped(b))) / 4
    # The weights of the six parts.
    whole = 0.30 * apart("names") + 0.25 * apart("primary") + 0.15 * apart("categories") + 0.10 * (apart("schools") + apart("resources")) / 2 + 0.10 * numbers + 0.10 * roles
    return F.round(F.least(F.lit(1.0), whole + TIE), 4)


def signatures(builds: DataFrame, actions: DataFrame) -> DataFrame:
    """``builds`` (build, role) with how each is played, from its actions (build, key, category, priority)."""
    kinds = {
        "core": ("builder", "spender", "filler", "execute", "aoe"),
        "maintenance": ("maintenance",),
        "cooldown": ("cooldown",),
        "tools": ("defensive", "healing", "support", "utility"),
    }
    some = actions.select("build", F.struct("priority", "key").alias("k"), normalized(F.col("category")).alias("c"))
    order = lambda names: F.transform(F.array_sort(F.collect_list(F.when(F.col("c").isin(*names), F.struct(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("c")).alias("p"), "k")))), lambda x: x["k"]["key"])
    each = some.groupBy("build").agg(*[order(names).alias(f"{kind}_actions") for kind, names in kinds.items()], F.collect_set("c").alias("_c"))
    out = builds.join(each, "build", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in (*[f"{k}_actions" for k in kinds], "_c")})
    has = lambda name: F.array_contains("_c", name)
    loop = F.when(has("builder") & has("spender"), "builder_spender").when(has("maintenance"), "maintenance_loop").when(has("cooldown"), "cooldown_driven").when(has("support"), "support_cycle").when(has("defensive"), "defensive_cycle").otherwise("unknown")
    n = F.size("cooldown_actions")
    uptime = F.array_compact(F.array(*[F.when(has(c), F.lit(u)) for c, u in (("maintenance", "dot"), ("healing", "hot"), ("support", "aura"), ("defensive", "mitigation"), ("summon", "summon"))]))
    opener = F.concat(F.slice("maintenance_actions", 1, 1), F.slice("cooldown_actions", 1, 1), F.slice("core_actions", 1, 2))
    reach = F.when(F.endswith("role", F.lit("_dps")), F.replace("role", F.lit("_dps"), F.lit(""))).otherwise(F.col("role"))
    return out.withColumns({"opener_actions": opener, "resource_loop": loop, "burst": F.when(n >= 2, "long").when(n == 1, "medium").otherwise("none"), "uptime": uptime, "reach": reach}).drop("_c")


def signature_distance(a: str, b: str) -> Column:
    """Distance of how two builds are played."""
    apart = lambda name: jaccard_distance(F.col(f"{a}.{name}"), F.col(f"{b}.{name}"))
    other = lambda name: (F.col(f"{a}.{name}") != F.col(f"{b}.{name}")).cast("double")
    # The weights of the parts.
    acts = 0.35 * apart("core_actions") + 0.15 * apart("opener_actions") + 0.15 * apart("maintenance_actions") + 0.15 * apart("cooldown_actions") + 0.05 * apart("tools_actions")
    kinds = (other("resource_loop") + other("burst") + other("reach")) / 3
    return F.round(F.least(F.lit(1.0), acts + 0.10 * kinds + 0.05 * apart("uptime") + TIE), 4)


def blended_distance(a: str, b: str) -> Column:
    """55 % fingerprint, 45 % signature; the fingerprint alone where a side has no signature (``played`` false)."""
    both = F.col(f"{a}.played") & F.col(f"{b}.played")
    return F.when(both, F.round(0.55 * distance(a, b) + 0.45 * signature_distance(a, b) + TIE, 4)).otherwise(distance(a, b))


def best_distances(prints: DataFrame, scope: str, key: str, measure=distance) -> DataFrame:
    """(scope, key, distance) of every candidate to the best one of its scope by score, ties to the first key: one join row each, no pairs."""
    best = prints.groupBy(scope).agg(F.max_by(key, F.struct("score", key)).alias(key))
    anchors = prints.join(best, [scope, key], "left_semi")
    pairs = prints.alias("a").join(anchors.alias("b"), F.expr(f"a.{scope} = b.{scope}"))
    return pairs.select(F.col(f"a.{scope}").alias(scope), F.col(f"a.{key}").alias(key), measure("a", "b").alias("distance"))


#: Values that a task orders as they are, and the ranges that more are cut into.
CUT, RANGES = 10_000, 64


def order_statistics(values: DataFrame, asked: DataFrame, scope: str, cut: int = CUT) -> DataFrame:
    """(scope, which, value): the value of rank k, exactly, for each ask.

    values: scope, value, n (how often), each value once, written; asked: scope,
    which, k (from 0). Where a scope has more than ``cut`` values, they are cut
    into ranges at approximate quantiles, the ranges are counted, and the one
    that holds the rank is cut again, until few values are left; only these are
    ordered. So no task holds a scope, whatever its size.
    """
    sizes = values.groupBy(scope).agg(F.count("*").alias("_rows"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    spots = materialize(asked.join(sizes, scope).withColumn("_start", F.lit(0).cast("long")), "rank-spots")
    within = F.expr(f"v.{scope} = s.{scope} AND v.value >= s._lo AND v.value <= s._hi")
    held = lambda some: values.alias("v").join(some.alias("s"), within).select(f"s.{scope}", "s.which", "s.k", "s._start", "v.value", "v.n")
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    by = [scope, "which"]
    while not (large := spots.filter(F.col("_rows") > cut)).isEmpty():
        inside = held(large)
        bounds = inside.groupBy(*by).agg(F.array_distinct(F.percentile_approx("value", steps)).alias("_b"))
        ranged = inside.join(materialize(bounds, "rank-bounds"), by).withColumn("_range", F.size(F.filter("_b", lambda b: b <= F.col("value"))))
        sums = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_n"), F.count("*").alias("_rows"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.first("k").alias("k"), F.first("_start").alias("_start"))
        upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
        placed = sums.withColumn("_start", F.col("_start") + F.sum("_n").over(upto) - F.col("_n"))
        better = placed.filter("_start <= k AND k < _start + _n").select(*by, "k", "_rows", "_lo", "_hi", "_start")
        spots = materialize(spots.filter(F.col("_rows") <= cut).unionByName(better), "rank-spots")
    order = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    walked = held(spots).withColumn("_upto", F.col("_start") + F.sum("n").over(order))
    return walked.filter("_upto - n <= k AND k < _upto").select(*by, "value")


def medians(rows: DataFrame, scope: str, value: Column, cut: int = CUT) -> DataFrame:
    """(scope, median) of the values that are not null: the middle one, or the mean of the two in the middle."""
    counted = materialize(rows.select(scope, value.alias("value")).filter("value IS NOT NULL").groupBy(scope, "value").agg(F.count("*").alias("n")), "rank-values")
    totals = counted.groupBy(scope).agg(F.sum("n").alias("_all"))
    asked = totals.select(scope, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.expr("(_all - 1) DIV 2").alias("k")), F.struct(F.lit(1).alias("which"), F.expr("_all DIV 2").alias("k")))).alias("a")).select(scope, "a.*")
    return order_statistics(counted, asked, scope, cut).groupBy(scope).agg(F.avg("value").alias("median"))


def band_floor(scores: DataFrame, scope: str, relative: float = 0.90, cut: int = CUT) -> DataFrame:
    """The least score of the band per scope, and whether the band had to be widened.

    Six candidates or more: best less the larger of 1.5 MAD and 5 %; never under
    ``relative`` of the best. If only one is left, down to the second or 88 %.
    Medians are exact, found by narrowing ranges; the plan runs jobs.
    """
    scores = materialize(scores.select(scope, "score"), "band-scores")
    basic = scores.groupBy(scope).agg(F.max("score").alias("_best"), F.count("*").alias("_n")).join(medians(scores, scope, F.col("score"), cut).withColumnRenamed("median", "_med"), scope, "left")
    off = materialize(scores.join(materialize(basic, "band-basics"), scope), "band-offsets")
    # The second best is the best when two share it, else the largest of the others.
    rest = off.groupBy(scope).agg(F.max(F.when(F.col("score") < F.col("_best"), F.col("score"))).alias("_below"), F.count_if(F.col("score") == F.col("_best")).alias("_firsts"))
    rest = rest.join(medians(off, scope, F.abs(F.col("score") - F.col("_med")), cut).withColumnRenamed("median", "_mad"), scope, "left")
    joined = basic.join(rest, scope).withColumn("_second", F.when(F.col("_firsts") > 1, F.col("_best")).otherwise(F.col("_below")))
    least = F.col("_best") * relative
    floor = F.greatest(least, F.when(F.col("_n") >= 6, F.col("_best") - F.greatest(1.5 * F.col("_mad"), F.col("_best") * 0.05)).otherwise(least))
    joined = joined.withColumn("_floor", floor)
    alone = F.coalesce((F.col("_n") > 1) & (F.col("_second") < F.col("_floor")), F.lit(False))
    return joined.select(scope, F.round(F.when(alone, F.greatest(F.col("_best") * 0.88, F.col("_second"))).otherwise(F.col("_floor")), 4).alias("floor"), alone.alias("widened"), F.col("_best").alias("best"))


def in_band(candidates: DataFrame, scope: str) -> DataFrame:
    """The candidates (with scope and score) that reach their scope's floor, and ``best``, the scope's best score; written. Runs jobs."""
    with scratch(candidates.sparkSession) as result:
        floors = result(band_floor(candidates, scope).select(scope, "floor", "best"), "floors")
    return materialize(candidates.join(floors, scope).filter(F.round("score", 4) >= F.col("floor")).drop("floor"), "eligible")


def select_diverse(eligible: DataFrame, prints: Callable[[DataFrame], DataFrame], scope: str, key: str, k: int, least_distance: float = 0.22, measure=distance) -> DataFrame:
    """(scope, key, place): the best reliable one in the band, then those of best blended score that differ enough.

    All scopes in one pass per place; a candidate is only ever compared with the
    chosen ones, at most k. eligible: what ``in_band`` gives of scope, key, score
    and reliability; only these columns go through the rounds. ``prints`` gives
    the fingerprints (with scope and key) of the candidates it gets: those of
    scopes with a choice. Runs a job per place.
    """
    columns = [scope, key, "score", "best", "reliability"]
    rank = F.struct((F.col("reliability") >= 0.5).alias("sure"), "score", "reliability")
    first = eligible.groupBy(scope).agg(F.max(rank).alias("_top"), F.count("*").alias("_n"))
    same = eligible.join(first, scope).filter(rank == F.col("_top")).groupBy(scope).agg(F.min(key).alias(key))
    chosen = materialize(same.select(scope, key, F.lit(1).alias("place")), "chosen")
    if k < 2:
        return chosen
    several = materialize(eligible.join(first.filter("_n > 1").select(scope), scope), "contested")
    prints = materialize(prints(several), "prints")
    last, gaps = chosen, None
    for place in range(2, k + 1):
        have = prints.join(last.select(scope, key), [scope, key], "left_semi")
        near = prints.alias("a").join(have.alias("b"), F.expr(f"a.{scope} = b.{scope} AND a.{key} <> b.{key}")).select(F.col(f"a.{scope}").alias(scope), F.col(f"a.{key}").alias(key), measure("a", "b").alias("_d"))
        # The gaps hold none of those chosen before.
        gaps = near if gaps is None else near.join(gaps.withColumnRenamed("_d", "_e"), [scope, key]).select(scope, key, F.least("_d", "_e").alias("_d"))
        gaps = materialize(gaps, "gaps")
        blended = F.round(0.60 * F.col("score") / F.col("best") + 0.25 * F.col("reliability") + 0.15 * F.col("_d"), 9)
        far = gaps.filter(F.col("_d") >= least_distance).join(several.select(*columns), [scope, key]).withColumn("_s", F.struct(blended.alias("b"), "score"))
        top = far.groupBy(scope).agg(F.max("_s").alias("_m"))
        last = far.join(top, scope).filter(F.col("_s") == F.col("_m")).groupBy(scope).agg(F.min(key).alias(key)).withColumn("place", F.lit(place))
        last = materialize(last, "chosen")
        if last.isEmpty():
            break
        chosen = chosen.unionByName(last)
    return chosen
