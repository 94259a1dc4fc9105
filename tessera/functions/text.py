"""Text extraction on columns: built-in functions only, except Unicode normalisation (an Arrow UDF)."""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII word boundaries; Java's own ``\b`` also takes accented letters for word characters.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Detection rules. The first and last branch of a rule stand at a word boundary, the others anywhere.
TAG_RULES = {
    "heal": r"\bheal|healing|restores? health|mending|regenerat(?:e|es|ing|ion)|absorb\b",
    "tank": r"\btaunt|threat|armor|parry|dodge|block|damage taken|shield|barrier|mitigation|brace\b",
    "melee": r"\bmelee|weapon damage|main-hand|off-hand|strike|slash|cleave|swing|combo\b",
    "ranged": r"\branged weapon|ranged damage|shot|shoot|arrow|bolt|blast|projectile|throw|spear\b",
    "dot": r"\bperiodic damage|damage over|bleed|burn|poison|venom|disease|every \d+ sec",
    "hot": r"\bperiodic healing|healing over|regenerat(?:e|es|ing) .* health",
    "summon": r"\bsummon|animate|minion|pet|construct|wraith|elemental|falcon|hound|ward\b",
    "crowd_control": r"\bstun|root|silence|disorient|incapacitate|fear|slow|freeze|frozen|knock",
    "mobility": r"\bcharge|dash|leap|blink|teleport|movement speed|sprint|rush\b",
    "stealth": r"\bstealth|stealthed|invisible|ambush\b",
    "execute": r"\bbelow 20% health|below 35% health|above 80% health|execute\b",
    "proc": r"\bchance to|whenever|after casting|critical strikes?|resets? the cooldown|your next\b",
    "cooldown": r"\bcooldown|recharge|charges?\b",
    "builder": r"\bgenerates?|restores? .* (Energy|Rage|Insanity|Felfury|Static|Heat|mana)|refunds?|grants?",
    "spender": r"\bcost|spend|spends|consumes?|depletes?|free of cost\b",
    "aura": r"\baura|allies within|party and raid|nearby allies|members\b",
    "resource_management": r"\bEnergy|Rage|Insanity|Felfury|Static|Heat|mana|Fill Level|Advantage\b",
}
SCHOOL_RULES = {
    "physical": r"\bPhysical|weapon damage|bleed\b",
    "fire": r"\bFire|flame|burn|ember|pyro|ignite|hellfire|infernal\b",
    "frost": r"\bFrost|ice|rime|freeze|frozen|chill|hodir\b",
    "shadow": r"\bShadow|void|curse|horror|insanity|dark|soul\b",
    "holy": r"\bHoly|light|radiance|bless|vow|seraph|piety\b",
    "nature": r"\bNature|poison|venom|serpent|storm|lightning|earth|primal\b",
    "arcane": r"\bArcane|aether|chrono|time|distortion|rune|rift\b",
    "fel": r"\bFel|felfury|demon|infernal\b",
}
RESOURCE_RULES = {
    "Energy": r"\bEnergy\b",
    "Rage": r"\bRage\b",
    "Insanity": r"\bInsanity\b",
    "Felfury": r"\bFelfury\b",
    "Static": r"\bStatic\b",
    "Heat": r"\bHeat\b",
    "Mana": r"\bmana\b",
    "Advantage": r"\bAdvantage\b",
    "Fill Level": r"\bFill Level\b",
}
# Mechanic tags. A tag needs every pattern of its list.
MECHANIC_RULES = {
    "damage": [r"\bdamage\b"],
    "heal": [r"\bheal|healing|restore[s]?\s+health\b"],
    "dot": [r"\bover\s+\d|every\s+\d", r"\bdamage|poison|bleed|burn|disease\b"],
    "hot": [r"\bover\s+\d|every\s+\d", r"\bheal|restore[s]?\s+health\b"],
    "cooldown": [r"\bcooldown\b"],
    "summon": [r"\bsummon|pet|minion\b"],
    "crowd_control": [r"\bstun|silence|root|snare|slow\b"],
}
# Entities, stats and the words of items.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"))
# The tags that a tooltip may hold.
TOOLTIP_TAGS = ("b", "br", "div", "em", "i", "p", "small", "span", "strong", "table", "tbody", "td", "tfoot", "th", "thead", "tr")
STATS = "Critical Strike|Attack Power|Spell Power|Strength|Agility|Stamina|Intellect|Spirit|Haste|Mastery|Versatility|Armor"
WEAPONS = "sword|axe|mace|dagger|staff|polearm|bow|crossbow|gun|wand|fist weapon"
ARMOR_SLOTS = "head|neck|shoulder|chest|wrist|hands|waist|legs|feet|finger|trinket|back|shield"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = re.compile(r"[a-z0-9 %-]+")


def folded(text: Column) -> Column:
    """A-Z in lower case, null as empty: what the rules are tested on."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def branches(pattern: str) -> list[str]:
    """The branches of a pattern outside parentheses."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def literals(branch: str) -> list[str] | None:
    """The texts that a branch stands for, if it has only letters, optional letters and one group; the shortest do where one starts another."""
    group = re.search(r"\(\?:([^()]*)\)", branch)
    if group:
        made = [literals(branch[: group.start()] + x + branch[group.end() :]) for x in group[1].split("|")]
        return None if None in made else sorted({x for m in made for x in m})
    optional = re.search(r"([a-z])\?", branch)
    if optional:
        made = [literals(branch[: optional.start()] + x + branch[optional.end() :]) for x in ("", optional[1])]
        return None if None in made else sorted({x for m in made for x in m})
    return [branch] if PLAIN.fullmatch(branch) else None


def holds(value: Column, pattern: str) -> Column:
    r"""Whether a rule's pattern is found in a folded text; ``\b`` at its ends is an ASCII boundary.

    Plain branches are substring searches. Only branches with a boundary, a
    quantifier or ``.*`` are regular expressions, and those are tried where
    their first plain part occurs.
    """
    parts = branches(translate_ascii(pattern))
    tests = []
    for place, branch in enumerate(parts):
        left, right = place == 0 and branch.startswith(r"\b"), place == len(parts) - 1 and branch.endswith(r"\b")
        body = branch.removeprefix(r"\b").removesuffix(r"\b")
        plain = literals(body)
        if plain and not left and not right:
            short = [x for x in plain if not any(y != x and y in x for y in plain)]
            tests += [F.contains(value, F.lit(x)) for x in short]
        else:
            regex = F.regexp_like(value, F.lit((LEFT if left else "") + (f"(?:{body})" if left or right else body) + (RIGHT if right else "")))
            part = os.path.commonprefix(plain) if plain else re.match(r"[a-z0-9 %-]*(?![?*(])", body)[0][: None if re.fullmatch(r"[a-z0-9 %-]*", body) else -1]
            tests.append(F.contains(value, F.lit(part)) & regex if part else regex)
    return functools.reduce(lambda x, y: x | y, tests)


def translate_ascii(pattern: str) -> str:
    """The pattern's letters in lower case; its escapes have none in upper case."""
    return pattern.translate(str.maketrans(UPPER, LOWER))


def detect(text: Column, rules: dict[str, str], is_folded: bool = False) -> Column:
    """Names of the rules that match, in rule order; fold a column once where several rule sets are tested."""
    value = text if is_folded else folded(text)
    return F.array_compact(F.array(*[F.when(holds(value, p), F.lit(name)) for name, p in rules.items()]))


def detect_all(text: Column, rules: dict[str, list[str]], is_folded: bool = False) -> Column:
    """Names of the rules all of whose patterns match, sorted."""
    value = text if is_folded else folded(text)
    both = lambda patterns: functools.reduce(lambda x, y: x & y, [holds(value, p) for p in patterns])
    return F.array_compact(F.array(*[F.when(both(patterns), F.lit(name)) for name, patterns in sorted(rules.items())]))


def html_text(html: Column, line_breaks: bool = False) -> Column:
    """Tags out, common entities decoded, blanks collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>", "\n" if line_breaks else " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def escaped(text: Column) -> Column:
    """``& < > " '`` as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def safe_html(html: Column, allowed: tuple[str, ...] = TOOLTIP_TAGS) -> Column:
    """Only allowed tags are left, without attributes but the class of a span; scripts and styles go with their content.

    The text is cut at every ``<``; a part that is no tag stays as it is.
    """
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<\s*(script|style)\b[^>]*>.*?<\s*/\s*\1\s*>", "")
    tag = r"(?s)^\s*(/?)\s*([a-zA-Z0-9]+)([^>]*)>(.*)$"

    def part(p: Column) -> Column:
        slash, name, attributes, rest = (F.regexp_extract(p, tag, g) for g in (1, 2, 3, 4))
        name = F.lower(name)
        cls = F.when((name == "span") & (slash == ""), F.regexp_extract(attributes, r"""(?i)class\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0))
        value = F.regexp_replace(cls, r"""(?is)^class\s*=\s*["']|["']$""", "")
        opened = F.when(F.coalesce(cls, F.lit("")) != "", F.concat(F.lit('<span class="'), escaped(value), F.lit('">'))).otherwise(F.concat(F.lit("<"), slash, name, F.lit(">")))
        kept = F.when(name.isin(*allowed), opened).otherwise("")
        return F.when(F.regexp_like(p, F.lit(tag)), F.concat(kept, rest)).otherwise(F.concat(F.lit("<"), p))

    parts = F.split(out, "<", -1)
    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), part), ""))


def linked_ids(html: Column, kind: str) -> Column:
    """Ids in ``href="?kind=ID"``, distinct, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"""href=["']\?{kind}=(\d+)["']"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("long")))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def _word(first: str, rest: str) -> str:
    """A pattern at a word's start. The first character is tested before the one on its left, since nearly all places fail there."""
    return rf"(?i){first}(?<![A-Za-z0-9_]{first}){rest}"


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once, however often it occurs."""
    return F.get(F.transform(F.array(value), make), 0)


def level(text: Column) -> Column:
    """N of "Level N"."""
    return first_match(text, _word("L", rf"evel\s+(\d+){RIGHT}")).cast("int")


def required_level(text: Column) -> Column:
    """N of "Requires Level N", else of "Level N"."""
    return F.coalesce(first_match(text, _word("R", rf"equires Level\s+(\d+){RIGHT}")).cast("int"), level(text))


# What follows a number or a unit can't be part of it, so neither gives a character back.
_NUMBER = r"\d++(?:\.\d++)?+"
_SECONDS, _TIMES = "sec(?:onds?|s)?+", "(?:sec(?:onds?|s)?+|min(?:utes?|s)?+)"


def _amount(rest: str) -> str:
    """A pattern that begins with a number."""
    return _word(r"\d", rf"\d*+(?:\.\d++)?+\s*+{rest}{RIGHT}")


def _first_number(match: Column) -> Column:
    return F.regexp_extract(match, _NUMBER, 0).try_cast("double")


def _found(text: Column, pattern: str) -> Column:
    """The first match, empty if there is none: the text is searched once, numbers and units are taken from what was found."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0)


def _millis(text: Column, pattern: str, minutes: bool = False) -> Column:
    """The first number of the first match, as seconds or, where the pattern takes them, minutes."""
    found = _found(text, pattern)
    unit = F.when(F.contains(F.lower(found), F.lit("min")), 60000).otherwise(1000) if minutes else 1000
    return F.round(_first_number(found) * unit).cast("long")


def cooldown_ms(text: Column) -> Column:
    return _millis(text, _amount(rf"{_TIMES}\s+cooldown"), True)


def gcd_ms(text: Column) -> Column:
    return _millis(text, _amount(rf"{_SECONDS}\s+global cooldown"))


def cast_time_ms(text: Column) -> Column:
    """0 for "Instant", which is a value, not an absence."""
    instant = F.regexp_like(F.coalesce(text, F.lit("")), F.lit(_word("I", f"nstant{RIGHT}")))
    return F.when(instant, F.lit(0).cast("long")).otherwise(_millis(text, _amount(rf"{_SECONDS}\s+cast")))


def duration_ms(text: Column) -> Column:
    return _millis(text, _word("[lof]", rf"(?:(?<=l)asts|(?<=o)ver|(?<=f)or)\s+{_NUMBER}\s*+{_TIMES}{RIGHT}"), True)


def period_ms(text: Column) -> Column:
    return _millis(text, _word("e", rf"very\s+{_NUMBER}\s*+{_SECONDS}{RIGHT}"))


def range_yards(text: Column) -> Column:
    return _first_number(_found(text, _amount(r"yd\s+range")))


def power_costs(text: Column) -> Column:
    """Array of (amount, resource) for every "Costs N Resource"."""
    stop = r"(?=\s+(?:and|to|for|when|if|Deals|Heals|Restores|Lasts|over|every|Requires)|[.,;]|\s*$)"
    pattern = _word("C", rf"osts?\s+{_NUMBER}\s+[A-Za-z][A-Za-z ]*?{stop}")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda x: F.struct(_first_number(x).alias("amount"), F.trim(F.regexp_extract(x, r"\d\s+([A-Za-z].*)", 1)).alias("resource")))


def stats(text: Column) -> Column:
    """Map of stat to value for every "+N Stat"; the last one of a name wins."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\+\d+\s+(?:{STATS}){RIGHT}"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.replace(F.lower(F.regexp_extract(x, r"\s([A-Za-z].*)", 1)), F.lit(" "), F.lit("_")).alias("key"), _first_number(x).alias("value")))
    last = lambda some: F.filter(some, lambda x, i: ~F.exists(F.slice(some, i + 2, F.size(some)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(_let(pairs, last))


def item_kind(text: Column) -> Column:
    """struct(item_class, item_subclass, inventory_type) from weapon or armour words."""
    value = F.lower(F.coalesce(text, F.lit("")))
    weapon = rf"([otmr](?<![a-z0-9_].)(?:(?<=o)ne-hand|(?<=t)wo-hand|(?<=m)ain hand|(?<=o)ff hand|(?<=r)anged))\s+({WEAPONS}){RIGHT}"
    armor = rf"([clmp](?<![a-z0-9_].)(?:(?<=c)loth|(?<=l)eather|(?<=m)ail|(?<=p)late))\s+({ARMOR_SLOTS}){RIGHT}"
    w_prefix, w_kind, a_kind, a_slot = (first_match(value, p, g) for p, g in ((weapon, 1), (weapon, 2), (armor, 1), (armor, 2)))
    return F.struct(
        F.when(w_kind.isNotNull(), "weapon").when(a_kind.isNotNull(), "armor").alias("item_class"),
        F.coalesce(F.regexp_replace(w_kind, r"\s+", "_"), a_kind).alias("item_subclass"),
        F.coalesce(F.regexp_replace(w_prefix, r"[\s-]+", "_"), a_slot).alias("inventory_type"),
    )


def slug(text: Column, separator: str = "_") -> Column:
    """Lower case, runs of other characters as one separator, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", separator), F.lit(separator))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition has no built-in function."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def canonical_label(text: Column) -> Column:
    """NFKC, no blanks, lower case: equal labels that are only written differently become equal."""
    return F.lower(F.regexp_replace(nfkc(text), r"\s+", ""))


def icon_token(text: Column) -> Column:
    """Base name without extension, as a slug."""
    return slug(F.regexp_replace(F.regexp_replace(text, r"^.*[\\/]", ""), r"\.[A-Za-z0-9]+$", ""))
