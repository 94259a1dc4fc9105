"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans. A span that one of the four
base formats validates is always redacted. The others (spelled-out addresses,
unprefixed phone numbers, shorter card numbers, bracketed addresses) are scored
by boosted trees over format and context features, and redacted where the score
reaches the threshold calibrated for their kind.

The trees are trained on the corpus itself with MLlib. Positive examples are the
validated base spans, as they stand and written out in place in the forms that
only the wide generators propose. Negative ones are base-shaped spans that fail
validation, and what the wide generators propose wrongly: at/dot runs of words
that are no address, quads that fail, and parts of a valid span of another kind.
Corpora rarely hold failing quads, so each valid one is also given with an octet
out of range. The features leave out what makes an example positive
by definition: they give measures (the Luhn remainder, the largest and smallest
number, at and dot words, the last label), not the verdicts of the base formats.
Every document gives its candidates, and all of them count: equal examples are
one row with their number as its weight. A third of the texts is held out to set the
thresholds: the lowest score (in steps of 0.0001) from which the precision on the held-out spans is
at least ``PRECISION``; a kind without examples of both labels gets no spans
beyond the base.

Edge cases: a null text is empty; ids may be null or repeated, and any integers; a corpus without
both classes of examples trains no trees and reports base spans only; all scans
are linear in the length of the text, and choosing among n candidates takes
n log n steps.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import Cover, Span, digest, freed, joined, per_document
from tessera.session import bound_batches, materialize, scratch

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TREES, DEPTH, LEAST_BINS = 10, 3, 16

# The base formats, written so that every scan is linear.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{3,6}(?:[\x20./-]?[0-9]{3,6}){2,5}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
}
# Where the wide forms can be: an address has one of these marks, the other kinds lie in such a run.
MARK = re.compile(r"\(at\)|\[at\]|\x20at(?=\x20)")
RUN = re.compile(r"[0-9(][0-9\x20./()\[\]-]{6,}")
CUES = {
    "email": re.compile(r"mail|contact|write|@", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|login", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|account|payment", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|fax|mobile", re.IGNORECASE),
}
CONTEXT = 24
AT = re.compile(r"\x20?(\(at\)|\[at\]|\x20at\x20)\x20?")
DOT = re.compile(r"\x20?(\(dot\)|\[dot\]|\x20dot\x20)\x20?|\.")
LABEL = re.compile(r"[A-Za-z0-9-]{2,63}")


def luhn_rest(digits: str) -> int:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10


def luhn(digits: str) -> bool:
    return luhn_rest(digits) == 0


def octet(digits: str) -> bool:
    """At most 255, with any number of zeros before it."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: each @ takes the run of local characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)
    return out


def _valid(kind: str, body: str) -> bool:
    if kind == "ip":
        return all(octet(p) for p in body.split("."))
    if kind == "card":
        digits = _digits(body)
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(_digits(body)) <= 15


def spelled_out(body: str) -> bool:
    """An address with at and dots in words: a domain that ends in letters, and more than a bare "at" before a dot."""
    parts = AT.split(body, maxsplit=1)
    if len(parts) < 3:
        return False
    labels = DOT.split(parts[2])
    names, dots = labels[::2], labels[1::2]
    return all(map(LABEL.fullmatch, names)) and len(names) > 1 and names[-1].isalpha() and (parts[1] != " at " or any(dots))


def written_out(kind: str, body: str) -> list[str]:
    """A valid base span in the forms that only the wide generators propose."""
    if kind == "email":
        local, domain = body.split("@", 1)
        forms = [local + at + domain.replace(".", dot) for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "))]
    elif kind == "ip":
        forms = [body.replace(".", "[.]"), body.replace(".", " . ")]
    elif kind == "card":
        digits = _digits(body)
        forms = [sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sep in "./"]
    else:
        forms = [re.sub(r"^\+[0-9]{1,3}[\x20.-]", "", body)]
    return [f for f in forms if WIDE[kind].fullmatch(f)]


def perturbed(body: str) -> tuple[list[str], list[str]]:
    """Other addresses than this one, without digits, and what the wide generators take for it: sentence ends, times, bare hosts."""
    local, domain = body.split("@", 1)
    name, host = (re.sub("[0-9]", "", x).strip(".-") or "some" for x in (local, domain.split(".")[0]))
    plain = f"{name}@{host}." + re.sub("[0-9]", "", domain.split(".")[-1])
    wrong = [f"{local} at {host}. {name}", f"{name} at {host}. {local}", f"{local} (at) {host}.{len(body)}", f"{name} at {host}.{name}", f"{name} at {len(body)}. {host}"]
    return written_out("email", plain), [w for w in wrong if WIDE["email"].fullmatch(w) and not spelled_out(w)]


def examples(text: str) -> list[tuple[str, float, list[float]]]:
    """Labelled candidates of a text: kind, label, features (see the module's text)."""
    out, base = [], base_matches(text)

    def placed(kind: str, start: int, end: int, form: str) -> list[float]:
        before = text[max(0, start - CONTEXT) : start]
        return features(before + form + text[end : end + 1], (kind, len(before), len(before) + len(form)))

    for (kind, start, end), valid in base:
        # Runs of few digits are what the wide generators would never propose.
        if valid or end - start >= 6:
            out.append((kind, float(valid), features(text, (kind, start, end))))
        if valid:
            forms = written_out(kind, text[start:end])
            out += [(kind, 1.0, placed(kind, start, end, f)) for f in forms]
            if kind == "email":
                right, wrong = perturbed(text[start:end])
                out += [(kind, label, placed(kind, start, end, f)) for label, some in ((1.0, right), (0.0, wrong)) for f in some]
            if kind == "ip":
                out += [(kind, 0.0, placed(kind, start, end, re.sub(r"^[0-9]+", lambda m: str(int(m[0]) + 256), f))) for f in (text[start:end], *forms)]
    good = [span for span, valid in base if valid]
    for kind, start, end in wide_candidates(text):
        over = {k for k, s, e in good if s < end and start < e}
        body = text[start:end]
        wrong = kind == "email" and not spelled_out(body) or kind == "ip" and not all(int(g) <= 255 for g in re.findall("[0-9]+", body))
        if kind not in over and (over or wrong):
            out.append((kind, 0.0, features(text, (kind, start, end))))
    return out


def base_matches(text: str) -> list[tuple[Span, bool]]:
    """Base-shaped spans, leftmost and non-overlapping within each kind, and whether they validate."""
    out = [(("email", s, e), True) for s, e in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [((kind, m.start(), m.end()), _valid(kind, m[0])) for m in pattern.finditer(text)]
    return out


def _spelled(text: str) -> list[Span]:
    """The matches of the wide form of an address, found from its marks: each takes the run of local characters before it."""
    out, free = [], 0
    for mark in MARK.finditer(text):
        end = mark.start() - (text[mark.start() - 1 : mark.start()] == " ")
        start = end
        while start > free and end - start < 64 and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if end - start >= 2 and (m := WIDE["email"].match(text, start)):
            out.append(("email", start, m.end()))
            free = m.end()
    return out


def wide_candidates(text: str) -> list[Span]:
    """Overlapping proposals of the high-recall generators."""
    found, runs = _spelled(text), [m.span() for m in RUN.finditer(text)]
    for kind in KINDS[1:]:
        found += [(kind, m.start(), m.end()) for start, end in runs for m in WIDE[kind].finditer(text, start, end)]
    return found


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    body, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = _digits(body)
    groups = re.findall(r"[0-9]+", body)
    after = text[end : end + 1]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(body)),
        float(len(digits)),
        len(digits) / len(body),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(len(set(digits))),
        float(luhn_rest(digits) if digits and len(digits) <= 32 else -1),
        float(max((int(g[:4]) if len(g) <= 4 else 10_000 for g in groups), default=-1)),
        float(min((int(g[:4]) if len(g) <= 4 else 10_000 for g in groups), default=-1)),
        float(body.count("@")),
        float(len(re.findall(r"[\[(]at[\])]", body))),
        float(len(re.findall(r"[\[(\x20]dot[\])\x20]", body))),
        float(body.count(". ")),
        float(body[-1:].isalpha()),
        float(len(re.search(r"[A-Za-z0-9-]*\Z", body)[0])),
        float("(" in body or "[" in body),
        float(body.count("-") + body.count(" ")),
        float(body.count(".")),
        float(bool(CUES[kind].search(before))),
        float(before[-1:].isalnum()),
        float(after.isalnum()),
        sum(c.isdigit() for c in before) / max(1, len(before)),
    ]


N_FEATURES = 26


@dataclass(frozen=True)
class Model:
    """Trees as arrays (feature, threshold, left, right, value); thresholds by kind, above 1 where there is no evidence."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """In steps of 0.0001, so that all held-out examples can be counted by score."""
        margin = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            margin += weight * value[at]
        return np.round(1 / (1 + np.exp(-2 * margin)), 4)


NO_MODEL = Model((), (), dict.fromkeys(KINDS, 2.0))


def _tree_arrays(root) -> tuple:
    """A fitted MLlib tree as arrays; trees have at most 2 ** (DEPTH + 1) - 1 nodes."""
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, float(node.prediction())])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), float(split.threshold())]
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        return at

    add(root)
    columns = list(zip(*rows, strict=True))
    return tuple(np.array(c, dtype=np.int64 if i in (0, 2, 3) else np.float64) for i, c in enumerate(columns))


EXAMPLE = "kind string, label double, held_out boolean, x array<double>, n long"


def training_spans(docs: DataFrame) -> DataFrame:
    """Labelled candidates of all documents: kind, label, held_out, features, and how many are alike."""

    def run(batches):
        for batch in batches:
            alike = Counter()
            for text in batch["text"].to_pylist():
                held = zlib.crc32((text or "").encode()) % 3 == 0  # all candidates of a text go the same way
                alike.update((kind, label, held, tuple(x)) for kind, label, x in examples(text or ""))
            if alike:
                kinds, labels, helds, xs = zip(*alike, strict=True)
                columns = [pa.array(kinds), pa.array(labels), pa.array(helds), pa.array(xs, pa.list_(pa.float64())), pa.array(alike.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "label", "held_out", "x", "n"])

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(lambda it: freed(run(it)), EXAMPLE).groupBy("kind", "label", "held_out", "x").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, precision: float = PRECISION) -> Model:
    """Train and calibrate on the candidates of all documents (see the module's text)."""
    with scratch(docs.sparkSession):
        return _fitted(materialize(training_spans(docs), "pii-examples"), precision)


def _fitted(spans: DataFrame, precision: float) -> Model:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    train = spans.filter(~F.col("held_out")).select("label", F.col("n").cast("double").alias("n"), array_to_vector("x").alias("features"))
    rows, low, high = train.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if (low, high) != (0.0, 1.0):
        return NO_MODEL
    # MLlib takes split points from as many rows as the square of maxBins: with this many bins from all of them.
    bins = max(LEAST_BINS, math.isqrt(rows) + 1)
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=0.3, seed=7, weightCol="n").fit(train)
    trees = tuple(_tree_arrays(t._java_obj.rootNode()) for t in fitted.trees)
    model = Model(trees, tuple(fitted.treeWeights), {})
    return Model(trees, model.weights, thresholds(spans.filter("held_out"), model, precision))


def thresholds(held: DataFrame, model: Model, precision: float) -> dict[str, float]:
    """The threshold of each kind, from all held-out candidates, counted by score (at most 10,001 of each kind)."""

    def scored(batches):
        for batch in batches:
            x = np.array(batch["x"].to_pylist()).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch["kind"], pa.array(model.scores(x)), batch["label"], batch["n"]], names=["kind", "score", "label", "n"])

    counted = held.select("kind", "label", "x", "n").mapInArrow(scored, "kind string, score double, label double, n long")
    counts = counted.groupBy("kind", "score").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("every")).toPandas()
    own = {kind: counts[counts["kind"] == kind] for kind in KINDS}
    return {kind: calibrated(*(c[k].to_numpy() for k in ("score", "good", "every")), precision) for kind, c in own.items()}


def calibrated(scores: np.ndarray, good: np.ndarray, every: np.ndarray, precision: float, least: int = 10) -> float:
    """The lowest of distinct scores from which at least ``precision`` of the spans are good; 2.0 if none, or too few of either label."""
    if min(good.sum(), every.sum() - good.sum()) < least:
        return 2.0
    order = np.argsort(-scores)
    right, met = np.cumsum(good[order]), np.cumsum(every[order])
    enough = np.flatnonzero((right / met >= precision) & (right >= least))
    return float(scores[order][enough[-1]]) if len(enough) else 2.0


def select_spans(base: list[Span], candidates: list[Span], scores: np.ndarray, thresholds: dict[str, float]) -> list[Span]:
    """Base spans, and the candidates over their threshold that overlap nothing chosen before them, best first."""
    chosen, taken = list(base), Cover((s, e) for _, s, e in base)
    for i in sorted(range(len(candidates)), key=lambda i: (-scores[i], candidates[i][1], -candidates[i][2])):
        kind, start, end = candidates[i]
        if scores[i] >= thresholds[kind] and not taken.meets(start, end):
            chosen.append(candidates[i])
            taken.add(start, end)
    return sorted(chosen, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_all(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; the candidates of all texts are scored together."""
    found, xs = [], []
    for text in texts:
        base = [span for span, valid in base_matches(text) if valid]
        wide = [c for c in wide_candidates(text) if model.thresholds[c[0]] <= 1]
        found.append((base, wide))
        xs += [features(text, c) for c in wide]
    scores, at, out = model.scores(np.array(xs).reshape(-1, N_FEATURES)), 0, []
    for base, wide in found:
        out.append((base, select_spans(base, wide, scores[at : at + len(wide)], model.thresholds)))
        at += len(wide)
    return out


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: counts per kind and digest of the base spans, and all spans to redact."""
    model = fit(docs) if model is None else model

    def rows(texts: list[str]) -> list[tuple]:
        out = []
        for base, every in find_all(texts, model):
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            out.append((*counts, digest(base), joined(every)))
        return out

    return per_document(docs, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", rows)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])
