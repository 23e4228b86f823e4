"""Personal data: fixed base patterns, and more spans chosen by candidate gradient boosting.

Generators with a high recall propose spans that may overlap.  Boosted trees score
each from its format (digits, groups, separators, checksum, octets) and its context (the text
before it, the characters around it).  Per kind, the least score at which the calibration part of
the documents still has the wanted precision is the threshold; candidates above it are
added to the base spans, which always stay.

Only candidates that no base span touches are learned from, since only these can be added.  In
all documents (two thirds of them by a hash of the id fit, the others calibrate), every base span is rewritten in its own
context the ways in which people write around such patterns ("(at)", "00" for "+", other separators,
a line break, the same value twice side by side); where the base patterns lose it, candidates on it are the
positive rows.  The negative ones are the candidates of the texts as they are: dates, versions, ids, numbers of
failed checksums.  A number that no base span touches but that has a card's checksum may be either, and teaches nothing.  The fitted trees become one column expression, so all texts are
scanned, scored and joined to results inside Spark's own functions, without a shuffle.

What is learned from is counted: rows alike in kind, features and label are one row with their summed weight, so the
table that the trees are fitted on grows with the different candidates and not with the documents.

Defined cases: a null text is empty and has no spans; a text without candidates has empty ``spans``;
if the documents have candidates of one class only, nothing is added; repeated rows give one
result row each; an empty table gives an empty result; other columns are ignored.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, DEPTH, STEP = 20, 3, 0.2
#: Precision that a threshold must reach on the calibration part.
PRECISION = 0.9
#: Code points before a candidate that are its context.
CONTEXT = 30

# Fixed patterns of the base kinds, in their fixed order.  Each finds what the plain pattern finds leftmost and
# without overlaps: a match starts where no match could have started one character earlier, or where the last
# one ended (\G), and groups that cannot give characters back are possessive, so long texts neither take quadratic time nor deep recursion.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters without one of which a kind cannot occur.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

# Patterns of the candidate generators, as (kind, pattern); what they propose may overlap.
_BETWEEN = r"[\x20\t\r\n./_-]"
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}+(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]{1,3}+){3}+(?::[0-9]{1,5}+)?|(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+)(?![0-9A-Za-z])"),
    ("card", rf"(?<![0-9])[0-9](?:{_BETWEEN}?[0-9]){{11,18}}+(?![0-9])"),
    # Four groups of four, also in the midst of a longer run of numbers: cards side by side.
    ("card", rf"(?<![0-9])[0-9]{{4}}+(?:{_BETWEEN}?[0-9]{{4}}+){{3}}(?![0-9])"),
    ("phone", r"(?<![0-9+(A-Za-z])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[\x20./\r\n-]{1,2}+\(?[0-9]{2,5}+\)?){1,5}+(?![0-9A-Za-z])"),
    # A whole country code, area and line, however long the run of numbers after it.
    ("phone", r"(?<![0-9+(A-Za-z])(?:\+|00)[1-9][0-9]{0,2}+[\x20./-]?\([0-9]{2,5}\)[\x20./-]?[0-9]{3}[\x20./-]?[0-9]{4}(?![0-9])"),
)
LOOSE_NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": "[.:]", "card": "[0-9]", "phone": "[0-9]"}

#: Place of the checksum among the features.
CHECKSUM = 8

# Words of a context that hint at a kind.
HINTS = (r"(?i)tel|phone|call|mobil|fax", r"(?i)card|visa|credit|kredit|konto|account", r"(?i)mail|contact|kontakt|write to", r"(?i)\bip\b|host|server|addr")


def located(text: Column, pattern: str, possible: Column) -> Column:
    """Matches of a pattern as (start, stop, value, before, after), in order; none where they are not ``possible``.

    The text between matches gives their places, and the context on either side.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.element_at(state["gaps"], i))
        value = F.element_at(state["found"], i)
        stop = start + F.length(value)
        before, after = F.element_at(state["gaps"], i), F.element_at(state["gaps"], i + 1)
        one = F.struct(start.alias("start"), stop.alias("stop"), value.alias("value"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(1)).alias("after"))
        return F.struct(stop.alias("at"), state["found"].alias("found"), state["gaps"].alias("gaps"), F.concat(state["out"], F.array(one)).alias("out"))

    none = F.array().cast("array<struct<start:int,stop:int,value:string,before:string,after:string>>")
    first = F.struct(F.lit(0).alias("at"), found.alias("found"), gaps.alias("gaps"), none.alias("out"))
    walked = F.aggregate(F.sequence(F.lit(1), F.size(found)), first, step)["out"]
    return F.when(possible & F.regexp_like(text, F.lit(pattern)), walked).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is one."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans as (start, rank of the kind, stop), sorted."""

    def of(rank: int, kind: str) -> Column:
        possible = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        good = F.filter(located(text, BASE[kind], possible), lambda m: passes(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["stop"].alias("stop")))

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def described(kind: str, m: Column) -> Column:
    """Format and context features of a candidate."""
    value, before, after = m["value"], m["before"], m["after"]
    number = digits(value)
    parts = F.filter(F.split(value, "[^0-9]+"), lambda p: p != "")
    glued = r"[A-Za-z0-9]"
    return F.array(
        F.lit(float(KINDS.index(kind))), F.length(value).cast("double"), F.length(number).cast("double"), F.size(parts).cast("double"),
        F.length(F.regexp_replace(value, r"[^\x20]", "")).cast("double"), F.length(F.regexp_replace(value, r"[^A-Za-z]", "")).cast("double"),
        flag(F.startswith(value, F.lit("+"))), flag(F.contains(value, F.lit("@"))), flag(F.call_function("luhn_check", F.when(number == "", "1").otherwise(number))),
        F.coalesce(F.array_max(F.transform(parts, lambda p: F.right(p, F.lit(6)).try_cast("double"))), F.lit(0.0)),
        F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).cast("double"),
        flag(F.regexp_like(F.right(before, F.lit(1)), F.lit(glued))), flag(F.regexp_like(after, F.lit(glued))),
        *[flag(F.regexp_like(before, F.lit(h))) for h in HINTS])


def candidates(text: Column) -> Column:
    """All proposed spans as (start, rank, stop, f)."""

    def of(kind: str, pattern: str) -> Column:
        found = located(text, pattern, F.regexp_like(text, F.lit(LOOSE_NEEDS[kind])))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["stop"].alias("stop"), described(kind, m).alias("f")))

    return F.array_distinct(F.concat(*(of(kind, pattern) for kind, pattern in GENERATORS)))


def untouched(c: Column, base: Column) -> Column:
    """Whether no base span of its kind overlaps a candidate, so that it would add something."""
    return ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]) & (b["rank"] == c["rank"]))


def rewritten(kind: Column, value: Column) -> Column:
    """The ways to write a base span of a kind that its pattern may miss, as (text, what one value is long)."""
    n = F.length(value)
    same = lambda text: F.struct(text.alias("text"), F.length(text).alias("size"))
    twice = lambda between: F.struct(F.concat(value, F.lit(between), value).alias("text"), n.alias("size"))
    grouped = F.regexp_replace(digits(value), r"([0-9]{4})(?=[0-9])", "$1#")
    at = lambda a, dot: same(F.replace(F.replace(value, F.lit("@"), F.lit(a)), F.lit("."), F.lit(dot)))
    ways = [
        F.array(at("(at)", "."), at(" [at] ", "."), at("(at)", "(dot)"), at(" @ ", "."), at("@", " [dot] ")),
        F.array(same(F.replace(value, F.lit("."), F.lit("[.]"))), same(F.replace(value, F.lit("."), F.lit(" . ")))),
        F.array(*[same(F.replace(grouped, F.lit("#"), F.lit(x))) for x in (".", "/", "_", "\n")], twice(" "), twice("-")),
        F.array(same(F.regexp_replace(value, r"^\+", "00")), same(F.regexp_replace(F.regexp_replace(value, r"^\+", "00"), r"[\x20()-]+", ".")),
                same(F.regexp_replace(value, r"[\x20()-]+", "/")), same(F.regexp_replace(value, r"^\+", "")), twice(" ")),
    ]
    return F.element_at(F.array(*ways), kind + 1)


@dataclass
class Trees:
    """Fitted trees as plain nodes, their weights, and the threshold of each kind (a kind without one adds nothing)."""

    roots: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def chance(self, f: Column) -> Column:
        """Probability of a candidate with features ``f``."""
        margin = sum((tree_value(r, f) * F.lit(float(w)) for r, w in zip(self.roots, self.weights, strict=True)), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def accepted(self, c: Column) -> Column:
        """Whether a candidate reaches its kind's threshold."""
        least = F.coalesce(*[F.when(c["rank"] == rank, F.lit(t)) for rank, t in sorted(self.thresholds.items())], F.lit(2.0))
        return self.chance(c["f"]) >= least


def tree_value(node: tuple | float, f: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(F.get(f, F.lit(feature)) <= F.lit(threshold), tree_value(left, f)).otherwise(tree_value(right, f))


def plain_node(node) -> tuple | float:
    """A node of a fitted tree as (feature, threshold, left, right), or a leaf's value."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return int(node.split().featureIndex()), float(node.split().threshold()), plain_node(node.leftChild()), plain_node(node.rightChild())


def learned_from(texts: DataFrame) -> DataFrame:
    """rank, f, label, weight, calibrates of the candidates that no base span touches: of rewritten spans (1) and of the texts as they are (0).

    ``texts`` has doc_id and a text that is not null; of rows alike in both, one teaches.  All ways to rewrite a span weigh as much
    as one candidate together, and rows alike in all but the weight are one row with their sum.
    """
    third = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).alias("calibrates")
    based = texts.select("doc_id", F.xxhash64("text").alias("h"), "text", third, base_spans(F.col("text")).alias("base"))
    open_case = lambda c: (c["rank"] == KINDS.index("card")) & (F.get(c["f"], F.lit(CHECKSUM)) == 1.0)
    fresh = F.filter(candidates(F.col("text")), lambda c: untouched(c, F.col("base")) & ~open_case(c))
    plain = based.select("doc_id", "h", "calibrates", F.lit(0).alias("at"), F.lit(-1).alias("way"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("label"), F.explode(fresh).alias("c"))
    spans = based.select("doc_id", "h", "text", "calibrates", F.explode("base").alias("b"))
    ways = lambda value: rewritten(F.col("b.rank"), value)
    around = lambda start, size: F.substring(F.col("text"), start, size)
    before = around(F.greatest(F.col("b.start") - F.lit(2 * CONTEXT), F.lit(0)) + 1, F.least(F.col("b.start"), F.lit(2 * CONTEXT)))
    value = around(F.col("b.start") + 1, F.col("b.stop") - F.col("b.start"))
    snippets = spans.select("doc_id", "h", "calibrates", F.col("b.start").alias("at"), F.col("b.rank").alias("rank"), before.alias("before"), around(F.col("b.stop") + 1, F.lit(CONTEXT)).alias("after"),
                            (F.lit(1.0) / F.size(ways(value))).alias("weight"), F.posexplode(ways(value)).alias("way", "w"))
    shown = snippets.select("doc_id", "h", "calibrates", "at", "way", "rank", "weight", F.length("before").alias("from"), (F.length("before") + F.length("w.text")).alias("to"), "w.size", F.concat("before", "w.text", "after").alias("text"))
    masked = shown.select("*", base_spans(F.col("text")).alias("base"))
    # On it: within the rewritten text, and no less than most of one value.
    mine = F.filter(candidates(F.col("text")), lambda c: (c["rank"] == F.col("rank")) & (c["start"] >= F.col("from")) & (c["stop"] <= F.col("to")) & ((c["stop"] - c["start"]) * 10 >= F.col("size") * 9) & untouched(c, F.col("base")))
    hidden = masked.select("doc_id", "h", "calibrates", "at", "way", "weight", F.lit(1.0).alias("label"), F.explode(mine).alias("c"))
    # A candidate has one place in its document, so equal places come from equal rows; no texts are moved for that.
    each = plain.union(hidden).distinct()
    counted = each.groupBy("c.rank", "c.f", "label", "weight", "calibrates").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("rank", "f", "label", (F.col("weight") * F.col("n")).alias("weight"), "calibrates")


def fit(docs: DataFrame) -> Trees:
    """Trees and thresholds from the candidates of all documents; those of a third of them calibrate."""
    rows = learned_from(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).persist()
    try:
        classes = {r["label"] for r in rows.filter("NOT calibrates").select("label").distinct().collect()}
        if len(classes) < 2:
            return Trees()
        model = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=9).fit(
            rows.filter("NOT calibrates").select(array_to_vector("f").alias("v"), "label", "weight"))
        trees = Trees([plain_node(t._java_obj.rootNode()) for t in model.trees], [float(w) for w in model.treeWeights])
        scored = rows.filter("calibrates").select("rank", (F.floor(trees.chance(F.col("f")) * 1000) / 1000).alias("score"), "label", "weight")
        steps = scored.groupBy("rank", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all"))  # at most 1,001 rows a kind
        above = Window.partitionBy("rank").orderBy(F.desc("score"))
        fine = steps.select("rank", "score", (F.sum("good").over(above) / F.sum("all").over(above)).alias("precision")).filter(F.col("precision") >= PRECISION)
        trees.thresholds = {r["rank"]: float(r["score"]) for r in fine.groupBy("rank").agg(F.min("score").alias("score")).collect()}
        return trees
    finally:
        rows.unpersist()


def names(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def detect(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with base and all spans, arrays of (start, rank of the kind, stop) in order."""
    based = docs.withColumn("base", base_spans(F.coalesce("text", F.lit(""))))
    if not trees.thresholds:
        return based.withColumn("spans", F.col("base"))
    proposed = based.withColumn("proposed", candidates(F.coalesce("text", F.lit(""))))
    chosen = F.filter("proposed", lambda c: trees.accepted(c) & untouched(c, F.col("base")))
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["stop"].alias("stop")))
    return proposed.withColumn("spans", F.array_sort(F.array_distinct(F.concat(F.col("base"), added)))).drop("proposed")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every document."""
    found = detect(docs.select("doc_id", "text"), fit(docs))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [count(rank) for rank in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(names(F.col("base")), 256).alias("base_sha256"), names(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced in ``text`` by the kind in brackets."""
    found = detect(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text"), trees)
    kinds = F.array(*map(F.lit, KINDS))

    def step(state: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], state["at"])
        piece = F.when(s["start"] >= state["at"], F.concat(F.substring(F.col("text"), state["at"] + 1, begin - state["at"]), F.lit("["), F.element_at(kinds, s["rank"] + 1), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.col("text").isNotNull(), done).alias("text")
    return found.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
