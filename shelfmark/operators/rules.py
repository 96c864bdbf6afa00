"""Weighted keyword rules: the rule table and the classifier.

The rules travel inside the plan as one array literal and each record is scored
where it lies, without a shuffle. Rule tables too large for that are matched by
an equi-join on short text fragments (``category_scores_by_join``).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.base import ColumnLike, col, each, let
from shelfmark.functions.labels import CATEGORIES
from shelfmark.functions.text import match_text

# Stems that add to every category, their bonus, and stems that
# decide a listing with a low score.
CONTEXT_STEMS = ("marketing", "advertis", "promotion", "campaign", "brand")
DOCUMENT_STEMS = ("document", "pdf", "text processing", "convert")
CONTEXT_BONUS = 2.0
FEATURE_BONUS = 1.0
MIN_SCORE = 3.0

# Weighted keywords and feature stems per category, in tie-break
# order. A keyword listed under two weights counts under both.
DEFAULT_RULES = (
    ("Marketing & Advertising", "keyword", 3.0, (
        "ad campaign", "ppc", "advertising", "ad management", "media buying", "display ads", "google ads",
        "facebook ads", "ad optimization",
    )),
    ("Marketing & Advertising", "keyword", 2.0, (
        "campaign management", "digital advertising", "marketing campaign", "ad targeting",
    )),
    ("Marketing & Advertising", "keyword", 1.0, (
        "marketing", "advertising", "ads",
    )),
    ("Marketing & Advertising", "feature", FEATURE_BONUS, (
        "ad", "campaign", "conversion", "target",
    )),
    ("Social Media Marketing", "keyword", 3.0, (
        "social media management", "social scheduling", "social analytics", "social engagement",
        "instagram marketing", "twitter marketing", "linkedin marketing", "tiktok marketing",
    )),
    ("Social Media Marketing", "keyword", 2.0, (
        "social strategy", "social content", "social media", "social platform",
    )),
    ("Social Media Marketing", "keyword", 1.0, (
        "engagement", "followers", "social",
    )),
    ("Social Media Marketing", "feature", FEATURE_BONUS, (
        "social", "post", "share", "engage", "follower",
    )),
    ("Content Marketing", "keyword", 3.0, (
        "content creation", "blog writing", "copywriting", "content strategy", "content planning", "article writing",
        "content generation",
    )),
    ("Content Marketing", "keyword", 2.0, (
        "content optimization", "content calendar", "content distribution", "content analytics",
    )),
    ("Content Marketing", "keyword", 1.0, (
        "content", "writing", "blog",
    )),
    ("Content Marketing", "feature", FEATURE_BONUS, (
        "document", "pdf", "text", "content", "write", "edit",
    )),
    ("Email Marketing", "keyword", 3.0, (
        "email automation", "newsletter", "email campaign", "email sequence", "drip campaign", "email template",
    )),
    ("Email Marketing", "keyword", 2.0, (
        "email analytics", "email optimization", "email deliverability", "subscriber", "autoresponder", "broadcast",
    )),
    ("Email Marketing", "keyword", 1.0, (
        "email", "newsletter", "campaign",
    )),
    ("Email Marketing", "feature", FEATURE_BONUS, (
        "email", "newsletter", "sequence", "broadcast",
    )),
    ("SEO Tools", "keyword", 3.0, (
        "keyword research", "rank tracking", "backlink analysis", "seo optimization", "serp tracking", "site audit",
    )),
    ("SEO Tools", "keyword", 2.0, (
        "technical seo", "on page seo", "off page seo", "keyword tracking", "seo analytics",
    )),
    ("SEO Tools", "keyword", 1.0, (
        "seo", "ranking", "search engine",
    )),
    ("SEO Tools", "feature", FEATURE_BONUS, (
        "search", "keyword", "rank", "traffic", "seo",
    )),
    ("Analytics & Insights", "keyword", 3.0, (
        "marketing analytics", "performance tracking", "conversion tracking", "attribution", "marketing metrics",
        "roi tracking",
    )),
    ("Analytics & Insights", "keyword", 2.0, (
        "data visualization", "reporting", "dashboard", "metrics", "kpi",
    )),
    ("Analytics & Insights", "keyword", 1.0, (
        "analytics", "tracking", "insights",
    )),
    ("Analytics & Insights", "feature", FEATURE_BONUS, (
        "analyze", "track", "measure", "report", "insight",
    )),
    ("Marketing Automation", "keyword", 3.0, (
        "workflow automation", "crm integration", "marketing workflow", "lead nurturing", "automated campaign",
        "trigger",
    )),
    ("Marketing Automation", "keyword", 2.0, (
        "marketing pipeline", "lead scoring", "automation rules", "marketing tasks",
    )),
    ("Marketing Automation", "keyword", 1.0, (
        "automation", "workflow", "integration",
    )),
    ("Marketing Automation", "feature", FEATURE_BONUS, (
        "automate", "workflow", "process", "generate",
    )),
    ("Visual Marketing", "keyword", 3.0, (
        "video generation", "video creation", "video marketing", "social media image", "ad creative",
        "marketing design", "thumbnail generator", "visual content", "video production",
    )),
    ("Visual Marketing", "keyword", 2.0, (
        "banner design", "social graphic", "video editing", "marketing template", "brand visual", "video content",
    )),
    ("Visual Marketing", "keyword", 1.0, (
        "design", "visual", "creative", "video",
    )),
    ("Visual Marketing", "feature", FEATURE_BONUS, (
        "video", "image", "visual", "design", "creative",
    )),
)

# Rules that one pass of the join form sends to every executor.
BROADCAST_RULES = 100_000

_RULE_STRUCT = "struct<cat_order:int,category:string,keyword:string,kind:string,weight:double>"
_GROUP_SCHEMA = f"array<struct<gate:string,rules:array<{_RULE_STRUCT}>>>"


def _clean_keyword(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


@dataclass(frozen=True)
class Rule:
    category: str
    cat_order: int
    keyword: str
    weight: float
    kind: str = "keyword"


@dataclass(frozen=True)
class RuleSet:
    """Rules plus the decisions taken around the best score."""

    rules: tuple[Rule, ...]
    default_category: str
    min_score: float = MIN_SCORE
    context_stems: tuple[str, ...] = ()
    # Category of a low-scoring listing that mentions one of document_stems.
    document_category: str | None = None
    document_stems: tuple[str, ...] = ()
    categories: tuple[tuple[int, str], ...] = field(init=False)

    def __post_init__(self) -> None:
        cleaned = tuple(
            Rule(r.category, r.cat_order, _clean_keyword(r.keyword), float(r.weight), r.kind) for r in self.rules
        )
        object.__setattr__(self, "rules", tuple(r for r in cleaned if r.keyword))
        first: dict[str, int] = {}
        for r in cleaned:
            first[r.category] = min(r.cat_order, first.get(r.category, r.cat_order))
        object.__setattr__(self, "categories", tuple(sorted((order, name) for name, order in first.items())))

    @staticmethod
    def default() -> "RuleSet":
        order = {name: i for i, name in enumerate(CATEGORIES)}
        rules = [Rule(name, order[name], word, weight, kind) for name, kind, weight, words in DEFAULT_RULES for word in words]
        return RuleSet(
            rules=tuple(rules),
            default_category=CATEGORIES[0],
            context_stems=CONTEXT_STEMS,
            document_category="Content Marketing",
            document_stems=DOCUMENT_STEMS,
        )

    @staticmethod
    def from_dataframe(rules: DataFrame, default_category: str, **options):
        """Rule set from a table ``category, cat_order, keyword, weight``.

        The table becomes part of the plan, so this is for tables a person
        would write; the join form is for larger ones.
        """
        rows = rules.select("category", "cat_order", "keyword", "weight").collect()
        ordered = sorted(rows, key=lambda r: (r["cat_order"], -r["weight"], r["keyword"]))
        return RuleSet(
            rules=tuple(Rule(r["category"], r["cat_order"], r["keyword"], r["weight"]) for r in ordered),
            default_category=default_category,
            **options,
        )

    def literal(self) -> Column:
        """The rules as one constant array, grouped by a word they share."""
        groups: dict[str, list[dict]] = {}
        gates = _gates([r.keyword for r in self.rules])
        for r in self.rules:
            row = {"cat_order": r.cat_order, "category": r.category, "keyword": r.keyword, "kind": r.kind,
                   "weight": r.weight}
            groups.setdefault(gates[r.keyword], []).append(row)
        rows = [{"gate": gate, "rules": rules} for gate, rules in groups.items()]
        return F.from_json(F.lit(json.dumps(rows)), _GROUP_SCHEMA)


def _gates(keywords: list[str]) -> dict[str, str]:
    """For each keyword a text it contains, shared by as many as possible."""
    uses = Counter(word for keyword in set(keywords) for word in set(keyword.split()))
    gate = {k: max(k.split(), key=lambda word: (uses[word], len(word))) for k in set(keywords)}
    # A gate that contains another one is served by the shorter. Very short
    # texts occur almost everywhere, so they serve only themselves.
    short = sorted({g for g in gate.values() if len(g) > 2}, key=len)
    root = {g: next((s for s in short if s in g), g) for g in set(gate.values())}
    return {k: root[g] for k, g in gate.items()}


def _any_stem(text: Column, stems: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for stem in stems:
        found = found | F.contains(text, F.lit(stem))
    return found


def _texts(name: ColumnLike, description: ColumnLike) -> Column:
    """Cleaned name and description, and both together between spaces.

    Keywords neither start nor end with a space, so looking for one in
    ``padded`` is looking for it in the text.
    """
    clean = F.struct(
        match_text(F.coalesce(col(name), F.lit(""))).alias("name"),
        match_text(F.coalesce(col(description), F.lit(""))).alias("description"),
    )
    return let(
        clean,
        lambda t: F.struct(
            t["name"].alias("name"),
            t["description"].alias("description"),
            F.concat(F.lit(" "), t["name"], F.lit(" "), t["description"], F.lit(" ")).alias("padded"),
        ),
    )


def _hit_score(text: Column, keyword: Column, kind: Column, weight: Column) -> Column:
    """Exact phrase counts double, in the name 1.5 times, elsewhere once."""
    exact = F.contains(text["padded"], F.concat(F.lit(" "), keyword, F.lit(" ")))
    return (
        F.when(kind != "keyword", weight)
        .when(exact, weight * 2.0)
        .when(F.contains(text["name"], keyword), weight * 1.5)
        .when(F.contains(text["description"], keyword), weight)
        .otherwise(0.0)
    )


def _hits(text: Column, rules: RuleSet) -> Column:
    # One scan per gate sorts out the many rules that do not occur at all.
    groups = F.filter(rules.literal(), lambda g: F.contains(text["padded"], g["gate"]))
    present = F.flatten(F.transform(
        groups, lambda g: F.filter(g["rules"], lambda r: F.contains(text["padded"], r["keyword"]))
    ))
    scored = F.transform(
        present,
        lambda r: F.struct(
            r["cat_order"].alias("cat_order"), r["category"].alias("category"), r["keyword"].alias("keyword"),
            r["kind"].alias("kind"), r["weight"].alias("weight"),
            _hit_score(text, r["keyword"], r["kind"], r["weight"]).alias("score"),
        ),
    )
    return F.filter(scored, lambda h: h["score"] > 0)


def _context_hits(text: Column, rules: RuleSet) -> Column:
    if not rules.context_stems:
        return F.array().cast("array<string>")
    stems = F.array(*[F.lit(s) for s in rules.context_stems])
    return F.filter(stems, lambda s: F.contains(text["padded"], s))


def _scores(hits: Column, context: Column, rules: RuleSet) -> Column:
    categories = [{"cat_order": order, "category": category} for order, category in rules.categories]
    known = F.from_json(F.lit(json.dumps(categories)), "array<struct<cat_order:int,category:string>>")

    def total(category: Column) -> Column:
        return F.aggregate(
            hits, F.lit(0.0), lambda sum_, h: sum_ + F.when(h["category"] == category, h["score"]).otherwise(0.0)
        )

    base = F.size(context) * CONTEXT_BONUS
    return F.transform(
        known,
        lambda c: F.struct(
            (base + total(c["category"])).alias("score"),
            (-c["cat_order"]).alias("rank"),
            c["category"].alias("category"),
        ),
    )


def verdict(name: ColumnLike, description: ColumnLike, rules: RuleSet) -> Column:
    """Struct ``category, score, scores, hits, context`` for one record."""

    def decide(found: Column) -> Column:
        return let(_scores(found["hits"], found["context"], rules), lambda scores: conclude(found, scores))

    def conclude(found: Column, scores: Column) -> Column:
        best = F.array_max(scores)
        category = F.when(best["score"] >= rules.min_score, best["category"])
        if rules.document_category is not None:
            category = category.when((best["score"] > 0) & found["document"], rules.document_category)
        return F.struct(
            category.otherwise(rules.default_category).alias("category"),
            best["score"].alias("score"),
            scores.alias("scores"),
            found["hits"].alias("hits"),
            found["context"].alias("context"),
        )

    def search(text: Column) -> Column:
        found = F.struct(
            _hits(text, rules).alias("hits"),
            _context_hits(text, rules).alias("context"),
            _any_stem(text["padded"], rules.document_stems).alias("document"),
        )
        return let(found, decide)

    return let(_texts(name, description), search)


def category_of(name: ColumnLike, description: ColumnLike, rules: RuleSet | None = None) -> Column:
    """Category of a record under the rules."""
    return verdict(name, description, rules or RuleSet.default())["category"]


def category_scores(df: DataFrame, key: str, name: ColumnLike, description: ColumnLike, rules: RuleSet) -> DataFrame:
    """One row per record and category with a score above zero."""
    scored = df.select(key, verdict(name, description, rules)["scores"].alias("scores"))
    return (
        scored.select(key, each(F.col("scores")).alias("s"))
        .select(key, F.col("s.category").alias("category"), F.col("s.score").alias("score"))
        .filter("score > 0")
    )


def explain_matches(df: DataFrame, key: str, name: ColumnLike, description: ColumnLike, rules: RuleSet) -> DataFrame:
    """One row per record and rule that scored, with the points it gave."""
    scored = df.select(key, verdict(name, description, rules)["hits"].alias("hits"))
    return scored.select(key, each(F.col("hits")).alias("h")).filter("h IS NOT NULL").select(
        key, "h.category", "h.keyword", "h.kind", "h.weight", "h.score"
    )


# Characters of cleaned text, and where the numbers of fragments of one, two and three of them begin.
_LETTERS = " abcdefghijklmnopqrstuvwxyz0123456789"
_STARTS = (0, len(_LETTERS), len(_LETTERS) + len(_LETTERS) ** 2)
_FRAGMENTS = sum(len(_LETTERS) ** size for size in (1, 2, 3))


def _fragment_numbers(texts: pa.Array) -> pa.Array:
    """For each cleaned text the numbers of the fragments of one to three characters it holds, each once."""
    codes = np.zeros(256, np.int32)
    codes[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(len(_LETTERS))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    letters = codes[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]] if data else np.zeros(0, np.int32)
    found, ends = [], [0]
    for start, end in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True):
        text, held = letters[start:end], np.zeros(_FRAGMENTS, bool)
        number = text
        for size, first in enumerate(_STARTS):
            if size:
                number = number[:-1] * len(_LETTERS) + text[size:]
            held[first + number] = True
        found.append(np.flatnonzero(held))
        ends.append(ends[-1] + len(found[-1]))
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int32()))


def _fragments(text: Column) -> Column:
    """Numbers of a cleaned text's fragments, worked out a batch at a time."""
    return F.arrow_udf(_fragment_numbers, "array<int>")(text)


def _rows(df: DataFrame, key: str, name: ColumnLike, description: ColumnLike) -> DataFrame:
    """``key``, its cleaned texts, and ``_row``: equal for rows that repeat in full, else apart."""
    return df.select(key, F.xxhash64(key, col(name), col(description)).alias("_row"), _texts(name, description).alias("text"))


def _scores_by_join(records: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """``_row, key, category, cat_order, score`` for every category with a score, shuffled once, by ``_row``.

    A keyword can only occur in a text that holds all its fragments of three
    characters (or all of it, if shorter); the one that fewest keywords have is
    looked up. Rules go to the texts in parts of a bounded size, one pass over
    the texts each, and are tested there, so no text is moved. The rules are
    counted first; nothing else runs before the result is asked for.
    """
    parts = max(1, -(-rules.count() // BROADCAST_RULES))
    if parts == 1:
        rules = rules.coalesce(1)  # few enough for one task, which then needs no shuffle for its groupings
    firsts = rules.groupBy("category").agg(F.min("cat_order").alias("cat_order"))
    cleaned = (
        rules.select("category", match_text("keyword").alias("keyword"), F.col("weight").cast("double").alias("weight"))
        .filter("keyword <> ''").groupBy("category", "keyword").agg(F.sum("weight").alias("weight"))
        .join(firsts, "category")
    )
    # The fragments of the keyword's own size, or of three characters.
    longest = F.array(*[F.lit(start) for start in _STARTS])[F.least(F.length("keyword"), F.lit(3)) - 1]
    held = cleaned.withColumn("fragment", F.explode(_fragments(F.col("keyword")))).filter(F.col("fragment") >= longest)
    uses = held.groupBy("fragment").agg(F.count(F.lit(1)).alias("uses"))
    rarest = held.join(uses, "fragment").groupBy("category", "keyword", "weight", "cat_order").agg(
        F.min_by("fragment", F.struct("uses", "fragment")).alias("fragment"))
    pieces = records.select(key, "_row", "text", each(_fragments(F.col("text.padded"))).alias("fragment"))
    hits = None
    for part in range(parts):
        some = rarest.filter(F.pmod(F.xxhash64("category", "keyword"), F.lit(parts)) == part)
        score = _hit_score(F.col("text"), F.col("keyword"), F.lit("keyword"), F.col("weight"))
        met = pieces.join(F.broadcast(some), "fragment").withColumn("score", score).filter("score > 0")
        met = met.select("_row", key, "category", "cat_order", "keyword", "score")
        hits = met if hits is None else hits.union(met)
    return (
        # Rows that repeat count once; one exchange serves both groupings and what follows.
        hits.repartition("_row").groupBy("_row", key, "category", "cat_order", "keyword").agg(F.max("score").alias("score"))
        .groupBy("_row", key, "category", "cat_order").agg(F.sum("score").alias("score"))
    )


def category_scores_by_join(
    df: DataFrame, key: str, name: ColumnLike, description: ColumnLike, rules: DataFrame
) -> DataFrame:
    """``category_scores`` for a rule table of any size, without context stems."""
    records = _rows(df, key, name, description)
    scores = _scores_by_join(records, key, rules).drop(key)
    return records.select(key, "_row").join(scores, "_row").select(key, "category", "score")


def best_by_join(df: DataFrame, key: str, name: ColumnLike, description: ColumnLike, rules: DataFrame,
                 default_category: str, min_score: float = MIN_SCORE) -> DataFrame:
    """``key, category`` under a rule table of any size."""
    records = _rows(df, key, name, description)
    best = (
        _scores_by_join(records, key, rules).groupBy("_row")
        .agg(F.max(F.struct("score", (-F.col("cat_order")).alias("rank"), "category")).alias("best"))
        .filter(F.col("best.score") >= min_score)
        .select("_row", F.col("best.category").alias("category"))
    )
    return records.select(key, "_row").join(best, "_row", "left").select(
        key, F.coalesce("category", F.lit(default_category)).alias("category")
    )


def classify(df: DataFrame, key: str, name: ColumnLike, description: ColumnLike, rules: DataFrame,
             default_category: str, min_score: float = MIN_SCORE, form: str = "fold") -> DataFrame:
    """``key, category`` under a user's rule table.

    Both forms give the same rows. ``fold`` puts the rules into the plan and
    scores each record in place; ``join`` looks them up, for tables of
    thousands of rules and more.
    """
    if form == "join":
        return best_by_join(df, key, name, description, rules, default_category, min_score)
    if form != "fold":
        raise ValueError(f"unknown form: {form}")
    inline = RuleSet.from_dataframe(rules, default_category, min_score=min_score)
    return df.select(key, category_of(name, description, inline).alias("category"))
