"""Selectors as data, answered by expressions on the elements of a page."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.base import ColumnLike, col, first, let, strip


@dataclass(frozen=True)
class Sel:
    """One selector; all stated conditions must hold.

    ``part_class`` tests for a piece of a class name, ``op`` is one of ``has``,
    ``contains``, ``prefix``, ``equals`` and applies to ``attr``. ``text``
    tests the trimmed text, ``text_part`` a piece of it. ``inside`` is an
    ancestor, ``child_of`` the parent, ``after`` the element just before,
    ``later`` a sibling anywhere before. ``holds`` is a descendant.
    """

    tags: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    part_class: str | None = None
    attr: str | None = None
    op: str = "has"
    value: str = ""
    text: str | None = None
    text_part: str | None = None
    inside: "Sel | None" = None
    child_of: "Sel | None" = None
    after: "Sel | None" = None
    later: "Sel | None" = None
    holds: "Sel | None" = None


def _ink(text: str) -> int:
    return sum(map(len, text.split()))


class Page:
    """Expressions over one parsed page: its ``elements`` and ``runs``."""

    def __init__(self, elements: ColumnLike = "elements", runs: ColumnLike = "runs") -> None:
        self._elements, self._runs = elements, runs

    @property
    def elements(self) -> Column:
        return col(self._elements)

    @property
    def runs(self) -> Column:
        return col(self._runs)

    # -- text -------------------------------------------------------------
    def _slice(self, e: Column) -> Column:
        # By position: slice() would copy all pieces of the page first.
        at = F.filter(F.sequence(e["run_from"], e["run_to"]), lambda i: i < e["run_to"])
        return F.transform(at, lambda i: F.get(self.runs, i))

    def text(self, e: Column) -> Column:
        """All text inside an element, as it stands."""
        return F.array_join(self._slice(e), "")

    def trimmed(self, e: Column) -> Column:
        return strip(self.text(e))

    def joined(self, e: Column) -> Column:
        """Text pieces trimmed one by one, then joined without a space."""
        return F.array_join(F.filter(F.transform(self._slice(e), strip), lambda t: t != ""), "")

    # -- matching ---------------------------------------------------------
    def at(self, pos: Column) -> Column:
        return F.get(self.elements, pos)

    def _within(self, scope: Column | None) -> Column:
        """Elements below ``scope``, which follow it directly, or all."""
        if scope is None:
            return self.elements
        below = F.filter(F.sequence(scope["pos"], scope["last_pos"]), lambda i: i > scope["pos"])
        return F.transform(below, self.at)

    def select(self, sel: Sel, scope: Column | None = None) -> Column:
        """Matching elements in page order, below ``scope`` when given."""
        own = self._following(sel, scope) if sel.after is not None else F.filter(
            self._within(scope), lambda e: self._own(e, sel)
        )
        if sel.later is not None:
            leaders = F.filter(self._within(scope), lambda s: self._own(s, sel.later))
            own = let(F.transform(leaders, lambda s: F.struct(s["parent_pos"].alias("of"), s["pos"].alias("pos"))), lambda led: F.filter(
                own, lambda e: F.exists(led, lambda s: (s["of"] == e["parent_pos"]) & (s["pos"] < e["pos"]))))
        if sel.holds is not None:
            own = let(self.select(sel.holds), lambda held: F.filter(
                own, lambda e: F.exists(held, lambda d: self.below(d, e))
            ))
        if sel.inside is not None:
            own = let(self.select(sel.inside), lambda outer: F.filter(
                own, lambda e: F.exists(outer, lambda a: self.below(e, a))
            ))
        return own

    def select_any(self, sels: tuple[Sel, ...], scope: Column | None = None) -> Column:
        """Elements matching any selector, in page order."""
        if len(sels) == 1:
            return self.select(sels[0], scope)
        if all(s.after is None and s.later is None and s.holds is None and s.inside is None for s in sels):
            return F.filter(self._within(scope), lambda e: reduce(or_, [
                F.coalesce(self._own(e, s), F.lit(False)) for s in sels
            ]))
        found = F.array_union(
            *[F.transform(self.select(s, scope), lambda e: e["pos"]) for s in sels[:2]]
        )
        for s in sels[2:]:
            found = F.array_union(found, F.transform(self.select(s, scope), lambda e: e["pos"]))
        return F.transform(F.sort_array(found), self.at)

    @staticmethod
    def below(e: Column, a: Column) -> Column:
        return (e["pos"] > a["pos"]) & (e["pos"] <= a["last_pos"])

    def _own(self, e: Column, sel: Sel) -> Column:
        tests = []
        if sel.tags:
            tests.append(e["tag"] == sel.tags[0] if len(sel.tags) == 1 else e["tag"].isin(*sel.tags))
        tests += [F.array_contains(e["classes"], name) for name in sel.classes]
        if sel.part_class is not None:
            tests.append(F.exists(e["classes"], lambda c: F.contains(c, F.lit(sel.part_class))))
        if sel.attr is not None:
            value = F.try_element_at(e["attrs"], F.lit(sel.attr))
            if sel.op == "has":
                tests.append(value.isNotNull())
            elif sel.op == "contains":
                tests.append(F.contains(value, F.lit(sel.value)))
            elif sel.op == "prefix":
                tests.append(F.startswith(value, F.lit(sel.value)))
            elif sel.op == "equals":
                tests.append(value == sel.value)
            else:
                raise ValueError(f"unknown op {sel.op!r}")
        if sel.text is not None:
            # Counting ink first spares joining the text of every container.
            tests += [e["ink"] == _ink(sel.text), self.trimmed(e) == sel.text]
        if sel.text_part is not None:
            tests += [e["ink"] >= _ink(sel.text_part), F.contains(self.text(e), F.lit(sel.text_part))]
        if sel.child_of is not None:
            tests.append(self._own(self.at(e["parent_pos"]), sel.child_of))
        return reduce(and_, tests) if tests else F.lit(True)

    def _following(self, sel: Sel, scope: Column | None) -> Column:
        """Matches of ``sel`` right after a sibling that matches ``sel.after``.

        The next sibling of an element starts where its subtree ends.
        """

        def leads(s: Column) -> Column:
            follower = self.at(s["last_pos"] + 1)
            together = follower["parent_pos"] == s["parent_pos"]
            return F.when(together & self._own(follower, sel), self._own(s, sel.after))

        leaders = F.filter(self._within(scope), leads)
        return F.transform(F.sort_array(F.transform(leaders, lambda s: s["last_pos"] + 1)), self.at)

    def nearest(self, e: Column, blocks: Column) -> Column:
        """Innermost of ``blocks`` (in page order) around ``e``."""
        return F.try_element_at(F.filter(blocks, lambda a: self.below(e, a)), F.lit(-1))

    # -- values -----------------------------------------------------------
    def first_text(self, *sels: Sel, scope: Column | None = None) -> Column:
        """Trimmed text of the first match, blank or not."""
        return let(first(self.select_any(sels, scope)), self.trimmed)

    def first_filled_text(self, *sels: Sel, scope: Column | None = None) -> Column:
        """Trimmed text of the first match that has any."""
        filled = F.filter(self.select_any(sels, scope), lambda e: e["ink"] > 0)
        return let(first(filled), self.trimmed)

    def texts(self, *sels: Sel, scope: Column | None = None) -> Column:
        """Trimmed non-blank texts of all matches, in page order."""
        filled = F.filter(self.select_any(sels, scope), lambda e: e["ink"] > 0)
        return F.transform(filled, self.trimmed)

    def first_attr(self, name: str, *sels: Sel, scope: Column | None = None) -> Column:
        return F.try_element_at(first(self.select_any(sels, scope))["attrs"], F.lit(name))

    def attr_values(self, name: str, *sels: Sel, scope: Column | None = None) -> Column:
        return F.transform(self.select_any(sels, scope), lambda e: F.try_element_at(e["attrs"], F.lit(name)))

    def text_or(self, primary: tuple[Sel, ...], fallback: tuple[Sel, ...] = (), default: str = "N/A",
                scope: Column | None = None) -> Column:
        """First match of ``primary``; without one the matches of ``fallback``
        joined by a space; blank results give ``default``."""
        main = let(first(self.select_any(primary, scope)), lambda e: F.when(e.isNotNull(), self.joined(e)))
        if fallback:
            other = F.transform(self.select_any(fallback, scope), self.text)
            main = F.coalesce(main, strip(F.array_join(other, " ")))
        return F.coalesce(F.nullif(main, F.lit("")), F.lit(default))


_TABLE_COLUMNS = (
    "field", "priority", "tag", "class_name", "class_part", "attr", "attr_op", "attr_value", "ancestor_class",
    "text", "text_part", "after_tag", "after_text", "later_tag", "later_text", "parent_tag", "parent_class", "held_tag", "held_class",
)


def selectors_from(table: DataFrame) -> dict[str, tuple[Sel, ...]]:
    """A registry like REGISTRY out of a user's table of selectors.

    One row per selector; a column that is NULL or missing states no condition;
    several tags or classes are separated by spaces. ``after_*``, ``later_*``,
    ``parent_*`` and ``held_*`` describe the element just before, a sibling
    anywhere before, the parent, and a descendant. The table is a setting and
    becomes part of the plan.
    """
    present = [c for c in _TABLE_COLUMNS if c in table.columns]
    registry: dict[str, tuple[Sel, ...]] = {}

    def other(r: dict, tag: str, classes: str | None = None, part: str | None = None) -> Sel | None:
        tags, names, text = ((r.get(c) or "") if c else "" for c in (tag, classes, part))
        return Sel(tags=tuple(tags.split()), classes=tuple(names.split()), text_part=text or None) if tags or names or text else None

    for r in sorted((row.asDict() for row in table.select(*present).collect()), key=lambda r: (r["field"], r.get("priority") or 0)):
        outer = r.get("ancestor_class")
        sel = Sel(
            tags=tuple((r.get("tag") or "").split()), classes=tuple((r.get("class_name") or "").split()),
            part_class=r.get("class_part"), attr=r.get("attr"), op=r.get("attr_op") or "has", value=r.get("attr_value") or "",
            text=r.get("text"), text_part=r.get("text_part"), inside=Sel(classes=tuple(outer.split())) if outer else None,
            after=other(r, "after_tag", None, "after_text"), later=other(r, "later_tag", None, "later_text"),
            child_of=other(r, "parent_tag", "parent_class"), holds=other(r, "held_tag", "held_class"),
        )
        registry[r["field"]] = (*registry.get(r["field"], ()), sel)
    return registry


# The selectors of the directory's pages, by field.
REGISTRY: dict[str, tuple[Sel, ...]] = {
    "tool_card": (Sel(tags=("div",), part_class="tool-item"),),
    "name": (
        Sel(classes=("text-base", "font-medium")),
        Sel(classes=("text-lg", "font-medium")),
        Sel(tags=("h1", "h2", "h3", "h4")),
        Sel(tags=("div",), part_class="title"),
    ),
    "description": (
        Sel(classes=("text-sm", "text-gray-500")),
        Sel(classes=("text-base", "text-gray-500")),
        Sel(tags=("p",), part_class="description"),
    ),
    "category": (Sel(classes=("text-xs", "text-gray-400")),),
    "monthly_traffic": (Sel(tags=("span",), inside=Sel(classes=("text-sm",))),),
    "rating": (Sel(classes=("rating-value",)),),
    "image_url": (Sel(tags=("img",), attr="src"),),
    "pricing_link": (Sel(tags=("a",), attr="href", op="contains", value="pricing"),),
    "twitter_link": (Sel(tags=("a",), attr="href", op="contains", value="twitter.com"),),
    "facebook_link": (Sel(tags=("a",), attr="href", op="contains", value="facebook.com"),),
    "linkedin_link": (Sel(tags=("a",), attr="href", op="contains", value="linkedin.com"),),
    "instagram_link": (Sel(tags=("a",), attr="href", op="contains", value="instagram.com"),),
    "features": (Sel(tags=("li",), inside=Sel(classes=("features-list",))),),
    "pricing_model": (Sel(classes=("pricing-model",)),),
    "api_info": (Sel(classes=("api-info",)),),
}
# What is tried when the selectors above find nothing.
FALLBACKS: dict[str, tuple[Sel, ...]] = {
    "name": (Sel(tags=("h2", "h3", "h4")),),
    "description": (Sel(tags=("p",)),),
    "category": (Sel(tags=("a",), attr="href", op="contains", value="/category/"),),
    "monthly_traffic": (Sel(tags=("span",), later=Sel(tags=("span",), text_part="Monthly Visits")),),
    "rating": (Sel(tags=("span",), part_class="group-hover:text-purple-1300"),),
    "image_url": (Sel(tags=("img",), attr="src"),),
    "pricing_link": (Sel(tags=("a",), text_part="Pricing"),),
    "twitter_link": (Sel(tags=("a",), attr="href", op="contains", value="twitter.com"),),
    "linkedin_link": (Sel(tags=("a",), attr="href", op="contains", value="linkedin.com"),),
    "support_email": (Sel(tags=("a",), attr="href", op="prefix", value="mailto:"),),
    "features": (Sel(tags=("li",), child_of=Sel(tags=("ul",), part_class="features")),),
}
