"""Logo candidates and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.urls import absolute_url

# Logo words and the points given.
LOGO_WORDS = ("logo", "brand", "icon")
WORD_POINTS, NAME_POINTS, SHAPE_POINTS, SIZE_POINTS = 5, 8, 3, 2
ENOUGH_POINTS = 5
SMALLEST, LARGEST = 32, 200


def usable_source(src: Column) -> Column:
    return F.coalesce((src != "") & ~F.startswith(src, F.lit("data:image/")), F.lit(False))


def _mentions_logo(src: Column, alt: Column) -> Column:
    found = F.lit(False)
    for word in LOGO_WORDS:
        found = found | F.contains(F.lower(src), F.lit(word)) | F.contains(F.lower(alt), F.lit(word))
    return found


def _squarish(w: Column, h: Column) -> Column:
    return (w / h).between(0.8, 1.2)


def _fits(w: Column, h: Column) -> Column:
    return F.least(w, h).between(SMALLEST, LARGEST)


def _points(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def _named(name: Column, text: Column) -> Column:
    """The name occurs in the text; a blank name occurs nowhere."""
    return F.coalesce((name != "") & F.contains(F.lower(text), F.lower(name)), F.lit(False))


def score_external(name: Column, src: Column, alt: Column, w: Column, h: Column) -> Column:
    """Points of an image on the listing's own site."""
    return (
        _points(_mentions_logo(src, alt), WORD_POINTS)
        + _points(_named(name, alt) | _named(name, src), NAME_POINTS)
        + _points(_squarish(w, h), SHAPE_POINTS)
        + _points(_fits(w, h), SIZE_POINTS)
    )


def score_directory(name: Column, src: Column, alt: Column, w: Column, h: Column, image_host: str) -> Column:
    """Points of an image on the directory's page; tiny images get none."""
    points = (
        _points(_named(name, alt) & F.contains(src, F.lit(image_host)), NAME_POINTS)
        + _points(_mentions_logo(src, alt), WORD_POINTS)
        + _points(_squarish(w, h) & _fits(w, h), SHAPE_POINTS)
    )
    return F.when(F.greatest(w, h) >= SMALLEST, points).otherwise(0)


def candidates(images: DataFrame, key: str, page_url: Column, site_host: str | None = None) -> DataFrame:
    """Scored candidates of ``key, pos, name, src, alt, w, h`` rows.

    Without ``site_host`` the images are taken from the listing's own site;
    with it from the directory, and ``site_host`` is the host of its images.
    """
    w, h = F.greatest("w", F.lit(1.0)), F.greatest("h", F.lit(1.0))
    usable = images.filter(usable_source(F.col("src"))).select(
        key, "pos", "name", absolute_url("src", page_url).alias("src"),
        F.coalesce("alt", F.lit("")).alias("alt"), w.alias("w"), h.alias("h"),
    )
    args = [F.col(c) for c in ("name", "src", "alt", "w", "h")]
    score = score_external(*args) if site_host is None else score_directory(*args, site_host)
    return usable.select(key, "pos", F.col("src").alias("url"), score.alias("score"), "w", "h").filter(
        F.col("score") > ENOUGH_POINTS
    )


def _rank(score: Column, w: Column, h: Column, pos: Column, url: Column) -> Column:
    """Higher is better: points, then squareness, then page order."""
    return F.struct(
        score.alias("score"), (-F.abs(w - h)).alias("shape"), (-pos).alias("order"), url.alias("url")
    )


def best(found: DataFrame, key: str) -> DataFrame:
    """The best candidate of each key, by partial aggregation."""
    rank = _rank(F.col("score"), F.col("w"), F.col("h"), F.col("pos"), F.col("url"))
    return found.groupBy(key).agg(F.max(rank).alias("_best")).select(
        key, F.col("_best.url").alias("logo_url"), F.col("_best.score").alias("logo_score")
    )


def best_in_page(images: Column, name: Column, page_url: Column, image_host: str | None = None) -> Column:
    """Best logo address among an array of ``pos, src, alt, w, h``, row-local."""
    absolute = F.transform(
        F.filter(images, lambda i: usable_source(i["src"])),
        lambda i: F.struct(i["pos"].alias("pos"), absolute_url(i["src"], page_url).alias("src"),
                           i["alt"].alias("alt"), i["w"].alias("w"), i["h"].alias("h")),
    )

    def scored(i: Column) -> Column:
        args = (name, i["src"], i["alt"], i["w"], i["h"])
        score = score_external(*args) if image_host is None else score_directory(*args, image_host)
        return _rank(score, i["w"], i["h"], i["pos"], i["src"])

    good = F.filter(F.transform(absolute, scored), lambda r: r["score"] > ENOUGH_POINTS)
    return F.array_max(good)["url"]


def with_fallback(tools: DataFrame, external: DataFrame, directory: DataFrame, key: str) -> DataFrame:
    """Best external logo of each tool, else the best of the directory: one grouping for all."""
    rank = _rank(F.col("score"), F.col("w"), F.col("h"), F.col("pos"), F.col("url"))
    own = external.select(key, rank.alias("own"))
    shown = directory.select(key, rank.alias("shown"))
    rows = tools.select(key, F.lit(True).alias("asked")).unionByName(own, allowMissingColumns=True).unionByName(
        shown, allowMissingColumns=True)
    best_of = rows.groupBy(key).agg(F.max("own").alias("own"), F.max("shown").alias("shown"), F.max("asked").alias("asked"))
    return best_of.filter("asked").select(key, F.coalesce("own.url", "shown.url").alias("logo_url"))
