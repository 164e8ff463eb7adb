"""Which name of a catalogue a wanted city goes by: override, equal key, pattern, near key, best guess.

Equal keys are an equi-join. Only names that none has reach the pattern and near-key steps. Both are blocked: a
pattern's candidates must share the pattern's first word's first letters with some word of the name, a near key's its
length range and one of its letter pairs' positions; conditions that a match of the required similarity meets anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import like_pattern, name_key, similarity

# How near a key must be, and how far ahead a best guess.
NEAR_KEY, CANDIDATE_KEY, MARGIN = 0.88, 0.80, 0.08


def distinct_names(rows: DataFrame, column: str) -> DataFrame:
    """The distinct names of a catalogue that are not NULL."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct()


def names_like(rows: DataFrame, column: str, pattern: str, limit: int = 50) -> DataFrame:
    """At most ``limit`` distinct names like a pattern, in order, whatever the case."""
    return rows.where(F.lower(F.col(column)).like(pattern.lower())).select(column).distinct().orderBy(column).limit(limit)


def _pieces(key: Column, parts: int) -> Column:
    """Substrings of a key at fixed places: two keys that are near share a run of letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - (parts - 1), F.lit(1))), lambda i: F.substr(key, i, F.lit(parts))))


def near_keys(wanted: DataFrame, catalogue: DataFrame, least: float = NEAR_KEY, run: int = 2) -> DataFrame:
    """(key, catalogue_key, score): for each wanted key its most similar catalogue key, if that is at least ``least``.

    A similarity of r means that both lengths are within r / (2 - r) of each other, which bounds the join, and that
    keys of more than one letter share a run of ``run`` letters or are short. Ties go to the first key."""
    a = wanted.select("key").distinct().withColumn("piece", F.explode(_pieces(F.col("key"), run)))
    b = catalogue.select(F.col("key").alias("catalogue_key")).distinct().withColumn("piece", F.explode(_pieces(F.col("catalogue_key"), run)))
    size, other = F.length("key"), F.length("catalogue_key")
    bound = least / (2 - least)
    pairs = a.join(b, "piece").where((other >= size * bound) & (size >= other * bound)).select("key", "catalogue_key").distinct()
    scored = pairs.withColumn("score", similarity("key", "catalogue_key")).where(F.col("score") >= least)
    best = F.max_by(F.struct("catalogue_key", "score"), F.struct("score", F.transform(F.split(F.col("catalogue_key"), ""), lambda c: -F.ascii(c))))
    return scored.groupBy("key").agg(best.alias("b")).select("key", "b.catalogue_key", "b.score")


def match_plan(wanted: DataFrame, catalogue: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``wanted`` (row_index, city, country) with the chosen name of ``catalogue`` (name), how it was found, and its
    margin: OVERRIDE, NAME_KEY_UNIQUE, LIKE_UNIQUE, FUZZY_UNIQUE, NAME_KEY_MULTI_BEST_GUESS, or the reasons
    EMPTY_CITY_KEY and NO_GPKG_MATCH; ``is_ambiguous`` where the second guess is within 0.08."""
    rows = wanted.withColumns({"key": name_key(F.col("city")), "country_key": name_key(F.coalesce("country", F.lit("")))})
    names = distinct_names(catalogue, "name").withColumn("name_key", name_key(F.col("name"))).where("name_key <> ''")
    if overrides is None:
        rows = rows.withColumn("override", F.lit(None).cast("string"))
    else:
        o = overrides.select(name_key(F.col("city")).alias("key"), name_key(F.col("country")).alias("country_key"), F.col("name").alias("override"))
        rows = rows.join(o, ["key", "country_key"], "left")
    open_ = rows.where("override is null and key <> ''")
    by_key = open_.join(names, F.col("key") == F.col("name_key")).select("row_index", "name", F.lit("key").alias("way"))
    left = open_.join(by_key.select("row_index").distinct(), "row_index", "left_anti")
    # A pattern holds the words of a city in order: each candidate holds the first three letters of the first word.
    pattern = left.withColumns({"pattern": like_pattern(F.col("city")), "lead": F.split(F.lower(F.trim("city")), r"[\s\-_/]+")[0]}).where("pattern is not null and lead <> ''")
    pattern = pattern.withColumn("gram", F.substring("lead", 1, 3)).select("row_index", "key", "pattern", "gram")
    low = F.lower("name")
    runs = F.flatten(F.array(*[_pieces(low, k) for k in (1, 2, 3)]))
    grams = names.withColumn("gram", F.explode(F.array_distinct(runs)))
    liked = pattern.join(grams, "gram").where(F.like(F.lower("name"), F.col("pattern"))).select("row_index", "name", (F.col("key") == F.col("name_key")).alias("same")).distinct()
    any_same = Window.partitionBy("row_index")
    by_like = liked.withColumn("some_same", F.max("same").over(any_same)).where("same or not some_same").select("row_index", "name", F.lit("like").alias("way"))
    left = left.join(by_like.select("row_index").distinct(), "row_index", "left_anti")
    near = near_keys(left, names.select(F.col("name_key").alias("key")))
    by_near = left.join(near, "key").join(names, F.col("catalogue_key") == F.col("name_key")).select("row_index", "name", F.lit("near").alias("way"))
    found = by_key.unionByName(by_like).unionByName(by_near).join(rows.select("row_index", "city"), "row_index")
    flat = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", " ")
    guesses = Window.partitionBy("row_index").orderBy(F.desc("score"), "name")
    scored = found.withColumn("score", similarity(flat("city"), flat("name")))
    best = scored.withColumns({"place": F.row_number().over(guesses), "second": F.lead("score").over(guesses), "n": F.count("*").over(any_same)}).where("place = 1")
    method = (
        F.when(F.col("n") > 1, "NAME_KEY_MULTI_BEST_GUESS").when(F.col("way") == "key", "NAME_KEY_UNIQUE")
        .when(F.col("way") == "like", "LIKE_UNIQUE").otherwise("FUZZY_UNIQUE")
    )
    best = best.select("row_index", F.col("name").alias("chosen"), method.alias("method"), F.when(F.col("n") > 1, F.col("score") - F.col("second")).alias("margin"))
    out = rows.join(best, "row_index", "left")
    return out.select(
        "row_index", "city", "country", "key", F.coalesce("override", "chosen").alias("name"),
        F.when(F.col("key") == "", "EMPTY_CITY_KEY").when(F.col("override").isNotNull(), "OVERRIDE").otherwise(F.coalesce("method", F.lit("NO_GPKG_MATCH"))).alias("match_method"),
        "margin", F.coalesce(F.col("margin") < MARGIN, F.lit(False)).alias("is_ambiguous"),
    )


def lookup_names(rows: DataFrame, conventions: DataFrame, least: float = 0.85) -> DataFrame:
    """``rows`` (key) with the convention's name: by equal key, else by the most similar one of at least ``least``.
    Of several conventions with one key the last by ``place`` wins."""
    one = conventions.groupBy("key").agg(F.max_by("name", "place").alias("exact"))
    out = rows.join(one, "key", "left")
    near = near_keys(out.where("exact is null").select("key"), one.select("key"), least)
    fuzzy = near.join(one.select(F.col("key").alias("catalogue_key"), F.col("exact").alias("fuzzy")), "catalogue_key").select("key", "fuzzy", "score")
    return out.join(fuzzy, "key", "left").withColumn("convention", F.coalesce("exact", "fuzzy")).drop("exact", "fuzzy")
