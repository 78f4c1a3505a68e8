"""Vehicle reference: building, matching, searching, fuzzy names, vectors, ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vestigo.functions.numbers import rnd
from vestigo.functions.text import matching_blocks_ratio, norm_lower, norm_upper, years_in
from vestigo.session import stash

# Search scores.
INDEX_BASE, REFERENCE_BASE = 1.0, 0.8
NAME_FLOOR = 36.0
RERANK_WEIGHT, RERANK_TOP = 0.5, 5
FALLBACK_SCORE = 0.35
RANKED_TOP = 3
# Most queries and vectors that meet in one task, and the fewest worth a task of their own.
QUERY_BLOCK, VECTOR_SLICE, LEAST_BLOCK = 65_536, 65_536, 2_048
# Blocks that queries are cut into where that leaves them larger than the fewest.
SIDE_BLOCKS = 8
# Queries of a block that are compared at a time.
QUERY_CHUNK = 1_024
# Vectors of a slice that are compared at a time.
VECTOR_CHUNK = 2_048
# Coarse lists of the approximate search: vectors they are fitted on at most, queries that the number of
# lists read is measured with, lists, and the share of neighbours to find on the sample.
FIT_VECTORS, FIT_QUERIES, LISTS, AIMED_RECALL = 20_000, 500, 64, 0.96


def build_reference(rows: DataFrame) -> DataFrame:
    """One entry per make and model with its years, variants, fuels and ids.

    `rows`: row_id, make, model, year, variant, fuel, model_identifier.
    """
    named = rows.where((F.trim("make") != "") & (F.trim("model") != ""))
    listed = lambda c: F.array_sort(F.collect_set(F.nullif(F.trim(c), F.lit(""))))
    return named.groupBy(
        F.upper(F.trim("make")).alias("make"), F.upper(F.trim("model")).alias("model_key")
    ).agg(
        F.min_by(F.trim("model"), "row_id").alias("model"),
        F.array_sort(F.collect_set("year")).alias("years"),
        listed("variant").alias("variants"),
        listed("fuel").alias("fuels"),
        F.array_sort(F.collect_set("model_identifier")).alias("model_identifiers"),
        F.min("row_id").alias("position"),
    )


def reference_totals(reference: DataFrame) -> DataFrame:
    return reference.agg(F.count_distinct("make").alias("total_makes"), F.count(F.lit(1)).alias("total_models"))


def _substrings(c: Column) -> Column:
    """Every distinct run of characters of a text, the empty one included."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c)))
    runs = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(0), F.length(c) - i + 1), lambda n: F.substring(c, i, n)
            ),
        )
    )
    return F.array_distinct(runs)


def containment_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct texts (a of left, b of right) of which one contains the other.

    The longer text is cut into its substrings, which meet the shorter one by equality: only true
    pairs are ever formed. Each side is read twice, so a long derivation is better stored first.
    """
    la, rb = left.select(a).distinct(), right.select(b).distinct()
    in_b = rb.select(b, F.explode(_substrings(F.col(b))).alias(a)).join(la, a)
    in_a = la.select(a, F.explode(_substrings(F.col(a))).alias(b)).join(rb, b)
    return in_b.select(a, b).unionByName(in_a.select(a, b)).distinct()


def match_model(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """Match a table of (make, model) against the reference: exact, partial, or why not.

    `reference`: make, model, years, position (scan order). Each distinct pair is matched once.
    """
    wanted = queries.select(
        "make", "model", norm_lower(F.col("make")).alias("make_norm"), norm_lower(F.col("model")).alias("model_norm")
    ).distinct()
    wanted = stash(wanted, "match-wanted")
    ref = reference.select(
        norm_lower(F.col("make")).alias("make_norm"),
        norm_lower(F.col("model")).alias("name_norm"),
        F.col("model").alias("model_name"),
        "years",
        "position",
    ).where((F.col("make_norm") != "") & (F.col("name_norm") != ""))
    ref = stash(ref, "match-reference")
    usable = wanted.where((F.col("make_norm") != "") & (F.col("model_norm") != "")).select("make_norm", "model_norm").distinct()
    near = usable.join(containment_pairs(usable, ref, "model_norm", "name_norm"), "model_norm").join(
        ref, ["make_norm", "name_norm"]
    )
    exact = F.col("model_norm") == F.col("name_norm")
    found = near.groupBy("make_norm", "model_norm").agg(
        F.min_by(
            F.struct(F.when(exact, "exact").otherwise("partial").alias("kind"), "model_name", "years"),
            F.struct(F.when(exact, 0).otherwise(1), F.col("position")),
        ).alias("m")
    )
    makes = ref.select("make_norm").distinct().withColumn("_known", F.lit(True))
    return (
        wanted.join(found, ["make_norm", "model_norm"], "left")
        .join(makes, "make_norm", "left")
        .select(
            "make",
            "model",
            F.when((F.col("make_norm") == "") | (F.col("model_norm") == ""), "none")
            .when(F.col("m").isNotNull(), F.col("m.kind"))
            .when(F.col("_known").isNull(), "make_not_found")
            .otherwise("model_not_found")
            .alias("match_type"),
            F.col("m").isNotNull().alias("matched"),
            F.coalesce("m.model_name", F.lit("")).alias("model_name"),
            F.col("m.years").alias("years"),
        )
    )


def _reachable(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Query rows joined to the index rows whose make and model agree by containment; blanks agree with all."""
    makes = containment_pairs(queries, index, "q_make", "make_norm")
    models = containment_pairs(queries, index, "q_model", "model_norm")
    return queries.join(makes, "q_make").join(models, "q_model").join(index, ["make_norm", "model_norm"])


def _query_norms(queries: DataFrame) -> DataFrame:
    return queries.select(
        "query_id",
        F.col("year").alias("q_year"),
        norm_lower(F.col("make")).alias("q_make"),
        norm_lower(F.col("model")).alias("q_model"),
        norm_lower(F.col("colour")).alias("q_colour"),
    )


def _index_rows(index: DataFrame) -> DataFrame:
    """The first row of each (make, model, year, colour), with its normal forms."""
    return (
        index.select(
            "row_id",
            "make",
            "model",
            "year",
            "colour",
            norm_lower(F.col("make")).alias("make_norm"),
            norm_lower(F.col("model")).alias("model_norm"),
            norm_lower(F.col("colour")).alias("colour_norm"),
        )
        .groupBy("make_norm", "model_norm", "colour_norm", "year")
        .agg(F.min_by(F.struct("make", "model", "colour", "row_id"), "row_id").alias("r"))
        .select("make_norm", "model_norm", "colour_norm", "year", "r.*")
    )


def _index_score() -> Column:
    gap, colour = F.abs(F.col("year") - F.col("q_year")), F.col("q_colour")
    score = (
        F.lit(INDEX_BASE)
        + F.when((colour != "") & (F.col("colour_norm") == colour), 0.5)
        .when((colour != "") & F.col("colour_norm").contains(colour), 0.2)
        .otherwise(0.0)
        + F.when(gap == 0, 0.4).when(gap <= 2, 0.2).otherwise(0.0)
        + F.when((F.col("q_model") != "") & (F.col("model_norm") == F.col("q_model")), 0.3).otherwise(0.0)
    )
    return rnd(score, 6)


def search_metadata(queries: DataFrame, index: DataFrame) -> DataFrame:
    """All index rows that answer each query, scored by colour, year and exact model.

    Copies of one (make, model, year, colour) are reduced to the first before any join. Where only the
    best rows count, `vehicle_search` reads ranked lists instead.
    """
    unique = stash(_index_rows(index), "search-index")
    return _reachable(stash(_query_norms(queries), "search-queries"), unique).select(
        "query_id",
        "make",
        "model",
        "year",
        "colour",
        _index_score().alias("score"),
        F.lit("index").alias("source"),
        "row_id",
    )


def search_reference(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference models that answer each query; without a year, its first three years."""
    ref = reference.select(
        "make",
        "model",
        "years",
        "position",
        norm_lower(F.col("make")).alias("make_norm"),
        norm_lower(F.col("model")).alias("model_norm"),
    )
    hit = _reachable(_query_norms(queries), ref)
    year = F.col("q_year")
    near = F.exists("years", lambda y: F.abs(y - year) <= 2)
    score = (
        F.lit(REFERENCE_BASE)
        + F.when((F.col("q_make") != "") & (F.col("make_norm") == F.col("q_make")), 0.2).otherwise(0.0)
        + F.when((F.col("q_model") != "") & (F.col("model_norm") == F.col("q_model")), 0.3).otherwise(0.0)
        + F.when(year.isNotNull() & F.array_contains("years", year), 0.3)
        .when(year.isNotNull() & near, 0.1)
        .otherwise(0.0)
    )
    years = F.when(year.isNotNull(), F.array(year)).otherwise(F.slice("years", 1, 3))
    return hit.select(
        "query_id",
        F.col("make_norm").alias("make"),
        "model",
        F.explode_outer(years).alias("year"),
        F.lit("").alias("colour"),
        rnd(score, 6).alias("score"),
        F.lit("reference").alias("source"),
        F.col("position").alias("row_id"),
    )


def _under_any(rows: DataFrame, *names: str) -> DataFrame:
    """Each row under every key: a column's own value (if there is one) or null, which stands for any."""
    for c in names:
        own_and_any = F.when(F.col(c).isNull(), F.array(F.col(c))).otherwise(F.array(F.col(c), F.lit(None)))
        rows = rows.withColumn(f"k_{c}", F.explode(own_and_any))
    return rows


def _first_of(rows: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """The first rows of each key; all but those are pruned before the shuffle."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= keep).drop("_n")


INDEX_KEYS = ["k_make_norm", "k_model_norm", "k_colour_norm", "k_year"]
REFERENCE_KEYS = ["k_make_norm", "k_model_norm", "kind", "k_year"]
# What a reference list's rows have in common: any year, a year they name, or no year asked.
ANY_YEAR, SAME_YEAR, NO_YEAR = range(3)


def index_lists(rows: DataFrame, keep: int) -> DataFrame:
    """Ranked lists of index rows, the first `keep` by row_id under each key.

    A key fixes or leaves open make, model, colour and year. A query's score depends on a row only
    through agreement in those, so the rows of one list that a query finds under its own key score at least alike,
    and its best `keep` rows lie at the heads of the lists of the values that raise the score, together
    with those that leave them open. `rows`: as `_index_rows` gives.
    """
    return _first_of(_under_any(rows, "make_norm", "model_norm", "colour_norm", "year"), INDEX_KEYS, ["row_id"], keep)


def reference_lists(reference: DataFrame, keep: int) -> DataFrame:
    """Ranked lists of reference models, the first `keep` by position under each key of make, model and year."""
    years = F.array_compact(F.coalesce("years", F.array().cast("array<int>")))
    entry = lambda kind, key, year: F.struct(F.lit(kind).alias("kind"), key.cast("int").alias("k_year"), year.cast("int").alias("year"))
    none = F.lit(None)
    first_years = F.transform(F.slice(years, 1, 3), lambda y: entry(NO_YEAR, none, y))
    entries = F.concat(
        F.array(entry(ANY_YEAR, none, none)),
        F.transform(F.array_distinct(years), lambda y: entry(SAME_YEAR, y, none)),
        F.when(F.size(years) > 0, first_years).otherwise(F.array(entry(NO_YEAR, none, none))),
    )
    named = reference.select(
        "model", "position", norm_lower(F.col("make")).alias("make_norm"), norm_lower(F.col("model")).alias("model_norm"), F.inline(entries)
    )
    # models whose normal forms are alike give one answer
    unique = named.groupBy("make_norm", "model_norm", "kind", "k_year", "year").agg(F.min_by("model", "position").alias("model"), F.min("position").alias("position"))
    return _first_of(_under_any(unique, "make_norm", "model_norm"), REFERENCE_KEYS, ["position", "year"], keep)


def _list_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """Make and model keys of each query: the names that agree with its own by containment, null where it has none.

    `names`: the (make_norm, model_norm) there are, so no key without rows is formed from two names.
    """
    makes = containment_pairs(wanted.where("q_make <> ''"), names, "q_make", "make_norm")
    models = containment_pairs(wanted.where("q_model <> ''"), names, "q_model", "model_norm")
    open_ = F.lit(None).cast("string")
    columns = [*wanted.columns, "k_make_norm", "k_model_norm"]
    by_make = wanted.where("q_make <> ''").join(makes, "q_make").withColumnRenamed("make_norm", "k_make_norm")
    both = (
        by_make.where("q_model <> ''")
        .join(names.withColumnRenamed("make_norm", "k_make_norm"), "k_make_norm")
        .join(models, ["q_model", "model_norm"])
        .withColumnRenamed("model_norm", "k_model_norm")
    )
    model_only = wanted.where("q_make = '' AND q_model <> ''").join(models, "q_model").withColumnRenamed("model_norm", "k_model_norm")
    parts = [
        both,
        by_make.where("q_model = ''").withColumn("k_model_norm", open_),
        model_only.withColumn("k_make_norm", open_),
        wanted.where("q_make = '' AND q_model = ''").withColumn("k_make_norm", open_).withColumn("k_model_norm", open_),
    ]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def _met(keys: DataFrame, lists: DataFrame, names: list[str]) -> DataFrame:
    """Query keys joined to the lists of the same key, open parts included."""
    renamed = keys.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in keys.columns])
    condition = F.lit(True)
    for c in names:
        condition = condition & F.col(f"_{c}").eqNullSafe(F.col(c))
    return renamed.join(lists, condition).drop(*[f"_{c}" for c in names])


def vehicle_search(queries: DataFrame, index: DataFrame, reference: DataFrame, limit: int = 20) -> DataFrame:
    """Index answers, completed from the reference where they are fewer than `limit`; best `limit`.

    Exact, though no query meets more than the heads of ranked lists (`index_lists`, `reference_lists`),
    however much a blank make or model leaves open. Equal queries are answered once.
    """
    asked = stash(_query_norms(queries), "search-queries")
    own = ["q_make", "q_model", "q_year", "q_colour"]
    wanted = asked.select(*own).distinct()
    rows, models = stash(_index_rows(index), "search-index"), stash(reference_lists(reference, 2 * limit), "search-reference")
    lists = stash(index_lists(rows, limit), "search-lists")
    known = rows.select("make_norm", "model_norm").union(models.select("make_norm", "model_norm")).distinct()
    named = stash(_list_names(wanted, known), "search-keys")

    colours = rows.select("colour_norm").distinct()
    inside = colours.select(F.col("colour_norm").alias("k_colour_norm"), F.explode(_substrings(F.col("colour_norm"))).alias("q_colour"))
    inside = inside.where("q_colour <> ''").unionByName(
        wanted.select("q_colour").distinct().select(F.lit(None).cast("string").alias("k_colour_norm"), "q_colour")
    )
    any_year = F.lit(None).cast("int")
    years = F.when(F.col("q_year").isNotNull(), F.concat(F.array(any_year), F.sequence(F.col("q_year") - 2, F.col("q_year") + 2)))
    keys = named.join(inside, "q_colour").withColumn("k_year", F.explode(F.coalesce(years, F.array(any_year))))
    found = _met(keys, lists, INDEX_KEYS).dropDuplicates([*own, "row_id"]).withColumn("score", _index_score())
    best = Window.partitionBy(*own).orderBy(F.col("score").desc(), "row_id")
    first = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit)
    first = stash(first.select(*own, "make", "model", "year", "colour", "score", F.lit(0).alias("turn"), F.col("row_id").alias("id"), "_n"), "search-first")

    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own]
    enough = first.where(F.col("_n") == limit).select(*[F.col(c).alias(f"_{c}") for c in own])
    short = named.join(enough, same[0] & same[1] & same[2] & same[3], "left_anti")
    key = lambda kind, year: F.struct(F.lit(kind).alias("kind"), year.cast("int").alias("k_year"))
    around = F.transform(F.sequence(F.col("q_year") - 2, F.col("q_year") + 2), lambda y: key(SAME_YEAR, y))
    kinds = F.when(F.col("q_year").isNotNull(), F.concat(F.array(key(ANY_YEAR, any_year)), around)).otherwise(F.array(key(NO_YEAR, any_year)))
    short = short.select("*", F.inline(kinds)).withColumn("_gap", F.abs(F.col("k_year") - F.col("q_year")))
    hits = _met(short, models, REFERENCE_KEYS)
    score = (
        F.lit(REFERENCE_BASE)
        + F.when((F.col("q_make") != "") & (F.col("make_norm") == F.col("q_make")), 0.2).otherwise(0.0)
        + F.when((F.col("q_model") != "") & (F.col("model_norm") == F.col("q_model")), 0.3).otherwise(0.0)
        + F.when(F.col("_gap") == 0, 0.3).when(F.col("_gap") > 0, 0.1).otherwise(0.0)
    )
    second = hits.select(
        *own, F.col("make_norm").alias("make"), "model", F.coalesce("q_year", "year").alias("year"), F.lit("").alias("colour"),
        rnd(score, 6).alias("score"), F.lit(1).alias("turn"), F.col("position").alias("id"),
    )
    order = F.struct("turn", (-F.col("score")).alias("neg"), "id")
    unique = (
        first.drop("_n")
        .unionByName(second)
        .withColumn("_o", order)
        .groupBy(*own, norm_lower(F.col("make")).alias("_make"), norm_lower(F.col("model")).alias("_model"), "year", norm_lower(F.col("colour")).alias("_colour"))
        .agg(F.min_by(F.struct("make", "model", "colour", "score", "turn"), "_o").alias("r"), F.min("_o").alias("_o"))
    )
    place = Window.partitionBy(*own).orderBy(F.col("r.score").desc(), "_o", "year")
    answers = unique.withColumn("rank", F.row_number().over(place).cast("bigint")).where(F.col("rank") <= limit)
    answers = answers.select(
        *[F.col(c).alias(f"_{c}") for c in own], "rank", "r.make", "r.model", "year", "r.colour", "r.score",
        F.when(F.col("r.turn") == 0, "index").otherwise("reference").alias("source"),
    )
    return asked.join(answers, same[0] & same[1] & same[2] & same[3]).select("query_id", "rank", "make", "model", "year", "colour", "score", "source")


# -- fuzzy names -------------------------------------------------------------------------------


def _grams(c: Column, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))
    )


def _blocking_keys(c: Column, needle: bool, blocks: bool) -> Column:
    """Keys of which any pair that can reach the floor shares one.

    A pair scores through a shared word, through containment, or through at least 80 % similarity. By
    edit distance, texts that similar share a run of three characters, or of two where both are short.
    By matching blocks, runs of two may do at any length (parted by single strangers), and single
    characters where two of them match among five.
    """
    none = F.array().cast("array<string>")
    words = F.transform(F.split(c, " "), lambda w: F.concat(F.lit("w:"), w))
    three = F.when(F.length(c) >= 3, F.transform(_grams(c, 3), lambda g: F.concat(F.lit("3:"), g))).otherwise(none)
    pairing = F.length(c) >= 2 if blocks else (F.length(c) >= 2) & (F.length(c) <= 9)
    two = F.when(pairing, F.transform(_grams(c, 2), lambda g: F.concat(F.lit("2:"), g))).otherwise(none)
    # Texts of one or two characters can only be contained: as themselves on one side, as runs on the other.
    tiny = F.when(F.length(c) <= 2, F.array(F.concat(F.lit("t:"), c))).otherwise(none)
    pairs = F.when(F.length(c) >= 2, _grams(c, 2)).otherwise(none)
    runs = F.transform(F.concat(_grams(c, 1), pairs), lambda g: F.concat(F.lit("t:"), g))
    inside = F.transform(F.concat(_grams(c, 1), pairs), lambda g: F.concat(F.lit("s:"), g))
    small = F.when(F.length(c) <= 2, F.array(F.concat(F.lit("s:"), c))).otherwise(none)
    extra = F.concat(tiny, inside) if needle else F.concat(runs, small)
    one = F.when(F.length(c) <= 3, F.transform(_grams(c, 1), lambda g: F.concat(F.lit("1:"), g))).otherwise(none)
    return F.array_distinct(F.concat(words, three, two, extra, *([one] if blocks else [])))


def name_score(needle: Column, name: Column, percent: Column) -> Column:
    words, others = F.split(needle, " "), F.split(name, " ")
    shared = F.size(F.filter(words, lambda w: F.array_contains(others, w)))
    near = (
        F.when(name.contains(needle), 80.0).otherwise(0.0)
        + F.when(needle.contains(name), 40.0).otherwise(0.0)
        + shared * 28.0
        + shared / F.greatest(F.lit(1), F.size(words)) * 30.0
        + percent * 0.45
    )
    return F.when(needle == name, 200.0).otherwise(near)


def fuzzy_name_join(needles: DataFrame, names: DataFrame, floor: float = NAME_FLOOR, similarity: str = "edit") -> DataFrame:
    """Best name for each needle, if it reaches the floor. `needles`: needle; `names`: name, position.

    Distinct texts meet on shared blocking keys. Similarity is by edit distance, or by matching
    blocks (`similarity="blocks"`), which runs in Python on the blocked pairs only.
    """
    a = needles.select("needle", norm_upper(F.col("needle")).alias("a")).distinct().where(F.col("a") != "")
    b = (
        names.withColumn("b", norm_upper(F.col("name")))
        .where(F.col("b") != "")
        .groupBy("b")
        .agg(F.min_by("name", "position").alias("name"), F.min("position").alias("position"))
    )
    left = a.select("a").distinct().select("a", F.explode(_blocking_keys(F.col("a"), True, similarity == "blocks")).alias("key"))
    right = b.select("b", F.explode(_blocking_keys(F.col("b"), False, similarity == "blocks")).alias("key"))
    pairs = left.join(right, "key").select("a", "b").distinct()
    if similarity == "blocks":
        percent = matching_blocks_ratio(F.col("a"), F.col("b")) * 100.0
    else:
        longest = F.greatest(F.length("a"), F.length("b"))
        percent = (1.0 - F.levenshtein("a", "b") / longest) * 100.0
    scored = pairs.withColumn("_pct", percent).withColumn("score", name_score(F.col("a"), F.col("b"), F.col("_pct")))
    best = (
        scored.where(F.col("score") >= floor)
        .join(b, "b")
        .groupBy("a")
        .agg(
            F.min_by(F.struct("name", "score", "position"), F.struct((-F.col("score")).alias("s"), "position")).alias("m")
        )
    )
    return a.join(best, "a").select("needle", "m.name", F.col("m.position").alias("position"), rnd(F.col("m.score"), 6).alias("score"))


def pick_year(targets: DataFrame, years: DataFrame) -> DataFrame:
    """Year entry for each target: the year asked for, else the first plausible one, else the first.

    `targets`: model, asked (text). `years`: model, position, code, name.
    """

    def named(c: Column) -> Column:
        return F.regexp_extract(F.coalesce(c, F.lit("")), "\\b((?:19|20)\\d{2})\\b", 1).try_cast("int")

    asked = F.array_max(years_in(F.col("asked")))
    found = years.withColumn("_y", F.coalesce(named(F.col("code")), named(F.col("name")), F.lit(0)))
    # Entries are settled per model, and per model and year, before any target meets them.
    turn = F.when(F.col("_y").between(1900, 2100), 1).otherwise(2)

    def first(rows: DataFrame, name: str, order: Column, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.struct(F.min(order).alias("order"), F.min_by("code", order).alias("code")).alias(name))

    by_model = first(found, "_any", F.struct(turn.alias("turn"), "position"), "model")
    by_year = first(found.where(F.col("_y") > 0), "_own", F.struct(F.lit(0).alias("turn"), "position"), "model", "_y")
    joined = targets.withColumn("_y", F.coalesce(asked, F.lit(0))).join(by_model, "model").join(by_year, ["model", "_y"], "left")
    best = joined.withColumn("_best", F.coalesce("_own", "_any"))
    return best.groupBy("target_id").agg(F.min_by("_best.code", "_best.order").alias("year_code"))


# -- vectors -----------------------------------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(c: Column) -> Column:
    """Vector scaled to length one, as doubles."""
    norm = F.sqrt(_dot(c, c)) + 1e-8
    return F.transform(c, lambda x: x.cast("double") / norm)


def semantic_rerank(candidates: DataFrame, cases: DataFrame, vectors: DataFrame, top: int = RERANK_TOP) -> DataFrame:
    """Raise candidate scores by cosine similarity to the case's own vector; best `top` per case.

    `candidates`: case_id, key, score; `cases`: case_id, embedding; `vectors`: key, embedding.
    A candidate without a vector keeps its score.
    """
    own = cases.select("case_id", unit(F.col("embedding")).alias("_q"))
    known = vectors.select("key", unit(F.col("embedding")).alias("_v"))
    sim = F.coalesce(_dot(F.col("_q"), F.col("_v")), F.lit(0.0))
    scored = (
        candidates.join(known, "key", "left")
        .join(own, "case_id", "left")
        .withColumn("semantic_score", rnd(sim, 6))
        .withColumn("score", rnd(F.col("score") + sim * RERANK_WEIGHT, 6))
    )
    best = Window.partitionBy("case_id").orderBy(F.col("score").desc(), "key")
    return (
        scored.withColumn("rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("rank") <= top)
        .select("case_id", "key", "semantic_score", "score", "rank")
    )


def _best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row with their ids, largest first, of equal ones the smaller id."""
    if sims.shape[1] > 2 * k:
        # the k-th largest of each row is a limit; what lies at it is kept whole, as its ids decide
        limit = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
        kept = sims >= limit
        width = int(kept.sum(axis=1).max())
        order = np.argsort(~kept, axis=1, kind="stable")[:, :width]
        inside = np.take_along_axis(kept, order, axis=1)
        sims = np.where(inside, np.take_along_axis(sims, order, axis=1), -np.inf)
        ids = np.take_along_axis(ids, order, axis=1)
    order = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(sims, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _nearest(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors of a slice for each query of a block; the slice is read in chunks, and only the
    best so far are held beside a chunk's similarities."""
    names = ["query_id", "vec_id", "similarity"]
    if queries.empty or vectors.empty:
        return pd.DataFrame({n: [] for n in names})
    asked, known, known_ids = np.stack(queries["v"].to_numpy()), np.stack(vectors["v"].to_numpy()), vectors["vec_id"].to_numpy()
    best_sims, best_ids = [], []
    for start in range(0, len(asked), QUERY_CHUNK):
        some = asked[start : start + QUERY_CHUNK]
        sims = ids = None
        for at in range(0, len(known), VECTOR_CHUNK):
            new, new_ids = some @ known[at : at + VECTOR_CHUNK].T, known_ids[at : at + VECTOR_CHUNK]
            if sims is None or sims.shape[1] < k:
                wide = np.broadcast_to(new_ids, new.shape)
                if sims is not None:
                    new, wide = np.hstack([sims, new]), np.hstack([ids, wide])
                sims, ids = _best_of(new, wide, k)
                continue
            # only what reaches a query's k-th best so far can be among its best
            row, column = np.nonzero(new >= sims[:, -1:])
            if not len(row):
                continue
            hit, first, found = np.unique(row, return_index=True, return_counts=True)
            place, slot = np.repeat(np.arange(len(hit)), found), np.arange(len(row)) - np.repeat(first, found)
            late_sims, late_ids = np.full((len(hit), int(found.max())), -np.inf), np.zeros((len(hit), int(found.max())), ids.dtype)
            late_sims[place, slot], late_ids[place, slot] = new[row, column], new_ids[column]
            sims[hit], ids[hit] = _best_of(np.hstack([sims[hit], late_sims]), np.hstack([ids[hit], late_ids]), k)
        best_sims.append(sims)
        best_ids.append(ids)
    sims, ids = np.vstack(best_sims), np.vstack(best_ids)
    return pd.DataFrame(
        {"query_id": np.repeat(queries["query_id"].to_numpy(), sims.shape[1]), "vec_id": ids.ravel(), "similarity": sims.ravel()}
    )


def _pieces(rows: int, most: int) -> int:
    """Pieces that rows are cut into: none above `most`, and some for every core where they stay large enough."""
    return max(1, -(-rows // most), min(SIDE_BLOCKS, rows // LEAST_BLOCK))


def knn_search(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = QUERY_BLOCK, cut: int = VECTOR_SLICE) -> DataFrame:
    """Exact k nearest vectors of each query by cosine similarity.

    Queries fall into blocks and vectors into slices of bounded size. Each block meets each slice in
    one task, as a matrix product of which only the k best per query leave; the best of those are the
    answer. Neither side passes through the driver. `queries`: query_id, embedding; `vectors`: vec_id,
    embedding.
    """
    # Vectors stay in as few slices as their bound allows: the longer a slice, the sooner most of it is passed over.
    blocks, slices = _pieces(queries.count(), block), max(1, -(-vectors.count() // cut))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(
        "query_id", unit(F.col("embedding")).alias("v"), part("query_id", blocks).alias("b"), every(slices).alias("s")
    )
    right = vectors.select(
        "vec_id", unit(F.col("embedding")).alias("v"), part("vec_id", slices).alias("s"), every(blocks).alias("b")
    )
    found = (
        left.groupBy("b", "s")
        .cogroup(right.groupBy("b", "s"))
        .applyInPandas(lambda q, v: _nearest(q, v, k), "query_id long, vec_id long, similarity double")
    )
    near = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(near).cast("bigint")).where(F.col("rank") <= k)


def coarse_lists(vectors: DataFrame, k: int, lists: int = LISTS, recall: float = AIMED_RECALL, sample: int = FIT_VECTORS, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Unit centroids of coarse lists, and how many of them a query has to read.

    Both come from at most `sample` vectors, those with the smallest hash of their id: the centroids by
    rounds of means, the number by looking up in how manieth list the neighbours of some of them lie.
    """
    rows = vectors.select(unit(F.col("embedding")).alias("v"), F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample)
    known = np.array([r.v for r in rows.select("v").collect()])
    if not len(known):
        return np.zeros((0, 0)), 0
    centres = known[: min(lists, len(known))].copy()
    for _ in range(rounds):
        owner = (known @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            mine = known[owner == i]
            if len(mine):
                centres[i] = mine.sum(axis=0) / (np.linalg.norm(mine.sum(axis=0)) + 1e-8)
    owner = (known @ centres.T).argmax(axis=1)
    asked = known[:FIT_QUERIES]
    ids = np.broadcast_to(np.arange(len(known)), (len(asked), len(known)))
    _, near = _best_of(asked @ known.T, ids, k)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    places = np.sort(np.take_along_axis(place, owner[near], axis=1).ravel())
    return centres, int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1


def _probed(centres: np.ndarray, probes: int):
    """UDF: the lists whose centroids are nearest to a unit vector, nearest first."""

    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        sims = np.stack(v.to_numpy()) @ centres.T
        return pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return lists


def knn_search_lists(
    queries: DataFrame, vectors: DataFrame, k: int = 5, lists: int = LISTS, probes: int | None = None, slice_rows: int = VECTOR_SLICE
) -> DataFrame:
    """Approximate `knn_search`: every vector is in the coarse list of its nearest centroid, and a query
    reads its `probes` nearest lists, by default as many as find nearly all neighbours on the sample.
    Centroids come from a bounded sample; the index covers every vector.

    Lists are cut into slices of bounded size, as a popular one may hold a large share of all vectors, and
    queries into blocks. With `probes` equal to `lists` the answer is the exact one.
    """
    centres, enough = coarse_lists(vectors, k, lists)
    if not len(centres):
        return knn_search(queries, vectors, k)
    probes = min(len(centres), probes or enough)
    known = vectors.select("vec_id", unit(F.col("embedding")).alias("v"))
    known = stash(known.withColumn("l", _probed(centres, 1)(F.col("v"))[0]), "listed-vectors")
    wanted = queries.select("query_id", unit(F.col("embedding")).alias("v"))
    wanted = stash(wanted.withColumn("near", _probed(centres, probes)(F.col("v"))), "probed-queries")
    # A list is cut by its own size and by the queries that read it, so most meet in one task and nothing is sent twice.
    lengths = {r.l: r["count"] for r in known.groupBy("l").count().collect()}
    readers = {r.l: r["count"] for r in wanted.select(F.explode("near").alias("l")).groupBy("l").count().collect()}
    every = range(len(centres))
    cut = F.array(*[F.lit(max(1, -(-lengths.get(i, 0) // slice_rows))) for i in every])
    blocks = F.array(*[F.lit(max(1, -(-readers.get(i, 0) // QUERY_BLOCK))) for i in every])
    own = lambda c, pieces: F.pmod(F.xxhash64(c), F.get(pieces, F.col("l"))).cast("int")
    each = lambda pieces: F.explode(F.sequence(F.lit(0), F.get(pieces, F.col("l")) - 1))
    stored = known.withColumn("s", own("vec_id", cut)).withColumn("b", each(blocks))
    asked = wanted.select("query_id", "v", F.explode("near").alias("l")).withColumn("b", own("query_id", blocks)).withColumn("s", each(cut))
    found = (
        asked.groupBy("l", "b", "s")
        .cogroup(stored.groupBy("l", "b", "s"))
        .applyInPandas(lambda q, v: _nearest(q, v, k), "query_id long, vec_id long, similarity double")
    )
    near = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(near).cast("bigint")).where(F.col("rank") <= k)


def knn_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that an approximate search found, over all queries."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("_hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("neighbours"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("neighbours"))


# -- ranking and reports -----------------------------------------------------------------------


def rank_vehicle_candidates(
    readings: DataFrame, cases: DataFrame, matches: DataFrame, searches: DataFrame, top: int = RANKED_TOP
) -> DataFrame:
    """Best vehicle candidates of each case from image similarity, context, reference match and search.

    `readings`: case_id, make, model, clip_score; `cases`: case_id, has_class, has_lights, has_partial,
    seed_make, seed_model; `matches`: make, model, match_type; `searches`: make, model, best_score.
    A case without readings falls back to its own seed.
    """
    kinds = F.when(F.col("match_type") == "exact", 0.12).when(F.col("match_type") == "partial", 0.07).otherwise(0.0)
    flag = lambda name, value: F.when(F.col(name), value).otherwise(0.0)
    boost = F.least(F.lit(0.15), F.coalesce("best_score", F.lit(0.0)) * 0.1)
    score = (
        F.col("clip_score") * 0.80
        + flag("has_class", 0.08)
        + flag("has_lights", 0.05)
        + flag("has_partial", 0.03)
        + kinds
        + boost
    )
    context = cases.select("case_id", "has_class", "has_lights", "has_partial")
    rows = (
        readings.join(context, "case_id")
        .join(matches.select("make", "model", "match_type"), ["make", "model"], "left")
        .join(searches, ["make", "model"], "left")
        .withColumn("_s", score)
    )
    seeds = (
        cases.join(readings.select("case_id").distinct(), "case_id", "left_anti")
        .where((F.col("seed_make") != "") | (F.col("seed_model") != ""))
        .select(
            "case_id",
            F.col("seed_make").alias("make"),
            F.when(F.col("seed_model") == "", F.col("seed_make")).otherwise(F.col("seed_model")).alias("model"),
        )
        .join(matches.select("make", "model", "match_type"), ["make", "model"], "left")
        .withColumn("_s", F.lit(FALLBACK_SCORE) + kinds)
    )
    columns = ["case_id", "make", "model", F.coalesce("match_type", F.lit("none")).alias("match_type"), "_s"]
    pooled = rows.select(*columns).unionByName(seeds.select(*columns))
    scored = pooled.withColumn("probability", rnd(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_s"))), 4)).drop("_s")
    best = Window.partitionBy("case_id").orderBy(F.col("probability").desc(), "make", "model")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)


def unique_models(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Distinct (make, model) of several sources, in the order given; the first source names it."""
    pooled = None
    for turn, (name, df) in enumerate(sources):
        part = df.where(F.col("model") != "").select(
            "make", "model", F.lit(name).alias("source"), F.lit(turn).alias("_turn"), F.col("position").cast("bigint").alias("_pos")
        )
        pooled = part if pooled is None else pooled.unionByName(part)
    return (
        pooled.groupBy(F.lower("make").alias("_mk"), F.lower("model").alias("_mo"))
        .agg(F.min_by(F.struct("make", "model", "source"), F.struct("_turn", "_pos")).alias("r"))
        .select("r.*")
    )


def profile_dataset(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct ids, makes and years, and the year range."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    known = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct(known("model_id")).alias("models"),
        distinct(known("make")).alias("makes"),
        distinct(known("year")).alias("years"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    )


def profile_splits(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim("split") != "").groupBy(F.trim("split").alias("split")).agg(F.count(F.lit(1)).alias("rows"))


def source_status(reference: DataFrame, index: DataFrame, vectors: DataFrame) -> DataFrame:
    """What each source holds, as (source, available, measure, total) rows."""
    parts = [
        reference.agg(F.count_distinct("make").alias("total")).select(F.lit("reference").alias("source"), F.lit("makes").alias("measure"), "total"),
        reference.agg(F.count(F.lit(1)).alias("total")).select(F.lit("reference").alias("source"), F.lit("models").alias("measure"), "total"),
        index.agg(F.count(F.lit(1)).alias("total")).select(F.lit("index").alias("source"), F.lit("records").alias("measure"), "total"),
        index.agg(F.count_distinct("make", "model", "colour").alias("total")).select(F.lit("index").alias("source"), F.lit("keys").alias("measure"), "total"),
        vectors.agg(F.count(F.lit(1)).alias("total")).select(F.lit("vectors").alias("source"), F.lit("vectors").alias("measure"), "total"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("available", F.col("total") > 0)
