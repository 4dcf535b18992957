"""Spelling correction against a frequency dictionary, on distinct tokens only.

Two words within ``distance`` edits share a string that deleting that many characters leaves of
each, also if only their prefixes are taken. So candidates come from an equi-join on deletions,
and only they are measured. Words that are in the dictionary are their own closest and take no
part in that.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import clean, is_number, tokens

DISTANCE, PREFIX = 2, 7


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        older, old = old, row
    return old[-1]


def _swapped(a: Column, b: Column) -> Column:
    """Whether swapping two neighbours in a gives b."""
    n = F.length(a)
    swap = lambda i: F.concat(F.left(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n))
    return (n > 1) & (n == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: swap(i) == b)


def osa_within_2(a: Column, b: Column) -> Column:
    """osa of a and b where it is up to 2, 3 otherwise.

    It is Levenshtein's distance unless a swap helps: two neighbours of a are then the swapped ones
    of b, at most a place apart, and one more edit is on one side of them.
    """
    lev, n = F.levenshtein(a, b), F.length(a)
    one = lambda x, y: F.least(F.levenshtein(x, y), F.when(_swapped(x, y), 1).otherwise(3))

    def at(i: Column, shift: int) -> Column:
        j = i + shift
        crossed = (j >= 1) & (j < F.length(b)) & (F.substring(a, i, F.lit(1)) == F.substring(b, j + 1, F.lit(1))) & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, j, F.lit(1)))
        cost = 1 + one(F.left(a, i - 1), F.left(b, j - 1)) + one(F.substring(a, i + 2, n), F.substring(b, j + 2, F.length(b)))
        return F.when(crossed, cost).otherwise(3)

    best = F.array_min(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.least(at(i, -1), at(i, 0), at(i, 1))))
    return F.when(lev <= 1, lev).when((lev > 4) | (n < 2), F.least(lev, F.lit(3))).otherwise(F.least(lev, best, F.lit(3)))


def osa_distance(a: Column, b: Column) -> Column:
    """osa of any distance, measured by the Python function."""

    @F.pandas_udf("int")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return of(a, b)


def deletions(word: Column, distance: int = DISTANCE, prefix: int = PREFIX) -> Column:
    """What is left of word's prefix after up to ``distance`` deletions."""
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.length(s))))
    out = last = F.array(F.left(word, F.lit(prefix)))
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda s: s != ""), cut)))
        out = F.array_union(out, last)
    return out


@dataclass(frozen=True)
class SpellIndex:
    """A dictionary with the deletions of its terms, as a table that is bucketed by them, so lookups don't move it."""

    table: DataFrame
    distance: int

    @staticmethod
    def save(dictionary: DataFrame, name: str, distance: int = DISTANCE, buckets: int = 64) -> SpellIndex:
        """Writes the index of dictionary (term, count) as the catalog's table ``name``, in place of one that is there."""
        own = dictionary.select("term", "count", F.explode(deletions(F.col("term"), distance)).alias("_part"))
        own.repartition(buckets, "_part").write.mode("overwrite").bucketBy(buckets, "_part").sortBy("_part").saveAsTable(name)
        dictionary.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('distance' = '{distance}')")
        return SpellIndex.open(dictionary.sparkSession, name, distance)

    @staticmethod
    def open(spark: SparkSession, name: str, distance: int = DISTANCE) -> SpellIndex:
        """The saved index; one for fewer edits than ``distance`` is an error."""
        held = int({r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}["distance"])
        if held < distance:
            raise ValueError(f"the index {name} is for {held} edits, not {distance}")
        return SpellIndex(spark.table(name), distance)


def closest(words: DataFrame, dictionary: DataFrame | SpellIndex, distance: int = DISTANCE, measure: str = "osa") -> DataFrame:
    """(token, term, dist) of each token in words that has a dictionary term within ``distance`` edits.

    Of the closest terms, the most frequent, then the least. dictionary: term, count, or a saved
    index of them. measure: osa, or levenshtein, which knows no swaps. Only osa beyond 2 edits needs
    Python.
    """
    each = words.select("token").distinct()
    if isinstance(dictionary, SpellIndex):
        return _nearest(each, dictionary.table, distance, measure)
    known = each.join(dictionary.select(F.col("term").alias("token")).distinct(), "token", "left_semi")
    return known.select("token", F.col("token").alias("term"), F.lit(0).alias("dist")).union(corrected(each, dictionary, distance, measure))


def corrected(words: DataFrame, dictionary: DataFrame | SpellIndex, distance: int = DISTANCE, measure: str = "osa") -> DataFrame:
    """closest of the distinct words that aren't in the dictionary.

    With a saved index they aren't told apart before: a term meets itself, as its prefix is among its deletions.
    """
    if isinstance(dictionary, SpellIndex):
        if dictionary.distance < distance:
            raise ValueError(f"the index is for {dictionary.distance} edits, not {distance}")
        return _nearest(words.select("token").distinct(), dictionary.table, distance, measure).filter("dist > 0")
    strange = words.select("token").distinct().join(dictionary.select(F.col("term").alias("token")), "token", "left_anti")
    return _nearest(strange, dictionary.select("term", "count", F.explode(deletions(F.col("term"), distance)).alias("_part")), distance, measure)


def _nearest(words: DataFrame, terms: DataFrame, distance: int, measure: str) -> DataFrame:
    """(token, term, dist): for distinct words the closest of terms (term, count, _part)."""
    own = words.select("token", F.explode(deletions(F.col("token"), distance)).alias("_part"))
    pairs = own.join(terms, "_part").select("token", "term", "count").distinct()
    near = F.abs(F.length("token") - F.length("term")) <= distance
    osa_of = osa_within_2 if distance <= 2 else osa_distance
    dist = osa_of(F.col("token"), F.col("term")) if measure == "osa" else F.levenshtein("token", "term")
    found = pairs.filter(near).withColumn("dist", dist).filter(F.col("dist") <= distance)
    return found.groupBy("token").agg(F.min(F.struct("dist", (-F.col("count")).alias("c"), "term")).alias("m")).select("token", "m.term", "m.dist")


def normalize(texts: DataFrame, dictionary: DataFrame | SpellIndex | None = None, id_col: str = "id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, normalized): texts cleaned and, with a dictionary, each word but numbers corrected.

    Only corrections meet the words of the texts, so frequent words, which dictionaries have, match none.
    """
    cleaned = texts.select(F.col(id_col), clean(F.col(text_col)).alias("normalized"))
    if dictionary is None:
        return cleaned
    each = cleaned.select(id_col, F.posexplode(tokens(F.col("normalized"))).alias("pos", "token"))
    fixed = corrected(each.filter(~is_number(F.col("token"))), dictionary, distance)
    words = each.join(fixed, "token", "left").select(id_col, "pos", F.coalesce("term", "token").alias("w"))
    joined = words.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("_done"))
    return cleaned.join(joined, id_col, "left").select(id_col, F.coalesce("_done", F.lit("")).alias("normalized"))
