"""Records that differ in formatting only (problem 1).

Method: the distinct values of every column are put in canonical form once and get
integer identifiers in a dictionary; each record becomes the sorted tuple of its
field-value integers, and equal tuples are one record.

An identifier is a 64-bit hash of the canonical value under a seed for which no two
values of the dictionary share one: this is checked, and another seed taken if it does
not hold. So identifiers need no numbering of values, no join back to them, and come
out alike if a task runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import canonical
from pagewright.runtime import HEAVY_PARTS, materialize, split_join

#: Kinds of dictionary entries; a kind tells equal strings of different columns apart.
DOC, NAME, ENTRY, EXTRA = 0, 1, 2, 3


def fields(concepts: DataFrame) -> DataFrame:
    """(concept_id, kind, raw): one row per value of a record with an id and a name.

    A null list has no entries, a null extra no value; null doc_ids are equal. Whether
    a name is blank is told later, once per distinct name.
    """
    rows = concepts.filter(F.col("name").isNotNull() & F.col("concept_id").isNotNull())

    def value(kind: int, c: str) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(c).alias("raw"))

    entries = F.transform(F.coalesce("prerequisites", F.array().cast("array<string>")),
                          lambda x: F.struct(F.lit(ENTRY).alias("kind"), x.alias("raw")))
    values = F.concat(F.array(value(DOC, "doc_id"), value(NAME, "name"), value(EXTRA, "extra")), entries)
    return (
        rows.select("concept_id", F.explode(values).alias("v")).select("concept_id", "v.kind", "v.raw")
        .filter(F.col("raw").isNotNull())
    )


def meaning() -> F.Column:
    """What a raw value means, as canonical strings.

    A document id means itself; a name or an entry its letters and digits, a blank one
    nothing. An extra means its keys with their values, in any order (null is a value
    of its own), and one string that says there is an extra. One that is no JSON
    object means its letters and digits.
    """
    pairs = F.transform(
        F.map_entries(F.from_json("raw", "map<string,string>")),
        lambda e: F.concat(F.lit("k"), canonical(e["key"]), F.coalesce(F.concat(F.lit(" v"), canonical(e["value"])), F.lit(" null"))),
    )
    return (
        F.when(F.col("kind") == DOC, F.array("raw"))
        .when(F.col("kind") == EXTRA, F.concat(F.array(F.lit("extra")), F.coalesce(pairs, F.array(F.concat(F.lit("text "), canonical("raw"))))))
        .otherwise(F.filter(F.array(canonical("raw")), lambda x: x != ""))
    )


def coded(values: DataFrame, seed: int) -> DataFrame:
    """(kind, raw, n, codes): each distinct value, how often it occurs, and the identifiers of what it means; canonical once per value."""
    counted = values.groupBy("kind", "raw").agg(F.count(F.lit(1)).alias("n"))
    codes = F.transform(meaning(), lambda m: F.xxhash64(F.lit(seed), "kind", m))
    # A second hash tells values apart that share an identifier.
    proof = F.transform(meaning(), lambda m: F.xxhash64(m, F.lit(~seed), "kind"))
    return materialize(counted.select("kind", "raw", "n", codes.alias("codes"), proof.alias("proof")))


def dictionary(values: DataFrame, seed: int = 1) -> DataFrame:
    """As coded, under the first seed from `seed` on that gives every canonical value an identifier of its own."""
    while True:
        book = coded(values, seed)
        pairs = book.select(F.explode(F.arrays_zip("codes", "proof")).alias("p"))
        shared = pairs.groupBy("p.codes").agg(F.min("p.proof").alias("a"), F.max("p.proof").alias("b")).filter("a <> b")
        if shared.isEmpty():
            return book.drop("proof")
        seed += 1


def tuples(concepts: DataFrame) -> DataFrame:
    """(concept_id, key): each record with a non-blank name as the sorted array of its field-value integers."""
    values = fields(concepts)
    book = dictionary(values)
    total = book.agg(F.sum("n")).first()[0] or 0
    heavy = book.filter(F.col("n") * HEAVY_PARTS > total).select("kind", "raw")
    met = split_join(values, book.drop("n"), ["kind", "raw"], heavy).select("concept_id", "kind", "codes")
    named = F.max(F.when(F.col("kind") == NAME, F.size("codes"))).alias("named")
    rows = met.groupBy("concept_id").agg(F.sort_array(F.flatten(F.collect_list("codes"))).alias("key"), named)
    return rows.filter("named > 0").select("concept_id", "key")


def record_groups(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tuples of all records, and (key, keep_id, n_copies) of the groups they form.

    Rows with a null or blank name belong to no group. concept_id is taken to be
    unique: rows that share one count as one record.
    """
    records = materialize(tuples(concepts))
    groups = records.groupBy("key").agg(F.min("concept_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    return records, groups


def copies(concepts: DataFrame) -> DataFrame:
    """(keep_id, copy_id): every record but the first of its group, with the first.

    A group that holds a large part of all rows is joined by broadcast: one row per
    group, and at most HEAVY_PARTS groups.
    """
    records, groups = record_groups(concepts)
    groups = materialize(groups.filter(F.col("n_copies") > 1))
    total = groups.agg(F.sum("n_copies")).first()[0] or 0
    heavy = groups.filter(F.col("n_copies") * HEAVY_PARTS > total).select("key")
    joined = split_join(records, groups, ["key"], heavy)
    return joined.filter(F.col("concept_id") != F.col("keep_id")).select("keep_id", F.col("concept_id").alias("copy_id"))


def collapsed(concepts: DataFrame) -> DataFrame:
    """One row per record: concept_id (smallest of its group), doc_id, name, prerequisites and extra as first written, n_copies."""
    _, groups = record_groups(concepts)
    first = concepts.select(F.col("concept_id").alias("keep_id"), "doc_id", "name", "prerequisites", "extra")
    return groups.select("keep_id", "n_copies").join(first, "keep_id").select(
        F.col("keep_id").alias("concept_id"), "doc_id", "name", "prerequisites", "extra", "n_copies")
