"""Name search with pruning (F3, F4, R8, R10, R11): a dictionary of the names of
an index and the places where each occurs.

* ``postings``: every distinct name of a class, callable, callee or imported
  module, in blocks of ``BLOCK`` names that are near each other in order,
  bucketed by block;
* ``grams``: (gram, block), one row for each run of three characters in lower
  case and block that has a name with it, bucketed by gram;
* ``places``: one row for each occurrence of a name, with what an answer shows
  of it, bucketed by name and salt.

A search reads the blocks that hold every run of three characters that a match
must hold, verifies their names with the search's own condition, and then reads
their places.  A rare term so reads a few buckets of names and places; no call
list is scanned.  A run that many names of a block share is one row, so the runs
take less room than the names.

Names that are not plain ASCII (lower case and the case rules of patterns differ
there) or longer than ``LONGEST`` are posted under the empty run, which every
search reads as well.  A pattern without three plain characters in a row reads
the dictionary of names instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import GLOB_PARTS, is_glob
from ..sources.bucketed import buckets_for, write_bucketed
from . import lookup

#: Longest name with runs of its own, and the most names (or blocks) that are read by key.
LONGEST, FEW = 512, 64
#: Names of a block, a power of two.
BLOCK = 512
TABLES = ["grams", "postings", "places"]


def occurrences(classes: DataFrame, callables: DataFrame, imports: DataFrame) -> DataFrame:
    """One row for each place of a name: ``role`` is ``import``, ``definition``
    or ``usage`` (one for each call of a callable)."""
    none = F.lit(None)
    context = F.when(F.col("kind") == "method", F.concat_ws(".", "class_name", "name")).otherwise(F.col("name"))

    def row(df, role, name, kind, shown, call_ord, ord_):
        at = ["repo", "path", "class_ord", "signature", "line"]
        return df.select(name.alias("name"), F.lit(role).alias("role"), kind.alias("kind"), shown.alias("context"),
                         *[(F.col(c) if c in df.columns else none.cast("int" if c != "signature" else "string")).alias(c) for c in at],
                         call_ord.cast("int").alias("call_ord"), ord_.cast("int").alias("ord"))

    called = callables.select("repo", "path", "class_ord", "signature", "line", "kind", "call_ord", context.alias("context"),
                              F.posexplode("calls").alias("ord", "callee"))
    parts = [row(imports, "import", F.col("module"), none.cast("string"), none.cast("string"), none, F.col("ord")),
             row(classes, "definition", F.col("name"), F.lit("class"), F.col("name"), F.lit(-1), none),
             row(callables, "definition", F.col("name"), F.col("kind"), context, F.col("call_ord"), none),
             row(called, "usage", F.col("callee"), F.col("kind"), F.col("context"), F.col("call_ord"), F.col("ord"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    salt = F.pmod(F.xxhash64("repo", "path"), F.lit(lookup.SALTS))  # a name called everywhere is spread
    return out.where(F.col("name").isNotNull()).select(lookup.key_of(salt, F.col("name")).alias("key"), "*").drop("name")


def runs(name: Column) -> Column:
    """The distinct runs of three characters that ``name`` is posted under."""
    plain = name.rlike(rf"\A[\x00-\x7F]{{0,{LONGEST}}}\z")
    # a look ahead from every character, in one pass over the name
    pieces = F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("(?s)(?=(.{3}))"), 1))
    return F.when(plain, pieces).otherwise(F.array(F.lit("")))


def runs_of(pattern: str) -> set[str]:
    """The runs of three plain characters that every match of a search holds in lower case."""
    literal = [m["text"] for m in GLOB_PARTS.finditer(pattern) if m["text"]] if is_glob(pattern) else [pattern.lower()]
    plain = [p.lower() for text in literal for p in re.findall(r"[\x00-\x7F]{3,}", text)]
    return {p[i:i + 3] for p in plain for i in range(len(p) - 2)}


def write(spark: SparkSession, classes: DataFrame, callables: DataFrame, imports: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Write the three tables below ``folder``, each from the one before; they are read back."""
    found = occurrences(classes, callables, imports)
    places = write_bucketed(found, f"{folder}/places", ["key"], buckets_for(found))
    names = places.select(lookup.name_in("key").alias("name")).distinct().sortWithinPartitions("name")
    # the numbers of a partition are consecutive, so a block holds neighbours of one partition
    blocks = names.select(F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1).alias("block"), "name")
    postings = write_bucketed(blocks, f"{folder}/postings", ["block"], buckets_for(places))
    held = postings.select("block", F.explode(runs(F.col("name"))).alias("gram")).distinct().select("gram", "block")
    return {"postings": postings, "places": places,
            "grams": write_bucketed(held, f"{folder}/grams", ["gram"], buckets_for(postings))}


@dataclass
class NameIndex:
    grams: DataFrame
    postings: DataFrame
    places: DataFrame

    @property
    def names(self) -> DataFrame:
        return self.postings.select("name")

    def matching(self, pattern: str, match) -> DataFrame:
        """The distinct names for which ``match`` holds, ``match`` being the
        condition of the search for ``pattern``."""
        wanted = runs_of(pattern)
        if not wanted:
            return self.names.where(match(F.col("name")))
        odd = F.col("gram") == ""
        blocks = self.grams.where(F.col("gram").isin([*sorted(wanted), ""])).groupBy("block") \
            .agg(F.count(F.when(~odd, 1)).alias("n"), F.count(F.when(odd, 1)).alias("odd")) \
            .where((F.col("n") == len(wanted)) | (F.col("odd") > 0)).select("block")
        few = [r["block"] for r in blocks.limit(FEW + 1).collect()]
        near = self.postings.where(F.col("block").isin(few)) if len(few) <= FEW else self.postings.join(blocks, "block", "left_semi")
        return near.where(match(F.col("name"))).select("name")

    def places_of(self, pattern: str, match) -> DataFrame:
        """Every place of the matching names.  Places of a few names are read
        from their buckets; those of many meet the names in place."""
        names = self.matching(pattern, match)
        few = [r["name"] for r in names.limit(FEW + 1).collect()]
        if len(few) <= FEW:
            found = self.places.where(F.col("key").isin([f"{n}\0{i}" for n in few for i in range(lookup.SALTS)]))
        else:
            found = self.places.join(lookup.salted(names, F.col("name")).select("key"), "key", "left_semi")
        return found.withColumn("name", lookup.name_in("key"))
