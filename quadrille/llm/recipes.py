"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut into chunks where its own bytes say so, so equal passages give
equal chunks wherever they stand.  Each distinct chunk moves once, to be
verified: an identifier is the chunk's 64-bit hash, and where one hash stands
for several contents, each of them has an ordinal beside it.  From then on a
document is its recipe, the ordered list of its chunks' identifiers; documents
are equal if their recipes are.  Recipes are about a hundredth of the texts, so
long documents don't move again, and hot groups of copies are counted before
they are shuffled.

Defined results: null texts count as empty, and an empty text (white space
alone is one space, not empty) is a text like any other, with an empty recipe.
Of equal texts the row with the smallest doc_id stays; a row without doc_id
stays only if no row of its group has one; of rows that repeat a doc_id and a
text one stays.  Columns beside doc_id and text are not read, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.workspace import stored


@dataclass(frozen=True)
class Chunking:
    """A chunk ends at the first place behind `least` bytes where the last bytes leave the remainders of one of `ends`, divided by `modulus`; or at `most` bytes."""

    least: int = 1024
    most: int = 16384
    modulus: int = 5
    #: Two of 125 triples: one place in 62 of random bytes.
    ends: tuple[tuple[int, ...], ...] = ((0, 2, 4), (3, 1, 0))

    def pattern(self) -> str:
        kind = ["[" + "".join(f"\\x{b:02x}" for b in range(r, 256, self.modulus)) + "]" for r in range(self.modulus)]
        ends = "|".join("".join(kind[r] for r in e) for e in self.ends)
        return f"(?s).{{{self.least},{self.most}}}?(?<={ends})|.{{1,{self.most}}}"


#: Runs of white space other than one space alone.
_RUNS = "[\\t-\\r][ \\t-\\r]*| [ \\t-\\r]+"


def normalised(text: Column) -> Column:
    """The text's bytes as characters (a character for a byte, so any bytes will do), each run of white space as one space."""
    return F.regexp_replace(F.decode(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), "ISO-8859-1"), _RUNS, " ")


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_groups(docs: DataFrame, chunking: Chunking = Chunking(), hashed: Callable[[Column], Column] = _hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) and n_chunks of every row of `docs` (doc_id, text)."""
    # A row's number settles ties between rows that repeat a doc_id; it holds for one reading, so recipes are stored.
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    own = text.select("row", "doc_id", F.sha2(F.encode("text", "ISO-8859-1"), 256).alias("text_sha256"), F.regexp_extract_all("text", F.lit(chunking.pattern()), F.lit(0)).alias("chunks"))
    clashes = _clashes(own.select(F.explode("chunks").alias("chunk")), hashed)
    if clashes.isEmpty():
        recipes = stored(own.select("row", "doc_id", "text_sha256", F.transform("chunks", hashed).alias("recipe"), F.array().cast("array<long>").alias("numbers")), "recipes")
    else:
        recipes = stored(_told_apart(own, clashes, hashed), "recipes")
    recipes = recipes.withColumn("key", F.xxhash64("recipe", "numbers"))
    same = ["key", "recipe", "numbers"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # Stored, so that the join deals both sides and can split a group that is hot.
    groups = stored(recipes.groupBy(*same).agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    return recipes.join(groups, same).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def _clashes(chunks: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """(hash, chunk, number) of contents that share their hash with others; a content moves once for each task that reads it."""
    contents = chunks.select(hashed(F.col("chunk")).alias("hash"), "chunk").distinct()
    shared = stored(contents.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return shared
    return stored(contents.join(shared, "hash", "left_semi").withColumn("number", F.monotonically_increasing_id()), "clashes")


def _told_apart(own: DataFrame, clashes: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """Recipes where hashes clash: each place of a clashing content also has the content's number, all others -1."""
    places = own.select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk")).withColumn("hash", hashed(F.col("chunk")))
    numbered = places.join(clashes, ["hash", "chunk"], "left").withColumn("number", F.coalesce("number", F.lit(-1)))
    one = F.when(F.col("pos").isNotNull(), F.struct("pos", "hash", "number"))
    lists = numbered.groupBy("row", "doc_id", "text_sha256").agg(F.array_sort(F.collect_list(one)).alias("ids"))
    return lists.select("row", "doc_id", "text_sha256", F.col("ids.hash").alias("recipe"), F.col("ids.number").alias("numbers"))
