"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common turn prefix of both conversations (same roles and texts,
turn by turn) is rendered once as the prompt; the turns behind it are the two
completions.  Each completion comes with its mask: the character spans that
carry loss, which are its assistant turns' texts and end marks.

What is gathered in one place is one conversation, which is one value of the
output in any case; conversations are never gathered together, and each is
read once for each pair it is in.

Defined results: null roles and texts count as empty; turns are ordered by
turn number (null first), then role and text, so repeated turns stay; a pair
whose conversation has no turns has an empty side, so the prompt is empty and
the other side is all completion; rows without conv_id belong to no pair; pairs
with a null id are left out, and a conversation may be in several pairs.
Columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around each turn."""

    open: str = "<|"
    named: str = "|>\n"
    end: str = "<|end|>\n"

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.open), role, F.lit(self.named), text, F.lit(self.end))

    def before(self, role: Column) -> Column:
        """Characters of a turn that precede its text."""
        return F.length(role) + len(self.open) + len(self.named)


def preference_pairs(turns: DataFrame, pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    `turns`: conv_id, turn, role, text; `pairs`: pair_id, chosen_id, rejected_id.
    A mask is an array of (begin, end), in characters of its completion.
    """
    wanted = pairs.select("pair_id", "chosen_id", "rejected_id").dropna().dropDuplicates(["pair_id"])
    sides = wanted.select("pair_id", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("conv_id")) for i, c in enumerate(("chosen_id", "rejected_id"))])).alias("s")).select("pair_id", "s.*")
    clean = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    whole = clean.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return _rendered(whole.join(sides, "conv_id"), wanted, template)


def _rendered(whole: DataFrame, wanted: DataFrame, template: Template) -> DataFrame:
    none = F.array().cast(whole.schema["turns"].dataType)
    both = wanted
    for i, name in enumerate(("chosen", "rejected")):
        side = whole.filter(F.col("side") == i).select("pair_id", F.col("turns").alias(name))
        both = both.join(side, "pair_id", "left").withColumn(name, F.coalesce(name, none))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False)))
    differs = F.array_position(same, False)
    common = F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")
    cut = both.withColumn("n_common", common)
    parts = cut.withColumns({"shared": F.slice("chosen", F.lit(1), F.col("n_common")), **{name: F.slice(name, F.col("n_common") + 1, F.size(name)) for name in ("chosen", "rejected")}})
    return parts.select("pair_id", "chosen_id", "rejected_id", "n_common", _text(F.col("shared"), template).alias("prompt"), *[_text(F.col(n), template).alias(n) for n in ("chosen", "rejected")], *[_mask(F.col(n), template).alias(f"{n}_mask") for n in ("chosen", "rejected")])


def _text(turns: Column, template: Template) -> Column:
    return F.array_join(F.transform(turns, lambda t: template.turn(t.role, t.text)), "")


def _mask(turns: Column, template: Template) -> Column:
    """The spans of assistant turns, from their text to behind their end mark."""
    kind = "struct<at:int,spans:array<struct<begin:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")).cast(kind)

    def step(acc: Column, t: Column) -> Column:
        begin = acc.at + template.before(t.role)
        end = begin + F.length(t.text) + len(template.end)
        span = F.array(F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(t.role == "assistant", F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans")).cast(kind)

    return F.aggregate(turns, start, step, lambda acc: acc.spans)
