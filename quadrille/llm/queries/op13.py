"""Conversations damaged by a hash of their turns' numbers, and repaired."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.repair import Repair

NAME, SQL = "op13_conversation_repair", None


def damaged(turns: DataFrame) -> DataFrame:
    """Of 20 kinds of crc32(`conv_id:turn`): 0 goes, 1 loses its text, 2 its sentence ends, 3 is doubled, 4 is the user's; nulls are one space."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", said["conv_id"], said["turn"]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said["role"].alias("role"), said["text"].alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return Repair(damaged(turns), turns).summary()
