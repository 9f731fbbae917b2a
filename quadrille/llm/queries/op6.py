"""The verdict on every page's url."""

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.urlfilter import Rule, judge

#: The rules, and the listed hosts.
RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]
LISTED = [f"{name}.{zone}" for name in ("casino-win", "cheap-pills", "spam-farm") for zone in ("example.com", "example.net", "example.org")]

NAME = "op6_url_filters"

SQL = f"""
WITH behind AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM behind
), judged AS (
  SELECT *, '.' || host AS dotted,
    list_has_any([array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)], {LISTED!r}) AS listed
  FROM parts
), ruled AS (
  SELECT page_id, host, path, listed, CASE
    WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM judged
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed, RULES)
