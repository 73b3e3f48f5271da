"""A vault of notes made from the keys of the star schema, for operators on Markdown: the test tables hold none.

One SQL text serves Spark and the oracle. Notes of regions, nations (with an archived copy of every fifth, so that names collide) and customers link to
each other in all ways that the link graph tells apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"


def _lines(*parts: str) -> str:
    """SQL for lines of text; a part is SQL for one."""
    return "concat(" + f", {NL}, ".join(parts) + ")"


def _slug(name: str) -> str:
    return f"lower(replace({name}, ' ', '-'))"


REGION_NOTE = _lines("'---'", "concat('title: ', r_name)", "concat('tags: [region, r', CAST(r_regionkey AS STRING), ']')", "'---'", "concat('# ', r_name)", "''", "'A region of several nations. It is described elsewhere.'", "''")
NATION_NOTE = (
    "CASE n_nationkey % 6 WHEN 1 THEN concat('---', chr(10), 'title: never closed', chr(10)) WHEN 3 THEN concat('---', chr(10), 'title: [a, b', chr(10), '---', chr(10)) "
    "WHEN 5 THEN '' ELSE concat('---', chr(10), 'title: ', n_name, chr(10), 'tags:', chr(10), '  - nation', chr(10), 'key: ', CAST(n_nationkey AS STRING), chr(10), '---', chr(10)) END"
)
NATION_BODY = _lines(
    f"concat('Preamble of ', n_name, ' #nation/', {_slug('n_name')}, '.')", "concat('# ', n_name, ' #')", "''",
    f"concat('Part of [[', r_name, '|the region]] and near [[', {_slug('next_name')}, '#History]]. See #trade, not a#b.')", "''", "'## History'",
    "concat('Dr. Smith, e.g. in no. ', CAST(n_nationkey AS STRING), ', maybe agrees. It seems old! Was it? Yes.')", "'Another line of the paragraph. \"Quoted\" words end it.'", "' '", "''",
    "concat('See [a map](https://example.org/n/', CAST(n_nationkey AS STRING), ' \"Map\") and ![a picture](p.png), or [the list](list.html).')", "''",
    "'```sql'", "'SELECT 1 -- [[hidden]] #hidden'", "'```'", "'Inline `[[no]]` code.'", "'### Trade'", "'| a | b |'", "concat('Exports grew by ', CAST(n_nationkey AS STRING), ' percent. Imports fell.')",
    "'## Empty'", "''", "'# Links'", f"concat('![[regions/', {_slug('r_name')}, ']] and [[', {_slug('r_name')}, ']]')", "''",
)
CUSTOMER_BODY = _lines(
    f"concat('# Customer ', CAST(c_custkey AS STRING))", "''", f"concat('A customer in [[', {_slug('n_name')}, ']]. I think this is a ', lower(c_mktsegment), ' account.')",
    "concat('The next is [[C', CAST(c_custkey + 1 AS STRING), '.md|the next]].', CASE WHEN c_custkey % 2 = 0 THEN concat(' Before: [[customers/c', CAST(c_custkey - 1 AS STRING), ']].') ELSE '' END)", "''",
    "concat('Its balance is ', CASE WHEN c_acctbal < 0 THEN 'probably a debt. ' ELSE 'known. ' END, CASE WHEN c_custkey % 7 = 0 THEN concat('Lost: [[missing-', CAST(c_custkey % 13 AS STRING), ']].') ELSE 'Nothing is lost.' END)",
    "CASE WHEN c_custkey % 3 = 0 THEN concat('![[c', CAST(c_custkey + 1 AS STRING), ']]') WHEN c_custkey % 11 = 0 THEN concat('[[c', CAST(c_custkey AS STRING), ']]') ELSE 'No picture.' END", "''",
)

VAULT = f"""
WITH named AS (
    SELECT n_nationkey, n_name, r_name, coalesce(lead(n_name) OVER (ORDER BY n_nationkey), 'nowhere') AS next_name
    FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
)
SELECT concat('regions/', {_slug('r_name')}, '.md') AS source_rel, {REGION_NOTE} AS raw FROM {{region}}
UNION ALL SELECT concat('nations/', {_slug('n_name')}, '.md'), concat({NATION_NOTE}, {NATION_BODY}) FROM named
UNION ALL SELECT concat('archive/', {_slug('n_name')}, '.md'), concat('An old copy of [[', {_slug('n_name')}, ']].', chr(10)) FROM named WHERE n_nationkey % 5 = 0
UNION ALL SELECT concat('customers/c', CAST(c_custkey AS STRING), '.md'), {CUSTOMER_BODY} FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
"""


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_rel, raw)"""
    return spark.sql(VAULT, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("region", "nation", "customer")})


def vault_sql() -> str:
    """The same for the oracle, which has the tables by their names."""
    return VAULT.format(region="region", nation="nation", customer="customer")
