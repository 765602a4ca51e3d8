"""A listing table out of the order tables, so that every listing operator can run, and be checked by SQL, on driver data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: ANSI SQL that Spark and other engines read alike.
SQL = """
select o.o_orderkey as lid, cast(substr(o.o_orderpriority, 1, 1) as int) as platform_rank, o.o_orderpriority as platform,
  concat(p.p_name, ' ', p.p_brand) as title, concat('CITY_', cast(c.c_nationkey % 7 as varchar(10))) as city,
  cast(o.o_orderdate as date) as start_d,
  case when o.o_orderkey % 5 = 0 then null else cast(o.o_orderdate as date) + cast(o.o_orderkey % 40 as int) end as end_d,
  o.o_totalprice / 20 as price_min, case when o.o_orderkey % 3 = 0 then null else o.o_totalprice / 10 end as price_max,
  o.o_orderkey % 11 = 0 as is_free, concat('https://x.test/', cast(o.o_orderkey % 5000 as varchar(20))) as url, o.o_orderstatus as status
from orders o join customer c on o.o_custkey = c.c_custkey
join (select l_orderkey, min(l_partkey) as pk from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
join part p on p.p_partkey = l.pk
"""
TABLES = ("orders", "customer", "lineitem", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, built on frames that are passed to spark.sql by name, so no temporary view is left behind."""
    text = SQL
    for name in TABLES:
        text = text.replace(f" {name} ", f" {{{name}}} ")
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in TABLES})
