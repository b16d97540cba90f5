"""Grids, points and features derived from the driver's tables, so that every operator has data at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.scalar import classify_zone

WIDTH, BLOCK_COLS = 100, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a dense grid: a pitted (zp) and a tilted surface (zt), masks, blocks, labels and zone attributes."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    row = F.floor(k / WIDTH)
    zone_text = F.when(F.col("o_orderpriority") == "1-URGENT", "AE").when(F.col("o_orderpriority") == "2-HIGH", " x ").when(F.col("o_orderpriority") == "3-MEDIUM", "D").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Open Water").otherwise("B")
    subtype = F.when(F.col("o_orderstatus") == "F", "Floodway").when(F.col("o_orderstatus") == "P", "0.2 PCT ANNUAL CHANCE FLOOD HAZARD").otherwise("")
    flag = F.when(k % 7 == 0, "t").otherwise("F")
    return o.select(
        k.alias("cell_id"),
        row.cast("int").alias("row"),
        (k % WIDTH).cast("int").alias("col"),
        (F.col("o_totalprice") / 10000).alias("zp"),
        (row * F.lit(1.0) + F.col("o_totalprice") / 500000).alias("zt"),
        (k % 41 != 0).alias("valid"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("stream"),
        (F.floor((k % WIDTH) / BLOCK_COLS) + 1).cast("int").alias("block_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") / 500000).alias("p"),
        zone_text.alias("fld_zone"),
        subtype.alias("zone_subty"),
        flag.alias("sfha_tf"),
    ).withColumn("zone", classify_zone(F.col("fld_zone"), F.col("zone_subty"), F.col("sfha_tf")))


CELLS = """cells as materialized (
  select *, case when upper(trim(zone_subty)) like '%FLOODWAY%' and hazard then 2 when hazard then 1 when upper(trim(fld_zone)) = 'D' then 5
    when upper(trim(fld_zone)) = 'X' or upper(zone_subty) like '%MINIMAL FLOOD%' or zone_subty like '%0.2%'
      then case when zone_subty like '%0.2%' or upper(zone_subty) like '%SHADED%' then 3 else 4 end
    when upper(trim(fld_zone)) in ('', 'OPEN WATER', 'AREA NOT INCLUDED') or upper(fld_zone) like '%NOT INCLUDED%' then 0 else 6 end as zone
  from (select *, sfha_tf = 't' or fld_zone = 'AE' as hazard from (
    select o_orderkey as cell_id, cast(o_orderkey // 100 as int) as "row", cast(o_orderkey % 100 as int) as col, o_totalprice / 10000 as zp,
      (o_orderkey // 100) * 1.0::double + o_totalprice / 500000 as zt, o_orderkey % 41 <> 0 as valid, o_orderpriority = '1-URGENT' and o_orderstatus = 'P' as stream,
      cast((o_orderkey % 100) // 17 + 1 as int) as block_id, cast(o_orderstatus = 'F' as int) as y, o_totalprice / 500000 as p,
      case o_orderpriority when '1-URGENT' then 'AE' when '2-HIGH' then ' x ' when '3-MEDIUM' then 'D' when '4-NOT SPECIFIED' then 'Open Water' else 'B' end as fld_zone,
      case o_orderstatus when 'F' then 'Floodway' when 'P' then '0.2 PCT ANNUAL CHANCE FLOOD HAZARD' else '' end as zone_subty,
      case when o_orderkey % 7 = 0 then 't' else 'F' end as sfha_tf
    from orders)))"""


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a smooth surface 50 cells wide."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("cell_id"), F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), F.col("p_retailprice").alias("z"), (k % 41 != 0).alias("valid"))


SMOOTH = """cells as (select p_partkey as cell_id, cast(p_partkey // 50 as int) as "row", cast(p_partkey % 50 as int) as col, p_retailprice as z, p_partkey % 41 <> 0 as valid from part)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facilities, dealt over the grid and a little beyond it."""
    height = table(spark, sf_dir, "orders").agg((F.floor(F.max("o_orderkey") / WIDTH) + 1).alias("h"))
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").crossJoin(F.broadcast(height)).select(k.alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("on_site_release_lb"), ((k * 31) % (F.col("h") + 7) - 3).cast("int").alias("row"), ((k * 17) % 106 - 3).cast("int").alias("col"))  # one row


POINTS = """points as (select c_custkey as key, c_name as name, c_acctbal as on_site_release_lb, cast((c_custkey * 31) % (h + 7) - 3 as int) as "row", cast((c_custkey * 17) % 106 - 3 as int) as col
  from customer, (select max(o_orderkey) // 100 + 1 as h from orders))"""


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw release rows under the headers of a published file, all strings."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (k * 10 + n).alias("ordinal"),
        F.when(k % 9 == 0, "OH").when(k % 9 == 1, "").when(k % 9 == 2, " il ").otherwise("IN").alias("5. ST"),
        F.when(F.col("l_returnflag") == "R", "grams").otherwise("Pounds").alias("unit of measure"),
        F.when(n == 6, "Dioxin and like").otherwise("Lead").alias("CHEMICAL"),
        F.when(n == 5, "NA").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("ON-SITE RELEASE TOTAL"),
        F.when(n == 4, "1,200.5").otherwise("").alias("OFF-SITE RELEASE TOTAL"),
        F.when(n == 7, "").otherwise((F.lit(41) + F.col("l_suppkey") % 10).cast("string")).alias("LATITUDE"),
        (F.lit(-87) - F.col("l_suppkey") % 10).cast("string").alias("LONGITUDE"),
        F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("F"), F.col("l_suppkey").cast("string"))).alias("FRS ID"),
        F.when(F.col("l_suppkey") % 2 == 0, "").otherwise(F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))).alias("TRIFD"),
        F.concat(F.lit("Plant "), F.col("l_partkey").cast("string")).alias("FACILITY NAME"),
    )


RELEASES = """releases as (select l_orderkey * 10 + l_linenumber as ordinal, case l_orderkey % 9 when 0 then 'OH' when 1 then '' when 2 then 'IL' else 'IN' end as state,
  l_returnflag = 'R' or l_linenumber = 6 as held, case when l_linenumber <> 5 then cast(cast(l_quantity as int) as double) end as onsite, l_linenumber = 4 as off,
  case when l_linenumber <> 7 then cast(41 + l_suppkey % 10 as double) end as lat, cast(-87 - l_suppkey % 10 as double) as lon,
  case when l_suppkey % 3 = 0 then '' else 'F' || l_suppkey end as frs, case when l_suppkey % 2 = 0 then '' else 'T' || l_suppkey end as trifd, 'Plant ' || l_partkey as name from lineitem)"""

#: Polygons in grid units (x = column, y = -row): an L, a triangle with a hole's worth of overlap, a diamond and a sliver.
SHAPES = {
    1: [[(2.0, -2.0), (30.0, -2.0), (30.0, -12.0), (14.0, -12.0), (14.0, -30.0), (2.0, -30.0)], [(5.0, -5.0), (9.0, -5.0), (9.0, -9.0), (5.0, -9.0)]],
    2: [[(10.0, -8.0), (38.5, -20.25), (12.5, -36.0)]],
    3: [[(20.0, -4.0), (33.0, -17.0), (20.0, -30.0), (7.0, -17.0)]],
    4: [[(1.2, -33.3), (39.1, -33.9), (39.1, -34.8), (1.2, -35.1)]],
}
SHAPE_GRID = (40, 40, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0))


def shapes(spark: SparkSession) -> DataFrame:
    rows = [(k, f"z{k}", [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in SHAPES.items()]
    return spark.createDataFrame(rows, "feature int, name string, rings array<array<struct<x:double,y:double>>>")


def shape_edges_sql() -> str:
    out = []
    for k, rings in SHAPES.items():
        for ring in rings:
            out += [f"({k},{x1!r}::double,{y1!r}::double,{x2!r}::double,{y2!r}::double)" for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])]
    return f"edges as (select * from (values {','.join(out)}) t(feature,x1,y1,x2,y2))"
