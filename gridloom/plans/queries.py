"""One query per operator over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.errors import GateError
from gridloom.functions import claims, scalar as S
from gridloom.operators import facilities, flow, focal, learning, vector, zonal
from gridloom.plans import grid as G, substrate as B
from gridloom.plans.substrate import CELLS, POINTS, RELEASES, SMOOTH, table
from gridloom.session import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---- map algebra and predicates ----

@query(f"with {CELLS} select cell_id, round(case when stream then zp - 50 else zp end, 6) as burned from cells")
def map_burn(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).select("cell_id", F.round(S.burn(F.col("zp"), F.col("stream")), 6).alias("burned"))


NAMES_SQL = "case zone when 0 then 'unmapped' when 1 then 'sfha' when 2 then 'floodway' when 3 then 'shaded_x' when 4 then 'unshaded_x' when 5 then 'D' when 6 then 'other' else 'off_grid' end"


@query(f"with {CELLS} select cell_id, zone, {NAMES_SQL} as zone_class from cells")
def zone_classify(spark, d):
    return B.cells(spark, d).select("cell_id", "zone", S.zone_name(F.col("zone")).alias("zone_class"))


@query(f"with {CELLS} select {NAMES_SQL} as zone_class, count(*) as n from cells where valid group by 1")
def zone_histogram(spark, d):
    return zonal.histogram(B.cells(spark, d), inside=F.col("valid"))


@query(f"with {CELLS} select count(*) filter (zone in (1,2)) as n_sfha, count(*) filter (zone not in (1,2)) as n_other, count(*) filter (zone = 2) as n_floodway, round(count(*) * 900 / 1e6, 6) as area_sqkm from cells where valid")
def sfha_counts(spark, d):
    c = B.cells(spark, d).where("valid").withColumn("sfha", S.sfha_band(F.col("zone")))
    n = c.agg(F.count_if(F.col("sfha") == 1).alias("n_sfha"), F.count_if(F.col("sfha") == 0).alias("n_other"), F.count_if(F.col("zone") == S.FLOODWAY).alias("n_floodway"), F.count("*").alias("_n"))
    return n.select("n_sfha", "n_other", "n_floodway", F.round(zonal.area_sqkm(F.col("_n")), 6).alias("area_sqkm"))


@query(f"with {CELLS} select cell_id, zone in (1,2) and stream or block_id = 2 as in_union, (zone in (1,2)) and not stream as in_difference from cells where (zone in (1,2) and stream or block_id = 2) or ((zone in (1,2)) and not stream)")
def mask_union(spark, d):
    sfha, stream = F.col("zone").isin(1, 2), F.col("stream")
    return B.cells(spark, d).select("cell_id", zonal.mask_union(sfha & stream, F.col("block_id") == 2).alias("in_union"), zonal.mask_difference(sfha, stream).alias("in_difference")).where("in_union or in_difference")


@query(f"with {CELLS} select cell_id from cells where valid and not (\"row\" > 0 and col > 0 and stream)")
def mask_difference(spark, d):
    inner = (F.col("row") > 0) & (F.col("col") > 0) & F.col("stream")
    return B.cells(spark, d).where(zonal.mask_difference(F.col("valid"), inner)).select("cell_id")


@query(f"with {CELLS} select count(*) as n_floodway, count(*) filter (zone not in (1,2)) as n_missing from cells where valid and zone = 2")
def floodway_subset_gate(spark, d):
    c = B.cells(spark, d).where("valid").withColumn("sfha", S.sfha_band(F.col("zone")))
    c = zonal.require_both_classes(zonal.require_floodway_in_sfha(c))
    return c.where(F.col("zone") == S.FLOODWAY).agg(F.count("*").alias("n_floodway"), F.count_if(F.col("sfha") != 1).alias("n_missing"))


@query(f"with {CELLS} select block_id, count(*) filter (valid and zone in (1,2)) as n_pos, count(*) filter (valid and zone = 4 and stream) as n_near from cells group by block_id")
def eligible_near_counts(spark, d):
    c = B.cells(spark, d).withColumn("hand", F.when(F.col("valid"), F.col("zp"))).withColumn("sfha", S.sfha_band(F.col("zone")))
    dist = F.when(F.col("stream"), F.lit(0.0)).otherwise(F.lit(300.0))
    ok = S.eligible(F.col("hand"), F.col("sfha"))
    return c.groupBy("block_id").agg(F.count_if(ok & (F.col("sfha") == 1)).alias("n_pos"), F.count_if(ok & S.near_stream_unshaded(F.col("zone"), dist, F.lit(None).cast("double"))).alias("n_near"))


@query(f"with {CELLS} select cell_id, cast(case when valid then zp else -9999 end as float) as painted from cells")
def paint_nodata(spark, d):
    return B.cells(spark, d).select("cell_id", S.paint(F.when(F.col("valid"), F.col("zp")), -9999.0).alias("painted"))


RAW_FLOAT = "case c_custkey % 6 when 0 then cast(c_custkey as varchar) || '.50' when 1 then ' 1,2' || (c_custkey % 10) || '4.25 ' when 2 then 'NA' when 3 then '' when 4 then 'x' || c_custkey else 'null' end"


@query(f"select c_custkey as key, try_cast(case when upper(trim(t)) in ('', 'NA', 'NONE', 'NULL') then null else trim(t) end as double) as value from (select c_custkey, replace({RAW_FLOAT}, ',', '') as t from customer)")
def alias_parse_float(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, F.concat(k.cast("string"), F.lit(".50"))).when(k % 6 == 1, F.concat(F.lit(" 1,2"), (k % 10).cast("string"), F.lit("4.25 "))).when(k % 6 == 2, "NA").when(k % 6 == 3, "").when(k % 6 == 4, F.concat(F.lit("x"), k.cast("string"))).otherwise("null")
    return table(spark, d, "customer").select(k.alias("key"), S.parse_float(raw).alias("value"))


@query("select c_custkey as key, case when c_name like '%7%' then 'seven' else substr(trim(split_part(c_name, '-', 1)), 1, 22) end as short from customer")
def short_names(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), S.short_name(F.col("c_name"), {"7": "seven"}).alias("short"))


BAN_SQL = {k: "regexp_matches(text, '(?i)" + v.replace("'", "''") + "')" for k, v in claims.PATTERNS.items()}


@query("select doc_id, array_to_string(list_filter([" + ",".join(f"case when {v} then '{k}' end" for k, v in BAN_SQL.items()) + ", case when contains(lower(text), 'the') then 'indy_plant_copy' end, case when contains(text, chr(8212)) then 'em_dash' end], lambda x: x is not null), ',') as hits from documents")
def claims_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(claims.scan(F.col("text"), ("THE",)), ",").alias("hits"))


TOKENS = {"article": r"(^| )the( |$)", "joined": r"(^| )(and|und|et)( |$)", "licence": r"licen[cs]ed?"}


@query("select doc_id, array_to_string(list_filter([" + ",".join(f"case when regexp_matches(text, '(?i){v}') then '{k}' end" for k, v in TOKENS.items()) + ", case when contains(text, chr(8212)) then 'em_dash' end], lambda x: x is not null), ',') as hits from documents")
def claims_scan_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(claims.scan(F.col("text"), (), TOKENS), ",").alias("hits"))


# ---- grid ----

WINDOWS_SQL = "(select c_custkey as key, c_acctbal * 3.5 as minx, c_acctbal * 2 as miny, c_acctbal * 3.5 + 100 + c_custkey as maxx, c_acctbal * 2 + 50 + c_custkey % 700 as maxy from customer)"
SNAP_SQL = f"snapped as (select key, w, s, e, n, cast(round((e - w) / 30) as int) as width, cast(round((n - s) / 30) as int) as height from (select key, floor(minx/30)*30 - 30 as w, floor(miny/30)*30 - 30 as s, ceil(maxx/30)*30 + 30 as e, ceil(maxy/30)*30 + 30 as n from {WINDOWS_SQL}))"


def windows(spark, d):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    raw = table(spark, d, "customer").select(k.alias("key"), (b * 3.5).alias("minx"), (b * 2).alias("miny"), (b * 3.5 + 100 + k).alias("maxx"), (b * 2 + 50 + k % 700).alias("maxy"))
    return raw.select("key", *G.snap_bounds(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))


@query(f"with {SNAP_SQL} select key, w::double as west, s::double as south, e::double as east, n::double as north, width, height from snapped")
def snap_bounds(spark, d):
    return windows(spark, d).select("key", *[F.col(c).cast("double").alias(c) for c in ("west", "south", "east", "north")], "width", "height")


@query(f"with {SNAP_SQL} select key, row0, col0, (w + col0 * 30)::double as tile_west, (n - row0 * 30)::double as tile_north, least(20, width - col0) as tile_w, least(20, height - row0) as tile_h from (select *, unnest(range(0, width, 20))::int as col0 from (select *, unnest(range(0, height, 20))::int as row0 from snapped))")
def tile_iter(spark, d):
    return G.tiles(windows(spark, d), 20).select("key", "row0", "col0", F.col("tile_west").cast("double").alias("tile_west"), F.col("tile_north").cast("double").alias("tile_north"), "tile_w", "tile_h")


@query("select c_custkey as key, sha256('5070|' || c_custkey || '|' || (c_custkey + 5) || '|30.0,0.0,692250.0,0.0,-30.0,2162790.0') as fingerprint from customer")
def fingerprint(spark, d):
    k = F.col("c_custkey")
    t = F.array(*[F.lit(x) for x in (30.0, 0.0, 692250.0, 0.0, -30.0, 2162790.0)])
    return table(spark, d, "customer").select(k.alias("key"), G.fingerprint_column(F.lit(5070), k, k + 5, t).alias("fingerprint"))


A = S.ALBERS
LONLAT_SQL = "(select c_custkey as key, -87.9 + (c_custkey % 997) / 1000.0::double as lon, 41.1 + (c_custkey % 389) / 400.0::double as lat from customer)"
ALBERS_SQL = f"""(select key, rho * sin(theta) as x, {A['rho0']!r} - rho * cos(theta) as y from (select key, {A['a']!r} * sqrt({A['c']!r} - {A['n']!r} * q) / {A['n']!r} as rho, {A['n']!r} * (radians(lon) - {A['lon0']!r}) as theta
  from (select key, lon, {1 - A['e2']!r} * (s / (1 - {A['e2']!r} * s * s) - ln((1 - {A['e']!r} * s) / (1 + {A['e']!r} * s)) / {2 * A['e']!r}) as q from (select key, lon, sin(radians(lat)) as s from {LONLAT_SQL}))))"""


def lonlat(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("key"), (F.lit(-87.9) + (k % 997) / F.lit(1000.0)).alias("lon"), (F.lit(41.1) + (k % 389) / F.lit(400.0)).alias("lat"))


@query(f"select key, round(x, 3) as x, round(y, 3) as y, cast(floor((2162790.0 - y) / 30) as int) as \"row\", cast(floor((x - 692250.0) / 30) as int) as col from {ALBERS_SQL}")
def albers_project(spark, d):
    x, y = S.albers(F.col("lon"), F.col("lat"))
    p = lonlat(spark, d).select("key", x.alias("x"), y.alias("y"))
    row, col = S.cell_of(F.col("x"), F.col("y"), (30.0, 0.0, 692250.0, 0.0, -30.0, 2162790.0))
    return p.select("key", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), row.alias("row"), col.alias("col"))


@query(f"with {POINTS}, {CELLS} select key, coalesce(zone, -1) as zone, case when c.cell_id is null then 'off_grid' else {NAMES_SQL} end as zone_class from points p left join cells c on p.\"row\" = c.\"row\" and p.col = c.col")
def gate_samples(spark, d):
    p = B.points(spark, d).select("key", "row", "col").join(B.cells(spark, d).select("row", "col", "zone"), ["row", "col"], "left")
    return p.select("key", F.coalesce("zone", F.lit(-1)).alias("zone"), S.zone_name(F.col("zone")).alias("zone_class"))


@query("select \"row\", col, arg_min(band, tile) as band from (select o_orderkey // 100 % 40 as \"row\", o_orderkey % 100 as col, o_orderkey // 4000 as tile, o_orderkey % 12 as band from orders) where band <> 11 group by 1, 2")
def mosaic_first_tile(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select((F.floor(k / 100) % 40).alias("row"), (k % 100).alias("col"), F.floor(k / 4000).alias("tile"), (k % 12).alias("band"))
    return G.mosaic(t, nodata=11)


@query(f"with {CELLS}, m as (select * from cells where stream and \"row\" > 5 and col > 7) select \"row\" - (select min(\"row\") from m) as \"row\", col - (select min(col) from m) as col, cell_id from m")
def crop_to_mask(spark, d):
    c = B.cells(spark, d)
    return G.crop(c, c.where("stream and row > 5 and col > 7")).select("row", "col", "cell_id")


@query("select cell_id, band from (select range as cell_id, (range // 64 + range % 64) % 101 as band from range(4096))")
def synthetic_grid(spark, d):
    return G.GridSpec.at(750000.0, 2170000.0, 64, 64).synthetic_band(spark).select("cell_id", "band")


# ---- focal ----

SLOPE_SQL = "sl as (select cell_id, valid, case when valid then atan(sqrt(dx * dx + dy * dy)) end as slope from (select *, case when w is null then (e - zz) / 30 when e is null then (zz - w) / 30 else (e - w) / 60 end as dx, case when n is null then (s - zz) / 30 when s is null then (zz - n) / 30 else (s - n) / 60 end as dy from (select *, lag(zz) over r as w, lead(zz) over r as e, lag(zz) over c as n, lead(zz) over c as s from (select *, case when valid then z else (select median(z) from src where valid) end as zz from src) window r as (partition by \"row\" order by col), c as (partition by col order by \"row\"))))"


@query(f"with {CELLS}, src as (select cell_id, \"row\", col, zp as z, valid from cells), {SLOPE_SQL} select cell_id, round(slope, 8) as slope from sl")
def slope_central(spark, d):
    return focal.slope(B.cells(spark, d), "zp").select("cell_id", F.round("slope", 8).alias("slope"))


@query(f"with {SMOOTH}, src as (select * from cells), {SLOPE_SQL} select count(*) filter (slope < 0.01) as n_below, count(slope) as n from sl")
def slope_floor_count(spark, d):
    s = focal.slope(B.smooth(spark, d))
    return s.agg(F.count_if(F.col("slope") < 0.01).alias("n_below"), F.count("slope").alias("n"))


@query(f"with {CELLS} select a.cell_id from cells a left join cells b on b.valid and abs(a.\"row\" - b.\"row\") <= 1 and abs(a.col - b.col) <= 1 where a.valid group by a.cell_id having count(b.cell_id) < 9")
def seed_boundary(spark, d):
    return focal.boundary_seeds(B.cells(spark, d)).where("seed").select("cell_id")


STEPS_SQL = "steps as (select * from (values (0,-1,0,1.0::double),(1,-1,1,sqrt(2.0)),(2,0,1,1.0),(3,1,1,sqrt(2.0)),(4,1,0,1.0),(5,1,-1,sqrt(2.0)),(6,0,-1,1.0),(7,-1,-1,sqrt(2.0))) t(k,di,dj,w))"


def d8_sql(z: str, source: str = "cells") -> str:
    return f"""d8 as materialized (select c.cell_id, c."row", c.col, c.valid, case when not c.valid then -1 when max(drop_) > 0 then arg_min(k, (-drop_, k)) else -2 end as flowdir
      from {source} c left join (select s.cell_id, k, (s.z - b.{z}) / (w * 30) as drop_ from (select cell_id, k, w, {z} as z, "row" + di as nr, col + dj as nc from {source}, steps where valid) s join {source} b on b."row" = nr and b.col = nc where b.valid) x using (cell_id) group by c.cell_id, c."row", c.col, c.valid)"""


@query(f"with recursive {CELLS}, {STEPS_SQL}, {d8_sql('zp')} select cell_id, flowdir from d8")
def d8_flowdir(spark, d):
    return focal.flow_direction(B.cells(spark, d), "zp").select("cell_id", "flowdir")


@query(f"with recursive {CELLS}, {STEPS_SQL}, {d8_sql('zt')} select flowdir, count(*) as n from d8 group by 1")
def d8_outlet_count(spark, d):
    return focal.flow_direction(B.cells(spark, d), "zt").groupBy("flowdir").agg(F.count("*").alias("n"))


@query(f"with {CELLS} select cell_id from cells a where exists (select 1 from cells b where b.block_id = 3 and b.stream and abs(a.\"row\" - b.\"row\") + abs(a.col - b.col) <= 1)")
def halo_dilate(spark, d):
    c = B.cells(spark, d).withColumn("m", (F.col("block_id") == 3) & F.col("stream"))
    return focal.dilate(c, "m").where("halo").select("cell_id")


WINDOW_SQL = f"{POINTS}, {CELLS}, near as (select p.key, c.\"row\" as r, c.col as c, c.p from points p join cells c on c.valid and abs(p.\"row\" - c.\"row\") <= 4 and abs(p.col - c.col) <= 4)"


def scored_points(spark, d):
    p = B.points(spark, d)
    return focal.window_stats(p, B.cells(spark, d).where("valid"), "p", ["key"])


@query(f"with {WINDOW_SQL} select p.key, round(max(n.p), 6) as p_max, round(avg(n.p), 6) as p_mean, count(n.p) as n_cells from points p left join near n using (key) group by p.key")
def window_stats_9x9(spark, d):
    return scored_points(spark, d).select("key", F.round("p_max", 6).alias("p_max"), F.round("p_mean", 6).alias("p_mean"), "n_cells")


@query(f"with {WINDOW_SQL} select key, r as max_row, c as max_col from (select *, row_number() over (partition by key order by p desc, r, c) as k from near) where k = 1")
def window_argmax(spark, d):
    return scored_points(spark, d).where("max_row is not null").select("key", "max_row", "max_col")


@query(f"with {CELLS} select a.cell_id, round(sqrt(min((a.\"row\" - b.\"row\") ** 2 + (a.col - b.col) ** 2)) * 30, 6) as distance from cells a, (select * from cells where stream and block_id in (2, 5)) b group by a.cell_id")
def edt_stream(spark, d):
    c = B.cells(spark, d).withColumn("m", F.col("stream") & F.col("block_id").isin(2, 5))
    return focal.euclidean_distance(c, "m").select("cell_id", F.round("distance", 6).alias("distance"))


# The two queries above keep to the streams of some blocks, as their SQL does. These take the whole stream mask, as stage B does.


@query(f"with {CELLS} select distinct a.cell_id from cells a join cells b on b.\"row\" between a.\"row\" - 1 and a.\"row\" + 1 and abs(a.\"row\" - b.\"row\") + abs(a.col - b.col) <= 1 where b.stream")
def halo_dilate_all(spark, d):
    return focal.dilate(B.cells(spark, d), "stream").where("halo").select("cell_id")


@query()
def edt_stream_all(spark, d):
    return focal.euclidean_distance(B.cells(spark, d), "stream").select("cell_id", F.round("distance", 6).alias("distance"))


# ---- flow ----

FILL_SQL = f"""seeds as (select a.cell_id from cells a left join cells b on b.valid and abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1 where a.valid group by a.cell_id, a.stream having count(b.cell_id) < 9 or a.stream),
 filled(cell_id, f) using key (cell_id) as (select cell_id, zp from cells join seeds using (cell_id)
   union select n.cell_id, min(greatest(n.zp, u.f + 0.001)) from filled u join cells c on c.cell_id = u.cell_id cross join steps join cells n on n."row" = c."row" + di and n.col = c.col + dj and n.valid left join recurring.filled old on old.cell_id = n.cell_id
   where n.cell_id not in (select cell_id from seeds) and (old.f is null or greatest(n.zp, u.f + 0.001) < old.f) group by n.cell_id)"""


def filled_cells(spark, d):
    return flow.fill_depressions(B.cells(spark, d), "zp", tile=64)


@query(f"with recursive {CELLS}, {STEPS_SQL}, {FILL_SQL} select cell_id, round(f, 9) as filled from filled")
def fill_relax(spark, d):
    return filled_cells(spark, d).where("filled is not null").select("cell_id", F.round("filled", 9).alias("filled"))


def routed(cells: DataFrame, z: str) -> DataFrame:
    c = focal.flow_direction(cells, z)
    return stored(c.withColumn("down_id", flow.downstream(B.WIDTH)), "routed")


ROUTE_SQL = "route as materialized (select d.cell_id, n.cell_id as down_id from d8 d left join steps on k = flowdir left join cells n on n.\"row\" = d.\"row\" + di and n.col = d.col + dj where d.valid)"
ACC_SQL = "walk(src, cur) as (select cell_id, down_id from route where down_id is not null union all select src, down_id from walk join route on cur = cell_id where down_id is not null), acc as (select r.cell_id, count(w.src) as acc from route r left join walk w on w.cur = r.cell_id group by r.cell_id)"


@query(f"with recursive {CELLS}, {STEPS_SQL}, {d8_sql('zt')}, {ROUTE_SQL}, {ACC_SQL} select cell_id, acc from acc")
def flow_acc(spark, d):
    return flow.flow_accumulation(routed(B.cells(spark, d), "zt"))


@query(f"with recursive {CELLS}, {STEPS_SQL}, {FILL_SQL}, fc as (select cells.*, f from cells left join filled using (cell_id)), {d8_sql('f', 'fc')}, {ROUTE_SQL}, {ACC_SQL} select cell_id, acc from acc")
def flow_acc_filled(spark, d):
    return flow.flow_accumulation(routed(filled_cells(spark, d), "filled"))


@query(f"with recursive {CELLS}, {STEPS_SQL}, {d8_sql('zt')}, {ROUTE_SQL}, {ACC_SQL}, src as (select cell_id, \"row\", col, zt as z, valid from cells), {SLOPE_SQL} select cell_id, (acc + 1) * 30.0::double as sca, round(ln((acc + 1) * 30 / tan(greatest(slope, 0.001))), 6) as twi from acc join sl using (cell_id)")
def sca_twi(spark, d):
    c = routed(B.cells(spark, d), "zt")
    acc = flow.flow_accumulation(c)
    s = focal.slope(c, "zt").select("cell_id", "slope")
    out = acc.join(s, "cell_id").withColumn("sca", S.specific_catchment(F.col("acc")))
    return out.select("cell_id", "sca", F.round(S.wetness(F.col("sca"), F.col("slope")), 6).alias("twi"))


HAND_SQL = "reach(cell_id, drain_id) as (select cell_id, cell_id from cells where valid and stream union all select r.cell_id, x.drain_id from reach x join route r on r.down_id = x.cell_id join cells c on c.cell_id = r.cell_id where not c.stream)"


@query(f"with recursive {CELLS}, {STEPS_SQL}, {d8_sql('zt')}, {ROUTE_SQL}, {HAND_SQL} select c.cell_id, case when b.zp is not null then round(greatest(c.zp - b.zp, 0), 6) end as hand from cells c left join reach using (cell_id) left join cells b on b.cell_id = drain_id where c.valid")
def hand_flow(spark, d):
    c = routed(B.cells(spark, d), "zt")
    return flow.height_above_drainage(c, "zp").where("valid").select("cell_id", F.round("hand", 6).alias("hand"))


# ---- vector ----

INSIDE_SQL = f"""{B.shape_edges_sql()}, g as (select r, c from range(40) a(r), range(40) b(c)),
 inside as (select feature, r, c from g, edges where least(-y1, -y2) - 0.5 <= r and r < greatest(-y1, -y2) - 0.5 and x1 + (-(r + 0.5) - y1) * (x2 - x1) / (y2 - y1) - 0.5 <= c group by feature, r, c having count(*) % 2 = 1)"""


@query(f"with {INSIDE_SQL} select feature, r as \"row\", c as col from inside")
def polygon_spans(spark, d):
    return vector.cells_of(vector.spans(vector.edges_of(B.shapes(spark)), *B.SHAPE_GRID)).select("feature", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query(f"with {INSIDE_SQL} select r as \"row\", c as col, 'z' || max(feature) as name from inside group by r, c")
def paint_priority(spark, d):
    return vector.rasterize(B.shapes(spark), "name", "feature", *B.SHAPE_GRID).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "name")


@query(f"""with {B.shape_edges_sql()}, pt as (select c_custkey as key, (c_custkey % 83) / 2.0::double as x, -((c_custkey // 83) % 75) / 2.0::double as y from customer),
 hit as (select key, feature, sum(case when least(y1, y2) <= y and y < greatest(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x then 1 else 0 end) as n,
   bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 and x between least(x1, x2) and greatest(x1, x2) and y between least(y1, y2) and greatest(y1, y2)) as on_ from pt, edges group by key, feature)
 select distinct key from hit where n % 2 = 1 or on_""")
def pip_clip(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("key"), ((k % 83) / F.lit(2.0)).alias("x"), (-(F.floor(k / 83) % 75) / F.lit(2.0)).alias("y"))
    return vector.points_in_polygons(p, vector.edges_of(B.shapes(spark)), ["key"]).select("key")


@query()
def touched_cells(spark, d):
    return vector.touched_cells(vector.edges_of(B.shapes(spark)), *B.SHAPE_GRID)


@query("select key, name from (select *, row_number() over (partition by key order by ordinal) as k from (select event_id as ordinal, case when event_id % 5 = 0 then null else user_id end as key, event_type as name from events)) where key is null or k = 1")
def feature_dedupe(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("user_id")).alias("key"), F.col("event_type").alias("name"))
    return zonal.dedupe_features(e, "key", "ordinal").select("key", "name")


# ---- facilities ----

@query(f"""with {RELEASES}, r as (select *, coalesce(nullif(frs, ''), nullif(trifd, ''), printf('%.5f,%.5f', lat, lon)) as key, (ordinal, frs, trifd, name, lat, lon, state) as o from releases where state <> 'OH' and lat is not null)
 select key, arg_min(name, o) as name, arg_min(lat, o) as lat, arg_min(lon, o) as lon, arg_min(state, o) as state, sum(case when held then 0 else coalesce(onsite, 0) end) as on_site_release_lb, count(*) as n_chem from r group by key""")
def facility_rollup(spark, d):
    r = B.releases(spark, d)
    return facilities.rollup(facilities.parse_releases(r, F.col("ordinal")), 2023).select("key", "name", "lat", "lon", "state", "on_site_release_lb", "n_chem")


@query(f"with {RELEASES} select count(*) as n_rows, count(*) filter (state <> 'OH') as n_in_states, count(*) filter (state = 'OH') as n_dropped_other_state, count(*) filter (state <> 'OH' and held) as n_held, count(*) filter (state <> 'OH' and off) as n_off_site, count(*) filter (state <> 'OH' and lat is null) as n_missing_xy from releases")
def rollup_budget(spark, d):
    return facilities.budget(facilities.parse_releases(B.releases(spark, d), F.col("ordinal")))


def overlaid(spark, d):
    c = B.cells(spark, d)
    zones = c.select("row", "col", "zone", F.when(F.col("stream"), 0.0).otherwise(30.0).alias("dist_flowline"), F.lit(None).cast("double").alias("dist_waterbody"))
    return facilities.overlay(B.points(spark, d), c.where("valid"), zones, ["key"])


OVERLAY_SQL = f"""{WINDOW_SQL}, top as (select key, r, c from (select *, row_number() over (partition by key order by p desc, r, c) as k from near) where k = 1),
 st as (select key, max(p) as p_max, avg(p) as p_mean from near group by key),
 ov as (select p.key, p.name, p.on_site_release_lb, p_max, p_mean, z.zone as zone, z.cell_id, case when t.key is null then 'unscored' when t.r = p."row" and t.c = p.col then 'office_pixel' when m.stream or m.zone in (1, 2) then 'adjacent_hydro_cell' else 'neighboring_land_cell' end as note,
   coalesce(z.zone = 4 and p_max is not null, false) as d1
  from points p left join st using (key) left join top t using (key) left join cells z on z."row" = p."row" and z.col = p.col left join cells m on m."row" = t.r and m.col = t.c)"""


@query(f"with {OVERLAY_SQL} select note as p_max_note, count(*) as n from ov group by 1")
def pmax_note(spark, d):
    return overlaid(spark, d).groupBy("p_max_note").agg(F.count("*").alias("n"))


@query(f"with {OVERLAY_SQL} select key, name, round(p_max, 6) as p_max, round(p_mean, 6) as p_mean, on_site_release_lb from ov where d1 order by ov.p_max desc, on_site_release_lb desc, key limit 5")
def top5_headline(spark, d):
    top = facilities.headline(overlaid(spark, d).where("d1"), "key")
    return top.select("key", "name", F.round("p_max", 6).alias("p_max"), F.round("p_mean", 6).alias("p_mean"), "on_site_release_lb")


@query(f"with {OVERLAY_SQL} select {NAMES_SQL} as zone_class, count(*) as n from ov where not d1 group by 1")
def not_d1_by_zone(spark, d):
    return facilities.not_d1_by_zone(overlaid(spark, d))


# ---- sampling, metrics, calibration ----

@query(f"""with {CELLS}, b as (select unnest(range(1, 7)) as block), t as (select block, c.*, valid and block_id = block as t from cells c, b),
 h as (select a.block, a.cell_id, case when a.t then 'test' when not a.valid or a.block_id = a.block then 'none' when exists (select 1 from t x where x.block = a.block and x.t and abs(x."row" - a."row") + abs(x.col - a.col) = 1) then 'halo' else 'train' end as part from t a)
 select block, part, count(*) as n from h group by block, part""")
def loo_block_split(spark, d):
    c = B.cells(spark, d)
    out = None
    for b in range(1, 7):
        n = learning.leave_one_block_out(c, b, "valid").groupBy("part").agg(F.count("*").alias("n")).select(F.lit(b).cast("long").alias("block"), "part", "n")
        out = n if out is None else out.union(n)
    return out


@query(f"""with {CELLS}, n as (select count(*) filter (pos) as p, count(*) filter (not pos) as q, count(*) filter (not pos and stream) as near from (select stream, cell_id % 19 = 0 as pos from cells where valid)),
 t as (select *, round_even(p * 3.0, 0)::bigint as target from n), u as (select *, case when near > 0 then least(near, greatest(target // 2, 1)) else 0 end as take from t)
 select p as n_pos, take + least(q - take, target - take) as n_neg, take <= near as near_ok from u""")
def strat_sample_counts(spark, d):
    c = B.cells(spark, d).where("valid").withColumn("pos", F.col("cell_id") % 19 == 0)
    s = learning.stratified_sample(c, "pos", "stream")
    return s.agg(F.count_if("pos").alias("n_pos"), F.count_if(~F.col("pos")).alias("n_neg"), (F.count_if(~F.col("pos") & F.col("stream")) > 0).alias("near_ok"))


SCORED_SQL = "scored as (select event_id, floor(value / 5) / 100 as p, cast((event_id * 37) % 100 < value / 3 as int) as y, cast(user_id % 3 + 1 as int) as block_id from events where event_type = 'purchase')"


def scored(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select("event_id", (F.floor(F.col("value") / 5) / 100).alias("p"), ((F.col("event_id") * 37) % 100 < F.col("value") / 3).cast("int").alias("y"), (F.col("user_id") % 3 + 1).cast("int").alias("block_id"))


def ap_sql(p: str, source: str) -> str:
    return f"(select sum(tp * ctp / cn) / sum(tp) as ap from (select tp, sum(tp) over (order by p desc)::double as ctp, sum(n) over (order by p desc)::double as cn from (select {p} as p, sum(y)::double as tp, count(*) as n from {source} where {p} is not null group by 1)))"


@query(f"with {SCORED_SQL} select round(ap, 9) as ap from {ap_sql('p', 'scored')}")
def avg_precision(spark, d):
    return learning.average_precision(scored(spark, d)).select(F.round("ap", 9).alias("ap"))


@query(f"with {SCORED_SQL} select round(avg((p - y) ** 2), 9) as brier, round(avg(y), 9) as prevalence, round(avg(p), 9) as mean_p, count(*) as n, round(avg(y) * (1 - avg(y)), 9) as brier_constant from scored")
def brier_baselines(spark, d):
    return learning.brier(scored(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("brier", "prevalence", "mean_p")], "n", F.round("brier_constant", 9).alias("brier_constant"))


@query(f"with recursive {CELLS}, {STEPS_SQL}, {d8_sql('zt')}, {ROUTE_SQL}, {HAND_SQL}, h as (select -greatest(c.zp - b.zp, 0) as p, c.y from cells c join reach using (cell_id) join cells b on b.cell_id = drain_id) select round(ap, 9) as ap from {ap_sql('p', 'h')}")
def hand_baseline_ap(spark, d):
    h = flow.height_above_drainage(routed(B.cells(spark, d), "zt"), "zp").where("valid").withColumn("p", -F.col("hand"))
    return learning.average_precision(h).select(F.round("ap", 9).alias("ap"))


def iso_sql(train: str) -> str:
    """Isotonic fit of tied scores: the greatest, over starts up to x, of the least, over ends from x on, of the mean."""
    return f"""(with t as (select p, sum(y)::double as s, count(*)::double as w from {train} group by p), c as (select p, sum(s) over (order by p) - s as s0, sum(s) over (order by p) as s1, sum(w) over (order by p) - w as w0, sum(w) over (order by p) as w1 from t),
      m as (select x.p as x, a.p as j, min((k.s1 - a.s0) / (k.w1 - a.w0)) as v from c x join c a on a.p <= x.p join c k on k.p >= x.p group by x.p, a.p) select x as p, max(v) as v from m group by x)"""


@query(f"with {SCORED_SQL} select event_id, round(v, 6) as p_cal from scored join {iso_sql('scored')} using (p)")
def isotonic_pooled(spark, d):
    s = scored(spark, d)
    return learning.apply_isotonic(learning.isotonic(s), s).select("event_id", F.round("p_cal", 6).alias("p_cal"))


NESTED_SQL = " union all ".join(f"""select event_id, case when lo.p is null then hi.v when hi.p is null or lo.p = hi.p then lo.v else lo.v + (hi.v - lo.v) * (s.p - lo.p) / (hi.p - lo.p) end as v from (select * from scored where block_id = {b}) s
 asof left join iso{b} lo on s.p >= lo.p asof left join iso{b} hi on s.p <= hi.p""" for b in (1, 2, 3))
ISO_CTES = ", ".join(f"iso{b} as {iso_sql(f'(select * from scored where block_id <> {b})')}" for b in (1, 2, 3))


@query(f"with {SCORED_SQL}, {ISO_CTES}, nested as ({NESTED_SQL}) select event_id, round(v, 6) as p_cal from nested")
def isotonic_nested(spark, d):
    return learning.isotonic_nested(scored(spark, d), [1, 2, 3]).select("event_id", F.round("p_cal", 6).alias("p_cal"))


@query(f"with {SCORED_SQL}, {ISO_CTES}, nested as ({NESTED_SQL}), n as (select round(v, 9) as p, y from nested join scored using (event_id)), q as (select round(v, 9) as p, y from scored join {iso_sql('scored')} using (p)), r as (select (select ap from {ap_sql('p', 'scored')}) as raw, (select ap from {ap_sql('p', 'n')}) as nested, (select ap from {ap_sql('p', 'q')}) as pooled) select case when abs(nested - raw) <= 0.1 then 'nested' else 'pooled' end as chosen, round(raw, 6) as ap_raw, round(case when abs(nested - raw) <= 0.1 then nested else pooled end, 6) as ap_chosen from r")
def calibration_choice(spark, d):
    s = scored(spark, d)
    ap = lambda df, c: learning.average_precision(df.withColumn("_q", F.round(c, 9)), "_q").first().ap
    raw, nested = ap(s, "p"), ap(learning.isotonic_nested(s, [1, 2, 3]), "p_cal")
    pooled = ap(learning.apply_isotonic(learning.isotonic(s), s), "p_cal")
    name, best = learning.choose_calibration(raw, nested, pooled, 0.1)
    return spark.createDataFrame([(name, round(raw, 6), round(best, 6))], "chosen string, ap_raw double, ap_chosen double")


# The five queries above keep to the purchases and to rounded scores, as their SQL does. These go over all events, with scores as they are.

SCORED_ALL_SQL = "scored as (select event_id, value / 500 as p, cast((event_id * 37) % 100 < value / 3 as int) as y from events)"


def scored_all(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("value") / 500).alias("p"), ((F.col("event_id") * 37) % 100 < F.col("value") / 3).cast("int").alias("y"), (F.col("user_id") % 3 + 1).cast("int").alias("block_id"))


@query(f"with {SCORED_ALL_SQL} select round(ap, 9) as ap from {ap_sql('p', 'scored')}")
def avg_precision_all(spark, d):
    return learning.average_precision(scored_all(spark, d)).select(F.round("ap", 9).alias("ap"))


@query(f"with {SCORED_ALL_SQL} select round(avg((p - y) ** 2), 9) as brier, round(avg(y), 9) as prevalence, round(avg(p), 9) as mean_p, count(*) as n, round(avg(y) * (1 - avg(y)), 9) as brier_constant from scored where p is not null and y is not null")
def brier_baselines_all(spark, d):
    return learning.brier(scored_all(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("brier", "prevalence", "mean_p")], "n", F.round("brier_constant", 9).alias("brier_constant"))


@query()
def isotonic_pooled_all(spark, d):
    s = scored_all(spark, d)
    return learning.apply_isotonic(learning.isotonic(s), s).select("event_id", F.round("p_cal", 6).alias("p_cal"))


@query()
def isotonic_nested_all(spark, d):
    return learning.isotonic_nested(scored_all(spark, d), [1, 2, 3]).select("event_id", F.round("p_cal", 6).alias("p_cal"))


@query()
def calibration_choice_all(spark, d):
    """By the law's own bound; what the gate refuses is `refused`, with no precision."""
    s = scored_all(spark, d)
    ap = lambda df, c: learning.average_precision(df, c).first().ap
    raw, nested = ap(s, "p"), ap(learning.isotonic_nested(s, [1, 2, 3]), "p_cal")
    pooled = ap(learning.apply_isotonic(learning.isotonic(s), s), "p_cal")
    try:
        name, best = learning.choose_calibration(raw, nested, pooled)
    except GateError:
        name, best = "refused", None
    return spark.createDataFrame([(name, round(raw, 6), best if best is None else round(best, 6))], "chosen string, ap_raw double, ap_chosen double")


def featured(spark, d):
    """The valid cells with the classifier's six features, as stage C reads them from stage B: open water stands for waterbodies.
    Each is worked out on the few columns that it needs, once, and they meet by cell."""
    c = routed(B.cells(spark, d).select("cell_id", "row", "col", "zp", "zt", "valid", "stream", "zone"), "zt")
    out = c.where("valid").select("cell_id", "zone", (F.col("zp") > 20).cast("int").alias("y"))
    parts = [focal.slope(c.select("cell_id", "row", "col", "zt", "valid"), "zt").select("cell_id", "slope"), flow.flow_accumulation(c), flow.height_above_drainage(c.select("cell_id", "down_id", "valid", "stream", "zp"), "zp").select("cell_id", "hand")]
    for name, mask in (("flowline", F.col("stream")), ("waterbody", F.col("zone") == 0)):
        far = focal.euclidean_distance(c.select("cell_id", "row", "col", mask.alias("_m")), "_m")
        parts.append(far.select("cell_id", F.coalesce("distance", F.lit(-1.0)).alias(f"dist_{name}")))
    for part in parts:
        out = out.join(part, "cell_id", "left")
    return stored(out.withColumn("twi", S.wetness(S.specific_catchment(F.col("acc")), F.col("slope"))), "features")


@query()
def boosted_trees(spark, d):
    """The operator's own fit, on the cells whose features are all defined (a height above drainage needs a stream downhill); the classifier has no SQL."""
    c = featured(spark, d)
    return learning.predict(learning.fit_classifier(c), c).select("cell_id", "p")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return top5_headline(spark, d)


from gridloom.plans import gate_queries  # noqa: E402,F401  registers its queries
