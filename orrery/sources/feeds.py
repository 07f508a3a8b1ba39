"""Connectors of public feeds: payload files to records or published tables, as DataFrame code.

Records have type, id, label, lon, lat, t_ms and props (JSON). The column names are
those of the feeds' own formats.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.geo import path_km
from orrery.operators.analytics import families, grid_dedupe, orbits
from orrery.operators.temporal import latest
from orrery.sources import readers

_LINE = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
KNOT = 0.514444  # metres a second


def _record(df: DataFrame, entity_type: str, ident: Column, label: Column, lon=None, lat=None, t_ms=None, **props: Column) -> DataFrame:
    none = F.lit(None)
    packed = F.to_json(F.struct(*[c.alias(n) for n, c in props.items()])) if props else F.lit("{}")
    coordinate = lambda c: none.cast("double") if c is None else c.try_cast("double")
    return df.select(F.lit(entity_type).alias("type"), ident.cast("string").alias("id"), label.cast("string").alias("label"), coordinate(lon).alias("lon"), coordinate(lat).alias("lat"), (none.cast("long") if t_ms is None else t_ms.cast("long")).alias("t_ms"), packed.alias("props"))


def _ms(text: Column, form: str | None = None) -> Column:
    ts = F.try_to_timestamp(text, F.lit(form)) if form else F.try_to_timestamp(text)
    return F.unix_millis(ts)


def earthquakes(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON feed of earthquakes; deleted ones come as retracted."""
    f = readers.geojson(spark, path, "mag double, place string, time long, status string, ids string")
    status = F.when(F.col("status") == "deleted", "retracted").otherwise(F.col("status"))
    return _record(f, "seismic.earthquake", F.col("id"), F.col("place"), F.col("lon"), F.col("lat"), F.col("time"), magnitude=F.col("mag"), status=status, ids=F.filter(F.split("ids", ","), lambda x: x != ""))


def airports(spark: SparkSession, path: str) -> DataFrame:
    c = readers.delimited(spark, path).where(F.col("type") != "closed")
    return _record(c, "transport.airport", F.col("ident"), F.col("name"), F.col("longitude_deg"), F.col("latitude_deg"), size=F.col("type"), country=F.col("iso_country"), iata=F.nullif("iata_code", F.lit("")))


def power_plants(spark: SparkSession, path: str) -> DataFrame:
    c = readers.delimited(spark, path)
    return _record(c, "energy.power_plant", F.col("gppd_idnr"), F.col("name"), F.col("longitude"), F.col("latitude"), country=F.col("country"), capacity_mw=F.col("capacity_mw").try_cast("double"), fuel=F.col("primary_fuel"))


def ports(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("ports array<struct<portNumber:long,portName:string,countryCode:string,xcoord:double,ycoord:double,harborSize:string>>").json(path, multiLine=True)
    p = raw.select(F.explode("ports").alias("p")).select("p.*")
    return _record(p, "transport.port", F.col("portNumber"), F.col("portName"), F.col("xcoord"), F.col("ycoord"), country=F.col("countryCode"), size=F.col("harborSize"))


def violence(spark: SparkSession, path: str) -> DataFrame:
    c = readers.delimited(spark, path)
    return _record(c, "conflict.violence_event", F.col("id"), F.concat_ws(" – ", "side_a", "side_b"), F.col("longitude"), F.col("latitude"), _ms(F.col("date_start").substr(1, 10), "yyyy-MM-dd"), deaths=F.col("best").try_cast("int"), kind=F.col("type_of_violence").try_cast("int"), adm_1=F.col("adm_1"))


def hotspots(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, frp, acquired: the newest, then strongest detection of each cell of 0.01 degrees; low confidence is left out."""
    c = readers.delimited(spark, path).where(~F.lower("confidence").isin("l", "low"))
    acquired = F.concat("acq_date", F.lit("T"), F.substring(F.lpad("acq_time", 4, "0"), 1, 2), F.lit(":"), F.substring(F.lpad("acq_time", 4, "0"), 3, 2))
    rows = c.select(F.col("longitude").try_cast("double").alias("lon"), F.col("latitude").try_cast("double").alias("lat"), F.col("frp").try_cast("double").alias("frp"), acquired.alias("acquired"))
    return grid_dedupe(rows, 0.01, ["acquired", "frp", "lon", "lat"]).select("lon", "lat", "frp", "acquired")


def satellites(spark: SparkSession, path: str, priority: dict[str, int] | None = None) -> DataFrame:
    """norad, name, family, apogee, perigee, period_min, regime: each object once, from the list of the least priority number."""
    c = readers.delimited(spark, path)
    order = F.lit(99)
    for name, p in (priority or {}).items():
        order = F.when(F.col("_list") == name, p).otherwise(order)
    c = c.withColumn("_list", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)?$", 1))
    one = latest(c, ["NORAD_CAT_ID"], order, F.desc("EPOCH"), F.asc("OBJECT_NAME"))
    named = one.select(F.col("NORAD_CAT_ID").cast("long").alias("norad"), F.col("OBJECT_NAME").alias("name"), F.col("MEAN_MOTION").cast("double").alias("motion"), F.col("ECCENTRICITY").cast("double").alias("ecc"))
    # Families of satellites by their names.
    found = families(named, [(r"\bdeb\b|debris|r/b", "debris"), ("^starlink", "starlink"), ("^oneweb", "oneweb"), (r"^(navstar|gps|galileo|glonass|beidou)", "navigation"), ("^iss|^css", "station")])
    return orbits(found)


def kev(spark: SparkSession, path: str) -> DataFrame:
    """cve, vendor, product, added: known exploited vulnerabilities, the newest first."""
    raw = spark.read.schema("vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,dateAdded:string>>").json(path, multiLine=True)
    v = raw.select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cveID").alias("cve"), F.col("v.vendorProject").alias("vendor"), F.col("v.product").alias("product"), F.col("v.dateAdded").alias("added"))
    return v.orderBy(F.desc("added"), "cve")


def geomagnetic(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """time_tag, kp, kind: observed and predicted index, observed ones before predictions of the same time."""
    rows = observed.select("time_tag", F.col("kp").cast("double").alias("kp"), F.lit("observed").alias("kind")).unionByName(predicted.select("time_tag", F.col("kp").cast("double").alias("kp"), F.lit("predicted").alias("kind")))
    return latest(rows, ["time_tag"], F.asc("kind"), F.asc("kp"))


def argo(spark: SparkSession, path: str) -> DataFrame:
    """platform, time, lon, lat, temp, psal: the latest profile of each float near the surface; bad values are null, bad places are left out."""
    good = lambda c: F.col(c).isin("1", "2", "5", "8")
    c = readers.delimited(spark, path).where(good("position_qc"))
    value = lambda v: F.when(good(f"{v}_qc"), F.col(v).try_cast("double"))
    rows = c.select(F.col("platform_number").alias("platform"), "time", F.col("longitude").try_cast("double").alias("lon"), F.col("latitude").try_cast("double").alias("lat"), F.col("pres").try_cast("double").alias("pres"), value("temp").alias("temp"), value("psal").alias("psal"))
    return latest(rows, ["platform"], F.desc("time"), F.asc("pres")).drop("pres")


def buoys_csv(spark: SparkSession, path: str) -> DataFrame:
    """station, time, lon, lat, wind_ms: the latest row of each station, knots as metres a second."""
    c = readers.delimited(spark, path).where(F.coalesce(F.col("QC_Flag"), F.lit("0")) != "9")
    rows = c.select(F.col("station_id").alias("station"), "time", F.col("longitude").try_cast("double").alias("lon"), F.col("latitude").try_cast("double").alias("lat"), F.round(F.col("WindSpeed").try_cast("double") * KNOT, 2).alias("wind_ms"))
    return latest(rows, ["station"], F.desc("time"))


def buoys_text(spark: SparkSession, path: str, stations: DataFrame) -> DataFrame:
    """station, t_ms, lon, lat and measures of the fixed layout of latest observations, for stations of a catalogue."""
    names = "station lat lon year month day hour minute wdir wspd gst wvht dpd apd mwd pres ptdy atmp wtmp dewp vis tide".split()
    r = readers.columns_by_header(spark, path, names)
    t = F.unix_millis(F.make_timestamp(*[F.col(c).cast("int") for c in ("year", "month", "day", "hour", "minute")], F.lit(0).cast("decimal(16,6)")))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return r.join(stations, "station", "left_semi").select("station", t.alias("t_ms"), number("lon"), number("lat"), number("wspd"), number("wvht"), number("pres"), number("wtmp"))


def tide_levels(spark: SparkSession, path: str) -> DataFrame:
    """station, time, level, quality: the last valid water level of each station."""
    raw = spark.read.schema("metadata struct<id:string,name:string>, data array<struct<t:string,v:string,q:string>>").json(path, multiLine=True)
    rows = raw.select(F.col("metadata.id").alias("station"), F.explode("data").alias("d")).select("station", F.col("d.t").alias("time"), F.col("d.v").try_cast("double").alias("level"), F.when(F.col("d.q") == "v", "verified").otherwise("preliminary").alias("quality"))
    return latest(rows.where("level IS NOT NULL"), ["station"], F.desc("time"))


def indicator_json(spark: SparkSession, path: str, aggregates: list[str]) -> DataFrame:
    """indicator, iso3, year, value of a two-part indicator answer; groups of countries and missing values are left out."""
    raw = spark.read.text(path, wholetext=True)
    row = "struct<indicator:struct<id:string>,countryiso3code:string,date:string,value:double>"
    rows = raw.select(F.explode(F.from_json(F.get_json_object("value", "$[1]"), f"array<{row}>")).alias("r"))
    rows = rows.select(F.col("r.indicator.id").alias("indicator"), F.col("r.countryiso3code").alias("iso3"), F.col("r.date").try_cast("int").alias("year"), F.col("r.value").alias("value"))
    return rows.where((F.length("iso3") == 3) & ~F.col("iso3").isin(*aggregates) & F.col("value").isNotNull())


def news_events(exports: DataFrame, mentions: DataFrame, n_links: int = 8) -> DataFrame:
    """id, code, lon, lat, articles, tone, url, links: root events with a place, one for each (root code, place, page), with the first links that mention them.

    exports and mentions are the feeds' tables with columns _c0, _c1, ... as read without a header.
    """
    c = lambda i: F.col(f"_c{i}")
    e = exports.where((c(25) == "1") & c(56).isNotNull() & c(57).isNotNull())
    e = e.select(c(0).alias("id"), c(28).alias("root"), c(26).alias("code"), c(57).try_cast("double").alias("lon"), c(56).try_cast("double").alias("lat"), c(33).try_cast("int").alias("articles"), c(34).try_cast("double").alias("tone"), c(60).alias("url"))
    e = latest(e, ["root", "lon", "lat", "url"], F.desc("articles"), F.asc("id"))
    m = mentions.where(c(3) == "1").select(c(0).alias("id"), c(5).alias("link"), c(2).alias("seen")).groupBy("id", "link").agg(F.min("seen").alias("seen"))
    m = m.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("seen", "link"))).where(F.col("_r") <= n_links)
    links = m.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "link"))), lambda x: x["link"]).alias("links"))
    return e.join(links, "id", "left")


FEEDS = {"earthquakes": earthquakes, "airports": airports, "power_plants": power_plants, "ports": ports, "violence": violence, "hotspots": hotspots, "satellites": satellites, "kev": kev, "argo": argo, "buoys_csv": buoys_csv, "tide_levels": tide_levels}


def sea_routes(lines: DataFrame) -> DataFrame:
    """Routes from rows (route, wkb): each line of a geometry as an entity of its own, with its points and length.

    A geometry that is null gives no rows.
    """

    @F.arrow_udf("array<array<struct<lon:double,lat:double>>>")
    def read(blobs: pa.Array) -> pa.Array:
        lines = [None if b is None else [[{"lon": x, "lat": y} for x, y in line] for line in readers.wkb_lines(b)] for b in blobs.to_pylist()]
        return pa.array(lines, pa.list_(_LINE))

    rows = lines.select("route", F.posexplode(read("wkb")).alias("part", "points")).where(F.size("points") >= 2)
    ident = F.concat_ws(":", F.lit("searoute"), F.col("route").cast("string"), F.col("part").cast("string"))
    first = F.get("points", F.lit(0))
    return _record(rows, "sea.route", ident, ident, first["lon"], first["lat"], points=F.col("points"), km=F.round(path_km(F.col("points")), 3))


def mapped_ways(spark: SparkSession, path: str, entity_type: str, tolerance: float = 0.01) -> DataFrame:
    """Ways of an Overpass answer (cables, naval bases) with lines simplified to a tolerance in degrees; nodes are points."""
    place = "struct<lat:double,lon:double>"
    raw = spark.read.schema(f"elements array<struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>,geometry:array<{place}>>>").json(path, multiLine=True)

    @F.arrow_udf("array<struct<lon:double,lat:double>>")
    def slim(lines: pa.Array) -> pa.Array:
        thin = [None if g is None else [{"lon": x, "lat": y} for x, y in readers.simplify([(p["lon"], p["lat"]) for p in g if p is not None], tolerance)] for g in lines.to_pylist()]
        return pa.array(thin, _LINE)

    e = raw.select(F.explode("elements").alias("e")).select("e.*").withColumn("points", slim("geometry"))
    first = F.get("points", F.lit(0))
    label = F.coalesce(F.try_element_at("tags", F.lit("name")), F.concat_ws(" ", "type", F.col("id").cast("string")))
    return _record(e.where("lat IS NOT NULL OR size(points) > 0"), entity_type, F.concat_ws(":", "type", F.col("id").cast("string")), label, F.coalesce("lon", first["lon"]), F.coalesce("lat", first["lat"]), points=F.col("points"), tags=F.col("tags"))
