"""Feeds on small made-up payloads."""

import json

from orrery.sources import feeds


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(p)


def test_records(spark, tmp_path):
    quake = {"type": "Feature", "id": "q1", "geometry": {"type": "Point", "coordinates": [10, 20, 5]}, "properties": {"mag": 6.1, "place": "sea", "time": 1709210096789, "status": "deleted", "ids": ",a,b,"}}
    r = feeds.earthquakes(spark, put(tmp_path, "q.json", {"type": "FeatureCollection", "features": [quake]})).first()
    assert (r["id"], r["lon"], r["t_ms"]) == ("q1", 10.0, 1709210096789) and json.loads(r["props"]) == {"magnitude": 6.1, "status": "retracted", "ids": ["a", "b"]}
    a = feeds.airports(spark, put(tmp_path, "a.csv", 'ident,type,name,latitude_deg,longitude_deg,iso_country,iata_code\nLIMC,large_airport,"Milan, M",45.6,8.7,IT,MXP\nX,closed,Old,0,0,IT,\n')).collect()
    assert [x["label"] for x in a] == ["Milan, M"]
    p = feeds.power_plants(spark, put(tmp_path, "p.csv", "country,name,gppd_idnr,capacity_mw,latitude,longitude,primary_fuel\nITA,P,G1,12.5,45,9,Hydro\n")).first()
    assert json.loads(p["props"])["capacity_mw"] == 12.5
    h = feeds.ports(spark, put(tmp_path, "h.json", {"ports": [{"portNumber": 7, "portName": "Genova", "xcoord": 8.9, "ycoord": 44.4}]})).first()
    assert (h["id"], h["lat"]) == ("7", 44.4)
    v = feeds.violence(spark, put(tmp_path, "v.csv", "id,side_a,side_b,latitude,longitude,date_start,best,type_of_violence,adm_1\n5,A,B,1,2,2024-02-29 00:00:00.000,3,1,Prov\n")).first()
    assert (v["label"], v["t_ms"]) == ("A – B", 1709164800000)


def test_tables(spark, tmp_path):
    fires = "latitude,longitude,frp,confidence,acq_date,acq_time\n10.001,20.001,5,h,2024-01-01,30\n10.002,20.002,9,n,2024-01-01,1230\n10.002,20.002,99,low,2024-01-02,1\n"
    assert [tuple(r) for r in feeds.hotspots(spark, put(tmp_path, "f.csv", fires)).collect()] == [(20.002, 10.002, 9.0, "2024-01-01T12:30")]
    sats = "OBJECT_NAME,NORAD_CAT_ID,EPOCH,MEAN_MOTION,ECCENTRICITY\nSTARLINK-1,1,2024-01-01,15.06,0.0001\nSTARLINK-1,1,2024-01-02,15.07,0.0001\nFENGYUN DEB,2,2024-01-01,1.0027,0.0002\n"
    got = {r["norad"]: (r["family"], r["regime"]) for r in feeds.satellites(spark, put(tmp_path, "s.csv", sats)).collect()}
    assert got == {1: ("starlink", "LEO"), 2: ("debris", "GEO")}
    k = {"vulnerabilities": [{"cveID": "C1", "dateAdded": "2024-01-01"}, {"cveID": "C2", "dateAdded": "2024-02-01"}]}
    assert [r["cve"] for r in feeds.kev(spark, put(tmp_path, "k.json", k)).collect()] == ["C2", "C1"]
    ar = "platform_number,time,latitude,longitude,pres,temp,psal,temp_qc,psal_qc,position_qc\n1,2024-01-01,1,2,5,10,35,1,4,1\n1,2024-01-02,1,2,9,11,35,1,1,1\n1,2024-01-02,1,2,3,12,35,1,4,1\n2,2024-01-01,1,2,5,10,35,1,1,4\n"
    assert [(r["platform"], r["temp"], r["psal"]) for r in feeds.argo(spark, put(tmp_path, "ar.csv", ar)).collect()] == [("1", 12.0, None)]
    b = "station_id,time,latitude,longitude,WindSpeed,QC_Flag\nM1,2024-01-01,53,-10,10,0\nM1,2024-01-02,53,-10,20,9\n"
    assert feeds.buoys_csv(spark, put(tmp_path, "b.csv", b)).first()["wind_ms"] == 5.14
    n = "#STN LAT\n#txt\n41001 34.7 -72.3 2024 02 29 12 30 180 7.0 9.0 MM MM MM MM 1013.2 MM 20.1 22.5 MM MM MM\n99999 0 0 2024 02 29 12 30 MM MM MM MM MM MM MM MM MM MM MM MM MM MM\n"
    r = feeds.buoys_text(spark, put(tmp_path, "n.txt", n), spark.createDataFrame([("41001",)], "station string")).collect()
    assert [(x["station"], x["t_ms"], x["wspd"], x["wvht"]) for x in r] == [("41001", 1709209800000, 7.0, None)]
    w = {"metadata": {"id": "8", "name": "x"}, "data": [{"t": "2024-01-01 00:00", "v": "1.5", "q": "v"}, {"t": "2024-01-01 00:06", "v": "", "q": "p"}]}
    assert tuple(feeds.tide_levels(spark, put(tmp_path, "w.json", w)).first()) == ("8", "2024-01-01 00:00", 1.5, "verified")
    i = [{"page": 1}, [{"indicator": {"id": "X"}, "countryiso3code": "ITA", "date": "2020", "value": 1.5}, {"indicator": {"id": "X"}, "countryiso3code": "WLD", "date": "2020", "value": 2}, {"indicator": {"id": "X"}, "countryiso3code": "FRA", "date": "2020", "value": None}]]
    assert [r["iso3"] for r in feeds.indicator_json(spark, put(tmp_path, "i.json", i), ["WLD"]).collect()] == ["ITA"]


def test_news(spark):
    row = lambda **k: tuple(k.get(f"_c{i}") for i in range(61))
    cols = ", ".join(f"_c{i} string" for i in range(61))
    base = {"_c25": "1", "_c26": "145", "_c28": "14", "_c33": "3", "_c34": "-1.5", "_c56": "45", "_c57": "9", "_c60": "http://x"}
    e = spark.createDataFrame([row(_c0="1", **base), row(_c0="2", **(base | {"_c33": "9"})), row(_c0="3", **(base | {"_c25": "0"})), row(_c0="4", **(base | {"_c56": None}))], cols)
    m = spark.createDataFrame([("2", "s", "3", "1", "", "http://b"), ("2", "s", "1", "1", "", "http://a"), ("2", "s", "2", "2", "", "http://c")], "_c0 string, _c1 string, _c2 string, _c3 string, _c4 string, _c5 string")
    assert [(r["id"], r["links"]) for r in feeds.news_events(e, m).collect()] == [("2", ["http://a", "http://b"])]
