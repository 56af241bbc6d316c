"""Operators on small literal tables: nulls, ties, edges of intervals, empty input."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.operators import clean, composite, conformal, metrics, publish, resolve, robust, spatial, splits, text
from brindle.sources import bundle, listings, pages
from brindle.streaming import streams


def one(df):
    return df.first().asDict()


def test_numbers_in_swiss_notation(spark):
    df = spark.createDataFrame([("CHF 1'850.–",), ("3,5",), ("3½",), ("2’100.-",), ("1,850.50",), ("auf Anfrage",), (None,)], "x string")
    assert [r[0] for r in df.select(S.coerce_numeric("x")).collect()] == [1850.0, 3.5, 3.5, 2100.0, 1850.5, None, None]


def test_dates(spark):
    df = spark.createDataFrame([("2026-05-01",), ("01.05.2026",), ("2026-05-01T02:00:00+02:00",), ("sofort",)], "x string")
    got = [r[0] and r[0].isoformat() for r in df.select(F.date_format(S.parse_date("x"), "yyyy-MM-dd HH:mm").alias("t")).select(F.to_timestamp("t")).collect()]
    assert got == ["2026-05-01T00:00:00", "2026-05-01T00:00:00", "2026-05-01T00:00:00", None]


def test_schema_is_idempotent(spark):
    raw = spark.createDataFrame([(1, "70", "196", "2000"), (2, "50", "3,5", "0")], "listing_id long, area_sqm string, rooms string, price_cold string")
    once = clean.fix_schema(clean.conform(raw))
    twice = clean.fix_schema(once)
    assert once.columns == twice.columns and once.collect() == twice.collect()
    assert [r.rooms_invalid for r in once.orderBy("listing_id").collect()] == [True, False]
    with pytest.raises(ValueError):
        clean.conform(raw.withColumn("area", F.lit(1)))


def test_domain_limits_are_allowed(spark):
    df = spark.createDataFrame([(10.0, 300.0), (9.99, 200.0), (500.0, 15000.0), (501.0, 1.0), (None, 400.0)], "area double, price double")
    assert [r.reason for r in df.withColumn("reason", clean.domain_reason()).collect()] == [None, "area_below_min", None, "price_below_min", None]


def test_language_regions(spark):
    df = spark.createDataFrame([("VS", "Goms", None), ("FR", "Lac", "Courtepin"), ("ZH", "x", None), (None, "x", None), ("GR", "Moesa", None)], "c string, d string, m string")
    assert [r[0] for r in df.select(S.language_region("c", "d", "m")).collect()] == ["de", "fr", "de", None, "it"]


def test_decay_and_verdict(spark):
    df = spark.createDataFrame([(0.0,), (400.0,), (1400.0,), (2400.0,), (None,)], "d double")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(S.distance_decay("d")).collect()] == [1, 1, 0.5, 0, None]
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "a double").select(S.verdict("a", F.lit(2.0), F.lit(3.0)))
    assert [r[0] for r in v.collect()] == ["below", "within", "within", "above"]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    roots = resolve.components(edges, spark.range(210))
    assert {(r.id, r.root) for r in roots.collect()} == {(k, 0 if k <= 200 else k) for k in range(210)}


def test_object_ids(spark):
    rows = [
        (1, 70.0, 3.5, 2000.0, 100.0, 100.0, None, "s", "a"), (2, 72.0, None, 2100.0, 103.0, 100.0, None, "s", "b"),  # coords, rooms unknown
        (3, 70.0, 3.5, 2000.0, 5000.0, 0.0, None, "s", "a"),  # slug
        (4, 70.0, 3.5, 2000.0, 9000.0, 0.0, 1.0, "s", "d"), (5, 70.0, 3.5, 2000.0, 9000.0, 0.0, 2.0, "s", "e"),  # another building: veto
    ]
    df = spark.createDataFrame(rows, "listing_id long, area double, rooms double, price double, east double, north double, egid double, source string, slug string")
    got = {r.listing_id: r.object_id for r in resolve.assign_object_ids(df).collect()}
    assert got == {1: "obj_000001", 2: "obj_000001", 3: "obj_000001", 4: "obj_000002", 5: "obj_000003"}


def test_conformal_ranks(spark):
    nine = spark.range(1, 10).select(F.col("id").cast("double").alias("x"))
    assert one(conformal.quantile(nine, F.col("x"), 0.2))["q"] == 8.0
    assert one(conformal.quantile(spark.range(1, 100).select(F.col("id").cast("double").alias("x")), F.col("x"), 0.2))["q"] == 80.0
    assert one(conformal.quantile(nine.where("x <= 3"), F.col("x"), 0.2))["q"] == float("inf")


def test_market_percentile_edges(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 0.0), ([1.0, 2.0, 3.0], 2.0), ([1.0, 2.0, 3.0], 9.0), ([2.0, 2.0, 2.0], 2.0), ([2.0, 2.0, 2.0], 3.0), ([None, 2.0, 3.0], 2.0)], "q array<double>, v double")
    got = [r[0] if r[0] is None else round(r[0], 6) for r in df.select(metrics.market_percentile("q", [0.25, 0.5, 0.75], "v")).collect()]
    assert got == [0.01, 0.5, 0.99, 0.75, 0.99, None]


def test_zscores_fall_back(spark):
    rows = [(k, 1, 25.0 + k % 3, 1.0) for k in range(30)] + [(100 + k, 2, 50.0, 1.0) for k in range(4)] + [(200, None, None, 1.0)]
    df = spark.createDataFrame(rows, "listing_id long, municipality_id int, price double, area double")
    z = {r.listing_id: r.z for r in robust.price_zscores(df, ["municipality_id"]).collect()}
    assert z[200] is None and abs(z[1]) < 1e-9 and z[100] > 3.5


def test_publication_hides_small_units(spark):
    df = spark.createDataFrame([("a", 100.0, 10.0)] * 25 + [("b", 100.0, 10.0)] * 5, "u string, price double, area double")
    got = {r.unit_id: (r.n, r.median_rate) for r in publish.unit_stats(df, {"unit": "u"}).collect()}
    assert got == {"a": (25, 10.0), "b": (5, None)}


def test_folds_keep_groups(spark):
    df = spark.range(500).select("id", (F.col("id") % 120).alias("g"), F.when(F.col("id") % 7 == 0, "x").otherwise("y").alias("s"))
    out = splits.group_folds(df, "g", "id", stratum="s")
    assert out.count() == 500 and splits.leaking_groups(out, "fold", "g").count() == 0
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 20
    with pytest.raises(ValueError):
        splits.assert_no_leakage(df.withColumn("fold", F.col("id") % 7), "fold", "g")


def test_spatial_folds(spark):
    df = spark.range(60).select("id", (F.col("id") % 12).alias("p"), F.floor(F.col("id") / 2).alias("g"))
    out = splits.spatial_folds(df, "p", "g", "id", n=3)
    assert splits.leaking_groups(out, "fold", "p").count() == 0 and splits.leaking_groups(out, "fold", "g").count() == 0


def test_knn_against_brute_force(spark):
    import numpy as np

    xy = np.random.default_rng(0).random((80, 2)) * 1000
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "id long, east double, north double")
    got = spatial.knn_join(df, df, 3, "id", "id", 50.0, exclude_self=True).groupBy("id").agg(F.array_sort(F.collect_list("r_id")).alias("n")).collect()
    for r in got:
        d = np.hypot(*(xy - xy[r.id]).T)
        d[r.id] = np.inf
        assert sorted(np.argsort(d)[:3].tolist()) == r.n
    assert len(got) == 80


def test_polygon_snap_and_exclusion(spark):
    square = lambda x0, y0, s: [[{"x": x0, "y": y0}, {"x": x0 + s, "y": y0}, {"x": x0 + s, "y": y0 + s}, {"x": x0, "y": y0 + s}]]
    kind = "u long, rings array<array<struct<x: double, y: double>>>"
    polys = spark.createDataFrame([(2, square(0.0, 0.0, 100.0)), (1, square(200.0, 0.0, 100.0))], kind)
    lake = spark.createDataFrame([(9, square(101.0, 0.0, 20.0))], kind)
    pts = spark.createDataFrame([(1, 50.0, 50.0), (2, 130.0, 50.0), (3, 110.0, 10.0), (4, 900.0, 900.0), (5, None, 1.0)], "p long, east double, north double")
    got = {r.p: (r.u, r.match) for r in spatial.locate(pts, polys, "p", "u", 50.0, 100.0, exclude=lake).collect()}
    assert got == {1: (2, "within"), 2: (2, "nearest"), 3: (None, "none"), 4: (None, "none"), 5: (None, "none")}


def test_masking(spark):
    cases = {
        "Mail: max.muster@example.ch oder www.example.ch": "Mail: [EMAIL] oder [URL]",
        "Tel. 044 123 45 67": "Tel. [PHONE]",
        "Miete CHF 1'850.– inkl.": "Miete [PRICE] inkl.",
        "Baujahr 1995, 85 m2": "Baujahr 1995, 85 m2",
        "Kontakt: Frau Anna Muster": "Kontakt: Frau [NAME]",
        "  ": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.m for r in df.withColumn("m", text.anonymize("t")).collect()}
    assert got == cases
    again = {r.t: r.m for r in spark.createDataFrame([(v,) for v in cases.values() if v], "t string").withColumn("m", text.anonymize("t")).collect()}
    assert all(k == v for k, v in again.items())


def test_language_votes(spark):
    df = spark.createDataFrame([("Die Wohnung ist neu und hell",), ("l'appartement est très grand",), ("",), (None,), ("xyz",)], "t string")
    assert [r[0] for r in df.select(text.detect_language("t")).collect()] == ["de", "fr", "unknown", "unknown", "unknown"]


def test_attributes_and_negation(spark):
    df = spark.createDataFrame([(1, "Schöne 3.5-Zimmer-Wohnung, 85 m2, 2. OG, kein Lift, renoviert 2019"), (2, "Studio mit Lift, Seesicht und Garage, unmöbliert"), (3, None)], "id long, t string")
    got = {r.id: r for r in text.attributes(df, "id", "t").collect()}
    assert (got[1].rooms, got[1].area_sqm, got[1].floor, got[1].renovation_year, got[1].has_lift) == (3.5, 85.0, 2, 2019, False)
    assert got[2].has_lift is True and got[3].rooms is None and got[3].view is None
    assert (got[2].view, got[2].parking, got[2].is_furnished) == ("lake", "garage", False)


def test_addresses(spark):
    df = spark.createDataFrame([(1, "8044, Gockhausen-Zürich, Rütistrasse, 1"), (2, "Schellerstrasse 17, 8630 Wetzikon"), (3, None)], "id long, a string")
    got = {r.id: (r.postcode, r.locality, r.street, r.house_number) for r in text.parse_address(df, "id", "a").collect()}
    assert got == {1: (8044, "Gockhausen-Zürich", "Rütistrasse", "1"), 2: (8630, "Wetzikon", "Schellerstrasse", "17"), 3: (None, None, None, None)}


def test_address_forms(spark):
    cases = {
        "Dorfweg 4b, CH-3012 Bern, Schweiz": (3012, "Bern", "Dorfweg", "4b"),  # the country goes
        "Dorfweg **, Olten 4600": (4600, "Olten", "Dorfweg", None),  # a code behind the place, as nothing else has one
        "Dorfweg 1234, 4600 Olten": (4600, "Olten", "Dorfweg", "1234"),
        "Dorfweg 4 4600 Olten": (4600, "Olten", "Dorfweg", "4"),  # no comma
        "4600, Olten, 7 Dorfweg": (4600, "Olten", "Dorfweg", "7"),
        "Dorfweg, Dorfweg 9, Olten": (None, "Olten", "Dorfweg", "9"),  # the street again, with its number
        "4600, Olten, Dorfweg 12, 12C": (4600, "Olten", "Dorfweg", "12C"),  # the part of its own wins
        "4600, Olten, Dorfweg 12, Olten Süd": (4600, "Olten", "Dorfweg", "12"),
        "Genève, genève": (None, "Genève", None, None),
        "4600 Olten": (4600, "Olten", None, None),
        "Olten": (None, "Olten", None, None),
        "4600": (4600, None, None, None),
        "*, ,": (None, None, None, None),
    }
    got = {r.id: tuple(r)[1:] for r in text.parse_address(spark.createDataFrame([(k, k) for k in cases], "id string, a string"), "id", "a").collect()}
    assert got == cases


def test_attributes_in_context(spark):
    cases = [
        ("Keller 20 m2, Wohnfläche 70 m2", "area_sqm", 70.0, "70 m2"),
        ("Garten 300 m2", "area_sqm", None, None),
        ("Wohnung mit grosser Terrasse 120 m2", "area_sqm", 120.0, "120 m2"),
        ("Estrich im 4. Stock, Wohnung im 1. Stock", "floor", 1, "1. Stock"),
        ("im dritten Stock", "floor", 3, "dritten Stock"),
        ("2015 komplett saniert", "renovation_year", 2015, "2015 komplett saniert"),
        ("saniert, Baujahr 1960", "renovation_year", None, None),
        ("Monolocale arredato", "rooms", 1.0, "Monolocale"),
        ("Aufzug: nein", "has_lift", False, "Aufzug: nein"),
        ("ohne eigenen Balkon", "has_balcony_or_terrace", False, "ohne eigenen Balkon"),
        ("ohne Keller, mit Balkon", "has_balcony_or_terrace", True, "Balkon"),
        ("nicht weit weg vom Garten", "has_garden", True, "Garten"),  # four words on
        ("keine Garage, aber Parkplatz", "parking", "outdoor", "Parkplatz"),
        ("Zimmer in einer 4er-WG", "rent_regime", "shared_flat", "Zimmer in einer 4er-WG"),
        ("ideal als WG", "rent_regime", None, None),
        ("İ, 2.5 ZIMMER", "rooms", 2.5, "2.5 ZIMMER"),  # a letter whose lower case is longer
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, t string")
    got = {r.id: r for r in text.attributes(df, "id", "t").collect()}
    assert [(c[0], c[1], got[i][c[1]], got[i].evidence.get(c[1])) for i, c in enumerate(cases)] == cases


def test_masking_by_cues(spark):
    cases = {
        "Miete ab Mai 2025: 1700": "Miete ab Mai 2025: [PRICE]",  # the year stays, its cue reaches past it
        "Miete ab Mai 2025: Depot 2000": "Miete ab Mai 2025: Depot [PRICE]",  # a nearer cue comes first
        "NK 150, Garage 120": "NK [PRICE], Garage [PRICE]",
        "Miete für 3.5 Zimmer 1700": "Miete für 3.5 Zimmer [PRICE]",
        "Miete 100 m2": "Miete 100 m2",
        "Parkplatz in 4600 Olten": "Parkplatz in 4600 Olten",
        "Miete auf Anfrage sofort. Haus 1700": "Miete auf Anfrage sofort. Haus 1700",  # another sentence
        "Telefon 1700": "Telefon 1700",
        "Fr. 10-12 Uhr": "Fr. 10-12 Uhr",
        "Kontakt: Dr. Eva von Allmen, Herr P. Muster": "Kontakt: [NAME], Herr [NAME]",
        "Miete " + "x" * 5000 + " 1700": "Miete " + "x" * 5000 + " 1700",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("m", text.anonymize("t")).withColumn("again", text.anonymize("m"))
    rows = df.collect()
    assert {r.t: r.m for r in rows} == cases
    assert all(r.m == r.again for r in rows)


def test_price_leaks(spark):
    df = spark.createDataFrame([("für 1'850 zu haben", 1850.0), ("85 m2", 1850.0), (None, 1.0)], "t string, p double")
    assert [r[0] for r in df.select(text.price_leak("t", "p")).collect()] == [True, False, None]


def test_html(spark):
    page = '<html lang="de"><title> A <b>b</b></title><a href="/x">x</a><dl><dt>Rooms</dt><dd>3</dd><dt>Lift</dt><dd>-</dd></dl><script type="application/ld+json">{"@type": "Apartment", "description": "nice"}</script></html>'
    df = spark.createDataFrame([(1, page)], "id long, h string")
    r = df.select(pages.tag_text("h", "title").alias("t"), pages.json_ld("h", "Apartment", "description").alias("d"), pages.label_values("h").alias("m"), pages.attribute("h", "html", "lang").alias("l")).first()
    assert (r.t, r.d, r.m, r.l) == ("A b", "nice", {"Rooms": "3", "Lift": None}, "de")


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 2.0), (3, 2.0, 1.0), (4, None, 0.0)], "id long, q double, p double")
    assert {r.id: round(r.value_score, 4) for r in composite.value_score(df, "q", "p").collect()} == {1: 0.0, 2: 62.5, 3: 87.5}


def test_bundle_and_run_log(spark, tmp_path):
    units = spark.createDataFrame([("a", 1)], "u string, n int")
    bundle.Bundle(units, {"seed": 42}).save(f"{tmp_path}/b")
    again = bundle.Bundle.load(spark, f"{tmp_path}/b")
    assert again.meta == {"seed": 42} and again.units.count() == 1
    log = bundle.RunLog(spark, f"{tmp_path}/log")
    log.write("start", "r1", run_name="first", stage="s", status="RUNNING")
    log.write("metrics", "r1", metrics={"mae": 3.0}, steps={"mae": 1})
    log.write("metrics", "r1", metrics={"mae": 2.0, "bad": float("inf")}, steps={"mae": 2})
    log.write("end", "r1", status="FINISHED")
    r = log.frame().first()
    assert (r.run_name, r.status, r.metrics["mae"]) == ("first", "FINISHED", 2.0)


def test_cache_is_frozen(spark, tmp_path):
    raw = spark.createDataFrame([(1, "70", "2000", "Tel. 044 123 45 67")], "listing_id long, area_sqm string, price_cold string, description string")

    def down():
        raise listings.SourceUnavailable("down")

    first = listings.load_listings(spark, down, lambda: raw, cache=f"{tmp_path}/c")
    assert first.first().description == "Tel. [PHONE]"
    assert listings.load_listings(spark, down, lambda: raw.limit(0), cache=f"{tmp_path}/c").count() == 1


def test_upsert_stream(spark, tmp_path):
    for k, rows in enumerate([[(1, 1), (2, 1)], [(2, 2), (3, 2)]]):
        spark.createDataFrame(rows, "key long, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.file_stream(spark, f"{tmp_path}/in", "key long, seq long")
        streams.upsert_stream(stream, f"{tmp_path}/out", "key", "seq", f"{tmp_path}/check").awaitTermination()
        assert {(r.key, r.seq) for r in spark.read.parquet(f"{tmp_path}/out/v{k}").collect()} == ({(1, 1), (2, 1)} if k == 0 else {(1, 1), (2, 2), (3, 2)})


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = streams.file_stream(spark, f"{tmp_path}/e", events.schema)
    streams.to_memory(streams.windowed_counts(stream, "ts", ["event_type"]), "counts", "complete")
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_the_rest_imports_without_the_training_data_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'unit_stats_3_levels' in e.queries() and not any(k.startswith('op1') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_holm_by_group(spark):
    """Groups with a null key, ties, zeros and null p-values, against the step-down loop."""
    rows = [(g, n, None if n % 9 == 0 else (n * 37 % 50) / 400) for g in ("a", None) for n in range(80 if g else 30)]
    got = {(r.g, r.n): r.p_holm for r in metrics.holm(spark.createDataFrame(rows, "g string, n int, p double"), "p", ["g"]).collect()}
    assert len(got) == len(rows)
    for g in ("a", None):
        own, top = sorted((p, n) for h, n, p in rows if h == g and p is not None), 0.0
        for k, (p, n) in enumerate(own):
            top = max(top, min(1.0, (len(own) - k) * p))
            assert got[g, n] == pytest.approx(top)
    assert all(got[g, n] is None for g, n, p in rows if p is None)


@pytest.mark.parametrize("rows_a_step", [1, 1024])
def test_order_matches_numpy(spark, monkeypatch, rows_a_step):
    """Ranks and quantiles over groups with ties, nulls, infinities, far outliers and tight clusters."""
    import numpy as np
    from brindle.operators import order

    rng = np.random.default_rng(3)
    groups = {
        "ties": [float(x) for x in rng.integers(-5, 5, 300)],
        "wide": [float(x) for x in np.concatenate([rng.normal(1e6, 1e-3, 200), rng.normal(0, 1e-9, 200), [-1e300, 1e300]])],
        "one": [7.0],
        None: [float(x) for x in rng.lognormal(0, 4, 250)],
    }
    monkeypatch.setattr(order, "ROWS", rows_a_step)
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: (r.n, r.q) for r in order.quantiles(df, F.col("v"), shares, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs)
        assert np.allclose(got[g][1], np.quantile(vs, shares), rtol=1e-9)
    places = {(r["__k"].g, r["__v"]): (r["__before"], r["__w"]) for r in order.positions(df, F.col("v"), keys=["g"]).collect()}
    for g, vs in groups.items():
        for v in vs:
            assert places[g, v] == (sum(x < v for x in vs), vs.count(v))
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.0,), (-0.0,), (None,)], "v double")
    assert [(str(r["__v"]), r["__before"], r["__w"]) for r in order.positions(odd, F.col("v")).orderBy("__before").collect()] == [("-inf", 0, 1), ("0.0", 1, 2), ("inf", 3, 1), ("nan", 4, 1)]
    none = order.quantiles(df.where("g = 'empty'"), F.col("v"), [0.5]).collect()
    assert len(none) == 1 and none[0].q is None


def test_wilcoxon_exact_against_all_signs(spark):
    """Eleven distinct differences and a zero, against all signs; with ties the normal takes over; no difference at all."""
    from itertools import product

    from brindle.operators import inference

    d = [3.0, -1.0, 4.0, -1.5, 5.0, 9.0, -2.0, 6.0, 5.5, 3.5, 8.0, 0.0]
    df = spark.createDataFrame([(i, 0.0, 10.0 + x, 10.0) for i, x in enumerate(d)], "g int, y double, a double, b double")
    got = one(inference.wilcoxon(df, "y", "a", "b", "g"))
    used = sorted((x for x in d if x), key=abs)
    low = sum(i + 1 for i, x in enumerate(used) if x < 0)
    sums = [sum((i + 1) * s for i, s in enumerate(signs)) for signs in product((0, 1), repeat=len(used))]
    assert (got["n"], got["w_plus"], got["w_minus"]) == (11, 66 - low, low)
    assert abs(got["p"] - min(1, 2 * sum(s <= low for s in sums) / len(sums))) < 1e-12
    assert one(inference.wilcoxon(df.withColumn("a", F.col("b") + 1), "y", "a", "b", "g"))["w_plus"] == 78.0
    assert one(inference.wilcoxon(df.withColumn("a", F.col("b")), "y", "a", "b", "g"))["p"] == 1.0


def test_knn_on_a_line_and_in_clusters(spark):
    """Rows on one northing, a far pair and copies of one place find their nearest whatever the density."""
    line = [(i, 1000.0 * i, 5.0) for i in range(30)]
    town = [(100 + i, 1e7 + i % 5, 1e7 + i // 5) for i in range(25)] + [(200, 0.0, 0.0), (201, 5e6, 0.0)]
    for rows in (line, town, [(i, 1.0, 1.0) for i in range(4)]):
        df = spark.createDataFrame(rows, "id long, east double, north double")
        got = {}
        for r in spatial.knn_join(df, df, 2, "id", "id", 100.0, exclude_self=True).collect():
            got.setdefault(r.id, []).append((r["rank"], r.r_id))
        for i, x, y in rows:
            near = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in rows if j != i)[:2]
            assert [j for _, j in sorted(got[i])] == [j for _, j in near]


def test_no_order_in_one_task(spark):
    """No exchange of data rows to a single partition in the operators that need a whole order."""
    df = spark.range(5000).select("id", (F.col("id") * 7 % 997).cast("double").alias("a"), (F.col("id") * 13 % 991).cast("double").alias("b"))
    plans = [composite.value_score(df, "a", "b"), composite.weighted_quantile(df, "a", "b", 0.3), conformal.quantile(df, F.col("a"), 0.2), robust.winsor_bounds(df, ["a", "b"])]
    for p in plans:
        text = p._jdf.queryExecution().executedPlan().toString()
        assert "Window" in text
        above = [text.splitlines()[n + 1] for n, row in enumerate(text.splitlines()) if "SinglePartition" in row]
        assert all("Aggregate" in row for row in above)  # partial sums only


def test_latest_wide_and_domain(spark):
    rows = spark.createDataFrame([(1, "x", 2020, 1.0), (1, "x", 2021, None), (1, "y", 2019, 2.0), (1, "z", 2019, 9.0), (2, "y", 2018, 3.0)], "k int, v string, year int, value double")
    got = {r.k: (r.x, r.x_year, r.y, r.y_year) for r in listings.latest_wide(rows, "k", "v", "value", "year", ["x", "y"]).collect()}
    assert got == {1: (1.0, 2020, 2.0, 2019), 2: (None, None, 3.0, 2018)}
    flats = spark.createDataFrame([(10.0, 1.0), (9.9, 1.0), (50.0, 15.5), (None, 3.0), (float("nan"), 3.0)], "a double, r double")
    assert [r[0] for r in flats.select(clean.outside_domain("a", "r")).collect()] == [None, "area", "rooms", "area", "area"]


def test_power_grid_levels_come_by_runs(spark):
    """The same quantiles as an exact percentile, without a buffer that holds the column; no errors, no power."""
    from brindle.operators import inference, order

    df = spark.range(5000).select(F.when(F.col("id") % 7 > 0, (F.col("id") * 7919 % 3001) / 10 - 100).alias("e"))
    exact = df.agg(F.percentile(F.abs("e"), [k / 1000 for k in range(1001)]).alias("q")).first().q
    found = order.even_quantiles(df, F.abs("e"), 1000).first()
    assert found.n == df.where("e is not null").count() and found.q == exact
    assert order.even_quantiles(df.limit(1), F.lit(3.0), 1000).first().q == [3.0] * 1001
    grid = inference.power_grid(df, "e", [20], [0.1, 0.5], sims=5)
    assert "percentile" not in grid._jdf.queryExecution().optimizedPlan().toString()
    assert [r.power for r in inference.power_grid(df.where("e > 1000"), "e", [20], [0.1], sims=5).collect()] == [None]


def test_accessibility_joins_places(spark, monkeypatch):
    """Scores as by brute force; of crowded places and amenities few rows are joined."""
    from math import cos, hypot, pi

    rng = random.Random(8)
    points = [(k, *rng.choice([(5.0, 5.0), (30.0, 40.0), (900.0, 0.0), (None, 3.0)])) for k in range(40)]
    amenities = [(k, rng.choice("abz"), 10.0 * (k % 4), 20.0) for k in range(400)] + [(1000 + k, "a", rng.uniform(0, 90), rng.uniform(0, 90)) for k in range(300)]
    weights, joined, join = {"a": [2.0, 1.0, 0.5], "b": [1.0]}, [], spatial.radius_join

    def counted(*args):
        out = join(*args)
        joined.append(out.count())
        return out

    monkeypatch.setattr(spatial, "radius_join", counted)
    p = spark.createDataFrame(points, "id long, east double, north double")
    a = spark.createDataFrame(amenities, "amenity_id long, category string, east double, north double")
    found = {r.id: (r.acc_a, r.acc_b, r.acc_total) for r in spatial.accessibility(p, a, "id", weights, 10.0, 60.0).collect()}
    for k, x, y in points:
        raw = {}
        for c, w in weights.items():
            d = sorted(hypot(x - e, y - n) for _, kind, e, n in amenities if kind == c) if x is not None else []
            raw[c] = sum(v * 0.5 * (1 + cos(pi * max(0, min(1, (z - 10) / 50)))) for v, z in zip(w, d) if z <= 60)
        assert found[k] == pytest.approx((100 * raw["a"] / 3.5, 100 * raw["b"], 100 * (raw["a"] + raw["b"]) / 4.5))
    assert len(found) == 40 and sum(joined) < 1000


def test_weight_sensitivity_of_many_rows(spark, monkeypatch):
    """As by ranks of every draw, whole or by runs; no row for each row and draw."""
    import numpy as np

    rng = random.Random(3)
    rows = [(k, float(rng.randrange(9)), rng.random(), None if k == 5 else float(k % 4)) for k in range(200)]
    df = spark.createDataFrame(rows + [(k + 200, *r[1:]) for k, r in enumerate(rows[:80])], "id long, a double, b double, c double")
    data = np.array([r[1:] for r in df.dropna().select("id", "a", "b", "c").collect()], float)

    def ranks(v):
        s = np.sort(v)
        return (np.searchsorted(s, v) + np.searchsorted(s, v, "right") + 1) / 2

    def index(w):
        return data[:, 0] * w[0] + data[:, 1] * w[1] + data[:, 2] * w[2]

    ra, expected = ranks(index([1 / 3] * 3)), []
    for w in np.random.default_rng(42).dirichlet(np.full(3, 10.0), 7):
        rb = ranks(index(w))
        expected.append((np.corrcoef(ra, rb)[0, 1], np.abs(ra - rb).mean() / (len(ra) - 1) * 100))
    for points, bins in ((10**6, 64), (50, 64), (50, 3)):
        monkeypatch.setattr(composite, "POINTS", points)
        monkeypatch.setattr(composite, "BINS", bins)
        out = composite.weight_sensitivity(df, ["a", "b", "c"], "id", draws=7)
        found = sorted((r.draw, r.spearman, r.mean_shift) for r in out.collect())
        assert [x[0] for x in found] == list(range(7))
        assert [x[1:] for x in found] == [pytest.approx(e) for e in expected]
        assert "Join Cross" not in out._jdf.queryExecution().analyzed().toString()
    assert composite.weight_sensitivity(df.where("a > 99"), ["a", "b", "c"], "id", draws=7).count() == 0
