from datetime import date, datetime

from pyspark.sql import functions as F

from fluvia.functions import columns as C


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


def test_numbers(spark):
    for text, expected in (("1.234,5", 1234.5), ("1,5", 1.5), ("1.5", 1.5), ("null", None), ("", None), (None, None), ("abc", None)):
        assert one(spark, text, C.parse_product_number) == expected
    assert one(spark, " 2,5 ", C.parse_series_number) == 2.5
    assert one(spark, "1.234,5", C.parse_threshold) == 1234.5


def test_codes_and_segments(spark):
    for text, expected in (("123", "00000123"), ("1234567.0", "01234567"), ("A1", "A1"), ("123456789", "123456789")):
        assert one(spark, text, C.station_code) == expected
    for text, first, last in (("02/03", 2, 3), ("2", 2, None), (None, None, None)):
        assert one(spark, text, C.parse_segment_number) == first
        assert one(spark, text, lambda c: C.parse_segment_number(c, last=True)) == last


def test_dates(spark):
    assert one(spark, "30/09/2000", C.parse_date) == date(2000, 9, 30)
    assert one(spark, "2000-09-30", C.parse_date) == date(2000, 9, 30)
    assert one(spark, "31/02/2000", C.parse_date) is None
    assert one(spark, "2000-09-30T10:20:30", C.parse_datetime) == datetime(2000, 9, 30, 10, 20, 30)
    for d, y in ((date(2000, 9, 30), 2000), (date(2000, 10, 1), 2001)):
        assert one(spark, d, C.hydrological_year, "date") == y


def test_finite_and_labels(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert df.agg(F.count(C.finite("x"))).first()[0] == 1
    assert one(spark, True, lambda c: C.labels([(F.col(c), "a"), (F.lit(None).cast("boolean"), "b")], "none"), "boolean") == "a"
    assert one(spark, False, lambda c: C.labels([(F.col(c), "a")], "none"), "boolean") == "none"
    assert one(spark, 0.0, lambda c: C.safe_divide(F.lit(1.0), c), "double") is None
    assert one(spark, "Sim", C.truthy) is True
    assert one(spark, -46.63, lambda c: C.dms(c, "E", "W"), "double") == "46° 37' 48\" W"
    assert one(spark, 5.99999, lambda c: C.dms(c, "N", "S"), "double") == "06° 00' 00\" N" and one(spark, None, lambda c: C.dms(c, "N", "S"), "double") is None
    assert one(spark, 1234.5, C.format_number_pt, "double") == "1.234,50"


def test_classes(spark):
    for v, expected in ((None, "not_available"), (0.0, "none"), (0.005, "very_low"), (0.03, "low"), (0.1, "moderate"), (0.15, "high")):
        assert one(spark, v, lambda c: C.percent_class(F.col(c)), "double") == expected
    for v, expected in ((100.0, "100%"), (75.0, "75–<100%"), (0.1, "0–<25%"), (0.0, "0%")):
        assert one(spark, v, lambda c: C.failure_class(F.col(c)), "double") == expected
    assert one(spark, None, lambda c: C.attention_class(F.col(c)), "int") == "high_attention"


def test_truth_of_numbers_texts_and_nulls(spark):
    for value, kind, expected in ((2, "int", True), (1.0, "double", True), (0, "int", False), (-1.5, "double", False), (True, "boolean", True), (False, "boolean", False), (" Sim ", "string", True), ("não", "string", False), (None, "string", False), (None, "int", False)):
        assert one(spark, value, C.truthy, kind) is expected


def test_private_columns_stay_out():
    private = ["cpf_responsavel", "CNPJ", "identificador_usuario", "access_token", "senha", "raw_file", "Raw_JSON", "source_path", "response_body", "raw_verticais", "credencial", "first_raw_file"]
    assert all(map(C.sensitive, private))
    assert not any(map(C.sensitive, ["station_code", "raw_value", "rawness", "discharge_m3s"]))


def test_values_and_headings(spark):
    from fluvia.operators import display

    cases = (
        ("x", 1234567.5, "double", "1,234,568"), ("x", 123456.78, "double", "123,456.8"), ("x", -12345.678, "double", "-12,345.68"), ("x", 1000, "int", "1,000"), ("x", 12.34567, "double", "12.346"), ("x", 100, "int", "100"), ("x", float("nan"), "double", "—"), ("x", None, "double", "—"),
        ("latitude", -22.5, "double", "22° 30' 00\" S"), ("frac_gap", 0.1234, "double", "12.3%"), ("flag_a", "sim", "string", "Sim"), ("has_a", "0", "string", "Não"), ("is_operating", "?", "string", "?"), ("b", True, "boolean", "Sim"), ("b", None, "boolean", "—"), ("t", "", "string", "—"),
        ("valid_from", "30/09/2000", "string", "2000-09-30"), ("valid_to", "soon", "string", "soon"), ("d", date(2000, 9, 30), "date", "2000-09-30"), ("t", datetime(2000, 9, 30, 1, 2, 3), "timestamp", "2000-09-30 01:02"), ("station_type", "Fluviometrica", "string", "Fluviométrica"), ("station_name", "Fluviometrica", "string", "Fluviometrica"),
    )
    for field, value, kind, expected in cases:
        df = spark.createDataFrame([(value,)], f"`{field}` {kind}")
        assert df.select(display.value_text(field, kind)).first()[0] == expected, (field, value)
    assert (display.field_label("n_flags"), display.field_label(None), display.field_label("uf", {"uf": "UF"})) == ("N flags", "Campo", "UF")
    t = display.display_table(spark.createDataFrame([(None, float("inf"), None, [1, 2])], "a_b boolean, `a b` double, s string, l array<int>"))
    assert t.columns == ["A b", "A b 1", "S", "L"] and tuple(t.first()) == ("", None, "", "[1,2]")


def test_normal_axis(spark):
    from statistics import NormalDist

    from fluvia.operators import flow

    at = [0.0, 0.1, 1.0, 7.5, 8.0, 25.0, 50.0, 92.5, 99.0, 99.9, 100.0]
    rows = spark.createDataFrame([(p,) for p in [*at, None]], "p double").select("p", flow.normal_axis("p").alias("z")).collect()
    for r in rows:
        assert r["z"] is None if r["p"] is None else abs(r["z"] - NormalDist().inv_cdf(min(max(r["p"], 0.1), 99.9) / 100)) < 1e-12
