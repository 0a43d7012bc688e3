import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from fluvia.sources import readers, rest, sinks
from fluvia.streaming import telemetry

CSV = "Arquivo gerado\r\n;;\r\nEstacaoCodigo;NivelConsistencia;Data;MediaDiaria;Vazao01;Vazao02;Vazao01Status;Observação\r\n60435000;1;01/03/2020;1;10,5;;1;é\r\n60435000;2;01/02/2020;1;1.5;2,5;0;\r\n"


def check(rows):
    assert sorted((r["date"], r["value"]) for r in rows.where("value is not null").collect()) == [(date(2020, 2, 1), 1.5), (date(2020, 2, 2), 2.5), (date(2020, 3, 1), 10.5)]


def test_csv_and_zip(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(CSV.encode("iso-8859-1"))
    check(readers.read_series(spark, str(tmp_path / "a.csv"), "discharge", "hidroweb_csv"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("Vazoes_T.csv", CSV.encode("iso-8859-1"))
        z.writestr("cotas.csv", "x")
    check(readers.read_series(spark, str(tmp_path / "b.zip"), "discharge", "hidroweb_zip"))
    with pytest.raises(ValueError):
        readers.read_series(spark, str(tmp_path / "b.zip"), "rainfall", "hidroweb_zip")


def test_xml_and_json(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><SerieHistorica><EstacaoCodigo>1</EstacaoCodigo><NivelConsistencia>2</NivelConsistencia><DataHora>2020-02-01 00:00:00</DataHora><Vazao01>1.5</Vazao01></SerieHistorica></r>")
    assert [r["value"] for r in readers.read_series(spark, str(tmp_path / "a.xml"), "discharge").collect()] == [1.5]
    folder = tmp_path / "raw" / "route=q" / "station=1"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text('{"items": [{"codigoestacao": "1", "Data_Hora_Dado": "2020-02-01", "Vazao_01": "2.5"}]}')
    assert [r["value"] for r in readers.read_series(spark, str(folder / "x.json"), "discharge", "ana_json").collect()] == [2.5]
    log = spark.createDataFrame([("raw/x.json", "2021")], "raw_file string, downloaded_at string")
    r = readers.read_raw_folder(spark, str(tmp_path / "raw"), log).first()
    assert (r["route"], str(r["station"]), r["downloaded_at"]) == ("q", "1", "2021")


def test_missing_table_is_empty(spark, tmp_path):
    assert readers.read_table(spark, str(tmp_path), "none").count() == 0


def test_download_state():
    tasks = rest.yearly_tasks("1", ["q", "h"], 2019, 2030, date(2020, 6, 1))
    assert len(tasks) == 4 and tasks[-1].end == date(2020, 6, 1)
    tokens = iter(["a", "b", "c"])

    def fetch(route, station, start, end, token):
        return rest.Response(200, [{"x": 1}]) if token == "b" else rest.Response(401, message="token expirado")

    run = rest.download(tasks, fetch, lambda: next(tokens))
    assert run.paused is None and len(run.items) == 4 and len(run.log) == 5
    run = rest.download(tasks, lambda *a: rest.Response(401), lambda: "x")
    assert run.paused == "unauthorized" and len(run.pending) == 4
    run = rest.download(tasks, lambda *a: rest.Response(500), lambda: "x")
    assert run.paused == "failures" and len(run.pending) == 1
    assert len(rest.windows("1", "q", date(2000, 1, 1), date(2002, 1, 1))) == 2
    assert "tipoDados=3" in rest.legacy_url("http://x", "1", "discharge", date(2000, 1, 1), date(2000, 2, 1))


def test_data_source(spark):
    class Source(rest.SeriesSource):
        fetch = staticmethod(lambda route, station, start, end, token: rest.Response(200, [{"station": station, "v": 1}]))

    spark.dataSource.register(Source)
    df = spark.read.format("fluvia_series").option("stations", "1,2").option("routes", "q").option("start", "2000-01-01").option("end", "2000-12-31").load()
    assert sorted((r["station_code"], r["item"]["v"]) for r in df.collect()) == [("1", "1"), ("2", "1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2000, 1, 2.5, "x")], "year int, month int, q_mean double, api_token string")
    n = sinks.write_localized_csv(sinks.to_export(df, "monthly"), tmp_path / "a.csv")
    assert n == 1 and (tmp_path / "a.csv").read_bytes().startswith(b"\xef\xbb\xbf") and "2,5" in (tmp_path / "a.csv").read_text("utf-8-sig")
    assert sinks.safe_columns(df).columns == ["year", "month", "q_mean"]
    for i in (1, 2):
        sinks.write_table(df.withColumn("year", F.lit(i)), f"{tmp_path}/stage", ["year"])
        sinks.publish(spark, f"{tmp_path}/stage", f"{tmp_path}/final")
    assert spark.read.parquet(f"{tmp_path}/final").first()["year"] == 2
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in sinks.upsert_metadata(meta, {"b": "3", "c": "4"}).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("k", "2024-01-01 01:00:00", 1.0), ("k", "2024-01-01 02:00:00", 3.0), ("k", "2024-03-01 00:00:00", 9.0)], "k string, t string, v double").selectExpr("k", "to_timestamp(t) ts", "v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(f"{tmp_path}/in")
    got = []
    q = telemetry.run_batches(telemetry.daily_stats(stream, "k", "v"), lambda df, i: got.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert [(r["n_values"], r["mean"]) for r in got] == [(2, 2.0)]


def test_annual_max_download(spark, tmp_path):
    from pyspark.sql import functions as F

    from fluvia.operators import extremes
    from fluvia.sources import sinks

    grid = spark.range(800).select(F.lit("00000001").alias("station_code"), F.date_add(F.lit("2000-10-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 91).cast("double").alias("discharge_m3s"))
    maxima = extremes.annual_maxima(grid)
    full, simple = sinks.annual_max_export(maxima), sinks.annual_max_export(maxima, simple=True)
    assert full.columns == list(sinks.HEADINGS["annual_max"].values()) and simple.columns == ["ano_hidrologico", "data_maximo", "q_max_m3s"]
    assert sinks.write_localized_csv(full, tmp_path / "max.csv") == 3
    nothing = sinks.or_message(simple.limit(0), "annual_max_simple")
    assert nothing.collect()[0]["mensagem"] == "Nenhum máximo anual disponível."
    assert sinks.or_message(simple, "annual_max_simple").count() == 3


def test_attempts_and_reports():
    task = rest.Task("1", "q", date(2000, 1, 1), date(2000, 12, 31))

    def fails(*a):
        raise OSError("reset")

    assert rest.attempt(task, fails, "t").status == "failed_after_3_attempts"
    assert rest.attempt(task, lambda *a: rest.Response(200), "t").status == "empty"
    assert rest.attempt(task, lambda *a: rest.Response(200, [{"x": 1}]), "").status == "paused_auth"
    assert rest.attempt(task, lambda *a: rest.Response(401), "t").n_attempts == 1
    renewed = rest.attempt(task, lambda *a: rest.Response(200, [{"x": 1}]) if a[-1] == "new" else rest.Response(401), "old", lambda: "new")
    assert (renewed.status, renewed.n_attempts, renewed.token) == ("success", 1, "new")
    answers = iter([rest.Response(500), rest.Response(None), rest.Response(200, [{"x": 1}])])
    assert rest.attempt(task, lambda *a: next(answers), "t").n_attempts == 3


def test_download_source_is_read_as_series(spark, tmp_path):
    class Source(rest.SeriesSource):
        fetch = staticmethod(lambda route, station, start, end, token: rest.Response(200, [{"codigoestacao": station, "Data_Hora_Dado": "2020-02-01", "Vazao_01": "2.5"}]) if station == "1" else rest.Response(500, message="down"))

    spark.dataSource.register(Source)
    rows = spark.read.format("fluvia_series").option("stations", "1,2").option("routes", "q").option("start", "2020-01-01").option("end", "2020-12-31").load()
    rows.write.parquet(f"{tmp_path}/d")
    found = {r["station_code"]: (r["status"], r["n_records"], r["n_attempts"]) for r in rest.reports(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert found == {"1": ("success", 1, 1), "2": ("failed_after_3_attempts", 0, 3)}
    series = readers.read_series(spark, f"{tmp_path}/d", "discharge", "ana_api_download").where("value is not null").collect()
    assert [(r["station_code"], r["value"], r["source"]) for r in series] == [("00000001", 2.5, "ana_api_download")]


def test_parts_are_joined_and_checked(tmp_path):
    import hashlib

    parts = [b"abc" * 1000, b"", b"xyz"]
    for i, data in enumerate(parts):
        (tmp_path / f"p{i}").write_bytes(data)
    names, hashes = [tmp_path / f"p{i}" for i in range(3)], [hashlib.sha256(p).hexdigest() for p in parts]
    whole = hashlib.sha256(b"".join(parts)).hexdigest()
    assert sinks.reassemble(names, hashes, tmp_path / "db", whole.upper(), piece=7).read_bytes() == b"".join(parts)
    for bad_hashes, bad_whole in (([*hashes[:2], "0"], whole), (hashes, "0")):
        with pytest.raises(ValueError):
            sinks.reassemble(names, bad_hashes, tmp_path / "other", bad_whole)
    assert not (tmp_path / "other").exists() and not (tmp_path / "other.partial").exists()
    assert sinks.file_name("low_flow", "00000001", date(2024, 2, 3), 7) == "vazoes_minimas_7d_00000001_20240203.csv"


def test_low_flow_duration_and_matrix_downloads(spark):
    from fluvia.operators import extremes, flow

    grid = spark.range(2300).select(F.lit("00000001").alias("station_code"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (1 + F.col("id") % 91).cast("double").alias("discharge_m3s"))
    low = sinks.low_flow_export(extremes.low_flows(grid, 7))
    assert low.columns == list(sinks.HEADINGS["low_flow"].values()) and low.count() == 7
    monthly, annual = flow.monthly_stats(grid), flow.annual_stats(grid)
    curve = sinks.duration_export(monthly, annual)
    assert curve.groupBy("escala").count().count() == 2 and curve.count() == 200
    matrix = sinks.to_export(flow.monthly_matrix(monthly, annual), "monthly_matrix")
    assert matrix.columns[:3] == ["Ano", "Jan", "Fev"]
    mean = grid.agg(F.avg("discharge_m3s")).first()[0]
    assert matrix.where("Ano = 'Média'").first()["Média"] == round(mean, 3)
    short = grid.where("date < '2003-01-01'")
    assert sinks.or_message(sinks.duration_export(flow.monthly_stats(short), flow.annual_stats(short)), "duration").first()["mensagem"].startswith("Curvas de permanência")
