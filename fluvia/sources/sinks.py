"""Exports and tables: localized CSV with a byte-order mark, safe columns, clustered tables, metadata."""

from __future__ import annotations

import csv
import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions.columns import is_finite, sensitive
from fluvia.operators import flow

#: Headings of the exported products, their file names and what an export says that has no rows.
HEADINGS = {
    "monthly": {"year": "Ano", "month": "Mês", "days_in_period": "Dias no período", "days_with_value": "Dias com vazão", "days_missing": "Dias sem vazão", "failure_pct": "Falhas (%)", "q_mean": "Vazão média (m³/s)", "q_min": "Vazão mínima (m³/s)", "q_max": "Vazão máxima (m³/s)"},
    "monthly_matrix": {"label": "Ano", "m01": "Jan", "m02": "Fev", "m03": "Mar", "m04": "Abr", "m05": "Mai", "m06": "Jun", "m07": "Jul", "m08": "Ago", "m09": "Set", "m10": "Out", "m11": "Nov", "m12": "Dez", "annual": "Média"},
    "annual": {"year": "ano", "q_mean": "q_media_m3s", "days_with_value": "dias_com_vazao", "failure_pct": "falhas_pct"},
    "duration": {"escala": "escala", "permanence_pct": "permanencia_pct", "discharge_m3s": "vazao_m3s"},
    "regularization": {"cenario": "cenario", "demand_pct_qmlt": "demanda_pct_qmlt", "demand_m3s": "demanda_m3s", "regularization_volume_hm3": "volume_regularizacao_hm3"},
    "rippl": {"critical_period": "periodo_critico", "month_index": "mes_indice", "period": "periodo", "year": "ano", "month": "mes", "q_mean": "q_media_mensal_m3s", "volume_hm3": "volume_mensal_hm3", "cumulative_volume_hm3": "volume_acumulado_hm3"},
    "annual_max_simple": {"hydrological_year_label": "ano_hidrologico", "date_max": "data_maximo", "q_max_m3s": "q_max_m3s"},
    "annual_max": {
        "hydrological_year_label": "ano_hidrologico", "date_max": "data_maximo", "q_max_m3s": "q_max_m3s", "missing_pct": "falhas_pct", "rank_descending": "rank", "n_days_equal_to_max": "n_dias_iguais_ao_maximo", "dates_equal_to_max": "datas_iguais_ao_maximo", "flag_gap_near_max": "falhas_no_entorno", "outlier_label": "outlier",
        "flag_papalexiou_candidate": "candidato_a_exclusao", "flag_consistency_issue_on_max": "ocorrencia_na_consistencia", "flag_repeated_annual_max_across_years": "maximo_repetido_entre_anos", "n_flags": "n_flags", "nivel_atencao": "nivel_atencao", "flags_resumo": "flags_resumo",
    },
    "pot": {
        "event_id": "evento", "date_peak": "data_pico", "year": "ano", "q_peak_m3s": "q_pico_m3s", "threshold_m3s": "limiar_m3s", "excess_m3s": "excesso_m3s", "threshold_method": "metodo_limiar", "lambda_observed": "lambda_observado", "hypotheses_ok": "hipoteses_pot_atendidas", "message": "mensagem_diagnostico",
    },
    "low_flow": {
        "year": "ano", "duration_days": "duracao_dias", "date_start": "data_inicial", "date_end": "data_final", "date_center": "data_central", "q_min_nday_m3s": "q_minima_m3s", "month_minimum_label": "mes_minima", "missing_pct": "falhas_ano_pct", "failures_pct_month_minimum": "falhas_mes_minima_pct",
        "n_windows_expected": "janelas_possiveis", "n_windows_valid": "janelas_validas", "windows_valid_pct": "janelas_validas_pct", "rank_ascending": "rank", "n_missing_near_minimum": "n_falhas_entorno_minima", "flag_gap_near_minimum": "falhas_no_entorno", "outlier_label": "outlier", "flag_candidate_exclusion": "candidato_a_exclusao",
        "flag_consistency_issue_on_min_window": "ocorrencia_na_consistencia", "consistency_issue_types_on_min_window": "tipos_ocorrencia_consistencia", "flag_zero_or_negative_minimum": "vazao_nula_ou_negativa", "n_flags": "n_flags", "nivel_atencao": "nivel_atencao", "flags_resumo": "flags_resumo",
    },
    "issue_report": {
        "date": "data", "station_code": "codigo_estacao", "issue_group": "grupo", "code": "codigo_ocorrencia", "label": "ocorrencia", "discharge_m3s": "vazao_m3s", "stage_cm": "cota_cm", "rating_curve_segment_id": "ramo_curva", "q_generated_m3s": "q_gerada_m3s", "relative_error_pct": "erro_relativo_pct", "abs_relative_error_pct": "erro_absoluto_relativo_pct",
    },
    "rain_max_simple": {"hydrological_year": "hydrological_year", "date_center": "date_max", "p_max_mm": "p_max_mm"},
}
FILES = {
    "monthly_matrix": "vazoes_medias_mensais", "annual": "vazoes_medias_anuais", "duration": "curvas_permanencia", "regularization": "curva_regularizacao", "rippl": "diagrama_rippl", "annual_max_simple": "maximos_anuais_vazao_simples", "annual_max": "maximos_anuais_vazao_detalhado", "pot": "serie_pot_vazao", "low_flow": "vazoes_minimas",
    "issue_report": "consistencia_fluviometrica", "rain_issues": "consistencia_pluviometrica", "rain_annual": "estatisticas_anuais_pluviometricas", "rain_monthly": "estatisticas_mensais_pluviometricas", "rain_max_simple": "maximos_anuais_pluviometricos", "rain_max": "maximos_anuais_pluviometricos_detalhado",
}
NOTHING = {
    "monthly_matrix": "Nenhuma tabela mensal disponível.", "annual": "Nenhuma estatística anual disponível.", "duration": "Curvas de permanência disponíveis apenas para postos com pelo menos 5 anos de dados.", "regularization": "Curva de regularização disponível apenas para postos com pelo menos 5 anos de dados.",
    "rippl": "Diagrama de Rippl disponível apenas para postos com pelo menos 5 anos de dados.", "annual_max_simple": "Nenhum máximo anual disponível.", "annual_max": "Nenhum máximo anual disponível.", "pot": "Nenhum evento POT disponível.", "low_flow": "Nenhuma mínima anual disponível.", "issue_report": "Nenhuma ocorrência foi identificada para os critérios avaliados.",
}


def file_name(kind: str, station: str, day: date, duration_days: int | None = None) -> str:
    """The name of a product's file: what it is (with the days of low flows), the station, the day it was made."""
    what = FILES[kind] if duration_days is None else f"{FILES[kind]}_{duration_days}d"
    return f"{what}_{station}_{day:%Y%m%d}.csv"


def to_export(df: DataFrame, kind: str, digits: int = 3) -> DataFrame:
    """The columns of a product under its headings, numbers rounded half to even."""
    kinds = dict(df.dtypes)
    return df.select(*(F.bround(F.col(c), digits).alias(h) if kinds[c] == "double" else F.col(c).alias(h) for c, h in HEADINGS[kind].items() if c in kinds))


def outlier_label() -> Column:
    return F.when(F.col("flag_high_outlier_iqr"), "alto").when(F.col("flag_low_outlier_iqr"), "baixo").otherwise("")


def annual_max_export(maxima: DataFrame, simple: bool = False) -> DataFrame:
    """The annual maxima of a station under the headings of their download; the simple one has known maxima only."""
    year = F.concat((F.col("hydrological_year") - 1).cast("string"), F.lit("/"), F.col("hydrological_year").cast("string"))
    rows = maxima.withColumns({"hydrological_year_label": year, "missing_pct": 100 * F.col("missing_fraction"), "outlier_label": outlier_label()})
    return to_export(rows.where(is_finite("q_max_m3s")), "annual_max_simple") if simple else to_export(rows, "annual_max")


def low_flow_export(minima: DataFrame) -> DataFrame:
    return to_export(minima.withColumns({"missing_pct": 100 * F.col("missing_fraction"), "outlier_label": outlier_label()}), "low_flow")


def duration_export(monthly: DataFrame, annual: DataFrame) -> DataFrame:
    """Duration curves of the annual and the monthly means at each whole percent, of stations with enough years; with station_code."""
    scales = {"Anual": annual, "Mensal": monthly}
    rows = [flow.flow_duration(df.withColumn("discharge_m3s", F.col("q_mean")), [float(p) for p in range(1, 101)]).withColumn("escala", F.lit(name)) for name, df in scales.items()]
    both = rows[0].unionByName(rows[1]).join(flow.eligible(annual), "station_code", "left_semi")
    return both.select("station_code", "escala", F.col("permanence_pct").alias("permanencia_pct"), F.bround("discharge_m3s", 3).alias("vazao_m3s"))


def issue_export(report: DataFrame) -> DataFrame:
    """The issue report under the headings of its download, errors in percent."""
    return to_export(report.withColumns({"relative_error_pct": 100 * F.col("relative_error"), "abs_relative_error_pct": F.abs(100 * F.col("relative_error"))}), "issue_report")


def or_message(df: DataFrame, kind: str) -> DataFrame:
    """The rows, or one that says there are none."""
    return df.sparkSession.createDataFrame([(NOTHING[kind],)], "mensagem string") if df.isEmpty() else df


def write_localized_csv(df: DataFrame, path: str | Path, separator: str = ";", decimal: str = ",", bom: bool = True) -> int:
    """One CSV file with a byte-order mark and decimal commas; rows pass through the driver one by one. For small exports."""

    def text(v: object) -> object:
        if isinstance(v, float):
            return repr(v).replace(".", decimal) if "e" not in repr(v) else f"{v:.12f}".rstrip("0").replace(".", decimal)
        return "" if v is None else v

    n = 0
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as file:
        out = csv.writer(file, delimiter=separator)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow([text(v) for v in row])
            n += 1
    return n


def safe_columns(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Without raw and sensitive columns."""
    return df.select(*(c for c in df.columns if c not in drop and not sensitive(c)))


def write_table(df: DataFrame, path: str, cluster_by: Sequence[str] = (), partitions: int | None = None, partition_by: Sequence[str] = ()) -> None:
    """A Parquet table, ranged and sorted by its keys so that filters on them skip row groups."""
    if cluster_by:
        df = (df.repartitionByRange(partitions, *cluster_by) if partitions else df.repartitionByRange(*cluster_by)).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Puts a staged table in the target's place by renames, in any Hadoop file system; the old one goes last."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, final, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, target, f"{target}.old"))
    fs.delete(old, True)
    if fs.exists(final) and not fs.rename(final, old):
        raise OSError(f"cannot move {target} away")
    if not fs.rename(new, final):
        fs.rename(old, final)
        raise OSError(f"cannot publish {target}")
    fs.delete(old, True)


def upsert_metadata(current: DataFrame, changes: Mapping[str, str]) -> DataFrame:
    """The (key, value) table with keys replaced or added."""
    fresh = current.sparkSession.createDataFrame(sorted(changes.items()), "key string, value string")
    return current.join(fresh, "key", "left_anti").select("key", "value").union(fresh)


def write_metadata(path: str | Path, values: Mapping[str, object]) -> None:
    Path(path).write_text(json.dumps(values, ensure_ascii=False, indent=2, sort_keys=True, default=str), encoding="utf-8")


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Compares sizes and SHA-256 of files with a manifest (file, size_bytes, sha256); one row a listed file."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    return manifest.join(files, "file", "left").withColumn("ok", F.coalesce((F.col("size_bytes") == F.col("found_bytes")) & (F.lower("sha256") == F.col("found_sha256")), F.lit(False)))


def reassemble(parts: Sequence[str | Path], sha256: Sequence[str], target: str | Path, whole_sha256: str, piece: int = 1 << 20) -> Path:
    """Joins the parts of a released file in order, piece by piece, and checks each part's hash and the whole one's.

    The target appears only once all of it is right; a part or a whole that differs raises and leaves nothing behind.
    """
    target, staged, whole = Path(target), Path(f"{target}.partial"), hashlib.sha256()
    try:
        with open(staged, "wb") as out:
            for part, wanted in zip(parts, sha256, strict=True):
                own = hashlib.sha256()
                with open(part, "rb") as file:
                    while data := file.read(piece):
                        own.update(data)
                        whole.update(data)
                        out.write(data)
                if own.hexdigest() != wanted.lower():
                    raise ValueError(f"{part} is not what the manifest lists")
        if whole.hexdigest() != whole_sha256.lower():
            raise ValueError(f"{target} is not what the manifest lists")
        return staged.replace(target)
    finally:
        staged.unlink(missing_ok=True)


def create_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> SparkSession:
    """Temporary views of the session, replaced where they exist, for queries in SQL."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark


def append_rows(df: DataFrame, folder: str) -> None:
    """Appends rows to a log kept as a folder of CSV files with a heading each; a task that runs again adds nothing twice."""
    df.write.mode("append").option("header", True).csv(folder)
