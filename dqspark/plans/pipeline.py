"""Configured runs: profile, clean, validate; with checks before, artefacts after, a log, and a command line."""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import Contract
from ..operators import anomaly, classify, cleaning, drift, features, inference, profile, rules
from ..sources import tables
from .report import evaluation_markdown

DEFAULTS = {
    "paths": {"input": None, "output": None},
    "profiling": {"rows": 0, "heatmap_rows": 1000},
    "cleaning": {"imputation_method": "statistical+knn", "knn_neighbors": 5, "fuzzy_threshold": 0.90},
    "validation": {"contamination": 0.01, "classifier_sample_n": 5000, "years": [2009, 2010], "window": ["2009-01-01 00:00:00", "2011-12-31 23:59:59"], "contract": "fixed"},
    "logging": {"level": "INFO", "console": True, "file": None},
    "pipeline": {"stop_on_stage_failure": True},
}
LOG = logging.getLogger("dqspark")
#: What each stage reads of the config, and the files that it writes.
CONTRACTS = {
    "profiling": {"params": ["profiling.rows", "profiling.heatmap_rows"], "outputs": ["profiling_report.json", "expected_schema.json"]},
    "cleaning": {"params": ["cleaning.imputation_method", "cleaning.knn_neighbors", "cleaning.fuzzy_threshold"], "outputs": ["cleaned.parquet", "cleaning_report.json"]},
    "validation": {"params": ["validation.contamination", "validation.classifier_sample_n", "validation.years", "validation.window", "validation.contract"], "outputs": ["validation_report.json", "evaluation_report.md"]},
}


def validate_config(config: dict) -> dict:
    """The config with defaults filled in; all that is wrong is said at once."""
    wrong, out = [], {}
    if not isinstance(config, dict):
        raise ValueError("the config is no mapping")
    for section, values in DEFAULTS.items():
        own = config.get(section)
        if not isinstance(own, dict):
            wrong.append(f"section {section} is missing or no mapping")
            own = {}
        out[section] = values | own
    whole = lambda x, least: isinstance(x, int) and not isinstance(x, bool) and x >= least
    part = lambda x, top: isinstance(x, (int, float)) and not isinstance(x, bool) and 0 < x and (x < 1 or top and x == 1)
    c, v = out["cleaning"], out["validation"]
    checks = [
        (isinstance(out["paths"]["input"], str), "paths.input is no path"), (isinstance(out["paths"]["output"], str), "paths.output is no path"),
        (whole(out["profiling"]["rows"], 0), "profiling.rows is below 0 or no whole number"), (whole(out["profiling"]["heatmap_rows"], 1), "profiling.heatmap_rows is below 1 or no whole number"),
        (c["imputation_method"] == "statistical+knn", "cleaning.imputation_method is unknown"), (whole(c["knn_neighbors"], 1), "cleaning.knn_neighbors is below 1 or no whole number"), (part(c["fuzzy_threshold"], True), "cleaning.fuzzy_threshold is outside (0, 1]"),
        (part(v["contamination"], False), "validation.contamination is outside (0, 1)"), (whole(v["classifier_sample_n"], 1), "validation.classifier_sample_n is below 1 or no whole number"),
        (v["contract"] in ("fixed", "inferred"), "validation.contract is neither fixed nor inferred"), (out["logging"]["file"] is None or isinstance(out["logging"]["file"], str), "logging.file is no path"),
        (str(out["logging"]["level"]).upper() in logging.getLevelNamesMapping(), "logging.level is unknown"), (isinstance(out["pipeline"]["stop_on_stage_failure"], bool), "pipeline.stop_on_stage_failure is neither true nor false"),
    ]
    if wrong := wrong + [say for good, say in checks if not good]:
        raise ValueError("; ".join(wrong))
    return out


def load_config(path: str) -> dict:
    return validate_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def logger(level: str = "INFO", console: bool = True, file: str | None = None) -> logging.Logger:
    LOG.setLevel(level.upper())
    for h in list(LOG.handlers):
        LOG.removeHandler(h)
        h.close()
    for h in ([logging.StreamHandler()] if console else []) + ([logging.FileHandler(file, encoding="utf-8")] if file else []):
        h.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s"))
        LOG.addHandler(h)
    return LOG


@contextmanager
def stage(name: str, summary: dict) -> Iterator[None]:
    began = time.time()
    LOG.info("START %s", name)
    try:
        yield
    except Exception as e:
        summary[name] = {"status": "failed", "error": str(e)[:500], "seconds": round(time.time() - began, 2)}
        LOG.error("FAILED %s after %.1f s: %s", name, time.time() - began, e)
        raise
    summary[name] = {"status": "ok", "seconds": round(time.time() - began, 2)}
    LOG.info("DONE %s in %.1f s", name, time.time() - began)


def _rows(df: DataFrame) -> list[dict]:
    """A report's few rows."""
    return [r.asDict(recursive=True) for r in df.collect()]


def profile_report(df: DataFrame, heatmap_rows: int = 1_000) -> dict:
    numeric, own = ["Quantity", "UnitPrice"], df.drop("row_id").cache()
    flags = profile.flags(own).cache()
    parts = {
        "columns": profile.column_profile(own), "types": profile.infer_dtype(own), "semantics": profile.infer_semantic(own), "mixed": profile.mixed_type(own), "consistency": profile.dtype_consistency(own), "missing": profile.missing_per_column(own), "missing_rows": profile.missing_per_row(own), "missing_total": profile.missing_total(own),
        "heatmap": profile.missing_heatmap(df, heatmap_rows), "cardinality": profile.cardinality(own), "top": profile.top_values(own), "numeric": profile.numeric_summary(own, numeric), "outliers": profile.iqr_outliers(own, numeric), "correlation": profile.corr_long(own, numeric), "flags": flags, "summary": profile.flag_summary(flags), "pii": profile.pii_columns(own),
    }
    out = {k: _rows(v) for k, v in parts.items()}
    flags.unpersist()
    own.unpersist()
    return out


def validation_report(df: DataFrame, contract: Contract, drift_years: tuple[int, int], contamination: float = 0.01, classifier_sample_n: int | None = None) -> dict:
    sev = rules.rows_by_severity(df, contract)
    one = _rows(sev.withColumn("error_severity", rules.error_severity()))[0]
    if not one["n_rows"]:
        raise ValueError("no rows to validate")
    q = _rows(features.quality(df, contract))[0]
    d = _rows(drift.verdict(df, drift_years))[0]
    a = _rows(anomaly.severity(df, ["Quantity", "UnitPrice"], contamination))[0]
    return {
        "rules": _rows(rules.counts(df, contract)), "findings": _rows(rules.findings(df, contract)), "examples": _rows(rules.examples(df, 3, contract)), "severity": one, "anomaly": a, "quality": q, "drift": d | {"measures": _rows(drift.measures(df, drift_years)), "shares": _rows(drift.shares(df, drift_years))},
        "columns": _rows(classify.classify(df, [c for c in tables.CANONICAL if c in df.columns], classifier_sample_n)), "health": features.health(one["n_rows"], one["n_hard"], one["n_review"], a["n_both"], d["max_rel_change"]),
        "actions": actions(one, d, a),
    }


def actions(severity: dict, d: dict, a: dict) -> list[str]:
    said = [(severity["n_hard"] > 0, f"Quarantine {severity['n_hard']} rows that break hard rules."), (severity["n_review"] > 0, f"Review {severity['n_review']} rows that break review rules."), (a["n_both"] > 0, f"Look at {a['n_both']} rows that both outlier models flag."), (d["verdict"] == "alert", "Look into the measures whose drift is an alert."), (d["verdict"] == "watch", "Watch the measures that drift.")]
    return [s for on, s in said if on] or ["Nothing to do."]


def run(spark: SparkSession, config: dict, dry: bool = False) -> dict:
    """All stages; a summary by stage. The cleaned table and three reports are written to the output folder."""
    config = validate_config(config)
    source, out = config["paths"]["input"], config["paths"]["output"].rstrip("/")
    summary: dict = {}
    if "://" not in source and not Path(source).exists():
        raise FileNotFoundError(source)
    logger(config["logging"]["level"], config["logging"]["console"], config["logging"]["file"])
    if dry:
        return {"dry_run": True}
    at = lambda name: f"{out}/{name}"
    tables.save_text(spark, yaml.safe_dump(config), at("run_config.yaml"))
    c, v = config["cleaning"], config["validation"]
    state: dict = {"contract": Contract(window=tuple(v["window"]), years=tuple(v["years"])), "raw": tables.load(spark, source, config["profiling"]["rows"] or None)}
    measures = ["Quantity", "UnitPrice"]

    def profiling() -> None:
        tables.save_json(profile_report(state["raw"], config["profiling"]["heatmap_rows"]), at("profiling_report.json"), spark)
        schema = inference.schema(state["raw"], state["contract"])
        tables.save_json(schema, at("expected_schema.json"), spark)
        if v["contract"] == "inferred":
            state["contract"] = inference.from_schema(schema, state["contract"])

    def clean() -> None:
        raw, contract = state["raw"], state["contract"]
        features.extract(cleaning.clean(raw)).write.mode("overwrite").parquet(at("cleaned.parquet"))
        done = spark.read.parquet(at("cleaned.parquet"))
        report = {"before": features.quality(raw, contract), "after": features.quality(done, contract), "duplicates": cleaning.duplicate_groups(cleaning.normalise(raw)), "imputation": anomaly.knn_verify(raw, k=c["knn_neighbors"]), "near_duplicates": cleaning.near_groups(done, c["fuzzy_threshold"]), "changes": cleaning.normalise_log(raw)}
        one = ("before", "after", "duplicates", "imputation")
        tables.save_json({k: _rows(x)[0] if k in one else _rows(x) for k, x in report.items()}, at("cleaning_report.json"), spark)

    def validate() -> None:
        done = spark.read.parquet(at("cleaned.parquet"))
        tables.save_json(validation_report(done, state["contract"], tuple(v["years"]), v["contamination"], v["classifier_sample_n"]), at("validation_report.json"), spark)
        models, recalls = _rows(anomaly.evaluate(done, measures, v["contamination"])), _rows(anomaly.recall_by_model(done, measures, v["contamination"]))
        tables.save_text(spark, evaluation_markdown(models, recalls, v["contamination"]), at("evaluation_report.md"))

    stages = [("profiling", profiling), ("cleaning", clean), ("validation", validate)]
    failed = []
    for name, work in stages:
        try:
            with stage(name, summary):
                work()
        except Exception as e:
            failed.append(f"{name}: {e}")
            if config["pipeline"]["stop_on_stage_failure"]:
                break
    if failed:
        raise RuntimeError("; ".join(failed))
    missing = [f for stage_ in CONTRACTS.values() for f in stage_["outputs"] if not tables.exists(spark, at(f))]
    if missing:
        raise RuntimeError(f"missing artefacts: {missing}")
    return summary


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="dqspark", description="Profile, clean and validate a line-item table.")
    args.add_argument("--input", required=True)
    args.add_argument("--output", required=True)
    args.add_argument("--config")
    args.add_argument("--dry-run", action="store_true")
    a = args.parse_args(argv)
    config = yaml.safe_load(Path(a.config).read_text(encoding="utf-8")) if a.config else {k: dict(v) for k, v in DEFAULTS.items()}
    config["paths"] = {"input": a.input, "output": a.output}
    spark = SparkSession.builder.appName("dqspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(run(spark, config, a.dry_run))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
