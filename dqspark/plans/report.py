"""The evaluation of the outlier models as Markdown."""

from __future__ import annotations

TITLES = {"isolation_forest": "Isolation forest", "lof": "Outlier factor", "either": "Either model", "both": "Both models"}


def _table(head: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def evaluation_markdown(models: list[dict], recalls: list[dict], contamination: float) -> str:
    """models: rows of anomaly.evaluate; recalls: rows of anomaly.recall_by_model. Results, recall by type of injected row,
    and a confusion matrix for each model."""
    by = {m["model"]: m for m in models}
    order = [m for m in TITLES if m in by]
    injected = max((m["tp"] + m["fn"] for m in models), default=0)
    base = max((m["fp"] + m["tn"] for m in models), default=0)
    types = sorted({r["anomaly_type"] for r in recalls})
    found = {(r["model"], r["anomaly_type"]): r["recall"] for r in recalls}
    shown = [[TITLES[m], *(f"{by[m][k]:.4f}" for k in ("auc", "precision", "recall", "f1", "precision_at_k")), str(by[m]["tp"] + by[m]["fp"])] for m in order]
    missed = [f"{TITLES[m]} finds no row of type {t}." for m in order for t in types if found.get((m, t), 0.0) == 0.0]
    parts = [
        "# Outlier models on injected rows",
        f"{injected} rows with known outliers were added to {base} rows; each model marks the {100 * contamination:g} % it holds most unusual.",
        "## Results",
        _table(["model", "ROC AUC", "precision", "recall", "F1", f"precision at {injected}", "flagged"], shown),
        "## Recall by type",
        _table(["model", *types], [[TITLES[m], *(f"{found.get((m, t), 0.0):.2f}" for t in types)] for m in order]),
        *(missed and ["## Blind spots", "\n".join(f"* {x}" for x in missed)]),
        "## Confusion matrices",
        *(f"{TITLES[m]}:\n\n" + _table(["", "flagged", "not flagged"], [["injected", str(by[m]["tp"]), str(by[m]["fn"])], ["base", str(by[m]["fp"]), str(by[m]["tn"])]]) for m in order),
    ]
    return "\n\n".join(parts) + "\n"
