"""Bounded results in words and manuscript tables."""

from __future__ import annotations

MODES = {"holdout": "Holdout C-index", "apparent": "Apparent C-index", "repeated_cv": "Repeated-CV mean C-index"}


def metric_name(mode: str) -> str:
    return MODES.get(mode, "C-index")


def manuscript_table(rows: list[dict], mode: str, seed: int | None = None) -> dict:
    """Ranked rows, caption and notes of a model comparison."""
    ok = sorted((r for r in rows if r.get("c_index") is not None), key=lambda r: (-r["c_index"], r["model"]))
    table = [{"Rank": i + 1, "Model": r["model"], metric_name(mode): round(r["c_index"], 3), "IBS": None if r.get("ibs") is None else round(r["ibs"], 3), "Brier skill": None if r.get("skill") is None else round(r["skill"], 3), "Train N": r.get("train_n"), "Test N": r.get("test_n"), "Features": r.get("n_features")} for i, r in enumerate(ok)]
    notes = [f"{r['model']} failed: {r['error']}" for r in rows if r.get("error")]
    if mode == "apparent":
        notes.append("Too few rows for a holdout: the models were evaluated on their training rows.")
    if seed is not None:
        notes.append(f"Splits are drawn from row ids with seed {seed}.")
    return {"caption": f"Comparison of survival models by {metric_name(mode)}", "rows": table, "notes": notes}


def model_narrative(rows: list[dict], mode: str, robust: float = 0.65, review: float = 0.55) -> dict:
    ok = [r for r in rows if r.get("c_index") is not None]
    if not ok:
        return {"status": "caution", "headline": "No model could be evaluated.", "cautions": [r.get("error") for r in rows if r.get("error")]}
    best = max(ok, key=lambda r: r["c_index"])
    status = "caution" if mode == "apparent" or best["c_index"] < review else "robust" if best["c_index"] > robust else "review"
    cautions = ["evaluated on training rows"] if mode == "apparent" else []
    if best.get("skill") is not None and best["skill"] <= 0:
        cautions.append("no better than the plain survival curve by the Brier score")
    if best.get("test_events") is not None and best["test_events"] < 20:
        cautions.append(f"only {best['test_events']} test events")
    return {"status": status, "headline": f"{best['model']} leads with {metric_name(mode)} {best['c_index']:.3f}.", "cautions": cautions}


def km_narrative(summary: list[dict], test: dict | None, pairwise: list[dict], contrast: dict | None, outcome_informed: bool = False) -> dict:
    """Status robust, review or caution of a Kaplan-Meier analysis, with its reasons."""
    strengths, cautions = [], []
    events = sum(r["events"] for r in summary)
    small = [r for r in summary if r["events"] < 5]
    if outcome_informed:
        cautions.append("the groups were derived from the outcome, so no test is given")
    if small:
        cautions.append(f"{len(small)} group(s) with under 5 events")
    if events >= 10 * max(1, len(summary)):
        strengths.append(f"{events} events over {len(summary)} group(s)")
    if any(r["median"] is None for r in summary):
        cautions.append("the median is not reached in every group")
    if test and test["p_value"] is not None:
        (strengths if test["p_value"] < 0.05 else cautions).append(f"{test['test']} p = {test['p_value']:.3g}")
    close = [r for r in pairwise if r["p_value"] < 0.05 <= r["p_adjusted"]]
    if close:
        cautions.append(f"{len(close)} pair(s) lose significance when adjusted")
    if contrast and contrast["p_value"] is not None and contrast["p_value"] < 0.05:
        strengths.append(f"restricted mean differs by {contrast['estimate']:.3g} up to {contrast['horizon']:.3g}")
    status = "caution" if outcome_informed or small else "review" if cautions else "robust"
    return {"status": status, "strengths": strengths, "cautions": cautions, "metrics": {"events": events, "groups": len(summary)}}


def signature_narrative(result: dict) -> dict:
    rules = result["rules"]
    best = rules[0] if rules else None
    firm = bool(best and best["significant"])
    return {"status": "review" if firm else "caution", "headline": "No rule was found." if not best else f"{best['rule']}: hazard ratio {best['hazard_ratio']:.3g}, adjusted p {best['p_adjusted']:.3g}" if best["hazard_ratio"] else best["rule"], "wording": "confirmed by resampling" if firm else "exploratory", "tested": result["tested"]}


def provenance(request: dict, audit: dict, dataset_hash: str | None = None) -> list[str]:
    """What is needed to run a request again."""
    out = [f"{k} = {v}" for k, v in sorted(request.items()) if v not in (None, "", [], {})]
    out += [f"{k}: {v}" for k, v in audit.items()]
    return out + ([f"dataset {dataset_hash}"] if dataset_hash else [])


def shown_range(values: list[float], factor: float = 3.0) -> tuple[float, float] | None:
    """The range to draw: all values, unless the ends lie beyond factor widths of the 5 to 95 % core."""
    import numpy as np

    x = np.array([v for v in values if v is not None and np.isfinite(v)])
    if not len(x):
        return None
    low, high = np.quantile(x, [0.05, 0.95])
    width = max(high - low, 1e-12)
    return float(max(x.min(), low - factor * width)), float(min(x.max(), high + factor * width))
