"""Analysis requests: validated parameters against a dataset of the store, one function each.

The request surface without a server: load, profile, derive a group, Kaplan-Meier, Cox and its preview, cohort table,
signature search, cut-point, models, deep models, time slices, counterfactual, partial dependence, export.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import UserInputError
from ..operators import cohort, cox, cutpoint, explain, grouping, km, profile, report, table_one, treeshap
from ..operators import encode as enc
from ..operators import signature as signatures
from ..operators.learners import compare
from ..operators.learners.deep import deep_models
from ..operators.learners.models import MODELS
from ..sources import bundled, exports, readers, synthetic
from ..sources.artifacts import ModelStore, signature
from ..sources.store import DatasetStore


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise UserInputError(f"{name} must be between {low:g} and {high:g}")


@dataclass(frozen=True)
class Outcome:
    """What every request says: the dataset, its time and event columns and the value that means the event (null: inferred)."""

    dataset_id: str
    time_column: str
    event_column: str
    event_positive_value: object = None
    strict_roles: bool = True


@dataclass(frozen=True)
class KaplanMeierRequest(Outcome):
    group_column: str | None = None
    confidence_level: float = 0.95
    max_time: float | None = None
    risk_table_points: int = 6
    logrank_weight: str = "logrank"
    fh_p: float = 1.0

    def __post_init__(self) -> None:
        _within("confidence_level", self.confidence_level, 0.5, 0.999)
        _within("risk_table_points", self.risk_table_points, 4, 12)
        _within("fh_p", self.fh_p, 0, 5)


@dataclass(frozen=True)
class CoxRequest(Outcome):
    covariates: list[str] = field(default_factory=list)
    categorical_covariates: list[str] = field(default_factory=list)
    strata_columns: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class CutpointRequest(Outcome):
    variable: str = ""
    min_group_fraction: float = 0.1
    permutation_iterations: int = 100

    def __post_init__(self) -> None:
        _within("min_group_fraction", self.min_group_fraction, 0.02, 0.45)
        _within("permutation_iterations", self.permutation_iterations, 0, 500)


@dataclass(frozen=True)
class SignatureRequest(Outcome):
    candidate_columns: list[str] = field(default_factory=list)
    max_combination_size: int = 2
    top_k: int = 10
    min_group_fraction: float = 0.1
    operator: str = "mixed"
    bootstrap_iterations: int = 30
    permutation_iterations: int = 100
    validation_iterations: int = 20

    def __post_init__(self) -> None:
        for name, low, high in (("max_combination_size", 1, 4), ("top_k", 3, 50), ("min_group_fraction", 0.02, 0.45), ("bootstrap_iterations", 0, 120), ("permutation_iterations", 0, 400), ("validation_iterations", 0, 80)):
            _within(name, getattr(self, name), low, high)


@dataclass(frozen=True)
class ModelRequest(Outcome):
    features: list[str] = field(default_factory=list)
    categorical_features: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=lambda: list(MODELS))
    n_estimators: int = 100
    max_depth: int | None = None
    learning_rate: float = 0.1
    evaluation: str = "holdout"
    folds: int = 5
    repeats: int = 3
    epochs: int = 100
    bins: int = 20
    seed: int = 42

    def __post_init__(self) -> None:
        for name, low, high in (("n_estimators", 10, 1000), ("folds", 2, 10), ("repeats", 1, 20), ("epochs", 10, 1000), ("bins", 10, 200)):
            _within(name, getattr(self, name), low, high)


class Service:
    """Datasets and requests of one session."""

    def __init__(self, spark: SparkSession, store: DatasetStore | None = None):
        self.spark, self.store, self.fits = spark, store or DatasetStore(), ModelStore(spark)

    def load(self, path: str) -> str:
        return self.store.put(readers.load(self.spark, path), path)

    def load_example(self, n: int = 360, seed: int = 42) -> str:
        return self.store.put(synthetic.make_cohort(self.spark, n, seed), "synthetic")

    def load_bundled(self, name: str, folder: str | None = None) -> str:
        return self.store.put(bundled.load(self.spark, name, folder), name)

    def load_bytes(self, content: bytes, name: str) -> str:
        """An uploaded file; the kind follows from its name."""
        return self.store.put(readers.load_bytes(self.spark, content, name), name)

    def profile(self, dataset_id: str) -> dict:
        s = self.store.get(dataset_id)
        return profile.profile(s.df) | {"dataset_id": dataset_id, "hash": s.hash, "derived": s.derived}

    def _cohort(self, r: Outcome, extras: list[str], drop: bool = True) -> cohort.Cohort:
        return cohort.build(self.store.get(r.dataset_id).df, r.time_column, r.event_column, r.event_positive_value, extras, drop, r.strict_roles)

    def _informed(self, r: Outcome, columns: list[str]) -> bool:
        derived = self.store.get(r.dataset_id).derived
        return any(derived.get(c, {}).get("outcome_informed") for c in columns)

    def _guard(self, r: Outcome, features: list[str]) -> None:
        s = self.store.get(r.dataset_id)
        cohort.reject_outcome_features(s.df, features, r.time_column, r.event_column, r.event_positive_value, tuple(c for c, d in s.derived.items() if d.get("outcome_informed")))

    def kaplan_meier(self, r: KaplanMeierRequest) -> dict:
        groups = [r.group_column] if r.group_column else []
        c, informed = self._cohort(r, groups), self._informed(r, groups)
        got = km.analyse(c.df, r.group_column, r.confidence_level, r.max_time, r.risk_table_points, r.logrank_weight, r.fh_p, informed)
        rows = [x.asDict() for x in got.summary.limit(km.MAX_GROUPS).collect()]
        return {"result": got, "summary": rows, "audit": c.audit, "narrative": report.km_narrative(rows, got.test, got.pairwise, got.contrast, informed), "request": report.provenance(asdict(r), c.audit)}

    def cox_preview(self, r: CoxRequest) -> dict:
        return cohort.preview(self.store.get(r.dataset_id).df, r.time_column, r.event_column, r.covariates, r.strata_columns, r.event_positive_value)

    def cox(self, r: CoxRequest) -> dict:
        self._guard(r, [*r.covariates, *r.strata_columns])
        c = self._cohort(r, [*r.covariates, *r.strata_columns])
        return cox.analyse(c.df, r.covariates, r.categorical_covariates, r.strata_columns) | {"audit": c.audit, "request": report.provenance(asdict(r), c.audit)}

    def cohort_table(self, dataset_id: str, variables: list[str], group_column: str | None = None) -> list[dict]:
        df = self.store.get(dataset_id).df
        cohort.require_columns(df, [*variables, *([group_column] if group_column else [])])
        return table_one.table_one(df, variables, group_column)

    def derive_group(self, dataset_id: str, source: str, method: str, **how) -> tuple[str, grouping.Derived]:
        got = grouping.derive_group(self.store.get(dataset_id).df, source, method, **how)
        return self.store.derive(dataset_id, got.df, got.column, got.recipe | {"outcome_informed": got.outcome_informed}), got

    def optimal_cutpoint(self, r: CutpointRequest) -> dict:
        self._guard(r, [r.variable])
        return cutpoint.optimal_cutpoint(self._cohort(r, [r.variable]).df, r.variable, r.min_group_fraction, r.permutation_iterations)

    def discover_signature(self, r: SignatureRequest) -> tuple[str, dict]:
        """The id of a new dataset with the best rule's label, and the search."""
        self._guard(r, r.candidate_columns)
        got = signatures.discover(self._cohort(r, r.candidate_columns).df, r.candidate_columns, r.max_combination_size, r.top_k, r.min_group_fraction, r.operator, r.bootstrap_iterations, r.permutation_iterations, r.validation_iterations)
        df = signatures.apply_rule(self.store.get(r.dataset_id).df, got, 0, "signature_group")
        key = self.store.derive(r.dataset_id, df, "signature_group", {"rule": got["rules"][0]["rule"], "outcome_informed": True})
        return key, got | {"narrative": report.signature_narrative(got)}

    def _how(self, r: ModelRequest) -> dict:
        return {"n_estimators": r.n_estimators, "max_depth": r.max_depth, "learning_rate": r.learning_rate}

    def models(self, r: ModelRequest) -> dict:
        """Comparison by holdout or repeated cross-validation, with the manuscript table."""
        self._guard(r, r.features)
        df = self._cohort(r, r.features, drop=False).df
        if r.evaluation == "repeated_cv":
            each = compare.cross_validate(df, r.features, r.categorical_features, r.models, r.folds, r.repeats, r.seed, **self._how(r))
            rows, mode = [x.asDict() for x in compare.summarise(each).collect()], "repeated_cv"
        else:
            rows = compare.compare(df, r.features, r.categorical_features, r.models, r.seed, **self._how(r))
            mode = rows[0]["evaluation_mode"] if rows else "holdout"
        return {"rows": rows, "table": report.manuscript_table(rows, mode, r.seed), "narrative": report.model_narrative(rows, mode)}

    def deep_models(self, r: ModelRequest, kinds: list[str] | None = None) -> dict:
        """Neural models on the shared holdout; undeclared text features are refused, as they have no levels to learn."""
        self._guard(r, r.features)
        df = self._cohort(r, r.features).df
        text = [c for c in r.features if c not in r.categorical_features and dict(df.dtypes)[c] == "string"]
        if text:
            raise UserInputError("declare these as categorical: " + ", ".join(text))
        data, rows = compare.prepare(df, r.features, r.categorical_features, r.seed), []
        on = data.test if data.test.any() else ~data.test
        for kind in kinds or list(deep_models()):
            got = deep_models()[kind](data.x[~data.test], data.t[~data.test], data.e[~data.test], epochs=r.epochs, bins=r.bins, seed=r.seed, learning_rate=min(r.learning_rate, 0.01))
            rows.append({"model": kind, **compare.evaluate(got, data.x[on], data.t[on], data.e[on], data.t[~data.test], data.e[~data.test]), "epochs": len(got.history)})
        return {"rows": sorted(rows, key=lambda x: -(x["c_index"] or 0)), "narrative": report.model_narrative(rows, data.mode)}

    def fitted(self, r: ModelRequest, model: str):
        self._guard(r, r.features)
        df = self._cohort(r, r.features, drop=False).df
        key = signature(data=self.store.get(r.dataset_id).hash, model=model, request=asdict(r))
        kept = self.fits.get(key)
        if kept is None:
            data = compare.prepare(df, r.features, r.categorical_features, r.seed)
            kept = data, compare.train(data, model, seed=r.seed, **self._how(r))[0]
            self.fits.put(key, kept)
        return df, *kept

    def partial_dependence(self, r: ModelRequest, model: str, feature: str, points: int = 50) -> list[dict]:
        _, data, got = self.fitted(r, model)
        return explain.partial_dependence(got, data, feature, points)

    def counterfactual(self, r: ModelRequest, model: str, feature: str, original: object, changed: object) -> dict:
        df, data, got = self.fitted(r, model)
        return explain.counterfactual(got, df, data, feature, original, changed)

    def shap(self, r: ModelRequest, model: str) -> list[dict]:
        """Mean absolute Shapley values: by the trees where the model has some, over all rows; else by coalitions."""
        df, data, got = self.fitted(r, model)
        if hasattr(got, "trees"):
            return treeshap.mean_contributions(enc.encode(df, data.encoder, ["_row_id"]), got, data.names)
        return explain.kernel_shap(got, data, seed=r.seed)

    def time_slice_importance(self, r: ModelRequest, times: list[float] | None = None) -> DataFrame:
        self._guard(r, r.features)
        return explain.time_slice_importance(self._cohort(r, r.features, drop=False).df, r.features, r.categorical_features, times)

    @staticmethod
    def export(rows: list[dict], kind: str, **how) -> str | bytes:
        kinds = {"csv": exports.to_csv, "markdown": exports.to_markdown, "latex": exports.to_latex, "docx": exports.to_docx, "xlsx": exports.to_xlsx}
        if kind not in kinds:
            raise UserInputError(f"unknown format {kind}; one of {', '.join(kinds)}")
        return kinds[kind](rows, **how)
