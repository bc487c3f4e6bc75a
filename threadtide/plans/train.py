"""Train, evaluate, tune and explain the score models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from threadtide.operators import attribution, leastsquares, models
from threadtide.operators.features import default_roles, leaking
from threadtide.operators.splits import split_flag, with_folds
from threadtide.operators.summary import require_text
from threadtide.schema import TARGET


@dataclass
class Trained:
    linear: PipelineModel
    boosted: PipelineModel
    metrics: dict[str, dict[str, float]]
    best_params: dict
    names: list[str]
    leaking: list[str]
    importance: DataFrame
    test: DataFrame
    base_value: float = 0.0
    attribution: DataFrame | None = None
    candidates: DataFrame | None = None


def train(
    df: DataFrame,
    row_id: str,
    order: list[str],
    target: str = TARGET,
    roles: dict | None = None,
    drop_leaking: bool = True,
    refit_on_all: bool = False,
    boosted_params: dict | None = None,
    draws: int = models.SEARCH_DRAWS,
    search_space: dict = models.SEARCH_SPACE,
    cv_folds: int = models.CV_FOLDS,
    search_folds: int = models.SEARCH_FOLDS,
    parallelism: int = 2,
    seed: int = 42,
) -> Trained:
    """Linear and boosted models with test scores, fold scores, random search and attribution.

    drop_leaking leaves out features that are computed from the target. refit_on_all refits the
    tuned model on all rows, test rows included; such test scores say nothing about new rows. The
    input is read once and persisted (memory and disk) until the models are done.
    """
    roles = roles or default_roles(df, drop_leaking)
    if roles.get("text"):
        require_text(df, roles["text"])
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    folded = with_folds(split_flag(df, row_id, seed=seed), order, {"cv_fold": cv_folds, "search_fold": search_folds})
    train_rows, test_rows = folded.where(~F.col("is_test")), folded.where("is_test")
    metrics: dict[str, dict[str, float]] = {}

    def evaluate(name: str, model: PipelineModel, fit) -> None:
        row = models.regression_metrics(model.transform(test_rows), target).first()
        cv = models.fold_summary(models.cross_validate(folded, fit, target, "cv_fold", parallelism)).first()
        metrics[name] = {"mse_test": row["mse"], "r2_test": row["r2"], "cv_mean_r2": cv["mean_r2"], "cv_std_r2": cv["std_r2"]}

    linear_fit = models.fit_with_features(leastsquares.LeastSquares(labelCol=target), **roles)
    boosted_fit = lambda params: models.fit_with_features(models.boosted_trees(target, seed=seed, **params), **roles)
    linear = linear_fit(train_rows)
    evaluate("linear", linear, linear_fit)
    first = boosted_fit(boosted_params or {})
    evaluate("boosted", first(train_rows), first)

    candidates = models.draw_params(draws, search_space, seed)
    searched = folded if refit_on_all else train_rows
    make = lambda params: models.boosted_trees(target, seed=seed, **params)
    best, table = models.random_search(searched, make, roles, target, candidates, "search_fold", parallelism)
    tuned_fit = boosted_fit(best)
    tuned = tuned_fit(searched)
    evaluate("boosted_tuned", tuned, tuned_fit)

    names = tuned.feature_names
    regressor = tuned.stages[-1]
    scored = tuned.transform(test_rows)
    values, base = attribution.tree_attribution(scored, regressor, row_id)
    every = [c for part in roles.values() if part for c in ([part] if isinstance(part, str) else part)]
    return Trained(
        linear=linear, boosted=tuned, metrics=metrics, best_params=best, names=names, leaking=leaking(every),
        importance=models.feature_importance(regressor, names, df.sparkSession), test=scored,
        base_value=base, attribution=values, candidates=table,
    )
