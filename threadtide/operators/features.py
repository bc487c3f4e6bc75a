"""The feature matrix: text weights, one-hot categories, scaled numbers and flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, OneHotEncoder, RegexTokenizer,
    SQLTransformer, StopWordsRemover, StringIndexer, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from threadtide.functions.numeric import known
from threadtide.functions.text import STOP_WORDS
from threadtide.operators.selection import numeric_columns
from threadtide.operators.tfidf import MAX_DF, MAX_FEATURES, MIN_DF, vocabulary
from threadtide.schema import BOOLEAN, CATEGORICAL, NUMERICAL, TARGET_DERIVED, TEXT

NULL_CATEGORY = "∅"


@dataclass
class FeatureModel:
    """A fitted feature pipeline and the name of each slot of its vector."""

    pipeline: PipelineModel
    names: list[str]
    output: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)


def leaking(features: Sequence[str]) -> list[str]:
    """The features that are computed from the target."""
    return [f for f in features if f in TARGET_DERIVED]


def default_roles(df: DataFrame, drop_leaking: bool = True) -> dict:
    """The standard column roles, cut to the columns present; leaking columns only on request."""
    skip = TARGET_DERIVED if drop_leaking else []
    return {
        "text": TEXT if TEXT in df.columns else None,
        "categorical": [c for c in CATEGORICAL if c in df.columns],
        "numeric": [c for c in numeric_columns(df, NUMERICAL) if c not in skip],
        "boolean": [c for c in BOOLEAN if c in df.columns],
    }


def _text_stages(df: DataFrame, text: str, stop_words: Sequence[str], max_features: int, min_df: int, max_df: float):
    steps = [
        SQLTransformer(statement=f"SELECT *, coalesce(`{text}`, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+", minTokenLength=2),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=list(stop_words)),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _grams FROM __THIS__"),
    ]
    # the same terms and weights as the long form, ties at the border settled by term; max_features rows at most
    found = vocabulary(df.select(text), text, text, stop_words, max_features, min_df, max_df)
    rows = found.orderBy(F.desc("cf"), "term").select("term", "idf").collect()
    if not rows:
        raise ValueError(f"no term of {text} is in {min_df} rows and in no more than a share of {max_df}")
    terms = [r["term"] for r in rows]
    steps += [
        CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_tf"),
        ElementwiseProduct(inputCol="_tf", outputCol="_tfidf", scalingVec=Vectors.dense([r["idf"] for r in rows])),
        Normalizer(inputCol="_tfidf", outputCol="_text_vec", p=2.0),
    ]
    return steps, [f"text__{t}" for t in terms]


def _category_stages(df: DataFrame, columns: Sequence[str]):
    marked = ", ".join(f"coalesce(cast(`{c}` AS string), '{NULL_CATEGORY}') AS `_c_{c}`" for c in columns)
    fill = SQLTransformer(statement=f"SELECT *, {marked} FROM __THIS__")
    current = fill.transform(df)
    indexed = StringIndexer(
        inputCols=[f"_c_{c}" for c in columns], outputCols=[f"_i_{c}" for c in columns],
        handleInvalid="keep", stringOrderType="alphabetAsc",
    ).fit(current)
    # the dropped last slot is the bucket of unseen values, which so become all zeros
    onehot = OneHotEncoder(
        inputCols=[f"_i_{c}" for c in columns], outputCols=[f"_o_{c}" for c in columns], dropLast=True
    ).fit(indexed.transform(current))
    names = [f"cat__{c}_{label}" for c, labels in zip(columns, indexed.labelsArray) for label in labels]
    return [fill, indexed, onehot], names


def scaling_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: per column the mean and the population deviation."""
    return df.agg(*[F.struct(F.avg(known(c)).alias("m"), F.stddev_pop(known(c)).alias("s")).alias(c) for c in columns])


def standardize(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0, null stays null."""
    row = scaling_table(df if fitted_on is None else fitted_on, columns).select(F.struct(*columns).alias("s")).scalar()
    scaled = {}
    for c in columns:
        spread = F.when(row[c]["s"] == 0, 1.0).otherwise(row[c]["s"])
        scaled[c] = (known(c) - row[c]["m"]) / spread
    return df.withColumns(scaled)


def _number_stages(df: DataFrame, columns: Sequence[str]):
    """Scaling as a SQL stage, so that it is saved with the pipeline; a missing number takes the mean."""
    fitted = scaling_table(df, columns).first()
    parts = []
    for c in columns:
        mean, spread = fitted[c]["m"], fitted[c]["s"]
        value = f"cast(`{c}` AS double)"
        scaled = f"({value} - ({mean!r}D)) / {spread!r}D" if spread else f"{value} * 0.0D"
        parts.append(f"coalesce(nanvl({scaled}, 0.0D), 0.0D) AS `_n_{c}`")
    return [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")], [f"num__{c}" for c in columns]


def fit_features(
    df: DataFrame,
    text: str | None = None,
    categorical: Sequence[str] = (),
    numeric: Sequence[str] = (),
    boolean: Sequence[str] = (),
    stop_words: Sequence[str] = STOP_WORDS,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    output: str = "features",
) -> FeatureModel:
    """Learn every block on df and combine them; columns without a role are left out of the vector."""
    stages, names, inputs = [], [], []
    if text:
        part, labels = _text_stages(df, text, stop_words, max_features, min_df, max_df)
        stages, names, inputs = stages + part, names + labels, inputs + ["_text_vec"]
    if categorical:
        part, labels = _category_stages(df, categorical)
        stages, names, inputs = stages + part, names + labels, inputs + [f"_o_{c}" for c in categorical]
    if numeric:
        part, labels = _number_stages(df, numeric)
        stages, names, inputs = stages + part, names + labels, inputs + [f"_n_{c}" for c in numeric]
    if boolean:
        flags = ", ".join(f"coalesce(cast(`{c}` AS double), 0.0D) AS `_b_{c}`" for c in boolean)
        stages.append(SQLTransformer(statement=f"SELECT *, {flags} FROM __THIS__"))
        names, inputs = names + [f"bool__{c}" for c in boolean], inputs + [f"_b_{c}" for c in boolean]
    if not inputs:
        raise ValueError("no features")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return FeatureModel(PipelineModel(stages), names, output)


def feature_names(spark, model: FeatureModel) -> DataFrame:
    return spark.createDataFrame(list(enumerate(model.names)), "slot int, name string")
