"""Demand models and the forecasters that put their output into a panel.

A forecaster scores a featured history (``score_history``) and prepared
scenarios (``score_scenarios``); both add ``predicted`` in units. Everything
downstream takes any of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import unlog
from ..schema import DATE, LABEL, LAG_COLUMNS, SERIES, code_column, model_inputs
from ..session import ensure_checkpoint_dir, release_shuffles, ship_package, stored
from .boosting import BoostedTrees as GBTRegressor
from .boosting import BoostedTreesModel, blocks, cut_points, read_blocks, squared_error, write_blocks
from .clean import MIN_STORE_ROWS
from .encode import encode
from .features import baseline_predict, calendar_features
from .joins import split_join

TRAIN_SHARE = 0.80

# The training parameters of the global model, by MLlib name.
# A round is several jobs; pass ``maxIter`` for fewer.
GLOBAL_PARAMS = {
    "maxIter": 600,
    "maxDepth": 6,
    "stepSize": 0.05,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 5,
    "minInfoGain": 0.0,
    "maxBins": 256,
    "lossType": "squared",
    "seed": 42,
}


# -- time split -------------------------------------------------------------


def split_date(df: DataFrame, q: float = TRAIN_SHARE, by: Sequence[str] | None = None) -> DataFrame:
    """The ``q`` quantile of the dates in days since 1970, interpolated.

    Counts per date are all a group has to hold, so the exact aggregate is safe.
    """
    day = F.percentile(F.unix_date(DATE), F.lit(q)).alias("split_day")
    return df.groupBy(*(by or ())).agg(day)


def split_text(day: Column) -> Column:
    """A split day as timestamp text."""
    moment = F.timestamp_seconds(F.floor(day * 86400))
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def time_split(
    df: DataFrame,
    q: float = TRAIN_SHARE,
    by: Sequence[str] | None = None,
    panel: DataFrame | None = None,
) -> DataFrame:
    """Label rows ``train`` up to the split date and ``valid`` after it.

    ``panel`` may hold the dates of the same rows in a plan cheaper than ``df``.
    """
    cut = split_date(df if panel is None else panel, q, by)
    if by:
        df = split_join(df, cut, by)
        day = F.col("split_day")
    else:
        day = cut.scalar()
    label = F.when(F.unix_date(DATE) <= day, "train").otherwise("valid")
    return df.withColumn("split", label).drop("split_day")


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows of each split and their share of all, in percent."""
    rows = df.groupBy("split").agg(F.count(F.lit(1)).alias("records"))
    total = rows.agg(F.sum("records").cast("double")).scalar()
    return rows.withColumn("share", F.col("records") / total * 100.0)


# -- scenarios --------------------------------------------------------------


def zero_lags(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.lit(0.0) for name in LAG_COLUMNS})


def prepare_scenarios(
    scenarios: DataFrame, lags: str = "zero", latest: DataFrame | None = None
) -> DataFrame:
    """Calendar and lag columns for rows that have no history of their own.

    ``zero`` sets all lags and rolling means to 0; ``carry`` takes them from the
    series' latest row in ``latest``, or from the scenario if it has them.
    """
    dated = calendar_features(scenarios)
    if lags == "zero":
        return zero_lags(dated)
    if lags != "carry":
        raise ValueError(f"unknown lag choice: {lags}")
    if latest is None:
        return dated
    carried = latest.select(*SERIES, *LAG_COLUMNS)
    joined = split_join(dated.drop(*LAG_COLUMNS), carried, SERIES, "left")
    return joined.fillna(0.0, subset=list(LAG_COLUMNS))


# -- global boosted trees ---------------------------------------------------


def feature_projection(df: DataFrame) -> DataFrame:
    """Only the model's inputs, in training order."""
    return df.select(*model_inputs())


# Training rows of one task: some 70 MB of inputs as doubles.
TASK_ROWS = 300_000


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, in partitions that do not grow with it.

    The trainer keeps the partitions it gets through all its rounds.
    """
    tasks = -(-rows // TASK_ROWS)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def stored_panel(df: DataFrame) -> DataFrame:
    """``df``, computed once; the shuffle files of what made it are given up."""
    panel = stored(df, "panel")
    release_shuffles(df.sparkSession)
    return panel


def by_series(panel: DataFrame) -> DataFrame:
    """A stored panel laid by series, in partitions that do not grow with it; a table's footers have its rows counted."""
    tasks = max(panel.sparkSession.sparkContext.defaultParallelism, -(-panel.count() // TASK_ROWS))
    return panel.repartition(tasks, *SERIES)


def _cut(train: DataFrame, count: int, settings: dict) -> list[list[float]]:
    return cut_points(train, model_inputs(), settings["maxBins"], settings["seed"], count)


def fit_global(train: DataFrame, **params) -> PipelineModel:
    """Boosted trees on the log target over encoded, featured rows of all stores."""
    settings = {**GLOBAL_PARAMS, **params}
    cuts = _cut(train, train.count(), settings)
    path = f"{ensure_checkpoint_dir(train.sparkSession)}/shelfcast-blocks-{uuid.uuid4().hex}"
    rows = write_blocks(blocks(train, model_inputs(), LABEL, cuts, settings["maxBins"]), path)
    model = GBTRegressor(model_inputs(), cuts, **settings).fit(rows)
    target, files = _folder(train.sparkSession, path)
    files.delete(target, True)
    return PipelineModel(stages=[model])


# Columns that models saved by an earlier trainer add, one for each stage.
STAGE_COLUMN = "_stage_log_"


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> bool:
    target, files = _folder(spark, f"{path}/finished/_SUCCESS")
    return files.exists(target)


def stage_table(spark: SparkSession, path: str) -> DataFrame:
    """What finished stages have noted: stage, settings, rounds, rows and the squared error left."""
    return spark.read.parquet(f"{path}/stage-*/finished").orderBy("stage")


def fit_global_stages(
    train: DataFrame, path: str, rounds: int = GLOBAL_PARAMS["maxIter"], stage_rounds: int = 50, **params
) -> PipelineModel:
    """:func:`fit_global` in stages that survive the driver: each is saved to the shared folder ``path``.

    A stage boosts ``stage_rounds`` rounds on what the stages before left of the
    log target. Its model, and the rows (their bins) with what it left in turn, are
    written before the stage counts as finished. A run that finds finished stages goes on behind the last one;
    other settings or other rows than theirs are an error. The trees of all stages make one
    model, so it is saved, loaded and scored like any
    other. The first tree of a stage is not shrunk (a property of the trainer), which
    leaves the error of a few long stages near that of a single run.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    settings = {**GLOBAL_PARAMS, **params}
    settings.pop("maxIter")
    plan = [min(stage_rounds, rounds - done) for done in range(0, rounds, stage_rounds)]
    count = train.count()
    note = json.dumps({**settings, "rows": count}, sort_keys=True)
    trees, cuts = [], None
    for stage, size in enumerate(plan):
        here = f"{path}/stage-{stage:04d}"
        if _finished(spark, here):
            done = spark.read.parquet(f"{here}/finished").first()
            if done.settings != note or done.rounds != size:
                raise ValueError(f"{here} was trained with other settings, rounds or rows")
            _, cuts, grown = BoostedTreesModel.load(f"{here}/model").parts()
            trees += grown
            continue
        if stage == 0:
            cuts = _cut(train, count, settings)
            rows = write_blocks(blocks(spread_rows(train, count), model_inputs(), LABEL, cuts, settings["maxBins"]), f"{here}/start")
        else:
            rows = read_blocks(spark, f"{path}/stage-{stage - 1:04d}/rows")
        trainer = GBTRegressor(model_inputs(), cuts, maxIter=size, **settings)
        model = trainer.fit(rows)
        model.write().overwrite().save(f"{here}/model")
        grown = model.parts()[2]
        left = write_blocks(trainer.taken_off(rows, grown), f"{here}/rows")
        finished = squared_error(left).select(
            F.lit(stage).alias("stage"), F.lit(note).alias("settings"), F.lit(size).alias("rounds"), "rows", "squared_error"
        )
        finished.coalesce(1).write.mode("overwrite").parquet(f"{here}/finished")
        # The rows the stage began with are not needed any more.
        target, files = _folder(spark, f"{path}/stage-{stage - 1:04d}/rows" if stage else f"{here}/start")
        files.delete(target, True)
        trees += grown
    return PipelineModel(stages=[BoostedTreesModel.of(model_inputs(), cuts, trees)])


def score_encoded(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Predictions in units; null where an input is null, such as an unseen label's code."""
    whole = F.lit(True)
    for name in model_inputs():
        whole = whole & F.col(name).isNotNull()
    scored = model.transform(df).withColumn("predicted", F.when(whole, unlog("predicted_log")))
    parts = [c for c in scored.columns if c.startswith(STAGE_COLUMN)]
    return scored.drop("features", "predicted_log", *parts)


# -- one linear model per store ---------------------------------------------

# Text columns whose every label has a weight of its own in a store's model.
INDICATORS = ("category", "region", "seasonality")
# The other inputs of a store's model, in the order of its coefficients.
STORE_INPUTS = tuple(
    name for name in model_inputs() if name not in {code_column(c) for c in (*INDICATORS, "store_id")}
)
# Smallest values are worth taking off where they may be large beside the spread.
SHIFTED = ("inventory_level", "price", "discount", "competitor_pricing")


def store_cells(df: DataFrame) -> DataFrame:
    """Rows, sums and sums of products of the numeric inputs and the label, by store and labels.

    One aggregate with map-side sums over (store, category, region, seasonality).
    A row is a block of the normal equations: indicators add only counts and sums to
    them, so no row is ever written out with its zeros. ``low`` holds the
    store's smallest values, which are taken off first (``_low`` of
    :func:`training_rows`; zeros without it).
    """
    columns = [*STORE_INPUTS, LABEL]
    low = F.col("_low") if "_low" in df.columns else F.array(*[F.lit(0.0)] * len(columns))
    rows = df.select(
        "store_id", *INDICATORS, low.alias("low"), *[F.col(name).cast("double").alias(name) for name in columns]
    )
    shifted = rows.select(
        "store_id", *INDICATORS, "low", *[(F.col(name) - F.col("low")[k]).alias(f"x{k}") for k, name in enumerate(columns)]
    )
    count = len(columns)
    # One by one: an array among the aggregates would have all rows sorted first.
    lows = [F.first(F.col("low")[k]).alias(f"l{k}") for k in range(count)]
    sums = [F.sum(f"x{k}").alias(f"s{k}") for k in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    cells = shifted.groupBy("store_id", *INDICATORS).agg(
        F.count(F.lit(1)).alias("n"), *lows, *sums, *products
    )
    return cells.select(
        "store_id", *INDICATORS, "n", F.array(*[f"l{k}" for k in range(count)]).alias("low"),
        F.array(*[f"s{k}" for k in range(count)]).alias("sums"),
        F.array(*[f"p{i}_{j}" for i, j in pairs]).alias("products"),
    )


def normal_equations(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sums of products of (1, numeric inputs, indicators, label) of one store, low values, and the indicators' names."""
    size = len(STORE_INPUTS) + 1
    upper = np.triu_indices(size)
    names = sorted({f"{c}={v}" for c in INDICATORS for v in cells[c].dropna()})
    spot = {name: 1 + len(STORE_INPUTS) + k for k, name in enumerate(names)}
    numeric = [*range(1, size), size + len(names)]
    gram = np.zeros((1 + size + len(names),) * 2)
    for row in cells.itertuples(index=False):
        sums, block = np.asarray(row.sums, float), np.zeros((size, size))
        block[upper] = row.products
        block = block + np.triu(block, 1).T
        ones = [0, *(spot[f"{c}={getattr(row, c)}"] for c in INDICATORS if getattr(row, c) is not None)]
        gram[np.ix_(numeric, numeric)] += block
        gram[np.ix_(ones, ones)] += row.n
        gram[np.ix_(ones, numeric)] += sums
        gram[np.ix_(numeric, ones)] += sums[:, None]
    low = np.asarray(cells["low"].iloc[0], float)
    low = np.concatenate([low[:-1], np.zeros(len(names)), low[-1:]])
    return gram[np.triu_indices(len(gram))], low, names


def solve_ridge(sums: np.ndarray, low: np.ndarray, inputs: int, penalty: float) -> np.ndarray:
    """Intercept and coefficients from one store's sums of products around ``low``.

    Inputs are standardized first; one without variance gets coefficient 0. The
    shifted values are not negative, so a mean of 0 means that all of them are
    0, and the variance cannot be lost in the difference of two large numbers.
    """
    size = inputs + 2
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = sums
    gram = gram + np.triu(gram, 1).T
    rows = gram[0, 0]
    mean = gram[0, 1:] / rows
    cov = gram[1:, 1:] / rows - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(cov)[:-1], 0.0, None))
    # Rounding leaves about rows * epsilon of the mean square in a variance.
    noise = 4 * np.finfo(float).eps * np.sqrt(rows) * (np.diag(gram)[1:-1] / rows)
    usable = spread**2 > noise
    coefficients = np.zeros(inputs)
    if usable.any():
        scale = spread[usable]
        left = cov[:-1, :-1][np.ix_(usable, usable)] / np.outer(scale, scale)
        right = cov[:-1, -1][usable] / scale
        left = left + penalty * np.eye(usable.sum())
        coefficients[usable] = np.linalg.solve(left, right) / scale
    intercept = mean[-1] + low[-1] - coefficients @ (mean[:-1] + low[:-1])
    return np.concatenate([[intercept], coefficients])


def fit_per_store(train: DataFrame, penalty: float = 0.01) -> DataFrame:
    """A ridge regression on the log target for every store.

    Takes featured rows with product codes and gives one row per store: the
    coefficients (intercept, then ``STORE_INPUTS``) and the weight of every label
    of category, region and seasonality by its name, as ``category=...``. These are linear models: a
    set of trees per store would need all of a store's rows in one place. A task
    gets one row per combination of labels that a store has, never its panel rows.
    """
    ship_package(train.sparkSession)

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        sums, low, names = normal_equations(cells)
        solved = solve_ridge(sums, low, len(STORE_INPUTS) + len(names), penalty)
        split = 1 + len(STORE_INPUTS)
        weights = list(zip(names, solved[split:].tolist()))
        return pd.DataFrame({"store_id": cells["store_id"].iloc[:1], "coefficients": [solved[:split].tolist()], "labels": [weights]})

    solved = store_cells(train).groupBy("store_id").applyInPandas(
        solve, "store_id string, coefficients array<double>, labels array<struct<name:string,weight:double>>"
    )
    return solved.withColumn("labels", F.map_from_entries("labels"))


def score_per_store(df: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Score rows with their store's model; stores without one get null.

    A label that the store's training rows did not have weighs nothing. Where
    the rows carry the codes of their labels, one without a code gives null.
    """
    models = coefficients.select("store_id", "coefficients", "labels")
    joined = split_join(df, models, ["store_id"], "left")
    terms = F.col("coefficients")[0]
    for spot, name in enumerate(STORE_INPUTS, start=1):
        terms = terms + F.col("coefficients")[spot] * F.col(name).cast("double")
    known = F.lit(True)
    for name in INDICATORS:
        label = F.concat(F.lit(f"{name}="), F.col(name).cast("string"))
        terms = terms + F.coalesce(F.try_element_at("labels", label), F.lit(0.0))
        if code_column(name) in df.columns:
            known = known & F.col(code_column(name)).isNotNull()
    return joined.withColumn("predicted", F.when(known, unlog(terms))).drop("coefficients", "labels")


def training_rows(
    featured: DataFrame,
    panel: DataFrame | None = None,
    min_rows: int = MIN_STORE_ROWS,
    with_low: bool = False,
    series_joined: bool = False,
) -> DataFrame:
    """Rows of stores large enough to train on, split by each store's own dates.

    Row counts, split dates and smallest values come from one aggregate over
    ``panel``, which needs only the keys, dates and raw columns of the same rows, and
    reach the rows in one join. ``with_low`` adds ``_low``, the values that
    :func:`store_cells` takes off its inputs. ``series_joined`` is for rows that lie by series and
    have no null keys: a store's values then go to each of its series, and the rows stay where they are.
    """
    source = featured if panel is None else panel
    lows = {name: F.min(F.col(name).cast("double")) for name in SHIFTED} if with_low else {}
    stores = source.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.percentile(F.unix_date(DATE), F.lit(TRAIN_SHARE)).alias("_split_day"),
        *[value.alias(f"_low_{name}") for name, value in lows.items()],
    )
    low = [F.coalesce(F.col(f"_low_{name}"), F.lit(0.0)) if name in lows else F.lit(0.0) for name in (*STORE_INPUTS, LABEL)]
    large = stores.filter(F.col("_rows") >= min_rows).select(
        "store_id", "_split_day", *([F.array(*low).alias("_low")] if with_low else [])
    )
    label = F.when(F.unix_date(DATE) <= F.col("_split_day"), "train").otherwise("valid")
    if series_joined:
        rows = featured.join(source.select(*SERIES).distinct().join(large, "store_id"), list(SERIES))
    else:
        rows = split_join(featured, large, ["store_id"])
    return rows.withColumn("split", label).drop("_split_day")


# -- forecasters ------------------------------------------------------------


class BaselineForecaster:
    """The rolling mean known before the row; needs no training."""

    lags = "carry"

    def score_history(self, featured: DataFrame) -> DataFrame:
        return baseline_predict(featured)

    def score_scenarios(self, prepared: DataFrame) -> DataFrame:
        return prepared.withColumn("predicted", F.col("rolling_mean_7"))


class GlobalForecaster:
    """Boosted trees for all stores with the encoders they were trained with."""

    lags = "zero"

    def __init__(self, model: PipelineModel, encoders: DataFrame, invalid: str = "null"):
        self.model, self.encoders, self.invalid = model, encoders, invalid

    def _score(self, df: DataFrame) -> DataFrame:
        return score_encoded(encode(df, self.encoders, invalid=self.invalid), self.model)

    score_history = _score
    score_scenarios = _score


class StoreForecaster:
    """The linear model of each row's store.

    Stores without a model and labels that no store had give a null prediction. Models and
    encoders of several runs carry ``run_id``; each store uses its own run's.
    """

    lags = "zero"

    def __init__(self, coefficients: DataFrame, encoders: DataFrame, invalid: str = "null"):
        self.coefficients, self.encoders, self.invalid = coefficients, encoders, invalid

    def _score(self, df: DataFrame) -> DataFrame:
        by = "run_id" if "run_id" in self.encoders.columns else None
        if by:
            df = split_join(df, self.coefficients.select("store_id", by), ["store_id"], "left")
        encoded = encode(df, self.encoders, ("product_id", *INDICATORS), invalid=self.invalid, by=by)
        return score_per_store(encoded.drop(*[by] if by else []), self.coefficients)

    score_history = _score
    score_scenarios = _score
