"""Preprocessing, resampling, estimators, the training sweep and scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions import scoring as sx
from cohortry.functions.features import class_index
from cohortry.functions.tokens import (
    number_sql, parse_number, quoted, sql_double, sql_name, sql_text,
)
from cohortry.operators.hashrank import kth_hashes, number_rows_by_hash, seeded_row_hash
from cohortry.operators.metrics import (
    binary_metrics, class_report, multiclass_metrics, roc_auc,
)
from cohortry.operators.quantiles import exact_quantiles
from cohortry.operators.schema import numeric_and_categorical, require_columns
from cohortry.operators.shadow import select_features
from cohortry.operators.trees import TreeEstimator, TreeSettings, with_settings
from cohortry.sources import store
from cohortry.sources.scratch import settle

FAMILIES = ("logistic_regression", "random_forest", "boosted_trees")
SAMPLINGS = ("none", "over", "under")

# Estimator settings.
LOGISTIC_MAX_ITER = 2000
FOREST_TREES = 400
FOREST_DEPTH = None  # unlimited
BOOST_ROUNDS = 350
BOOST_DEPTH = 6
BOOST_RATE = 0.05
BOOST_ROW_SHARE = 0.9
BOOST_COLUMN_SHARE = 0.9
BOOST_PENALTY = 1.0

#: Fits of a sweep that run side by side.
PARALLEL_FITS = 4


# ---------------------------------------------------------------- preprocessing

EMPTY = "(empty)"


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mode (ties to the lowest value) and distinct count per column."""
    cells = [f"struct({i} AS column_index, CAST({sql_name(c)} AS STRING) AS value)"
             for i, c in enumerate(columns)]
    counts = (df.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")
              .groupBy("column_index", "value").agg(F.count(F.lit(1)).alias("n")))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)),
                                            "column_index int, column string")
    found = counts.groupBy("column_index").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        F.count(F.lit(1)).alias("n_distinct"))
    return names.join(found, "column_index", "left").select("column", "mode", "n_distinct")


def imputed_moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, population std) per numeric column, the last two after
    filling with the median."""
    numbers = df.selectExpr(*[f"{number_sql(df, c)} AS x{i}" for i, c in enumerate(columns)])
    medians = {c: (q[0] if q else 0.0)
               for c, q in exact_quantiles(numbers, numbers.columns, (0.5,)).items()}
    filled = [f"coalesce({c}, {sql_double(m)})" for c, m in medians.items()]
    row = numbers.selectExpr(*[f"avg({f}) AS m{i}" for i, f in enumerate(filled)],
                             *[f"stddev_pop({f}) AS s{i}" for i, f in enumerate(filled)]).first()
    return {name: (medians[f"x{i}"], row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0)
            for i, name in enumerate(columns)}


def fit_preprocessor(train: DataFrame, inputs: list[str],
                     hashed: dict[str, int] | None = None) -> PipelineModel:
    """Numeric: median fill and standardize. Categorical: mode fill and one-hot,
    unknown values all zero. The statistics become constants of one projection.

    One-hot coding keeps the value list of a column in the model and gives every
    value a slot of a sparse vector. For columns whose values are too many for a
    model, ``hashed`` names the slots to spread them over: a chosen mode, never
    switched on by the data.
    """
    hashed = dict(hashed or {})
    require_columns(train, inputs, "preprocessing")
    numeric, categorical = numeric_and_categorical(train, inputs)
    columns, parts, stages = ["*"], [], []
    if numeric:
        for c, (median, mean, std) in imputed_moments(train, numeric).items():
            x = f"CAST({sql_name(c)} AS DOUBLE)"
            filled = f"coalesce(nullif({x}, DOUBLE('NaN')), {sql_double(median)})"
            columns.append(f"({filled} - {sql_double(mean)}) / {sql_double(std)} "
                           f"AS {sql_name('numeric__' + c)}")
            parts.append("numeric__" + c)
    if categorical:
        for r in most_frequent(train, categorical).collect():
            # An empty text is a value like others, but a slot needs a name.
            filled = f"coalesce(nullif(coalesce(CAST({sql_name(r['column'])} AS STRING), " \
                     f"{sql_text(r['mode'] or '')}), ''), {sql_text(EMPTY)})"
            columns.append(f"{filled} AS {sql_name('filled__' + r['column'])}")
            if slots := hashed.get(r["column"]):
                columns.append(f"CAST(pmod(xxhash64({filled}), {slots}) AS DOUBLE) "
                               f"AS {sql_name('index__' + r['column'])}")
    shape = SQLTransformer(statement=f"SELECT {', '.join(columns)} FROM __THIS__")
    stages.append(shape)
    table = shape.transform(train)
    if categorical:
        listed = [c for c in categorical if c not in hashed]
        if listed:
            index = StringIndexer(
                inputCols=[f"filled__{c}" for c in listed],
                outputCols=[f"index__{c}" for c in listed],
                stringOrderType="alphabetAsc", handleInvalid="keep").fit(table)
            table = index.transform(table)
            # The indexer's extra slot for unknown values is the one dropped.
            stages += [index, _one_hot(table, listed, "error")]
        if wide := [c for c in categorical if c in hashed]:
            # A slot number above those of the training rows becomes all zero.
            stages.append(_one_hot(table, wide, "keep"))
        parts += [f"categorical__{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return PipelineModel(stages)


def _one_hot(table: DataFrame, columns: list[str], invalid: str):
    return OneHotEncoder(
        inputCols=[f"index__{c}" for c in columns],
        outputCols=[f"categorical__{c}" for c in columns], dropLast=True,
        handleInvalid=invalid).fit(table)


def slot_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's slots, from the metadata of the column."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])
    return [a.get("name", str(a["idx"])) for a in slots]


# ---------------------------------------------------------- weights and sampling

def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: rows, balanced weight n / (k * n_class), and the ratio of all
    other rows to the class."""
    counts = df.groupBy(quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    one_row = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"),
                         F.collect_list(F.struct("label", "n")).alias("each"))
    return one_row.select("total", "classes", F.inline("each")).select(
        "label", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("balanced_weight"),
        ((F.col("total") - F.col("n")) / F.col("n")).alias("others_ratio"))


def _weight_column(weights: dict[float, float]) -> Column:
    chain = F.when(F.lit(False), F.lit(1.0))
    for value, w in weights.items():
        chain = chain.when(F.col("label") == value, F.lit(float(w)))
    return chain.otherwise(F.lit(1.0))


#: Copies made by one explode; a row that is drawn more often is exploded in
#: blocks of this many, so no array grows with the data.
COPY_BLOCK = 1000


def _repeated(row: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, made by many tasks where that is often."""
    blocks = row.withColumn("_block", F.explode(F.expr(
        f"sequence(0L, {times}L div {COPY_BLOCK})")))
    size = f"CAST(least({times}L - _block * {COPY_BLOCK}, {COPY_BLOCK}) AS INT)"
    return blocks.repartition("_block").withColumn(
        "_copy", F.explode(F.expr(f"array_repeat(0, {size})"))).drop("_block", "_copy")


def undersample(df: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest class has, drawn by hash.

    Per larger class one hash marks the border, so rows are kept by a filter
    and no class is gathered in one task. Rows that share the border's hash are
    equal in all columns, so one of them is repeated as often as the size still
    lacks rows. Null and repeated keys are drawn like others.
    """
    sizes = {r["label"]: r["n"] for r in class_weights(df, label).collect()}
    smallest = min(sizes.values(), default=0)
    hashed = df.withColumn("_hash", seeded_row_hash(df, quoted(key), seed))
    keep, ties = F.lit(False), []
    for value, n in sizes.items():
        of_class = quoted(label).eqNullSafe(F.lit(value))
        if n > smallest:
            rows = hashed.where(of_class)
            (border,) = kth_hashes(rows.select(F.col("_hash").alias("h")), [smallest])
            at_border = rows.where(F.col("_hash") == F.lit(border))
            lacking = smallest - rows.where(F.col("_hash") < F.lit(border)).count()
            ties.append(_repeated(at_border.limit(1), lacking))
            of_class = of_class & (F.col("_hash") < F.lit(border))
        keep = keep | of_class
    return reduce(DataFrame.unionByName, ties, hashed.where(keep)).drop("_hash")


def oversample(df: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """All rows, and per smaller class as many draws with replacement as bring
    it to the size of the largest class.

    Draws are row numbers from a distributed range, counted before the join,
    so a row drawn many times is still one join row. Rows with the same number in
    another evaluation are equal in all columns; null and repeated keys are
    drawn like others.
    """
    spark = df.sparkSession
    sizes = {r["label"]: r["n"] for r in class_weights(df, label).collect()}
    largest = max(sizes.values(), default=0)
    parts = df
    for i, (value, n) in enumerate(sorted(sizes.items(), key=lambda item: str(item[0]))):
        if n == largest:
            continue
        numbered = number_rows_by_hash(df.where(quoted(label).eqNullSafe(F.lit(value))),
                                       seeded_row_hash(df, quoted(key), seed), "_number")
        draws = spark.range(largest - n).select(
            F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(n)).alias("_number"))
        counted = draws.groupBy("_number").agg(F.count(F.lit(1)).alias("_copies"))
        blocks = F.expr(f"sequence(0, (_copies - 1) div {COPY_BLOCK})")
        inside = F.expr(f"sequence(1, least(_copies - _block * {COPY_BLOCK}, {COPY_BLOCK}))")
        again = (numbered.join(counted, "_number").withColumn("_block", F.explode(blocks))
                 .withColumn("_copy", F.explode(inside)).select(*[quoted(c) for c in df.columns]))
        parts = parts.unionByName(again)
    return parts


def resample(df: DataFrame, strategy: str, key: str, label: str = "label",
             seed: int = 42) -> DataFrame:
    if strategy == "none":
        return df
    if strategy == "over":
        return oversample(df, key, label, seed)
    if strategy == "under":
        return undersample(df, key, label, seed)
    raise ValueError(f"unknown sampling strategy: {strategy}")


# ------------------------------------------------------------------- estimators

def build_estimator(family: str, task: str, n_rows: float, seed: int = 42,
                    weighted: bool = False, params: dict | None = None, classes: int | None = None):
    """The estimator of a model family; ``params`` replaces settings by name.

    The logistic penalty is 1/2 |w|^2 against the summed loss, which is 1/n
    against the mean loss that MLlib minimizes. Tree families fit all rows, cut into bins
    (see operators/trees.py).
    """
    params = dict(params or {})
    weight = "weight" if weighted else None
    classes = classes or (2 if task == "binary" else len(presets.CLASS_LABELS))
    if family == "logistic_regression":
        return LogisticRegression(**{
            "maxIter": LOGISTIC_MAX_ITER, "regParam": 1.0 / max(n_rows, 1.0),
            "standardization": False, "family": "auto",
            **({"weightCol": weight} if weight else {}), **params})
    if family == "random_forest":
        settings = TreeSettings("forest", classes, FOREST_TREES, FOREST_DEPTH, seed=seed)
    elif family == "boosted_trees":
        settings = TreeSettings("boosted", classes, BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE,
                                BOOST_ROW_SHARE, BOOST_COLUMN_SHARE, BOOST_PENALTY, seed=seed)
    else:
        raise ValueError(f"unknown model family: {family}")
    return TreeEstimator(with_settings(settings, params), weight)


def estimator_settings(estimator) -> list[tuple[str, str]]:
    """Parameters in force, as (name, text) pairs for the run table."""
    if isinstance(estimator, TreeEstimator):
        return estimator.settings()
    pairs = ((p.name, v) for p, v in estimator.extractParamMap().items())
    return sorted((name, str(value)) for name, value in pairs)


def labelled(df: DataFrame, task: str, target: str, labels=presets.CLASS_LABELS) -> DataFrame:
    """The table with a double ``label``. A binary label that is no number
    becomes 0; an unknown class label is an error."""
    if task == "binary":
        return df.withColumn("label", F.coalesce(parse_number(df, target), F.lit(0.0)))
    index = class_index(target, labels)
    bad = df.where(index.isNull()).select(quoted(target).alias("bad")).limit(1).collect()
    if bad:
        raise ValueError(f"unexpected label in {target}: {bad[0]['bad']}")
    return df.withColumn("label", index)


# ---------------------------------------------------------------------- scoring

def score(model: PipelineModel, df: DataFrame, task: str,
          labels: list[str] | None = None) -> DataFrame:
    """Rows with ``prediction`` (index), ``predicted_label``, ``class_shares``
    (label -> probability) and, for a binary task, ``positive_share``."""
    names = list(labels) if labels else ["0", "1"]
    scored = model.transform(df)
    shares = sx.class_shares(scored.columns, "probability", "rawPrediction")
    out = scored.withColumn("_shares", shares).withColumns({
        "predicted_label": sx.decode_label(F.col("prediction").cast("int"), names),
        "class_shares": sx.shares_by_label(F.col("_shares"), names)})
    if task == "binary":
        out = out.withColumn("positive_share", sx.positive_share(F.col("_shares")))
    kept = [*df.columns, "prediction", "predicted_label", "class_shares",
            *(["positive_share"] if task == "binary" else [])]
    return out.select(*[quoted(c) for c in dict.fromkeys(kept)])


def evaluate(scored: DataFrame, task: str, labels=presets.CLASS_LABELS) -> dict[str, float | None]:
    """Headline numbers of one scored table.

    The metrics read label, prediction and score several times, so those three
    columns are written once and the model scores every row a single time.
    """
    if task == "binary":
        y = settle(scored.select(F.col("label").cast("int").alias("label"),
                                 F.col("prediction").cast("int").alias("prediction"),
                                 F.col("positive_share").alias("score")))
        found = binary_metrics(y).first().asDict()
        found["roc_auc"] = roc_auc(y).first()["roc_auc"]
        return found
    y = settle(scored.select(
        sx.decode_label(F.col("label").cast("int"), list(labels)).alias("label"),
        F.col("predicted_label").alias("prediction")))
    found = multiclass_metrics(y).first().asDict()
    for r in class_report(y, labels).collect():
        for name in ("precision", "recall", "f1", "support"):
            found[f"per_class.{r['class_label']}.{name}"] = float(r[name])
    return found


# ------------------------------------------------------------------------ sweep

@dataclass
class Run:
    name: str
    task: str
    family: str
    sampling: str
    selection: str
    run_order: int
    model: PipelineModel
    inputs: list[str]
    slots: list[str]
    val: dict
    test: dict
    settings: list[tuple[str, str]]
    warnings: list[str] = field(default_factory=list)


def selection_key(task: str) -> tuple[str, str]:
    """The two validation metrics that rank the runs, most important first."""
    return ("f1", "roc_auc") if task == "binary" else ("macro_f1", "accuracy")


@dataclass
class Prepared:
    """What all fits of a sweep share."""
    task: str
    labels: tuple[str, ...]
    seed: int
    pre: PipelineModel
    inputs: list[str]
    ready: DataFrame
    slots: list[str]
    middle: list
    notes: list[str]
    selection: str
    sizes: dict
    mark: str

    @property
    def train(self) -> DataFrame:
        return self.ready.where("split = 'train'")


def _content_marks(rows: DataFrame, columns: list[list[str]]) -> list[str]:
    """Per list of columns a short text that changes with the rows, whatever their order."""
    totals = [F.sum(F.xxhash64(*[quoted(c) for c in own]).cast("decimal(38,0)")) for own in columns]
    n, *marks = rows.agg(F.count(F.lit(1)), *totals).first()
    return [f"{n}:{mark}" for mark in marks]


@dataclass
class Vectors:
    """Feature vectors, written once, with a label column for each task."""
    pre: PipelineModel
    table: DataFrame
    slots: list[str]
    marks: dict[str, str]


def prepare_vectors(splits: DataFrame, targets: dict[str, str], inputs: list[str], key: str,
                    labels=presets.CLASS_LABELS, marked: bool = False) -> Vectors:
    """What the sweeps of several tasks over the same rows share; ``targets`` are by task."""
    table = splits
    for task, target in targets.items():
        table = labelled(table, task, target, labels).withColumnRenamed("label", f"_label_{task}")
    pre = fit_preprocessor(table.where("split = 'train'"), inputs)
    vectors = pre.transform(table).select(
        quoted(key).alias("row_key"), "split", *[f"_label_{task}" for task in targets], "features")
    read = [[key, "split", target, *inputs] for target in targets.values()]
    marks = dict(zip(targets, _content_marks(splits, read))) if marked else {}
    return Vectors(pre, settle(vectors), slot_names(vectors), marks)


def prepare_sweep(splits: DataFrame, task: str, inputs: list[str], key: str, target: str,
                  select: str, labels, seed: int, selection: dict | None, marked: bool,
                  vectors: Vectors | None = None) -> Prepared:
    """Feature vectors computed once and written to the shared folder, with the slots
    that selection leaves. ``vectors`` are those of prepare_vectors, where there are any."""
    vectors = vectors or prepare_vectors(splits, {task: target}, inputs, key, labels, marked)
    pre, all_slots = vectors.pre, vectors.slots
    ready = vectors.table.select("row_key", "split", F.col(f"_label_{task}").alias("label"), "features")
    train = ready.where("split = 'train'")
    middle, slots, notes = [], all_slots, []
    if select != "none":
        chosen, note = select_features(train, len(all_slots), seed=seed, **(selection or {}))
        notes += [note] if note else []
        if chosen:
            slots = [all_slots[i] for i in chosen]
            middle = [VectorSlicer(inputCol="features", outputCol="chosen", indices=chosen)]
    sizes = {r["label"]: r for r in class_weights(train).collect()}
    mark = vectors.marks.get(task, "")
    return Prepared(task, tuple(labels), seed, pre, list(inputs), ready, slots, middle, notes, select, sizes, mark)


def fit_model(p: Prepared, family: str, sampling: str = "none", params: dict | None = None):
    """One candidate fitted on train, as the stages after the preprocessor, and its estimator."""
    counts = [r["n"] for r in p.sizes.values()]
    # Rows that are fitted, by sampling: the penalty is set against their loss.
    fitted_rows = {"none": sum(counts), "over": len(counts) * max(counts, default=0),
                   "under": len(counts) * min(counts, default=0)}
    # A fit reads its rows several times; drawn ones are drawn once.
    data = p.train if sampling == "none" else settle(resample(p.train, sampling, "row_key", "label", p.seed))
    weighted = p.task == "binary" and sampling == "none"
    if weighted:
        if family == "boosted_trees":
            positive = p.sizes.get(1.0)
            w = {1.0: positive["others_ratio"] if positive else 1.0}
        else:
            w = {v: r["balanced_weight"] for v, r in p.sizes.items()}
        data = data.withColumn("weight", _weight_column(w))
    estimator = _estimator(p, family, sampling, float(fitted_rows[sampling]), params)
    if p.middle:
        data = p.middle[0].transform(data)
    return PipelineModel([*p.middle, estimator.fit(data)]), estimator


def unmeasured_run(p: Prepared, order: int, family: str, sampling: str, params: dict | None) -> Run:
    """Fit one candidate on train."""
    model, estimator = fit_model(p, family, sampling, params)
    return Run(name=run_name(p.task, family, sampling, p.selection), task=p.task, family=family,
               sampling=sampling, selection=p.selection, run_order=order,
               model=PipelineModel([*p.pre.stages, *model.stages]), inputs=p.inputs, slots=p.slots,
               val={}, test={}, settings=estimator_settings(estimator), warnings=[*p.notes])


def fit_run(p: Prepared, order: int, family: str, sampling: str, params: dict | None) -> Run:
    """Fit one candidate on train and measure it on val and test."""
    model, estimator = fit_model(p, family, sampling, params)
    labels = None if p.task == "binary" else list(p.labels)
    scored = settle(score(model, p.ready.where("split != 'train'"), p.task, labels).drop(
        "row_key", "features", "class_shares"))
    measured = {split: evaluate(scored.where(F.col("split") == split), p.task, p.labels)
                for split in ("val", "test")}
    run_notes = [f"ROC AUC is undefined on {split}: one class only"
                 for split, m in measured.items() if m.get("roc_auc", 0.0) is None]
    return Run(name=run_name(p.task, family, sampling, p.selection), task=p.task, family=family,
               sampling=sampling, selection=p.selection, run_order=order,
               model=PipelineModel([*p.pre.stages, *model.stages]), inputs=p.inputs, slots=p.slots,
               val=measured["val"], test=measured["test"], settings=estimator_settings(estimator),
               warnings=[*p.notes, *run_notes])


def _estimator(p: Prepared, family: str, sampling: str, fitted_rows: float, params: dict | None):
    found = build_estimator(family, p.task, fitted_rows, p.seed, p.task == "binary" and sampling == "none",
                            (params or {}).get(family), 2 if p.task == "binary" else len(p.labels))
    return found.setFeaturesCol("chosen") if p.middle else found


def run_name(task: str, family: str, sampling: str, selection: str) -> str:
    return f"{task}_{family}_sampling-{sampling}_fs-{selection}"


def train_sweep(splits: DataFrame, task: str, inputs: list[str], key: str, target: str,
                families=FAMILIES, samplings=("none",), select: str = "none",
                labels=presets.CLASS_LABELS, seed: int = 42,
                params: dict[str, dict] | None = None,
                selection: dict | None = None, keep: str | None = None,
                parallel: int = PARALLEL_FITS, vectors: Vectors | None = None,
                measured: bool = True) -> tuple[list[Run], Run]:
    """Fit every family with every sampling on train, measure on val and test,
    and name the best run by its validation metrics; the first wins a tie.

    ``parallel`` fits run side by side, each in a scheduler pool of its own. Several
    class labels allow no resampling. ``params`` holds estimator settings by
    family, ``selection`` those of the feature selection. With ``keep``, every run is
    saved there as soon as it is measured, and a sweep over the same rows with the same
    settings takes the runs that it finds: a sweep that was stopped goes on. ``vectors``
    are those that sweeps of several tasks share, marked where ``keep`` is given. Runs that
    are not ``measured`` read train alone and have no metrics.
    """
    samplings = ("none",) if task == "multiclass" else tuple(samplings)
    wanted = [(i, family, sampling) for i, (family, sampling) in
              enumerate((f, s) for f in families for s in samplings)]
    if not wanted:
        raise RuntimeError("no training run was asked for")
    spark = splits.sparkSession
    if not measured:
        splits = splits.where("split = 'train'")
    fit = fit_run if measured else unmeasured_run
    shared = prepare_sweep(splits, task, inputs, key, target, select, labels, seed, selection, bool(keep),
                           vectors)

    def one(candidate: tuple[int, str, str]) -> Run:
        order, family, sampling = candidate
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{family}-{sampling}")
        try:
            name = run_name(task, family, sampling, select)
            mark = (f"{shared.mark} {seed} {sorted((params or {}).get(family, {}).items())} {shared.slots}"
                    f"{'' if measured else ' unmeasured'}")
            stored = store.load_run(spark, f"{keep}/{name}", mark) if keep else None
            if stored is not None:
                model, meta = stored
                return Run(name, task, family, sampling, select, order, model, meta["inputs"], meta["slots"],
                           meta["val"], meta["test"], sorted(meta["settings"].items()), meta["warnings"])
            run = fit(shared, order, family, sampling, params)
            if keep:
                store.save_model(spark, run, f"{keep}/{name}", labels, mark=mark)
            return run
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    if parallel > 1 and len(wanted) > 1:
        with ThreadPoolExecutor(parallel) as pool:
            runs = list(pool.map(inheritable_thread_target(spark)(one), wanted))
    else:
        runs = [one(candidate) for candidate in wanted]
    first, second = selection_key(task)
    best = max(runs, key=lambda r: (r.val.get(first) or 0.0, r.val.get(second) or 0.0))
    return runs, best


def reference_scores(model: PipelineModel, reference: DataFrame) -> DataFrame:
    """Positive probabilities of a reference table, for score drift."""
    return score(model, reference, "binary").select(
        F.col("positive_share").alias("binary_probability"))

