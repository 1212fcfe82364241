"""Models trained on real and synthetic rows, and the metrics that compare them.

Rows that agree in all columns a model sees are one row with a count: tables are grouped once (:func:`counted`), written to the shared folder, and models,
encoders and metrics take the counts as weights. So each pass of a fit costs what the different rows cost. Multilayer perceptrons take
no weights and are given each row as often as it counts.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions.columns import hash_order, or_missing
from tabulith.operators.clean import impute, impute_values
from tabulith.operators.profile import rare_class, weighted_rollup
from tabulith.sources.tables import scratch_path

EPSILON = 2.220446049250313e-16
#: A forest draws its bootstraps over rows; of equal rows it is given up to so many, which share their count.
FOREST_PARTS = 32


def counted(df: DataFrame, columns: list[str], **aggregates: F.Column) -> DataFrame:
    """``columns`` and ``_n``, how many rows have these values (and further aggregates), with a number ``_id``; a table in the shared folder."""
    path = scratch_path(df.sparkSession, "counted")
    out = df.groupBy(*columns).agg(F.count("*").alias("_n"), *(x.alias(c) for c, x in aggregates.items()))
    out = out.sortWithinPartitions(*columns)  # forests draw by the order of rows
    out.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _each(table: DataFrame, most: int | None = None) -> DataFrame:
    """A counted table with ``_n`` rows for each of its own; with ``most`` at most so many, which share ``_n``."""
    copies = F.col("_n") if most is None else F.least("_n", F.lit(most))
    return table.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_copy").withColumn("_n", F.col("_n") / copies)


def _rank_counts(pred: DataFrame, parts: int = 256, by_class: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(score, pos, neg, pos_below, neg_below): counts of each distinct score and of scores below it, in two passes; for each ``by_class``."""
    own, w = by_class or [], F.col(weight) if weight else F.lit(1)
    by = pred.groupBy(*own, F.col("prob").alias("score")).agg(F.sum(w * F.col("label").cast("bigint")).alias("pos"), F.sum(w * (1 - F.col("label").cast("bigint"))).alias("neg"))
    by = by.withColumn("part", F.floor(F.col("score") * parts))
    inside = Window.partitionBy(*own, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy(*own, "part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # at most parts + 1 rows a class
    order = Window.partitionBy(*(own or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*own, "part", F.coalesce(F.sum("p").over(order), F.lit(0)).alias("pb"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("nb"))
    rows = by.withColumn("pi", F.coalesce(F.sum("pos").over(inside), F.lit(0))).withColumn("ni", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    return rows.join(F.broadcast(sums), [*own, "part"]).select(*own, "score", "pos", "neg", (F.col("pi") + F.col("pb")).alias("pos_below"), (F.col("ni") + F.col("nb")).alias("neg_below"))


def multiclass_metrics(pred: DataFrame, key: str = "row_id", weight: str | None = None) -> DataFrame:
    """(accuracy, auc, f1) of (key, class, truth, prob), a row for each key and class: percent right, AUC and F1 weighted by support.

    The class of greatest probability is the guess (ties: the first by name). AUC is one class against the rest,
    exact with ties as halves, over the classes that have rows of both kinds. All are null without rows. ``weight`` is how many rows a key stands for.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    rows = pred.withColumn("label", (F.col("class") == F.col("truth")).cast("int"))
    area = F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))
    aucs = _rank_counts(rows, by_class=["class"], weight=weight).groupBy("class").agg(area.alias("a"), F.sum("pos").alias("s"))
    auc = aucs.filter("a IS NOT NULL").agg(F.try_divide(F.sum(F.col("a") * F.col("s")), F.sum("s")).alias("auc"))
    guess = pred.groupBy(key).agg(F.min_by("class", F.struct(-F.col("prob"), F.col("class"))).alias("guess"), F.first("truth").alias("truth"), F.first(w).alias("w"))  # one truth a key
    cells = guess.groupBy("guess", "truth").agg(F.sum("w").alias("n"))  # a row for each pair of classes
    hit = F.when(F.col("guess") == F.col("truth"), F.col("n")).otherwise(0)
    sides = cells.select(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).alias("guessed"), hit.alias("hit")).unionByName(
        cells.select(F.col("guess").alias("class"), F.lit(0).alias("support"), F.col("n").alias("guessed"), F.lit(0).alias("hit")))
    per = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "guessed", "hit")))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("guessed")), F.lit(0.0))
    return per.agg(F.try_divide(100 * F.sum("hit"), F.sum("support")).alias("accuracy"), F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1")).crossJoin(
        F.broadcast(auc)).select("accuracy", "auc", "f1")  # one row each


def classification_metrics(pred: DataFrame, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """(accuracy, auc, f1) of (label 0/1, prob in [0, 1]): percent right, exact AUC with ties as halves, mean F1 of both classes.

    The AUC is null with one class only, and all are null without rows but F1, which is 0. ``weight`` is how many rows a row stands for.
    """
    w = F.col(weight) if weight else F.lit(1)
    hit = (F.col("prob") >= threshold).cast("int")
    count = lambda a, b: F.sum(w * ((F.col("label") == a) & (hit == b)).cast("bigint"))
    c = pred.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    f1 = lambda t, a, b: F.when(2 * F.col(t) + F.col(a) + F.col(b) > 0, 2 * F.col(t) / (2 * F.col(t) + F.col(a) + F.col(b))).otherwise(0.0)
    auc = _rank_counts(pred, weight=weight).agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.crossJoin(F.broadcast(auc)).select(F.try_divide(100 * (F.col("tp") + F.col("tn")), n).alias("accuracy"), "auc",  # one row each
                                                ((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2).alias("f1"))


def regression_metrics(pred: DataFrame) -> DataFrame:
    """(mape, explained_variance, r2) of (y, y_hat). The last two are null where y is constant."""
    y, e = F.col("y"), F.col("y") - F.col("y_hat")
    return pred.agg(F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"), (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
                    (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))


def average_precision(pred: DataFrame, weight: str | None = None) -> DataFrame:
    """(ap): the sum of precision times gain in recall, over distinct scores from the top. Null without positives."""
    r = _rank_counts(pred, weight=weight)
    total = r.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = r.crossJoin(F.broadcast(total)).withColumn("tp", F.col("p") - F.col("pos_below")).withColumn("fp", F.col("n") - F.col("neg_below"))
    return rows.agg(F.sum(F.try_divide("pos", "p") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"))


def _encoder(train: DataFrame, numeric: list[str], categorical: list[str]) -> PipelineModel:
    """One-hot and standardized features, fitted on counted training rows; unknown categories have a slot of their own."""
    stages, labels = [], {c: [] for c in categorical}
    if categorical:  # as a StringIndexer orders them: the most frequent first, ties by name
        sizes = train.unpivot(["_n"], categorical, "c", "v").groupBy("c", "v").agg(F.sum("_n").alias("n"))
        for r in sizes.orderBy(F.desc("n"), "v").collect():  # a row for each category, as the model has
            labels[r.c].append(r.v)
    for c in categorical:
        stages.append(StringIndexerModel.from_labels(labels[c], inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep"))
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], dropLast=False))
    stages.append(VectorAssembler(inputCols=[*numeric, *(f"_o_{c}" for c in categorical)], outputCol="_raw"))
    fitted = Pipeline(stages=stages).fit(train)
    w = F.col("_n").cast("double")
    row = fitted.transform(train).agg(Summarizer.metrics("variance").summary(F.col("_raw"), w)["variance"].alias("v"), F.sum(w).alias("n"), F.sum(w * w).alias("s")).first()
    # the summary's variance takes weights as reliabilities; of counts it is over n - 1
    as_counts = (row.n - row.s / row.n) / (row.n - 1) if row.n > 1 else 0.0
    return PipelineModel(stages=[*fitted.stages, ElementwiseProduct(scalingVec=Vectors.dense([(x * as_counts) ** -0.5 if x * as_counts > 0 else 0.0 for x in row.v]), inputCol="_raw", outputCol="features")])


def _prepare(df: DataFrame, numeric: list[str], categorical: list[str], values: dict[str, object]) -> DataFrame:
    return impute(df, values).withColumns({c: or_missing(F.col(c)) for c in categorical})


CLASSIFIERS = {
    "logistic": lambda n, k, trees: LogisticRegression(labelCol="y", maxIter=20),
    "tree": lambda n, k, trees: DecisionTreeClassifier(labelCol="y", maxDepth=6, seed=0),
    "forest": lambda n, k, trees: RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=6, seed=0),
    "mlp": lambda n, k, trees: MultilayerPerceptronClassifier(labelCol="y", layers=[n, 16, k], maxIter=40, seed=0),
}
REGRESSORS = {
    "ols": lambda: LinearRegression(labelCol="y"),
    "ridge": lambda: LinearRegression(labelCol="y", regParam=1.0, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(labelCol="y", regParam=0.1, elasticNetParam=1.0),
}


def _fitted(ready: DataFrame, model: str, classes: int, trees: int, weight: F.Column | None = None):
    """A classifier fitted on a counted, encoded table (y, features, _n); ``weight`` is further weight of a row."""
    est = CLASSIFIERS[model](len(ready.select("features").first()[0]), classes, trees)
    if model == "mlp":
        return est.fit(_each(ready.select("y", "features", "_n")).select("y", "features"))
    w = F.col("_n") if weight is None else F.col("_n") * weight
    rows = _each(ready, FOREST_PARTS) if model == "forest" else ready
    return est.setWeightCol("_w").fit(rows.select("y", "features", w.cast("double").alias("_w")))


def _binary_model(train: DataFrame, numeric: list[str], categorical: list[str], model: str, trees: int, weight: F.Column | None = None):
    """A function from rows with numeric, categorical and ``y`` to (kept columns, label, prob); ``train`` is counted and has these too."""
    values = impute_values(_each(train), numeric, [])
    a = _prepare(train, numeric, categorical, values)
    enc = _encoder(a, numeric, categorical)
    fitted = _fitted(enc.transform(a), model, 2, trees, weight)

    def predict(rows: DataFrame, *keep: str) -> DataFrame:
        out = fitted.transform(enc.transform(_prepare(rows, numeric, categorical, values)))
        return out.select(*keep, F.col("y").cast("int").alias("label"), vector_to_array("probability")[1].alias("prob"))

    return predict


def _class_model(train: DataFrame, numeric: list[str], categorical: list[str], model: str, trees: int):
    """A function from rows with numeric, categorical and ``_label`` to (kept columns, class, truth, prob), a row for each class; ``train`` is counted and has these too."""
    values = impute_values(_each(train), numeric, [])
    a = _prepare(train, numeric, categorical, values)
    index = StringIndexer(inputCol="_label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(a)
    classes, enc = index.labels, _encoder(a, numeric, categorical)
    fitted, p = _fitted(enc.transform(index.transform(a)), model, len(classes), trees), vector_to_array("probability")
    each = F.array(*(F.struct(F.lit(c).alias("class"), F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias("prob")) for i, c in enumerate(classes)))

    def predict(rows: DataFrame, *keep: str) -> DataFrame:
        out = fitted.transform(enc.transform(_prepare(rows, numeric, categorical, values)))
        return out.select(*keep, F.col("_label").alias("truth"), F.inline(each)).select(*keep, "class", "truth", "prob")

    return predict


def _labelled(df: DataFrame, label: str, *columns: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).select(*columns, F.col(label).cast("string").alias("_label"))


def train_classifier(train: DataFrame, test: DataFrame, label: F.Column, numeric: list[str], categorical: list[str], model: str = "forest", trees: int = 20) -> DataFrame:
    """(row_key, label, prob) of the test rows by a binary model; ``label`` is true or false. For more classes see :func:`predict_classes`."""
    y = lambda df: df.withColumn("y", label.cast("double"))
    return _binary_model(counted(y(train), [*numeric, *categorical, "y"]), numeric, categorical, model, trees)(y(test), "row_key")


def predict_classes(train: DataFrame, test: DataFrame, label: str, numeric: list[str], categorical: list[str], model: str = "forest", trees: int = 20) -> DataFrame:
    """(row_key, class, truth, prob): a row for each test row and class of the training rows, by a model of all classes at once.

    Logistic regression is multinomial. Rows without a label are left out; a test label that was not trained on stays as the truth. Medians
    for missing numbers come from the training rows.
    """
    a = counted(_labelled(train, label, *numeric, *categorical), [*numeric, *categorical, "_label"])
    return _class_model(a, numeric, categorical, model, trees)(_labelled(test, label, "row_key", *numeric, *categorical), "row_key")


def _regression_model(train: DataFrame, numeric: list[str], categorical: list[str], model: str):
    """A function from rows with numeric, categorical and ``y`` to (kept columns, y, y_hat). ``train`` is counted by the features, ``y`` the mean of its rows, ``yy`` that of the squares.

    Means give the least squares of the rows: what they leave out doesn't depend on the coefficients. Spark divides an L2 penalty by the
    deviation of y, so it is scaled by that of the means over that of the rows; an L1 penalty has no such factor.
    """
    values = impute_values(_each(train), numeric, [])
    a = _prepare(train, numeric, categorical, values)
    enc, est = _encoder(a, numeric, categorical), REGRESSORS[model]()
    n = F.sum("_n")
    s = train.agg(*(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("_n") * x) / n - F.pow(F.sum(F.col("_n") * F.col("y")) / n, F.lit(2)))).alias(c) for c, x in (("means", F.col("y") ** 2), ("rows", F.col("yy"))))).first()
    if est.getElasticNetParam() == 0.0 and s.rows:
        est = est.setRegParam(est.getRegParam() * s.means / s.rows)
    fitted = est.setWeightCol("_w").fit(enc.transform(a).select("y", "features", F.col("_n").cast("double").alias("_w")))
    return lambda rows, *keep: fitted.transform(enc.transform(_prepare(rows, numeric, categorical, values))).select(*keep, "y", F.col("prediction").alias("y_hat"))


def _targets(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull()).withColumn("y", F.col(target))


def _mean_targets(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    y = F.col(target).cast("double")
    return counted(df.filter(F.col(target).isNotNull()), columns, y=F.avg(y), yy=F.avg(y * y))


def train_regressor(train: DataFrame, test: DataFrame, target: str, numeric: list[str], categorical: list[str], model: str = "ols") -> DataFrame:
    """(row_key, y, y_hat) of the test rows."""
    return _regression_model(_mean_targets(train, target, [*numeric, *categorical]), numeric, categorical, model)(_targets(test, target), "row_key")


def _gaps(split: DataFrame, syn: DataFrame, models: list[str], count, score, metrics: tuple[str, ...]) -> DataFrame:
    """(model, run, metrics, gaps): ``score(count(train), model)`` for real (run 0) and for each synthetic run, on the same held-out real rows."""
    out = None
    runs = [r.run for r in syn.select("run").distinct().orderBy("run").collect()]  # a row for each file
    for run in [0, *runs]:
        train = count(split.filter("part = 'train'") if run == 0 else syn.filter(F.col("run") == run))
        for m in models:
            row = score(train, m).select(F.lit(m).alias("model"), F.lit(run).cast("int").alias("run"), *metrics)
            out = row if out is None else out.unionByName(row)
    real = F.max_by(F.struct(*metrics), F.when(F.col("run") == 0, 1)).over(Window.partitionBy("model"))  # a row for each run
    return out.withColumn("_real", real).select("model", "run", *metrics, *((F.col(f"_real.{c}") - F.col(c)).alias(f"gap_{c}") for c in metrics))


def utility_gap(split: DataFrame, syn: DataFrame, label: F.Column, numeric: list[str], categorical: list[str], models: list[str]) -> DataFrame:
    """(model, run, accuracy, auc, f1, gap_accuracy, gap_auc, gap_f1): trained on real (run 0) and on each synthetic run, all tested on the same held-out real rows.

    ``split`` is the real table with ``part``; its test rows must be unknown to the generator. ``label`` is true or false.
    A gap is what the model trained on real rows has more than this one; 0 for run 0.
    """
    count = lambda df: counted(df.withColumn("y", label.cast("double")), [*numeric, *categorical, "y"])
    test = count(split.filter("part = 'test'"))
    score = lambda train, m: classification_metrics(_binary_model(train, numeric, categorical, m, 20)(test, "_n"), weight="_n")
    return _gaps(split, syn, models, count, score, ("accuracy", "auc", "f1"))


def class_gap(split: DataFrame, syn: DataFrame, label: str, numeric: list[str], categorical: list[str], models: list[str]) -> DataFrame:
    """As :func:`utility_gap` for a label of any number of classes, with AUC and F1 weighted by support."""
    count = lambda df: counted(_labelled(df, label, *numeric, *categorical), [*numeric, *categorical, "_label"])
    test = count(split.filter("part = 'test'"))
    score = lambda train, m: multiclass_metrics(_class_model(train, numeric, categorical, m, 20)(test, "_id", "_n"), "_id", "_n")
    return _gaps(split, syn, models, count, score, ("accuracy", "auc", "f1"))


def regression_gap(split: DataFrame, syn: DataFrame, target: str, numeric: list[str], categorical: list[str], models: list[str]) -> DataFrame:
    """As :func:`utility_gap` for a number: (model, run, mape, explained_variance, r2) and their gaps."""
    count = lambda df: _mean_targets(df, target, [*numeric, *categorical])
    test = _targets(split.filter("part = 'test'"), target)
    score = lambda train, m: regression_metrics(_regression_model(train, numeric, categorical, m)(test))
    return _gaps(split, syn, models, count, score, ("mape", "explained_variance", "r2"))


def mean_gap(gaps: DataFrame) -> DataFrame:
    """(model, n_runs, gaps): real less the mean of the synthetic runs."""
    return gaps.filter("run > 0").groupBy("model").agg(F.count("*").alias("n_runs"), *(F.avg(c).alias(c) for c in gaps.columns if c.startswith("gap_")))


def rare_event_recall(split: DataFrame, syn: DataFrame, label: str, numeric: list[str], categorical: list[str], trees: int = 200) -> DataFrame:
    """(arm, rare_label, n_rare, n_hit, recall): how many of the rarest class a forest of all classes finds, trained on real and on synthetic rows.

    Both are tested on the same real rows. A row is found if no class is likelier (ties: the first by name).
    """
    rare = rare_class(split, label).first()["rare_label"]
    count = lambda df: counted(_labelled(df, label, *numeric, *categorical), [*numeric, *categorical, "_label"])
    test, out = count(split.filter("part = 'test'").filter(F.col(label) == rare)), None
    for arm, train in (("real", split.filter("part = 'train'")), ("syn", syn)):
        pred = _class_model(count(train), numeric, categorical, "forest", trees)(test, "_id", "_n")
        guess = pred.groupBy("_id").agg(F.min_by("class", F.struct(-F.col("prob"), F.col("class"))).alias("guess"), F.first("_n").alias("_n"))  # one count an id
        row = guess.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rare"), F.coalesce(F.sum(F.when(F.col("guess") == str(rare), F.col("_n"))), F.lit(0)).alias("n_hit")).select(
            F.lit(arm).alias("arm"), F.lit(str(rare)).alias("rare_label"), "n_rare", "n_hit", F.try_divide("n_hit", "n_rare").alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def _sides(real: DataFrame, syn: DataFrame, seed: int) -> tuple[DataFrame, F.Column]:
    """Both tables with ``y``, 1 for synthetic rows, and which rows are held out, 77 in 256 by a hash."""
    both = real.withColumn("y", F.lit(0.0)).unionByName(syn.withColumn("y", F.lit(1.0)))
    return both, F.conv(F.substring(hash_order(seed, "row_key"), 1, 2), 16, 10).cast("int") < 77


def _detector_model(both: DataFrame, train: DataFrame, numeric: list[str], categorical: list[str], model: str, trees: int):
    """A binary model of the counted ``train``, its classes balanced by the rows of both sides."""
    n = {r["y"]: r["count"] for r in both.groupBy("y").count().collect()}  # two rows
    half = sum(n.values()) / 2.0
    return _binary_model(train, numeric, categorical, model, trees, F.when(F.col("y") == 1, half / n.get(1.0, 1)).otherwise(half / n.get(0.0, 1)))


def detector(real: DataFrame, syn: DataFrame, numeric: list[str], categorical: list[str], *, seed: int = 0, model: str = "forest", trees: int = 300) -> DataFrame:
    """(row_key, label, prob): a class-balanced classifier of synthetic against real rows, on held-out rows, 77 in 256 by a hash."""
    both, held = _sides(real, syn, seed)
    train = counted(both.filter(~held), [*numeric, *categorical, "y"])
    return _detector_model(both, train, numeric, categorical, model, trees)(both.filter(held), "row_key")


def detector_report(real: DataFrame, syn: DataFrame, numeric: list[str], categorical: list[str], *, seed: int = 0, model: str = "forest", trees: int = 300) -> DataFrame:
    """(accuracy, auc, f1, ap, n_real, n_syn, n_features, n_encoded) of a detector: its metrics, the rows of both sides, and its columns before and after encoding."""
    both, held = _sides(real, syn, seed)
    every = counted(both.withColumn("_held", held), [*numeric, *categorical, "y", "_held"])
    predict = _detector_model(_each(every), every.filter(~F.col("_held")), numeric, categorical, model, trees)
    pred = predict(every.filter("_held"), "_n")
    path = scratch_path(real.sparkSession, "detected")
    pred.write.parquet(path)
    pred = real.sparkSession.read.schema(pred.schema).parquet(path)
    encoded = _prepare(every, numeric, categorical, {}).na.fill(0.0)
    encoded = len(_encoder(encoded, numeric, categorical).transform(encoded).select("features").first()[0])
    of = lambda side, name: F.coalesce(F.sum(F.when(F.col("y") == side, F.col("_n"))), F.lit(0)).alias(name)
    sizes = every.agg(of(0, "n_real"), of(1, "n_syn"))  # one row, as below
    return classification_metrics(pred, weight="_n").crossJoin(F.broadcast(average_precision(pred, "_n"))).crossJoin(F.broadcast(sizes)).withColumns(
        {"n_features": F.lit(len(numeric) + len(categorical)), "n_encoded": F.lit(encoded)})


def detector_importance(real: DataFrame, syn: DataFrame, numeric: list[str], categorical: list[str], *, seed: int = 0) -> DataFrame:
    """(feature, weight): what the detector's AUC loses when a column is shuffled among the held-out rows.

    A column is shuffled by giving each row the value of the row whose rank by one hash, in one of 256
    slices of the rows, is its own by another hash: every row gets one. One model serves all columns, and one table of rows with their partners.
    """
    both, held = _sides(real, syn, seed)
    names, spark = [*numeric, *categorical], real.sparkSession
    train = both.filter(~held).select(*names, "y", F.lit(1).cast("long").alias("_n"))  # row by row, as its 20 trees draw
    predict = _binary_model(train, numeric, categorical, "forest", 20)
    part = F.substring(hash_order(seed + 1, "row_key"), 1, 2)
    rank = lambda s: F.row_number().over(Window.partitionBy("_z").orderBy(hash_order(s, "row_key"), "row_key"))
    test = both.filter(held).select("row_key", *names, "y", part.alias("_z"))
    partner = test.select(F.col("_z").alias("_pz"), rank(seed + 2).alias("_pr"), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(names)))
    pairs = test.withColumn("_r", rank(seed + 1)).join(partner, (F.col("_z") == F.col("_pz")) & (F.col("_r") == F.col("_pr")))
    path = scratch_path(spark, "pairs")
    pairs.select(*names, "y", *(f"_p{i}" for i in range(len(names)))).write.parquet(path)
    pairs = spark.read.parquet(path)
    score = lambda rows: _auc_row(predict(counted(rows, [*names, "y"]), "_n"), "_n")
    rows, base = None, score(pairs).withColumnRenamed("auc", "base")
    for i, c in enumerate(names):
        row = score(pairs.withColumn(c, F.col(f"_p{i}"))).crossJoin(F.broadcast(base)).select(F.lit(c).alias("role"), (F.col("base") - F.col("auc")).alias("weight"))
        rows = row if rows is None else rows.unionByName(row)
    layout = rows.select("role", F.col("role").alias("feature"))
    return weighted_rollup(rows, layout)


def _auc_row(pred: DataFrame, weight: str | None = None) -> DataFrame:
    return classification_metrics(pred, weight=weight).select("auc")
