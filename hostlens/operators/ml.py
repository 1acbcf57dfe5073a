"""Training, evaluation and promotion of detection models as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.sources.sinks import removed, scratch


def stratified_split(df: DataFrame, id_col: str, label_col: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``: in each label the first share of rows in order of a seeded hash, exactly.

    Rows are counted by hash prefix; only the prefix in which the cut falls needs its rows in order.
    """
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed).cast("string")))
    rows = df.withColumns({"__h": h, "__b": F.substring(h, 1, 3)})
    n = rows.groupBy(label_col, "__b").agg(F.count("*").alias("__n"))
    by = W.partitionBy(label_col)
    n = n.withColumns({"__before": F.sum("__n").over(by.orderBy("__b")) - F.col("__n"), "__cut": F.floor(F.sum("__n").over(by) * share + 0.5)})
    n = n.select(F.col(label_col).alias("__l"), F.col("__b").alias("__k"), "__n", "__before", "__cut")
    # Labels are few, and each has at most 4,096 prefixes: rows with all their features stay where they are.
    rows = rows.join(F.broadcast(n), F.col(label_col).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__k")))
    inside = (F.col("__before") < F.col("__cut")) & (F.col("__before") + F.col("__n") > F.col("__cut"))
    edge = rows.where(inside).withColumn("is_train", F.row_number().over(W.partitionBy(label_col, "__b").orderBy("__h", id_col)) + F.col("__before") <= F.col("__cut"))
    rest = rows.where(~inside).withColumn("is_train", F.col("__before") < F.col("__cut"))
    return edge.unionByName(rest).drop("__h", "__b", "__l", "__k", "__n", "__before", "__cut")


def confusion(df: DataFrame, label_col: str, prediction_col: str, by: list[str] = ()) -> DataFrame:
    """Confusion counts and the measures that follow (0 where a measure isn't defined)."""
    y, p = F.col(label_col), F.col(prediction_col)
    n = df.groupBy(*by).agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    r = lambda a, b: a / F.greatest(F.lit(1), b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = n.withColumns({"accuracy": r(tp + tn, tp + fp + tn + fn), "precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "fpr": r(fp, fp + tn), "fnr": r(fn, fn + tp)})
    return n.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def recall_by_category(df: DataFrame, label_col: str, prediction_col: str, category_col: str) -> DataFrame:
    return df.where(F.col(label_col) == 1).groupBy(category_col).agg(F.count("*").alias("n"), (F.count_if(F.col(prediction_col) == 1) / F.count("*")).alias("recall"))


def verdict(prediction: Column, score: Column, probability: Column) -> tuple[Column, Column]:
    """Anomaly and attack from a forest's prediction and score and a classifier's probability."""
    anomaly = (prediction == -1) | (score < 0)
    return anomaly, (probability > 0.992) | ((probability > 0.95) & anomaly)


TRAINED_IN_A_TASK = 10_000  #: rows of boosted trees that a task learns from


def train_boosted(df: DataFrame, features: list[str], label_col: str = "label", trees: int = 20, depth: int = 4, step: float = 0.1, seed: int = 42):
    """Boosted trees; attacks weigh as many times more as they are rarer.

    A tree takes a job for each level, so rows are dealt evenly over as many tasks as they need, however few files or
    however many groups they come from. They are worked out twice, to be counted and to be dealt.
    """
    n = df.groupBy().agg(F.count_if(F.col(label_col) == 1).alias("p"), F.count_if(F.col(label_col) == 0).alias("n"), F.count("*").alias("rows")).first()
    weight = n["n"] / max(1, n["p"])
    rows = VectorAssembler(inputCols=features, outputCol="__v").transform(df).select(label_col, "__v", F.when(F.col(label_col) == 1, float(weight)).otherwise(1.0).alias("__w"))
    rows = rows.repartition(max(1, math.ceil(n["rows"] / TRAINED_IN_A_TASK)))
    return GBTClassifier(featuresCol="__v", labelCol=label_col, weightCol="__w", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, minInstancesPerNode=3, seed=seed).fit(rows)


def apply_boosted(model, df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(VectorAssembler(inputCols=features, outputCol="__v").transform(df))
    return rows.withColumns({"prob": vector_to_array("probability")[1], "prediction": F.col("prediction").cast("int")}).drop("__v", "rawPrediction", "probability")


def importances(model, features: list[str], spark, n: int = 20) -> DataFrame:
    pairs = sorted(((float(v), f) for f, v in zip(features, model.featureImportances.toArray(), strict=True)), reverse=True)[:n]
    return spark.createDataFrame([(f, v) for v, f in pairs], "feature string, importance double")


NODE = "tree int, node int, feature int, cut double, size int"


def isolation_forest(normal: DataFrame, id_col: str, vector_col: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Trees as a table of nodes (children of node k are 2k and 2k + 1; feature -1: a leaf with its size).

    Each tree has its own sample of at most ``sample`` rows, chosen by hash, and is grown in a task of its own.
    """
    total = normal.count()
    share = min(1.0, 2.0 * sample / max(1, total))
    rows = normal.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # Only the trees that draw a row get a copy of it.
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    rows = rows.select("*", F.explode(drawn).alias("tree")).withColumn("key", F.xxhash64("id", "tree", F.lit(seed)))

    def grow(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, k[0]])
        x = np.stack(pdf.sort_values(["key", "id"])["v"].head(sample).to_list())
        out, limit = [], max(1, math.ceil(math.log2(max(2, len(x)))))
        todo = [(1, np.arange(len(x)), 0)]
        while todo:
            node, rows_in, depth = todo.pop()
            part = x[rows_in]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows_in) > 1 else []
            if depth >= limit or not len(spread):
                out.append((k[0], node, -1, 0.0, len(rows_in)))
                continue
            f = int(rng.choice(spread))
            cut = rng.uniform(part[:, f].min(), part[:, f].max())
            out.append((k[0], node, f, cut, len(rows_in)))
            left = part[:, f] < cut
            todo += [(2 * node, rows_in[left], depth + 1), (2 * node + 1, rows_in[~left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size"])

    return rows.groupBy("tree").applyInPandas(grow, NODE)


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def forest_scores(df: DataFrame, id_col: str, vector_col: str, nodes: DataFrame, sample: int = 256) -> DataFrame:
    """(id, score) with scores towards 1 for points that few cuts isolate. The node table's size is set by trees and sample."""
    table = nodes.toPandas().sort_values(["tree", "node"])
    forest = [(t["node"].to_numpy(), t["feature"].to_numpy(), t["cut"].to_numpy(), t["size"].to_numpy()) for _, t in table.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    kind = dict(df.dtypes)[id_col]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x, total = np.stack(pdf["v"].to_list()), np.zeros(len(pdf))
            for names, feature, cut, size in shared.value:
                node, depth, live = np.ones(len(x), np.int64), np.zeros(len(x)), np.arange(len(x))
                while len(live):
                    at = np.searchsorted(names, node[live])
                    leaf = feature[at] < 0
                    depth[live[leaf]] += _average_path(size[at[leaf]])
                    live, at = live[~leaf], at[~leaf]
                    depth[live] += 1
                    node[live] = 2 * node[live] + (x[live, feature[at]] >= cut[at])
                total += depth
            yield pd.DataFrame({"id": pdf["id"], "score": 2.0 ** (-(total / len(shared.value)) / float(_average_path(sample)))})

    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(score, f"id {kind}, score double").withColumnRenamed("id", id_col)


def with_anomaly(scores: DataFrame, contamination: float) -> DataFrame:
    """Add ``is_anomaly``: the share of highest scores."""
    cut = scores.agg(F.percentile_approx("score", F.lit(1 - contamination), 100_000).alias("__cut"))  # a sketch of bounded size
    return scores.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col("score") > F.col("__cut")).drop("__cut")


def acceptance(candidate: DataFrame, baseline: DataFrame, keys: list[str], min_recall: float = 0.85, min_f1: float = 0.8, max_fpr: float = 0.05, recall_drop: float = 0.02, fpr_rise: float = 0.02) -> DataFrame:
    """Accept a candidate by its own measures and against the approved model's on the same rows."""
    b = baseline.select(*keys, F.col("recall").alias("b_recall"), F.col("fpr").alias("b_fpr"))
    rows = candidate.join(b, keys, "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("recall") < min_recall, "recall too low"), F.when(F.col("f1") < min_f1, "f1 too low"), F.when(F.col("fpr") > max_fpr, "fpr too high"),
        F.when(F.col("b_recall") - F.col("recall") > recall_drop, "recall fell"), F.when(F.col("fpr") - F.col("b_fpr") > fpr_rise, "fpr rose"),
    ))
    return rows.withColumns({"reasons": reasons, "accepted": F.size(reasons) == 0})


# Columns of a collector's own events, of which no two are in a feature matrix.
COLLECTOR_COLUMNS = "event_id instance_id event_type syscall_category comm ts_epoch tid"


def foreign_columns(columns: list[str], tokens: str | None = None) -> tuple[list[str], list[str]]:
    """Columns of collector events, and ``sc_`` columns whose tokens are of another kind than ``tokens`` ("numbers" or "names")."""
    raw = [c for c in columns if c in COLLECTOR_COLUMNS.split()]
    number = lambda c: c[3:].split("_")[0].isdigit()
    mixed = [c for c in columns if c.startswith("sc_") and tokens is not None and number(c) != (tokens == "numbers")]
    return raw, mixed


def validate(df: DataFrame, features: list[str], label_col: str | None = "label", tokens: str | None = None) -> DataFrame:
    """One row of counts by which training data is judged: rows, missing columns, bad labels, nulls, NaN or infinite values, repeated rows.

    ``raw_columns`` counts columns of collector events, which must be made features first, and ``mixed_columns`` those of
    another data set's schema; ``usable`` is false with two raw columns, a mixed one, or without rows.
    """
    raw, mixed = foreign_columns(df.columns, tokens)
    have = [f for f in features if f in df.columns]
    number = [F.col(f).try_cast("double") for f in have]
    null = sum((F.when(F.col(f).isNull(), 1).otherwise(0) for f in have), F.lit(0))
    odd = sum((F.when(F.isnan(x) | (F.abs(x) == float("inf")), 1).otherwise(0) for x in number), F.lit(0))
    text = sum((F.when(F.col(f).isNotNull() & x.isNull(), 1).otherwise(0) for f, x in zip(have, number, strict=True)), F.lit(0))
    label = F.col(label_col).try_cast("double") if label_col and label_col in df.columns else F.lit(0.0)
    key = F.xxhash64(*have) if have else F.lit(0)
    return df.agg(
        F.count("*").alias("rows"), F.lit(len(features) - len(have)).alias("missing_features"), F.count_if(label.isNull() | ~label.isin(0.0, 1.0)).alias("bad_labels"), F.coalesce(F.sum(null), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(odd), F.lit(0)).alias("not_finite"), F.coalesce(F.sum(text), F.lit(0)).alias("not_numeric"), (F.count("*") - F.count_distinct(key)).alias("repeated_rows"), F.count_distinct(label).alias("classes"),
        F.lit(len(raw)).alias("raw_columns"), F.lit(len(mixed)).alias("mixed_columns"), ((F.count("*") > 0) & F.lit(len(raw) < 2 and not mixed)).alias("usable"),
    )


def split_leakage(train: DataFrame, val: DataFrame, features: list[str]) -> DataFrame:
    a, b = train.select(*features).distinct(), val.select(*features).distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    rows = one(a, "n_train").crossJoin(one(b, "n_val")).crossJoin(one(a.intersect(b), "overlap"))
    return rows.withColumn("leakage_ratio", F.col("overlap") / F.greatest(F.lit(1), F.col("n_val")))


def active_runs(ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The model in force per key: the last promoted of the accepted runs, and the one before it for a rollback."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    promoted = ledger.where("action = 'promote' and status = 'ACCEPTED'").withColumn("__n", F.row_number().over(w))
    return promoted.groupBy(*keys).agg(F.max(F.when(F.col("__n") == 1, F.col("run_id"))).alias("active"), F.max(F.when(F.col("__n") == 2, F.col("run_id"))).alias("previous"))


LEDGER = "run_no long, dataset string, model string, action string, status string, path string, rows long, n_train long, n_test long, leakage_ratio double, recall double, fpr double, f1 double, reasons array<string>"


def retrain(rows: DataFrame, features: list[str], id_col: str, label_col: str, folder: str, dataset: str, promote: bool = True, trees: int = 20, depth: int = 4, step: float = 0.1, **gate) -> dict:
    """Validate, split, check for leakage, train, evaluate, save the model, gate it, and append what happened to the ledger.

    An accepted model is promoted by another row. The gate compares with the model in force, on the same test rows.
    Data that fails validation is not trained on. Returns the run's ledger row.
    """
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    try:
        old = spark.read.schema(LEDGER).parquet(f"{folder}/ledger").where((F.col("dataset") == dataset) & (F.col("model") == "boosted"))
        number = (old.agg(F.max("run_no").alias("n")).head()["n"] or 0) + 1
        active = old.where("action = 'promote'").orderBy(F.desc("run_no")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        number, active = 1, []
    dealt = scratch(spark)  # once, for all that a run does with them
    stratified_split(rows, id_col, label_col).repartition(spark.sparkContext.defaultParallelism).write.parquet(dealt)
    try:
        entry = _run(spark.read.parquet(dealt), features, label_col, f"{folder}/models/{number}", active[0]["path"] if active else None, trees, depth, step, gate)
    finally:
        removed(spark, dealt)
    entry |= {"run_no": number, "dataset": dataset, "model": "boosted", "action": "train"}
    names = [c.split()[0] for c in LEDGER.split(", ")]
    log = [entry, *([entry | {"action": "promote"}] if promote and entry["status"] == "ACCEPTED" else [])]
    spark.createDataFrame([tuple(e.get(c) for c in names) for e in log], LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    return entry


def _run(split: DataFrame, features: list[str], label_col: str, path: str, active: str | None, trees: int, depth: int, step: float, gate: dict) -> dict:
    """What a retraining run finds, as columns of its ledger row. The model goes to ``path``; ``active`` is where the one in force is."""
    from pyspark.ml.classification import GBTClassificationModel

    train, test = split.where("is_train"), split.where("not is_train")
    found = validate(split, features, label_col).head()
    entry = {"status": "INVALID", "path": "", "rows": found["rows"], "n_train": train.count(), "n_test": test.count(), "reasons": []}
    if found["bad_labels"] + found["nulls"] + found["not_finite"] + found["not_numeric"] + found["missing_features"] == 0 and found["usable"]:
        model = train_boosted(train, features, label_col, trees, depth, step)
        model.write().overwrite().save(path)
        measure = lambda m: confusion(apply_boosted(m, test, features), label_col, "prediction").withColumn("model", F.lit("boosted"))
        mine = measure(model)
        base = measure(GBTClassificationModel.load(active)) if active else mine.limit(0)
        judged = acceptance(mine, base, ["model"], **gate).head()
        entry |= {"path": path, "status": "ACCEPTED" if judged["accepted"] else "REJECTED", "leakage_ratio": split_leakage(train, test, features).head()["leakage_ratio"], "recall": judged["recall"], "fpr": judged["fpr"], "f1": judged["f1"], "reasons": judged["reasons"]}
    return entry
