"""Risk scoring: features per taxpayer, peer percentiles, anomaly scores and explained predictions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assurelake.functions.scalar import clamp, total
from assurelake.operators.rules import customs_of, periods_of
from assurelake.operators.shapley import Explainer, Tree
from assurelake.sources.catalog import replace_tagged, written

SOURCE = "AI_RISK_SCORING"
# Weights of the rule-based contributions, by feature
WEIGHTS = {
    "invoiceSalesExceedDeclaredSales": ("invoice_to_declared_sales", 30),
    "customsValueExceedsDeclaredIncome": ("customs_to_declared_income", 24),
    "withholdingIncomeExceedsDeclaredIncome": ("withholding_to_declared_income", 18),
    "riskSignalGapPressure": ("risk_signal_gap_scaled", 12),
    "peerGroupOutlierPercentile": ("peer_group_percentile", 10),
    "sectorOutlierPercentile": ("sector_peer_percentile", 10),
    "ruleScoreSignal": ("rule_score_scaled", 6),
}
LABELS = {c: n for n, (c, _) in WEIGHTS.items()} | {"revenue_footprint_scaled": "revenueFootprintOutlier"}
FEATURES = [*dict.fromkeys(c for c, _ in WEIGHTS.values()), "revenue_footprint_scaled"]
MONEY = ("declared_sales", "declared_income", "invoice_sales", "customs_landed_cost", "withholding_income", "risk_signal_gap")
COUNTS = ("return_count", "invoice_count", "customs_count", "withholding_count", "open_signal_count")
#: Distinct footprints in a part of their range, about; there are as many parts as shuffle partitions at least.
PART_ROWS = 1_000_000


def observations(tables, signals: DataFrame, scores: DataFrame, as_of: date) -> DataFrame:
    """A row per active taxpayer; every source is aggregated to the taxpayer before it is joined."""

    def by(rows: DataFrame, who: str, *aggs: Column) -> DataFrame:
        return rows.filter(F.col(who).isNotNull()).groupBy(F.col(who).alias("taxpayer_id")).agg(*aggs)

    def given(sums: str, name: str, who: str) -> DataFrame:
        """Rows of a table with `n`, their number: its sums by month, where the tables have them."""
        return tables[sums] if sums in tables else tables[name].withColumns({"taxpayer_id": F.col(who), "n": F.lit(1)})

    money = lambda c, name: total(F.col(c) if isinstance(c, str) else c).alias(name)
    parts = [
        by(periods_of(tables), "taxpayer_id", F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), money("declared_sales", "declared_sales"), money("declared_income", "declared_income"), F.sum("returns").alias("return_count")),
        by(given("supplier_invoices", "invoices", "supplier_taxpayer_id"), "taxpayer_id", money("total_amount", "invoice_sales"), F.sum("n").alias("invoice_count")),
        by(customs_of(tables), "taxpayer_id", money("landed", "customs_landed_cost"), F.sum("n").alias("customs_count")),
        by(given("supplier_certificates", "withholding_certificates", "payee_taxpayer_id"), "taxpayer_id", money("gross_amount", "withholding_income"), F.sum("n").alias("withholding_count")),
        by(signals, "taxpayer_id", money(F.greatest("estimated_gap", F.lit(Decimal(0))), "risk_signal_gap"), F.count_if(F.upper("status").isin("OPEN", "NEW")).alias("open_signal_count")),
        by(scores.filter(F.col("source").isin("TAX_GAP_ENGINE", "RULE_ENGINE")), "taxpayer_id", F.max("score").alias("rule_score")),
    ]
    out = tables["taxpayers"].filter(F.upper("status") == "ACTIVE").select(F.col("id").alias("taxpayer_id"), "kra_pin", "legal_name", "sector_name", "county")
    for p in parts:
        out = out.join(p, "taxpayer_id", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return out.select(
        "taxpayer_id", "kra_pin", "legal_name", "sector_name", "county",
        F.coalesce("period_start", F.lit(as_of - timedelta(days=30))).alias("period_start"), F.coalesce("period_end", F.lit(as_of)).alias("period_end"),
        *[zero(c, "decimal(18,2)") for c in MONEY], zero("rule_score", "decimal(5,2)"), *[zero(c, "long") for c in COUNTS],
    )


def _excess(seen: str, said: str) -> Column:
    return F.greatest(F.col(seen) - F.col(said), F.lit(Decimal(0))).cast("double") / F.greatest(F.col(said), F.lit(Decimal(1))).cast("double")


def running_shares(values: DataFrame, keys: list[str], parts: int, name: str) -> DataFrame:
    """values (keys, footprint, c) with the share of the rows of its keys that aren't larger, in percent.

    Values are dealt to ranges of about equal volume, in each of which a window counts; the ranges before add
    what they hold. A group of keys may take many ranges, and a range hold many groups.
    """
    rows = values.groupBy(*keys, "footprint").agg(F.sum("c").alias("c")).repartitionByRange(parts, *keys, "footprint")
    rows = written(rows.withColumn("part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("part", *keys).orderBy("footprint").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy(*keys, "part").agg(F.sum("c").alias("size"))  # a row for each range of a group
    of_keys = keys or [F.lit(1)]
    before = Window.partitionBy(*of_keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"below": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(Window.partitionBy(*of_keys))})
    rows = rows.withColumn("here", F.sum("c").over(here)).join(sizes.drop("size"), [*keys, "part"])
    share = F.round(((F.col("here") + F.col("below")) * 100).cast("decimal(20,0)") / F.col("n").cast("decimal(18,0)"), 2).cast("decimal(5,2)")
    return rows.select(*keys, "footprint", share.alias(name))


def percentiles(obs: DataFrame) -> DataFrame:
    """obs with footprint and its percentiles among all taxpayers and in its sector (null is a sector).

    Shares are counted over distinct values, so equal ones are one row. They go back to the observations by
    value; the few values that more than a part's share of all rows have (fewer than there are parts) are sent to all
    tasks, so that a common one makes no large key.
    """
    spark = obs.sparkSession
    obs = written(obs, "observations")
    sum_of = F.col("invoice_sales") + F.col("customs_landed_cost") + F.col("withholding_income") + F.col("risk_signal_gap")
    obs = obs.withColumns({"footprint": sum_of.cast("decimal(22,2)"), "sector": F.coalesce("sector_name", F.lit("UNSPECIFIED"))})
    values = written(obs.groupBy("sector", "footprint").agg(F.count("*").alias("c")), "values")
    size = values.agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // PART_ROWS))
    keys = ["sector", "footprint"]
    shares = values.join(running_shares(values, [], parts, "all_percentile"), "footprint").join(running_shares(values, ["sector"], parts, "sector_percentile"), keys)
    shares = written(shares, "shares")
    common = F.col("c") * parts > size["rows"]  # holds for fewer values than there are parts
    out = obs.join(F.broadcast(shares.filter(common).drop("c")), keys)
    return out.unionByName(obs.join(shares.filter(~common).drop("c"), keys))


def features(obs: DataFrame) -> DataFrame:
    """The eight features of every observation."""
    rows = percentiles(obs)
    top = rows.agg(F.max("footprint").alias("m"))  # one row
    rows = rows.crossJoin(F.broadcast(top))
    cap = F.least(F.greatest("rule_score", F.lit(Decimal(0))), F.lit(Decimal(100)))
    return rows.withColumns(
        {
            "invoice_to_declared_sales": _excess("invoice_sales", "declared_sales"),
            "customs_to_declared_income": _excess("customs_landed_cost", "declared_income"),
            "withholding_to_declared_income": _excess("withholding_income", "declared_income"),
            "risk_signal_gap_scaled": F.col("risk_signal_gap").cast("double") / 100000.0,
            "rule_score_scaled": cap.cast("double") / 100.0,
            "revenue_footprint_scaled": F.col("footprint").cast("double") / F.greatest(F.col("m").cast("double"), F.lit(1.0)),
            "peer_group_percentile": F.col("all_percentile").cast("double") / 100.0,
            "sector_peer_percentile": F.col("sector_percentile").cast("double") / 100.0,
        }
    ).drop("m", "all_percentile", "sector_percentile", "sector")


def with_contributions(rows: DataFrame) -> DataFrame:
    """rows with each feature's contribution, their capped sum, the four largest, and the confidence."""
    points = {n: F.round(F.col(c).cast("decimal(24,10)") * w, 2).cast("decimal(18,2)") for n, (c, w) in WEIGHTS.items()}
    rows = rows.withColumns({f"c_{n}": x for n, x in points.items()})
    total = sum((F.col(f"c_{n}") for n in list(WEIGHTS)[1:]), F.col(f"c_{list(WEIGHTS)[0]}"))
    # by size, of equals in the stated order
    each = F.array(*[F.struct((-F.col(f"c_{n}")).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(WEIGHTS)])
    most = F.transform(F.slice(F.array_sort(F.filter(each, lambda x: x["v"] < 0)), 1, 4), lambda x: x["n"])
    evidence = sum(((F.col(c) > 0).cast("int") for c in COUNTS[1:]), (F.col(COUNTS[0]) > 0).cast("int"))
    return rows.withColumns(
        {
            "contribution_score": F.least(F.greatest(total, F.lit(Decimal(0))), F.lit(Decimal(100))).cast("decimal(5,2)"),
            "main_features": F.array_join(most, ","),
            "confidence_score": F.least(55 + 8 * evidence, F.lit(95)).cast("decimal(5,2)"),
        }
    )


# isolation forest: trees from samples of fixed size, scores by task

def grow(sample: np.ndarray, rng: np.random.Generator, depth: int) -> Tree:
    """One tree; the length of an inner node is the mean of the sample's rows that reach it."""
    feature, split, left, length, cover = [], [], [], [], []

    def add() -> int:
        feature.append(-1), split.append(0.0), left.append(-1), length.append(0.0), cover.append(0)
        return len(feature) - 1

    todo, inner = [(add(), sample, 0)], []
    while todo:
        at, rows, level = todo.pop()
        cover[at] = len(rows)
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if level >= depth or len(rows) <= 1 or not len(usable):
            length[at] = level + expected_path(len(rows))
            continue
        f = int(rng.choice(usable))
        s = float(rng.uniform(low[f], high[f]))
        a, b = add(), add()
        feature[at], split[at], left[at] = f, s, a
        below = rows[:, f] <= s
        inner.append((at, below.mean()))
        todo += [(a, rows[below], level + 1), (b, rows[~below], level + 1)]
    for at, share in reversed(inner):  # children come after their parent
        length[at] = share * length[left[at]] + (1 - share) * length[left[at] + 1]
    return np.array(feature), np.array(split), np.array(left), np.array(length), np.array(cover)


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a tree of n."""
    return 0.0 if n <= 1 else (1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def paths(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Path lengths of the rows of x."""
    feature, split, left, length, _ = tree
    at = np.zeros(len(x), dtype=np.int64)
    while (inner := feature[at] >= 0).any():
        rows, here = np.flatnonzero(inner), at[inner]
        at[rows] = left[here] + (x[rows, feature[here]] > split[here])
    return length[at]


def tree_samples(rows: DataFrame, trees: int, per_tree: int, seed: int, key: str) -> list[np.ndarray]:
    """For each tree the per_tree rows, out of all, with the smallest hash of seed, tree and key. Only rows
    under a threshold that about twice as many pass leave their task: trees * per_tree * 2 in all."""
    n = rows.count()
    top = 1 << 30
    limit = top if n <= 2 * per_tree else min(top, int(top * (2 * per_tree + 8 * per_tree**0.5) / n) + 1)
    drawn = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(top)).alias("h"))),
        lambda d: d["h"] < limit,
    )
    got = rows.select(F.explode(drawn).alias("d"), key, *[F.col(c).cast("double").alias(c) for c in FEATURES]).select("d.tree", "d.h", key, *FEATURES)
    frame = got.toPandas().sort_values(["tree", "h", key])
    return [g[FEATURES].to_numpy(dtype=float) for _, g in frame.groupby("tree").head(per_tree).groupby("tree")]


def grown_forest(rows: DataFrame, trees: int = 128, per_tree: int = 256, seed: int = 42, key: str = "taxpayer_id") -> list[Tree]:
    """Trees of samples of all rows; none without rows."""
    rng = np.random.default_rng(seed)
    return [grow(s, rng, int(np.ceil(np.log2(max(2, len(s)))))) for s in tree_samples(rows, trees, per_tree, seed, key)]


def explained(rows: DataFrame, forest: list[Tree], key: str = "taxpayer_id") -> DataFrame:
    """(key, path_length, base_length, a column for each feature): the mean path length of every row, that of
    the training rows, and the Shapley values that sum to the difference."""
    shared = rows.sparkSession.sparkContext.broadcast((forest, Explainer(forest, len(FEATURES))))  # trees * per_tree leaves

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, explainer = shared.value
        for frame in frames:
            for start in range(0, frame.num_rows, 2000):
                some = frame.slice(start, 2000)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in some.columns[1:]])
                mean = sum(paths(t, x) for t in trees) / len(trees)
                cols = [some.column(0), pa.array(mean), pa.array(np.full(len(x), explainer.base)), *(pa.array(np.ascontiguousarray(c)) for c in explainer.values(x).T)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "path_length", "base_length", *FEATURES])

    given = rows.select(key, *[F.col(c).cast("double") for c in FEATURES])
    return given.mapInArrow(run, f"{key} string, path_length double, base_length double, " + ", ".join(f"{c} double" for c in FEATURES))


def isolation_scores(rows: DataFrame, trees: int = 128, per_tree: int = 256, seed: int = 42, key: str = "taxpayer_id") -> DataFrame:
    """rows with isolation_score: how early random splits set a row apart, scaled to 0..100 over all rows; and
    forest_contributions: ten times the absolute Shapley value of each feature in the mean path length."""
    rows = written(rows, "features")
    forest = grown_forest(rows, trees, per_tree, seed, key)
    kind = "map<string,decimal(18,2)>"
    if not forest:
        return rows.withColumns({"isolation_score": F.lit(None).cast("decimal(5,2)"), "forest_contributions": F.lit(None).cast(kind)})
    norm = max(expected_path(int(forest[0][4][0])), 1e-9)
    raw = explained(rows, forest, key).withColumn("raw", F.pow(F.lit(2.0), -F.col("path_length") / norm))
    raw = written(raw, "isolation")
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))  # one row
    scaled = F.round((F.col("raw") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)) * 100, 2).cast("decimal(5,2)")
    given = F.create_map(*[x for c in FEATURES for x in (F.lit(LABELS[c]), F.round(F.abs(c) * 10, 2).cast("decimal(18,2)"))])
    return rows.join(raw.crossJoin(F.broadcast(ends)).select(key, scaled.alias("isolation_score"), given.alias("forest_contributions")), key)


def blend(rows: DataFrame) -> DataFrame:
    """rows with model_score and combined_score."""
    rule = F.least(F.greatest("rule_score", F.lit(Decimal(0))), F.lit(Decimal(100)))
    rows = rows.withColumn("model_score", F.greatest("isolation_score", "contribution_score").cast("decimal(5,2)"))
    mixed = F.round(F.col("model_score") * F.lit(Decimal("0.65")) + rule * F.lit(Decimal("0.35")), 2)
    return rows.withColumn("combined_score", mixed.cast("decimal(5,2)"))


def predict(obs: DataFrame, seed: int = 42) -> DataFrame:
    """Predictions of all observations; none for no observations."""
    return blend(isolation_scores(with_contributions(features(obs)), seed=seed))


def model_version(obs: DataFrame, name: str = "taxpayer-risk", seed: int = 42) -> DataFrame:
    """A name for model and data: the same rows in any order have the same. Each row's SHA-256 is summed in
    four pieces of 48 bits, so no task holds all rows, and the sums are hashed."""
    columns = sorted(obs.columns)
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    pieces = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)]
    digest = obs.agg(F.count("*").alias("n"), *pieces)
    text = F.concat_ws("|", F.lit(name), F.lit(str(seed)), F.lit(",".join(columns)), "n", *[F.coalesce(F.col(f"h{i}").cast("string"), F.lit("0")) for i in range(4)])
    return digest.select(F.lit(name).alias("model_name"), F.concat(F.lit("risk-"), F.substring(F.sha2(text, 256), 1, 12)).alias("version"))


def run_metrics(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count("*").alias("scored"), F.round(F.avg("model_score"), 2).cast("decimal(5,2)").alias("average_model_score"), F.count_if(F.col("combined_score") >= 70).alias("high_risk"))


def upsert_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """All versions with the new one active and every other one not."""
    old = versions.join(new, ["model_name", "version"], "left_anti").withColumn("active", F.lit(False))
    return old.unionByName(new.withColumn("active", F.lit(True)))


def persist_scores(scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """The scores table with this engine's rows replaced."""
    rows = predictions.select("taxpayer_id", F.col("combined_score").alias("score"), F.lit(SOURCE).alias("source"))
    return replace_tagged(scores.select("taxpayer_id", "score", "source"), rows, "source", SOURCE)


def prediction_list(predictions: DataFrame, limit: int = 20) -> DataFrame:
    return predictions.orderBy(F.desc_nulls_last("combined_score"), "taxpayer_id").limit(clamp(limit, 100))


def version_list(versions: DataFrame, name: str = "taxpayer-risk") -> DataFrame:
    """Versions of a model: the active one first, then the newest."""
    return versions.filter(F.col("model_name") == name).orderBy(F.desc("active"), F.desc_nulls_last("created_at"), "version")


def dashboard(predictions: DataFrame, scores: DataFrame, versions: DataFrame, name: str = "taxpayer-risk") -> DataFrame:
    """One row: the active version, the number and mean score of the model's predictions (model_score by
    version), and the number of high risks and the mean of this engine's scores."""
    active = versions.filter((F.col("model_name") == name) & F.col("active")).agg(F.coalesce(F.max("version"), F.lit("none")).alias("active_version"))
    known = versions.filter(F.col("model_name") == name).select("version")
    mean = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0)).cast("decimal(5,2)")
    made = predictions.join(F.broadcast(known), "version", "left_semi").agg(F.count("*").alias("predictions"), mean("model_score").alias("average_model_score"))  # versions of one model
    own = scores.filter(F.col("source") == SOURCE).agg(F.count_if(F.col("score") >= 70).alias("high_risk"), mean("score").alias("average_combined_score"))
    return active.crossJoin(made).crossJoin(own)  # one row each
