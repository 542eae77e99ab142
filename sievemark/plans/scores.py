"""Queries on classifier scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import error_type, temperature_scaled
from ..operators import ranking
from ..storage import Workspace
from .catalogue import query
from .views import SQL_SCORES, scores

THRESHOLD = 0.359516855691905
TEMPERATURE = 1.18576874816716
WITH = f"with {SQL_SCORES} "
_AUC = "(select (sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) as auroc from (select label, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2.0 as r from good))"
_AP = "(select sum(case when label = 1 then tp / rn end) / sum(label) as auprc from (select label, sum(label) over w as tp, row_number() over w as rn from good window w as (order by probability desc, image_key rows unbounded preceding)))"
_BIN = " + ".join(f"(probability >= {i} * 0.1::double)::int" for i in range(1, 10))
_ECE = f"(select sum(n * abs(mp - ml)) / sum(n) as ece from (select count(*) as n, avg(probability) as mp, avg(label) as ml from good group by {_BIN}))"
_NAN = "'nan'::double"
_COUNTS = f"count(*) as n, count(*) filter (label = 1) as positives, count(*) filter (label = 0) as negatives, count(*) filter (label = 1 and probability >= {THRESHOLD}::double) as tp, count(*) filter (label = 0 and probability < {THRESHOLD}::double) as tn, count(*) filter (label = 0 and probability >= {THRESHOLD}::double) as fp, count(*) filter (label = 1 and probability < {THRESHOLD}::double) as fn, avg((probability - label) ** 2) as brier"


def _ratios(source: str, extra: str = "") -> str:
    return f"""select *, (case when precision + sensitivity = 0 then 0 else 2 * precision * sensitivity / (precision + sensitivity) end)::double as f1 from (
        select {extra} n, positives, negatives, tp, tn, fp, fn, brier, {THRESHOLD}::double as threshold, (tp + tn) / n as accuracy,
        case when tp + fn = 0 then {_NAN} else tp / (tp + fn) end as sensitivity, case when tn + fp = 0 then {_NAN} else tn / (tn + fp) end as specificity,
        (case when tp + fp = 0 then 0 else tp / (tp + fp) end)::double as precision,
        (case when tp + fn = 0 then {_NAN} else tp / (tp + fn) end + case when tn + fp = 0 then {_NAN} else tn / (tn + fp) end) / 2 as balanced_accuracy from ({source}))"""


@query("roc_auc", WITH + f"select auroc from {_AUC}")
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.roc_auc(scores(spark, folder), Workspace(spark, "auc"))


@query("average_precision", WITH + f"select auprc from {_AP}")
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.average_precision(scores(spark, folder), Workspace(spark, "ap"), "image_key")


@query("brier", WITH + "select avg((probability - label) ** 2) as brier from good")
def brier(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.threshold_metrics(scores(spark, folder), THRESHOLD).select("brier")


@query("ece_10", WITH + f"select ece from {_ECE}")
def ece_10(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.calibration_error(scores(spark, folder))


@query("reliability_bins", WITH + "select least(floor(probability * 10), 9)::int as bin, count(*) as n, avg(probability) as mean_probability, avg(label) as mean_label from good group by 1")
def reliability_bins(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.binned(scores(spark, folder), F.least(F.floor(F.col("probability") * 10), F.lit(9)).cast("int"))


_BIN20 = " + ".join(f"(probability >= {i} * 0.05::double)::int" for i in range(1, 20))


@query("score_histogram", WITH + f"select label, {_BIN20} as bin, count(*) as n from good group by 1, 2")
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    good = scores(spark, folder).where("label in (0, 1) and probability is not null")
    return good.groupBy("label", ranking.edge_bin(F.col("probability"), 20).alias("bin")).agg(F.count("*").alias("n"))


@query("confusion_metrics", WITH + f"select * from ({_ratios(f'select {_COUNTS} from good')}), {_AUC}, {_AP}, (select ece as ece_10_bin from {_ECE})")
def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.classification_report(scores(spark, folder), Workspace(spark, "report"), THRESHOLD, "image_key")


_YOUDEN = """select t as threshold, tp / pos as sensitivity, 1 - fp / neg as specificity from (
    select t, sum(p) over (order by t desc) as tp, sum(q) over (order by t desc) as fp, sum(p) over () as pos, sum(q) over () as neg from (
        select t, sum(p) as p, sum(q) as q from (select probability as t, label as p, 1 - label as q from good union all select 0.0, 0, 0 union all select 1.0, 0, 0) group by t))
    order by tp * neg - fp * pos desc, tp desc, t desc limit 1"""


@query("youden_threshold", WITH + _YOUDEN)
def youden_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.youden_threshold(scores(spark, folder), Workspace(spark, "youden"))


_SCALED = f"1 / (1 + exp(-ln(greatest(1e-7, least(1 - 1e-7, raw_probability)) / (1 - greatest(1e-7, least(1 - 1e-7, raw_probability)))) / {TEMPERATURE}::double))"


@query("temperature_scale", WITH + f"select image_key, {_SCALED} as scaled from sc where raw_probability between 0 and 1")
def temperature_scale(spark: SparkSession, folder: str) -> DataFrame:
    return scores(spark, folder).where("raw_probability between 0 and 1").select("image_key", temperature_scaled(F.col("raw_probability"), TEMPERATURE).alias("scaled"))


_FIT = """select temperature, loss from (select i, t as temperature, -sum(pos * ln(q) + neg * ln(1 - q)) / sum(pos + neg) as loss from (
    select i, t, pos, neg, greatest(1e-7::double, least(1 - 1e-7::double, 1 / (1 + exp(-ln(c / (1 - c)) / t)))) as q from (
        select greatest(1e-7::double, least(1 - 1e-7::double, probability)) as c, sum(label) as pos, sum(1 - label) as neg from good group by 1),
        (select i, exp(ln(0.1::double) + i * ((ln(10.0::double) - ln(0.1::double)) / 2000)) as t from range(2001) r(i))) group by 1, 2) order by round(loss, 12), i limit 1"""


@query("fit_temperature", WITH + _FIT)
def fit_temperature(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.fit_temperature(scores(spark, folder))


_LONG = "long as (select 'anatomy' as field, anatomy as value, * from good union all select 'view', view, * from good union all select 'hardware', hardware::varchar, * from good where hardware is not null)"
_SUB = f"""with {SQL_SCORES}, {_LONG},
    a as (select field, value, (sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * sum(1 - label), 0) as auroc from (select field, value, label, rank() over (partition by field, value order by probability) + (count(*) over (partition by field, value, probability) - 1) / 2.0 as r from long) group by 1, 2),
    b as (select field, value, sum(case when label = 1 then tp / rn end) / nullif(sum(label), 0) as auprc from (select field, value, label, sum(label) over w as tp, row_number() over w as rn from long window w as (partition by field, value order by probability desc, image_key rows unbounded preceding)) group by 1, 2),
    c as (select field, value, sum(n * abs(mp - ml)) / sum(n) as ece_10_bin from (select field, value, count(*) as n, avg(probability) as mp, avg(label) as ml from long group by 1, 2, {_BIN}) group by 1, 2)
    select field, value, n, case when positives > 0 and negatives > 0 then null else 'single-class subgroup' end as note, {", ".join(f"case when positives > 0 and negatives > 0 then {m} end as {m}" for m in ("auroc", "auprc", "ece_10_bin", "brier", "sensitivity", "specificity", "f1"))}
    from ({_ratios(f"select field, value, {_COUNTS} from long group by 1, 2", "field, value,")}) join a using (field, value) join b using (field, value) join c using (field, value)"""


@query("subgroup_metrics", _SUB)
def subgroup_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics per value of anatomy, view and hardware, in one pass over a long form."""
    good = scores(spark, folder)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("anatomy", "view", "hardware")])
    long = good.select("image_key", "label", "probability", F.inline(fields)).where("value is not null")
    report = ranking.classification_report(long, Workspace(spark, "subgroups"), THRESHOLD, "image_key", ("field", "value"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return report.select("field", "value", "n", F.when(~both, "single-class subgroup").alias("note"), *[F.when(both, F.col(m)).alias(m) for m in ("auroc", "auprc", "ece_10_bin", "brier", "sensitivity", "specificity", "f1")])


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, folder: str, replicates: int = 1000) -> DataFrame:
    """95 % intervals of the reference's eight metrics over 1000 replicates."""
    rows = scores(spark, folder).select(F.col("image_key").alias("key"), "label", "probability")
    ws = Workspace(spark, "bootstrap")
    rows = ws.keep(rows, "scores")
    return ranking.bootstrap(rows, THRESHOLD, replicates, 20260912).union(ranking.bootstrap_ranked(rows, ws, replicates, 20260912))


@query("class_weight", WITH + "select (sum(1 - label) / sum(label))::double as positive_weight from good")
def class_weight(spark: SparkSession, folder: str) -> DataFrame:
    good = scores(spark, folder).where("label in (0, 1) and probability is not null")
    return good.agg(F.try_divide(F.sum(1 - F.col("label")), F.sum("label")).alias("positive_weight"))


@query("metric_input_violations", f"with {SQL_SCORES} select count(*) as n, count(*) filter (probability is null or label is null) as missing, count(*) filter (label not in (0, 1)) as bad_labels, count(*) filter (isnan(probability) or probability < 0 or probability > 1) as bad_probabilities from sc")
def metric_input_violations(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.violations(scores(spark, folder))


_ERR = "case when label = 1 and prediction = 0 then 'false_negative' when label = 0 and prediction = 1 then 'false_positive' else 'correct' end"


@query("ranked_errors", WITH + f"""select * from (select image_key, error_type, probability, row_number() over (partition by error_type order by case when error_type = 'false_negative' then probability else -probability end, image_key) as place
    from (select image_key, probability, {_ERR} as error_type from good where prediction is not null) where error_type <> 'correct') where place <= 20""")
def ranked_errors(spark: SparkSession, folder: str, examples: int = 20) -> DataFrame:
    """The most confident errors of either kind: top-k by a bounded sort, not a global one."""
    rows = scores(spark, folder).where("label in (0, 1) and probability is not null and prediction is not null").select("image_key", "probability", error_type(F.col("label"), F.col("prediction")).alias("error_type"))
    from pyspark.sql import Window

    tops = []
    for kind, first in (("false_negative", F.col("probability")), ("false_positive", F.col("probability").desc())):
        top = rows.where(F.col("error_type") == kind).orderBy(first, "image_key").limit(examples)
        tops.append(top.withColumn("place", F.row_number().over(Window.partitionBy("error_type").orderBy(first, "image_key"))))
    return tops[0].union(tops[1])


@query("error_counts", WITH + f"select field, value, error_type, count(*) as n from (select 'anatomy' as field, anatomy as value, {_ERR} as error_type from good where prediction is not null union all select 'view', view, {_ERR} from good where prediction is not null) where error_type <> 'correct' group by 1, 2, 3")
def error_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = scores(spark, folder).where("label in (0, 1) and probability is not null and prediction is not null").withColumn("error_type", error_type(F.col("label"), F.col("prediction"))).where("error_type <> 'correct'")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("anatomy", "view")])
    return rows.select("error_type", F.inline(fields)).groupBy("field", "value", "error_type").agg(F.count("*").alias("n"))


_EPOCH = """with e as (select year(recorded_at) * 12 + month(recorded_at) as epoch, avg(probability) as primary_metric, avg((probability - label) ** 2) as secondary from classifier_prediction where probability is not null and label in (0, 1) and recorded_at is not null group by 1)
    select epoch, primary_metric, secondary, max(primary_metric) over w as best_so_far, epoch - max(epoch) filter (improved) over w as stale, epoch = (select arg_max(epoch, (primary_metric, -secondary, -epoch)) from e) as is_best
    from (select *, coalesce(primary_metric > max(primary_metric) over (order by epoch rows between unbounded preceding and 1 preceding), true) as improved from e) window w as (order by epoch rows unbounded preceding)"""


@query("epoch_selection", _EPOCH)
def epoch_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Best epoch and patience over a history; months of predictions stand for epochs."""
    from ..operators.history import early_stopping
    from ..sources.tables import table

    rows = table(spark, folder, "classifier_prediction", "recorded_at", "probability", "label").where("probability is not null and label in (0, 1) and recorded_at is not null")
    gap = F.col("probability") - F.col("label")
    history = rows.groupBy((F.year("recorded_at") * 12 + F.month("recorded_at")).alias("epoch")).agg(F.avg("probability").alias("primary_metric"), F.avg(gap * gap).alias("secondary"))
    return early_stopping(history)
