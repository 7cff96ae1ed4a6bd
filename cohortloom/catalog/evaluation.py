"""Thresholds, metrics, error analysis, fairness and drift on the prediction views."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query
from cohortloom.operators import confusion as cf
from cohortloom.operators import drift as dr
from cohortloom.operators import metrics as mx
from cohortloom.operators import profile as pf
from cohortloom.operators import scores as sc
from cohortloom.operators.curate import sample_order
from cohortloom.functions.numbers import age_bucket
from cohortloom.functions.text import token_length
from cohortloom.session import fresh_path
from cohortloom.sources.views import LABELS
from cohortloom.streaming import jobs

K_LIST = (1, 3, 5)
N = len(LABELS)


def _round(df, *columns, digits=9):
    """Sums of floats differ in the last bits with the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "pr_curve",
    """SELECT icd_code, score, tp, predicted, tp / predicted AS precision, tp / n_pos AS recall, n_pos
       FROM curve""",
)
def _(t):
    return mx.pr_curve(t.scored)


def _tuned(gain, low, support=5):
    return f"""SELECT icd_code, CASE WHEN n_pos >= {support} THEN score ELSE 0.5 END AS threshold,
      n_pos AS support, n_pos >= {support} AS tuned FROM (SELECT *, row_number() OVER (PARTITION BY icd_code
      ORDER BY {gain} DESC, {low}) AS rn FROM curve) WHERE rn = 1"""


_F1_GAIN = "2.0::DOUBLE * tp / (predicted + n_pos)"


@query("tune_thresholds_f1", _tuned(_F1_GAIN, "score"))
def _(t):
    return mx.tune_thresholds(t.scored, "f1")


@query("tune_thresholds_youden", _tuned("tp / n_pos - (1.0::DOUBLE - tp / predicted)", "score"))
def _(t):
    return mx.tune_thresholds(t.scored, "youden")


@query(
    "tune_thresholds_default",
    _tuned(_F1_GAIN, "score", 200),
)
def _(t):
    # labels without enough support keep the default threshold
    return mx.tune_thresholds(t.scored, "f1", min_support=200)


@query(
    "threshold_summary",
    f"""SELECT min(threshold) AS min, median(threshold) AS median, max(threshold) AS max,
       count(*) FILTER (tuned) AS n_tuned, count(*) FILTER (NOT tuned) AS n_default
       FROM ({_tuned(_F1_GAIN, "score", 200)})""",
)
def _(t):
    return mx.threshold_summary(mx.tune_thresholds(t.scored, "f1", min_support=200))


@query(
    "fixed_threshold_f1",
    """SELECT 2 * sum(tp) / (sum(predicted) + sum(support)) AS micro_f1,
       avg(2 * tp / (predicted + support)) AS macro_f1 FROM (
       SELECT icd_code, CAST(sum(y * p) AS DOUBLE) AS tp, CAST(sum(p) AS DOUBLE) AS predicted,
         CAST(sum(y) AS DOUBLE) AS support FROM (
         SELECT icd_code, y, CASE WHEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-(4 * prob - 2.5))) >= 0.5
           THEN 1 ELSE 0 END AS p FROM scored) GROUP BY icd_code)""",
)
def _(t):
    return mx.fixed_threshold_f1(t.scored.withColumn("logit", 4 * F.col("prob") - 2.5))


@query(
    "precision_at_k",
    """SELECT k, sum(y) / (k * (SELECT count(DISTINCT hadm_id) FROM hits)) AS precision_at_k
       FROM hits JOIN (VALUES (1), (3), (5)) AS v(k) ON place <= k GROUP BY k""",
)
def _(t):
    return mx.precision_at_k(t.wide, K_LIST, N)


@query("micro_f1", "SELECT micro_f1 FROM f1_pair")
def _(t):
    return mx.micro_f1(t.scored, t.cutoffs)


@query("macro_f1", "SELECT round(macro_f1, 9) AS macro_f1 FROM f1_pair")
def _(t):
    return _round(mx.macro_f1(t.scored, t.cutoffs), "macro_f1")


@query("per_label_metrics", "SELECT * FROM per_label")
def _(t):
    return mx.per_label_metrics(t.scored, t.cutoffs)


@query(
    "roc_auc",
    """SELECT (SELECT round(auc, 9) FROM micro_areas) AS micro_auc,
       (SELECT round(avg(auc), 9) FROM label_areas) AS macro_auc""",
)
def _(t):
    return _round(mx.roc_auc(t.scored), "micro_auc", "macro_auc")


@query(
    "average_precision",
    """SELECT (SELECT round(ap, 9) FROM micro_areas) AS micro_auprc,
       (SELECT round(avg(ap), 9) FROM label_areas) AS macro_auprc""",
)
def _(t):
    return _round(mx.average_precision(t.scored), "micro_auprc", "macro_auprc")


@query("curve_areas", "SELECT icd_code, round(auc, 9) AS auc, round(ap, 9) AS ap FROM label_areas")
def _(t):
    return _round(mx.curve_areas(t.scored).select("icd_code", "auc", "ap"), "auc", "ap")


@query("evaluate_multilabel", "SELECT metric, round(value, 9) AS value FROM metric_rows")
def _(t):
    return _round(mx.evaluate_multilabel(t.wide, t.cutoffs, N, K_LIST), "value")


@query(
    "metric_row",
    """SELECT round(any_value(value) FILTER (metric = 'micro_f1'), 9) AS micro_f1,
       round(any_value(value) FILTER (metric = 'macro_auc'), 9) AS macro_auc,
       round(any_value(value) FILTER (metric = 'p_at_5'), 9) AS p_at_5 FROM metric_rows""",
)
def _(t):
    rows = mx.evaluate_multilabel(t.wide, t.cutoffs, N, K_LIST)
    names = ["micro_f1", "macro_auc", "p_at_5"]
    return _round(mx.metric_row(rows, names), *names)


_BRIER = "SELECT icd_code, avg((prob - y) * (prob - y)) AS brier FROM scored GROUP BY icd_code"


@query("brier_per_label", f"SELECT icd_code, round(brier, 9) AS brier FROM ({_BRIER})")
def _(t):
    return _round(mx.brier_per_label(t.scored), "brier")


@query("macro_brier", f"SELECT round(avg(brier), 9) AS macro_brier FROM ({_BRIER})")
def _(t):
    return _round(mx.macro_brier(t.scored), "macro_brier")


@query(
    "reliability_curve",
    """WITH e AS (SELECT i, CAST(i AS DOUBLE) * 0.1::DOUBLE AS lo FROM range(10) AS r(i)),
       b AS (SELECT s.prob, s.y, (SELECT max(i) FROM e WHERE s.prob >= e.lo) AS bin FROM scored s)
       SELECT CAST(bin AS INT) AS bin, round(avg(prob), 9) AS mean_prob, avg(y) AS observed_rate, count(*) AS n
       FROM b GROUP BY bin""",
)
def _(t):
    return _round(mx.reliability_curve(t.scored), "mean_prob")


_REPORT = f"""SELECT p.*, round(brier, 9) AS brier, coalesce(long_title, '(no description)') AS description
  FROM per_label p JOIN ({_BRIER}) USING (icd_code) LEFT JOIN titles USING (icd_code)"""


@query("per_label_report", _REPORT)
def _(t):
    return _round(cf.per_label_report(t.scored, t.cutoffs, t.dictionary), "brier")


def _substitutions(t):
    return cf.substitution_counts(t.wide, sc.threshold_map(t.cutoffs), list(LABELS))


@query(
    "confusion_pairs",
    """SELECT true_code, wrong_code, count, CAST(support AS BIGINT) AS true_support,
       count / support AS rate_per_true, coalesce(x.long_title, '(no description)') AS true_desc,
       coalesce(y.long_title, '(no description)') AS wrong_desc FROM substitutions s
       JOIN label_counts l ON l.icd_code = true_code LEFT JOIN titles x ON x.icd_code = true_code
       LEFT JOIN titles y ON y.icd_code = wrong_code
       ORDER BY count DESC, true_code, wrong_code LIMIT 10""",
)
def _(t):
    support = t.scored.groupBy("icd_code").agg(F.sum("y").alias("support"))
    return cf.confusion_pairs(_substitutions(t), support, t.dictionary, 10)


@query(
    "most_confused_labels",
    "SELECT icd_code, involvement FROM involvement ORDER BY involvement DESC, icd_code LIMIT 4",
)
def _(t):
    return cf.most_confused_labels(_substitutions(t), 4)


@query(
    "confusion_submatrix",
    """WITH head AS (SELECT icd_code FROM involvement ORDER BY involvement DESC, icd_code LIMIT 4)
       SELECT a.icd_code AS true_code, b.icd_code AS wrong_code, coalesce(count, 0) AS count
       FROM head a CROSS JOIN head b
       LEFT JOIN substitutions ON true_code = a.icd_code AND wrong_code = b.icd_code""",
)
def _(t):
    return cf.confusion_submatrix(_substitutions(t), 4)


@query("worst_labels", "SELECT icd_code, f1 FROM per_label ORDER BY f1, icd_code LIMIT 3")
def _(t):
    return cf.worst_labels(mx.per_label_metrics(t.scored, t.cutoffs), 3).select("icd_code", "f1")


@query("best_labels", "SELECT icd_code, f1 FROM per_label ORDER BY f1 DESC, icd_code LIMIT 3")
def _(t):
    return cf.best_labels(mx.per_label_metrics(t.scored, t.cutoffs), 3).select("icd_code", "f1")


@query(
    "prediction_summary",
    """SELECT CAST(sum(y) AS BIGINT) AS positives_true, CAST(sum(pred) AS BIGINT) AS positives_pred,
       avg(pred) AS mean_pred_rate FROM decided""",
)
def _(t):
    return mx.prediction_summary(t.scored, t.cutoffs)


def _period_metrics(parity):
    return f"""SELECT 'micro_f1' AS metric, 2 * sum(tp) / (sum(predicted) + sum(support)) AS value FROM part
      WHERE parity = {parity}
      UNION ALL SELECT 'macro_f1', avg(2 * tp / (predicted + support)) FROM part WHERE parity = {parity}"""


@query(
    "split_drift",
    f"""WITH part AS (SELECT CASE WHEN md5('42:' || hadm_id) < '8' THEN 0 ELSE 1 END AS parity, icd_code, CAST(sum(y * pred) AS DOUBLE) AS tp,
        CAST(sum(pred) AS DOUBLE) AS predicted, CAST(sum(y) AS DOUBLE) AS support
        FROM decided GROUP BY 1, 2),
      a AS ({_period_metrics(0)}), b AS ({_period_metrics(1)})
      SELECT metric, round(a.value, 9) AS val, round(b.value, 9) AS test,
        round(abs(a.value - b.value), 9) AS drift FROM a FULL JOIN b USING (metric)""",
)
def _(t):
    # all documents, each in one of two seeded parts
    cut = t.cutoffs
    part = F.when(sample_order(42, "hadm_id") < "8", "val").otherwise("test")
    placed = t.scored.withColumn("part", part)
    halves = [
        mx.as_rows(mx.f1_scores(mx.confusion_counts(placed.filter(F.col("part") == name), cut)))
        for name in ("val", "test")
    ]
    return _round(mx.split_drift(*halves), "val", "test", "drift")


@query(
    "metric_gates",
    """SELECT metric, round(value, 9) AS value, target, floor, coalesce(value >= target, false) AS meets_target,
       CASE WHEN floor IS NULL THEN true ELSE coalesce(value >= floor, false) END AS meets_floor
       FROM metric_rows RIGHT JOIN (VALUES
       ('micro_f1', 0.70::DOUBLE, 0.55::DOUBLE), ('macro_f1', 0.55::DOUBLE, 0.40::DOUBLE),
       ('p_at_5', 0.70::DOUBLE, NULL), ('p_at_8', 0.65::DOUBLE, NULL)) AS g(metric, target, floor)
       USING (metric)""",
)
def _(t):
    rows = mx.evaluate_multilabel(t.wide, t.cutoffs, N, K_LIST)
    return _round(mx.metric_gates(rows), "value")


def _age_case():
    from cohortloom.catalog.notes import _AGES

    return _AGES


@query(
    "fairness_slices",
    f"""WITH who AS (SELECT a.hadm_id, gender, {_age_case()} AS age,
        CASE WHEN n_admissions = 1 THEN '1' WHEN n_admissions >= 5 THEN '5+' END AS frequency
        FROM admissions a JOIN patients USING (subject_id) JOIN per_patient USING (subject_id)),
      cells AS (SELECT 'gender' AS dimension, gender AS slice, d.* FROM decided d JOIN who USING (hadm_id)
        UNION ALL SELECT 'age', age, d.* FROM decided d JOIN who USING (hadm_id)
        UNION ALL SELECT 'frequency', frequency, d.* FROM decided d JOIN who USING (hadm_id)),
      counts AS (SELECT dimension, slice, icd_code, CAST(sum(y * pred) AS DOUBLE) AS tp,
        sum(pred) + sum(y) AS m, count(*) AS n FROM cells WHERE slice IS NOT NULL GROUP BY 1, 2, 3),
      f AS (SELECT dimension, slice, max(n) AS n_docs,
        avg(CASE WHEN m = 0 THEN 0 ELSE 2 * tp / m END) AS macro_f1 FROM counts GROUP BY 1, 2)
      SELECT dimension, slice, n_docs, round(macro_f1, 9) AS macro_f1,
        round(max(macro_f1) OVER (PARTITION BY dimension) - macro_f1, 9) AS gap,
        max(macro_f1) OVER (PARTITION BY dimension) - macro_f1 >= 0.05 AS flagged FROM f""",
)
def _(t):
    per = pf.admissions_per_patient(t.admissions)
    n = F.col("n_admissions")
    who = (
        t.admissions.join(t.patients, "subject_id")
        .join(per, "subject_id")
        .select(
            "hadm_id",
            "gender",
            age_bucket(F.col("anchor_age")).alias("age"),
            F.when(n == 1, "1").when(n >= 5, "5+").alias("frequency"),
        )
    )
    dimensions = {"gender": "gender", "age": "age", "frequency": "frequency"}
    report = mx.fairness_slices(t.wide, who, sc.threshold_map(t.cutoffs), dimensions)
    return _round(report, "macro_f1", "gap")


@query(
    "score_documents",
    """SELECT hadm_id, string_agg(icd_code, ',' ORDER BY prob DESC, icd_code) AS codes,
       coalesce(string_agg(icd_code, ',' ORDER BY prob DESC, icd_code) FILTER (pred = 1), '') AS thresholded,
       max(prob) AS best_score FROM decided GROUP BY hadm_id""",
)
def _(t):
    scored = sc.score_documents(t.scores, sc.threshold_map(t.cutoffs))
    return scored.select(
        "hadm_id",
        F.array_join("codes", ",").alias("codes"),
        F.array_join("thresholded", ",").alias("thresholded"),
        F.get("scores", F.lit(0)).alias("best_score"),
    )


_TOKEN_BIN = "CASE " + " ".join(
    f"WHEN n_tokens >= {edge} THEN '{i}'" for i, edge in reversed(list(enumerate(dr.TOKEN_EDGES)))
) + " END"


@query(
    "drift_report",
    f"""WITH counts AS (
        SELECT period, feature, bin, count(*) AS n FROM (
          SELECT CASE WHEN note_seq = 0 THEN 'reference' ELSE 'current' END AS period,
            'n_tokens' AS feature, {_TOKEN_BIN} AS bin FROM notes JOIN lengths USING (note_id)
          UNION ALL SELECT CASE WHEN hadm_id % 2 = 0 THEN 'reference' ELSE 'current' END, 'score',
            CAST(CAST(least(floor(prob * 10), 9) AS INT) AS VARCHAR) FROM scored
          UNION ALL SELECT CASE WHEN hadm_id % 2 = 0 THEN 'reference' ELSE 'current' END, 'label',
            icd_code FROM scored WHERE y = 1)
        GROUP BY 1, 2, 3),
      bins AS (SELECT feature, bin, coalesce(sum(n) FILTER (period = 'reference'), 0) AS r,
        coalesce(sum(n) FILTER (period = 'current'), 0) AS c FROM counts GROUP BY 1, 2),
      shares AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS r,
        greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS c FROM bins)
      SELECT feature, count(*) AS n_bins, round(sum((c - r) * ln(c / r)), 9) AS psi
      FROM shares GROUP BY feature""",
)
def _(t):
    first = F.when(F.col("note_seq") == 0, "reference").otherwise("current")
    even = F.when(F.col("hadm_id") % 2 == 0, "reference").otherwise("current")
    n_tokens = token_length(F.col("text"))
    counts = (
        dr.binned(t.texts.select("note_seq", n_tokens.alias("n")), first, "n_tokens",
                  dr.edge_bin(F.col("n"), dr.TOKEN_EDGES))
        .unionByName(dr.binned(t.scored, even, "score", dr.score_bin(F.col("prob"))))
        .unionByName(dr.binned(t.scored.filter("y = 1"), even, "label", F.col("icd_code")))
    )
    return _round(dr.drift_report(counts), "psi")


_DAY_SPLIT = "2024-01-16"


@query(
    "drift_report_windows",
    f"""WITH counts AS (SELECT CASE WHEN ts < TIMESTAMP '{_DAY_SPLIT}' THEN 'reference' ELSE 'current' END
        AS period, event_type AS bin, count(*) AS n FROM events GROUP BY 1, 2),
      bins AS (SELECT bin, coalesce(sum(n) FILTER (period = 'reference'), 0) AS r,
        coalesce(sum(n) FILTER (period = 'current'), 0) AS c FROM counts GROUP BY 1),
      shares AS (SELECT greatest(r / sum(r) OVER (), 1e-6) AS r,
        greatest(c / sum(c) OVER (), 1e-6) AS c FROM bins)
      SELECT 'event_type' AS feature, count(*) AS n_bins, round(sum((c - r) * ln(c / r)), 9) AS psi FROM shares""",
)
def _(t):
    from cohortloom.streaming.jobs import drift_counts, windowed_counts

    counts = drift_counts(windowed_counts(t.base("events"), "event_type"), _DAY_SPLIT, "event_type")
    return _round(dr.drift_report(counts), "psi")


# Three arrivals of the events; the last one brings every 40th event of all days. A row is late once the
# watermark that closed windows in the batch before has passed its window.
_ARRIVALS, _REFERENCE_END = ("2024-01-12 12:00:00", "2024-01-18 12:00:00"), "2024-01-06"
_ARRIVAL = (
    f"CASE WHEN event_id % 40 = 0 OR ts >= TIMESTAMP '{_ARRIVALS[1]}' THEN 2 "
    f"WHEN ts >= TIMESTAMP '{_ARRIVALS[0]}' THEN 1 ELSE 0 END"
)


@query(
    "stream_drift_windows",
    f"""WITH arrived AS (SELECT *, {_ARRIVAL} AS nth, date_trunc('day', ts) AS day FROM events),
      seen AS (SELECT * FROM arrived WHERE nth < 2 OR day + INTERVAL 1 DAY >
        (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM arrived WHERE nth = 0)),
      closed AS (SELECT day, event_type AS bin, count(*) AS n FROM seen
        WHERE day + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2),
      ref AS (SELECT event_type AS bin, count(*) / sum(count(*)) OVER () AS r FROM events
        WHERE ts < TIMESTAMP '{_REFERENCE_END}' GROUP BY 1),
      grid AS (SELECT day, bin, greatest(coalesce(r, 0), 1e-6) AS r FROM (SELECT DISTINCT day FROM closed)
        CROSS JOIN (SELECT bin FROM ref UNION SELECT bin FROM closed) LEFT JOIN ref USING (bin)),
      shares AS (SELECT day, bin, r, coalesce(n, 0) AS n, greatest(coalesce(n, 0) / sum(n) OVER (PARTITION BY day), 1e-6) AS c
        FROM grid LEFT JOIN closed USING (day, bin))
      SELECT day AS window_start, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_bins, round(sum((c - r) * ln(c / r)), 9) AS psi
      FROM shares GROUP BY day""",
)
def _(t):
    # the files of a folder are arrivals, in the order they were written
    events = t.base("events").withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    folder = fresh_path(t.spark, "arrivals")
    for nth in range(3):
        part = events.filter(F.expr(_ARRIVAL) == nth).select("ts", "event_type")
        part.coalesce(1).write.parquet(f"{folder}/arrival={nth}")
    kept = events.filter(F.col("ts") < F.lit(_REFERENCE_END).cast("timestamp"))
    shares = jobs.reference_shares(kept.groupBy(F.col("event_type").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    stream = jobs.read_files(t.spark, f"{folder}/arrival=*", events.select("ts", "event_type").schema, files_per_batch=1)
    return _round(jobs.drain(jobs.stream_drift(stream, "event_type", shares), "drift-stream"), "psi")
