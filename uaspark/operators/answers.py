"""Rule-based answers (X26), model replies (X28) and the compact campaign row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published answer texts of the keyword router.
ROI_REACHED = "Based on the data, ROI of 100% (ROAS = 1.0) is achieved at "
ROI_REACHED_TAIL = ". The ROAS progression shows: "
ROI_MISSED = "ROI of 100% is not achieved in the available data. Maximum ROAS is "
ROI_MISSED_TAIL = ". ROAS progression: "
NO_DRIVERS = "Feature importance not available. Train a model first."
UNSUPPORTED = "This question is currently not supported by the automated Q&A."

# The second router (X26), in order.  A question takes the first route for
# which it holds a word of every group; then the answer with a model and a dataset
# ({model}, {dataset}), the one without, and whether recommendations leave it to a
# language model instead.
FALLBACK_ROUTES = [
    ("roi", [["roi"], ["100%", "d15", "d30", "d90"]],
     "To determine when ROI reaches 100% on this channel, run predictions using model '{model}' on dataset '{dataset}' in the Predictions tab. The system will show projected ROAS over time with confidence intervals to identify when break-even is achieved.",
     "Please select a model and dataset to get ROI projections. Go to the Model Training tab to train or select a model, then run predictions to see when 100% ROI will be achieved.", True),
    ("continue", [["continue"], ["campaign", "pause"]],
     "Campaign continuation recommendations are available in the Predictions tab using model '{model}'. The system categorizes campaigns as Scale, Maintain, Reduce, or Cut based on predicted ROAS and confidence intervals.",
     "Please select a model and dataset to get campaign recommendations. Use the Model Training tab to make your selections, then check the Predictions tab for specific guidance.", True),
    ("projected", [["roas"], ["projected", "spending"]],
     "Projected ROAS analysis is available in the Predictions tab using model '{model}'. The system shows confidence intervals and projected performance over time.",
     "Please select a model and dataset to get ROAS projections. Use the Model Training tab to make your selections, then run predictions to see projected ROAS.", True),
    ("cpi", [["cpi"], ["profitability", "d30", "d90"]],
     "Target CPI for profitability can be calculated using model '{model}' on dataset '{dataset}'. Run predictions in the Predictions tab to see the relationship between CPI and projected ROAS, helping identify the maximum CPI for profitable campaigns.",
     "Please select a model and dataset to analyze CPI requirements. Use the Model Training tab to make your selections, then run predictions to see CPI vs ROAS relationships.", False),
    ("retention", [["retention rate"], ["d7", "d15", "d30"]],
     "Required retention rates for D30 ROAS goals can be analyzed using model '{model}' on dataset '{dataset}'. Check the Model Training tab for feature importance to see how retention impacts ROAS predictions.",
     "Please select a model and dataset to analyze retention requirements. Use the Model Training tab to train a model and view feature importance, showing how retention rates affect ROAS predictions.", False),
    ("scale", [["scale aggressively", "ready to scale"]],
     "Scaling recommendations are available in the Predictions tab using model '{model}'. Look for campaigns with high predicted ROAS and narrow confidence intervals as candidates for aggressive scaling.",
     "Please select a model and dataset to get scaling recommendations. Use the Model Training tab to make your selections, then check the Predictions tab for specific guidance.", False),
    ("cut", [["cut immediately", "campaigns should we cut"]],
     "Campaign cutting recommendations are available in the Predictions tab using model '{model}'. Look for campaigns with low predicted ROAS and wide confidence intervals as candidates for immediate cuts.",
     "Please select a model and dataset to get cutting recommendations. Use the Model Training tab to make your selections, then check the Predictions tab for specific guidance.", False),
]
FALLBACK_OTHER = "I can help you with questions about model performance, campaign recommendations, ROAS predictions, and data insights. Please select a model and dataset for more specific answers, or ask a more specific question."
ADAPTIVE_MODE = "adaptive ai recommendations"


def fallback_route(question: Column) -> Column:
    """X26, second router: the first route whose groups of words all occur, else ``other``."""
    low = F.lower(question)
    expr = F.when(question.isNull(), F.lit("other"))
    for name, groups, *_ in FALLBACK_ROUTES:
        held = F.lit(True)
        for words in groups:
            held = held & F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
        expr = expr.when(held, F.lit(name))
    return expr.otherwise("other")


def fallback_answers(questions: DataFrame, question: str, model: str, dataset: str, has_predictions: str, mode: str) -> DataFrame:
    """``questions`` plus ``route`` and ``answer`` by the second router and the row's
    context: columns with the names of the selected model and dataset (null or empty: none), whether
    predictions exist, and the model type, which makes the adaptive mode count as having some.

    A null answer means that the question is left to a language model."""
    chosen = (F.coalesce(F.col(model), F.lit("")) != "") & (F.coalesce(F.col(dataset), F.lit("")) != "")
    advice = F.coalesce(F.col(has_predictions), F.lit(False)) | F.lower(F.coalesce(F.col(mode), F.lit(""))).startswith(ADAPTIVE_MODE)
    out = questions.withColumn("route", fallback_route(F.col(question)))
    answer = F.when(F.col("route") == "other", F.when(~advice, FALLBACK_OTHER))
    for name, _, guided, unguided, left in FALLBACK_ROUTES:
        text = F.replace(F.replace(F.lit(guided), F.lit("{model}"), F.col(model)), F.lit("{dataset}"), F.col(dataset))
        rest = F.when(~advice, unguided) if left else F.lit(unguided)
        answer = answer.when(F.col("route") == name, F.when(chosen, text).otherwise(rest))
    return out.withColumn("answer", answer)


def fallback_answer_sql(question: str, model: str, dataset: str, advice: str) -> tuple[str, str]:
    """Oracle spelling: (route, answer); ``advice`` is a condition, names are '' for none."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    route, answer = [], [f"WHEN route = 'other' THEN CASE WHEN NOT ({advice}) THEN {q(FALLBACK_OTHER)} END"]
    for name, groups, guided, unguided, left in FALLBACK_ROUTES:
        held = " AND ".join("(" + " OR ".join(f"contains(lower({question}), {q(w)})" for w in words) + ")" for words in groups)
        route.append(f"WHEN {held} THEN '{name}'")
        rest = f"CASE WHEN NOT ({advice}) THEN {q(unguided)} END" if left else q(unguided)
        answer.append(f"WHEN route = '{name}' THEN CASE WHEN {model} <> '' AND {dataset} <> '' "
                      f"THEN replace(replace({q(guided)}, '{{model}}', {model}), '{{dataset}}', {dataset}) ELSE {rest} END")
    return f"CASE {' '.join(route)} ELSE 'other' END", f"CASE {' '.join(answer)} END"


def _f3(c: Column) -> Column:
    return F.format_string("%.3f", c)


def _listed(pairs: Column, value) -> Column:
    """``label: value`` of an array of structs, joined by commas."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["label"].cast("string"), F.lit(": "), value(p["value"]))), ", ")


def roi_answer(progression: DataFrame) -> DataFrame:
    """(route, answer) from (day, value): the first day on which ROAS reaches 1,
    or else the largest value (the earliest day, if several have it)."""
    rows = progression.where(F.col("value").isNotNull())
    one = rows.agg(F.array_sort(F.collect_list(F.struct("day", "value"))).alias("p"),  # one entry per ROAS day
                   F.min(F.when(F.col("value") >= 1.0, F.col("day"))).alias("first"),
                   F.max("value").alias("most"),
                   F.max_by("day", F.struct("value", -F.col("day"))).alias("most_day"))
    named = F.transform("p", lambda x: F.struct(F.concat(F.lit("roas_d"), x["day"].cast("string")).alias("label"), x["value"]))
    shown = _listed(named, _f3)
    text = (F.when(F.size("p") == 0, F.lit(None).cast("string"))
             .when(F.col("first").isNotNull(), F.concat(F.lit(ROI_REACHED + "roas_d"), F.col("first").cast("string"),
                                                        F.lit(ROI_REACHED_TAIL), shown))
             .otherwise(F.concat(F.lit(ROI_MISSED), _f3(F.col("most")), F.lit(" at roas_d"), F.col("most_day").cast("string"),
                                 F.lit(ROI_MISSED_TAIL), shown)))
    return one.select(F.lit("roi_timeline").alias("route"), text.alias("answer"))


def metrics_answer(metrics: DataFrame, horizon: int) -> DataFrame:
    """From one row with r2, mape, rmse, mae, coverage."""
    parts = [("R²", "r2"), ("MAPE", "mape"), ("RMSE", "rmse"), ("MAE", "mae"), ("CI coverage", "coverage")]
    return metrics.select(F.lit("metrics").alias("route"), F.concat(
        F.lit(f"Model performance for D{horizon}: "),
        F.concat_ws(", ", *[F.concat(F.lit(f"{name}: "), _f3(F.col(c))) for name, c in parts])).alias("answer"))


def best_answer(best: DataFrame) -> DataFrame:
    return best.select(F.lit("best_platform").alias("route"), F.concat(F.lit("Best platform is "), F.col("platform")).alias("answer"))


def expectation_answer(summary: DataFrame, horizon: int) -> DataFrame:
    """From one row with mean, p10, p50, p90."""
    text = F.format_string(f"Expected D{horizon} ROAS — mean: %.3f, p50: %.3f, range ~ p10 %.3f to p90 %.3f.",
                           "mean", "p50", "p10", "p90")
    return summary.select(F.lit("expectation").alias("route"), text.alias("answer"))


def coverage_answer(df: DataFrame, col: str = "platform") -> DataFrame:
    """Rows per platform, most first (one entry per platform)."""
    counts = df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "label"))),
                         lambda x: F.struct(x["label"].alias("label"), (-x["k"]).alias("value")))
    return counts.agg(listed.alias("p")).select(
        F.lit("coverage").alias("route"),
        F.concat(F.lit("Data records by platform: "), _listed(F.col("p"), lambda v: v.cast("string"))).alias("answer"))


def actions_answer(top: DataFrame, text: str, pred: str, place: str) -> DataFrame:
    """The first five recommendations, one line each."""
    five = top.orderBy(place).limit(5).agg(F.array_sort(F.collect_list(F.struct(place, text, pred))).alias("l"))
    lines = F.transform("l", lambda x: F.concat(F.lit("- "), x[text], F.lit(" (pred ROAS "), _f3(x[pred]), F.lit(")")))
    return five.select(F.lit("actions").alias("route"), F.array_join(lines, "\n").alias("answer"))


def drivers_answer(spark, names: list[str]) -> DataFrame:
    text = f"Top drivers of ROAS include: {', '.join(names[:5])}." if names else NO_DRIVERS
    return spark.createDataFrame([("drivers", text)], "route string, answer string")


def drivers_from_importance(importance: DataFrame, n: int = 5) -> DataFrame:
    """The ``drivers`` answer from (feature, importance), as M7 gives it: the ``n`` features
    that matter most, ties by name; features that no split uses are left out."""
    top = importance.where(F.col("importance") > 0).orderBy(F.desc("importance"), "feature").limit(n)
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("k"), "feature"))), lambda x: x["feature"])
    text = F.concat(F.lit("Top drivers of ROAS include: "), F.array_join("l", ", "), F.lit("."))
    return top.agg(names.alias("l")).select(F.lit("drivers").alias("route"), F.when(F.size("l") > 0, text).otherwise(NO_DRIVERS).alias("answer"))


def answer_questions(questions: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """``questions`` (with ``route``) and the answer of each one's route (at most
    one row per route, so the answers are broadcast)."""
    table = answers[0]
    for a in answers[1:]:
        table = table.unionByName(a)
    return (questions.join(F.broadcast(table), "route", "left")
            .withColumn("answer", F.coalesce("answer", F.lit(UNSUPPORTED))))


# ---- X28 ------------------------------------------------------------------

REPLY = ("recommendations array<struct<row_index: string, action: string, rationale: string, "
         "budget_change_pct: double>>")


def unfence(text: Column) -> Column:
    """Text between the code fences when the reply starts with one."""
    body = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.regexp_extract(body, r"(?s)^```[^\n]*\n(.*?)(?:\n[ \t]*```[ \t]*(?:\n.*)?)?$", 1)
    return F.when(body.startswith("```"), inner).otherwise(body)


def parse_replies(replies: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """One row per recommendation of a reply: ``row_index`` (whole number),
    ``action``, ``rationale`` (trimmed, '' when missing), ``budget_change_pct``
    (null unless a number).  Replies that aren't JSON and entries without a whole
    row index are left out; of entries with one index the last counts."""
    parsed = F.from_json(unfence(F.col(text_col)), REPLY)["recommendations"]
    rows = replies.select(*keys, F.posexplode(parsed).alias("_pos", "r"))
    index = F.when(F.col("r.row_index").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("r.row_index").try_cast("int"))
    rows = rows.select(*keys, "_pos", index.alias("row_index"), F.trim(F.coalesce("r.action", F.lit(""))).alias("action"),
                       F.trim(F.coalesce("r.rationale", F.lit(""))).alias("rationale"), "r.budget_change_pct")
    last = rows.where("row_index IS NOT NULL").groupBy(*keys, "row_index").agg(
        F.max_by(F.struct("action", "rationale", "budget_change_pct"), "_pos").alias("r"))
    return last.select(*keys, "row_index", "r.*")


# ---- X27 ------------------------------------------------------------------

def plain_amount(c: Column) -> Column:
    """Dollar signs and commas dropped; what isn't a number then is 0."""
    return F.coalesce(F.trim(F.translate(c.cast("string"), "$,", "")).try_cast("double"), F.lit(0.0))


def compact_campaigns(df: DataFrame, keys: list[str], cost: str = "cost", revenue: str = "revenue",
                      installs: str = "installs") -> DataFrame:
    """Cost and revenue as numbers, installs (0 when unreadable), and
    cpi = cost / installs, 2 decimals, 0 without installs."""
    n = F.coalesce(F.col(installs).cast("string").try_cast("double"), F.lit(0.0))
    out = df.select(*keys, plain_amount(F.col(cost)).alias("cost"), plain_amount(F.col(revenue)).alias("revenue"), n.alias("installs"))
    return out.withColumn("cpi", F.when(F.col("installs") > 0, F.round(F.col("cost") / F.col("installs"), 2)).otherwise(0.0))
