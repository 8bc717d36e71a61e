"""Monitoring and evaluation: usage limits, rollups, intervals, agreement, calibration, splits, locators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .containment import LEAST, contained


def usage_windows(runs: DataFrame, per_hour: int = 10, per_day: int = 50) -> DataFrame:
    """Adds runs_last_hour (this one included), runs_today and limited_by to each attempt of a user."""
    second = F.unix_timestamp("created_at")
    hour = Window.partitionBy("user_id").orderBy(second).rangeBetween(-3600, 0)
    day = Window.partitionBy("user_id", F.to_date("created_at")).orderBy(second).rangeBetween(Window.unboundedPreceding, 0)
    rows = runs.withColumns({"runs_last_hour": F.count("*").over(hour), "runs_today": F.count("*").over(day)})
    return rows.withColumn("limited_by", F.when(F.col("runs_last_hour") > per_hour, "hour").when(F.col("runs_today") > per_day, "day"))


#: In microseconds.
HOUR = 3_600_000_000


@dataclass(frozen=True)
class Limits:
    """Runs an hour and a day, jobs a day, a user's spend and everybody's spend a day (in ten-thousandths)."""

    hour: int = 10
    day: int = 50
    jobs: int = 20
    spend: int = 20_000
    global_spend: int = 500_000

    def told(self, kind: str, hour: int, runs: int, jobs: int, spent: int) -> str | None:
        if kind == "run":
            return "hour" if hour > self.hour else "day" if runs > self.day else None
        if kind == "job":
            return "jobs" if jobs > self.jobs else None
        return "spend" if spent >= self.spend else None


def usage_decisions(attempts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Attempts (user_id, event_id, created_at, kind run / job / call, cost in ten-thousandths), refused ones counted too: runs_last_hour,
    runs_today, jobs_today (this moment's included), spent_before, closed (everybody's spend had reached its limit by an earlier minute) and limited_by."""
    micros = F.unix_micros("created_at")
    hour = F.floor(F.col("at") / HOUR)
    rows = attempts.select("user_id", "event_id", "created_at", "kind", F.col("cost").cast("long").alias("cost"), micros.alias("at")).withColumns({"hour": hour, "today": F.floor(F.col("at") / (24 * HOUR))})
    run, job, call = (F.col("kind") == k for k in ("run", "job", "call"))
    spent = F.when(call, F.col("cost"))
    # What an attempt sees lies in its hour and the one before, besides the sums of the day's earlier hours, so windows are an hour of a user
    # and each frame begins where its window does: a run counts from its moment on (change 1) and not after an hour (change -1, in the next hour).
    none, key = F.lit(0).cast("long"), ["user_id", "hour"]
    own = rows.select("*", F.lit(True).alias("own"), F.when(run, 1).otherwise(0).cast("long").alias("change"), F.when(run, 1).otherwise(0).cast("long").alias("runs"), F.when(job, 1).otherwise(0).cast("long").alias("jobs"), spent.alias("spent"))
    blank = lambda df, at, change, runs, jobs, spent_: df.select(
        "user_id", F.lit(None).cast(attempts.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(attempts.schema["created_at"].dataType).alias("created_at"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("cost"),
        at.alias("at"), "hour", "today", F.lit(False).alias("own"), change.alias("change"), runs.alias("runs"), jobs.alias("jobs"), spent_.alias("spent"),
    )
    moments = rows.where(run & F.col("at").isNotNull()).groupBy("user_id", "at").agg(F.count("*").alias("n"))
    after = moments.withColumn("hour", hour + 1).withColumn("today", F.floor(F.col("hour") / 24))
    leaving = after.where(F.col("at") + HOUR + 1 < (F.col("hour") + 1) * HOUR)
    hours = rows.groupBy(*key, "today").agg(F.count_if(run).alias("runs"), F.count_if(job).alias("jobs"), F.sum(spent).alias("spent"))
    earlier = Window.partitionBy("user_id", "today").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(*key, "today", *[F.sum(c).over(earlier).alias(c) for c in ("runs", "jobs", "spent")])
    entering = after.groupBy(*key, "today").agg(F.sum("n").alias("n"))
    start = F.col("hour") * HOUR - 1
    whole = reduce(DataFrame.unionByName, [
        own, blank(entering, start, F.col("n"), none, none, F.lit(None).cast("long")), blank(leaving, F.col("at") + HOUR + 1, -F.col("n"), none, none, F.lit(None).cast("long")),
        blank(carried, start, none, F.col("runs"), F.col("jobs"), F.col("spent")),
    ])
    along = Window.partitionBy(*key).orderBy("at")
    upto, before = along.rangeBetween(Window.unboundedPreceding, 0), along.rangeBetween(Window.unboundedPreceding, -1)
    told = whole.withColumns({
        "runs_last_hour": F.sum("change").over(upto), "runs_today": F.sum("runs").over(upto), "jobs_today": F.sum("jobs").over(upto), "spent_before": F.coalesce(F.sum("spent").over(before), F.lit(0)),
    }).where("own").drop("own", "change", "runs", "jobs", "spent", "hour")
    # a row a minute, then a row a day
    minutes = rows.where(call).groupBy("today", F.floor(F.col("at") / 60_000_000).alias("minute")).agg(F.sum("cost").alias("cost"))
    spent = F.sum("cost").over(Window.partitionBy("today").orderBy("minute"))
    closed = minutes.withColumn("spent", spent).where(F.col("spent") >= limits.global_spend).groupBy("today").agg(F.min("minute").alias("last"))
    told = told.join(closed, "today", "left").withColumn("closed", F.coalesce(call & (F.floor(F.col("at") / 60_000_000) > F.col("last")), F.lit(False)))
    limited = (
        F.when(run & (F.col("runs_last_hour") > limits.hour), "hour").when(run & (F.col("runs_today") > limits.day), "day").when(job & (F.col("jobs_today") > limits.jobs), "jobs")
        .when(call & (F.col("spent_before") >= limits.spend), "spend").when(F.col("closed"), "global")
    )
    return told.withColumn("limited_by", limited).drop("at", "today", "last")


def daily_spend(costed: DataFrame, most: str = "2.00") -> DataFrame:
    limit = F.lit(most).cast("decimal(10,4)")
    out = costed.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.sum("cost").alias("spend"), F.count("*").alias("n_calls"))
    return out.withColumns({"over": F.col("spend") > limit, "near": F.col("spend") >= limit * F.lit("0.8").cast("decimal(2,1)")})


def call_rollups(costed: DataFrame) -> DataFrame:
    """Calls, tokens, spend, cache share, refusals, retries and latency by purpose and model, with their totals."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    cached, plain = F.sum("cache_read_tokens"), F.sum("input_tokens")
    return costed.rollup("purpose", "model").agg(
        F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("spend"), share(cached, cached + plain).alias("cache_share"),
        F.avg((F.col("outcome") == "refused").cast("double")).alias("refusal_rate"), F.avg((F.col("attempt") > 1).cast("double")).alias("retry_rate"),
        F.percentile("latency_ms", 0.5).alias("latency_p50"), F.percentile("latency_ms", 0.95).alias("latency_p95"),
    )


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95 % interval of a rate."""
    p, z2 = successes / n, z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = (z / (1 + z2 / n)) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def rates(df: DataFrame, by: list[str], success: Column, tier: str = "production") -> DataFrame:
    """Rate and interval by group; at the development tier the point estimate is withheld."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(success).alias("successes"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return out.withColumns({"rate": F.lit(None).cast("double") if tier == "development" else F.col("successes") / F.col("n"), "low": low, "high": high})


def confusion(df: DataFrame, by: list[str], truth: Column, said: Column) -> DataFrame:
    out = df.groupBy(*by).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    return out.withColumns({"precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")), "fp_rate": ratio(c("fp"), c("fp") + c("tn")), "fn_rate": ratio(c("fn"), c("fn") + c("tp"))})


def kappa(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Cohen's kappa and the quadratically weighted one of two raters with integer grades.

    Only the (small) table of grade pairs is joined with its margins.
    """
    pairs = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    grades = [F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"), F.sum(F.col("n") * F.pow(F.col("a") - F.col("b"), 2)).alias("apart")]
    one = F.lit(1).alias("k")
    key = by or ["k"]
    keyed = pairs if by else pairs.select("*", one)
    whole = keyed.groupBy(*key).agg(*grades)
    ma = keyed.groupBy(*key, "a").agg(F.sum("n").alias("na"))
    mb = keyed.groupBy(*key, "b").agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, key).groupBy(*key).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * F.col("nb")).otherwise(0)).alias("by_chance"), F.sum(F.col("na") * F.col("nb") * F.pow(F.col("a") - F.col("b"), 2)).alias("apart_by_chance"))
    both = whole.join(chance, key)
    po, pe = F.col("agree") / F.col("total"), F.col("by_chance") / (F.col("total") * F.col("total"))
    weighted = 1 - F.col("apart") * F.col("total") / F.col("apart_by_chance")
    return both.select(*by, F.col("total").alias("n"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), F.when(F.col("apart_by_chance") > 0, weighted).alias("weighted_kappa"))


def calibration(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Reliability by bin: size, mean score, share of ones, and the bin's part of the expected calibration error."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(truth).cast("double")).alias("observed"))
    total = df.agg(F.count("*").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("bin", "n", "mean_score", "observed", (F.col("n") / F.col("total") * F.abs(F.col("mean_score") - F.col("observed"))).alias("error_part"))


def split_bucket(key: Column, salt: str) -> Column:
    """sha256(key + salt) modulo 100, folded over the digits, so it is exact."""
    digits = F.filter(F.split(F.sha2(F.concat(key.cast("string"), F.lit(salt)), 256), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, c: (acc * 16 + F.conv(c, 16, 10).cast("long")) % 100)


def assign_split(df: DataFrame, key: str, salt: str = "split-v1", test_share: int = 30) -> DataFrame:
    return df.withColumn("split", F.when(split_bucket(F.col(key), salt) < test_share, "test").otherwise("train"))


def split_leaks(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def resolve_locators(locators: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """locators (locator_id, doc_id, page, quote, occurrence from 0) to span ids by equal comparison form; and those that resolve to nothing."""
    order = Window.partitionBy("doc_id", "page", "norm").orderBy("seqno")
    own = spans.withColumn("norm", tx.comparison_form(F.col("text"))).withColumn("occurrence", F.row_number().over(order) - 1).select("doc_id", "page", "norm", "occurrence", "span_id")
    rows = locators.withColumn("norm", tx.comparison_form(F.col("quote"))).join(own, ["doc_id", "page", "norm", "occurrence"], "left").drop("norm")
    return rows.where("span_id is not null"), rows.where("span_id is null").drop("span_id")


def robustness(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, variant, score): the mean and largest absolute difference of clean and injected."""
    wide = pairs.groupBy("pair_id").agg(F.max(F.when(F.col("variant") == "clean", F.col("score"))).alias("clean"), F.max(F.when(F.col("variant") == "injected", F.col("score"))).alias("injected"))
    gap = F.abs(F.col("clean") - F.col("injected"))
    return wide.agg(F.count(gap).alias("n_pairs"), F.avg(gap).alias("mean_difference"), F.max(gap).alias("largest_difference"))


def stability(runs: DataFrame) -> DataFrame:
    """runs (pair_id, attempt, score, judgement): the spread of scores over attempts and the number of different judgements."""
    return runs.groupBy("pair_id").agg(F.count("*").alias("n"), F.stddev_samp("score").alias("sd"), F.count_distinct("judgement").alias("n_judgements"))


def jaccard(df: DataFrame, a: str, b: str) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def extraction_quality(truth: DataFrame, said: DataFrame, least: float = 0.5) -> DataFrame:
    """truth and said (job_id, ordinal, text, necessity, criticality): matched one to one by shared words, then precision, recall and accuracies per job."""
    words = lambda c: F.sort_array(F.array_distinct(F.split(tx.comparison_form(F.col(c)), " ")))
    t = truth.select("job_id", F.col("ordinal").alias("t"), words("text").alias("tw"), F.col("necessity").alias("tn"), F.col("criticality").alias("tc"))
    s = said.select("job_id", F.col("ordinal").alias("s"), words("text").alias("sw"), F.col("necessity").alias("sn"), F.col("criticality").alias("sc"))
    # two sets of which so large a part is common share a word among the first of either, in an order that both have: all but least * size, and one
    first = lambda w: F.slice(w, 1, F.greatest(F.size(w) - F.ceil(F.size(w) * F.lit(least) - 1e-9).cast("int") + 1, F.lit(1)))
    near = t.withColumn("w", F.explode(first(F.col("tw")))).join(s.withColumn("w", F.explode(first(F.col("sw")))), ["job_id", "w"])
    # a pair counts once, at the first word that it shares
    common = F.array_intersect("tw", "sw")
    near = near.where(F.col("w") == F.get(common, F.lit(0))).withColumn("alike", F.size(common) / F.size(F.array_union("tw", "sw"))).where(F.col("alike") >= least)
    near = near.select("job_id", "t", "s", "tn", "sn", "tc", "sc", "alike")
    best = lambda side, other: F.row_number().over(Window.partitionBy("job_id", side).orderBy(F.desc("alike"), other))
    pairs = near.withColumns({"of_t": best("t", "s"), "of_s": best("s", "t")}).where("of_t = 1 and of_s = 1")
    hits = pairs.groupBy("job_id").agg(F.count("*").alias("matched"), F.avg((F.col("tn") == F.col("sn")).cast("double")).alias("necessity_accuracy"), F.avg((F.abs(F.col("tc") - F.col("sc")) <= 1).cast("double")).alias("criticality_within_one"))
    counts = truth.groupBy("job_id").agg(F.count("*").alias("n_truth")).join(said.groupBy("job_id").agg(F.count("*").alias("n_said")), "job_id", "full").na.fill(0)
    out = counts.join(hits, "job_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return out.withColumns({"precision": F.when(F.col("n_said") > 0, F.col("matched") / F.col("n_said")), "recall": F.when(F.col("n_truth") > 0, F.col("matched") / F.col("n_truth"))})


def quote_leaks(templates: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """Quotes (template_id, body) that texts (doc_id, text) contain anywhere: template_id, n_documents, first_doc."""
    found = contained(templates, texts, "body", least=least)
    return tx.once(templates.select("template_id", "body"), quote=tx.collapse(F.col("body"))).join(found, "quote").select("template_id", "n_documents", "first_doc")


def stale_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Adds is_stale: whether the run's prompt or scoring version is not the current one (a table of one row)."""
    now = current.select(F.col("prompt_version_id").alias("p"), F.col("scoring_version").alias("s")).limit(1)
    rows = runs.crossJoin(F.broadcast(now))
    return rows.withColumn("is_stale", (F.col("prompt_version_id") != F.col("p")) | (F.col("scoring_version") != F.col("s"))).drop("p", "s")


#: Text that addresses a model instead of a reader: family, whether a hit is sure or uncertain, words of which every hit holds one, and the pattern (lower case).
INSTRUCTIONS = (
    ("override", "sure", ("ignore",), r"\bignore (all |any )?(the |of the )?(previous|above|prior|earlier) (instructions?|text|prompts?|rules)\b"),
    ("override", "sure", ("disregard",), r"\bdisregard (all |any )?(the |your )?(previous|above|prior|other) [a-z]+"),
    ("override", "uncertain", ("instead",), r"\b(do|say|answer|write) (this|that|the following) instead\b"),
    ("scoring", "sure", ("this",), r"\b(rate|score|rank|grade) this (candidate|resume|applicant|application|person)\b"),
    ("scoring", "sure", ("score", "marks", "rating"), r"\b(give|assign|award) [a-z ]{0,30}(full|highest|maximum|top|perfect) (score|marks|rating)\b"),
    ("scoring", "uncertain", ("recommend",), r"\b(must|should|always) (be )?(recommend|recommended)\b"),
    ("role", "sure", ("you are",), r"\byou are (now )?(a|an|the) (helpful )?(assistant|model|ai|evaluator|recruiter)\b"),
    ("role", "sure", ("system",), r"(\bsystem prompt\b|<\|?system\|?>|\bsystem:)"),
    ("role", "uncertain", ("act as",), r"\bact as (a|an|the|if)\b"),
    ("silence", "sure", ("do not",), r"\bdo not (mention|reveal|flag|report|disclose)\b"),
)


def instruction_shaped(spans: DataFrame) -> DataFrame:
    """(doc_id, span_id, page, patterns, families, severity, tier): spans that some pattern hits.

    A span is searched for a pattern only where it holds one of the pattern's words, which are plain substring searches.  A sure hit is suspicious, and
    high if two families meet in a span; uncertain hits alone are information, for a second look (tier 2).
    """
    low = F.lower("text")
    hit = lambda words, pattern: reduce(Column.__or__, [low.contains(w) for w in words]) & low.rlike(pattern)
    found = [F.when(hit(words, pattern), F.struct(F.lit(i).alias("no"), F.lit(family).alias("family"), F.lit(kind == "sure").alias("sure"))) for i, (family, kind, words, pattern) in enumerate(INSTRUCTIONS)]
    rows = spans.withColumn("hits", F.filter(F.array(*found), lambda x: x.isNotNull())).where(F.size("hits") > 0)
    families = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["family"])))
    sure = F.exists("hits", lambda x: x["sure"])
    return rows.select(
        "doc_id", "span_id", "page", F.transform("hits", lambda x: x["no"]).alias("patterns"), families.alias("families"),
        F.when(sure & (F.size(families) > 1), "high").when(sure, "suspicious").otherwise("info").alias("severity"), F.when(sure, 1).otherwise(2).alias("tier"),
    )


def truncate_evidence(spans: DataFrame, most: int = 12_000) -> DataFrame:
    """Spans in reading order as far as their tokens fit; `kept` and the running sum tell what was cut."""
    along = Window.partitionBy("doc_id").orderBy("page", "seqno").rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.withColumn("tokens_so_far", F.sum(tx.token_estimate(F.col("text"))).over(along))
    return rows.withColumn("kept", F.col("tokens_so_far") <= most)


def delta_gate(before: DataFrame, after: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, value) of two runs: the change, and whether it is a regression (more is better)."""
    rows = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full")
    return rows.withColumn("change", F.col("after") - F.col("before")).withColumn("regressed", F.coalesce(F.col("change") < -tolerance, F.lit(True)))
