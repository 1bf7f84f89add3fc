"""Retrospectives: allow-listed evidence of a journal, tagged records, what still lacks one, and orphaned runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.text import sanitize_history, shown_number
from trialframe.operators.ledger import journal_report
from trialframe.operators.lifecycle import metric_summary


def evidence(journal: DataFrame, entity: str, unit: str, metric: str, direction: str = "max") -> DataFrame:
    """(entity, evidence): JSON of counts, baseline and uplift if any was kept, and unit, metric and verdict of each row.

    Nothing else of a row goes in, whatever its columns.
    """
    rows = journal.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("unit"), F.col(metric).alias("metric"), "verdict"))).alias("r"))
    listed = rows.select(entity, F.transform("r", lambda x: F.struct(x["metric"].alias("metric"), x["unit"].alias("unit"), x["verdict"].alias("verdict"))).alias("rows"))
    report = journal_report(journal, entity, unit, metric, direction).select(entity, F.struct("crashes", "kept", "units").alias("report"))
    kept = metric_summary(journal, entity, unit, metric, direction).select(entity, F.struct("baseline", "uplift").alias("metrics"))
    held = listed.join(report, entity).join(kept, entity, "left")
    plain = {"ignoreNullFields": "false"}
    body = F.when(F.col("metrics").isNull(), F.to_json(F.struct("report", "rows"), plain)).otherwise(F.to_json(F.struct("metrics", "report", "rows"), plain))
    return held.select(entity, body.alias("evidence"))


def to_record(experiment: Column, baseline: Column, best: Column, uplift: Column, outcome: Column) -> Column:
    """A retrospective as JSON: with its metrics, or tagged as one that kept nothing."""
    verdict = F.struct(outcome.alias("outcome")).alias("verdict")
    positive = F.to_json(F.struct(experiment.alias("experiment"), baseline.alias("baseline"), best.alias("best_metric"), uplift.alias("uplift"), verdict))
    negative = F.to_json(F.struct(experiment.alias("experiment"), F.lit(False).alias("kept"), verdict))
    return F.when(best.isNull(), negative).otherwise(positive)


_FIELDS = {True: ("experiment", "baseline", "best_metric", "uplift", "verdict"), False: ("experiment", "kept", "verdict")}


def from_record(record: Column) -> Column:
    """(experiment, kept, baseline, best_metric, uplift, outcome) of a record; a field too many or too few raises."""
    kept = F.coalesce(F.get_json_object(record, "$.kept"), F.lit("")) != "false"
    keys = F.json_object_keys(record)
    exact = lambda k: (F.size(F.array_except(keys, F.array(*map(F.lit, _FIELDS[k])))) == 0) & (F.size(keys) == len(_FIELDS[k]))
    good = F.coalesce(F.when(kept, exact(True)).otherwise(exact(False)), F.lit(False))
    r = F.from_json(record, "experiment string, baseline double, best_metric double, uplift double, verdict struct<outcome:string>")
    out = F.struct(r["experiment"].alias("experiment"), kept.alias("kept"), r["baseline"].alias("baseline"), r["best_metric"].alias("best_metric"), r["uplift"].alias("uplift"), r["verdict"]["outcome"].alias("outcome"))
    return F.when(good, out).otherwise(F.raise_error(F.concat(F.lit("not a retrospective: "), F.coalesce(record, F.lit("null")))).cast(_TYPE))


_TYPE = "struct<experiment:string,kept:boolean,baseline:double,best_metric:double,uplift:double,outcome:string>"


def missing_retros(ledger: DataFrame, records: DataFrame, name: str) -> DataFrame:
    """Names of completed experiments without a durable retrospective."""
    return ledger.where(F.col("event") == "completed").select(name).distinct().join(records.select(name).distinct(), name, "left_anti")


def spend_recorded(runs: DataFrame, journal: DataFrame, sidecar: DataFrame, run: str) -> DataFrame:
    """runs whose spend is in the journal or in the sidecar of infrastructure events."""
    told = journal.select(run).unionByName(sidecar.select(run)).where(F.col(run).isNotNull()).distinct()
    return runs.join(told, run, "left_semi")


def orphan_scan(states: DataFrame, recorded: DataFrame, run: str) -> DataFrame:
    """(run, resolution) of runs that have not ended: live, unknown, accounted (dead, but its spend is recorded) or latched."""
    held = states.join(recorded.select(run).distinct().withColumn("__told", F.lit(True)), run, "left")
    out = F.when(F.col("state") != "dead", F.col("state")).when(F.col("__told"), "accounted").otherwise("latched")
    return held.select(run, out.alias("resolution"))


def scanned(registry: DataFrame, states: DataFrame, recorded: DataFrame, run: str, experiment: str) -> DataFrame:
    """(run, experiment, resolution, outcome, latch) of records that have not ended.

    The dead whose spend is recorded end as accounted; the other dead end as orphaned and put a latch on their experiment
    that says what to reconcile. Live and unknown ones stay, so that every later scan finds them again.
    """
    open_ = registry.where("outcome is null").select(run, experiment).join(states.select(run, "state"), run)
    held = orphan_scan(open_, recorded, run).join(open_, run)
    dead = F.col("resolution") == "latched"
    outcome = F.when(dead, "orphaned").when(F.col("resolution") == "accounted", "accounted")
    reason = F.concat(F.lit("orphaned run "), F.col(run).cast("string"), F.lit(" has no accounting trace; reconcile its spend, then delete this latch"))
    return held.select(run, experiment, "resolution", outcome.alias("outcome"), F.when(dead, reason).alias("latch"))


def unreconciled(registry: DataFrame, latches: DataFrame, run: str, experiment: str) -> DataFrame:
    """(run, experiment) of records that ended as orphaned and whose experiment still has its latch."""
    return registry.where("outcome = 'orphaned'").select(run, experiment).join(latches.select(experiment).distinct(), experiment, "left_semi")


def spec_seq(name: Column) -> Column:
    """The leading number of NNN-name, else null."""
    return F.regexp_extract(name, "^([0-9]+)-", 1).try_cast("int")


def pending_specs(specs: DataFrame, name: str) -> DataFrame:
    """(seq, name, state): the one pending spec of each number; several are ambiguous, and then none is named."""
    out = specs.groupBy(spec_seq(F.col(name)).alias("seq")).agg(F.count("*").alias("n"), F.min(name).alias("first"))
    return out.where("seq is not null").select("seq", F.when(F.col("n") == 1, F.col("first")).alias("name"), F.when(F.col("n") == 1, "pending").otherwise("ambiguous").alias("state"))


def described_change(changes: DataFrame, by: str, label: str, path: str, metric_key: str, reported: str) -> DataFrame:
    """(by, description): who edited which files, sorted, and the metric they reported, if any."""
    out = changes.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(path)), ", ").alias("f"), F.max(label).alias("l"), F.max(reported).alias("m"))
    files = F.when(F.col("f") == "", "no files").otherwise(F.col("f"))
    tail = F.when(F.col("m").isNull(), "").otherwise(F.concat(F.lit(f" (reported {metric_key}="), shown_number(F.col("m")), F.lit(")")))
    return out.select(by, F.concat("l", F.lit(" edited "), files, tail).alias("description"))


def rendered_retro(r: Column) -> Column:
    """The heading of a retrospective (as `from_record` gives it): its metrics, or that the incumbent stands."""
    kept = F.concat(F.lit(" (baseline "), shown_number(r["baseline"]), F.lit(" -> best "), shown_number(r["best_metric"]), F.lit(", uplift "), shown_number(r["uplift"]), F.lit(")"))
    return F.concat(r["experiment"], F.lit(": "), r["outcome"], F.when(r["kept"], kept).otherwise(" (no candidate kept; incumbent baseline stands)"))


def campaign_context(retro_records: DataFrame, failures: DataFrame, campaign: str, record: str) -> DataFrame:
    """(campaign, retros, failures): what the next round is told, each a text of lines; failures are sanitised.

    failures: (campaign, reasons), as `ledger.failure_reasons` gives them.
    """
    told = retro_records.groupBy(campaign).agg(F.array_join(F.array_sort(F.collect_list(rendered_retro(from_record(F.col(record))))), "\n").alias("retros"))
    said = failures.select(campaign, sanitize_history(F.col("reasons")).alias("failures"))
    return told.join(said, campaign, "full_outer").select(campaign, F.coalesce("retros", F.lit("")).alias("retros"), F.coalesce("failures", F.lit("")).alias("failures"))
