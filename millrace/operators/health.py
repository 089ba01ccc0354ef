"""Roll-ups of runs, crawls and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(frontier: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, n): urls by status and documents by acceptance (A13). ``frontier``: status; ``documents``: accepted."""
    urls = frontier.groupBy(F.concat(F.lit("urls_"), "status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    kept = documents.groupBy(F.when(F.col("accepted"), "documents_accepted").otherwise("documents_rejected").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return urls.unionByName(kept)


def recommendations(report: DataFrame) -> DataFrame:
    """(kind, severity) that follow from one row of figures: avg_quality, review_total, automated_pass, task_types, strongest_signal (null: unknown), benchmark_total, benchmark_score."""
    c = F.col
    rate = c("automated_pass") / F.greatest(F.lit(1), "review_total")
    rules = (
        (c("avg_quality") < 0.65, "quality_gate", "high"), ((c("review_total") > 0) & (rate < 0.5), "task_extraction", "high"), ((c("automated_pass") >= 20) & (c("task_types") < 3), "task_diversity", "medium"), (c("strongest_signal") < 0.2, "signal_quality", "medium"),
        ((c("benchmark_total") > 0) & (c("benchmark_score") < 0.75), "benchmark", "critical"), (c("benchmark_total") == 0, "benchmark_missing", "high"), (c("automated_pass") > 0, "human_review_required", "high"),
    )
    told = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for rule, kind, severity in rules]))
    none = F.array(F.struct(F.lit("governance").alias("kind"), F.lit("info").alias("severity")))
    return report.select(F.explode(F.when(F.size(told) > 0, told).otherwise(none)).alias("x")).select("x.*")


def histogram_summary(observations: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Count, sum, mean and greatest of the values of each name and set of labels."""
    return observations.groupBy(name, *labels).agg(F.count(value).alias("n"), F.round(F.sum(value), 6).alias("sum"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))


def loss_gate(losses: DataFrame, run: str = "run", step: str = "step", loss: str = "loss", most: float = 1.5) -> DataFrame:
    """(run, n, first, final, best, improvement, status) of each run's losses (A37, W10): pass if all are finite and the last is at most ``most`` times the first.

    First and last are by step (then loss); improvement is relative to the first. No window: the ends are aggregates.
    """
    x = F.struct(F.col(step), F.col(loss))
    by = losses.groupBy(run).agg(F.count(loss).alias("n"), F.min(x).alias("a"), F.max(x).alias("b"), F.min(loss).alias("best"), F.bool_and(~F.isnan(loss) & (F.abs(loss) < float("inf"))).alias("finite"))
    first, final = F.col("a")[loss], F.col("b")[loss]
    improvement = (first - final) / F.greatest(F.abs(first), F.lit(1e-9))
    ok = F.col("finite") & ((F.col("n") == 1) | (final <= first * most))
    return by.select(run, "n", first.alias("first"), final.alias("final"), "best", F.round(improvement, 6).alias("improvement"), F.when(ok, "pass").otherwise("fail").alias("status"))


def stale_validations(losses: DataFrame, patience: int, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """Adds best (so far), stale (validations since it was reached) and stop (W10): training would end where ``stale`` first is ``patience``."""
    w = Window.partitionBy(run).orderBy(step)
    best = losses.withColumn("best", F.min(loss).over(w)).withColumn("_at", F.row_number().over(w))
    reached = F.max(F.when(F.col(loss) <= F.col("best"), F.when(F.coalesce(F.lag("best").over(w) > F.col(loss), F.lit(True)), F.col("_at")))).over(w)
    out = best.withColumn("_r", reached).withColumn("stale", F.col("_at") - F.col("_r"))
    return out.withColumn("stop", F.col("stale") >= patience).drop("_at", "_r")


def forgetting(losses: DataFrame, kind: str = "kind", loss: str = "loss") -> DataFrame:
    """(kind, tasks, loss, perplexity, retention) by kind of task: the mean loss, e to it (at most e^20, 1 without losses), and 100 / (1 + loss)."""
    mean = F.coalesce(F.avg(loss), F.lit(0.0))
    by = losses.groupBy(kind).agg(F.count(F.lit(1)).alias("tasks"), mean.alias("m"))
    return by.select(kind, "tasks", F.round("m", 4).alias("loss"), F.round(F.when(F.col("m") > 0, F.exp(F.least(F.lit(20.0), "m"))).otherwise(1.0), 2).alias("perplexity"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 / (1.0 + F.col("m")))), 2).alias("retention"))


def readiness(checks: DataFrame, by: str, status: str = "status") -> DataFrame:
    """(by, checks, status): block if a check failed, warn if one warns, else pass."""
    out = F.when(F.bool_or(F.col(status) == "fail"), "block").when(F.bool_or(F.col(status) == "warn"), "warn").otherwise("pass")
    return checks.groupBy(by).agg(F.count(F.lit(1)).alias("checks"), out.alias("status"))


def last_of_stage(events: DataFrame, stage: str, order: list[str]) -> DataFrame:
    """The last event of each stage."""
    rest = [c for c in events.columns if c != stage and c not in order]
    return events.groupBy(stage).agg(F.max(F.struct(*order, *rest)).alias("m")).select(stage, *[f"m.{c}" for c in [*order, *rest]])


def unseen(events: DataFrame, keys: DataFrame, on: tuple[str, ...] = ("rank", "source_sequence")) -> DataFrame:
    """Events whose keys haven't come in before (J15); of events with the same keys in one batch, any one."""
    return events.dropDuplicates(list(on)).join(keys.select(*on).distinct(), list(on), "left_anti")


# --- records for fine-tuning

END = "<|document_end|>"


def sft_prompt(system: Column, instruction: Column) -> Column:
    """What a model sees of a record, up to its own turn."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    head = F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit("System:\n"), bare(system)))
    return F.concat_ws("\n\n", head, F.concat(F.lit("User:\n"), bare(instruction)), F.lit("Assistant:\n"))


def sft_completion(thought: Column, response: Column) -> Column:
    """What it should answer: thought, response and the end."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    mind = F.when(F.coalesce(thought, F.lit("")) != "", F.concat(F.lit("<|thought_start|>\n"), bare(thought), F.lit("\n<|thought_end|>")))
    return F.concat_ws("\n", mind, bare(response), F.lit(END))


def sft_arrays(prompt_ids: Column, completion_ids: Column, length: int, pad: int = 0, ignore: int = -100) -> Column:
    """(input_ids, labels, attention_mask) of one length: labels are ``ignore`` on the prompt and on padding; what is too long loses its end, empty ids are one 0."""
    some = lambda ids: F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, ids).otherwise(F.array(F.lit(0)).cast("array<int>"))
    a, b = some(prompt_ids), some(completion_ids)
    ids, labels = F.slice(F.concat(a, b), 1, length), F.slice(F.concat(F.transform(a, lambda _: F.lit(ignore)), b), 1, length)
    fill = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), F.lit(length) - F.size(x)))
    return F.struct(fill(ids, pad).alias("input_ids"), fill(labels, ignore).alias("labels"), fill(F.transform(ids, lambda _: F.lit(1)), 0).alias("attention_mask"))
