"""Status of simulation jobs: joins, anti-joins and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts after which a failing replica is given up, and minutes for which a preempted task counts as queued.
MAX_ATTEMPTS, GRACE_MINUTES = 5, 20


def jobs_by_directory(jobs: DataFrame) -> DataFrame:
    """``workdir``, ``n_jobs``, ``job_ids`` (sorted, by commas)."""
    return jobs.groupBy("workdir").agg(F.count("*").alias("n_jobs"), F.array_join(F.sort_array(F.collect_list("job_id")), ",").alias("job_ids"))


def simulation_status(sims: DataFrame, jobs: DataFrame, target_ps: float | None = None) -> DataFrame:
    """Each simulation (``workdir``, ``target_ps``, ``current_ps``) with its ``status``, ``n_jobs`` and ``job_ids``."""
    target = F.lit(float(target_ps)) if target_ps is not None else F.col("target_ps")
    out = sims.join(jobs_by_directory(jobs), "workdir", "left").withColumn("target_ps", target).withColumn("n_jobs", F.coalesce("n_jobs", F.lit(0)).cast("long"))
    finished = (F.col("target_ps") < float("inf")) & (F.col("current_ps") + 1e-3 >= F.col("target_ps"))
    status = F.when(F.col("target_ps").isNull(), "error").when(finished, "completed").when(F.col("n_jobs") > 1, "error").when(F.col("n_jobs") == 1, "active").otherwise("failed")
    return out.withColumn("status", status).withColumn("job_ids", F.coalesce("job_ids", F.lit("")))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """``transform``, ``replica``, ``attempts``: what the last line of an append-only table says."""
    return attempts.groupBy("transform", "replica").agg(F.max_by("n", "line_no").alias("attempts"))


def replica_status(replicas: DataFrame, jobs: DataFrame, attempts: DataFrame, churn: DataFrame | None = None, cap: int = MAX_ATTEMPTS) -> DataFrame:
    """Each replica (``transform``, ``replica``, ``est``, ``unc``) with its ``status``.

    ``jobs`` and ``churn`` have a row for each job and each requeue of a replica.
    """
    keys = ["transform", "replica"]
    out = replicas.join(jobs.groupBy(*keys).agg(F.count("*").alias("n_jobs")), keys, "left").join(latest_attempts(attempts), keys, "left")
    if churn is not None:
        out = out.join(churn.groupBy(*keys).agg(F.count("*").alias("churn")), keys, "left")
    else:
        out = out.withColumn("churn", F.lit(0))
    out = out.fillna(0, ["n_jobs", "attempts", "churn"])
    status = (
        F.when(F.col("est").isNotNull() & F.col("unc").isNotNull(), "completed")
        .when(F.col("n_jobs") > 1, "error")
        .when(F.col("n_jobs") == 1, "active")
        .when((F.col("attempts") >= cap) & (F.col("churn") == 0), "abandoned")
        .otherwise("failed")
    )
    return out.withColumn("status", status)


def with_preempted(queue: DataFrame, preempted: DataFrame, now, grace_minutes: int = GRACE_MINUTES) -> DataFrame:
    """The queue with recently preempted array tasks as ``REQUEUING``, unless they are queued already."""
    recent = preempted.filter(F.col("task_id").isNotNull() & ~F.contains(F.col("task_id").cast("string"), F.lit(".")))
    recent = recent.filter((F.col("ts") <= now) & (F.col("ts") >= now - F.expr(f"INTERVAL {grace_minutes} MINUTES")))
    keys = ["array_job_id", "task_id"]
    fresh = recent.select(*keys, "workdir").distinct().join(queue.select(*keys), keys, "left_anti")
    return queue.select(*keys, "state", "workdir").unionByName(fresh.withColumn("state", F.lit("REQUEUING")))


def enumerate_work(directories: DataFrame, active: DataFrame, transforms: DataFrame) -> DataFrame:
    """``transform``, ``replica``: replica directories and active tasks, whole numbers, of known transforms."""
    both = directories.select("transform", F.col("replica").cast("string").alias("replica")).union(active.select("transform", F.col("replica").cast("string")))
    numbered = both.filter(F.col("replica").rlike("^[0-9]+$")).withColumn("replica", F.col("replica").cast("long")).distinct()
    return numbered.join(transforms.select("transform").distinct(), "transform").orderBy("transform", "replica")


def resolve_transforms(queue: DataFrame, arrays: DataFrame) -> DataFrame:
    """Each queue row's ``transform`` by its array job; ``__UNKNOWN__`` where there is none."""
    return queue.join(arrays.select("array_job_id", "transform").distinct(), "array_job_id", "left").withColumn("transform", F.coalesce("transform", F.lit("__UNKNOWN__")))


def restart_groups(statuses: DataFrame, status: str = "failed") -> DataFrame:
    """``transform``, ``replicas``: the replicas to start again, sorted, by commas."""
    rows = statuses.filter(F.col("status") == status)
    return rows.groupBy("transform").agg(F.array_join(F.transform(F.sort_array(F.collect_list("replica")), lambda x: x.cast("string")), ",").alias("replicas"))


def status_counts(statuses: DataFrame, by: str = "workdir") -> DataFrame:
    """Counts by status for each directory, and a row of totals (null directory)."""
    names = ["completed", "active", "failed", "error", "abandoned"]
    return statuses.rollup(by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def fleet_report(counts: DataFrame, every_directory: bool = True) -> DataFrame:
    """``done``: whether all work has ended.

    ``every_directory``: each directory has some and all of it is completed or
    abandoned; else only the grand total counts, and only what is completed.
    """
    rows = counts.filter("workdir is not null")
    if every_directory:
        ended = (F.col("total") > 0) & (F.col("completed") + F.col("abandoned") == F.col("total"))
        return rows.agg(F.coalesce(F.bool_and(ended), F.lit(False)).alias("done"))
    total, completed = F.sum("total"), F.sum("completed")
    return rows.agg(F.coalesce((total > 0) & (completed == total), F.lit(False)).alias("done"))


def restart_listing(statuses: DataFrame) -> DataFrame:
    """``line``: what a dry run says about each simulation to start again."""
    rows = statuses.filter("status = 'failed'").orderBy("workdir")
    return rows.select(F.format_string("would restart %s (%.1f of %.1f ps)", "workdir", F.coalesce("current_ps", F.lit(0.0)), "target_ps").alias("line"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", "true").csv(path)
