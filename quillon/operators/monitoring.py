"""Progress, queues, retries and resources, over log tables.

progress: batch_id, seq, file_path, phase, start_time, end_time, processing_time, success, field_count, confidence_scores array
batches: batch_id, total_files, current_phase, current_progress (0 to 1), elapsed (seconds)
jobs: job_id, batch_id, seq, priority, status, created_at, started_at, completed_at
attempts: seq, operation_name, attempt_number; samples: host, seq, memory_percent, cpu_percent, disk_free_mb, threads
`seq` is the order of arrival, each number once in a batch or host. Running values and sliding frames are scanned in parts (see order.py):
no window holds a whole batch or host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..sources.scratch import fresh
from . import order
from .order import last

#: Phases in the order of their names, with their share of a file's work.
PHASES = {"Extraction": 0.4, "Ingestion": 0.2, "OCR": 0.3, "Validation": 0.1}
STATUSES = ("completed", "failed", "cancelled", "running", "queued")


def done_files(progress: DataFrame) -> DataFrame:
    """(batch_id, done): distinct files of each batch with a successful record."""
    return progress.where("success").groupBy("batch_id").agg(F.count_distinct("file_path").alias("done"))


def _with_done(batches: DataFrame, progress: DataFrame) -> DataFrame:
    return batches.join(done_files(progress), "batch_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))


def share_done() -> Column:
    """Of the columns done, total_files, current_phase and current_progress: the done files, and of the current one the phases before its own
    (by name) and its share of that one; at most 1."""
    part = F.lit(0.0)
    for name, weight in PHASES.items():
        part = part + F.when(F.col("current_phase") > name, weight).when(F.col("current_phase") == name, F.col("current_progress") * weight).otherwise(0.0)
    share = F.least(F.lit(1.0), F.col("done") / F.col("total_files") + part / F.col("total_files"))
    return F.when(F.col("total_files") > 0, share).otherwise(0.0)


def etas() -> dict[str, Column]:
    """current_eta and batch_eta, of the columns mean (a file's time; may be null), done, total_files and current_progress."""
    left = F.col("total_files") - F.col("done")
    known = F.col("mean").isNotNull() & (left > 0)
    current = F.col("mean") * (1.0 - F.col("current_progress"))
    return {"current_eta": F.when(known, current).otherwise(0.0), "batch_eta": F.when(known, current + (left - 1) * F.col("mean")).otherwise(0.0)}


def batch_progress(batches: DataFrame, progress: DataFrame) -> DataFrame:
    """(batch_id, progress): see share_done."""
    return _with_done(batches, progress).select("batch_id", share_done().alias("progress"))


def eta(batches: DataFrame, progress: DataFrame) -> DataFrame:
    """(batch_id, current_eta, batch_eta): from the mean time of a file in the last 20 records; 0 when nothing is known or left."""
    recent = last(progress, 20, "seq", "batch_id").groupBy("batch_id", "file_path").agg(F.sum("processing_time").alias("t"))
    mean = recent.groupBy("batch_id").agg(F.avg("t").alias("mean"))
    rows = _with_done(batches, progress).join(mean, "batch_id", "left")
    return rows.select("batch_id", *(c.alias(n) for n, c in etas().items()))


def running(progress: DataFrame) -> DataFrame:
    """progress with n (records so far), done (distinct successful files so far) and throughput (done files a minute since the batch's
    first start; the first six seconds count as six). A file counts at its first successful record; a long batch is scanned in parts."""
    firsts = progress.where("success").groupBy("batch_id", "file_path").agg(F.min("seq").alias("seq")).select("batch_id", "seq", F.lit(1).alias("done"))
    rows = order.scanned(progress.drop("done").join(firsts, ["batch_id", "seq"], "left"), "batch_id", "seq", {"n": ("count", F.lit(1)), "done": ("sum", F.coalesce("done", F.lit(0))), "since": ("min", F.col("start_time"))})
    return rows.withColumn("throughput", F.col("done") / F.greatest((F.col("end_time") - F.col("since")) / 60, F.lit(0.1))).drop("since")


def basic_eta(progress: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, seq, eta): at each record, the time so far for each record, times the files that are left; 0 at the end."""
    rows = order.scanned(progress.select("batch_id", "seq", "start_time", "end_time"), "batch_id", "seq", {"n": ("count", F.lit(1)), "since": ("min", F.col("start_time"))})
    left = F.greatest(F.col("total_files") - F.col("n"), F.lit(0))
    return rows.join(batches.select("batch_id", "total_files"), "batch_id").select("batch_id", "seq", ((F.col("end_time") - F.col("since")) / F.col("n") * left).alias("eta"))


def milestones(progress: DataFrame, batches: DataFrame, marks: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(batch_id, milestone, reached): the first record at which so large a share of a batch's files is done; only those reached."""
    rows = running(progress).where("success").join(batches.select("batch_id", "total_files"), "batch_id")
    share = F.col("done") / F.col("total_files")
    firsts = rows.groupBy("batch_id").agg(*(F.min(F.when(share >= m, F.col("seq"))).alias(f"m{i}") for i, m in enumerate(marks)))
    return firsts.select("batch_id", F.explode(F.array(*(F.struct(F.lit(m).alias("milestone"), F.col(f"m{i}").alias("reached")) for i, m in enumerate(marks)))).alias("x")).select("batch_id", "x.*").where("reached is not null")


def degradation(progress: DataFrame, threshold: float = 0.5, history: int = 5) -> DataFrame:
    """(batch_id, seq, baseline, throughput, alert): the baseline is the first throughput above 0 that is taken from the record `history` on;
    later records whose throughput is under `threshold` of it raise an alert."""
    rows = running(progress).where(f"n >= {history}").select("batch_id", "seq", "throughput")
    base = rows.where("throughput > 0").groupBy("batch_id").agg(F.min_by("throughput", "seq").alias("baseline"), F.min("seq").alias("taken"))
    return rows.join(base, "batch_id").where("seq > taken").select("batch_id", "seq", "baseline", "throughput", (F.col("throughput") < F.col("baseline") * threshold).alias("alert"))


def performance(batches: DataFrame, progress: DataFrame) -> DataFrame:
    """One row for each batch: files a minute, fields a second, mean time, success rate of records (1 without any) and mean of all
    scores."""
    scores = F.aggregate("confidence_scores", F.lit(0.0), lambda a, c: a + c)
    got = progress.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("field_count").alias("fields"), F.avg("processing_time").alias("mean_time"), F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("rate"), F.sum(scores).alias("s"), F.sum(F.size("confidence_scores")).alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = _with_done(batches, progress).join(got, "batch_id", "left")
    return rows.select("batch_id", F.when(F.col("n") > 0, F.col("done") / F.greatest(F.col("elapsed") / 60, F.lit(0.1))).otherwise(0.0).alias("docs_per_min"), zero(F.col("fields") / F.greatest(F.col("elapsed"), F.lit(0.1))).alias("fields_per_sec"), zero(F.col("mean_time")).alias("mean_time"), F.coalesce("rate", F.lit(1.0)).alias("success_rate"), zero(F.col("s") / F.nullif(F.col("k"), F.lit(0))).alias("avg_confidence"))


def phase_stats(progress: DataFrame) -> DataFrame:
    """One row for each phase; zeros for one without records."""
    phases = progress.sparkSession.createDataFrame([(p,) for p in PHASES], "phase string")
    t = F.col("processing_time")
    got = progress.groupBy("phase").agg(F.count("*").alias("n"), F.avg(t).alias("avg_time"), F.min(t).alias("min_time"), F.max(t).alias("max_time"), F.sum(t).alias("total_time"))
    return F.broadcast(phases).join(got, "phase", "left").na.fill(0)


def summary(batches: DataFrame, progress: DataFrame) -> DataFrame:
    """One row for each batch: its size, progress, elapsed time, performance, and its phases' counts and mean times as a map."""
    phases = progress.groupBy("batch_id", "phase").agg(F.count("*").alias("n"), F.avg("processing_time").alias("avg_time")).groupBy("batch_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", F.struct("n", "avg_time"))))).alias("phases"))
    return batches.select("batch_id", "total_files", "elapsed").join(batch_progress(batches, progress), "batch_id").join(performance(batches, progress), "batch_id").join(phases, "batch_id", "left")


# queue
def processing_time() -> Column:
    return F.coalesce(F.col("completed_at") - F.col("started_at"), F.lit(0.0))


def queue_progress(batch_jobs: DataFrame, active: DataFrame, finished: DataFrame) -> DataFrame:
    """One row for each batch of batch_jobs(batch_id, job_id): its jobs by status, a job's status taken from `active`, else from `finished`
    (job_id, status); the finished share in per cent, and whether all are."""
    status = F.coalesce("active_status", "finished_status")
    rows = batch_jobs.join(active.select("job_id", F.col("status").alias("active_status")), "job_id", "left").join(finished.select("job_id", F.col("status").alias("finished_status")), "job_id", "left").withColumn("status", status)
    n, over = F.count("*"), F.count_if(F.col("status").isin("completed", "failed", "cancelled"))
    return rows.groupBy("batch_id").agg(n.alias("total_jobs"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), (100.0 * over / n).alias("progress"), (over == n).alias("is_complete"))


def queue_stats(jobs: DataFrame, recent: int = 50) -> DataFrame:
    """One row: finished jobs by status, and over the last of them mean time, mean wait and jobs an hour (0 if they span no time)."""
    over = jobs.where(F.col("status").isin("completed", "failed", "cancelled"))
    totals = over.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES[:3]))
    late = over.orderBy(F.desc("seq")).limit(recent)
    span = F.max_by("completed_at", "seq") - F.min_by("created_at", "seq")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    means = late.agg(zero(F.avg(processing_time())).alias("avg_time"), zero(F.avg(F.col("started_at") - F.col("created_at"))).alias("avg_wait"), zero(F.when(span > 0, F.count("*") / (span / 3600))).alias("per_hour"))
    return totals.join(F.broadcast(means))


def priority_order(jobs: DataFrame, *, priority: str, created: str, key: str) -> DataFrame:
    """All jobs with `rank` from 1: the most urgent first, of equal ones the oldest. Priorities are text or numbers; ranks are given by ranges."""
    turn, last_first = fresh([*jobs.columns, "rank"], "turn", "level")
    # the few levels of priority are numbered, the greatest first, so that one ascending order holds for all three columns
    levels = order.numbered(jobs.select(F.col(priority).alias(last_first)).distinct(), last_first, turn)
    rows = jobs.join(levels, F.col(priority).eqNullSafe(F.col(last_first))).withColumn(turn, -F.col(turn))
    return order.numbered(rows, [turn, created, key], "rank").withColumn("rank", F.col("rank") + 1).select(*[c for c in jobs.columns if c != "rank"], "rank").orderBy("rank")


# retries
def retry_stats(attempts: DataFrame, most: int = 3) -> DataFrame:
    """One row: an operation has failed if its last attempt's number is `most` or more. success_rate is a fraction."""
    ops = attempts.groupBy("operation_name").agg(F.count("*").alias("n"), F.max_by("attempt_number", "seq").alias("last"))
    n, failed = F.count("*"), F.count_if(F.col("last") >= most)
    return ops.agg(n.alias("operations"), F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"), failed.alias("failed"), ((n - failed) / F.greatest(n, F.lit(1))).alias("success_rate"), (F.coalesce(F.sum("n"), F.lit(0)).cast("double") / F.greatest(n, F.lit(1))).alias("average_attempts"))


# resources
MEMORY_MOST, CPU_MOST, DISK_LEAST, WARN = 80.0, 90.0, 1000.0, 70.0


def resource_status(memory: Column, cpu: Column, disk: Column) -> Column:
    said = F.array(F.when(memory > MEMORY_MOST, "MEMORY_CRITICAL").when(memory > WARN, "MEMORY_WARNING"), F.when(cpu > CPU_MOST, "CPU_CRITICAL").when(cpu > WARN, "CPU_WARNING"), F.when(disk < DISK_LEAST, "DISK_CRITICAL"))
    joined = F.array_join(F.array_compact(said), ", ")
    return F.when(joined == "", "NORMAL").otherwise(joined)


def alerts(samples: DataFrame) -> DataFrame:
    """(host, seq, level, message): one row for each limit that a sample breaks; warnings only where nothing is critical."""
    m, c, d = F.col("memory_percent"), F.col("cpu_percent"), F.col("disk_free_mb")
    one = lambda v: F.format_string("%.1f", F.bround(v, 1))
    # The messages.
    critical = F.array_compact(F.array(
        F.when(m > MEMORY_MOST, F.concat(F.lit("Memory usage critical: "), one(m), F.lit(f"% (limit: {MEMORY_MOST}%)"))),
        F.when(c > CPU_MOST, F.concat(F.lit("CPU usage critical: "), one(c), F.lit(f"% (limit: {CPU_MOST}%)"))),
        F.when(d < DISK_LEAST, F.concat(F.lit("Disk space critical: "), F.format_string("%.0f", F.bround(d, 0)), F.lit(f"MB free (threshold: {DISK_LEAST:.0f}MB)"))),
    ))
    high = F.array_compact(F.array(F.when(m > WARN, F.concat(F.lit("Memory usage high: "), one(m), F.lit(f"% (warning at: {WARN}%)"))), F.when(c > WARN, F.concat(F.lit("CPU usage high: "), one(c), F.lit(f"% (warning at: {WARN}%)")))))
    said = F.when(F.size(critical) > 0, F.transform(critical, lambda x: F.struct(F.lit("critical").alias("level"), x.alias("message")))).otherwise(F.transform(high, lambda x: F.struct(F.lit("warning").alias("level"), x.alias("message"))))
    return samples.select("host", "seq", F.explode(said).alias("x")).select("host", "seq", "x.*")


def headroom(samples: DataFrame, recent: int = 5, most_threads: int = 8) -> DataFrame:
    """samples with the means of the last samples, whether there is room for more threads, and the recommendation: scale_down with 70 % of
    the threads when memory or CPU is critical, scale_up with 150 % when there is room; none in the first two samples."""
    number, span, copy = fresh(samples.columns, "n", "span", "copy")
    late = Window.partitionBy("host", span).orderBy(number).rowsBetween(1 - recent, 0)
    rows = order.framed(samples, "host", "seq", recent - 1, number, span, copy).withColumns({"mean_memory": F.avg("memory_percent").over(late), "mean_cpu": F.avg("cpu_percent").over(late)}).where(~F.col(copy)).drop(span, copy)
    room = (F.col(number) >= recent) & (F.col("mean_memory") < WARN * 0.8) & (F.col("mean_cpu") < WARN * 0.8) & (F.col("threads") < most_threads)
    tight = (F.col("memory_percent") > MEMORY_MOST) | (F.col("cpu_percent") > CPU_MOST)
    rows = rows.withColumn("has_room", room)
    enough = F.col(number) >= 3
    return rows.withColumns({"action": F.when(enough & tight, "scale_down").when(enough & F.col("has_room"), "scale_up"), "recommended_threads": F.when(enough & tight, F.greatest(F.lit(1), F.floor(F.col("threads") * 0.7))).when(enough & F.col("has_room"), F.floor(F.col("threads") * 1.5))}).drop(number)


def memory_trend(samples: DataFrame) -> DataFrame:
    """(host, seq, trend): the change of memory since the sample before; null for the first."""
    number, span, copy = fresh(["host", "seq", "memory_percent"], "n", "span", "copy")
    rows = order.framed(samples.select("host", "seq", "memory_percent"), "host", "seq", 1, number, span, copy)
    change = F.col("memory_percent") - F.lag("memory_percent").over(Window.partitionBy("host", span).orderBy(number))
    return rows.withColumn("trend", change).where(~F.col(copy)).select("host", "seq", "trend")


def optimal_threads(memory: Column, cpu: Column, cpus: int) -> Column:
    n = F.when(memory > WARN, max(1, cpus // 2)).otherwise(cpus)
    n = F.when(cpu > WARN, F.greatest(F.lit(1), F.floor(n * 0.7))).otherwise(n)
    return F.least(n, F.lit(8))


def resource_summary(samples: DataFrame, cpus: int = 8) -> DataFrame:
    """One row for each host: its last sample, the means of the last ten, the status, and what is recommended."""
    m, c, d = F.col("memory_percent"), F.col("cpu_percent"), F.col("disk_free_mb")
    means = last(samples, 10, "seq", "host").groupBy("host").agg(F.avg("memory_percent").alias("mean_memory"), F.avg("cpu_percent").alias("mean_cpu"))
    now = samples.groupBy("host").agg(F.max_by(F.struct("memory_percent", "cpu_percent", "disk_free_mb", "threads"), "seq").alias("x")).select("host", "x.*")
    return now.join(means, "host").select("*", resource_status(m, c, d).alias("status"), optimal_threads(m, c, cpus).cast("long").alias("optimal_threads"), ((m > MEMORY_MOST) | (c > CPU_MOST) | (d < DISK_LEAST)).alias("should_scale_down"))


def enhanced_statistics(batches: DataFrame, progress: DataFrame, jobs: DataFrame, attempts: DataFrame, samples: DataFrame) -> DataFrame:
    """(section, key, fact, value, said): every summary there is, a row for each fact: its value if it is a number or a truth (1, 0), else what it
    says. The key is a host or batch, empty for the one row of retries and of the queue."""

    def facts(df: DataFrame, section: str, key: str | None) -> DataFrame:
        number = lambda c, t: F.col(c).cast("int").cast("double") if t == "boolean" else F.col(c).cast("double")
        each = F.array(*(F.struct(F.lit(c).alias("fact"), (F.lit(None).cast("double") if t == "string" else number(c, t)).alias("value"), (F.col(c) if t == "string" else F.lit(None).cast("string")).alias("said")) for c, t in df.dtypes if c != key))
        return df.select(F.lit(section).alias("section"), (F.col(key).cast("string") if key else F.lit("")).alias("key"), F.explode(each).alias("x")).select("section", "key", "x.*")

    return facts(retry_stats(attempts), "retry", None).unionByName(facts(queue_stats(jobs), "queue", None)).unionByName(facts(resource_summary(samples), "resources", "host")).unionByName(facts(performance(batches, progress), "processing", "batch_id"))


def error_rows(errors: DataFrame, most: int = 3) -> DataFrame:
    """errors(name, status, message, attempt, ...) with its class, category, severity, whether to try again and the reported message."""
    category, severity, start = classify.error_kind(F.col("name"))
    return errors.withColumns({"class": classify.error_class(F.col("name"), F.col("status")), "retry": classify.should_retry(F.col("name"), F.col("status"), F.col("attempt"), most), "category": category, "severity": severity, "reported": F.concat(start, F.col("message"))})
