"""The durable queue: coalescing, claims, fair shares, transitions, releases and crash recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["pending", "in_flight", "retry_wait", "waiting_dep"]
#: (state, event) -> state of the queue's contract (fixed values); every other pair is invalid.
TRANSITIONS = {
    ("pending", "claim"): "in_flight",
    ("in_flight", "done"): "done",
    ("in_flight", "retry"): "retry_wait",
    ("in_flight", "refund"): "retry_wait",
    ("in_flight", "park"): "waiting_dep",
    ("in_flight", "dead"): "dead",
    ("retry_wait", "release"): "pending",
    ("waiting_dep", "release"): "pending",
}
CRASH_LIMIT, REFUND_MS, HISTORY = 2, 200, 32


def coalesce_requests(requests: DataFrame) -> DataFrame:
    """One pending slot a path: (path, generation, file_id, op, old_path, priority, next_attempt_at, n).

    The newest generation, then the latest request, gives op and old_path; the newest request with a file_id gives that;
    priority and next_attempt_at are the smallest. Only per-path aggregates travel, so a hot path costs one row a task.
    """
    order = F.struct("generation", "seq")
    return requests.where("path IS NOT NULL").groupBy("path").agg(
        F.max("generation").alias("generation"),
        F.max_by("file_id", F.when(F.col("file_id").isNotNull(), order)).alias("file_id"),
        F.max_by("op", order).alias("op"),
        F.max_by("old_path", order).alias("old_path"),
        F.min("priority").alias("priority"),
        F.min("next_attempt_at").alias("next_attempt_at"),
        F.count("*").alias("n"),
    )


def allocate_generation(requests: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """(path, generation): one above the catalog's for a known path, else above the largest of its tasks, else 1."""
    known = files.select(F.col("path_key").alias("path"), F.col("generation").alias("_f"))
    queued = tasks.groupBy("path").agg(F.max("generation").alias("_t"))
    paths = requests.select("path").distinct()
    return paths.join(known, "path", "left").join(queued, "path", "left").select("path", F.coalesce(F.col("_f") + 1, F.col("_t") + 1, F.lit(1)).alias("generation"))


def is_fresh() -> Column:
    """First attempts and free leases; all other tasks are retries."""
    return (F.col("attempts") == 0) | (F.col("claim_attempt_charge") == 0)


def claimable(tasks: DataFrame, now_ms: int) -> DataFrame:
    """Due pending tasks whose path has none in flight, one a path: the first by priority, then id."""
    busy = tasks.where("state = 'in_flight'").select("path").distinct()
    due = tasks.where((F.col("state") == "pending") & (F.col("next_attempt_at") <= now_ms)).join(busy, "path", "left_anti")
    first = due.groupBy("path").agg(F.min(F.struct("priority", "task_id")).alias("_f"))
    return due.join(first, "path").where((F.col("task_id") == F.col("_f.task_id"))).drop("_f")


def claim(tasks: DataFrame, now_ms: int, limit: int, which: Column | None = None) -> DataFrame:
    """The next tasks by (priority, task_id), in flight, with the attempt charged."""
    due = claimable(tasks, now_ms)
    chosen = (due.where(which) if which is not None else due).orderBy("priority", "task_id").limit(limit)
    return chosen.withColumns({"attempts": F.col("attempts") + F.col("claim_attempt_charge"), "state": F.lit("in_flight")})


def interleave(tasks: DataFrame, now_ms: int, limit: int, every: int = 5) -> DataFrame:
    """(slot, task_id, source): fresh and retried tasks, one retry in ``every`` slots; a source that runs dry lends its slots.

    Both sources are cut to ``limit`` before they are numbered, so the window sees a bounded number of rows.
    """
    due = claimable(tasks, now_ms)

    def side(which: Column, name: str) -> DataFrame:
        top = due.where(which).orderBy("priority", "task_id").limit(limit)
        return top.select("task_id", F.lit(name).alias("source"), F.row_number().over(Window.orderBy("priority", "task_id")).alias("n"))

    fresh, retry = side(is_fresh(), "fresh"), side(~is_fresh(), "retry")
    slot = F.when(F.col("source") == "retry", F.col("n") * every).otherwise(F.col("n") + F.floor((F.col("n") - 1) / (every - 1)))
    both = fresh.unionByName(retry).withColumn("_s", slot)
    order = Window.orderBy("_s", F.col("source") == "retry")
    return both.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= limit).select("slot", "task_id", "source")


def transition(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """(task_id, event, outcome, state, attempts, claim_attempt_charge) for events (task_id, event).

    not_found without a task, invalid_transition unless the contract has the pair. Attempts: a claim adds the
    charge, retry and dead add what was not charged, refund and park give it back, never below 0.
    """
    to = F.create_map(*[x for (s, e), t in TRANSITIONS.items() for x in (F.lit(f"{s}>{e}"), F.lit(t))])
    j = events.join(tasks.select("task_id", "state", "attempts", "claim_attempt_charge"), "task_id", "left")
    target = F.try_element_at(to, F.concat_ws(">", "state", "event"))
    c, e, a = F.col("claim_attempt_charge"), F.col("event"), F.col("attempts")
    attempts = F.when(e == "claim", a + c).when(e.isin("retry", "dead"), a + 1 - c).when(e.isin("refund", "park"), F.greatest(a - c, F.lit(0))).otherwise(a)
    charge = F.when(e.isin("retry", "dead"), 1).when(e == "park", 0).otherwise(c)
    ok = target.isNotNull() & F.col("state").isNotNull()
    outcome = F.when(F.col("state").isNull(), "not_found").when(target.isNull(), "invalid_transition").otherwise("ok")
    return j.select("task_id", "event", outcome.alias("outcome"), F.when(ok, target).otherwise(F.col("state")).alias("state"), F.when(ok, attempts).otherwise(a).alias("attempts"), F.when(ok, charge).otherwise(c).alias("claim_attempt_charge"))


def park(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """All of a batch in waiting_dep, or none of it when any is not in flight: (batch, task_id, parked)."""
    j = wanted.join(tasks.select("task_id", "state"), "task_id", "left")
    good = j.groupBy("batch").agg(F.bool_and(F.coalesce(F.col("state") == "in_flight", F.lit(False))).alias("parked"))
    return wanted.join(good, "batch").select("batch", "task_id", "parked")


def release(tasks: DataFrame, now_ms: int) -> DataFrame:
    """Due retries and parked tasks back to pending, meeting the pending slot of their path: the newest generation
    stays, ties to the one pending already, then the smallest id. (path, task_id, generation, attempts, n)"""
    coming = tasks.where(((F.col("state") == "retry_wait") & (F.col("next_attempt_at") <= now_ms)) | (F.col("state") == "waiting_dep"))
    slots = coming.withColumn("_in", F.lit(0)).unionByName(tasks.where("state = 'pending'").withColumn("_in", F.lit(1)))
    best = F.max(F.struct("generation", "_in", (-F.col("task_id")).alias("_t"), "attempts")).alias("b")
    return slots.groupBy("path").agg(best, F.count("*").alias("n")).select("path", (-F.col("b._t")).alias("task_id"), "b.generation", "b.attempts", "n")


def slot_collisions(tasks: DataFrame) -> DataFrame:
    """(path, state, task_id, keep): of tasks that share a slot the newest generation stays, ties to the smallest id."""
    w = Window.partitionBy("path", "state").orderBy(F.desc("generation"), "task_id")
    n = Window.partitionBy("path", "state")
    return tasks.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(n)}).where("_n > 1").select("path", "state", "task_id", (F.col("_r") == 1).alias("keep"))


def recover(tasks: DataFrame) -> DataFrame:
    """After a crash: tasks in flight go back to pending, or are dead as poison from the second crash on."""
    hit = F.col("state") == "in_flight"
    count = F.col("crash_count") + hit.cast("int")
    dead = hit & (count >= CRASH_LIMIT)
    return tasks.withColumns({"crash_count": count, "error_class": F.when(hit, "poison"), "state": F.when(dead, "dead").when(hit, "pending").otherwise(F.col("state"))})


def superseded(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks in flight for which the catalog or another task of the path has a newer generation."""
    newest = tasks.groupBy("path").agg(F.max("generation").alias("_t"))
    known = files.select("file_id", F.col("generation").alias("_f"))
    j = tasks.where("state = 'in_flight'").join(newest, "path").join(known, "file_id", "left")
    return j.where((F.col("_t") > F.col("generation")) | (F.col("_f") > F.col("generation"))).drop("_t", "_f")


def merge_history(old: Column, new: Column, keep: int = HISTORY) -> Column:
    """Two histories one after the other, of which the newest entries stay."""
    both = F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array()))
    return F.when(F.size(both) > keep, F.slice(both, -keep, keep)).otherwise(both)


def backoff_ms(attempt: Column, base_ms: int, cap_ms: int, u: Column | None = None) -> Column:
    """min(base * 2^attempt, cap), shaken by 0.8 + 0.4 u; negative attempts count as 0, u is 0.5 when null or NaN, and 1 the least."""
    a = F.least(F.greatest(attempt, F.lit(0)), F.lit(62))
    shake = F.lit(0.5) if u is None else F.when(u.isNull() | F.isnan(u), F.lit(0.5)).otherwise(F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)))
    return F.greatest(F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), a.cast("double")), F.lit(float(cap_ms))) * (F.lit(0.8) + F.lit(0.4) * shake), F.lit(1.0))


#: First and longest wait, in ms, before a watch is opened again and before a failed scan is repeated (fixed values).
REOPEN_MS, RESCAN_MS = (5_000, 300_000), (1_000, 60_000)


def step_ms(attempt: Column, first_ms: int, most_ms: int) -> Column:
    """first * 2^attempt, at most ``most_ms``, in whole numbers and unshaken; null and negative attempts count as 0."""
    a = F.least(F.greatest(F.coalesce(attempt, F.lit(0)), F.lit(0)), F.lit(30)).cast("int")
    return F.least(F.lit(first_ms).cast("long") * F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(31)]), a + 1), F.lit(most_ms).cast("long"))


def attempt_entry(attempt: Column, at_ms: Column, error_class: Column, error: Column) -> Column:
    """One failed attempt as the JSON list that a history is made of; keys in order of their names."""
    return F.to_json(F.array(F.struct(at_ms.alias("at_ms"), attempt.alias("attempt"), error_class.alias("class"), error.alias("error"))))


def error_chain(chain: Column) -> Column:
    """JSON of an error and its causes, an array of (type, message), outermost first; null and empty give an empty list."""
    return F.coalesce(F.to_json(F.transform(chain, lambda e: F.struct(e["type"].alias("type"), e["message"].alias("message")))), F.lit("[]"))


def active_by_path(tasks: DataFrame) -> DataFrame:
    """(path, generation, pending, in_flight, parked): the active tasks of each path: largest generation, whether one waits or is in flight, and ids of parked ones.

    A path has one slot a state, so ``parked`` has two ids at most: of several rows in a slot the smallest id stands.
    """
    s = F.col("state")
    parked = F.array_compact(F.array(*[F.min(F.when(s == x, F.col("task_id"))) for x in ("retry_wait", "waiting_dep")]))
    return tasks.where(s.isin(ACTIVE) & F.col("path").isNotNull()).groupBy("path").agg(F.max("generation").alias("generation"), F.bool_or(s == "pending").alias("pending"), F.bool_or(s == "in_flight").alias("in_flight"), F.array_sort(parked).alias("parked"))


def tick(tasks: DataFrame, now_ms: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(tasks, claimed): one round of the scheduler: due retries and parked tasks come back to the pending slots of their paths, then the next ones are claimed."""
    coming = ((F.col("state") == "retry_wait") & (F.col("next_attempt_at") <= now_ms)) | F.col("state").isin("waiting_dep", "pending")
    kept = tasks.where(coming).join(release(tasks, now_ms).select("task_id").unionByName(tasks.where("state = 'pending'").join(tasks.where(coming & (F.col("state") != "pending")).select("path"), "path", "left_anti").select("task_id")).distinct(), "task_id", "left_semi")
    after = tasks.where(~F.coalesce(coming, F.lit(False))).unionByName(kept.withColumn("state", F.lit("pending")).select(*tasks.columns))
    claimed = claim(after, now_ms, limit).select(*tasks.columns)
    return after.join(claimed.select("task_id"), "task_id", "left_anti").select(*tasks.columns).unionByName(claimed), claimed


def settle(tasks: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """The tasks after events (task_id, event) that the contract allows; the others change nothing. Of several events of a task the first by name counts.

    A retry waits for its back-off, a claim given back for REFUND_MS.
    """
    one = events.groupBy("task_id").agg(F.min("event").alias("event"))
    moved = transition(tasks, one).where("outcome = 'ok'").select("task_id", F.struct("state", "attempts", "claim_attempt_charge", "event").alias("_to"))
    j = tasks.join(moved, "task_id", "left")
    wait = F.when(F.col("_to.event") == "retry", backoff_ms(F.col("_to.attempts") - 1, 5000, 1_800_000)).when(F.col("_to.event") == "refund", F.lit(REFUND_MS))
    changed = {c: F.coalesce(F.col(f"_to.{c}"), F.col(c)) for c in ("state", "attempts", "claim_attempt_charge")}
    return j.withColumns(changed | {"next_attempt_at": F.coalesce(F.lit(now_ms) + wait.cast("long"), F.col("next_attempt_at"))}).select(*tasks.columns)


def retry_allowed(error_class: Column, used: Column, most: int = 8) -> Column:
    return (error_class == "transient") & (used < most)


#: Error codes by class (fixed values); any other code is transient.
FATAL = ["ENOSPC", "EDQUOT"]
PERMANENT = ["EACCES", "EPERM", "EUNSUPPORTED", "EINVAL", "EROFS", "EFBIG", "ENAMETOOLONG", "ENOTDIR", "EISDIR", "ENOEXEC", "ENOSYS", "ENOTSUP", "EOPNOTSUPP"]
#: What each stage takes for permanent besides (fixed values).
STAGE_PERMANENT = {"io": ["file_too_large", "not_regular", "invalid_task"], "media": ["unsupported_image", "image_too_large", "image_panic", "invalid_image_config"], "embed": ["invalid_response"]}
CLASSES = ["transient", "permanent", "poison", "fatal"]


def classify_error(code: Column, explicit: Column | None = None, stage: Column | None = None) -> Column:
    """An explicit valid class holds, then the stage's rule; a full disk is fatal, what can't ever work permanent, all else (null too) transient."""
    own = F.lit(None).cast("string") if explicit is None else F.when(explicit.isin(CLASSES), explicit)
    by_stage = F.lit(None).cast("string")
    if stage is not None:
        for name, codes in STAGE_PERMANENT.items():
            by_stage = F.when((stage == name) & code.isin(codes), "permanent").otherwise(by_stage)
    return F.coalesce(own, by_stage, F.when(code.isin(FATAL), "fatal").when(code.isin(PERMANENT), "permanent").otherwise("transient"))


def dead_letter_versions(stage: Column, extractor: Column, model: Column) -> tuple[Column, Column]:
    """(extractor_version, embed_model_version) that a dead letter of a stage records; empty ones are null."""
    both = stage.isin("worker", "unknown")
    return F.when(((stage == "extract") | both) & (extractor != ""), extractor), F.when((stage.isin("embed", "vector") | both) & (model != ""), model)


def finish(tasks: DataFrame, done: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, dead letters) after tasks in flight are done: an older done task of the path goes, and so do dead letters of smaller generations."""
    hit = tasks.where("state = 'in_flight'").join(done.select("task_id"), "task_id", "left_semi")
    rest = tasks.join(hit.select("task_id"), "task_id", "left_anti")
    rest = rest.join(hit.select(F.col("path")).distinct().withColumn("state", F.lit("done")), ["path", "state"], "left_anti").select(*tasks.columns)
    newest = hit.groupBy("file_id").agg(F.max("generation").alias("_g"))
    kept = dead.join(newest, "file_id", "left").where(F.col("_g").isNull() | (F.col("generation") >= F.col("_g"))).select(*dead.columns)
    return rest.unionByName(hit.withColumn("state", F.lit("done")).select(*tasks.columns)), kept


def bury(tasks: DataFrame, failures: DataFrame, files: DataFrame, dead: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """The four tables a dead task changes, to be committed together: tasks, files, dead_letters and audit.

    failures: task_id, stage, error_class. The task is dead; its file, at the same generation, failed; the dead letter replaces one of a generation not
    above; audit tells of it. Failures of tasks not in flight change nothing.
    """
    hit = tasks.where("state = 'in_flight'").join(failures.groupBy("task_id").agg(F.max("stage").alias("stage"), F.max("error_class").alias("error_class")), "task_id")
    t = tasks.join(hit.select("task_id", F.lit(True).alias("_d")), "task_id", "left").withColumn("state", F.when(F.col("_d"), "dead").otherwise(F.col("state"))).select(*tasks.columns)
    letters = hit.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("generation", "path", "stage", "error_class")).alias("n"))
    failed = letters.select(F.col("file_id"), F.col("n.generation").alias("_g"))
    f = files.join(failed, "file_id", "left").withColumn("status", F.when(F.col("_g") == F.col("generation"), "failed").otherwise(F.col("status"))).select(*files.columns)
    old = dead.select("file_id", F.struct("generation", "path", "stage", "error_class", "updated_at").alias("o"))
    j = old.join(letters, "file_id", "full_outer")
    wins = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.generation") >= F.col("o.generation")))
    pick = lambda c: F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    d = j.select("file_id", pick("generation"), pick("path"), pick("stage"), pick("error_class"), F.when(wins, F.lit(now_ms).cast("long")).otherwise(F.col("o.updated_at")).alias("updated_at"))
    audit = hit.select(F.lit("dead_letter").alias("action"), "task_id", "file_id", "generation", F.col("path").alias("target"))
    return {"tasks": t, "files": f, "dead_letters": d, "audit": audit}


def probe(tasks: DataFrame) -> DataFrame:
    """The one parked task that is let through when a dependency's breaker half opens: the most urgent, then the oldest."""
    return tasks.where("state = 'waiting_dep'").orderBy("priority", "task_id").limit(1)


def due_roots(roots: DataFrame, now_ms: int, period_ms: int = 86_400_000) -> DataFrame:
    """(root, trigger): roots to reconcile now, with their most urgent trigger.

    roots: root, started (whether it was scanned since the start), dirty, last_ms, retry_at (null or when a failed scan may be repeated).
    """
    trigger = F.when(~F.col("started"), "startup").when(F.col("dirty"), "dirty").when(F.col("last_ms") + period_ms <= now_ms, "periodic")
    return roots.where(F.col("retry_at").isNull() | (F.col("retry_at") <= now_ms)).select("root", trigger.alias("trigger")).where("trigger IS NOT NULL")
