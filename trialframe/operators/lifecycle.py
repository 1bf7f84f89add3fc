"""Experiment lifecycle: approvals, liveness, replay, budgets, preflight, fingerprints, violations, tagged decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.functions.codec import canonical_json, json_objects
from trialframe.functions.expr import finite, seeded_key, text_digest

#: Events that mean that a number's launch has begun.
LAUNCHED_EVENTS = ("reserved", "started", "completed", "aborted", "infra_aborted", "preflight_failed")

# ---------------------------------------------------------------- decisions over keyed rows


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*keys, "r.*")


def approved_specs(ledger: DataFrame, files: DataFrame, seq: str, order: str, digest: str) -> DataFrame:
    """(seq, state) of every number that was queued: launched if its launch has begun ever, so it may not run again;
    pending without an approval; else by the last approval, whose digest the file must still have.
    """
    approved = F.col("event") == "approved"
    rows = ledger.where(F.col("event").isin("approved", "pending", *LAUNCHED_EVENTS)).groupBy(seq).agg(
        F.bool_or(F.col("event").isin(*LAUNCHED_EVENTS)).alias("begun"), F.bool_or(approved).alias("ok"), F.bool_or(F.col("event") == "pending").alias("asked"),
        F.max_by(F.when(approved, F.col(digest)), F.when(approved, F.col(order))).alias("held"),
    ).where("ok or asked")
    held = rows.join(files.select(seq, F.col(digest).alias("file_digest")), seq, "left")
    state = F.when(F.col("begun"), "launched").when(~F.col("ok"), "pending").when(F.col("file_digest").isNull(), "missing").when(F.col("file_digest") == F.col("held"), "verified").otherwise("altered")
    return held.select(seq, state.alias("state"))


def liveness(registry: DataFrame, processes: DataFrame | None, run: str, pid: str, group: str, command: str, alive: DataFrame | None = None) -> DataFrame:
    """(run, state, pid) of a registry of (run, pid, group): live, dead or unknown.

    A run with a process id is live if that process is there, has the run's name in its command and, where a group is
    registered, that group; else it is dead: the id has been given to another process. A run without an id is looked for
    in all commands, and the smallest process id that names it counts. Without a snapshot of processes only `alive`
    (a table of ids) tells, and a run without an id is unknown.

    Names are looked for as pieces of the commands of the lengths that names have, so the search is an equi-join.
    """
    if processes is None:
        known = registry.join(alive.select(pid).distinct().withColumn("__alive", F.lit(True)), pid, "left")
        state = F.when(F.col(pid).isNull(), "unknown").when(F.col("__alive"), "live").otherwise("dead")
        return known.select(run, state.alias("state"), F.col(pid).alias("pid"))
    by_pid = registry.where(F.col(pid).isNotNull()).select(run, pid, F.col(group).alias("__group")).join(processes, pid, "left")
    same = F.contains(F.col(command), F.col(run)) & (F.col("__group").isNull() | (F.col("__group") == F.col(group)))
    if alive is not None:
        by_pid = by_pid.join(alive.select(pid).distinct().withColumn("__alive", F.lit(True)), pid, "left")
        same = same & F.coalesce("__alive", F.lit(False))
    first = by_pid.select(run, F.when(F.coalesce(same, F.lit(False)), "live").otherwise("dead").alias("state"), F.col(pid).alias("pid"))
    named = registry.where(F.col(pid).isNull()).select(run)
    sizes = [r.n for r in named.select(F.length(run).alias("n")).distinct().where("n > 0").collect()]
    pieces = [_pieces(F.col(command), n) for n in sizes]
    none = F.expr("cast(array() as array<string>)")
    found = processes.select(F.col(pid).alias("pid"), F.explode(F.array_distinct(F.concat(none, *[F.coalesce(p, none) for p in pieces]))).alias(run))
    found = found.join(named.distinct(), run, "left_semi").groupBy(run).agg(F.min("pid").alias("pid"))
    second = named.join(found, run, "left").select(run, F.when(F.col("pid").isNotNull(), "live").otherwise("dead").alias("state"), "pid")
    return first.unionByName(second)


def _pieces(text: Column, n: int) -> Column:
    """All parts of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))


def parity_mismatches(local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): keys that one side lacks or whose values differ; a null value is a value."""
    a = local.select(key, F.struct(F.col(value).alias("v")).alias("a"))
    b = remote.select(key, F.struct(F.col(value).alias("v")).alias("b"))
    state = F.when(F.col("a").isNull(), "missing locally").when(F.col("b").isNull(), "missing remotely").when(~F.col("a.v").eqNullSafe(F.col("b.v")), "different")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")


REPLAY_MODES = ("record", "replay", "replay_or_record", "bypass")


def replayed(requests: DataFrame, store: DataFrame, key: str, mode: str) -> DataFrame:
    """requests with action: what each mode does with a request whose key the store has or lacks."""
    if mode not in REPLAY_MODES:
        raise ValueError(f"mode must be one of {REPLAY_MODES}")
    if mode in ("record", "bypass"):
        return requests.withColumn("action", F.lit("call and store" if mode == "record" else "call"))
    held = requests.join(store.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    miss = "refuse" if mode == "replay" else "call and store"
    return held.withColumn("action", F.when(F.col("__hit"), "serve").otherwise(miss)).drop("__hit")


def storable(responses: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    """Of each key the last response that succeeded."""
    return latest_per_key(responses.where(F.floor(F.col(status) / 100) == 2), keys, order)


def first_retries(retries: DataFrame, root: str, order: str, attempt: str) -> DataFrame:
    return retries.groupBy(root).agg(F.min_by(attempt, order).alias(attempt), F.count("*").alias("retries"))


def batch_members(members: DataFrame, batch: str, item: str) -> DataFrame:
    """(batch, n, members): the distinct items of a batch, sorted; a batch is bounded by its provider."""
    ids = F.array_sort(F.collect_set(item))
    return members.groupBy(batch).agg(ids.alias("ids")).select(batch, F.size("ids").alias("n"), F.array_join("ids", ",").alias("members"))


# ---------------------------------------------------------------- guards


def first_violation(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that does not hold, else null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def preflight(baseline: Column, again: Column, probe: Column, tolerance: float = 0.1, direction: str = "max") -> Column:
    """stable and reachable, or why not: a repeat within relative tolerance (equal for a baseline of 0), then a gain."""
    gains = probe > baseline if direction == "max" else probe < baseline
    stable = F.when(baseline == 0, again == 0).otherwise(F.abs(again - baseline) <= tolerance * F.abs(baseline))
    return F.when(~finite(baseline) | ~finite(again), "no metric").when(~stable, "unstable").when(gains, "ready").otherwise("unreachable")


def run_seconds(max_usd: Column, usd_per_hour: Column, overhead: int = 360, cap: int = 86_400) -> Column:
    """Seconds that a budget pays for, less the overhead, at most a day; null where nothing is left."""
    s = F.floor(max_usd / usd_per_hour * 3600 - overhead)
    return F.when(s >= 1, F.least(s, F.lit(cap)))


def checkpoint_steps(n: Column, fractions: list[float]) -> Column:
    """Distinct rounded-up shares of n steps, sorted, without the last step."""
    steps = F.array(*[F.ceil(n * F.lit(f)).cast("int") for f in fractions])
    return F.array_sort(F.array_distinct(F.array_except(steps, F.array(n.cast("int")))))


def diversity(drafts: DataFrame, by: str, text: str) -> DataFrame:
    """(by, drafts, distinct, violation): drafts that are all the same once trimmed."""
    out = drafts.groupBy(by).agg(F.count("*").alias("drafts"), F.count_distinct(F.trim(F.regexp_replace(text, "(?U)^\\s+|\\s+$", ""))).alias("distinct"))
    return out.withColumn("violation", (F.col("drafts") > 1) & (F.col("distinct") <= 1))


def not_finite_keys(values: Column) -> Column:
    """The sorted keys of a map whose numbers are NaN or infinite."""
    bad = F.map_filter(values, lambda _, v: v.isNotNull() & ~finite(v))
    return F.array_sort(F.map_keys(bad))


def with_prefixes(values: Column, prefixes: list[str]) -> Column:
    """The texts of an array that begin with any of the prefixes, in their order."""
    return F.filter(values, lambda x: F.greatest(*[F.startswith(x, F.lit(p)) for p in prefixes], F.lit(False)))


# ---------------------------------------------------------------- identities


DEFAULT_PORTS = {"http": 80, "https": 443}


def request_key(url: Column, method: Column, body: Column, schema_version: int = 1) -> Column:
    """A digest of a request: schema version, method, scheme, host, port, path, sorted query and body, apart by NUL.

    The order of the query and the case of scheme and host do not count; a port that is not written is its scheme's.
    Headers do not take part.
    """
    part = lambda k: F.regexp_extract(url, "^([^:/?#]+)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?", k)
    scheme, place = F.lower(part(1)), F.lower(F.regexp_replace(part(2), "^.*@", ""))
    host, port = F.regexp_replace(place, ":[0-9]*$", ""), F.regexp_extract(place, ":([0-9]+)$", 1)
    default = F.lit("")
    for name, number in DEFAULT_PORTS.items():
        default = F.when(scheme == name, str(number)).otherwise(default)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    named = lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v"))
    args = F.array_sort(F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), named))
    query = F.array_join(F.transform(args, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    parts = F.array(F.lit(str(schema_version)), F.upper(method), scheme, host, F.when(port == "", default).otherwise(port), path, query, F.coalesce(body, F.lit("")))
    return F.sha2(F.array_join(parts, "\u0000").cast("binary"), 256)


def rows_fingerprint(df: DataFrame, by: str, number: str, row: str, portion: int = 4096) -> DataFrame:
    """(by, fingerprint): a digest of the numbered rows of a packet in the order of their numbers.

    Rows are digested by portions of consecutive numbers, and the digests of the portions in their order, so that no
    task holds a packet.
    """
    line = F.concat(F.lit("["), F.col(number).cast("string"), F.lit(","), F.col(row).cast("string"), F.lit("]"))
    joined = lambda at, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v")))), lambda x: x["v"]), ",")
    rows = df.select(by, F.col(number).alias("__n"), F.floor(F.col(number) / portion).alias("__p"), line.alias("__line"))
    parts = rows.groupBy(by, "__p").agg(F.sha2(F.concat(F.lit("["), joined("__n", "__line"), F.lit("]")).cast("binary"), 256).alias("__d"))
    return parts.groupBy(by).agg(F.sha2(joined("__p", "__d").cast("binary"), 256).alias("fingerprint"))


# ---------------------------------------------------------------- time and series


def idle_sessions(df: DataFrame, entity: str, time: str, ttl_s: int) -> DataFrame:
    """(entity, session, first, last, uses): uses less than ttl apart; a resource is evicted ttl after the last one."""
    w = Window.partitionBy(entity).orderBy("__us")
    held = df.select(entity, F.unix_micros(F.col(time).cast("timestamp")).alias("__us"))
    new = F.coalesce((F.col("__us") - F.lag("__us").over(w)) >= ttl_s * 1_000_000, F.lit(True))
    numbered = held.withColumn("__new", new.cast("int")).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(entity, "session").agg(F.min("__us").alias("first_us"), F.max("__us").alias("last_us"), F.count("*").alias("uses"))


def metric_summary(df: DataFrame, entity: str, order: str, metric: str, direction: str = "max") -> DataFrame:
    """(entity, baseline, best, uplift): the first and the best kept metric and their distance."""
    kept = df.where((F.col("verdict") == "keep") & F.col(metric).isNotNull())
    out = kept.groupBy(entity).agg(F.min_by(metric, order).alias("baseline"), (F.max if direction == "max" else F.min)(metric).alias("best"))
    return out.withColumn("uplift", F.abs(F.col("best") - F.col("baseline")))


def unzipped_pairs(df: DataFrame, by: str, position: str, value: str) -> DataFrame:
    """(by, pair, chosen, rejected) of interleaved values: even positions are chosen, the next ones rejected."""
    pair = F.floor(F.col(position) / 2)
    return df.groupBy(by, pair.alias("pair")).agg(F.max(F.when(F.col(position) % 2 == 0, F.col(value))).alias("chosen"), F.max(F.when(F.col(position) % 2 == 1, F.col(value))).alias("rejected"))


def segments(words: Column, size: int) -> Column:
    """Words (text, start_ms, end_ms) in runs of size as segments with offsets in seconds."""
    firsts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / size), F.lit(0)).cast("int"))
    return F.transform(firsts, lambda k: _segment(F.slice(words, k * size + 1, size), k))


def _segment(part: Column, k: Column) -> Column:
    return F.struct(
        k.alias("id"), (F.element_at(part, 1)["start_ms"] / 1000.0).alias("start"), (F.element_at(part, -1)["end_ms"] / 1000.0).alias("end"),
        F.array_join(F.transform(part, lambda w: w["text"]), " ").alias("text"),
    )


# ---------------------------------------------------------------- decoding


def last_cost(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cost): the valid total_cost_usd of the last embedded object that has one."""
    found = df.select(key, F.posexplode(json_objects(F.col(text))).alias("position", "object"))
    cost = F.get_json_object("object", "$.total_cost_usd").cast("double")
    held = found.select(key, "position", cost.alias("cost")).where(finite(F.col("cost")) & (F.col("cost") >= 0))
    return held.groupBy(key).agg(F.max_by("cost", "position").alias("cost"))


def shuffled(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """df with a reproducible order key."""
    return df.withColumn("shuffle_key", seeded_key(seed, key))


# ---------------------------------------------------------------- judgements


def vote_key(provider: Column, model: Column, schema: Column, prompt_version: Column, digest: Column, row_id: Column, candidate: Column, reference: Column, seed: Column, version: int = 1) -> Column:
    """The key of a judge's vote: who judges, on what, in which order; canonical JSON, hashed."""
    judge = canonical_json(provider=provider, model=model, verdict_schema=schema)
    body = canonical_json(candidate_sha256=text_digest(candidate), digest=digest, judge=F.lit("\u0001"), prompt_version=prompt_version, reference_sha256=text_digest(reference), row_id=row_id.cast("string"), seed=seed, v=F.lit(version))
    return text_digest(F.replace(body, F.lit('"\\u0001"'), judge))


def served_votes(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """rows with vote and hit: a vote is served only where the whole key is that of a stored one."""
    return rows.join(cache.select(key, "vote"), key, "left").withColumn("hit", F.col("vote").isNotNull())


def parity_fingerprint(packages: Column, parameters: Column) -> Column:
    """Versions of packages and parameters in one map, each under its own prefix."""
    under = lambda m, p: F.transform_keys(m, lambda k, _: F.concat(F.lit(p), k))
    return F.map_concat(under(packages, "pkg:"), under(parameters, "param:"))


def run_key(name: Column, base: Column, method: Column, lora: Column, hyperparams: Column, dataset: Column) -> Column:
    """The key under which a training run finds its own state again: of what changes what it trains, not of where it resumes.

    lora, hyperparams and dataset are JSON texts with sorted keys.
    """
    fields = {"base": canonical_json(v=base), "method": canonical_json(v=method), "name": canonical_json(v=name)}
    plain = [F.concat(F.lit(f'"{k}":'), F.regexp_replace(v, r'^[{]"v":(.*)[}]$', "$1")) for k, v in fields.items()]
    nested = [F.concat(F.lit(f'"{k}":'), v) for k, v in (("dataset", dataset), ("hyperparams", hyperparams), ("lora", lora))]
    ordered = [plain[0], nested[0], nested[1], nested[2], plain[1], plain[2]]
    return text_digest(F.concat(F.lit("{"), F.concat_ws(",", *ordered), F.lit("}")))


def resume_choice(specs: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """specs (key, resume_from) with the choice: the run's own saved step, else the seed it names, else a new start."""
    own = states.where("status = 'running'").groupBy(key).agg(F.max(F.struct("step", "handle")).alias("s"))
    held = specs.join(own, key, "left")
    choice = F.when(F.col("s").isNotNull(), "own").when(F.col("resume_from").isNotNull(), "seed").otherwise("new")
    return held.select(key, choice.alias("choice"), F.when(F.col("s").isNotNull(), F.col("s.step")).otherwise(0).alias("from_step"), F.coalesce("s.handle", "resume_from").alias("handle"))


def nested_not_finite(metrics: Column) -> Column:
    """The sorted dotted names of values that are NaN or infinite in a map of maps."""
    bad = F.flatten(F.transform(F.map_entries(metrics), lambda e: F.transform(not_finite_keys(e["value"]), lambda k: F.concat(e["key"], F.lit("."), k))))
    return F.array_sort(bad)


def decider_violation(df: DataFrame, by: str, fires: Column) -> DataFrame:
    """(by, n, violation): deciders that fire on all rows or on none."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(fires).alias("__f"))
    return out.select(by, "n", F.when(F.col("__f") == F.col("n"), "fires on all").when(F.col("__f") == 0, "abstains on all").alias("violation"))
