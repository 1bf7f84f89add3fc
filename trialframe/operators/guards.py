"""Guards before spend: predicates on paths, specs, journals and reports, as columns with a reason or as refusals."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.expr import finite

#: The mode of a symbolic link, and files that run by lying on the search path.
SYMLINK_MODE = "120000"
AUTOLOADERS = ("sitecustomize.py", "usercustomize.py", "conftest.py", "__init__.py")
#: Fixed value: the share of the wall clock from which a budget is low.
LOW_WALL_FRACTION = 0.75


class Refused(ValueError):
    """A guard did not let the rows through."""


def glob_pattern(glob: str) -> str:
    """A regular expression for whole paths: `**` stands for any number of segments, `*` and `?` stay within one."""
    segments = [s for s in glob.split("/") if s not in ("", ".")]
    out = "/" if glob.startswith("/") else ""
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in s)
            out += body + ("" if last else "/")
    return f"^{out}$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def immutable_violations(changes: DataFrame, path: str, mode: str, mutable: Sequence[str], immutable: Sequence[str]) -> DataFrame:
    """changes that break the scoring boundary, with the reason: links, immutable or undeclared paths, auto-loaders."""
    p, name = F.col(path), F.element_at(F.split(path, "/"), -1)
    loader = name.isin(*AUTOLOADERS) | F.endswith(name, F.lit(".pth"))
    reason = (
        F.when(F.col(mode) == SYMLINK_MODE, "symlink").when(matches_any(p, immutable), "immutable")
        .when(~matches_any(p, mutable), "outside").when(loader, "auto-loader")
    )
    return changes.withColumn("reason", reason).where("reason is not null")


def escapes_workdir(path: Column) -> Column:
    """True for empty and absolute paths and those that climb."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return (F.size(parts) == 0) | F.startswith(path, F.lit("/")) | F.array_contains(parts, "..")


def unbounded_glob(glob: Column) -> Column:
    """True where the first segment is a bare wildcard."""
    parts = F.filter(F.split(glob, "/"), lambda s: (s != "") & (s != "."))
    return F.coalesce(F.get(parts, 0).isin("*", "**") & ~F.startswith(glob, F.lit("/")), F.lit(False))


def positive_int(number: Column) -> Column:
    """True for whole numbers above zero; null, NaN and infinity are none."""
    d = number.cast("double")
    return F.coalesce(finite(d) & (d == F.floor(d)) & (d > 0), F.lit(False))


def unknown_fields(fields: Column, declared: Sequence[str]) -> Column:
    """The sorted names of an array that are not declared."""
    return F.array_sort(F.array_except(fields, F.array(*map(F.lit, declared))))


def budget_low(unit: Column, elapsed: Column, max_units: Column, max_wall_s: Column) -> Column:
    """True where one unit or none is left, or where most of the wall clock, if it has a bound, is gone."""
    return (max_units - unit <= 1) | F.coalesce(elapsed >= LOW_WALL_FRACTION * max_wall_s, F.lit(False))


def _descendants(kind: type) -> list[str]:
    found = {kind.__name__}
    for k in kind.__subclasses__():
        found.update(_descendants(k))
    return sorted(found)


def failure_class(exception: Column, infra: Sequence[str] = ("InfraFailure", "CalledProcessError")) -> Column:
    """accounting, infra or candidate, by the name of an exception's type; system errors of all kinds are infra."""
    machine = [*infra, *_descendants(OSError), "IOError", "EnvironmentError"]
    return F.when(exception == "AccountingIntegrityError", "accounting").when(exception.isin(*machine), "infra").otherwise("candidate")


def poisoned_rows(journal: DataFrame, unit: str, metric: str, usd: str) -> DataFrame:
    """(…, poison): journal rows that cannot be trusted: a metric that is not finite, or no valid cost."""
    bad_metric = F.col(metric).isNotNull() & ~finite(F.col(metric))
    reason = F.when(bad_metric, "non-finite metric").when(F.col(usd).isNull(), "missing usd").when(~finite(F.col(usd)) | (F.col(usd) < 0), "invalid usd")
    return journal.withColumn("poison", reason).where("poison is not null")


def agreement_refusal(n: Column, agree: Column, panel_labels: Column, gate_n: Column, floor: Column) -> Column:
    """Why a report does not clear its gate, else null: other rows, one label for everything, too few agreements."""
    return F.when(n != gate_n, "partial").when(panel_labels == 1, "constant decider").when(agree < floor, "below floor")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has; none if both have the same set."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def require_none(violations: DataFrame, what: str) -> None:
    """Raises with the first rows if there are any."""
    rows = violations.limit(5).collect()
    if rows:
        raise Refused(f"{what}: {[r.asDict() for r in rows]}")


def violation_counts(rows: DataFrame, checks: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(name, violations) of every check, for a report in place of a refusal."""
    out = None
    for name, check in checks:
        one = check(rows).agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def blocking_invariants(rows: DataFrame, checks: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> None:
    """Runs checks, each from rows to their violations, in order; the first with any raises."""
    for name, check in checks:
        require_none(check(rows), name)
