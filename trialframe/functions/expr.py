"""Column helpers: safe ratios, finite checks, reproducible keys, digests, array arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def valid_cost(c: Column) -> Column:
    """The cost if it is finite and not negative, else null."""
    return F.when(finite(c) & (c >= 0), c)


def money(c: Column) -> Column:
    """Exact sums need decimals; calls can cost millionths."""
    return c.cast("decimal(38,12)")


def seeded_key(*parts: Column | str | int) -> Column:
    """A reproducible pseudo-random text that orders rows: md5 of the parts."""
    cols = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols).cast("binary"))


def seeded_number(*parts: Column | str | int) -> Column:
    """A reproducible number below 2**32 from the parts."""
    return F.conv(F.substring(seeded_key(*parts), 1, 8), 16, 10).cast("long")


def text_digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def order_free_digest(digests: Column, length: int = 16) -> Column:
    """An aggregate over row digests that does not depend on their order; repeated rows count."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(digests)), "").cast("binary"), 256), 1, length)


def framed_key(*parts: Column) -> Column:
    """A key of typed parts whose bounds cannot be confused: type, length and value of each, hashed."""
    framed = [F.concat(F.typeof(p), F.lit(":"), F.length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit("")), F.lit(";")) for p in parts]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def dot(a: Column, b: Column) -> Column:
    """The scalar product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def words(c: Column) -> Column:
    """Distinct case-folded words between Unicode white space."""
    return F.array_distinct(F.filter(F.split(F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ"), "(?U)[\\s\\x1c-\\x1f]+"), lambda w: w != ""))


def word_hashes(c: Column) -> Column:
    """The words as 64-bit numbers: a few bytes each to shuffle and compare, equal for equal words."""
    return F.array_distinct(F.transform(words(c), lambda w: F.xxhash64(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(safe_div(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def prefix_masked(n: Column, cut: Column, weight: float = 1.0) -> Column:
    """Weights of n tokens: 0 for the first cut, weight after."""
    return F.concat(F.array_repeat(F.lit(0.0), cut), F.array_repeat(F.lit(weight), n - cut))


def verdict(metric: Column, incumbent: Column, direction: str = "max", floor: float = 0.0) -> Column:
    """crash without a metric, keep without an incumbent or on a strict improvement beyond floor, else discard."""
    gain = (metric - incumbent) if direction == "max" else (incumbent - metric)
    return F.when(metric.isNull(), "crash").when(incumbent.isNull() | (gain > floor), "keep").otherwise("discard")


def uplift(candidate: Column, baseline: Column, direction: str = "max", floor: float = 1e-3) -> Column:
    """The signed relative gain over a baseline."""
    delta = (candidate - baseline) if direction == "max" else (baseline - candidate)
    return delta / F.greatest(F.abs(baseline), F.lit(floor))


def retry_delay(attempt: Column, base: float = 0.5, cap: float = 30.0, jitter: Column | None = None, retry_after: Column | None = None) -> Column:
    """Capped exponential wait in seconds, cut to between its half and its whole by jitter from 0 to 1; what a server
    says in whole seconds goes before."""
    wait = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
    wait = wait if jitter is None else wait * (F.lit(0.5) + jitter / 2)
    return wait if retry_after is None else F.when(retry_after.rlike("^[0-9]+\\z"), retry_after.try_cast("double")).otherwise(wait)


def finite_metric(text: Column, key: str) -> Column:
    """The finite number under key of a JSON object, else null: other types, words that look like numbers and NaN are none."""
    value = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant")
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\\z")
    d = F.when(number, F.try_variant_get(F.try_parse_json(text), f"$.{key}", "double"))
    return F.when(finite(d), d)


def spend_cap(max_usd: Column, default: float) -> Column:
    """The cap that binds a run: its own, 0 too, else the default."""
    return F.coalesce(max_usd.cast("double"), F.lit(float(default)))


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(c) / 4)
