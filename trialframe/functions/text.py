"""Text functions: Markdown to plain text, sanitised history lines, pattern checks, decoding of tagged values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_emphasis(c: Column) -> Column:
    """Without bold, italic and code marks, innermost text kept."""
    for mark in ("\\*\\*(.+?)\\*\\*", "__(.+?)__", "\\*(.+?)\\*", "_(.+?)_", "`(.+?)`"):
        c = F.regexp_replace(c, mark, "$1")
    return c


_SPACES = "[\\s\\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
_EDGES = f"^{_SPACES}|{_SPACES}$"
_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def stripped(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, _EDGES, "")


def folded(c: Column) -> Column:
    """Case folded: lower case, `ß` as `ss` and the final sigma as any other."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def normalized(c: Column) -> Column:
    """Words between single spaces, case folded."""
    return folded(F.trim(F.regexp_replace(c, _SPACES, " ")))


def strip_table_row(c: Column) -> Column:
    """The cells of a row between spaces, marks stripped over the whole; a row of separators is empty."""
    cells = F.filter(F.transform(F.split(c, "\\|"), stripped), lambda x: x != "")
    ruled = F.forall(cells, lambda x: x.rlike("^:?-+:?$"))
    return F.when(ruled, "").otherwise(strip_emphasis(F.array_join(cells, " ")))


def strip_line(c: Column) -> Column:
    """One line without white space at its ends: a table row by its cells, others without heading and marks."""
    return F.when(F.contains(c, F.lit("|")), strip_table_row(c)).otherwise(strip_emphasis(F.regexp_replace(c, "^#{1,6}\\s+", "")))


def strip_markdown(c: Column) -> Column:
    """Plain text: fenced lines as they are, others stripped, blank ones dropped.

    Fence lines cut the text into blocks that are outside and inside in turn, so no line has to know those before it.
    """
    lines = F.regexp_replace(c, _BREAKS, "\n")
    blocks = F.split(lines, "(?md)^[^\\S\n]*(?:```|~~~).*$")
    outside = lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: strip_line(stripped(x))), lambda x: x != "")
    inside = lambda b: F.filter(F.split(b, "\n"), lambda x: stripped(x) != "")
    return F.array_join(F.flatten(F.transform(blocks, lambda b, i: F.when(i % 2 == 0, outside(b)).otherwise(inside(b)))), "\n")


def sanitize_history(c: Column, limit: int = 240) -> Column:
    """One safe line: breaks shown, control characters blanked, backticks turned, capped with an ellipsis."""
    t = F.regexp_replace(c, "[\\r\\n\\u2028\\u2029]", "⏎")
    t = F.regexp_replace(t, "[\\p{Cc}\\p{Cf}]", " ")
    t = F.translate(t, "`", "'")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def family_of(c: Column, aliases: dict[str, str]) -> Column:
    """The one family that the letters-only tokens of a name point to, else null."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    found = F.array_distinct(F.filter(F.transform(F.split(F.lower(c), "[^a-z]+"), lambda w: known[w]), lambda x: x.isNotNull()))
    return F.when(F.size(found) == 1, found[0])


#: What a log says of the machine and not of the experiment.
INFRA_MARKERS = (
    "connection reset", "connection refused", "connection timed out", "network is unreachable", "no space left on device",
    "rate limit", "too many requests", "overloaded", "at capacity", "insufficient capacity", "temporarily unavailable",
    "service unavailable", "502 bad gateway", "503 service", "504 gateway timeout",
)


def infrastructure_failure(log: Column, markers: tuple[str, ...] = INFRA_MARKERS) -> Column:
    """True where a log holds any marker, without regard to case."""
    low = F.lower(log)
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m.lower()))
    return F.coalesce(out, F.lit(False))


def semantic_version(c: Column) -> Column:
    """Major, minor and patch of a full version text, comparable as a struct, else null."""
    pattern = "^(\\d+)\\.(\\d+)\\.(\\d+)"
    part = lambda k: F.regexp_extract(c, pattern, k).cast("int")
    return F.when(c.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def image_media_type(content: Column) -> Column:
    """The media type that the first bytes of an image tell, else null."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(h, F.lit("89504E470D0A1A0A")), "image/png")
        .when(F.startswith(h, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(h, F.lit("47494638")), "image/gif")
        .when(F.startswith(h, F.lit("52494646")) & F.endswith(h, F.lit("57454250")), "image/webp")
    )


def without_headers(headers: Column, names: tuple[str, ...]) -> Column:
    """An array of (name, value) without the named ones; order and repeats stay."""
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin([n.lower() for n in names]))


def env_pair(line: Column) -> Column:
    """Name and unquoted value of a NAME=VALUE line; null for comments and lines without a sign."""
    parts = F.split(line, "=", 2)
    value = F.regexp_replace(F.trim(parts[1]), "^(['\"])(.*)\\1$", "$2")
    return F.when(~F.startswith(F.trim(line), F.lit("#")) & (F.size(parts) == 2), F.struct(F.trim(parts[0]).alias("name"), value.alias("value")))


def after_fences(c: Column, fence: str = "==========") -> Column:
    """The lines between the first two fence lines, else the text."""
    lines = F.split(c, "\n")
    first = F.array_position(lines, fence)
    rest = F.slice(lines, first.cast("int") + 1, F.size(lines))
    second = F.array_position(rest, fence)
    return F.when((first > 0) & (second > 0), F.array_join(F.slice(rest, 1, second.cast("int") - 1), "\n")).otherwise(c)


def location(c: Column) -> Column:
    """(host, path) of a transfer target: `host:path` or `[v6]:path`; a colon after a slash is part of a local path."""
    v6 = "^([^\\]]*\\[[^\\]]*\\]|\\[[^\\]]*\\]):(.*)$"
    plain = "(?s)^([^:/]*):(.*)$"
    host = F.when(c.rlike(v6), F.regexp_extract(c, v6, 1)).when(c.rlike(plain), F.regexp_extract(c, plain, 1))
    path = F.when(c.rlike(v6), F.regexp_extract(c, v6, 2)).when(c.rlike(plain), F.regexp_extract(c, plain, 2)).otherwise(c)
    return F.struct(host.alias("host"), path.alias("path"))


#: The forms of names, labels, digests and versions, each for the whole text.
FORMS = {"name": "^[A-Za-z0-9._-]+$", "label": "^[A-Za-z0-9][A-Za-z0-9.-]*$", "digest": "^[0-9a-f]{32}$", "version": "^v[0-9]{3,}-[0-9]{8}-[0-9a-f]{12}$"}


def has_form(c: Column, form: str) -> Column:
    return F.coalesce(c.rlike(FORMS[form].replace("$", "\\z")), F.lit(False))


def shown_number(c: Column) -> Column:
    """A number as text: the fewest digits that name it, plain from 0.0001 to below 10**16, with an exponent beyond; whole
    ones of a double end in .0."""
    d = c.cast("double")
    size, tries = F.abs(d), [F.format_string(f"%.{n}e", d) for n in (14, 15, 16)]
    short = F.coalesce(*[F.when(t.try_cast("double") == d, t) for t in tries], tries[-1])
    plain = F.regexp_replace(F.regexp_replace(short.try_cast("decimal(38,20)").cast("string"), "0+$", ""), "\\.$", ".0")
    odd = F.when(F.isnan(d), "nan").when(size == float("inf"), F.when(d > 0, "inf").otherwise("-inf")).when(size == 0, c.cast("string"))
    shown = F.coalesce(odd, F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.regexp_replace(short, "\\.?0*e", "e")))
    return F.when(c.isNull(), None).when(F.typeof(c).isin("double", "float"), shown).otherwise(c.cast("string"))


def history_line(unit: Column, verdict: Column, metric: Column, description: Column) -> Column:
    """One sanitised line of an experiment's history; a unit without a metric is unscored. The form is fixed."""
    shown = F.coalesce(shown_number(metric), F.lit("unscored"))
    return sanitize_history(F.concat(F.lit("unit "), unit.cast("string"), F.lit(" ["), verdict, F.lit("] metric="), shown, F.lit(" — "), F.coalesce(description, F.lit(""))))


def bullets(globs: Column) -> Column:
    """A list of patterns as lines of Markdown."""
    return F.array_join(F.transform(globs, lambda g: F.concat(F.lit("- `"), g, F.lit("`"))), "\n")


#: The head of a history and the names of its three scores.
HISTORY_HEAD = "## History\nPrior attempts, oldest first. A `discard` line lost to the incumbent — learn from it, do not repeat it."
HISTORY_SCORES = ("baseline (untouched tree)", "incumbent", "best kept")


def render_history(baseline: Column, incumbent: Column, best: Column, lines: Column) -> Column:
    """The history that a prompt shows: what the tree, the incumbent and the best kept unit score, then the lines."""
    values = (F.coalesce(shown_number(baseline), F.lit("unscored")), F.coalesce(shown_number(incumbent), F.lit("unscored")), F.coalesce(shown_number(best), F.lit("none")))
    scores = [F.concat(F.lit(f"- {name}: "), v) for name, v in zip(HISTORY_SCORES, values, strict=True)]
    return F.array_join(F.concat(F.array(F.lit(HISTORY_HEAD), *scores), lines), "\n")


def merged_readings(readings: Column, instruction: str) -> Column:
    """A prompt that numbers several readings of one page from 1."""
    parts = F.transform(readings, lambda x, i: F.concat(F.lit("--- Reading "), (i + 1).cast("string"), F.lit(" ---\n"), x))
    return F.array_join(F.concat(F.array(F.lit(instruction)), parts), "\n\n")


#: The fields of a saved training state by the back end that wrote it.
HANDLES = {"tinker": ("state_path",), "local": ("adapter_dir",), "modal": ("repo", "revision")}


def handle_json(backend: Column, first: Column, second: Column) -> Column:
    """A saved state as tagged JSON; an unknown tag raises."""
    out = F.raise_error(F.concat(F.lit("unknown state backend "), F.coalesce(backend, F.lit("null")))).cast("string")
    for tag, fields in HANDLES.items():
        values = [v.alias(f) for v, f in zip((first, second), fields, strict=False)]
        out = F.when(backend == tag, F.to_json(F.struct(F.lit(tag).alias("backend"), *values))).otherwise(out)
    return out


def read_handle(c: Column) -> Column:
    """(backend, first, second) of a saved state; an unknown tag raises."""
    tag = F.get_json_object(c, "$.backend")
    kind = "struct<backend:string,first:string,second:string>"
    out = F.raise_error(F.concat(F.lit("unknown state backend "), F.coalesce(tag, F.lit("null")))).cast(kind)
    for name, fields in HANDLES.items():
        held = [F.get_json_object(c, f"$.{f}") for f in fields] + [F.lit(None).cast("string")]
        out = F.when(tag == name, F.struct(tag.alias("backend"), held[0].alias("first"), held[1].alias("second"))).otherwise(out)
    return out


def same_family(judge: Column, generator: Column, aliases: dict[str, str]) -> Column:
    """Why a judge may not grade a generator, else null: of one family, or of a family that is not known."""
    theirs = family_of(generator, aliases)
    return F.when(theirs.isNull(), "unknown family").when(judge == theirs, "same family")
