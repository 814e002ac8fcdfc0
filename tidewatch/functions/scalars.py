"""Column builders shared by the operators: hashes, keys, globs, readable numbers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the ladder of limits that people write, and the largest.
LADDER_STEPS = [1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 80]
LADDER_TOP = 1e12


def line_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a line."""
    return F.substring(F.sha2(text, 256), 1, 16)


def key_token(scope: Column, path: Column, longname: Column, parameters: Column, ordinal: Column | None = None) -> Column:
    """Opaque id of an entity: a JSON array; the ordinal stands only where it isn't 0."""
    four = F.to_json(F.array(scope, path, longname, parameters))
    if ordinal is None:
        return four
    return F.when(F.coalesce(ordinal, F.lit(0)) > 0, F.concat(F.regexp_replace(four, r"\]$", ","), ordinal.cast("string"), F.lit("]"))).otherwise(four)


def path_prefixes(path: Column) -> Column:
    """a/b/c -> [a, a/b, a/b/c]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(pattern: str) -> str:
    """A regex for a whole path or one of its directories: ** crosses borders, * and ? don't, a leading / anchors."""
    marks = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: marks.get(m[0]) or re.escape(m[0]), pattern.strip("/"))
    return ("^" if pattern.startswith("/") else "^(?:.*/)?") + body + "(?:/.*)?$"


def first_glob(path: Column, patterns: list[str]) -> Column:
    """The first pattern that covers the path or a directory above it, else null; empty patterns are skipped."""
    hits = [F.when(path.rlike(glob_regex(p)), F.lit(p)) for p in patterns if p]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def matches_any(subject: Column, regexes: list[str]) -> Column:
    """Whether any of the regexes is found anywhere."""
    return F.coalesce(subject.rlike("|".join(f"(?:{r})" for r in regexes)), F.lit(False)) if regexes else F.lit(False)


def breach(value: Column, most: Column, least: Column) -> Column:
    """'max' above the maximum, else 'min' below the minimum, else null; limits themselves are inside."""
    return F.when(value > most, "max").when(value < least, "min")


def shown(value: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"0+$", ""), r"\.$", "")


def ladder_at_least(value: Column) -> Column:
    """The smallest readable limit that is not below the value; null above the ladder's top."""
    power, rungs = 1.0, []
    while power <= LADDER_TOP:
        rungs += [s * power for s in LADDER_STEPS if s * power <= LADDER_TOP]
        power *= 10
    steps = F.array(*[F.lit(float(r)) for r in sorted(set(rungs))])
    return F.array_min(F.filter(steps, lambda s: s >= value))


def rungs_around(limit: Column) -> Column:
    """The rungs within two places of the limit, itself included; a limit between rungs has the ladder's first two. Each decade repeats the whole list of steps,
    and a limit's place is the first at which it stands."""
    decades = round(math.log10(LADDER_TOP)) + 1
    rungs = F.array(*[F.lit(float(s) * 10.0**k) for k in range(decades) for s in LADDER_STEPS])
    at = F.array_position(rungs, limit).cast("int")
    return F.when(at > 0, F.slice(rungs, F.greatest(at - 2, F.lit(1)), F.least(at, F.lit(3)) + 2)).otherwise(F.slice(rungs, F.lit(1), F.lit(2)))


def lines_per_statement(lines: Column, statements: Column) -> Column:
    return lines / F.nullif(statements, F.lit(0))


def non_stub_methods(methods: Column, automatic: Column) -> Column:
    return F.greatest(F.lit(0), methods - 2 * F.coalesce(automatic, F.lit(0)))


def count_params(parameters: Column) -> Column:
    """How many parameters are declared; none are 0."""
    return F.coalesce(F.size(parameters), F.lit(0))


def long_name(scope: Column, path: Column, name: Column) -> Column:
    """A file is named by its path, anything else by its qualified name."""
    return F.when(scope == "file", path).otherwise(name)


def root_checked(files: DataFrame, root: str) -> DataFrame:
    """One row (held: true) if some file (path) lies below the root, none for no files; a root that holds none of them is refused."""
    some = files.agg(F.bool_or(F.col("path").startswith(root)).alias("held")).where("held IS NOT NULL")
    return some.select(F.when(F.col("held"), F.col("held")).otherwise(F.raise_error(F.lit(f"no file below {root}"))).alias("held"))


def below_floor(metrics: Column, floor_metric: str, minimum: int) -> Column:
    """Known and below the minimum; unknown means judged."""
    value = F.element_at(metrics, floor_metric)
    return F.coalesce(value < minimum, F.lit(False))


def inside_root(path: Column, root: str) -> Column:
    """The path below root; anything else is an error."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("outside the root: "), path)))


def loose_number(text: Column) -> Column:
    """A number in either notation: commas group digits where a point is present, else a comma is the decimal mark."""
    plain = F.regexp_replace(F.trim(text), r"\s", "")
    return F.when(plain.contains("."), F.replace(plain, F.lit(","), F.lit(""))).otherwise(F.replace(plain, F.lit(","), F.lit("."))).try_cast("double")


def constructs(line: Column, known: list[tuple[str, str]]) -> Column:
    """The name of the first known construct whose regex is found in a source line."""
    return F.coalesce(*[F.when(line.rlike(rx), F.lit(name)) for name, rx in known])


def signed_line(statements: Column, lines: Column, routines: Column) -> Column:
    return F.format_string("net: %+d statements, %+d lines over %d routines", statements, lines, routines)
