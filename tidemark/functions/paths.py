"""Path identity, prefixes and ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A segment of one or two dots.
_DOTS = r"(?:^|/)\.{1,2}(?:/|$)"


def clean_path(path: Column | str, lower: bool = False) -> Column:
    """Lexically cleaned path: one slash for several, ``.`` dropped, ``..`` resolved, none at the end.

    ``..`` at a root is dropped, before a relative start it stays; an empty path becomes ``.``; null stays null.
    Clean paths, nearly all of them, pass plain string tests and are not taken apart; a regular expression sees those with a dotted name only.
    """
    p = F.col(path) if isinstance(path, str) else path
    rooted = p.startswith("/")
    last = lambda a: F.element_at(a, -1)

    def step(acc: Column, part: Column) -> Column:
        up = (
            F.when((F.size(acc) > 0) & (last(F.when(F.size(acc) > 0, acc).otherwise(F.array(F.lit("")))) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc) > 0, F.concat(F.when(rooted, "/").otherwise(""), F.array_join(acc, "/"))).when(rooted, "/").otherwise(".")

    folded = F.aggregate(F.split(p, "/", -1), F.expr("CAST(array() AS ARRAY<STRING>)"), step, finish)
    unclean = p.contains("//") | (p.endswith("/") & (p != "/")) | ((p.contains("/.") | p.startswith(".")) & p.rlike(_DOTS))
    cleaned = F.when(unclean, folded).when(p == "", ".").otherwise(p)
    return F.lower(cleaned) if lower else cleaned


def under_prefix(path: Column, prefix: str | None) -> Column:
    """Separator-aware prefix test: the path itself or a descendant; a separator at the end means descendants only.

    The prefix is taken literally. None or empty matches everything. Null paths give null.
    """
    if not prefix:
        return F.lit(True)
    if prefix[-1] in "/\\":
        return path.startswith(prefix)
    return (path == prefix) | path.startswith(prefix + "/") | path.startswith(prefix + "\\")


def strictly_below(path: Column, directory: Column) -> Column:
    """True for strict descendants of a directory; the directory itself and look-alike siblings are outside."""
    return path.startswith(F.concat(directory, F.lit("/")))


def relative_to(path: Column, directory: Column) -> Column:
    """What follows ``directory/`` in ``path``; null unless strictly below."""
    return F.when(strictly_below(path, directory), F.substr(path, F.length(directory) + 2))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, of the last segment; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def ancestors(path: Column, include_self: bool = False) -> Column:
    """All ancestor directories of a rooted path, the root left out; for equi joins instead of prefix joins."""
    parts = F.split(path, "/")
    count = F.size(parts) - (0 if include_self else 1)
    return F.when(count >= 2, F.transform(F.sequence(F.lit(2), F.greatest(count, F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def redact(path: Column) -> Column:
    """``sha256:<hex><ext>``; the extension is kept when at most 16 characters and not a bare dot file."""
    base = basename(path)
    ext = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    return F.concat(F.lit("sha256:"), F.sha2(path.cast("binary"), 256), F.when(F.length(ext) <= 16, ext).otherwise(F.lit("")))
