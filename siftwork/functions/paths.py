"""Path expressions: folding, names, extensions, folder exclusion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders a scan does not enter.
SOURCE_TREE_EXCLUDES = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", "bin", "obj",
)
PROJECT_TREE_EXCLUDES = (".git", "node_modules", "bin", "obj", ".vs", "packages", "TestResults")


def segments(path: Column) -> Column:
    return F.split(path, r"[/\\]")


def base_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def folder(path: Column) -> Column:
    """Everything before the last separator, `""` at the root."""
    parts = segments(path)
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def extension(path: Column) -> Column:
    """`.ext` of the file name as written, `""` without one; a leading dot starts no extension."""
    return F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def normalize(path: Column) -> Column:
    """Forward slashes, `.` and `..` folded; a leading slash and leading `..` of relative paths stay."""
    absolute = path.rlike(r"^[/\\]")

    def fold(done: Column, part: Column) -> Column:
        can_leave = (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("..")) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & can_leave, F.slice(done, F.lit(1), F.size(done) - 1))
            .when((part == "..") & absolute, done)
            .otherwise(F.array_append(done, part))
        )

    folded = F.array_join(F.aggregate(segments(path), F.array().cast("array<string>"), fold), "/")
    # Most paths are folded already; one search is cheaper than taking them apart.
    foldable = path.rlike(r"\\|//|/\z|(?:^|/)\.{1,2}(?:/|\z)")
    return F.when(~foldable, path).when(absolute, F.concat(F.lit("/"), folded)).otherwise(folded)


def in_any_folder(path: Column, names: Iterable[str]) -> Column:
    """True when a folder on the way to the file (not the file itself) has one of the names."""
    parts = segments(path)
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(n) for n in names]))


def in_hidden_folder(path: Column) -> Column:
    return path.rlike(r"(?:^|[/\\])\.[^/\\]*[/\\]")


def uri_to_path(uri: Column) -> Column:
    """A file URI (or percent-encoded path) as a path; malformed escapes stay as written."""

    def unquote(col: Column) -> Column:
        literal_percent = F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25")
        return F.url_decode(F.replace(literal_percent, F.lit("+"), F.lit("%2B")))

    file_part = F.regexp_extract(uri, r"(?i)^file:(?://[^/?#]*)?([^?#]*)", 1)
    return (
        F.when(uri.rlike("(?i)^file:"), unquote(unquote(file_part)))
        .when(F.contains(uri, F.lit("%")), unquote(uri))
        .otherwise(uri)
    )
