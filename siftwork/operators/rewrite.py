"""Bulk moves and namespace renames as a plan: validation, new contents, totals.

Contents are BINARY and are read one character per byte, so bytes that are no text survive.
The moves are a table of any size. The namespace mapping is a dict for all files, or a table
(repo, namespaces MAP) with one mapping per repository; both come from map files.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import paths
from siftwork.functions import text as tx
from siftwork.operators.diagnostics import BYTES_BOM

# Files a rename looks into, file-name endings it leaves alone, valid keys.
NAMESPACE_EXTENSIONS = (
    ".cs", ".razor", ".cshtml", ".csproj", ".props", ".targets", ".xaml", ".resx", ".config", ".json", ".xml",
)
FILE_ENDINGS = "csproj|sln|slnx|dll|exe|pdb|props|targets|json|xml|config|nupkg"
NAMESPACE_KEY = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"

# A dotted name where a key may begin.
_DOTTED = r"(?<![A-Za-z0-9_./\\])[A-Za-z_][A-Za-z0-9_.]*"

BAD_NAME = "not an ASCII dotted identifier"

# Not bytes, so they cannot occur in text read one character per byte.
_OPEN, _CLOSE = "\ue000", "\ue001"


# --- map files ------------------------------------------------------------------------------

_MAP_SCHEMA = "moves array<struct<`from`: string, `to`: string>>, namespaces map<string, string>, _bad string"


def read_move_maps(maps: DataFrame) -> DataFrame:
    """(repo, moves, namespaces, status) from (repo, body JSON); a broken map is a row, not a failure."""
    parsed = F.from_json(tx.without_bom(F.col("body")), _MAP_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    read = maps.select("repo", parsed.alias("_m"), tx.is_json_object(F.col("body")).alias("_sound"))
    whole = F.col("_m").isNotNull() & F.col("_m._bad").isNull()
    incomplete = F.exists("_m.moves", lambda m: m["from"].isNull() | m["to"].isNull())
    usable = whole & F.col("_sound") & ~F.coalesce(incomplete, F.lit(False))
    return read.select(
        "repo",
        F.when(usable, F.coalesce("_m.moves", F.array())).alias("moves"),
        F.when(usable, F.coalesce("_m.namespaces", F.create_map().cast("map<string,string>"))).alias("namespaces"),
        F.when(usable, "ok").otherwise("cannot read map").alias("status"),
    )


def map_moves(maps: DataFrame) -> DataFrame:
    """(repo, src, dst) of the moves in read maps, paths folded."""
    rows = maps.select("repo", F.explode("moves").alias("_m"))
    return rows.select("repo", paths.normalize(F.col("_m.from")).alias("src"), paths.normalize(F.col("_m.to")).alias("dst"))


# --- validation -----------------------------------------------------------------------------


def validate_moves(
    moves: DataFrame, files: DataFrame, namespaces: Mapping[str, str] | DataFrame | None = None
) -> DataFrame:
    """Everything wrong with the instructions: (repo, error, subject, n). Apply only if empty.

    moves are (repo, src, dst), files (repo, path).
    """
    present = files.select("repo", "path")
    one = F.lit(1).cast("bigint")

    def errors(rows: DataFrame, text: str, subject: str, n: Column = one) -> DataFrame:
        return rows.select("repo", F.lit(text).alias("error"), F.col(subject).alias("subject"), n.alias("n"))

    # Files meet the (usually few) moves first, so that what is left of them is no larger.
    sources = moves.select("repo", F.col("src").alias("path")).distinct()
    there = present.join(sources, ["repo", "path"]).select("repo", F.col("path").alias("src")).distinct()
    missing = moves.join(there, ["repo", "src"], "left_anti")
    folders = paths.segments(F.col("path"))
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(folders)), lambda depth: F.array_join(F.slice(folders, F.lit(1), depth), "/")
    )
    # A target may clash with a file or with a folder that files lie in.
    targets = moves.select("repo", "dst").distinct()
    taken = present.select("repo", F.explode(ancestors).alias("dst")).join(targets, ["repo", "dst"]).distinct()
    existing = moves.join(taken, ["repo", "dst"], "left_semi")
    repeated = moves.groupBy("repo", "src").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    shared = moves.groupBy("repo", "dst").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    chained = moves.join(sources.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi")
    found = (
        errors(missing, "source missing", "src")
        .unionByName(errors(existing, "target already exists", "dst"))
        .unionByName(errors(repeated, "two moves share the source", "src", F.col("n")))
        .unionByName(errors(shared, "two moves share the target", "dst", F.col("n")))
        .unionByName(errors(chained, "target is also a source (chained move)", "dst"))
    )
    if isinstance(namespaces, DataFrame):
        entries = namespaces.select("repo", F.explode("namespaces").alias("old", "new"))
        names = entries.select("repo", F.explode(F.array("old", "new")).alias("name"))
        wrong = names.filter(~F.col("name").rlike(f"^(?:{NAMESPACE_KEY})\\z"))
        return found.unionByName(errors(wrong, BAD_NAME, "name"))
    bad = [v for pair in (namespaces or {}).items() for v in pair if not re.fullmatch(NAMESPACE_KEY, v)]
    if bad:
        rows = [(None, BAD_NAME, v, 1) for v in bad]
        spark = moves.sparkSession
        found = found.unionByName(spark.createDataFrame(rows, "repo string, error string, subject string, n bigint"))
    return found


def applicable(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """The rows (moves, files, maps) of repositories without any error of `validate_moves`.

    An error without a repository, a bad name in a mapping for all of them, leaves nothing.
    """
    faulty = errors.select("repo").distinct()
    sound = rows.join(faulty.filter("repo is not null"), "repo", "left_anti")
    return sound.where(~faulty.filter("repo is null").exists())


# --- namespaces -----------------------------------------------------------------------------


def rename_namespaces(text: Column, namespaces: Mapping[str, str] | Column) -> Column:
    """STRUCT(text, replacements): all keys replaced at once, longest first, whole prefixes only.

    `namespaces` is one mapping for all rows or a MAP column, of few keys: every place of a text is
    tried against each. For many keys use `rename_by_table`.

    `A.B` fits `A.B` and `A.B.C`, but not `A.BC`, `X.A.B`, a path segment, a file name or
    anything in an AssemblyName element. One pass marks the hits, the marks are then looked up,
    so a replacement is never replaced again.
    """
    lead = r"((?i:<AssemblyName>[^<]*</AssemblyName>))|(?<![A-Za-z0-9_./\\])("
    end = rf")(?![A-Za-z0-9_/\\])(?!\.(?:{FILE_ENDINGS})(?![A-Za-z0-9_]))"
    if isinstance(namespaces, Column):
        table = namespaces
        longest_first = F.array_sort(F.map_keys(table), lambda a, b: F.length(b) - F.length(a))
        # Quoted for Java; the mark that ends a quote may stand in a key.
        quoted = lambda k: F.concat(F.lit(r"\Q"), F.replace(k, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        keys = F.array_join(F.transform(longest_first, quoted), "|")
        pattern, any_key = F.concat(F.lit(lead), keys, F.lit(end)), F.size(table) > 0
    elif namespaces:
        table = F.create_map(*[F.lit(x) for pair in namespaces.items() for x in pair])
        keys = "|".join(re.escape(k) for k in sorted(namespaces, key=len, reverse=True))
        pattern, any_key = F.lit(lead + keys + end), F.lit(True)
    else:
        return F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("replacements"))
    marked = F.when(any_key, F.regexp_replace(text, pattern, F.lit(f"$1{_OPEN}$2{_CLOSE}"))).otherwise(text)

    def resolved(piece: Column) -> Column:
        # "key CLOSE rest"; an empty key follows an untouched element.
        key = F.substring_index(piece, _CLOSE, 1)
        rest = F.substring(piece, F.length(key) + 2, F.length(piece))
        return F.concat(F.coalesce(F.try_element_at(table, key), F.lit("")), rest)

    def rebuild(pieces: Column) -> Column:
        head, hits = pieces[0], F.slice(pieces, F.lit(2), F.size(pieces))
        named = F.filter(hits, lambda piece: ~piece.startswith(_CLOSE))
        return F.struct(
            F.concat(head, F.array_join(F.transform(hits, resolved), "")).alias("text"),
            F.size(named).cast("bigint").alias("replacements"),
        )

    return tx.bind(F.split(marked, _OPEN), rebuild)


def _prefixes(text: Column) -> Column:
    """What a key could be in this text: every dotted name that nothing precedes, cut after each of its parts."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(_DOTTED), F.lit(0)))

    def cuts(name: Column) -> Column:
        parts = F.split(name, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))

    return F.array_distinct(F.flatten(F.transform(names, cuts)))


def rename_by_table(files: DataFrame, names: DataFrame, keys: Sequence[str] = ("repo", "path"), text: str = "text") -> DataFrame:
    """`files` with `renamed`, the STRUCT(text, replacements) of `rename_namespaces`, by a table of any size.

    `names` are (repo, old, new); of repeated keys the least `new` counts, and a key that is no dotted
    identifier fits nothing. A text is cut once into the names it holds, and their prefixes are
    looked up by a join: the time grows with the texts, not with texts times keys. Each text then
    replaces the keys that it holds, longest first.
    """
    sound = names.filter(F.col("old").rlike(f"^(?:{NAMESPACE_KEY})\\z")).groupBy("repo", "old").agg(F.min("new").alias("new"))
    held = files.select(*keys, F.explode(_prefixes(F.col(text))).alias("old")).distinct().join(sound.hint("merge"), ["repo", "old"])
    # No more entries than the text has names.
    own = held.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_names"))
    none = F.create_map().cast("map<string,string>")
    joined = files.join(own.hint("merge"), list(keys), "left").withColumn("_names", F.coalesce("_names", none))
    return joined.withColumn("renamed", rename_namespaces(F.col(text), F.col("_names"))).drop("_names")


# --- path headers ---------------------------------------------------------------------------


def _parts(path: Column) -> Column:
    return F.filter(paths.segments(path), lambda s: ~s.isin("", "."))


def _lowered(parts: Column) -> Column:
    return F.transform(parts, F.lower)


def update_header(text: Column, old_path: Column, new_path: Column, root: str = "") -> Column:
    """STRUCT(text, changed): a first line `// <path>` that names the tail of the old path is
    pointed at the new path, with the same base folder and slash style.

    Paths are relative to the repository; `root` is the repository's own place, whose folders a
    header may name too.
    """
    head = F.substring_index(text, "\n", 1)
    first = F.when(F.length(head) < F.length(text), F.concat(head, F.lit("\n"))).otherwise(head)
    pattern = rf"^((?:{BYTES_BOM})?[ \t]*//[ \t]*)([^\r\n]*?)[ \t]*(?:\r?\n|\z)"
    lead, header = F.regexp_extract(first, pattern, 1), F.regexp_extract(first, pattern, 2)
    place = F.lit(root.rstrip("/\\") + "/" if root else "")
    facts = F.struct(
        lead.alias("lead"), header.alias("header"), _parts(header).alias("named"),
        _parts(F.concat(place, old_path)).alias("old"), _parts(F.concat(place, new_path)).alias("new"),
        _parts(new_path).alias("new_inside"),
    )

    def rewritten(f: Column) -> Column:
        count = F.size(f["named"])
        base_size = F.size(f["old"]) - count
        fits = (
            (count > 0)
            & (base_size >= 0)
            & f["header"].rlike(r"^[\x00-\x7f]*\z")
            & (_lowered(F.slice(f["old"], F.greatest(base_size, F.lit(0)) + 1, count)) == _lowered(f["named"]))
        )
        safe_base = F.greatest(base_size, F.lit(0))
        same_base = _lowered(F.slice(f["new"], F.lit(1), safe_base)) == _lowered(F.slice(f["old"], F.lit(1), safe_base))
        target = F.when(same_base, F.slice(f["new"], safe_base + 1, F.size(f["new"]))).otherwise(f["new_inside"])
        slash = F.when(F.contains(f["header"], F.lit("\\")), F.array_join(target, "\\")).otherwise(
            F.array_join(target, "/")
        )
        rest = F.substring(text, F.length(f["lead"]) + F.length(f["header"]) + 1, F.length(text))
        writable = fits & slash.rlike(r"^[\x00-\x7f]*\z")
        return F.struct(
            F.when(writable, F.concat(f["lead"], slash, rest)).otherwise(text).alias("text"),
            F.coalesce(writable, F.lit(False)).alias("changed"),
        )

    return tx.bind(facts, rewritten)


# --- plan -----------------------------------------------------------------------------------


def rewrite_plan(
    files: DataFrame,
    moves: DataFrame,
    namespaces: Mapping[str, str] | DataFrame,
    map_path: str | None = None,
    root: str = "",
) -> DataFrame:
    """What a move-and-rename would do, per changed or unreadable file:
    (repo, src, dst, content BINARY, replacements, header_updated, unreadable).

    UTF-16 and binary files may move but are not rewritten; the map file itself is left alone.
    Pass what `applicable` leaves; unchecked moves that repeat a source use the least target.
    """
    path = F.col("path")
    targets = moves.groupBy("repo", F.col("src").alias("path")).agg(F.min("dst").alias("_to"))
    candidate = F.lower(paths.extension(path)).isin(*NAMESPACE_EXTENSIONS) & ~paths.in_any_folder(
        path, paths.PROJECT_TREE_EXCLUDES
    )
    if map_path is not None:
        candidate = candidate & (path != map_path)
    moved = F.col("_to").isNotNull() & (F.col("_to") != path)
    named = files.join(targets, ["repo", "path"], "left").filter(candidate | F.col("_to").isNotNull())
    texts = named.select(
        "repo", "path", F.coalesce("_to", path).alias("dst"), moved.alias("moved"), F.decode("content", "ISO-8859-1").alias("text")
    )
    text = F.col("text")
    unreadable = text.rlike("^(?:\xff\xfe|\xfe\xff)") | F.contains(text, F.lit("\x00"))
    judged = texts.withColumn("unreadable", unreadable)
    headed = judged.withColumn(
        "_h",
        F.when(F.col("moved") & ~F.col("unreadable"), update_header(text, path, F.col("dst"), root)).otherwise(
            F.struct(text.alias("text"), F.lit(False).alias("changed"))
        ),
    )
    if isinstance(namespaces, DataFrame):
        names = namespaces.select("repo", F.explode("namespaces").alias("old", "new"))
        named_once = rename_by_table(headed.withColumn("_text", F.when(~F.col("unreadable"), F.col("_h.text"))), names, text="_text")
        new = F.col("renamed")
    else:
        named_once, new = headed, rename_namespaces(F.col("_h.text"), namespaces)
    renamed = named_once.withColumn(
        "_r", F.when(~F.col("unreadable"), new).otherwise(F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("replacements")))
    )
    changed = F.col("moved") | F.col("unreadable") | (F.col("_r.text") != text)
    return renamed.filter(changed).select(
        "repo",
        path.alias("src"),
        "dst",
        F.encode(F.col("_r.text"), "ISO-8859-1").alias("content"),
        F.col("_r.replacements").alias("replacements"),
        F.col("_h.changed").alias("header_updated"),
        "unreadable",
    )


def rewrite_summary(plan: DataFrame) -> DataFrame:
    """Per repository: (repo, files_with_replacements, replacements, moves, headers, unreadable)."""
    count_if = lambda condition: F.count(F.when(condition, 1))
    return plan.groupBy("repo").agg(
        count_if(F.col("replacements") > 0).alias("files_with_replacements"),
        F.sum("replacements").alias("replacements"),
        count_if(F.col("src") != F.col("dst")).alias("moves"),
        count_if(F.col("header_updated")).alias("headers"),
        count_if(F.col("unreadable")).alias("unreadable"),
    )


def replaced_files(plan: DataFrame) -> DataFrame:
    """Files with replacements: (repo, path, replacements)."""
    return plan.filter("replacements > 0").select("repo", F.col("dst").alias("path"), "replacements")
