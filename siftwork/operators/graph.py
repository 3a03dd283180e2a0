"""Project-reference graphs: edges, names, components, cycles, layers.

Nodes are (repo, path, name), edges (repo, src, dst, pos) between names; `pos` is the place of
the reference in its file. Iterative operators write each round to the shared folder, so a
lost executor costs one round and the plan never grows. Joins run against a side that is
unique per node, which lets adaptive execution split a hub's rows over many tasks.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import paths
from siftwork.functions import text as tx
from siftwork.sources.checkpoints import materialize, materialize_counting


# --- nodes and edges ------------------------------------------------------------------------


def project_files(files: DataFrame) -> DataFrame:
    path = F.col("path")
    is_project = F.lower(path).endswith(".csproj")
    return files.filter(is_project & ~paths.in_any_folder(path, paths.PROJECT_TREE_EXCLUDES))


def project_names(files: DataFrame) -> DataFrame:
    """(repo, path, name): the file stem, or the path where the stem repeats in the repository."""
    projects = project_files(files).select(
        "repo", paths.normalize(F.col("path")).alias("path"), paths.stem(F.col("path")).alias("_stem")
    )
    keyed = projects.withColumn("_key", F.lower("_stem"))
    repeated = keyed.groupBy("repo", "_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(repeated, ["repo", "_key"], "left").select(
        "repo", "path", F.when(F.col("_n").isNull(), F.col("_stem")).otherwise(F.col("path")).alias("name")
    )


def _references(files: DataFrame) -> DataFrame:
    """(repo, path, pos, target): reference paths folded against the project's folder."""
    pattern = f'(?iu)<ProjectReference{tx.SPACE}+[^>]*?Include{tx.SPACE}*={tx.SPACE}*"([^"]+)"'
    included = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    rows = project_files(files).select(
        "repo", paths.normalize(F.col("path")).alias("path"), F.posexplode(included).alias("pos", "_ref")
    )
    joined = F.when(F.col("_ref").rlike(r"^[/\\]"), F.col("_ref")).otherwise(
        F.concat(paths.folder(F.col("path")), F.lit("/"), F.col("_ref"))
    )
    at_root = paths.folder(F.col("path")) == ""
    target = paths.normalize(F.when(at_root, F.col("_ref")).otherwise(joined))
    return rows.select("repo", "path", F.col("pos").cast("bigint").alias("pos"), target.alias("target"))


def project_edges(files: DataFrame) -> DataFrame:
    """References between known projects, repeated ones once: (repo, src, dst, pos)."""
    names = project_names(files)
    sources = names.select("repo", "path", F.col("name").alias("src"))
    targets = names.select("repo", F.col("path").alias("target"), F.col("name").alias("dst"))
    resolved = _references(files).join(sources, ["repo", "path"]).join(targets, ["repo", "target"])
    return resolved.groupBy("repo", "src", "dst").agg(F.min("pos").alias("pos"))


def dangling_references(files: DataFrame) -> DataFrame:
    """References to projects that do not exist: (repo, src, target, pos)."""
    names = project_names(files)
    known = names.select("repo", F.col("path").alias("target"))
    missing = _references(files).join(known, ["repo", "target"], "left_anti")
    sources = names.select("repo", "path", F.col("name").alias("src"))
    return missing.join(sources, ["repo", "path"]).select("repo", "src", "target", "pos")


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every project with each of its targets: (repo, src, dst, targets); dst NULL for none.

    One row per reference, not one array per project: a hub's list has no bound.
    """
    counts = edges.groupBy("repo", "src").agg(F.count("*").alias("_n"))
    every = nodes.select("repo", F.col("name").alias("src")).join(counts, ["repo", "src"], "left")
    return every.join(edges.select("repo", "src", "dst"), ["repo", "src"], "left").select(
        "repo", "src", "dst", F.coalesce("_n", F.lit(0)).alias("targets")
    )


# --- strong components ----------------------------------------------------------------------

# Orders tried at once; more of them mean fewer rounds and wider rows.
_ORDERS = 3


def strong_components(edges: DataFrame) -> DataFrame:
    """(repo, name, component, size) for components of two or more nodes.

    `component` is the smallest name in it. Each round puts the nodes of the remaining graph in
    some random orders and finds, per order, the first node that reaches a node and the first
    one it reaches. Where both are the same node, that node's component is known. Edges whose
    ends disagree in any answer lie on no cycle and are dropped. Random orders make the number
    of rounds logarithmic in expectation, also for long chains without a cycle. Long stretches of
    nodes with one way in and one way on are bridged before (`_roots`).
    """
    edges = materialize(edges.select("repo", "src", "dst").filter("src != dst"), "edges")
    ends = edges.select("repo", F.explode(F.array("src", "dst")).alias("name")).distinct()
    # Hashing one long under a fixed seed is a permutation: ids stay unique and become random.
    nodes = materialize(ends.withColumn("id", F.xxhash64(F.monotonically_increasing_id())), "nodes")
    sources = nodes.select("repo", F.col("name").alias("src"), F.col("id").alias("u"))
    targets = nodes.select("repo", F.col("name").alias("dst"), F.col("id").alias("v"))
    links, left = materialize_counting(
        edges.join(sources, ["repo", "src"]).join(targets, ["repo", "dst"]).select("u", "v"), "links"
    )
    if not left:
        none = nodes.limit(0)
        return none.select("repo", "name", F.col("name").alias("component"), F.lit(1).cast("bigint").alias("size"))
    members = _roots(links).join(nodes, "id")
    components = members.groupBy("root").agg(F.min("name").alias("component"), F.count("*").alias("size"))
    return members.join(components.filter("size > 1"), "root").select("repo", "name", "component", "size")


# Of the nodes with one way in and on, one in so many stays; as many pointer doublings reach over the others.
_STAYS, _REACH = 16, 7
_FEW = 1000  # fewer are not worth the jobs


def _roots(links: DataFrame, turn: int = 0) -> DataFrame:
    """(id, root): a node of the component for every node of `links(u, v)` that may lie in one.

    Nodes with one way in and one way on are bridged but for a random few, and the smaller graph
    is solved the same way. A bridged node belongs where both ends of its stretch do.
    """
    ends = links.groupBy("u").agg(F.count("*").alias("_out"), F.min("v").alias("to"))
    back = links.groupBy(F.col("v").alias("u")).agg(F.count("*").alias("_in"))
    one_way = ends.join(back, "u").filter(f"_out = 1 and _in = 1 and pmod(xxhash64(u, {turn}), {_STAYS}) != 0")
    passing, many = materialize_counting(one_way.select(F.col("u").alias("id"), "to", F.col("u").alias("last")), "passing")
    if many < _FEW:
        return _random_order_roots(links)
    at, moved, reach = passing, many, 0
    while moved and reach < _REACH:
        onward = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("last").alias("_last"))
        far = at.join(onward, "to", "left").select("id", F.coalesce("_to", "to").alias("to"), F.coalesce("_last", "last").alias("last"), F.col("_to").isNotNull().alias("moved"))
        at, moved = materialize_counting(far, "passing", "moved")
        at, reach = at.drop("moved"), reach + 1
    # What still ends at a passing node, as in a ring of them, stays; the rest knows its stretch by the last node.
    bridged = materialize(at.join(passing.select(F.col("id").alias("to")), "to", "left_anti"), "bridged")
    starts = links.join(bridged.select(F.col("id").alias("u")), "u", "left_anti")
    starts = starts.join(bridged.withColumnsRenamed({"id": "v", "to": "_to", "last": "_last"}), "v", "left")
    shorter = materialize(starts.select("u", F.coalesce("_to", "v").alias("v"), F.col("_last").alias("last")), "shorter")
    between = shorter.select("u", "v").filter("u != v").distinct()
    kept, left = materialize_counting(between, "links")
    solved = _roots(kept, turn + 1) if left else kept.select(F.col("u").alias("id"), F.col("v").alias("root"))
    solved = materialize(solved, "roots")
    at_u = solved.select(F.col("id").alias("u"), F.col("root").alias("_root_u"))
    at_v = solved.select(F.col("id").alias("v"), F.col("root").alias("_root_v"))
    stretches = shorter.filter("last is not null").join(at_u, "u", "left").join(at_v, "v", "left")
    closed = stretches.filter("u = v or _root_u = _root_v").select("last", "u", F.coalesce("_root_u", "u").alias("root"))
    inside = bridged.join(closed.select("last", "root"), "last").select("id", "root")
    alone = closed.filter("u = root").select(F.col("u").alias("id"), "root").distinct().join(solved.select("id"), "id", "left_anti")
    return solved.unionByName(inside).unionByName(alone)


def _random_order_roots(links: DataFrame) -> DataFrame:
    rng = random.Random(0)
    found: list[DataFrame] = []
    left = 1
    while left:
        keys = [rng.getrandbits(63) for _ in range(_ORDERS)]
        labels = _reach_labels(links, keys)
        f, b = [f"f{i}" for i in range(_ORDERS)], [f"b{i}" for i in range(_ORDERS)]
        root = F.coalesce(*[F.when(F.col(x) == F.col(y), F.col(x).bitwiseXOR(F.lit(k))) for x, y, k in zip(f, b, keys)])
        judged = labels.withColumn("root", root)
        found.append(judged.filter("root is not null").select("id", "root"))
        open_nodes = judged.filter("root is null")
        at_u = open_nodes.select(F.col("id").alias("u"), *[F.col(c).alias(f"{c}_u") for c in f + b])
        at_v = open_nodes.select(F.col("id").alias("v"), *[F.col(c).alias(f"{c}_v") for c in f + b])
        agree = reduce(and_, [F.col(f"{c}_u") == F.col(f"{c}_v") for c in f + b])
        links, left = materialize_counting(
            links.join(at_u, "u").join(at_v, "v").filter(agree).select("u", "v"), "links"
        )
    return reduce(DataFrame.unionByName, found)


def _reach_labels(links: DataFrame, keys: list[int]) -> DataFrame:
    """(id, f0.., b0..): per order the least label that reaches a node, and the least it reaches.

    A node's label in an order is its id XOR the order's key, so a label tells its node. Each
    step a node asks its neighbours and the nodes of all its labels, which shortens long paths,
    for what they know; the answers combine before the shuffle.
    """
    f, b = [f"f{i}" for i in range(len(keys))], [f"b{i}" for i in range(len(keys))]
    labels = [(c, key, back) for names, back in ((f, "true"), (b, "false")) for c, key in zip(names, keys)]
    neighbours = links.selectExpr("v AS asker", "u AS target", "true AS back").unionByName(
        links.selectExpr("u AS asker", "v AS target", "false AS back")
    )
    known = ", ".join(f"struct({c} ^ {key}L AS target, {back} AS back)" for c, key, back in labels)
    jump = f"explode(array_distinct(array({known}))) AS _a"
    answer = [f"if({'back' if back == 'true' else 'NOT back'}, {c}, NULL) AS {c}" for c, _, back in labels]
    nothing = [f"CAST(NULL AS BIGINT) AS {c}_old" for c in f + b]
    before = [f"{c} AS {c}_old" for c in f + b]
    least = [F.min(c).alias(c) for c in f + b] + [F.min(f"{c}_old").alias(f"{c}_old") for c in f + b]
    changed = F.expr(" OR ".join(f"{c} != {c}_old" for c in f + b))
    ends = links.selectExpr("explode(array(u, v)) AS id").distinct()
    state = ends.selectExpr("id", *[f"id ^ {key}L AS {c}" for c, key, _ in labels])
    while True:
        jumps = state.selectExpr("id AS asker", jump).selectExpr("asker", "_a.target", "_a.back")
        asks = neighbours.union(jumps.filter("asker != target"))
        answers = asks.join(state.withColumnRenamed("id", "target"), "target").selectExpr("asker AS id", *answer, *nothing)
        step = state.selectExpr("*", *before).union(answers).groupBy("id").agg(*least)
        state, moved = materialize_counting(step.select("id", *f, *b, changed.alias("changed")), "labels", "changed")
        state = state.drop("changed")
        if not moved:
            return state


# --- cycles ---------------------------------------------------------------------------------


_NODE = ["repo", "component", "node"]
_PART = ["repo", "component"]


def find_cycles(edges: DataFrame) -> DataFrame:
    """One shortest cycle per component through its smallest name: (repo, component, length, cycle).

    Among equally short cycles the one met first when references are followed in file order wins.
    """
    places = cycle_nodes(edges).withColumn("_one", F.struct("at", "name"))
    cycles = places.groupBy("repo", "component").agg(F.max("at").alias("length"), F.array_sort(F.collect_list("_one")).alias("_all"))
    return cycles.select("repo", "component", "length", F.col("_all.name").alias("cycle"))  # the cycle itself, nothing else, in one row


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """The cycles of `find_cycles` as rows: (repo, component, at, name), `at` from 0; the last name is the first again.

    Nodes with one way on are passed by pointers that double, so long stretches without a choice cost
    a logarithm of rounds. Between the others, labels (distance, choices so far, predecessor)
    spread one reference per round until none improves; no label holds names but two, and four bytes per
    choice keep ties in order. The nodes on the way are then marked by doubling pointers again.
    """
    edges = materialize(edges.select("repo", "src", "dst", "pos"), "edges")
    components = materialize(strong_components(edges), "components")
    loops = edges.filter("src = dst").select("repo", F.col("src").alias("name"), F.col("src").alias("component"))
    alone = loops.join(components, ["repo", "name"], "left_anti")
    members = materialize(components.select("repo", "name", "component").unionByName(alone), "members")
    at_src = members.select("repo", F.col("name").alias("src"), "component")
    at_dst = members.select("repo", F.col("name").alias("dst"), F.col("component").alias("other"))
    inner = materialize(
        edges.join(at_src, ["repo", "src"]).join(at_dst, ["repo", "dst"]).filter("component = other")
        .select("repo", "component", F.col("src").alias("node"), "dst", "pos"),
        "inner",
    )
    ways = inner.groupBy(*_NODE).agg(F.count("*").alias("_ways"), F.min("dst").alias("next"))
    straight = materialize(ways.filter("_ways = 1 and node != component").select(*_NODE, "next", F.lit(1).cast("bigint").alias("steps")), "straight")
    jumps = _doubled(straight)
    heads = jumps[-1]
    # Start and choices alone stay; `end` is the start when it is met again.
    first = heads.select("repo", "component", F.col("node").alias("dst"), F.col("next").alias("_head"), "steps")
    choices = inner.join(straight.select(*_NODE), _NODE, "left_anti").join(first, ["repo", "component", "dst"], "left")
    target = F.coalesce("_head", "dst")
    links = materialize(
        choices.select(
            *_NODE, "pos", F.col("dst").alias("via"), target.alias("to"), (target == F.col("component")).alias("end"),
            (F.coalesce("steps", F.lit(0)) + 1).cast("bigint").alias("steps"),
        ),
        "choices",
    )
    settled = _shortest(links)
    on_way = _marked(
        settled.filter("end").select("repo", "component", "node", "end"),
        _ancestors(settled),
        lambda found, up: found.join(up, ["repo", "component", "node", "end"]).select("repo", "component", F.col("above").alias("node"), F.lit(False).alias("end")),
    )
    stops = settled.join(on_way, ["repo", "component", "node", "end"])
    chains = stops.filter("via != node or (end and via != component)").select("repo", "component", F.col("via").alias("node"))
    inside = _marked(
        chains.join(straight.select(*_NODE), _NODE, "left_semi"),
        jumps[:-1],
        lambda found, up: found.join(up, _NODE).select("repo", "component", F.col("next").alias("node")).join(straight.select(*_NODE), _NODE, "left_semi"),
    )
    ends = stops.select("repo", "component", F.col("node").alias("_head"), F.col("at").alias("_head_at"), "end")
    passed = inside.join(heads.withColumnRenamed("next", "_head"), _NODE).join(ends.filter("end or _head != component"), ["repo", "component", "_head"])
    return stops.select("repo", "component", "at", F.col("node").alias("name")).unionByName(
        passed.select("repo", "component", (F.col("_head_at") - F.col("steps")).alias("at"), F.col("node").alias("name"))
    )


def _doubled(pointers: DataFrame) -> list[DataFrame]:
    """Pointers (repo, component, node, next, steps) after 1, 2, 4, ... steps; one that leaves the given nodes stays."""
    levels, moved = [pointers], 1
    while moved:
        at = levels[-1]
        onward = at.select("repo", "component", F.col("node").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        far = at.join(onward, ["repo", "component", "next"], "left").select(
            *_NODE, F.coalesce("_next", "next").alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_next").isNotNull().alias("_moved")
        )
        table, moved = materialize_counting(far, "pointers", "_moved")
        levels.append(table.drop("_moved"))
    return levels


def _shortest(links: DataFrame) -> DataFrame:
    """(repo, component, node, end, at, above, via) of every node met from the start: distance, predecessor, first step of the link.

    Each round the nodes whose label improved offer one to their targets. Offers longer than the
    component's shortest way back so far go no further.
    """
    label = F.struct("at", "key", "above", "via")
    no_key = F.lit(b"").cast("binary")
    zero, nobody = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    state = links.select("repo", "component").distinct().select(
        "repo", "component", F.col("component").alias("node"), F.lit(False).alias("end"),
        F.struct(zero.alias("at"), no_key.alias("key"), nobody.alias("above"), nobody.alias("via")).alias("label"), F.lit(True).alias("fresh"),
    )
    going = 1
    while going:
        limit = state.filter("end").select("repo", "component", F.col("label.at").alias("_most"))
        senders = state.filter("fresh and not end").join(limit, _PART, "left").filter("_most is null or label.at < _most")
        choice = F.concat("label.key", F.unhex(F.lpad(F.hex("pos"), 8, "0")))
        # The last step counts as the node that it leaves: nodes are taken in order, references are not.
        key = F.when(F.col("l.end") & (F.col("via") == F.col("s.component")), F.col("label.key")).otherwise(choice)
        offers = senders.alias("s").join(links.alias("l"), _NODE).select(
            "repo", "component", F.col("to").alias("node"), F.col("l.end").alias("end"), (F.col("label.at") + F.col("l.steps")).alias("at"),
            key.alias("key"), F.col("node").alias("above"), "via",
        )
        offers = offers.select("repo", "component", "node", "end", label.alias("label"), F.lit(None).cast(state.schema["label"].dataType).alias("before"))
        known = state.select("repo", "component", "node", "end", "label", F.col("label").alias("before"))
        best = known.unionByName(offers).groupBy("repo", "component", "node", "end").agg(F.min("label").alias("label"), F.max("before").alias("before"))
        improved = F.col("before").isNull() | (F.col("label") < F.col("before"))
        state, going = materialize_counting(best.select("repo", "component", "node", "end", "label", improved.alias("fresh")), "labels", "fresh")
    return state.select("repo", "component", "node", "end", "label.at", "label.above", "label.via")


def _ancestors(settled: DataFrame) -> list[DataFrame]:
    """(repo, component, node, end, above): the predecessor 1, 2, 4, ... links before."""
    at = settled.filter("above is not null").select("repo", "component", "node", "end", "above")
    levels, left = [], 1
    while left:
        levels.append(at)
        upper = at.filter("not end").select("repo", "component", F.col("node").alias("above"), F.col("above").alias("_above"))
        at, left = materialize_counting(
            at.join(upper, ["repo", "component", "above"]).select("repo", "component", "node", "end", F.col("_above").alias("above")), "ancestors"
        )
    return levels


def _marked(found: DataFrame, levels: list[DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """`found` and all that it reaches: each level of doubled pointers doubles what is marked."""
    for level in levels:
        found = materialize(found.unionByName(step(found, level)).distinct(), "marked")
    return found


# --- layers ---------------------------------------------------------------------------------


def layer_tokens(spec: str) -> list[tuple[int, str]]:
    """(layer, token) pairs of a text such as `core, base*; *; shop`: `;` opens the next layer, unless this one is empty."""
    pairs, level = [], 0
    for block in spec.lower().split(";"):
        tokens = re.findall(r"[^,\s](?:[^,]*[^,\s])?", block)
        pairs += [(level, token) for token in tokens]
        level += bool(tokens)
    return pairs


def glob_pattern(token: str) -> str:
    """A shell wildcard over a whole name as a regex."""
    out, i = "", 0
    while i < len(token):
        char, i = token[i], i + 1
        end = token.find("]", i + 1 + (token[i : i + 1] == "!")) if char == "[" else -1
        if char == "*":
            out += ".*"
        elif char == "?":
            out += "."
        elif end > 0:
            negated = token[i] == "!"
            body = token[i + negated : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            body = "\\" + body if body.startswith("^") else body
            out, i = out + f"[{'^' if negated else ''}{body}]", end + 1
        else:
            out += re.escape(char)
    return f"(?s)^{out}\\z"


def layer_of(name: Column, spec: str) -> Column:
    """The first layer (from 0) one of whose tokens fits the name; a lone `*` takes the rest."""
    lowered = F.lower(name)
    parts = F.split(lowered, r"[./\\]")
    level, rest = None, F.lit(None).cast("int")
    for position, token in layer_tokens(spec):
        if token == "*":
            rest = F.lit(position)
            continue
        fits = lowered.rlike(glob_pattern(token)) if set(token) & set("*?[") else F.array_contains(parts, token)
        level = F.when(fits, position) if level is None else level.when(fits, position)
    return rest if level is None else level.otherwise(rest)


def layer_violations(edges: DataFrame, spec: str) -> DataFrame:
    """References into a higher layer: (repo, src, src_level, dst, dst_level)."""
    levels = edges.select(
        "repo", "src", layer_of(F.col("src"), spec).alias("src_level"), "dst", layer_of(F.col("dst"), spec).alias("dst_level")
    )
    return levels.filter("dst_level > src_level")


def unassigned_projects(nodes: DataFrame, spec: str) -> DataFrame:
    """Projects no layer takes: (repo, name)."""
    return nodes.filter(layer_of(F.col("name"), spec).isNull()).select("repo", "name")
