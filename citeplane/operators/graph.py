"""Evidence graphs: closures, leaves, integrity, acyclicity, support and dependency rules.

nodes: case_id, node_id, kind (claim, inclusion, inference), and for claims variable, status, reading_id.
deps: case_id, parent_id, child_id (a node rests on its children).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import Scratch


def closure(deps: DataFrame, roots: DataFrame | None = None, through: DataFrame | None = None, most: int = 64) -> DataFrame:
    """(case_id, root_id, node_id) of all nodes reachable from each root by one or more steps, cycles included.

    Semi-naive: a round joins only the pairs that the round before it found, and ends when there are none; each
    round's pairs are written, so plans stay short and diamonds do not multiply rows. With `through` (case_id,
    node_id), only these nodes are passed through. Depth costs rounds: paths of every length found double the reach
    of a round when no `through` is given, so a chain of n takes about log2(n) rounds.
    """
    scratch = Scratch(deps.sparkSession, "closure")
    steps = deps.select("case_id", F.col("parent_id").alias("root_id"), F.col("child_id").alias("node_id")).distinct()
    if roots is not None or through is not None:
        return _frontier(steps, roots, through, scratch)
    reach = scratch.keep(steps, "0")
    turn, size = 0, reach.count()
    while True:
        left, right = reach.alias("l"), reach.alias("r")
        longer = left.join(right, (F.col("l.case_id") == F.col("r.case_id")) & (F.col("l.node_id") == F.col("r.root_id"))).select("l.case_id", "l.root_id", "r.node_id")
        turn += 1
        reach, before = scratch.keep(reach.union(longer).distinct(), str(turn)), size
        scratch.drop(str(turn - 1))
        size = reach.count()
        if size == before:
            return reach


def _frontier(steps: DataFrame, roots: DataFrame | None, through: DataFrame | None, scratch: Scratch) -> DataFrame:
    start = steps if roots is None else steps.join(roots.select("case_id", F.col("node_id").alias("root_id")), ["case_id", "root_id"], "left_semi")
    new = seen = scratch.keep(start, "f0")
    turn = 0
    while not new.isEmpty():
        tip = new if through is None else new.join(through.select("case_id", "node_id"), ["case_id", "node_id"], "left_semi")
        hop = steps.select("case_id", F.col("root_id").alias("node_id"), F.col("node_id").alias("to"))
        found = tip.join(hop, ["case_id", "node_id"]).select("case_id", "root_id", F.col("to").alias("node_id")).distinct().join(seen, ["case_id", "root_id", "node_id"], "left_anti")
        turn += 1
        new = scratch.keep(found, f"f{turn}")
        seen = seen.union(new)
    return seen


def with_roots(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure with each root reaching itself."""
    own = nodes.select("case_id", F.col("node_id").alias("root_id"), "node_id")
    return reach.union(own).distinct()


def source_leaves(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inclusions that each root rests on."""
    return reach.join(nodes.where("kind = 'inclusion'").select("case_id", "node_id"), ["case_id", "node_id"], "left_semi")


def cited_inclusions(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inclusions that claims reach through inferences, never through other claims."""
    claims = nodes.where("kind = 'claim'")
    reach = closure(deps, claims, nodes.where("kind = 'inference'"))
    return source_leaves(reach, nodes)


def unsupported(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """Live claims that reach a rejected claim."""
    claims = nodes.where("kind = 'claim'")
    rejected = claims.where("status = 'rejected'").select("case_id", "node_id")
    live = claims.where("status <> 'rejected'").select("case_id", F.col("node_id").alias("root_id"))
    return reach.join(rejected, ["case_id", "node_id"], "left_semi").join(live, ["case_id", "root_id"], "left_semi").select("case_id", F.col("root_id").alias("node_id")).distinct()


def undeclared(deps: DataFrame, nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """Claims consumed through inferences by a claim of a variable that does not declare theirs (variable, input)."""
    claims = nodes.where("kind = 'claim'").select("case_id", "node_id", "variable")
    reach = closure(deps, claims, nodes.where("kind = 'inference'"))
    used = reach.join(claims.withColumnRenamed("variable", "used"), ["case_id", "node_id"]).join(claims.select("case_id", F.col("node_id").alias("root_id"), "variable"), ["case_id", "root_id"])
    allowed = inputs.select("variable", F.col("input").alias("used"))
    return used.where("used <> variable").join(allowed, ["variable", "used"], "left_anti").select("case_id", "root_id", "node_id")


def dangling(rows: DataFrame, key: list[str], targets: DataFrame, target: list[str], code: str = "unknown_reference") -> DataFrame:
    """Rows whose key names no target."""
    named = targets.select(*(F.col(t).alias(k) for t, k in zip(target, key))).distinct()
    return rows.join(named, key, "left_anti").withColumn("code", F.lit(code))


def repeated_ids(*kinds: DataFrame) -> DataFrame:
    """Ids (case_id, node_id) used more than once over all kinds of records."""
    all_ = kinds[0].select("case_id", "node_id")
    for more in kinds[1:]:
        all_ = all_.union(more.select("case_id", "node_id"))
    return all_.groupBy("case_id", "node_id").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def peel(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(case_id, node_id, code): cycle for nodes on or above a cycle, unsupported for inferences that are not source-backed.

    Nodes all of whose children are settled are settled in rounds from the leaves; what never settles rests on a cycle.
    A settled node is backed if it is an inclusion, or has children and all are backed.
    """
    scratch = Scratch(nodes.sparkSession, "peel")
    deps = scratch.keep(deps.select("case_id", "parent_id", "child_id").distinct(), "deps")
    degree = deps.groupBy("case_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    open_ = scratch.keep(nodes.select("case_id", "node_id", "kind").join(degree, ["case_id", "node_id"], "left").select("case_id", "node_id", "kind", F.coalesce("children", F.lit(0)).alias("children"), F.lit(0).cast("long").alias("settled"), F.lit(True).alias("good")), "open0")
    done, turn = [], 0
    while True:
        ready = scratch.keep(open_.where("settled = children").select("case_id", "node_id", "kind", ((F.col("kind") == "inclusion") | ((F.col("children") > 0) & F.col("good"))).alias("backed")), f"ready{turn}")
        if ready.isEmpty():
            break
        done.append(ready)
        up = deps.join(ready.select("case_id", F.col("node_id").alias("child_id"), "backed"), ["case_id", "child_id"]).groupBy("case_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("backed").alias("ok"))
        rest = open_.where("settled < children").join(up, ["case_id", "node_id"], "left")
        turn += 1
        open_ = scratch.keep(rest.select("case_id", "node_id", "kind", "children", (F.col("settled") + F.coalesce("n", F.lit(0))).alias("settled"), (F.col("good") & F.coalesce("ok", F.lit(True))).alias("good")), f"open{turn}")
    out = open_.select("case_id", "node_id", F.lit("cycle").alias("code"))
    for ready in done:
        out = out.union(ready.where("kind <> 'inclusion' AND NOT backed").select("case_id", "node_id", F.when(F.col("kind") == "claim", "orphaned_claim").otherwise("unsupported_inference")))
    return out


def propagate_case(seeds: DataFrame, inputs: DataFrame) -> DataFrame:
    """(node_id, case_id): nodes take the cases of what they rest on, to the fixpoint. seeds: node_id, case_id; inputs: parent_id, child_id."""
    one = F.lit("").alias("case_id")
    reach = closure(inputs.select(one, "parent_id", "child_id"))
    above = reach.join(seeds.withColumnRenamed("case_id", "found"), "node_id").select(F.col("root_id").alias("node_id"), F.col("found").alias("case_id"))
    return seeds.select("node_id", "case_id").union(above).distinct()


def drop_dependents(nodes: DataFrame, deps: DataFrame, dropped: DataFrame) -> DataFrame:
    """Nodes left when inferences that rest on dropped nodes go too, to the fixpoint."""
    inferences = nodes.where("kind = 'inference'").select("case_id", "node_id")
    edges = deps.join(inferences.withColumnRenamed("node_id", "parent_id"), ["case_id", "parent_id"], "left_semi")
    fall = closure(edges).join(dropped.select("case_id", "node_id"), ["case_id", "node_id"], "left_semi").select("case_id", F.col("root_id").alias("node_id"))
    return nodes.join(dropped.select("case_id", "node_id").union(fall).distinct(), ["case_id", "node_id"], "left_anti")


def claim_order(claims: DataFrame, reach: DataFrame) -> DataFrame:
    """Claims with position in dependency order: by depth under other claims, then id."""
    inside = reach.join(claims.select("case_id", "node_id"), ["case_id", "node_id"], "left_semi").groupBy("case_id", F.col("root_id").alias("node_id")).agg(F.count(F.lit(1)).alias("below"))
    ranked = claims.join(inside, ["case_id", "node_id"], "left").withColumn("below", F.coalesce("below", F.lit(0)))
    return ranked.withColumn("position", F.expr("row_number() OVER (PARTITION BY case_id ORDER BY below, node_id)")).drop("below")


def mentions_at(inclusions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(evidence_id, mention_id) where an inclusion is a mention's hull or one of its fragments."""
    hull = mentions.select("mention_id", "source_id", "start", "end")
    part = mentions.select("mention_id", "source_id", F.explode("fragments").alias("f")).select("mention_id", "source_id", "f.start", "f.end")
    return inclusions.join(hull.union(part).distinct(), ["source_id", "start", "end"]).select("evidence_id", "mention_id").distinct()


def uncovered_mentions(mentions: DataFrame, cited: DataFrame) -> DataFrame:
    """Claims (claim_id, source_id, pieces) some piece of whose mention they do not cite (claim_id, source_id, start, end)."""
    need = mentions.select("claim_id", "source_id", F.explode("pieces").alias("p")).select("claim_id", "source_id", "p.start", "p.end")
    return need.join(cited, ["claim_id", "source_id", "start", "end"], "left_anti").select("claim_id").distinct()


def attribute_edges(edges: DataFrame, claims: DataFrame, readings: DataFrame) -> DataFrame:
    """Edges with role attribute:<category> that do not cite that category's cue on the claim's reading."""
    named = edges.where("role LIKE 'attribute:%'").withColumn("category", F.substring_index("role", ":", -1))
    cues = readings.select("reading_id", F.explode("attributes").alias("a")).select("reading_id", "a.category", F.col("a.evidence_id").alias("evidence_id"))
    good = named.join(claims.select(F.col("node_id").alias("claim_id"), "reading_id"), "claim_id").join(cues, ["reading_id", "category", "evidence_id"], "left_semi")
    return named.join(good.select("claim_id", "evidence_id", "role"), ["claim_id", "evidence_id", "role"], "left_anti")


def scope_outside(scopes: DataFrame, inclusions: DataFrame, mentions: DataFrame) -> DataFrame:
    """Attribute scopes (mention_id, evidence_id) whose inclusion does not contain the mention's hull."""
    i = inclusions.select("evidence_id", F.col("start").alias("a"), F.col("end").alias("b"))
    return scopes.join(i, "evidence_id").join(mentions.select("mention_id", "start", "end"), "mention_id").where("start < a OR end > b").select("mention_id", "evidence_id")


def register(stored: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows after registration, conflicts): an equal record is the same record, a different one under its key a conflict."""
    both = stored.unionByName(new).distinct()
    clash = both.groupBy(*key).agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")
    return both.join(clash, key, "left_anti"), clash


def records(rows: DataFrame, key: str, by: str = "case_id") -> DataFrame:
    """One row for each case with its records sorted by id."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in rows.columns if c not in (key, by)]))).alias("records"))


def commit(claims: DataFrame) -> DataFrame:
    """Field-role edges of new claims (claim_id, field_roles map of role to evidence ids)."""
    each = claims.select("claim_id", F.explode("field_roles").alias("role", "ids"))
    return each.select("claim_id", F.explode("ids").alias("evidence_id"), "role")


def claim_error(status: Column, allowed: list[str], variable_known: Column, context_matches: Column) -> Column:
    """First code that applies to a claim, else null."""
    return F.when(~F.coalesce(status.isin(*allowed), F.lit(False)), "invalid_status").when(~variable_known, "invalid_context").when(~context_matches, "invalid_context")
