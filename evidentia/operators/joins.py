"""Joins and reconciliations of evidence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import columns as C
from evidentia.operators import mapping
from evidentia.operators.sets import dealt_join
from evidentia.storage import saved


def parent_child(spans: DataFrame) -> DataFrame:
    """An edge for each span whose parent is in the same trace."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("component").alias("source"))
    return spans.select("trace_id", "span_id", "parent_span_id", F.col("component").alias("target")).join(parents, ["trace_id", "parent_span_id"])


def align_static(edges: DataFrame, static: DataFrame) -> DataFrame:
    """corroborated, runtime_only or unmapped."""
    known = static.select("source", "target").distinct().withColumn("known", F.lit(True))
    mapped = F.col("source").isNotNull() & F.col("target").isNotNull()
    return edges.join(known, ["source", "target"], "left").withColumn("alignment", F.when(~mapped, "unmapped").when(F.col("known"), "corroborated").otherwise("runtime_only")).drop("known")


def map_unique(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left join on a key, only where the key has one value."""
    unique = table.groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")
    return rows.join(unique, key, "left")


def range_map(points: DataFrame, ranges: DataFrame, id_cols: list[str]) -> DataFrame:
    """The narrowest range of a point's path around it: mapped, ambiguous where two are as narrow, or unmapped."""
    met = mapping.within(points.select(*id_cols, "path", "line").distinct(), ranges.select("component_id", "path", "line", "end_line"), "path")
    return mapping.narrowest(points, met, id_cols)


def coverage_by_component(points: DataFrame, components: DataFrame) -> DataFrame:
    """Lines that can run and that ran, within each component's range."""
    met = mapping.within(points, components.select("component_id", "path", "line", "end_line"), "path")
    return met.groupBy("component_id").agg(F.countDistinct("line").alias("executable"), F.countDistinct(F.when(F.col("executed") == 1, F.col("line"))).alias("executed"))


def branch_coverage(points: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component_id, branches, taken, rate) of branch points (path, line, to_line, executed) by their first line, and the
    leftovers (kind, id): paths that no component has, and components on no measured path."""
    met = mapping.within(points, components.select("component_id", "path", "line", "end_line"), "path")
    pair = F.struct("line", "to_line")
    rates = met.groupBy("component_id").agg(F.countDistinct(pair).alias("branches"), F.countDistinct(F.when(F.col("executed") == 1, pair)).alias("taken"))
    paths = points.select("path").distinct()
    loose = paths.join(components.select("path").distinct(), "path", "left_anti").select(F.lit("path").alias("kind"), F.col("path").alias("id"))
    idle = components.join(paths, "path", "left_anti").select(F.lit("component").alias("kind"), F.col("component_id").cast("string").alias("id"))
    return rates.withColumn("rate", F.col("taken") / F.col("branches")), loose.unionByName(idle)


def reconcile_edges(external: DataFrame, native: DataFrame) -> DataFrame:
    """corroborated, external_only or outside (an end that the native graph doesn't have)."""
    nodes = native.select(F.explode(F.array("source", "target")).alias("n")).distinct()
    known = native.select("source", "target").distinct().withColumn("known", F.lit(True))
    a, b = nodes.select(F.col("n").alias("source"), F.lit(True).alias("has_source")), nodes.select(F.col("n").alias("target"), F.lit(True).alias("has_target"))
    rows = external.select("source", "target").distinct().join(known, ["source", "target"], "left").join(a, "source", "left").join(b, "target", "left")
    return rows.select("source", "target", F.when(F.col("known"), "corroborated").when(F.col("has_source") & F.col("has_target"), "external_only").otherwise("outside").alias("state"))


def match_endpoints(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Same normalised path and compatible method; UNKNOWN and ANY fit all."""
    met = _paths(clients, "endpoint_id", "client").join(_paths(routes, "route_id", "route"), "path")
    return met.where("client_method = 'UNKNOWN' or route_method = 'ANY' or client_method = route_method").select("endpoint_id", "route_id", "path")


def _paths(df: DataFrame, id_col: str, side: str) -> DataFrame:
    return df.select(id_col, C.normalize_endpoint(F.col("url")).alias("path"), F.col("method").alias(f"{side}_method")).where("path <> ''")


def _methods(df: DataFrame, id_col: str) -> DataFrame:
    """(path, methods): the few methods that stand at each path."""
    return _paths(df, id_col, "its").groupBy("path").agg(F.collect_set("its_method").alias("methods"))


def method_mismatch(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Clients whose path some route has, but with no compatible method."""
    met = _paths(clients, "endpoint_id", "client").join(_methods(routes, "route_id"), "path")
    fits = (F.col("client_method") == "UNKNOWN") | F.array_contains("methods", "ANY") | F.array_contains("methods", F.col("client_method"))
    return met.where(~fits).select("endpoint_id", "path")


def unmatched_endpoints(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Clients on no route's path, and routes that no client meets.  Each side's paths are normalised once and meet the
    methods of the other, not its rows."""
    c = _paths(clients, "endpoint_id", "client").select("endpoint_id", F.col("path").alias("p"))
    on_path = c.join(_paths(routes, "route_id", "route").select(F.col("path").alias("p")).distinct(), "p", "left_semi").select("endpoint_id")
    lost = clients.select("endpoint_id").join(on_path, "endpoint_id", "left_anti")
    r = _paths(routes, "route_id", "route").join(_methods(clients, "endpoint_id"), "path")
    fits = (F.col("route_method") == "ANY") | F.array_contains("methods", "UNKNOWN") | F.array_contains("methods", F.col("route_method"))
    idle = routes.select("route_id").join(r.where(fits).select("route_id"), "route_id", "left_anti")
    return lost.select(F.lit("client").alias("side"), F.col("endpoint_id").alias("id")).unionByName(idle.select(F.lit("route").alias("side"), F.col("route_id").alias("id")))


def apply_dispositions(records: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records with their decisions, and decisions that met none."""
    return records.join(decisions, keys, "left"), decisions.join(records.select(*keys), keys, "left_anti")


def vuln_match(sbom: DataFrame, advisories: DataFrame) -> DataFrame:
    """affected or not_affected for each component whose normalised name an advisory has; the range is half-open.  Names of
    many pairs are dealt out over tasks."""
    a = advisories.select("advisory_id", C.normalize_package(F.col("package")).alias("name"), "introduced", "fixed")
    met = dealt_join(sbom.select("bom_ref", C.normalize_package(F.col("package")).alias("name"), "version"), a, ["name"])
    state = F.when((F.col("version") >= F.col("introduced")) & (F.col("version") < F.col("fixed")), "affected").otherwise("not_affected")
    return met.select("bom_ref", "advisory_id", state.alias("state"))


def merge_intel(base: DataFrame, **feeds: DataFrame) -> DataFrame:
    """Full outer join of feeds by id; a flag says which had it."""
    out = base.withColumn("in_base", F.lit(True))
    for name, feed in feeds.items():
        out = out.join(feed.withColumn(f"in_{name}", F.lit(True)), "id", "full")
    return out.select("id", *[F.coalesce(f"in_{n}", F.lit(False)).alias(f"in_{n}") for n in ("base", *feeds)], *[c for f in feeds.values() for c in f.columns if c != "id"])


def decision_table(obs: DataFrame, rules: DataFrame, points: list[str], default: str = "undecided") -> DataFrame:
    """The observations with the outcome of the last rule (rule_order, outcome, allowed: point to allowed values) that fits.

    A rule fits if each point that it names has one of the values it allows there; points that it doesn't name may have any
    value.  An observation of which a point is null is undecided, as is one that no rule fits.  Rules are multiplied out to
    rows, one for each combination of values, of which the last rule's stays; each distinct combination of points that is
    observed meets them by equality, once for each set of points that rules name.  So rules cost rows, not plan."""
    any_value = F.array(F.lit("*"))
    cell = lambda value: F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    rows = rules.select("rule_order", "outcome", F.array().cast("array<string>").alias("key"), "allowed")
    for p in points:
        cells = F.coalesce(F.transform(F.array_distinct(F.col("allowed")[p]), cell), any_value)
        rows = rows.select("rule_order", "outcome", "key", "allowed", F.explode(cells).alias("cell")).select("rule_order", "outcome", F.concat("key", F.array("cell")).alias("key"), "allowed")
    table = saved(rows.groupBy("key").agg(F.max_by("outcome", "rule_order").alias("outcome"), F.max("rule_order").alias("rule_order")))
    masks = table.select(F.transform("key", lambda c: c == "*").alias("any")).distinct()
    # sets of points that rules name: at most 2 to the number of points
    shapes = [r["any"] for r in masks.collect()]
    seen = obs.select(*points).where(reduce(lambda x, y: x & y, [F.col(p).isNotNull() for p in points])).distinct()
    keys = [F.array(*[F.lit("*") if any_ else cell(F.col(p).cast("string")) for p, any_ in zip(points, shape, strict=True)]) for shape in shapes]
    asked = seen.withColumn("key", F.explode(F.array(*keys) if keys else F.array().cast("array<array<string>>")))
    decided = asked.join(table, "key").groupBy(*points).agg(F.max_by("outcome", "rule_order").alias("outcome"))
    return obs.join(decided, points, "left").withColumn("outcome", F.coalesce("outcome", F.lit(default)))


#: Keys that the findings under a catch-all selector are dealt to.
SALT = 64


def cite(findings: DataFrame, mappings: DataFrame) -> DataFrame:
    """Findings with the citations whose selector fits: exact, prefix and catch-all selectors are joined apart, by equality."""
    exact = mappings.where(~F.col("selector").endswith("*")).select(F.col("selector").alias("rule_id"), "citation")
    prefix = mappings.where(F.col("selector").endswith(".*")).select(F.expr("substring(selector, 1, length(selector) - 1)").alias("prefix"), "citation")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("rule_id", r"\."))), lambda i: F.concat(F.array_join(F.slice(F.split("rule_id", r"\."), 1, i), "."), F.lit(".")))
    # rules meet mappings once each; findings of a rule, which may be most of them, are dealt out
    rules = findings.select("rule_id").distinct()
    fits = rules.join(exact, "rule_id").unionByName(rules.select("rule_id", F.explode(prefixes).alias("prefix")).join(prefix, "prefix").select("rule_id", "citation"))
    # the hints keep the findings from being broadcast
    fits = fits.distinct().withColumn("any", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    dealt = F.pmod(F.xxhash64("finding_id"), F.lit(SALT))
    a = findings.select("finding_id", "rule_id", dealt.alias("any")).join(fits.hint("shuffle_hash"), ["rule_id", "any"]).select("finding_id", "citation")
    # a catch-all selector is the same key for every rule: findings are dealt to SALT keys, and each gets the few such mappings
    salted = findings.withColumn("any", dealt)
    every = mappings.where("selector = '*'").select("citation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("any"))
    c = salted.join(every.hint("shuffle_hash"), "any").select("finding_id", "citation")
    return a.unionByName(c).distinct()


def cite_profiles(findings: DataFrame, mappings: DataFrame, profiles: list[str]) -> DataFrame:
    """(finding_id, mapping_id, citation, profiles) by the mappings (mapping_id, selector, citation, profiles, review_status) that
    weren't rejected and share a profile with those chosen, which are named in the order chosen."""
    chosen = F.filter(F.array(*[F.lit(p) for p in dict.fromkeys(profiles)]), lambda p: F.array_contains("profiles", p))
    open_ones = mappings.where("review_status is distinct from 'independent_rejected'").withColumn("profiles", chosen).where(F.size("profiles") > 0)
    # a mapping goes along whole, since few of them would be hot keys of a join with all that was found
    whole = F.struct("mapping_id", "citation", "profiles").alias("citation")
    return cite(findings, open_ones.select("selector", whole)).select("finding_id", "citation.*")


def tree_gaps(events: DataFrame, links: DataFrame, finding_hazards: DataFrame, hazards: DataFrame) -> DataFrame:
    """(gap_type, tree_id, event_id, hazard_id, finding_id) where fault trees and reviews don't meet.

    Events are (tree_id, hazard_id, event_id, explicit, event_type, selects), links (tree_id, event_id, finding_id), finding_hazards
    (finding_id, hazard_id) what reviews linked, hazards (hazard_id) the catalogue.  A basic or undeveloped event of an explicit
    tree that selects findings and has none is uncovered; a link is a mismatch if the review doesn't name the tree's hazard; a
    reviewed hazard is unmapped if no tree of it links the finding; a hazard may have no tree."""
    placed = links.join(events.select("tree_id", "event_id", "hazard_id"), ["tree_id", "event_id"]).distinct()
    leaf = F.col("explicit") & F.col("selects") & F.col("event_type").isin("basic", "undeveloped")
    parts = {
        "uncovered_event": events.where(leaf).join(links, ["tree_id", "event_id"], "left_anti"),
        "hazard_mismatch": placed.join(finding_hazards, ["finding_id", "hazard_id"], "left_anti"),
        "unmapped_finding": finding_hazards.distinct().join(hazards, "hazard_id", "left_semi").join(placed, ["finding_id", "hazard_id"], "left_anti"),
        "hazard_without_tree": hazards.distinct().join(events, "hazard_id", "left_anti"),
    }
    columns = ["tree_id", "event_id", "hazard_id", "finding_id"]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.select(F.lit(k).alias("gap_type"), *[c for c in columns if c in d.columns]) for k, d in parts.items()])


def paired_cohort(base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row: paired, base only, current only, and whether the cohorts are alike."""
    a = base.groupBy(key).agg(F.count("*").alias("a"))
    b = current.groupBy(key).agg(F.count("*").alias("b"))
    out = a.join(b, key, "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("paired"), F.count_if(F.col("b").isNull()).alias("base_only"),
                                     F.count_if(F.col("a").isNull()).alias("current_only"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"))
    return out.withColumn("comparable", (F.col("base_only") == 0) & (F.col("current_only") == 0) & (F.col("repeated") == 0))


def like_for_like(cohorts: DataFrame, cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base, current, comparable, reason) of pairs of cohorts (cohort, dataset_sha256, oracle_sha256) with cases (cohort, id), many at once.

    Only like may be compared with like: both digests are known and the same, no case lacks an identifier or occurs twice, and
    both have the same cases, at least one.  The reason is the first that fails, '' if none does."""
    known = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$") & (F.col(c) != "0" * 64), F.lit(False))
    blank = F.coalesce(F.trim("id"), F.lit("")) == ""
    each = cases.groupBy("cohort", "id").agg(F.count("*").alias("n"))
    sizes = each.groupBy("cohort").agg(F.count("*").alias("ids"), F.bool_or(F.col("n") > 1).alias("twice"), F.bool_or(blank).alias("blank"))
    about = cohorts.select("cohort", "dataset_sha256", "oracle_sha256", (known("dataset_sha256") & known("oracle_sha256")).alias("known")).join(sizes, "cohort", "left")
    side = lambda name: about.select(F.col("cohort").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in about.columns if c != "cohort"])
    met = pairs.join(side("base"), "base", "left").join(side("current"), "current", "left")
    ids = each.select("cohort", "id").where(~blank)
    shared = pairs.distinct().join(ids.withColumnRenamed("cohort", "base"), "base").join(ids.withColumnRenamed("cohort", "current"), ["current", "id"]).groupBy("base", "current").agg(F.count("*").alias("shared"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    same = (F.col("base_dataset_sha256") == F.col("current_dataset_sha256")) & (F.col("base_oracle_sha256") == F.col("current_oracle_sha256"))
    reason = (F.when(~yes(F.col("base_known") & F.col("current_known")), "unknown digest").when(~yes(same), "other digest").when(yes(F.col("base_blank")) | yes(F.col("current_blank")), "no identifier")
              .when(yes(F.col("base_twice")) | yes(F.col("current_twice")), "repeated case").when(F.coalesce("shared", F.lit(0)) == 0, "no shared case")
              .when((F.col("shared") != F.col("base_ids")) | (F.col("shared") != F.col("current_ids")), "other cases").otherwise(""))
    return met.join(shared, ["base", "current"], "left").select("base", "current", (reason == "").alias("comparable"), reason.alias("reason"))


def version_as_of(rows: DataFrame, changes: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The last version in force at each row's time: one shuffle on the keys, no range join.  The rows' columns may have any names;
    one called version is replaced."""
    given = [c for c in rows.columns if c.lower() != "version"]
    own = rows.select(*[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)], F.col(f"`{ts}`").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(changes.schema["version"].dataType).alias("version"),
                      F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"))
    told = changes.select(*[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)], F.col("effective_at").alias("at"), F.lit(0).alias("kind"), "version", F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    w = Window.partitionBy(*[f"k{n}" for n in range(len(keys))]).orderBy("at", "kind", "version").rowsBetween(Window.unboundedPreceding, 0)
    found = own.unionByName(told).withColumn("version", F.last("version", ignorenulls=True).over(w)).where("kind = 1")
    return found.select("row.*", "version")


def events_in_windows(events: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Events joined with the half-open windows around them; a window of any length is stored in at most two rows."""
    second = lambda c: F.unix_timestamp(c).cast("long")
    spans = windows.withColumns({"line": second("started_at"), "end_line": second("ended_at")})
    met = mapping.within(events.withColumn("line", second("ts")), spans, *keys)
    return met.where("ts >= started_at and ts < ended_at").drop("line", "from_line", "end_line")


def change_chain(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each record follows on from the one before it."""
    w = Window.partitionBy(*keys).orderBy("effective_at", "version")
    before = F.lag("version").over(w)
    return changes.select(*keys, "effective_at", "version", "previous_version", (before.isNull() | before.eqNullSafe(F.col("previous_version"))).alias("linked"),
                          (F.lag("effective_at").over(w).isNull() | (F.lag("effective_at").over(w) < F.col("effective_at"))).alias("increasing"))


def diff_runs(prev: DataFrame, cur: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """new, removed, changed or same, with the changed fields' names."""
    a = prev.select(key, F.struct(*fields).alias("a"))
    b = cur.select(key, F.struct(*fields).alias("b"))
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in sorted(fields)])), ",")
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(changed != "", "changed").otherwise("same")
    return a.join(b, key, "full").select(key, state.alias("change"), F.when(state == "changed", changed).otherwise("").alias("fields"))


def merge_rescan(prev: DataFrame, cur: DataFrame, key: str = "finding_id", mark: str = "fingerprint") -> DataFrame:
    """By id, else by a fingerprint that is unique among the leftovers of both sides: unchanged, changed, moved, new, removed."""
    a, b = prev.select(F.col(key).alias("old_id"), F.col(mark).alias("old_mark")), cur.select(F.col(key).alias("new_id"), F.col(mark).alias("new_mark"))
    by_id = a.join(b, F.col("old_id") == F.col("new_id"), "full")
    same = by_id.where("old_id is not null and new_id is not null").select("old_id", "new_id", F.when(F.col("old_mark").eqNullSafe(F.col("new_mark")), "unchanged").otherwise("changed").alias("change"))
    gone, come = by_id.where("new_id is null").select("old_id", "old_mark"), by_id.where("old_id is null").select("new_id", "new_mark")
    one = lambda df, i, m: df.groupBy(m).agg(F.count("*").alias("n"), F.min(i).alias(i)).where("n = 1").drop("n")
    moved = one(gone, "old_id", "old_mark").join(one(come, "new_id", "new_mark"), F.col("old_mark") == F.col("new_mark")).select("old_id", "new_id", F.lit("moved").alias("change"))
    removed = gone.join(moved.select("old_id"), "old_id", "left_anti").select("old_id", F.lit(None).cast("long").alias("new_id"), F.lit("removed").alias("change"))
    new = come.join(moved.select("new_id"), "new_id", "left_anti").select(F.lit(None).cast("long").alias("old_id"), "new_id", F.lit("new").alias("change"))
    return reduce(DataFrame.unionByName, [same, moved, removed, new])


def mcdc_pairs(vectors: DataFrame, conditions: list[str], decision: str = "decision", outcome: str = "outcome") -> DataFrame:
    """(decision, condition, covered): whether two vectors differ in that condition alone and in outcome."""
    parts = []
    for c in conditions:
        others = [x for x in conditions if x != c]
        groups = vectors.groupBy(decision, *others).agg(F.max(F.when(F.col(c), F.col(outcome).cast("int"))).alias("t1"), F.min(F.when(F.col(c), F.col(outcome).cast("int"))).alias("t0"),
                                                        F.max(F.when(~F.col(c), F.col(outcome).cast("int"))).alias("f1"), F.min(F.when(~F.col(c), F.col(outcome).cast("int"))).alias("f0"))
        apart = F.coalesce((F.col("t1") > F.col("f0")) | (F.col("f1") > F.col("t0")), F.lit(False))
        parts.append(groups.groupBy(decision).agg(F.bool_or(apart).alias("covered")).select(decision, F.lit(c).alias("condition"), "covered"))
    return reduce(DataFrame.unionByName, parts)


def unknown_refs(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    return rows.join(catalog.select(key), key, "left_anti")


def accounting(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Per adapter (the first key): expected, observed, missing and unexpected entities."""
    a, b = expected.select(*keys).distinct().withColumn("e", F.lit(1)), observed.select(*keys).distinct().withColumn("o", F.lit(1))
    return a.join(b, keys, "full").groupBy(keys[0]).agg(F.count("e").alias("expected"), F.count("o").alias("observed"), F.count_if(F.col("o").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))


def invalidated(prev: DataFrame, cur: DataFrame, key: str = "finding_id", mark: str = "fingerprint", sufficient: str = "status = 'F'") -> DataFrame:
    """Rows whose evidence was sufficient before, and whose mark has changed since."""
    now = cur.select(key, F.col(mark).alias("now"))
    return prev.where(sufficient).join(now, key).where(~F.col(mark).eqNullSafe(F.col("now"))).select(key)


def rescan_rows(prev: DataFrame, cur: DataFrame, human: list[str], scanner: list[str], key: str = "finding_id", mark: str = "fingerprint") -> DataFrame:
    """The merged findings themselves: the scanner's columns from the new scan, the human ones from the run before, what
    happened, and whether a review must be done again (human columns filled, scanner's view changed or gone)."""
    m = merge_rescan(prev, cur, key, mark)
    old, new = prev.select(F.col(key).alias("old_id"), *human), cur.select(F.col(key).alias("new_id"), *scanner)
    rows = m.join(old, "old_id", "left").join(new, "new_id", "left")
    reviewed = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in human])
    return rows.select(F.coalesce("new_id", "old_id").alias(key), "change", *human, *scanner, (reviewed & F.col("change").isin("changed", "moved", "removed")).alias("revalidate"))


def changes_inside(windows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Windows (keys, started_at, ended_at) within which a version changed: violations of one version a window."""
    c = changes.select(*keys, "effective_at")
    met = windows.join(c, keys).where("effective_at > started_at and effective_at < ended_at")
    return met.groupBy(*keys, "started_at").agg(F.count("*").alias("changes"), F.min("effective_at").alias("first_change"))
