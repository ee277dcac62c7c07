"""Fault trees and reliability diagrams, many at once, evaluated level by level.

Trees are tables: gates (tree, node, kind, k) and inputs (tree, node, child).  Kinds are and, or, vote (at least k) and
inhibit (like and).  A gate's level is one above its highest child's; gates on a cycle, or above an unknown child, never
get a level and are reported instead of computed.  Where every state or every cut set of a tree is asked for, the tree's few
rows come together and one task works on it; trees are spread over the tasks."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.columns import glob_match, vote_probability
from evidentia.storage import saved

#: A tree of n events has 2**n states; beyond this it is reported, not computed.
MOST_EVENTS = 20


def match_events(findings: DataFrame, selectors: list[dict], component: str = "component", text: str = "text") -> DataFrame:
    """(event_id, finding_id): findings that a selector names, or whose component fits one of its globs and whose text one of
    its failure globs (upper and lower case alike).  The selectors are a list of the user's, so one pass finds all."""
    def fits(s: dict) -> Column:
        named = F.col("finding_id").isin(*s["finding_ids"]) if s.get("finding_ids") else F.lit(False)
        globs = [glob_match(F.col(c), s[p], fold) for c, p, fold in ((component, "component_patterns", False), (text, "failure_patterns", True)) if s.get(p)]
        return named | (reduce(lambda a, b: a & b, globs) if globs else F.lit(False))

    hits = F.array_compact(F.array(*[F.when(F.coalesce(fits(s), F.lit(False)), F.lit(s["event_id"])) for s in selectors]))
    return findings.select("finding_id", F.explode(hits).alias("event_id")).select("event_id", "finding_id")


def levels(gates: DataFrame, inputs: DataFrame, events: DataFrame) -> tuple[DataFrame, int]:
    """(tree, node, level) of all gates, null for those that have none, and the highest level; events are (tree, node)."""
    # an event that is a gate too counts as the gate
    known = saved(events.select("tree", F.col("node").alias("child")).distinct().join(gates.select("tree", F.col("node").alias("child")), ["tree", "child"], "left_anti").withColumn("level", F.lit(0)))
    wanted = inputs.select("tree", "node", "child").distinct()
    need = wanted.groupBy("tree", "node").agg(F.count("*").alias("need"))
    done, level = None, 0
    while True:
        ready = wanted.join(known, ["tree", "child"]).groupBy("tree", "node").agg(F.count("*").alias("have"), F.max("level").alias("level")).join(need, ["tree", "node"]).where("have = need")
        ready = saved(ready.select("tree", F.col("node").alias("child"), (F.col("level") + 1).alias("level")).join(known.select("tree", "child"), ["tree", "child"], "left_anti"))
        if not ready.head(1):
            break
        known, level = saved(known.unionByName(ready)), level + 1
    done = known.where("level > 0").select("tree", F.col("child").alias("node"), "level")
    return gates.select("tree", "node").distinct().join(done, ["tree", "node"], "left"), level


def _value(kind: Column, yes: Column, count: Column, k: Column) -> Column:
    return F.when(kind == "or", yes > 0).when(kind == "vote", yes >= k).otherwise(yes == count)


def evaluate_trees(states: DataFrame, gates: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tree, node, value) of every gate for every state (keys, tree, node, value) of basic events; null without a level."""
    placed, highest = levels(gates, inputs, states.select("tree", "node"))
    placed = saved(gates.join(placed, ["tree", "node"]))
    known = states.select(*keys, "tree", F.col("node").alias("child"), "value")
    out = []
    for n in range(1, highest + 1):
        own = inputs.distinct().join(placed.where(F.col("level") == n), ["tree", "node"])
        values = known.join(own, ["tree", "child"]).groupBy(*keys, "tree", "node").agg(
            F.first("kind").alias("kind"), F.first("k").alias("k"), F.count_if("value").alias("yes"), F.count("*").alias("count"))
        values = saved(values.select(*keys, "tree", "node", _value(F.col("kind"), F.col("yes"), F.col("count"), F.col("k")).alias("value")))
        out.append(values)
        known = known.unionByName(values.withColumnRenamed("node", "child"))
    undone = states.select(*keys, "tree").distinct().join(placed.where("level is null").select("tree", "node"), "tree").withColumn("value", F.lit(None).cast("boolean"))
    return reduce(DataFrame.unionByName, [*out, undone])


def _drawn(gates: DataFrame, inputs: DataFrame) -> DataFrame:
    """(tree, gates): each tree's gates (node, kind, k, children) in one row."""
    children = inputs.distinct().groupBy("tree", "node").agg(F.array_sort(F.collect_list("child")).alias("children"))
    gate = F.struct("node", "kind", F.col("k").cast("int").alias("k"), "children")
    return gates.select("tree", "node", "kind", "k").distinct().join(children, ["tree", "node"]).groupBy("tree").agg(F.array_sort(F.collect_list(gate)).alias("gates"))


def _in_order(gates: Iterable[dict], events: Iterable[str]) -> list[dict]:
    """The gates that can be computed, each after its children.  An event that is a gate too counts as the gate."""
    by_name = {g["node"]: g for g in gates}
    left = {name: set(g["children"]) for name, g in by_name.items()}
    above = defaultdict(list)
    for name, children in left.items():
        for c in children:
            above[c].append(name)
    out, ready = [], [e for e in events if e not in by_name]
    while ready:
        child = ready.pop()
        for name in above[child]:
            left[name].discard(child)
            if not left[name]:
                out.append(by_name[name])
                ready.append(name)
    return out


#: States in which event 0 to 5 is true, of 64.
_MASKS = [sum(1 << s for s in range(64) if s >> i & 1) for i in range(6)]


def truth_table(gates: list[dict], events: list[str], top: str) -> np.ndarray | None:
    """Whether the top holds in each of the 2**n states (bit i of a state: event i), worked out gate by gate for 64 states a
    word; None if the top can't be computed."""
    words = max(1, 2 ** len(events) // 64)
    table: dict[str, np.ndarray] = {}
    for i, e in enumerate(events):
        table[e] = np.full(words, _MASKS[i], np.uint64) if i < 6 else np.where(np.arange(words) >> (i - 6) & 1, np.uint64(2**64 - 1), np.uint64(0))
    for gate in _in_order(gates, events):
        inputs = [table[c] for c in gate["children"]]
        least = {"or": 1, "vote": gate["k"] or 0}.get(gate["kind"], len(inputs))
        # at least j of the inputs so far
        held = [np.full(words, 2**64 - 1, np.uint64), *[np.zeros(words, np.uint64) for _ in range(min(max(least, 0), len(inputs) + 1))]]
        for x in inputs:
            for j in range(len(held) - 1, 0, -1):
                held[j] |= held[j - 1] & x
        table[gate["node"]] = held[-1]
    if top not in table or all(g["node"] != top for g in gates):
        return None
    return np.unpackbits(table[top].view(np.uint8), bitorder="little")[: 2 ** len(events)].astype(bool)


def _weights(chances: Iterable[float | None]) -> np.ndarray:
    """The probability of each state."""
    w = np.ones(1)
    for p in chances:
        p = float("nan") if p is None else p
        w = np.concatenate([w * (1 - p), w * p])
    return w


def tree_probability(events: DataFrame, gates: DataFrame, inputs: DataFrame, top: str = "top") -> tuple[DataFrame, DataFrame]:
    """(tree, status, probability, low, high) and (tree, event, importance), from events (tree, node, p, low, high).

    Exact over all 2**n states, so that shared events count once.  A tree is one row of its events and gates, and its truth
    table is made in one task; a tree of over MOST_EVENTS events is reported and its rows are not gathered.  The importance
    is Birnbaum's: P(top | event) - P(top | no event).  An unknown probability makes the tree's numbers unknown."""
    sizes = saved(events.groupBy("tree").agg(F.count("*").alias("n")))
    fine = events.join(sizes.where(F.col("n") <= MOST_EVENTS).select("tree"), "tree").groupBy("tree").agg(
        F.array_sort(F.collect_list(F.struct("node", *[F.col(c).cast("double").alias(c) for c in ("p", "low", "high")]))).alias("events"))
    rows = fine.join(_drawn(gates, inputs), "tree", "left")
    number = T.DoubleType()
    schema = T.StructType([T.StructField("tree", events.schema["tree"].dataType), T.StructField("status", T.StringType()), *[T.StructField(c, number) for c in ("probability", "low", "high")],
                           T.StructField("parts", T.ArrayType(T.StructType([T.StructField("event", T.StringType()), T.StructField("importance", number)])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lambda x: None if np.isnan(x) else float(x)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("status", "probability", "low", "high", "parts")}
            for own, drawn in zip(batch.column("events").to_pylist(), batch.column("gates").to_pylist(), strict=True):
                names = [e["node"] for e in own]
                holds = truth_table(drawn or [], names, top)
                out["status"].append("computed" if holds is not None else "undefined_top")
                for field, name in (("p", "probability"), ("low", "low"), ("high", "high")):
                    out[name].append(None if holds is None else known(_weights(e[field] for e in own)[holds].sum()))
                parts = []
                for i, e in enumerate(own if holds is not None else []):
                    w = _weights(x["p"] for x in own if x is not e)
                    split = holds.reshape(-1, 2, 2**i)
                    parts.append({"event": e["node"], "importance": known(w[split[:, 1, :].ravel()].sum() - w[split[:, 0, :].ravel()].sum())})
                out["parts"].append(parts)
            kinds = [pa.string(), *[pa.float64()] * 3, pa.list_(pa.struct([("event", pa.string()), ("importance", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["tree", *out])

    found = saved(rows.mapInArrow(run, schema))
    large = sizes.where(F.col("n") > MOST_EVENTS).select("tree", F.lit("too_many_events").alias("status"), *[F.lit(None).cast("double").alias(c) for c in ("probability", "low", "high")])
    return found.drop("parts").unionByName(large), found.select("tree", F.explode("parts").alias("x")).select("tree", "x.*")


class _TooMany(Exception):
    """A gate passes a limit."""


def _minimal(terms: Iterable[int], most_terms: int) -> set[int]:
    """The terms (sets of events, as bits) that hold no other one.  A kept term stands under its rarest event, so a term is
    compared only with those whose rarest event it holds."""
    terms = sorted(set(terms), key=int.bit_count)
    least = bisect_right(terms, terms[0].bit_count(), key=int.bit_count) if terms else 0
    if least > most_terms:  # none of the smallest holds another
        raise _TooMany
    if least == len(terms):
        return set(terms)
    bits = lambda t: (i for i in range(t.bit_length()) if t >> i & 1)
    often = Counter(i for t in terms for i in bits(t))
    kept: set[int] = set()
    under: dict[int, list[int]] = defaultdict(list)
    for t in terms:
        if t and any(k & t == k for i in bits(t) for k in under[i]) or 0 in kept:
            continue
        kept.add(t)
        if len(kept) > most_terms:
            raise _TooMany
        if t:
            under[min(bits(t), key=lambda i: (often[i], i))].append(t)
    return kept


def _product(a: set[int], b: set[int], most_terms: int) -> set[int]:
    """The minimal terms of a and b together; what grows past a few times the limit is cut down at once."""
    out: set[int] = set()
    for x in a:
        out.update(x | y for y in b)
        if len(out) > 4 * most_terms:
            out = _minimal(out, most_terms)
    return _minimal(out, most_terms)


def minimal_cuts(gates: list[dict], events: list[str], top: str, most_terms: int, most_width: int) -> tuple[str, list[list[str]]]:
    """The status of a tree and its minimal cut sets.

    Gates are worked out from below, and terms that hold another are dropped after each child.  At least k of the children
    follow from at least j of those before, so no choice of k is ever listed."""
    at = {e: i for i, e in enumerate(events)}
    terms: dict[str, set[int]] = {e: {1 << i} for e, i in at.items()}
    try:
        for gate in _in_order(gates, events):
            inputs = sorted((terms[c] for c in gate["children"]), key=len)
            least = {"or": 1, "vote": gate["k"] or 0}.get(gate["kind"], len(inputs))
            held: list[set[int]] = [{0}, *[set() for _ in range(min(max(least, 0), len(inputs) + 1))]]
            for n, x in enumerate(inputs):
                for j in range(len(held) - 1, 0, -1):
                    if n + 1 >= j >= len(held) - 1 - (len(inputs) - n - 1):  # others can't be filled, or don't matter any more
                        held[j] = _minimal(held[j] | _product(held[j - 1], x, most_terms), most_terms)
            if any(t.bit_count() > most_width for t in held[-1]):
                raise _TooMany
            terms[gate["node"]] = held[-1]
    except _TooMany:
        return "limit_exceeded", []
    if top not in terms or all(g["node"] != top for g in gates):
        return "undefined_top", []
    return "computed", sorted([e for e, i in at.items() if t >> i & 1] for t in terms[top])


def cut_sets(events: DataFrame, gates: DataFrame, inputs: DataFrame, top: str = "top", most_terms: int = 10_000, most_width: int = 50) -> tuple[DataFrame, DataFrame]:
    """Minimal cut sets (tree, cut_set) of the tops, and (tree, status).

    A tree is one row of its events and gates, worked out in one task.  If a gate, or the part of its children done so far, has
    more minimal terms than ``most_terms``, or a gate a term of more than ``most_width`` events, the tree is reported as
    limit_exceeded and left out; if its top can't be computed, as undefined_top."""
    own = events.select("tree", "node").distinct().groupBy("tree").agg(F.array_sort(F.collect_list("node")).alias("events"))
    rows = gates.select("tree").distinct().join(_drawn(gates, inputs), "tree", "left").join(own, "tree", "left")
    schema = T.StructType([T.StructField("tree", gates.schema["tree"].dataType), T.StructField("status", T.StringType()), T.StructField("sets", T.ArrayType(T.ArrayType(T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row's sets may be many
                one = batch.slice(i, 1)
                status, sets = minimal_cuts(one.column("gates")[0].as_py() or [], one.column("events")[0].as_py() or [], top, most_terms, most_width)
                yield pa.RecordBatch.from_arrays([one.column("tree"), pa.array([status]), pa.array([sets], pa.list_(pa.list_(pa.string())))], names=["tree", "status", "sets"])

    found = saved(rows.mapInArrow(run, schema))
    return found.select("tree", F.explode("sets").alias("cut_set")), found.select("tree", "status")


def availability(blocks: DataFrame) -> DataFrame:
    """(tree, node, value, low, high): the share of time that repaired blocks (tree, node, failure, repair and their _low and _high
    rates) are up, mu / (lambda + mu); the bounds take the worst and the best of both rates.  Null where no rate is above 0."""
    up = lambda failure, repair: F.col(repair) / F.nullif(F.col(failure) + F.col(repair), F.lit(0.0))
    return blocks.select("tree", "node", up("failure", "repair").alias("value"), up("failure_high", "repair_low").alias("low"), up("failure_low", "repair_high").alias("high"))


def _upwards(blocks: DataFrame, gates: DataFrame, inputs: DataFrame, values: list[str], combined: Callable[[str], Column]) -> DataFrame:
    """(tree, node, values) of every gate that can be computed, from blocks (tree, node, values).

    Each gate meets its children once, in one join and one aggregation, and keeps the blocks among them as its parts; further
    rounds take only gates that wait for gates.  A block that is a gate too counts as the gate."""
    own = blocks.select("tree", F.col("node").alias("child"), F.struct("node", *values).alias("part"), F.lit(False).alias("gate"))
    named = gates.select("tree", F.col("node").alias("child"), F.lit(None).cast(own.schema["part"].dataType).alias("part"), F.lit(True).alias("gate"))
    nodes = own.unionByName(named).groupBy("tree", "child").agg(F.first("part", ignorenulls=True).alias("part"), F.bool_or("gate").alias("gate"))
    met = saved(inputs.select("tree", "node", "child").distinct().join(nodes, ["tree", "child"], "left"))
    # a gate over an unknown child is never computed
    parts = met.groupBy("tree", "node").agg(F.collect_list(F.when(~F.col("gate"), F.col("part"))).alias("parts"), F.count_if("gate").alias("waits"), F.count_if(F.col("gate").isNull()).alias("unknown"))
    state = saved(gates.join(parts.where("unknown = 0").drop("unknown"), ["tree", "node"]))
    links = saved(met.where("gate").select("tree", "node", "child"))
    done = lambda df: df.where("waits = 0").withColumn("parts", F.array_sort("parts")).select("tree", "node", *[combined(c) for c in values])
    out = [done(state)]
    if links.head(1):
        out[0] = saved(out[0])
    while links.head(1) and out[-1].head(1):
        told = out[-1].select("tree", F.col("node").alias("child"), F.struct("node", *values).alias("part"))
        told = links.join(told, ["tree", "child"]).groupBy("tree", "node").agg(F.collect_list("part").alias("more"), F.count("*").alias("less"))
        state = saved(state.where("waits > 0").join(told, ["tree", "node"], "left").withColumns(
            {"parts": F.when(F.col("more").isNull(), F.col("parts")).otherwise(F.concat("parts", "more")), "waits": F.col("waits") - F.coalesce("less", F.lit(0))}).drop("more", "less"))
        out.append(saved(done(state)))
    return reduce(DataFrame.unionByName, out)


def _joined(c: Column) -> Column:
    """What a gate's children, as an array of their values in order, give by its kind, k and beta."""
    product = F.aggregate(c, F.lit(1.0), lambda a, x: a * x)
    none = F.aggregate(c, F.lit(1.0), lambda a, x: a * (1 - x))
    alone = F.when(F.col("kind") == "series", product).when(F.col("kind") == "parallel", 1 - none).otherwise(vote_probability(c, F.col("k").cast("int")))
    return (1 - F.col("beta")) * alone + F.col("beta") * F.array_min(c)


def block_reliability(blocks: DataFrame, gates: DataFrame, inputs: DataFrame) -> DataFrame:
    """(diagram, node, value, low, high) of every gate, from blocks (tree, node, value, low, high): success probabilities,
    such as exp(-rate * time), or availabilities.

    Gates are series, parallel or vote (at least k); beta is the share of a gate that fails with its weakest input alone."""
    rows = _upwards(blocks, gates, inputs, ["value", "low", "high"], lambda c: _joined(F.col("parts")[c]).alias(c))
    return rows.withColumnRenamed("tree", "diagram")


def block_importance(blocks: DataFrame, gates: DataFrame, inputs: DataFrame, top: str = "top") -> DataFrame:
    """(diagram, block, importance): what a sure success of the block adds to the top over a sure failure.

    A gate carries its value and, for each block below it, its values with that block forced to fail and to succeed; so a
    block costs one row a level rather than copies of its tree.  A block that is not below the top adds nothing."""
    forced = F.array(F.struct(F.col("node").alias("block"), F.lit(0.0).alias("off"), F.lit(1.0).alias("on")))
    parts = F.col("parts")

    def combined(c: str) -> Column:
        if c == "value":
            return _joined(parts["value"]).alias(c)
        # the children's values with block b forced
        child = lambda x, b, way: F.coalesce(F.get(F.filter(x["forced"], lambda f: f["block"] == b), F.lit(0)), F.struct(b.alias("block"), x["value"].alias("off"), x["value"].alias("on")))[way]
        at = lambda b, way: _joined(F.transform(parts, lambda x: child(x, b, way)))
        below = F.array_distinct(F.flatten(F.transform(parts, lambda x: x["forced"]["block"])))
        return F.transform(below, lambda b: F.struct(b.alias("block"), at(b, "off").alias("off"), at(b, "on").alias("on"))).alias(c)

    rows = saved(_upwards(blocks.select("tree", "node", "value", forced.alias("forced")), gates, inputs, ["value", "forced"], combined).where(F.col("node") == top).select("tree", "forced"))
    moved = rows.select("tree", F.explode("forced").alias("f")).select("tree", F.col("f.block").alias("block"), F.struct(F.lit(True).alias("below"), (F.col("f.on") - F.col("f.off")).alias("importance")).alias("x"))
    others = blocks.select("tree", F.col("node").alias("block"), F.struct(F.lit(False).alias("below"), F.lit(0.0).alias("importance")).alias("x")).join(rows.select("tree"), "tree", "left_semi")
    return moved.unionByName(others).groupBy(F.col("tree").alias("diagram"), "block").agg(F.max("x")["importance"].alias("importance"))
