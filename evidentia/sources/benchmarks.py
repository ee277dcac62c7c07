"""Results of benchmark suites and logs of evaluations, in whatever layout, as flat tables.

A record is read as one variant value, so names that a layout spells in several ways, values of mixed types and maps with
arbitrary keys need no schema.  Rows that can't be read are kept, with the reason in ``reject``; nothing is dropped."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What counts as true, as false, and as an outcome.
TRUE, FALSE = ("1", "true", "yes", "pass", "passed", "positive"), ("0", "false", "no", "fail", "failed", "negative")
OUTCOMES = ("success", "failure", "incomplete", "error", "not_reported")
_RESULT = ("case_id", "expected", "predicted", "passed", "resolved", "coverage_delta", "mutation_score", "outcome")


def at(value: Column | str, *names: str, kind: str = "string") -> Column:
    """The first of a record's fields that is there and not null."""
    return F.coalesce(*[F.try_variant_get(value, f'$["{n}"]', kind) for n in names])


def filled(value: Column | str, *names: str) -> Column:
    """The first of a record's fields that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get(value, f'$["{n}"]', "string"), F.lit("")) for n in names])


def has(value: Column | str, name: str) -> Column:
    """Whether a record has a field, be it null."""
    return F.array_contains(F.coalesce(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<string>")), name)


def truth(text: Column) -> Column:
    """A word as truth value; null if it is none."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def _detections(v: Column) -> dict[str, Column]:
    return {"case_id": filled(v, "testCaseName", "test_case", "id"), "expected": at(v, "realVulnerability", "expected"), "predicted": at(v, "toolFound", "predicted")}


def _flaky_tests(v: Column) -> dict[str, Column]:
    test = filled(v, "Pytest Test Name (PathToFile::TestClass::TestMethod or PathToFile::TestMethod)", "test_name")
    project = F.concat(filled(v, "Project URL", "project_url"), F.lit("@"), filled(v, "SHA Detected", "sha_detected"))
    return {"case_id": F.concat(project, F.lit("::"), test), "expected": F.lit("true")}


def _instances(v: Column) -> dict[str, Column]:
    return {"case_id": filled(v, "instance_id", "task_id", "id"), "passed": at(v, "passed", "resolved"), "resolved": at(v, "resolved")}


def _lists(v: Column) -> dict[str, Column]:
    return _instances(v) | {"outcome": at(v, "outcome")}


def _keyed(v: Column) -> dict[str, Column]:
    resolved = F.coalesce(at(v, "resolved"), F.try_variant_get(v, "$.report.resolved", "string"))
    return {"case_id": filled(v, "instance_id", "task_id", "id"), "passed": resolved, "resolved": resolved}


def _attacks(v: Column) -> dict[str, Column]:
    none = lambda name: F.coalesce(filled(v, name), F.lit("none"))
    made = F.concat(filled(v, "suite_name"), F.lit("/"), filled(v, "user_task_id"), F.lit("/"), none("attack_type"), F.lit("/"), none("injection_task_id"))
    both = has(v, "utility") & has(v, "security")
    return {"case_id": F.when(both, F.coalesce(filled(v, "case_id", "id"), made)), "passed": at(v, "security"), "resolved": at(v, "utility")}


def _generated_tests(v: Column) -> dict[str, Column]:
    return {"case_id": filled(v, "task_id", "instance_id", "id"), "passed": at(v, "passed"), "coverage_delta": at(v, "coverage_delta"), "mutation_score": at(v, "mutation_score")}


def _trials(v: Column) -> dict[str, Column]:
    """One reward of zero or one; an exception is an error, a trial without an end incomplete."""
    sound = ~has(v, "step_results") | (at(v, "step_results").isin("[]", "{}", "false", "0", "")) | at(v, "step_results").isNull()
    named = reduce(lambda a, b: a & b, [F.trim(at(v, n)) != "" for n in ("task_name", "trial_name", "id")]) & at(v, "task_checksum").rlike("^[0-9a-f]{64}$")
    kept = (at(v, "config") != "{}") & filled(v, "config").isNotNull() & (F.try_variant_get(v, "$.agent_info.name", "string") != "") & (F.try_variant_get(v, "$.agent_info.version", "string") != "")
    rewards = F.try_variant_get(v, "$.verifier_result.rewards", "map<string,variant>")
    reward = F.try_variant_get(v, "$.verifier_result.rewards.reward", "double")
    numeric = F.schema_of_variant(F.try_variant_get(v, "$.verifier_result.rewards.reward", "variant")) != "BOOLEAN"
    scored = (F.size(rewards) == 1) & reward.isin(0.0, 1.0) & numeric
    error, ended = at(v, "exception_info").isNotNull(), filled(v, "finished_at").isNotNull()
    outcome = F.when(error, "error").when(~ended, "incomplete").when(scored & (reward == 1), "success").when(scored, "failure")
    fine = F.coalesce(sound & named & kept & outcome.isNotNull(), F.lit(False))
    passed = F.when(outcome == "success", "true").when(outcome == "failure", "false")
    case_id = F.concat(at(v, "task_name"), F.lit("@"), at(v, "task_checksum"), F.lit("/"), at(v, "trial_name"))
    return {"case_id": F.when(fine, case_id), "passed": passed, "resolved": passed, "outcome": outcome}


#: How each layout's records become results.
LAYOUTS: dict[str, Callable[[Column], dict[str, Column]]] = {
    "detections": _detections, "flaky_tests": _flaky_tests, "instances": _instances, "id_lists": _lists, "keyed": _keyed, "attacks": _attacks,
    "generated_tests": _generated_tests, "trials": _trials,
}
#: Lists of identifiers, and what being in one means for ``resolved`` (null: nothing) and for the outcome.
ID_LISTS = (("success_ids", "true", "success"), ("failure_ids", "false", "failure"), ("incomplete_ids", None, "incomplete"), ("error_ids", None, "error"))


def read_records(spark: SparkSession, path: str, kind: str, keyed: bool = False) -> DataFrame:
    """(file, record): the records of csv, jsonl or json files as variant values; a line or document that can't be read is a null record.

    A json document is a list of records, or holds one under ``results`` or ``cases``.  If ``keyed``, that may also be an object of
    records by identifier (or of plain truth values), or the document itself."""
    file = F.input_file_name().alias("file")
    if kind == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return rows.select(file, F.try_parse_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("record"))
    if kind == "jsonl":
        return spark.read.text(path).where("trim(value) <> ''").select(file, F.try_parse_json("value").alias("record"))
    if kind != "json":
        raise ValueError("kind is csv, json or jsonl")
    docs = spark.read.text(path, wholetext=True).select(file, F.try_parse_json("value").alias("d"))
    inner = F.coalesce(*[F.try_variant_get("d", p, "variant") for p in ("$.results", "$.cases", *(["$"] if keyed else []))])
    lists = F.coalesce(F.try_variant_get("d", "$", "array<variant>"), F.try_variant_get(inner, "$", "array<variant>"))
    none = F.array(F.lit(None).cast("variant"))
    if not keyed:
        return docs.select("file", F.explode(F.coalesce(lists, none)).alias("record"))
    entries = F.map_entries(F.try_variant_get(inner, "$", "map<string,variant>"))
    # an entry's record gets its key as identifier; a plain value is the record's resolved
    told = F.transform(entries, lambda e: F.coalesce(
        F.try_parse_json(F.when(F.try_variant_get(e["value"], "$", "map<string,variant>").isNotNull(), F.concat(
            F.lit('{"instance_id":'), F.to_json(e["key"].cast("variant")), F.when(F.to_json(e["value"]) == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(F.to_json(e["value"]), 2, 1 << 30)))))),
        F.try_parse_json(F.concat(F.lit('{"instance_id":'), F.to_json(e["key"].cast("variant")), F.lit(',"resolved":'), F.to_json(e["value"]), F.lit("}")))))
    return docs.select("file", F.explode(F.coalesce(lists, told, none)).alias("record"))


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, record) of documents that list identifiers by outcome; each becomes a record."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("d"))
    one = lambda resolved, outcome: lambda i: F.struct(i.alias("instance_id"), F.lit(resolved).alias("resolved"), F.lit(outcome).alias("outcome"))
    empty = F.array().cast("array<struct<instance_id:string,resolved:string,outcome:string>>")
    lists = [F.coalesce(F.transform(F.try_variant_get("d", f"$.{name}", "array<string>"), one(resolved, outcome)), empty) for name, resolved, outcome in ID_LISTS]
    bad = F.array(F.lit(None).cast("struct<instance_id:string,resolved:string,outcome:string>"))
    rows = docs.select("file", F.explode(F.when(F.col("d").isNull(), bad).otherwise(F.concat(*lists))).alias("r"))
    return rows.select("file", F.try_parse_json(F.to_json("r")).alias("record"))


def read_results(spark: SparkSession, path: str, layout: str, kind: str) -> DataFrame:
    """(file, case_id, expected, predicted, passed, resolved, coverage_delta, mutation_score, outcome, reject) of a suite's results.

    A record without an identifier, with a word that is no truth value, a metric that is no finite number or an unknown
    outcome is rejected: its reason says which, and its values are null."""
    records = read_id_lists(spark, path) if layout == "id_lists" else read_records(spark, path, kind, keyed=layout == "keyed")
    own = LAYOUTS[layout](F.col("record"))
    raw = records.select("file", "record", *[own.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in _RESULT])
    reasons = [F.when(F.col("record").isNull(), "unreadable"), F.when(F.coalesce(F.trim("case_id"), F.lit("")) == "", "no identifier")]
    reasons += [F.when(F.col(c).isNotNull() & truth(F.col(c)).isNull(), f"no truth value: {c}") for c in ("expected", "predicted", "passed", "resolved")]
    number = lambda c: F.nullif(F.col(c), F.lit("")).try_cast("double")
    finite = lambda c: F.abs(number(c)) < float("inf")
    reasons += [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.when(~F.coalesce(finite(c), F.lit(False)), f"no number: {c}")) for c in ("coverage_delta", "mutation_score")]
    outcome = F.coalesce(F.nullif(F.trim("outcome"), F.lit("")), F.lit("not_reported"))
    reasons.append(F.when(~outcome.isin(*OUTCOMES), "unknown outcome"))
    raw = raw.withColumn("reject", F.coalesce(*reasons))
    good = F.col("reject").isNull()
    label = lambda c: F.when(good, F.when(truth(F.col(c)), "positive").when(~truth(F.col(c)), "negative")).alias(c)
    return raw.select("file", F.when(good, F.col("case_id")).alias("case_id"), label("expected"), label("predicted"), *[F.when(good, truth(F.col(c))).alias(c) for c in ("passed", "resolved")],
                      *[F.when(good, number(c)).alias(c) for c in ("coverage_delta", "mutation_score")], F.when(good, outcome).alias("outcome"), "reject")


#: What is read of a sample, and of a record of tokens, in one go; what isn't of its type is null by itself.
_COUNTS = ("input_tokens", "prompt_tokens", "output_tokens", "completion_tokens", "total_tokens")
_USAGE = f"struct<{','.join(f'{n}:string' for n in _COUNTS)}>"
_SAMPLE = ("struct<uuid:string,id:string,sample_id:string,epoch:double,error:string,scores:map<string,variant>,events:array<struct<event:string,type:string>>,"
           "model_usage:variant,usage:variant,messages:variant>")


def _tokens(records: Column, *names: str) -> Column:
    """A count of tokens, summed over records."""
    # by way of text, since a flag isn't a number
    one = lambda v: F.coalesce(*[v[n].try_cast("double") for n in names], F.lit(0.0)).cast("long")
    return F.coalesce(F.aggregate(records, F.lit(0).cast("long"), lambda a, v: a + one(v)), F.lit(0).cast("long"))


def read_eval_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample of evaluation logs: (file, run_id, eval_id, task, model, sample_id, epoch, scores, tool_events, input_tokens,
    output_tokens, total_tokens, messages_sha256, error, completed, reject).

    Scores are (name, value, answer, explanation) by name.  Without a total the total is input and output together.  A
    document without metadata or samples is one row with its reason; a sample and epoch that occur again are rejected."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("d"))
    about = F.try_variant_get("d", "$.eval", "variant")
    docs = docs.withColumn("samples", F.try_variant_get("d", "$.samples", f"array<{_SAMPLE}>"))
    bad = F.when(F.col("d").isNull(), "unreadable").when(F.try_variant_get(about, "$", "map<string,variant>").isNull() | F.col("samples").isNull(), "no metadata or samples")
    unknown = F.lit("unassigned")
    # what is said once a document is taken before its samples are told apart
    docs = docs.select(
        "file", bad.alias("bad"), F.coalesce(at(about, "run_id"), F.try_variant_get("d", "$.run_id", "string"), unknown).alias("run_id"),
        F.coalesce(at(about, "eval_id"), F.try_variant_get("d", "$.eval_id", "string"), unknown).alias("eval_id"), F.coalesce(at(about, "task", "task_name"), unknown).alias("task"),
        F.coalesce(at(about, "model"), unknown).alias("model"), F.when(bad.isNull(), F.col("samples")).alias("samples"))
    rows = docs.select("file", "bad", "run_id", "eval_id", "task", "model", F.posexplode_outer("samples").alias("place", "s"))
    rows = rows.where(F.col("bad").isNotNull() | F.col("place").isNotNull())
    s = F.col("s")
    usage = F.coalesce(s["model_usage"], s["usage"])
    # a sample's records of tokens are its models', or its one; each step is a column, or it would be made once for each use
    rows = rows.withColumn("models", F.map_values(F.try_variant_get(usage, "$", f"map<string,{_USAGE}>")))
    nested = (F.size("models") > 0) & F.forall("models", lambda v: v.isNotNull())
    rows = rows.withColumn("records", F.when(nested, F.col("models")).otherwise(F.array(F.try_variant_get(usage, "$", _USAGE))))

    def score(e):
        own, plain = F.try_variant_get(e["value"], "$", "struct<value:string,answer:string,explanation:string>"), F.try_variant_get(e["value"], "$", "string")
        return F.struct(e["key"].alias("name"), F.when(own.isNull(), plain).otherwise(own["value"]).alias("value"), own["answer"].alias("answer"), own["explanation"].alias("explanation"))

    none = F.array().cast("array<struct<name:string,value:string,answer:string,explanation:string>>")
    events = F.coalesce(s["events"], F.array().cast("array<struct<event:string,type:string>>"))
    tools = F.filter(events, lambda e: F.lower(F.coalesce(e["event"], e["type"], F.lit(""))).isin("tool", "tool_call", "toolcall", "tool_event"))
    epoch = F.coalesce(F.nullif(s["epoch"].cast("long"), F.lit(0)), F.lit(1))
    told = rows.select(
        "file", "run_id", "eval_id", "task", "model", "bad", F.coalesce(s["uuid"], s["id"], s["sample_id"], F.col("place").cast("string")).alias("sample_id"), epoch.cast("long").alias("epoch"),
        F.array_sort(F.coalesce(F.transform(F.map_entries(s["scores"]), score), none)).alias("scores"),
        F.size(tools).cast("long").alias("tool_events"), _tokens(F.col("records"), "input_tokens", "prompt_tokens").alias("input_tokens"),
        _tokens(F.col("records"), "output_tokens", "completion_tokens").alias("output_tokens"), _tokens(F.col("records"), "total_tokens").alias("total"),
        F.sha2(F.to_json(s["messages"]), 256).alias("messages_sha256"), s["error"].alias("error"), (F.coalesce(s["error"], F.lit("")) == "").alias("completed"))
    # counted beside the rows, so that documents are read once
    told = told.withColumn("same", F.count("*").over(Window.partitionBy("file", "sample_id", "epoch")))
    reject = F.coalesce("bad", F.when(F.col("same") > 1, "sample and epoch occur again"))
    return told.select("file", "run_id", "eval_id", "task", "model", "sample_id", "epoch", "scores", "tool_events", "input_tokens", "output_tokens",
                       F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "messages_sha256", "error", "completed", reject.alias("reject"))


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries (kind, entry_id, name, status, abstraction, deprecated, reject) of weakness and attack pattern catalogues in XML, and their
    links (kind, entry_id, target_kind, target_id, nature, view_id), each once.

    An entry whose identifier is no number or not unique, or without name or status, is rejected."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    weakness = "struct<Related_Weakness:array<struct<_CWE_ID:string,_Nature:string,_View_ID:string>>>"
    pattern = "struct<Related_Attack_Pattern:array<struct<_CAPEC_ID:string,_Nature:string,_View_ID:string>>>"
    head = "_ID string, _Name string, _Status string, _Abstraction string"
    out, links = [], []
    for kind, tag in (("cwe", "Weakness"), ("capec", "Attack_Pattern")):
        rows = xml(tag, f"{head}, Related_Weaknesses {weakness}, Related_Attack_Patterns {pattern}")
        trimmed = lambda c: F.coalesce(F.trim(c), F.lit(""))
        rows = rows.withColumn("entry_id", trimmed("_ID"))
        same = rows.groupBy("entry_id").agg(F.count("*").alias("same"))
        reject = F.when(~F.col("entry_id").rlike("^[0-9]+$"), "no number").when(F.col("same") > 1, "not unique").when((trimmed("_Name") == "") | (trimmed("_Status") == ""), "incomplete")
        out.append(rows.join(same, "entry_id").select(F.lit(kind).alias("kind"), "entry_id", trimmed("_Name").alias("name"), trimmed("_Status").alias("status"), trimmed("_Abstraction").alias("abstraction"),
                                                      F.lower(trimmed("_Status")).isin("deprecated", "obsolete").alias("deprecated"), reject.alias("reject")))
        related = [("cwe", "Related_Weaknesses.Related_Weakness", "_CWE_ID")] + ([("capec", "Related_Attack_Patterns.Related_Attack_Pattern", "_CAPEC_ID")] if kind == "capec" else [])
        for target, column, name in related:
            each = rows.select("entry_id", F.explode(column).alias("r"))
            nature = F.coalesce(F.lower(F.trim("r._Nature")), F.lit("related"))
            links.append(each.select(F.lit(kind).alias("kind"), "entry_id", F.lit(target).alias("target_kind"), trimmed(f"r.{name}").alias("target_id"), nature.alias("nature"), trimmed("r._View_ID").alias("view_id")))
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    return union(out), union(links).where(F.col("target_id").rlike("^[0-9]+$")).distinct()
