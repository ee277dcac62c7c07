"""Scalar expressions of assurance evidence, all from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rpn(severity: Column, occurrence: Column, detection: Column) -> Column:
    """Risk priority number; null unless all three are ratings from 1 to 10."""
    return F.when(severity.between(1, 10) & occurrence.between(1, 10) & detection.between(1, 10), severity * occurrence * detection)


def stable_id(prefix: str, *parts: Column, size: int = 12) -> Column:
    """PREFIX- and the first hexadecimal digits, in capitals, of the SHA-256 of the parts with unit separators between."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, size)))


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def normalize_endpoint(url: Column) -> Column:
    """Path of an address with parameters unified; '' for what is no path."""
    path = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    path = F.regexp_replace(path, r"\$?\{[^/}]*\}|:[A-Za-z_][A-Za-z0-9_]*", "{parameter}")
    path = F.regexp_replace(path, "/+", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(path.startswith("/"), path).otherwise("")


def normalize_package(name: Column) -> Column:
    return F.translate(F.lower(name), "_.", "--")


def purl_parts(purl: Column) -> Column:
    """struct(ecosystem, name, version) of a package address pkg:type/name@version."""
    body = F.regexp_replace(purl, r"[?#].*$", "")
    part = lambda n: F.nullif(F.url_decode(F.regexp_extract(body, r"^pkg:([^/]+)/([^@]+)(?:@(.+))?$", n)), F.lit(""))
    return F.struct(F.lower(part(1)).alias("ecosystem"), part(2).alias("name"), part(3).alias("version"))


def release_key(version: Column) -> Column:
    """Numbers of a plain release, trailing zeros dropped, as a comparable array; null for anything else."""
    plain = F.regexp_replace(version, r"(\.0+)+$", "")
    return F.when(version.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.split(plain, r"\.").cast("array<bigint>"))


def version_in_range(version: Column, events: Column) -> Column:
    """affected, not_affected or unresolved after folding an array of struct(kind, version) over a version."""
    own = release_key(version)

    def step(state: Column, e: Column) -> Column:
        at = release_key(e["version"])
        known = e["kind"].isin("introduced", "fixed", "last_affected", "limit") & at.isNotNull()
        out = F.when((e["kind"] == "introduced") & (own >= at), "affected").when(e["kind"].isin("fixed", "limit") & (own >= at), "not_affected").when((e["kind"] == "last_affected") & (own > at), "not_affected").otherwise(state)
        return F.when(state == "unresolved", state).when(known, out).otherwise("unresolved")

    return F.when(own.isNull(), "unresolved").otherwise(F.aggregate(events, F.lit("not_affected"), step))


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric words of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared among all; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def csv_safe(text: Column) -> Column:
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end
        else:
            out += "\\" + c if not c.isalnum() and c != "_" else c
        i += 1
    return f"(?s)^{out}$"


def glob_match(text: Column, patterns: list[str], fold: bool = False) -> Column:
    """Whether any pattern matches the whole text."""
    text = F.lower(text) if fold else text
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(glob_to_regex(p.lower() if fold else p))
    return found


def selector_match(rule: Column, selector: Column) -> Column:
    """'*', 'prefix.*' or the rule itself."""
    prefix = F.substring_index(selector, "*", 1)
    return (selector == "*") | (rule == selector) | (selector.endswith(".*") & rule.startswith(prefix))


def span_timing(start: Column, end: Column) -> Column:
    """struct(status, duration): unavailable, invalid or observed."""
    a, b = start.try_cast("bigint"), end.try_cast("bigint")
    status = F.when(a.isNull() | b.isNull(), "unavailable").when(b < a, "invalid").otherwise("observed")
    return F.struct(status.alias("status"), F.when(status == "observed", b - a).alias("duration"))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, letter in ((60, "D"), (70, "C"), (80, "B"), (90, "A")):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def pct_change(current: Column, base: Column) -> Column:
    return F.when(base == 0, F.when(current == 0, 0.0).otherwise(100.0)).otherwise(F.round((current - base) / base * 100, 3))


def source_area(path: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, 3), "/")


def priority_score(priority: Column) -> Column:
    return F.when(priority == "high", 8).when(priority == "medium", 3).when(priority == "low", 1).when(priority == "manual", 2).otherwise(0)


def redact(text: Column, patterns: list[str], most: int = 2000) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return F.substring(text, 1, most)


def claim_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def measure_pass(value: Column, uncertainty: Column, threshold: Column, direction: Column) -> Column:
    """Guard-banded comparison; target means within the uncertainty."""
    return F.when(direction == "minimum", value - uncertainty >= threshold).when(direction == "maximum", value + uncertainty <= threshold).otherwise(F.abs(value - threshold) <= uncertainty)


def zscore_status(value: Column, assigned: Column, sd: Column, warn: float = 2.0, action: float = 3.0) -> Column:
    z = F.abs((value - assigned) / F.nullif(sd, F.lit(0.0)))
    return F.when(z.isNull(), "unavailable").when(z > action, "action").when(z > warn, "warning").otherwise("acceptable")


def strict_instant(text: Column) -> Column:
    """A timestamp from ISO text with an offset; null without one."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def taxa_or_rule(taxa: Column, rule: Column) -> Column:
    return F.when(F.size(taxa) > 0, taxa).otherwise(F.array(rule))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of the score interval; null for n = 0."""
    p = k / F.nullif(n, F.lit(0))
    middle, d = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (middle - half) / d), F.least(F.lit(1.0), (middle + half) / d)
    return F.when(n > 0, F.struct(low.alias("low"), high.alias("high")))


def ratio(a: Column, b: Column) -> Column:
    """Null where nothing was counted."""
    return F.when(b != 0, a / b)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, by Stirling's series eight steps up."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    down = x
    for i in range(1, 8):
        down = down * (x + float(i))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(down)


def binomial_p(k: Column, n: Column) -> Column:
    """Exact two-sided p of the lesser count k among n at one half.

    The tail is summed from its greatest term down; terms beyond some 40 standard deviations are nothing, so the sum is as
    long as the root of n, and a count of millions neither underflows nor makes a long array."""
    x, m = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(m + 1) - log_gamma(x + 1) - log_gamma(m - x + 1) - m * F.log(F.lit(2.0)))
    steps = F.least(k.cast("long"), F.ceil(F.sqrt(m) * 20) + 20)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (x - i + 1) / (m - x + i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    relative = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * first * relative))


def vote_probability(p: Column, k: Column) -> Column:
    """Probability that at least k of independent events of these probabilities occur."""
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), F.size(p)))

    def step(dist: Column, x: Column) -> Column:
        return F.transform(dist, lambda d, i: d * (1 - x) + F.when(i > 0, F.get(dist, i - 1) * x).otherwise(0.0))

    return F.aggregate(F.slice(F.aggregate(p, start, step), k + 1, F.size(p) + 1), F.lit(0.0), lambda a, x: a + x)


#: File name rules, first that fits decides; the patterns are for the lower-case path.
ARTIFACT_KINDS = [
    ("python_test", r"(^|/)(tests?/.*|test_[^/]*|[^/]*_test)\.py$"), ("python_source", r"\.py$"), ("typescript_source", r"\.tsx?$"), ("javascript_source", r"\.(js|jsx|mjs|cjs)$"),
    ("stylesheet", r"\.(css|scss|sass|less)$"), ("user_interface", r"\.html?$"),
    ("dependency_manifest", r"(^|/)(pyproject\.toml|poetry\.lock|pdm\.lock|pipfile|pipfile\.lock|uv\.lock|setup\.cfg|requirements[^/]*|constraints[^/]*)$"),
    ("ci_configuration", r"^\.github/workflows/|(^|/)(\.gitlab-ci\.yml|azure-pipelines\.yml|jenkinsfile)$"), ("container_or_deployment", r"(^|/)(dockerfile[^/]*|(docker-)?compose\.ya?ml)$"),
    ("infrastructure", r"\.(tf|tfvars)$|k8s/|kubernetes/|manifests/|helm/templates/|(^|/)(configmap|cronjob|daemonset|deployment|ingress|job|namespace|secret|service|statefulset)\.ya?ml$"),
    ("api_or_data_schema", r"(openapi|swagger)[^/]*$|\.schema\.json$|\.(proto|graphql|graphqls|avsc)$|(^|/)asyncapi[^/]*$"), ("database_schema_or_migration", r"migration|\.sql$"),
    ("documentation", r"\.(md|rst|adoc|txt)$"), ("static_analysis_result", r"\.sarif$|sarif\.json$"), ("coverage_result", r"coverage[^/]*\.(json|xml|lcov)$"), ("test_result", r"junit[^/]*$|test-result|test_result"),
    ("configuration", r"\.(toml|ya?ml|json|ini|cfg|env)$"), ("binary_or_generated", r"\.(png|jpe?g|gif|webp|pdf|zip|gz|whl|exe|dll|so|pyd)$"),
]


def artifact_kind(path: Column) -> Column:
    """What kind of file a path is, by ordered rules; 'unclassified' if none fits."""
    out = F.lit("unclassified")
    for kind, pattern in reversed(ARTIFACT_KINDS):
        out = F.when(F.lower(path).rlike(pattern), kind).otherwise(out)
    return out


def evidence_posture(assurance: Column, evidence: Column, latest: Column, reviewed: Column, executions: Column, implemented: Column, tests: Column, covered: Column) -> Column:
    """What a finding's verification amounts to, from the sets of its obligations' and evidence's states, its latest execution and
    flags; the first rule that fits decides."""
    has = lambda c, *xs: F.arrays_overlap(c, F.array(*[F.lit(x) for x in xs]))
    idle = (F.size(assurance) > 0) & F.forall(assurance, lambda a: a.isin("not_applicable", "retired"))
    rules = [
        (has(assurance, "verified", "closed") & has(evidence, "sufficient"), "verified_with_sufficient_evidence"), (has(assurance, "accepted_risk"), "risk_accepted_not_verification_evidence"), (idle, "not_applicable"),
        (latest.isin("failed", "timeout", "error"), "execution_failed"), ((latest == "passed") & reviewed, "reviewed_execution_recorded"), (latest == "passed", "execution_review_pending"), (executions > 0, "execution_recorded"),
        (implemented, "implementation_registered"), (tests & covered, "candidate_tests_and_coverage"), (tests, "candidate_tests_only"), (covered, "coverage_observation_only"),
    ]
    out = F.lit("no_verification_signal")
    for test, name in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out
