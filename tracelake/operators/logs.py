"""Log operators: messages out of payloads, masks, signatures and templates, and what changed between periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import beside, least_values
from ..functions.lineage import cut

# Names of message fields, in order of priority.
MESSAGE_FIELDS = [
    "message", "msg", "log", "text", "body", "error", "error_message", "errorMessage", "description",
    "content", "data", "payload", "event", "detail", "details", "reason", "summary", "info",
]
# What a log message tends to hold.
MESSAGE_SIGNS = [
    r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}", r"\[(?:INFO|WARN|ERROR|DEBUG|TRACE)\]",
    r"(?:Exception|Error|Failed|Success|Started|Completed)", r"(?:GET|POST|PUT|DELETE|PATCH)\s+/",
]
# Masks of signatures, in order.
SIGNATURE_MASKS = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\d+", "<NUM>"),
    (r"[\w.-]+@[\w.-]+\.\w+", "<EMAIL>"),
]
# Masks of template variables, in order.
VARIABLE_MASKS = [
    (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"\b\d{4}-\d{2}-\d{2}", "<DATE>"),
    (r"\b\d{2}:\d{2}:\d{2}", "<TIME>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b[0-9a-f]{24,}\b", "<ID>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"\b\d+\.\d+ms\b", "<DURATION>"),
    (r"\b\d+ms\b", "<DURATION>"),
    (r"\"\w+@\w+\.\w+\"", "<EMAIL>"),
]
# Fixed values: (keyword, category, severity) of findings.
FINDING_RULES = [
    ("OOMKilled", "memory", "high"), ("out of memory", "memory", "high"), ("memory limit", "memory", "high"),
    ("cpu throttl", "cpu", "medium"), ("cpu limit", "cpu", "medium"), ("cpu saturat", "cpu", "medium"),
    ("connection pool", "database", "high"), ("pool exhausted", "database", "high"), ("max connections", "database", "high"), ("connection timeout", "database", "high"),
    ("timeout", "performance", "high"), ("high latency", "performance", "high"), ("slow query", "performance", "high"), ("deadline exceeded", "performance", "high"),
    ("error rate", "errors", "high"), ("5xx", "errors", "high"), ("500 error", "errors", "high"), ("internal server error", "errors", "high"),
    ("cold start", "serverless", "medium"), ("startup latency", "serverless", "medium"), ("instance scaling", "serverless", "medium"),
    ("pending pod", "kubernetes", "high"), ("insufficient", "kubernetes", "high"), ("unschedulable", "kubernetes", "high"), ("node affinity", "kubernetes", "high"),
    ("message backlog", "messaging", "medium"), ("oldest unacked", "messaging", "medium"), ("subscription lag", "messaging", "medium"), ("dead letter", "messaging", "medium"),
    ("disk pressure", "storage", "high"), ("storage full", "storage", "high"), ("ephemeral storage", "storage", "high"), ("no space", "storage", "high"),
]
# Words of risky and harmless changes.
LOW_RISK = ["scale up", "increase replicas", "add instances", "increase memory", "increase cpu", "enable logging", "add monitoring"]
HIGH_RISK = ["delete", "remove", "disable", "migration", "schema change", "database migration", "breaking change"]


def masked(text: Column, masks: list[tuple[str, str]]) -> Column:
    for pattern, name in masks:
        text = F.regexp_replace(text, pattern, name)
    return text


def mask_variables(logs: DataFrame, column: str = "message") -> DataFrame:
    return logs.withColumn("masked", masked(F.col(column), VARIABLE_MASKS))


def log_signature_patterns(logs: DataFrame, body: Column, severity: str = "severity_text", limit: int | None = 100) -> DataFrame:
    """Log bodies with their variable parts masked, counted."""
    df = logs.select(masked(body, SIGNATURE_MASKS).alias("pattern_signature"), body.alias("body"), F.col(severity).alias("severity"), "timestamp")
    out = df.groupBy("pattern_signature").agg(F.count("*").alias("occurrence_count"), F.min("body").alias("sample_log"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return out if limit is None else out.orderBy(F.desc("occurrence_count"), "pattern_signature").limit(limit)


def _from_json_payload(json: Column) -> Column:
    """The message of a JSON payload: a known field; else its best-looking long string; else a known field one level down;
    else the payload itself, compact."""
    entries = F.map_entries(F.from_json(json, "map<string,variant>"))
    typed = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), F.schema_of_variant(e["value"]).alias("t"), e["value"].cast("string").alias("v")))
    strings = F.filter(typed, lambda e: (e["t"] == "STRING") & (F.length(e["v"]) > 0))
    names = F.array(*[F.lit(n) for n in MESSAGE_FIELDS])
    lower = F.array(*[F.lit(n.lower()) for n in MESSAGE_FIELDS])
    known = F.filter(strings, lambda e: F.array_contains(lower, F.lower(e["k"])))
    first = F.array_min(F.transform(known, lambda e, i: F.struct((F.array_position(lower, F.lower(e["k"])) * 2 - F.array_contains(names, e["k"]).cast("int")).alias("rank"), i.alias("i"), F.trim(e["v"]).alias("v"))))

    def score(e: Column) -> Column:
        n = F.length(e["v"])
        s = F.when((n > 20) & (n < 2000), F.least(F.floor(n / 20), F.lit(10))).otherwise(F.lit(0))
        hint = F.lit(False)
        for word in ("msg", "log", "text", "error"):
            hint = hint | F.contains(F.lower(e["k"]), F.lit(word))
        s = s + F.when(hint, 5).otherwise(0)
        for sign in MESSAGE_SIGNS:
            s = s + F.when(e["v"].rlike(f"(?i){sign}"), 3).otherwise(0)
        s = s - F.when(F.lower(e["k"]).isin("id", "timestamp", "time", "level", "severity"), 10).otherwise(0)
        return s - F.when(e["v"].rlike(r"(?i)^[a-f0-9-]{32,}$"), 5).otherwise(0)

    long = F.filter(strings, lambda e: F.length(e["v"]) > 10)
    best = F.array_max(F.transform(long, lambda e, i: F.struct(score(e).alias("score"), (-i).alias("i"), F.trim(e["v"]).alias("v"))))
    nested = F.filter(typed, lambda e: F.startswith(e["t"], F.lit("OBJECT")))
    inner = F.filter(F.flatten(F.transform(nested, lambda e: F.array(*[F.get_json_object(e["v"], f"$.{n}") for n in MESSAGE_FIELDS[:5]]))), lambda v: v.isNotNull() & (F.length(v) > 10))
    return F.coalesce(first["v"], F.when(best["score"] > 0, best["v"]), F.trim(F.get(inner, F.lit(0))), F.substring(F.to_json(F.try_parse_json(json)), 1, 500), F.substring(json, 1, 500))


def _from_proto_payload(json: Column) -> Column:
    g = lambda p: F.get_json_object(json, p)
    status = F.when(F.coalesce(g("$.status.code"), g("$.status.message")).isNotNull(), F.concat(F.lit("status="), F.coalesce(g("$.status.code"), F.lit("")), F.lit(": "), F.coalesce(g("$.status.message"), F.lit(""))))
    parts = F.concat_ws(" ", F.concat(F.lit("["), g("$.methodName"), F.lit("]")), g("$.resourceName"), F.concat(F.lit("("), g("$.serviceName"), F.lit(")")), status)
    return F.when(json.isNotNull(), F.when(parts != "", parts).otherwise(F.substring(json, 1, 500)))


def extract_log_message(entries: DataFrame) -> DataFrame:
    """Log entries with their message: of the text payload, even a blank one; else of the JSON, else of the protocol
    payload; else of a column payload, message or text, taken as JSON if it is an object."""
    json = F.when(F.col("jsonPayload").isNotNull(), _from_json_payload(F.col("jsonPayload")))
    other = [F.when(F.try_parse_json(c).isNotNull() & F.col(c).rlike(r"^\s*\{"), _from_json_payload(F.col(c))).otherwise(F.trim(c)) for c in ("payload", "message", "text") if c in entries.columns]
    return entries.withColumn("message", F.coalesce(F.trim("textPayload"), json, _from_proto_payload(F.col("protoPayload")), *other, F.lit("")))


def _shared_key(rows: DataFrame, group: list[str], id_col: str, share: float) -> DataFrame:
    """(id_col, key): of each row (id_col, group columns, tokens) its ``share`` of tokens that most rows of its group have at
    the same place, as a digest; null where the row has not that many tokens that it shares. <*> is shared with none.

    Rows with one key have at least that share of their tokens in common. Tokens are counted once a group, so no rows are
    held against each other; a token of a single row is not joined back. There is a record for each token of a row, so
    ``id_col`` is to be a number, not the row's text.
    """
    at = rows.select(id_col, *group, F.size("tokens").alias("_size"), F.posexplode("tokens").alias("pos", "token")).filter("token <> '<*>'")
    known = at.groupBy(*group, "pos", "token").agg(F.count("*").alias("n")).filter("n > 1")
    # a message is a few hundred tokens at most, so its own are gathered in its row
    each = at.join(known, [*group, "pos", "token"]).groupBy(id_col).agg(F.first("_size").alias("_size"), F.collect_list(F.struct((-F.col("n")).alias("rare"), "pos", "token")).alias("_at"))
    enough = F.ceil(F.col("_size") * F.lit(share)).cast("int")
    best = F.array_sort(F.transform(F.slice(F.array_sort("_at"), F.lit(1), enough), lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token"))))
    key = F.array_join(F.transform(best, lambda x: F.concat_ws(":", x["pos"], x["token"])), "\u0001")
    return each.select(id_col, F.when(F.size("_at") >= enough, F.unhex(F.md5(key.cast("binary")))).alias("key"))


def _merged(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, parts, shape): the tokens of each group's rows, <*> at places where they differ."""
    at = rows.select(*group, F.posexplode("tokens").alias("pos", "token")).groupBy(*group, "pos").agg(F.min("token").alias("a"), F.max("token").alias("b"), F.count("*").alias("parts"))
    one = F.struct("pos", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("<*>").alias("t"))
    return at.groupBy(*group).agg(F.max("parts").alias("parts"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("shape"))


def message_templates(messages: DataFrame, lead: int = 2, similarity: float = 0.4, across: float = 0.6, many: int = 10) -> DataFrame:
    """(m, template) of distinct masked messages (m).

    First among messages with as many tokens and the same ``lead`` first ones (those with digits are alike): messages that
    share the ``similarity`` share of their tokens which is most common there become one template, <*> where they differ.
    Then templates of one length, whatever they begin with, become one where at least ``many`` of them have the ``across``
    share of tokens in common: what takes so many values is a variable. A message that shares too little is its own
    template. Every template thus keeps that share of its tokens, and the order of the messages does not matter.
    """
    tokens = F.filter(F.split("m", r"\s+"), lambda t: t != "")
    head = F.transform(F.slice("tokens", 1, lead), lambda t: F.when(t.rlike(r"\d"), "<*>").otherwise(t))
    # texts are written once with numbers for them; what is counted and joined token by token has the numbers
    numbered = lambda df: cut(df.withColumn("id", F.monotonically_increasing_id()))
    keyed = numbered(messages.select("m", tokens.alias("tokens")).withColumn("lead", F.concat_ws("\u0001", F.size("tokens"), head)))
    keys = cut(_shared_key(keyed, ["lead"], "id", similarity).filter("key is not null"))
    found = keyed.select("id", "lead", "tokens").join(keys, "id")
    # a group of one row is its own shape
    several = keys.join(keyed.select("id", "lead"), "id").groupBy("lead", "key").agg(F.count("*").alias("n")).filter("n > 1").select("lead", "key")
    shapes = numbered(_merged(found.join(several, ["lead", "key"], "left_semi"), ["lead", "key"]).drop("parts"))
    of_shape = cut(found.select("id", "lead", "key").join(shapes.select("lead", "key", F.col("id").alias("shape_id")), ["lead", "key"]).select("id", "shape_id"))
    alone = keyed.join(of_shape, "id", "left_anti").select("tokens")
    distinct = numbered(shapes.select(F.col("shape").alias("tokens")).unionByName(alone).distinct().withColumn("size", F.size("tokens")))
    common = cut(_shared_key(distinct, ["size"], "id", across).filter("key is not null"))
    enough = common.join(distinct.select("id", "size"), "id").groupBy("size", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= many).select("size", "key")
    common = cut(distinct.join(common, "id").join(enough, ["size", "key"], "left_semi"))
    wide = common.select("id", "size", "key").join(_merged(common, ["size", "key"]).select("size", "key", F.array_join("shape", " ").alias("wider")), ["size", "key"]).select("id", "wider")
    text = lambda c: F.array_join(c, " ")
    first = keyed.select("m", "id", "tokens").join(of_shape, "id", "left").join(shapes.select(F.col("id").alias("shape_id"), "shape"), "shape_id", "left").select("m", text(F.coalesce("shape", "tokens")).alias("template"))
    wide = distinct.join(wide, "id").select(text("tokens").alias("template"), "wider")
    return first.join(wide, "template", "left").select("m", F.coalesce("wider", "template").alias("template"))


def template_patterns(logs: DataFrame, message: str = "message", severity: str = "severity", resource: str | None = None, min_count: int = 1, **clustering) -> DataFrame:
    """Log templates with counts, times, severities and samples.

    Messages are masked and counted; from then on a row stands for all that look alike. clustering: options of
    ``message_templates``, which puts them together. Templates may differ in detail from those of an online miner, which
    depend on the order of the messages; counts and severities do not.
    """
    masked_text = masked(F.col(message), VARIABLE_MASKS)
    tag = F.col(resource) if resource else F.lit(None).cast("string")
    base = logs.select(masked_text.alias("m"), F.col(message).alias("raw"), F.col(severity).alias("severity"), "timestamp", tag.alias("resource"))
    each = cut(base.groupBy("m", "severity", "resource").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.min(F.substring("raw", 1, 200)).alias("sample")))
    templates = message_templates(each.select("m").filter("m is not null").distinct(), **clustering)
    named = cut(each.join(templates, "m", "left").select(F.coalesce("template", F.lit("")).alias("template"), "severity", "resource", "n", "a", "b", "sample").withColumn("_t", F.unhex(F.md5(F.col("template").cast("binary")))))
    # groups are told by a digest of the template, whose text comes along in the counts alone
    sev = named.groupBy("_t", "severity").agg(F.min("template").alias("template"), F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    out = sev.groupBy("_t").agg(F.min("template").alias("template"), F.sum("n").alias("count"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"))
    out = beside(out, ["_t"], least_values(named, ["_t"], "sample", 5, "sample_messages"), least_values(named, ["_t"], "resource", 5, "resources")).drop("_t")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("sample_messages", "resources")})
    return out.filter(F.col("count") >= min_count).select(F.substring(F.md5(F.col("template").cast("binary")), 1, 8).alias("pattern_id"), "*")


def _severity_count(name: str) -> Column:
    return F.coalesce(F.col("severity_counts")[name], F.lit(0))


def severity_score() -> Column:
    return _severity_count("ERROR") * 10 + _severity_count("CRITICAL") * 20 + _severity_count("WARNING") * 5


def top_patterns(patterns: DataFrame, by: str = "count", limit: int = 50) -> DataFrame:
    """The first patterns by count, by severity (score), or by the latest message (recent)."""
    order = {"count": F.col("count"), "severity": severity_score(), "recent": F.col("last_seen")}[by]
    return patterns.orderBy(order.desc_nulls_last(), F.desc("count"), "pattern_id").limit(limit)


def compression_ratio(patterns: DataFrame) -> DataFrame:
    """One row: messages, patterns, and messages a pattern."""
    g = patterns.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_logs"), F.count("*").alias("total_patterns"))
    return g.withColumn("compression_ratio", F.round(F.col("total_logs") / F.greatest(F.col("total_patterns"), F.lit(1)), 2))


def compare_log_patterns(before: DataFrame, after: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Patterns of two periods as new, disappeared, increased, decreased or stable, by their share of all messages."""
    total = lambda df: df.agg(F.greatest(F.sum("count"), F.lit(1)).alias("total"))
    a = before.select("pattern_id", F.col("template").alias("t1"), F.col("count").alias("c1"))
    b = after.select("pattern_id", F.col("template").alias("t2"), F.col("count").alias("c2"), (_severity_count("ERROR") + _severity_count("CRITICAL")).alias("errors"))
    j = a.join(b, "pattern_id", "full_outer").crossJoin(F.broadcast(total(before).withColumnRenamed("total", "n1"))).crossJoin(F.broadcast(total(after).withColumnRenamed("total", "n2")))
    change = (F.col("c2") / F.col("n2") - F.col("c1") / F.col("n1")) / (F.col("c1") / F.col("n1"))
    kind = F.when(F.col("c1").isNull(), "new").when(F.col("c2").isNull(), "disappeared").when(change > threshold, "increased").when(change < -threshold, "decreased").otherwise("stable")
    return j.select("pattern_id", F.coalesce("t2", "t1").alias("template"), F.coalesce("c1", F.lit(0)).alias("baseline_count"), F.coalesce("c2", F.lit(0)).alias("count"), F.round(change * 100, 1).alias("change_pct"), F.coalesce("errors", F.lit(0)).alias("error_count"), kind.alias("change"))


def alert_level(comparison: DataFrame) -> DataFrame:
    """One row: HIGH with a new error pattern, MEDIUM with over five new patterns or one grown by over 200 %, else LOW."""
    g = comparison.agg(F.count_if(F.col("change") == "new").alias("new_patterns"), F.count_if((F.col("change") == "new") & (F.col("error_count") > 0)).alias("new_error_patterns"), F.count_if((F.col("change") == "increased") & (F.col("change_pct") > 200)).alias("surges"))
    return g.withColumn("alert_level", F.when(F.col("new_error_patterns") > 0, "HIGH").when((F.col("new_patterns") > 5) | (F.col("surges") > 0), "MEDIUM").otherwise("LOW"))


def log_anomalies(patterns: DataFrame, by: str = "severity", limit: int = 20) -> DataFrame:
    """The patterns that weigh most, by severity score or count."""
    df = patterns.select("pattern_id", "template", "count", severity_score().alias("severity_score"), (_severity_count("ERROR") > 0).alias("has_errors"), (_severity_count("WARNING") > 0).alias("has_warnings"))
    return df.orderBy(F.desc("severity_score" if by == "severity" else "count"), F.desc("count"), "pattern_id").limit(limit)


def pattern_summary(patterns: DataFrame, budget: int = 2000, limit: int = 100) -> DataFrame:
    """The most frequent patterns as ranked lines, as many as fit into ``budget`` characters (of the first ``limit``)."""
    top = patterns.orderBy(F.desc("count"), "pattern_id").limit(limit)
    marks = F.array_join(F.transform(F.map_entries("severity_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    w = Window.orderBy(F.desc("count"), "pattern_id")
    lines = top.withColumn("rank", F.row_number().over(w)).withColumn("line", F.concat(F.col("rank"), F.lit(". ("), F.col("count"), F.lit("x) ["), marks, F.lit("] "), F.col("template")))
    used = F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).filter(F.col("used") <= budget).select("rank", "line")


def classify_findings(logs: DataFrame, text: str = "message", rules: list[tuple[str, str, str]] = FINDING_RULES) -> DataFrame:
    """Rows that speak of a known problem, with the categories they match, most severe first."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(k.lower())), F.struct(F.lit(0 if s == "high" else 1).alias("o"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for k, c, s in rules]))
    return logs.withColumn("_h", F.array_sort(F.array_distinct(hits))).filter(F.size("_h") > 0).withColumn("categories", F.array_join(F.transform("_h", lambda h: h["category"]), ",")).withColumn("severity_class", F.col("_h")[0]["severity"]).drop("_h")


def suggest_remediation(findings: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """(key, rank, category, action, risk, effort, quick_win): what to do about each row's categories (as
    ``classify_findings`` joins them), least risk and then least effort first. actions: category, action, risk, effort."""
    order = lambda c: F.coalesce(F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col(c)) - 1, F.lit(1))
    each = findings.select(key, F.explode(F.split("categories", ",")).alias("category")).distinct().join(actions, "category")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order("risk"), order("effort"), "category", "action"))
    return each.select(key, rank.alias("rank"), "category", "action", "risk", "effort", ((F.col("risk") == "low") & (F.col("effort") == "low")).alias("quick_win"))


def _grams(text: str, sizes: list[int]) -> Column:
    """All parts of a text of the given lengths."""
    parts = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.array_distinct(F.flatten(F.array(*parts)))


def containments(needles: DataFrame, texts: DataFrame, size: int = 3) -> DataFrame:
    """(needle_id, text_id) of every needle (needle_id, needle) that stands in a text (text_id, text), compared as given. Empty
    needles stand in none.

    Texts are indexed by their parts of one to ``size`` characters. A needle is looked up under the one of its parts that the
    fewest texts have (a shorter needle under itself), and only what is met there is compared.
    """
    needles = needles.filter(F.length("needle") > 0)
    words = cut(needles.select("needle").distinct().withColumn("gram", F.explode(F.when(F.length("needle") < size, F.array("needle")).otherwise(_grams("needle", [size])))))
    index = texts.select("text_id", F.explode(_grams("text", list(range(1, size + 1)))).alias("gram"))
    index = cut(index.join(words.select("gram").distinct(), "gram", "left_semi"))
    known = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a needle with a part that no text has stands in none
    rarest = words.join(known, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("needle", F.col("r.gram").alias("gram"))
    met = rarest.join(index, "gram").join(texts, "text_id").filter(F.contains("text", F.col("needle"))).select("needle", "text_id")
    return needles.join(met, "needle").select("needle_id", "text_id").distinct()


def similar_incidents(patterns: DataFrame, incidents: DataFrame, since: str | None = None, service: str | None = None) -> DataFrame:
    """(pattern, incident) by mutual substring of pattern texts, of services whose name holds ``service``; patterns without
    any, by a word of theirs in a title or root cause. incidents: incident_id, pattern, title, root_cause, service, date.
    Empty texts are like nothing. Both sides may be of any size: pairs are found over an index of short parts."""
    inc = incidents if since is None else incidents.filter(F.col("date") >= since)
    of_service = F.lit(True) if service is None else F.contains(F.lower("service"), F.lit(service.lower()))
    inc = cut(inc)
    p, known = patterns.select("pattern_id", F.lower("template").alias("t")), inc.filter(of_service).select("incident_id", F.lower("pattern").alias("k"))
    needle = lambda df, i, c: df.select(F.col(i).alias("needle_id"), F.col(c).alias("needle"))
    text = lambda df, i, c: df.select(F.col(i).alias("text_id"), F.col(c).alias("text"))
    inside = containments(needle(known, "incident_id", "k"), text(p, "pattern_id", "t")).select(F.col("text_id").alias("pattern_id"), F.col("needle_id").alias("incident_id"))
    around = containments(needle(p, "pattern_id", "t"), text(known, "incident_id", "k")).select(F.col("needle_id").alias("pattern_id"), F.col("text_id").alias("incident_id"))
    direct = cut(inside.unionByName(around).distinct())
    words = p.join(direct.select("pattern_id").distinct(), "pattern_id", "left_anti").select("pattern_id", F.explode(F.array_distinct(F.filter(F.split("t", r"\s+"), lambda w: w != ""))).alias("word"))
    said = text(inc, "incident_id", "title").withColumn("text", F.lower("text")).unionByName(text(inc, "incident_id", "root_cause").withColumn("text", F.lower("text"))).filter("text is not null").distinct()
    # a text of its own id: an incident has two
    said = cut(said.withColumn("incident_id", F.col("text_id")).withColumn("text_id", F.struct("text_id", F.md5("text"))))
    each_word = words.select("word").distinct()
    loose = containments(each_word.select(F.col("word").alias("needle_id"), F.col("word").alias("needle")), said.select("text_id", "text")).join(said.select("text_id", "incident_id"), "text_id").select(F.col("needle_id").alias("word"), "incident_id").distinct()
    by_word = words.join(loose, "word").select("pattern_id", "incident_id").distinct()
    every = direct.withColumn("match", F.lit("pattern")).unionByName(by_word.withColumn("match", F.lit("word")))
    return every.join(inc.select("incident_id", "title"), "incident_id").select("pattern_id", "incident_id", "title", "match")


def change_risk(changes: DataFrame, action: str = "action") -> DataFrame:
    """Changes with a risk level and what makes them risky."""
    text = F.lower(action)
    has = lambda words: F.array_contains(F.array(*[F.contains(text, F.lit(w)) for w in words]), F.lit(True))
    level = F.when(has(HIGH_RISK), "high").when(has(LOW_RISK), "low").otherwise("medium")
    factors = F.array_compact(F.array(F.when(has(["database", "sql"]), "data_integrity"), F.when(has(["rollback"]), "lost_features"), F.when(has(["restart"]), "interruption"), F.when(has(["config"]), "unexpected_effects"), F.when(has(["scale down"]), "less_capacity")))
    return changes.withColumn("risk_level", F.coalesce(level, F.lit("medium"))).withColumn("risk_factors", F.array_join(factors, ",")).withColumn("require_approval", F.col("risk_level") == "high")
