"""Transcript formats to one event schema, as DataFrame expressions.

Input rows are raw lines: source_file, line_no (from 1), raw. Output rows are events:
ts_raw, agent, model, session_id, cwd, role, text, tool_uses, tokens_out, source_file, line_no.
A line that is no JSON object gives no event; ``quality.bad_lines`` lists it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T

TOOLS = "array<struct<name:string,input_summary:string>>"
EVENT_COLUMNS = ("ts_raw", "agent", "model", "session_id", "cwd", "role", "text", "tool_uses", "tokens_out", "source_file", "line_no")
# Message texts that the host injects into a harness session.
INJECTED = (
    r"(?i)current runtime context|current dsh file policy|supersedes earlier|^\s*<system-reminder|A skill is a reusable set of task-specific instructions"
    r"|The following workspace instructions may be relevant|^Time sampled while preparing turn|^The approval policy changed from|^background job \S+ \("
)


def raw_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """source_file, line_no, byte_offset, raw of text files (compressed ones too), numbered per file.

    One file is one row before it is split, so files are bounded by what a task can
    hold; ``tail`` reads larger, growing ones in slices.
    """
    whole = spark.read.options(**options).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    parts = whole.select("source_file", F.posexplode(F.split("value", "\n")).alias("i", "raw"), F.split("value", "\n").alias("all"))
    before = F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)
    return parts.where("trim(raw) <> ''").select("source_file", (F.col("i") + 1).cast("long").alias("line_no"), before.alias("byte_offset"), "raw")


def classify(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` (source_file) with kind: that of the longest configured prefix (root, kind); null for none."""
    hit = files.join(F.broadcast(roots), F.col("source_file").startswith(F.concat(F.regexp_replace("root", "/$", ""), F.lit("/"))))
    best = hit.groupBy("source_file").agg(F.max_by("kind", F.length("root")).alias("kind"))
    return files.join(best, "source_file", "left")


def summarize(value: Column, limit: int = 120) -> Column:
    return T.clip(value, limit)


def jget(path: str, c: str = "raw") -> Column:
    return F.get_json_object(c, "$." + path)


def is_object(c: str = "raw") -> Column:
    return F.coalesce(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.lit(False))


def text_items(content: Column, kinds: tuple[str, ...]) -> Column:
    """Non-empty texts of a content array, or the content itself where it is a string, joined by new lines."""
    items = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(items, lambda x: x["type"].isin(*kinds) & (x["text"] != "")), lambda x: x["text"])
    return F.trim(F.when(F.ltrim(content).startswith("["), F.array_join(texts, "\n")).otherwise(F.coalesce(content, F.lit(""))))


def claude(lines: DataFrame) -> DataFrame:
    """Keep user and assistant lines with a timestamp; thinking is dropped, a lone tool result becomes role 'tool'."""
    rows = lines.where(is_object()).where(jget("type").isin("user", "assistant") & (jget("timestamp") != ""))
    content = jget("message.content")
    items = F.from_json(content, "array<struct<type:string,text:string,name:string,input:string>>")
    calls = F.when(F.ltrim(content).startswith("["), F.transform(F.filter(items, lambda x: x["type"] == "tool_use"), lambda x: F.struct(F.coalesce(x["name"], F.lit("?")).alias("name"), summarize(x["input"]).alias("input_summary"))))
    result = F.when(F.ltrim(content).startswith("["), F.exists(items, lambda x: x["type"] == "tool_result")).otherwise(False)
    rows = rows.select("source_file", "line_no", "raw", text_items(content, ("text",)).alias("text"), F.coalesce(calls, F.array().cast(TOOLS)).alias("tool_uses"), F.coalesce(result, F.lit(False)).alias("__result"))
    bare = (F.col("text") == "") & (F.size("tool_uses") == 0)
    role = F.when(bare, "tool").otherwise(F.coalesce(jget("message.role"), jget("type")))
    rows = rows.where(~bare | F.col("__result")).withColumn("role", role)
    tokens = F.when(F.col("role") == "assistant", F.coalesce(jget("message.usage.output_tokens").try_cast("long"), F.lit(0))).otherwise(0)
    blank = lambda p: F.coalesce(jget(p), F.lit(""))
    return rows.select(
        jget("timestamp").alias("ts_raw"), F.lit("claude").alias("agent"), F.coalesce(F.nullif(jget("message.model"), F.lit("")), F.lit("unknown")).alias("model"), blank("sessionId").alias("session_id"), blank("cwd").alias("cwd"),
        "role", "text", F.col("tool_uses").cast(TOOLS).alias("tool_uses"), tokens.cast("long").alias("tokens_out"), "source_file", "line_no",
    )


def codex(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rollout lines: headers and turn contexts set directory and model of the rows after them.

    ``known`` (session_id, cwd, model, originator) is the state of sessions whose header
    an earlier increment read.
    """
    rows = lines.where(is_object()).withColumn("type", jget("type"))
    sid = F.coalesce(F.nullif(jget("payload.session_id"), F.lit("")), F.when(F.col("type") == "session_meta", F.nullif(jget("payload.id"), F.lit(""))), ids.session_of_path(F.col("source_file")))
    rows = rows.withColumn("session_id", sid)
    header, context = F.col("type") == "session_meta", F.col("type") == "turn_context"
    some = lambda p: F.nullif(jget(p), F.lit(""))
    rows = rows.withColumns({
        "__cwd": F.when(header | context, some("payload.cwd")), "__originator": F.when(header, some("payload.originator")),
        "__model": F.when(header, F.coalesce(some("payload.model_provider"), some("payload.model"))).when(context, some("payload.model")),
    })
    so_far = Window.partitionBy("session_id").orderBy("source_file", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("__cwd", "__model", "__originator")})
    if known is not None:
        k = known.select("session_id", F.col("cwd").alias("k_cwd"), F.col("model").alias("k_model"), F.col("originator").alias("k_originator"))
        rows = rows.join(k, "session_id", "left")
        rows = rows.withColumns({f"__{c}": F.coalesce(f"__{c}", f"k_{c}") for c in ("cwd", "model", "originator")})
    kind = jget("payload.type")
    call, output = kind.isin("function_call", "custom_tool_call"), kind.isin("function_call_output", "custom_tool_call_output")
    rows = rows.where((F.col("type") == "response_item") & (call | output | (kind == "message")))
    role = F.when(call, "assistant").when(output, "tool").otherwise(F.coalesce(F.nullif(jget("payload.role"), F.lit("")), F.lit("assistant")))
    body = F.when(output, F.concat(F.lit("[tool_output] "), summarize(jget("payload.output"), 400))).when(call, "").otherwise(text_items(jget("payload.content"), ("input_text", "output_text", "text")))
    use = F.when(call, F.array(F.struct(F.coalesce(jget("payload.name"), F.lit("?")).alias("name"), summarize(F.when(kind == "function_call", jget("payload.arguments")).otherwise(jget("payload.input"))).alias("input_summary"))))
    rows = rows.select("*", role.alias("role"), F.trim(body).alias("text"), F.coalesce(use, F.array().cast(TOOLS)).alias("tool_uses")).where((F.col("text") != "") | (F.size("tool_uses") > 0))
    counted = F.coalesce(F.nullif(jget("payload.usage.output_tokens").try_cast("long"), F.lit(0)), F.nullif(jget("payload.usage.completion_tokens").try_cast("long"), F.lit(0)))
    guess = F.when(F.col("text") != "", F.greatest(F.lit(1), F.floor(F.length("text") / 3))).otherwise(0)
    low = F.lower(F.coalesce("__originator", F.lit("")))
    agent = F.when(low.contains("desktop"), "codex-desktop").when(low.contains("vscode"), "codex-vscode").when(low != "", F.concat(F.lit("codex-"), low)).otherwise("codex")
    return rows.select(
        F.coalesce(jget("timestamp"), jget("payload.timestamp")).alias("ts_raw"), agent.alias("agent"), F.coalesce("__model", F.lit("unknown")).alias("model"), "session_id", F.coalesce("__cwd", F.lit("")).alias("cwd"),
        "role", "text", F.col("tool_uses").cast(TOOLS).alias("tool_uses"), F.when(F.col("role") == "assistant", F.coalesce(counted, guess)).otherwise(0).cast("long").alias("tokens_out"), "source_file", "line_no",
    )


def codex_sessions(lines: DataFrame) -> DataFrame:
    """session_id, cwd, model, originator, cli_version, started_at of each header line: the state that later increments start from."""
    rows = lines.where(is_object()).where(jget("type") == "session_meta")
    sid = F.coalesce(F.nullif(jget("payload.session_id"), F.lit("")), jget("payload.id"))
    first = Window.partitionBy("session_id").orderBy(F.desc("source_file"), F.desc("line_no"))
    rows = rows.select(sid.alias("session_id"), "source_file", "line_no", jget("payload.cwd").alias("cwd"), F.coalesce(jget("payload.model_provider"), jget("payload.model")).alias("model"), jget("payload.originator").alias("originator"), jget("payload.cli_version").alias("cli_version"), F.coalesce(jget("payload.timestamp"), jget("timestamp")).alias("started_at"))
    return rows.where("session_id <> ''").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "source_file", "line_no")


def harness(lines: DataFrame) -> DataFrame:
    """Session files with a header row: rows copied from a parent session and injected user messages are dropped."""
    rows = lines.where(is_object()).withColumn("type", jget("type"))
    header = F.col("type") == "session"
    so_far = Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fill = lambda c: F.last(c, ignorenulls=True).over(so_far)
    model = F.coalesce(F.nullif(jget("data.message.source.model"), F.lit("")), F.nullif(jget("data.message.source.provider"), F.lit("")))
    time = jget("time").try_cast("double")
    rows = rows.withColumns({
        "session_id": fill(F.when(header, jget("id"))), "cwd": F.coalesce(fill(F.when(header, jget("cwd"))), F.lit("")), "__created": fill(F.when(header, jget("createdAt").try_cast("double"))),
        "__seeded": F.coalesce(fill(F.when(header, F.coalesce(jget("isSeeded") == "true", F.lit(False)))), F.lit(False)), "__time": time,
    })
    rows = rows.where(~F.col("__seeded") | F.coalesce(F.col("__time") >= F.col("__created"), F.lit(False)) | header)
    rows = rows.withColumns({"__model": fill(F.when(F.col("type") == "assistant/message", model)), "__preset": fill(F.when(F.col("type") == "agent-preset/selected", jget("data.agentPreset")))})
    rows = rows.where(F.col("type").isin("user/message", "assistant/message", "tool/call", "tool/result") & (F.col("session_id") != ""))
    role = F.when(F.col("type") == "user/message", "user").when(F.col("type") == "tool/result", "tool").otherwise("assistant")
    body = (
        F.when(F.col("type") == "user/message", text_items(jget("data.content"), ("text",)))
        .when(F.col("type") == "assistant/message", text_items(jget("data.message.content"), ("text",)))
        .when(F.col("type") == "tool/result", F.substring(F.coalesce(jget("data.output"), jget("data.result"), F.lit("")), 1, 400))
        .otherwise("")
    )
    use = F.when(F.col("type") == "tool/call", F.array(F.struct(F.coalesce(jget("data.name"), F.lit("?")).alias("name"), summarize(jget("data.arguments")).alias("input_summary"))))
    rows = rows.select("*", role.alias("role"), F.substring(body, 1, 2000).alias("text"))
    rows = rows.where((F.col("role") != "user") | ~F.col("text").rlike(INJECTED))
    tokens = F.when(F.col("type") == "assistant/message", F.coalesce(jget("data.message.tokens_out").try_cast("long"), F.lit(0))).otherwise(0)
    stamp = F.date_format(F.timestamp_millis(F.col("__time").cast("long")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return rows.select(
        stamp.alias("ts_raw"), F.lit("dsh").alias("agent"), F.coalesce("__model", "__preset", F.lit("deepseek")).alias("model"), "session_id", "cwd", "role", "text",
        F.coalesce(use, F.array().cast(TOOLS)).cast(TOOLS).alias("tool_uses"), tokens.cast("long").alias("tokens_out"), "source_file", "line_no",
    )


def work_logs(files: DataFrame) -> DataFrame:
    """Whole Markdown files (source_file, value): one assistant event at 23:59 of the date in the name."""
    stem = F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1)
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    return files.where(text != "").select(
        F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(stem, F.lit("T23:59:00"))).alias("ts_raw"), F.lit("qclaw").alias("agent"), F.lit("unknown").alias("model"), F.concat(F.lit("qclaw-memory-"), stem).alias("session_id"), folder.alias("cwd"),
        F.lit("assistant").alias("role"), text.alias("text"), F.array().cast(TOOLS).alias("tool_uses"), F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("long").alias("tokens_out"), "source_file", F.lit(None).cast("long").alias("line_no"),
    )


def session_stores(stores: DataFrame, summaries: DataFrame) -> DataFrame:
    """store.json files joined to the summary beside them (first by name); the summary's text wins."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    s = summaries.where(F.col("source_file").rlike(r"/summary_[^/]*\.md$") & (F.trim("value") != "")).groupBy(folder("source_file").alias("folder")).agg(F.min_by(F.trim("value"), "source_file").alias("summary"))
    rows = stores.where(F.col("source_file").endswith("/store.json") & is_object("value")).withColumn("folder", folder("source_file")).join(s, "folder", "left")
    get = lambda p: F.nullif(jget(p, "value"), F.lit(""))
    sid = F.coalesce(get("id"), F.element_at(F.split("folder", "/"), -1))
    agents = F.from_json(jget("agents", "value"), "array<struct<model:string>>")
    model = F.coalesce(F.try_element_at(F.filter(agents, lambda a: (a["model"] != "") & (a["model"] != "unknown")), F.lit(1))["model"], F.lit("unknown"))
    plain = F.concat(F.lit("Session: "), F.coalesce(get("name"), sid), F.lit(" (status="), F.coalesce(get("status"), F.lit("unknown")), F.lit(", messages="), F.coalesce(get("lastMessageCount"), F.lit("0")), F.lit(")"))
    text = F.coalesce("summary", plain)
    return rows.select(
        F.coalesce(get("updatedAt"), get("createdAt")).alias("ts_raw"), F.lit("qclaw").alias("agent"), model.alias("model"), F.concat(F.lit("qclaw-"), sid).alias("session_id"), F.regexp_replace("folder", "/[^/]*/[^/]*$", "").alias("cwd"),
        F.lit("assistant").alias("role"), text.alias("text"), F.array().cast(TOOLS).alias("tool_uses"), F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("long").alias("tokens_out"), "source_file", F.lit(None).cast("long").alias("line_no"),
    )


def to_events(parsed: DataFrame, hub_id: str, zone: str = "UTC") -> DataFrame:
    """Identity, instant and local day for parsed rows; the columns of the event log."""
    at = ids.instant(F.col("ts_raw"))
    own = F.sha2(F.concat_ws(":", "source_file", F.col("line_no").cast("string"), "role", "text"), 256)
    whole = ids.snapshot_event_id(F.col("agent"), F.col("session_id"), F.col("role"), F.col("text"), F.col("ts_raw"))
    return parsed.select(
        F.lit(hub_id).alias("hub_id"), F.when(F.col("line_no").isNull(), whole).otherwise(own).alias("event_id"), at.alias("ts"), *EVENT_COLUMNS[:-1], F.coalesce("line_no", F.lit(1)).cast("long").alias("line_no"),
        F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz"))).alias("day"), F.lit("hot").alias("tier"),
    )


def backfill(spark: SparkSession, path: str, since: str) -> tuple[DataFrame, DataFrame]:
    """Lines of files changed after ``since`` and, for older ones, where reading starts later (source_file, bytes)."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), F.col("length").alias("bytes"), "modificationTime")
    old = listed.where(F.col("modificationTime") <= F.to_timestamp(F.lit(since))).select("source_file", "bytes")
    return raw_lines(spark, path, modifiedAfter=since), old


def to_reconcile(spark: SparkSession, path: str, offsets: DataFrame) -> DataFrame:
    """Files whose size differs from the committed offset (source_file, bytes)."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), F.col("length").alias("size"))
    both = listed.join(offsets, "source_file", "left")
    return both.where(F.coalesce("bytes", F.lit(-1)) != F.col("size")).select("source_file", "size", "bytes")
