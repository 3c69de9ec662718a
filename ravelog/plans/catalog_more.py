"""Registered queries of sources, requests, leases and report parts, over data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import evidence, profiles, quality, reports, tiers, turns
from ..sources import archives
from ..sources import transcripts as S
from . import adapters as A
from .catalog import register

LINE = ("concat('/log/rollout-x-', conv_id, '-a-b-c-d.jsonl') as source_file", "turn + 2 as line_no")
T0 = "'2024-01-01T00:00:00Z'"


def lines(spark, d, raw: str, head: str | None = None) -> DataFrame:
    """Conversation turns written as transcript lines, after a header line where the format has one."""
    c = A.table(spark, d, "conversations")
    out = c.selectExpr(*LINE, f"{raw} as raw")
    if head:
        out = out.union(c.selectExpr("conv_id", "-1 as turn").distinct().selectExpr(*LINE, f"{head} as raw"))
    return out


CLAUDE = f"to_json(named_struct('type', role, 'timestamp', {T0}, 'sessionId', cast(conv_id as string), 'cwd', '/w', 'message', named_struct('role', role, 'content', text)))"
CODEX = f"to_json(named_struct('type', 'response_item', 'timestamp', {T0}, 'payload', named_struct('type', 'message', 'role', role, 'content', array(named_struct('type', 'input_text', 'text', text)))))"
CODEX_HEAD = f"to_json(named_struct('type', 'session_meta', 'timestamp', {T0}, 'payload', named_struct('session_id', concat(conv_id, '-a-b-c-d'), 'cwd', concat('/w/', conv_id % 7), 'model', concat('m', conv_id % 2), 'originator', case when conv_id % 3 = 0 then 'Codex Desktop' when conv_id % 3 = 1 then 'vscode' else 'cli' end)))"
HARNESS = "case role when 'assistant' then to_json(named_struct('type', 'assistant/message', 'time', turn * 1000, 'data', named_struct('message', named_struct('content', text)))) else to_json(named_struct('type', 'user/message', 'time', turn * 1000, 'data', named_struct('content', text))) end"
HARNESS_HEAD = "to_json(named_struct('type', 'session', 'id', concat('session-', conv_id), 'cwd', '/w', 'createdAt', 2000, 'isSeeded', conv_id % 2 = 0))"


@register("src_claude", "select cast(conv_id as varchar) as session_id, turn + 2 as line_no, role, trim(text) as text from conversations where role in ('user', 'assistant') and trim(text) <> ''")
def src_claude(spark, d):
    return S.claude(lines(spark, d, CLAUDE)).select("session_id", "line_no", "role", "text")


@register("src_codex", """select conv_id || '-a-b-c-d' as session_id, turn + 2 as line_no, role, '/w/' || (conv_id % 7) as cwd, case conv_id % 3 when 0 then 'codex-desktop' when 1 then 'codex-vscode' else 'codex-cli' end as agent,
  cast(case when role = 'assistant' then greatest(1, length(trim(text)) // 3) else 0 end as bigint) as tokens_out from conversations where trim(text) <> ''""")
def src_codex(spark, d):
    return S.codex(lines(spark, d, CODEX, CODEX_HEAD)).select("session_id", "line_no", "role", "cwd", "agent", "tokens_out")


@register("src_codex_prime", "select distinct conv_id || '-a-b-c-d' as session_id, '/w/' || (conv_id % 7) as cwd, 'm' || (conv_id % 2) as model from conversations where trim(text) <> '' and turn >= 1")
def src_codex_prime(spark, d):
    rows = lines(spark, d, CODEX, CODEX_HEAD)
    known = S.codex_sessions(rows)
    return S.codex(rows.where("line_no > 2"), known).select("session_id", "cwd", "model").distinct()


@register("src_dsh", "select 'session-' || conv_id as session_id, turn + 2 as line_no, case role when 'assistant' then 'assistant' else 'user' end as role, substr(trim(text), 1, 2000) as text from conversations where conv_id % 2 = 1 or turn >= 2")
def src_dsh(spark, d):
    return S.harness(lines(spark, d, HARNESS, HARNESS_HEAD)).select("session_id", "line_no", "role", "text")


@register("src_jsonl_lines", "select conv_id, count(*) as good from conversations where turn % 4 <> 3 group by 1")
def src_jsonl_lines(spark, d):
    raw = f"case when turn % 4 = 3 then concat('{{broken ', turn) else {CLAUDE} end"
    rows = lines(spark, d, raw).where(S.is_object())
    return rows.groupBy(F.regexp_extract("source_file", r"-x-(\d+)-", 1).cast("long").alias("conv_id")).agg(F.count("*").alias("good"))


@register("src_classify", "select source, case when source like 'src1%' then 'codex' else 'claude' end as kind from (select distinct source from documents)")
def src_classify(spark, d):
    files = A.table(spark, d, "documents").select(F.concat(F.when(F.col("source").startswith("src1"), "/a/b/").otherwise("/a/"), F.col("source")).alias("source_file")).distinct()
    roots = A.literal(spark, [("/a", "claude"), ("/a/b", "codex")], "root string, kind string")
    return S.classify(files, roots).select(F.element_at(F.split("source_file", "/"), -1).alias("source"), "kind")


@register("src_snapshot_md", "select doc_id, trim(text) as text, greatest(1, length(trim(text)) // 3) as tokens_out from documents where trim(text) <> ''")
def src_snapshot_md(spark, d):
    files = A.table(spark, d, "documents").select(F.concat(F.lit("/m/"), F.col("doc_id"), F.lit(".md")).alias("source_file"), F.trim("text").alias("value"))
    return S.work_logs(files).select(F.regexp_extract("session_id", r"(\d+)$", 1).cast("long").alias("doc_id"), "text", "tokens_out")


@register("src_snapshot_store", "select 'qclaw-' || doc_id as session_id, case when doc_id % 2 = 0 then trim(text) else 'Session: ' || doc_id || ' (status=unknown, messages=0)' end as text from documents")
def src_snapshot_store(spark, d):
    x = A.table(spark, d, "documents")
    store = x.select(F.format_string("/w/s/%d/store.json", "doc_id").alias("source_file"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"))).alias("value"))
    notes = x.where("doc_id % 2 = 0").select(F.format_string("/w/s/%d/summary_1.md", "doc_id").alias("source_file"), F.col("text").alias("value"))
    return S.session_stores(store, notes).select("session_id", "text")


@register("win_fill_meta", f"with {A.TURNS} select event_id, last_value(case when role = 'user' then event_id end ignore nulls) over (partition by hub_id, session_id order by line_no rows unbounded preceding) as last_user from turns")
def win_fill_meta(spark, d):
    rows = A.turns(spark, d).withColumn("last_user", F.when(F.col("role") == "user", F.col("event_id")))
    return turns.fill_forward(rows, ["hub_id", "session_id"], ["line_no"], ["last_user"]).select("event_id", "last_user")


@register("flt_injected", "select cast(conv_id as varchar) || '-' || turn as event_id from conversations where role = 'user'")
def flt_injected(spark, d):
    return A.turns(spark, d).where((F.col("role") == "user") & ~F.col("text").rlike(S.INJECTED)).select("event_id")


@register("sc_summarize", r"select doc_id, case when length(o) <= 120 then o else substr(o, 1, 120) || '…' end as short from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as o from documents)")
def sc_summarize(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.summarize(F.col("text")).alias("short"))


@register("sc_session_from_path", "select distinct conv_id, conv_id || '-a-b-c-d' as session_id from conversations")
def sc_session_from_path(spark, d):
    return A.table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", ids.session_of_path(F.format_string("/log/rollout-x-%d-a-b-c-d.jsonl", "conv_id")).alias("session_id"))


@register("sc_agent_label", "select distinct lang, case when lang = 'en' then 'codex-desktop' when lang = 'de' then 'codex-vscode' else 'codex' end as agent from documents")
def sc_agent_label(spark, d):
    name = F.when(F.col("lang") == "en", "Codex Desktop").when(F.col("lang") == "de", "VSCode").otherwise("")
    return A.table(spark, d, "documents").select("lang", ids.agent_label(name).alias("agent")).distinct()


@register("sc_memory_id", "select item_id, 'memory_' || substr(sha1(substr(text, 1, 9) || chr(10) || text), 1, 16) as id from benchmark")
def sc_memory_id(spark, d):
    return A.table(spark, d, "benchmark").select("item_id", ids.memory_id(F.substring("text", 1, 9), F.col("text")).alias("id"))


@register("sc_event_id_line", "select doc_id, sha256(source || ':' || doc_id || ':' || text) as id from documents")
def sc_event_id_line(spark, d):
    return A.table(spark, d, "documents").select("doc_id", ids.line_event_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("id"))


@register("sc_profile_key", r"select item_id, regexp_replace(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', '', 'g'), '[。.!！;；]+$', '') as key from benchmark")
def sc_profile_key(spark, d):
    return A.table(spark, d, "benchmark").select("item_id", profiles.profile_key(F.col("text")).alias("key"))


@register("agg_profile_dedupe", "select lang as filename, lower(source) as key, max(doc_id) as seq, count(distinct doc_id % 5) as sources from documents group by all")
def agg_profile_dedupe(spark, d):
    x = A.table(spark, d, "documents").selectExpr("'h0' as hub_id", "lang as filename", "doc_id as seq", "'t' as ts", "case when doc_id % 2 = 0 then upper(source) else concat(source, '.') end as text", "cast(doc_id % 5 as string) as session_id")
    return profiles.dedupe(x).select("filename", "key", "seq", F.size("sources").cast("long").alias("sources"))


@register("prj_clean_files", "select doc_id, case when doc_id % 2 = 0 then source || '.md' else source || '.md,' || lang || '/x.py' end as files from documents")
def prj_clean_files(spark, d):
    x = A.table(spark, d, "documents")
    files = F.array(F.concat("source", F.lit(".md")), F.lit("12/3"), F.lit("$VAR"), F.upper(F.concat("source", F.lit(".md"))), F.lit("abc"), F.when(F.col("doc_id") % 2 == 1, F.concat("lang", F.lit("/x.py"))).otherwise("~"))
    return x.select("doc_id", F.array_join(evidence.clean_files(files), ",").alias("files"))


@register("flt_display", "select doc_id, 1 as shown from documents")
def flt_display(spark, d):
    x = A.table(spark, d, "documents")
    return x.select("doc_id", F.size(reports.display_texts(F.array("source", F.lit("<heartbeat> x"), F.lit(" "), "source"))).alias("shown"))


REQUESTS = """requests as (select 'h' || (o_custkey % 3) as hub_id, strftime(o_orderdate, '%Y-%m-%d') as period, min(case o_orderstatus when 'F' then 'done' when 'O' then 'pending' else 'claimed' end) as status, max(o_custkey % 150) as owner from orders group by 1, 2)"""


def requests(spark, d) -> DataFrame:
    """A request per hub and order day; its status comes from the orders', its owner from a customer."""
    o = A.orders(spark, d).selectExpr("concat('h', o_custkey % 3) as hub_id", "date_format(o_orderdate, 'yyyy-MM-dd') as period", "case o_orderstatus when 'F' then 'done' when 'O' then 'pending' else 'claimed' end as s", "o_custkey % 150 as owner")
    rows = o.groupBy("hub_id", "period").agg(F.min("s").alias("status"), F.max("owner").alias("owner"))
    when = A.instant("2024-01-30 12:00:00") + F.make_dt_interval(hours=F.col("owner").cast("int") % 12)
    return rows.select("hub_id", F.lit("daily").alias("kind"), "period", "status", F.when(F.col("status") == "claimed", when).alias("claimed_at"), F.col("owner").cast("string").alias("claimed_session"), F.lit(None).cast("timestamp").alias("lease_renewed_at"))


@register("lim_pending_list", f"with {REQUESTS} select hub_id, period, row_number() over (partition by hub_id order by period desc) as rank, count(*) over (partition by hub_id) as total from requests where status <> 'done'")
def lim_pending_list(spark, d):
    return reports.pending(requests(spark, d)).select("hub_id", "period", F.col("rank").cast("long").alias("rank"), "total")


@register("lim_backlog", f"with {REQUESTS} select hub_id, period, count(*) over (partition by hub_id) as total from requests where status <> 'done' qualify row_number() over (partition by hub_id order by period desc) <= 3")
def lim_backlog(spark, d):
    return reports.pending(requests(spark, d), 3).select("hub_id", "period", "total")


@register("join_backlog_block", f"with {REQUESTS} select distinct hub_id, substr(period, 1, 7) as month from requests where status <> 'done'")
def join_backlog_block(spark, d):
    months = requests(spark, d).select("hub_id", F.substring("period", 1, 7).alias("month")).distinct()
    return reports.backlog_blocks(months, requests(spark, d))


@register("sink_request_gaps", f"with {REQUESTS}, g as (select hub_id, period from requests where owner % 2 = 0 union all select 'h9', '2024-01-01'), b as (select coalesce(r.hub_id, g.hub_id) as hub_id, coalesce(r.period, g.period) as period, r.status as old, r.hub_id is not null as have, g.hub_id is not null as gap from requests r full outer join g on r.hub_id = g.hub_id and r.period = g.period) select hub_id, period, case when not have then 'insert' when gap and old = 'done' then 'reopen' else 'keep' end as action from b")
def sink_request_gaps(spark, d):
    r = requests(spark, d)
    gaps = r.where("cast(claimed_session as int) % 2 = 0").select("hub_id", F.to_date("period").alias("day")).union(spark.range(1).select(F.lit("h9"), F.lit("2024-01-01").cast("date")))
    return reports.enqueue(gaps, r).select("hub_id", "period", "action")


LEASES = f"""{REQUESTS}, {A.ACTIVITY}, seen as (select hub_id, session_id, max(ts) as last_ts from activity group by all),
  l as (select r.*, timestamp '2024-01-30 12:00:00' + to_hours(owner % 12) as claimed, last_ts from requests r left join seen s on s.hub_id = r.hub_id and s.session_id = cast(r.owner as varchar)),
  leases as (select hub_id, period, case when status <> 'claimed' then 'unclaimed' when epoch(timestamp '2024-01-30 23:58:00') - epoch(greatest(claimed, case when last_ts >= claimed and last_ts <= timestamp '2024-01-31 00:03:00' then last_ts else claimed end)) < case when last_ts > claimed then 21600 else 2700 end then 'active' else 'expired' end as lease from l)"""


def leased(spark, d) -> DataFrame:
    seen = A.activity(spark, d).groupBy("hub_id", "session_id").agg(F.max("ts").alias("last_activity"))
    return reports.lease_state(requests(spark, d), seen, A.instant(A.NOW))


@register("val_lease_state", f"with {LEASES} select * from leases")
def val_lease_state(spark, d):
    return leased(spark, d).select("hub_id", "period", "lease")


@register("join_lease_activity", f"with {LEASES} select lease, count(*) as requests from leases group by 1")
def join_lease_activity(spark, d):
    return leased(spark, d).groupBy("lease").agg(F.count("*").alias("requests"))


@register("val_claims_audit", f"with {LEASES} select r.hub_id, count(*) filter (status = 'pending') as pending, count(*) filter (lease = 'active') as active, count(*) filter (lease = 'expired') as expired, count(*) filter (status = 'done') as done from requests r join leases l on l.hub_id = r.hub_id and l.period = r.period group by 1")
def val_claims_audit(spark, d):
    return quality.claims_audit(leased(spark, d)).select("hub_id", "pending", "active", "expired", "done")


@register("flt_claimable", f"with {LEASES} select r.hub_id, r.period from requests r join leases l on l.hub_id = r.hub_id and l.period = r.period where status <> 'done' and r.period < '2000-01-01' and lease <> 'active'")
def flt_claimable(spark, d):
    return reports.claimable(leased(spark, d), F.lit("2000-01-01").cast("date"), "none").select("hub_id", "period")


@register("join_unknown_citation", "select doc_id as period, 7 as n from documents where doc_id % 2 = 1")
def join_unknown_citation(spark, d):
    x = A.table(spark, d, "documents")
    body = F.concat(F.lit("- x [1]"), F.when(F.col("doc_id") % 2 == 1, "[7]").otherwise(""))
    rows = x.select(F.lit("h0").alias("hub_id"), F.col("doc_id").alias("period"), body.alias("body"))
    refs = x.select(F.lit("h0").alias("hub_id"), F.col("doc_id").alias("period"), F.lit(1).alias("n"))
    return reports.unknown_citations(rows, refs).select("period", "n")


@register("join_uncited_sessions", f"with {A.TURNS} select hub_id, cast(day as varchar) as period, session_id as session from turns where role <> 'system' group by all having max(length(text)) >= 30 and min(line_no) > 1")
def join_uncited_sessions(spark, d):
    t = A.turns(spark, d).where("role <> 'system'")
    refs = t.select("hub_id", F.col("day").cast("string").alias("period"), F.xxhash64("event_id").alias("n"), F.col("session_id").alias("session"), F.length("text").alias("chars"), "line_no")
    cited = refs.where("line_no = 1").select("hub_id", "period", "session").distinct()
    days = refs.select("hub_id", "period").distinct().withColumn("body", F.lit(""))
    return reports.uncited_sessions(days, refs).join(cited, ["hub_id", "period", "session"], "left_anti")


# ---------------------------------------------------------------- names, statuses, months


@register("sc_metadata_score", "select doc_id, case when source = 'src' || (doc_id % 5) then 1.5 else 0.0 end + case when doc_id % 2 = 0 and lang = 'en' then 1.0 else 0.0 end as score from (select doc_id, lang, 'src' || (n_chars % 5) as source from documents)")
def sc_metadata_score(spark, d):
    docs = A.table(spark, d, "documents")
    asked = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("")
    return docs.select("doc_id", ids.metadata_score(F.concat(F.lit("src"), (F.col("n_chars") % 5).cast("string")), F.col("lang"), F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string")), asked).alias("score"))


@register("sc_event_id_snapshot", "select doc_id, 'snapshot:' || sha256(to_json({'agent': lang, 'session_id': source, 'role': 'user', 'text': text, 'ts': cast(null as varchar)})) as id from documents")
def sc_event_id_snapshot(spark, d):
    return A.table(spark, d, "documents").select("doc_id", ids.snapshot_event_id(F.col("lang"), F.col("source"), F.lit("user"), F.col("text"), F.lit(None).cast("string")).alias("id"))


@register("sc_event_id_fallback", "select doc_id, substr(sha1(to_json({'line_no': doc_id, 'role': 'user', 'session_id': source, 'text': text, 'ts': lang})), 1, 20) as id from documents")
def sc_event_id_fallback(spark, d):
    return A.table(spark, d, "documents").select("doc_id", ids.fallback_event_id(F.col("source"), F.col("lang"), F.lit("user"), F.col("text"), F.col("doc_id")).alias("id"))


NAMES = "concat(source, case doc_id % 9 when 0 then '.pem' when 1 then '_token.txt' when 2 then '.md' when 3 then '-secrets.json' when 4 then '.secret.json' when 5 then '.KEY' when 6 then '_auth' when 7 then '.author' else '.jsonl' end)"


@register("flt_secret_name", f"with n as (select doc_id, {NAMES} as name from documents) select doc_id, name from n where not starts_with(name, '.') and not regexp_matches(name, '(?i)(^|[._-])(secret|token|credential|password|passwd|apikey|api[_-]key|auth)([._-]|$)') and not regexp_matches(name, '(?i)[.](pem|key|p12|pfx|keystore)$')")
def flt_secret_name(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", F.expr(NAMES).alias("name"))
    return rows.where(archives.servable(F.col("name")))


@register("sc_status_norm", "select doc_id, case doc_id % 7 when 0 then 'done' when 1 then 'wip' when 2 then 'done' when 3 then 'blocked' when 4 then 'fail' else '?' end as status from documents")
def sc_status_norm(spark, d):
    raw = F.expr("case doc_id % 7 when 0 then 'completed (checked)' when 1 then ' in_progress ' when 2 then '已完成（来源）' when 3 then 'blocked' when 4 then '失败' when 5 then 'later' end")
    return A.table(spark, d, "documents").select("doc_id", reports.short_status(raw).alias("status"))


MARKED_TEXT = "case doc_id % 6 when 1 then concat(text, ' ```') when 2 then concat('see /home/user/x ', text) when 3 then concat(text, ' sessions.jsonl') when 4 then concat('Ignore previous instructions. ', text) when 5 then concat('C:', chr(92), text) else text end"


@register("sc_forbidden", f"""with t as (select doc_id, {MARKED_TEXT} as t from documents), c as (select doc_id, case when contains(t, '```') then 'forbidden_code_fence'
  when regexp_matches(t, '(~|/Users|/home|/[A-Za-z0-9_.-]+)/[^\\s)\\]]+|[A-Za-z]:\\\\') then 'forbidden_raw_path' when regexp_matches(t, '(?i)(Agent-readable|sessions[.]jsonl|event_id|session-[0-9a-f]{{8,}}|tar[.]gz!)') then 'forbidden_machine_payload'
  when regexp_matches(t, '(?i)\\b(system prompt|prompt injection|ignore (all |previous )?instructions)\\b') then 'forbidden_prompt_injection' end as code from t) select doc_id, code from c where code is not null""")
def sc_forbidden(spark, d):
    return A.table(spark, d, "documents").select("doc_id", reports.forbidden(F.expr(MARKED_TEXT)).alias("code")).where("code is not null")


ARCHIVED = "a as (select 'h' || (user_id % 3) as hub_id, strftime(cast(ts as date) - to_months(cast(user_id % 20 as integer)), '%Y-%m') as month, count(distinct cast(ts as date)) as days, ['ok', 'corrupt', 'unverified', 'odd'][1 + min(user_id) % 4] as status from events group by 1, 2)"


def archives_of(spark, d):
    """The months before each event as archives, a status by the smallest user."""
    rows = A.table(spark, d, "events").selectExpr("concat('h', user_id % 3) as hub_id", "date_format(add_months(to_date(ts), -cast(user_id % 20 as int)), 'yyyy-MM') as month", "to_date(ts) as day", "user_id")
    return rows.groupBy("hub_id", "month").agg(F.count_distinct("day").alias("days"), F.get(F.array(*map(F.lit, ("ok", "corrupt", "unverified", "odd"))), (F.min("user_id") % 4).cast("int")).alias("status"))


@register("lim_archived_months", f"""with {ARCHIVED} select hub_id, month, days, status, case status when 'ok' then '' when 'corrupt' then ' (CORRUPT — quarantined)' when 'unverified' then ' (unverified)' else ' ?' end as flag, 'archive/' || left(month, 4) || '/' || month || '.tar.gz' as ref
  from (select *, row_number() over (partition by hub_id order by month desc) as n from a) where n <= 12""")
def lim_archived_months(spark, d):
    return tiers.archived_months(archives_of(spark, d))


@register("agg_archive_status", f"""with {A.ACTIVITY}, {ARCHIVED}, hot as (select hub_id, strftime(day, '%Y-%m') as month, count(distinct day) as days from activity where session_id not like '%7' group by 1, 2),
  p as (select hub_id, strftime(day, '%Y-%m') as month, string_agg(distinct cast(day as varchar), ',' order by cast(day as varchar)) as pending from activity where session_id like '%3' and day(day) % 9 = 0 group by 1, 2)
  select coalesce(h.hub_id, a.hub_id) as hub_id, coalesce(h.month, a.month) as month, coalesce(h.days, 0) as days, a.month is not null as archived, case when h.days is null then 'archived' when h.month = '2024-01' then 'current' when h.month < '2023-12' then 'eligible' else 'grace window' end as reason, coalesce(pending, '') as pending
  from hot h full join a on h.hub_id = a.hub_id and h.month = a.month left join p on p.hub_id = coalesce(h.hub_id, a.hub_id) and p.month = coalesce(h.month, a.month)""")
def agg_archive_status(spark, d):
    rows, kept = A.activity(spark, d), archives_of(spark, d)
    eligible = kept.where("month < '2023-12'")
    return tiers.month_status(rows.where("session_id not like '%7'"), eligible, rows.where("session_id like '%3' and day(day) % 9 = 0"), kept, F.lit("2024-01-30").cast("date"))
