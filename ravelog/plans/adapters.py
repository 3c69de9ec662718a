"""The given tables as logical tables of the engine, and the same views as SQL text.

``turns`` reads conversations as events with texts, ``activity`` reads the event
stream as events with times and tokens, ``corpus`` reads documents as a search
corpus, ``asked`` reads benchmark items as queries, ``tier_rows`` reads two
overlapping slices of documents as a recent and a compacted tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 23:58:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = "case when role = 'assistant' and length(text) % 5 = 0 then array(named_struct('name', concat('tool', length(text) % 7), 'input_summary', '')) else cast(array() as array<struct<name:string,input_summary:string>>) end"
    ts = "timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(conv_id % 30 as int), cast(conv_id % 24 as int), cast(turn * 7 as int), 0)"
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('h', conv_id % 3) as hub_id", "concat(conv_id, '-', turn) as event_id", "concat('agent', conv_id % 4) as agent", "concat('m', conv_id % 2) as model",
        "cast(conv_id as string) as session_id", "concat('/w/', conv_id % 7) as cwd", "role", "text", "turn + 1 as line_no", f"{ts} as ts", f"to_date({ts}) as day", f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\") as ts_raw",
        "cast(case when role = 'assistant' then floor(length(text) / 3) else 0 end as bigint) as tokens_out", f"{tool} as tool_uses", "concat('/log/', conv_id, '.jsonl') as source_file", "'hot' as tier",
    )


TURNS = """turns as (select 'h' || (conv_id % 3) as hub_id, conv_id || '-' || turn as event_id, 'agent' || (conv_id % 4) as agent, 'm' || (conv_id % 2) as model,
  cast(conv_id as varchar) as session_id, '/w/' || (conv_id % 7) as cwd, role, text, turn + 1 as line_no,
  timestamp '2024-01-01 00:00:00' + to_days(cast(conv_id % 30 as integer)) + to_hours(conv_id % 24) + to_minutes(turn * 7) as ts,
  cast(timestamp '2024-01-01 00:00:00' + to_days(cast(conv_id % 30 as integer)) + to_hours(conv_id % 24) + to_minutes(turn * 7) as date) as day,
  cast(case when role = 'assistant' then length(text) // 3 else 0 end as bigint) as tokens_out,
  case when role = 'assistant' and length(text) % 5 = 0 then 'tool' || (length(text) % 7) end as tool
  from conversations)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('h', user_id % 3) as hub_id", "cast(event_id as string) as event_id", "event_type as agent", "concat('m', event_id % 2) as model", "cast(user_id as string) as session_id",
        "concat('/p/', cast(get_json_object(props, '$.k') as bigint) % 10) as cwd", "'assistant' as role", "'' as text", "event_id as line_no", "cast(ts as timestamp) as ts", "to_date(ts) as day", "cast(ts as string) as ts_raw",
        "cast(floor(value) as bigint) as tokens_out", "cast(array() as array<struct<name:string,input_summary:string>>) as tool_uses", "'events' as source_file", "'hot' as tier",
    )


ACTIVITY = """activity as (select 'h' || (user_id % 3) as hub_id, cast(event_id as varchar) as event_id, event_type as agent, 'm' || (event_id % 2) as model,
  cast(user_id as varchar) as session_id, '/p/' || (cast(json_extract(props, '$.k') as bigint) % 10) as cwd, 'assistant' as role, event_id as line_no,
  cast(ts as timestamp) as ts, cast(ts as date) as day, cast(floor(value) as bigint) as tokens_out from events)"""


def corpus(spark: SparkSession, sf_dir: str, dated: bool = True) -> DataFrame:
    day = "date_add(date '2024-01-01', cast(doc_id % 60 as int))" if dated else "cast(null as date)"
    return table(spark, sf_dir, "documents").selectExpr("'h0' as hub_id", "doc_id", "'session' as source", "source as path", "source as cwd", "lang as agent", f"{day} as day", "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("'h0' as hub_id", "item_id as query_id", "concat_ws(' ', slice(split(text, ' '), 1, 4)) as text")


ASKED = "asked as (select item_id as query_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') as text from benchmark)"

TOKENS = r"""seg as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_./:-]+')) as w from documents),
  tok as (select doc_id, lower(regexp_replace(w, '^[._:/-]+|[._:/-]+$', '', 'g')) as t from seg),
  tokens as (select doc_id, t as term from tok where length(t) >= 2
    union all select doc_id, substr(t, 1, length(t) - 1) from tok where length(t) > 3 and t like '%s' and t not like '%ss'),
  postings as (select doc_id, term, count(*) as tf from tokens group by all),
  lengths as (select d.doc_id, coalesce(x.length, 0) as length from documents d left join (select doc_id, count(*) as length from tokens group by 1) x using (doc_id))"""

QUERY_TOKENS = r"""qseg as (select query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_./:-]+')) as w from asked),
  qtok as (select query_id, lower(regexp_replace(w, '^[._:/-]+|[._:/-]+$', '', 'g')) as t from qseg),
  qterms as (select query_id, term, count(*) as weight from (select query_id, t as term from qtok where length(t) >= 2
    union all select query_id, substr(t, 1, length(t) - 1) from qtok where length(t) > 3 and t like '%s' and t not like '%ss') group by all)"""


def tier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of two tiers: the lower 70 % of ids is cold, the upper 60 % hot; every tenth hot copy is altered."""
    d = table(spark, sf_dir, "documents").selectExpr("concat('h', doc_id % 3) as hub_id", "date_add(date '2024-01-01', cast(doc_id % 40 as int)) as day", "source as file", "doc_id as line_no", "concat('e', doc_id) as event_id", "text", "doc_id % 10 as part")
    cold = d.where("part < 7").selectExpr("hub_id", "day", "file", "line_no", "event_id", "text as raw", "'cold' as tier")
    hot = d.where("part >= 4").selectExpr("hub_id", "day", "file", "line_no", "event_id", "case when line_no % 30 = 4 then concat(text, ' changed') else text end as raw", "'hot' as tier")
    return cold.union(hot)


TIER_ROWS = """d as (select 'h' || (doc_id % 3) as hub_id, date '2024-01-01' + cast(doc_id % 40 as integer) as day, source as file, doc_id as line_no, 'e' || doc_id as event_id, text, doc_id % 10 as part from documents),
  tiers as (select hub_id, day, file, line_no, event_id, text as raw, 'cold' as tier from d where part < 7
    union all select hub_id, day, file, line_no, event_id, case when line_no % 30 = 4 then text || ' changed' else text end, 'hot' from d where part >= 4)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def instant(text: str) -> F.Column:
    return F.to_timestamp(F.lit(text))
