"""The registered queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

TOPIC_LOG = """
topic_log as (
  select event_type as topic, cast(user_id % 4 as int) as part_id,
         row_number() over (partition by event_type, user_id % 4 order by event_id) - 1 as log_offset,
         cast(user_id as varchar) as msg_key, case when event_id % 10 = 0 then null else props end as msg_value, ts
  from events)"""

COMMIT_LOG = """
commit_log as (
  select event_id as log_pos, 'cg-' || cast(user_id % 8 as varchar) as grp, event_type as topic,
         cast(event_id % 3 as int) as part_id,
         case when cast(json_extract_string(props, '$.k') as int) % 5 = 0 then null
              else cast(floor(event_id / 40) as bigint) end as committed,
         epoch_us(ts) // 1000 as commit_ms
  from events)"""

ASSIGNMENTS = """
assignments as (
  select distinct 'cg-' || cast(user_id % 8 as varchar) as grp, event_type as topic, cast(user_id % 4 as int) as part_id,
         'consumer-' || cast(user_id % 8 as varchar) as consumer_id, 'client-' || cast(user_id % 8 as varchar) as client_id,
         '/10.0.0.' || cast(user_id % 8 as varchar) as host
  from events where user_id % 8 < 6)"""

GROUPS = """
groups_in as (
  select distinct 'cg-' || cast(user_id % 8 as varchar) as grp,
         case user_id % 8 when 7 then 'Dead' when 6 then 'Empty' else 'Stable' end as state
  from events)"""

PARTITIONS = """
infos as (
  select distinct p_brand as topic, cast(p_size % 8 as int) as part_id,
         cast(1 + (p_size % 8 + length(p_brand)) % 3 as int) as n_replicas
  from part)"""

BAG = """
bag_events as (
  select user_id as bag_value, event_id as seq, case when event_type in ('error', 'view') then -1 else 1 end as delta
  from events),
run as (
  select *, sum(delta) over (partition by bag_value order by seq) as s from bag_events),
low as (
  select *, min(s) over (partition by bag_value order by seq) as m from run),
counted as (
  select *, cast(s - least(0, m) as bigint) as n,
         row_number() over (partition by bag_value order by seq desc) as from_end
  from low),
bag as (select bag_value, n from counted where from_end = 1 and n > 0)"""

WORDS = r"""
cut as (
  select doc_id, lower(text) as t, regexp_replace(lower(text), '\W+$', '') as c from documents where text is not null),
words as (
  select doc_id, unnest(case when t = '' then [''] when c = '' then [] else string_split_regex(c, '\W+') end) as word
  from cut)"""

LATEST_COMMITS = """
latest_commits as (
  select grp, topic, part_id, committed from (
    select *, row_number() over (partition by grp, topic, part_id order by log_pos desc) as from_end from commit_log)
  where from_end = 1 and committed is not null)"""

ENDS = """
ends as (select topic, part_id, cast(max(log_offset) + 1 as bigint) as log_end from topic_log group by all)"""

REPORT = """
report as (
  select grp, topic, part_id, committed, log_end, log_end - committed as lag, consumer_id, host, client_id
  from (select * from assignments full join latest_commits using (grp, topic, part_id))
  left join ends using (topic, part_id)
  where grp not in (select grp from groups_in where state = 'Dead'))"""

LAST_VALUES = """
last_values as (
  select topic, msg_key, msg_value from (
    select *, row_number() over (partition by topic, msg_key order by log_offset desc) as from_end from topic_log)
  where from_end = 1 and msg_value is not null)"""

INDEX = """
idx as (select distinct topic, grp, part_id from commit_log where committed is not null)"""

# What the damaged log does to the records of a class.
DAMAGED = """
damaged as (
  select *, case when log_pos % 25 in (3, 7) then 'unknown_key_version'
                 when log_pos % 25 = 19 then 'decode_error'
                 when committed is null then null
                 when log_pos % 25 = 11 then 'unsupported_value_version'
                 when log_pos % 25 = 13 then 'unknown_value_version'
                 when log_pos % 25 = 17 then 'decode_error' end as reason
  from commit_log),
damaged_groups as (
  select -1 - cast(substr(grp, 4) as bigint) as log_pos,
         case cast(substr(grp, 4) as int) when 0 then 'unsupported_value_version' when 1 then 'unknown_value_version'
              when 2 then 'decode_error' end as reason
  from groups_in)"""

ORPHANS = """
orphans as (
  select log_pos, grp, topic, part_id from (
    select *, lag(committed) over w as prev from {log} window w as (partition by grp, topic, part_id order by log_pos))
  where committed is null and prev is null)"""

SPECS = """
specs as (
  select c_mktsegment as topic, cast(c_custkey as varchar) as msg_key, 1 + c_custkey % 5 as n, c_custkey * 100 as start,
         c_acctbal >= 0 as alive
  from customer)"""

MEMBERS = """
members as (select distinct grp, consumer_id as member_id, client_id, host as client_host from assignments)"""


def _sql(body: str, *parts: str) -> str:
    return f"with {','.join(parts)}\n{body}" if parts else body


LAG_INPUTS = (TOPIC_LOG, COMMIT_LOG, ASSIGNMENTS, GROUPS, LATEST_COMMITS, ENDS, REPORT)

ORACLES: dict[str, str] = {
    "topic_scan": _sql("select topic, part_id, log_offset, msg_key, msg_value from topic_log", TOPIC_LOG),
    "topic_range": _sql(
        "select topic, part_id, log_offset, msg_key, msg_value from topic_log "
        "where topic = 'click' and part_id = 0 and log_offset >= 5 and log_offset < 40 "
        "or topic = 'click' and part_id = 2 and log_offset < 25 or topic = 'view' and part_id = 1 and log_offset >= 10",
        TOPIC_LOG,
    ),
    "sent_records": _sql("select topic, part_id, log_offset, msg_key from topic_log", TOPIC_LOG),
    "multi_topic_scan": _sql(
        "select topic, count(*) as n_records, count(*) filter (where msg_value is null) as n_tombstones "
        "from topic_log where topic in ('click', 'view') group by topic",
        TOPIC_LOG,
    ),
    "topic_list": "select distinct event_type as topic from events",
    "group_list": _sql("select distinct grp from commit_log", COMMIT_LOG),
    "generate_records": _sql(
        "select topic, msg_key, topic || cast(start + i as varchar) as msg_value "
        "from (select *, unnest(range(n)) as i from specs where alive) "
        "union all select topic, msg_key, null from specs where not alive",
        SPECS,
    ),
    "topic_roundtrip": _sql(
        "select topic, msg_key, topic || cast(start + n - 1 as varchar) as msg_value from specs where alive", SPECS
    ),
    "tokens": _sql("select doc_id, word, count(*) as n from words group by all", WORDS),
    "word_count": _sql("select word, count(*) as n from words group by all", WORDS),
    "record_text": _sql(
        "select topic, part_id, log_offset, 'Consumer Record:(key: ' || coalesce(msg_key, 'null') || ', value: ' || "
        "coalesce(msg_value, 'null') || ', partition: ' || part_id || ', offset: ' || log_offset || ', timestamp: ' || "
        "strftime(la, '%a %b %d %H:%M:%S') || case date_diff('hour', ts, la) when -8 then ' PST ' else ' PDT ' end || "
        "strftime(la, '%Y') || ')' as text "
        "from (select *, timezone('America/Los_Angeles', timezone('UTC', ts)) as la from topic_log)",
        TOPIC_LOG,
    ),
    "null_kinds": _sql(
        "select msg_value is null as is_null, coalesce(msg_value = 'null', false) as is_null_text, count(*) as n "
        "from topic_log group by all",
        TOPIC_LOG,
    ),
    "latest_by_key": _sql("select * from last_values", TOPIC_LOG, LAST_VALUES),
    "lookup_key": _sql("select topic, msg_value from last_values where msg_key = '8'", TOPIC_LOG, LAST_VALUES),
    "route_counts": _sql(
        "select case log_pos % 25 when 3 then 0 when 7 then 7 else 1 end as key_version, count(*) as n "
        "from commit_log group by all union all select 2, count(*) from groups_in",
        COMMIT_LOG, GROUPS,
    ),
    "decode_commits": _sql(
        "select log_pos, grp, topic, part_id, committed, case when committed is not null then commit_ms end as commit_ms, "
        "case when committed is not null then commit_ms + 86400000 end as expire_ms from commit_log",
        COMMIT_LOG,
    ),
    "expired_commits": _sql("select log_pos, grp, topic, part_id from commit_log where committed is null", COMMIT_LOG),
    "rejects": _sql(
        "select log_pos, reason from damaged where reason is not null "
        "union all select log_pos, reason from damaged_groups where reason is not null "
        "union all select log_pos, 'orphan_tombstone' from orphans",
        COMMIT_LOG, GROUPS, DAMAGED, ORPHANS.format(log="(select * from damaged where reason is null)"),
    ),
    "group_headers": _sql(
        "select distinct g.grp, 'consumer' as protocol_type, cast(substr(g.grp, 4) as int) + 1 as generation, "
        "case when consumer_id is not null then 'range' end as protocol, consumer_id as leader "
        "from groups_in g left join assignments a on a.grp = g.grp",
        ASSIGNMENTS, GROUPS,
    ),
    "group_members": _sql(
        "select grp, member_id, client_id, client_host, 30000 as session_timeout, 60000 as rebalance_timeout from members",
        ASSIGNMENTS, MEMBERS,
    ),
    "member_topics": _sql("select distinct consumer_id as member_id, topic from assignments", ASSIGNMENTS),
    "member_partitions": _sql("select consumer_id as member_id, topic, part_id from assignments", ASSIGNMENTS),
    "envelope_versions": (
        "select cast(event_id % 3 as int) as env_version, event_id % 3 = 1 as version_ok, count(*) as n "
        "from events group by all"
    ),
    "index_topic_group": _sql("select * from idx", COMMIT_LOG, INDEX),
    "index_group_topic": _sql(
        "select grp, topic, part_id from idx", COMMIT_LOG, INDEX,
    ),
    "live_index": _sql("select topic, grp, part_id from latest_commits", COMMIT_LOG, LATEST_COMMITS),
    "index_dump": _sql(
        "select 1 as index_kind, topic as entry_key, grp as entry_name, part_id from idx", COMMIT_LOG, INDEX,
    ),
    "orphan_tombstones": _sql("select * from orphans", COMMIT_LOG, ORPHANS.format(log="commit_log")),
    "log_end_offsets": _sql("select * from ends", TOPIC_LOG, ENDS),
    "latest_commits": _sql("select * from latest_commits", COMMIT_LOG, LATEST_COMMITS),
    "assigned_offsets": _sql(
        "select grp, topic, part_id, committed, consumer_id from assignments left join latest_commits "
        "using (grp, topic, part_id)",
        COMMIT_LOG, ASSIGNMENTS, LATEST_COMMITS,
    ),
    "unassigned_offsets": _sql(
        "select grp, topic, part_id, committed from latest_commits anti join assignments using (grp, topic, part_id)",
        COMMIT_LOG, ASSIGNMENTS, LATEST_COMMITS,
    ),
    "lag_report": _sql("select * from report", *LAG_INPUTS),
    "topic_groups": _sql("select distinct topic, grp from report", *LAG_INPUTS),
    "topic_group_counts": _sql(
        "select topic, count(distinct grp) as n_groups from report group by topic", *LAG_INPUTS
    ),
    "group_snapshot": _sql(
        "select g.grp, g.state, count(r.grp) as n_partitions, cast(sum(r.lag) as bigint) as total_lag "
        "from groups_in g left join report r on r.grp = g.grp group by g.grp, g.state",
        *LAG_INPUTS,
    ),
    "group_rows": _sql(
        "select g.grp, g.state, topic, part_id, lag, consumer_id from groups_in g left join report r on r.grp = g.grp",
        *LAG_INPUTS,
    ),
    "topic_partitions": _sql("select * from infos", PARTITIONS),
    "topic_partition_counts": _sql("select topic, count(*) as n_partitions from infos group by topic", PARTITIONS),
    "registration_rejects": (
        "select distinct p_brand as topic, 'decode_error' as reason from part "
        "where length(p_brand) % 2 = 1 or p_brand like '%3'"
    ),
    "topic_replica_counts": _sql(
        "select topic, cast(sum(n_replicas) as bigint) as n_replicas from infos group by topic", PARTITIONS
    ),
    "replication_factor": _sql(
        "select topic, cast(arg_min(n_replicas, part_id) as bigint) as replication_factor from infos group by topic",
        PARTITIONS,
    ),
    "key_value_sets": (
        "select o_custkey, count(distinct o_orderpriority) as n_values from orders group by o_custkey"
    ),
    "key_value_pairs": "select distinct o_custkey, o_orderpriority from orders",
    "bag_counts": _sql("select * from bag", BAG),
    "bag_bad_deletes": _sql(
        "select bag_value, seq from (select *, lag(n, 1, 0) over (partition by bag_value order by seq) as prev from counted) "
        "where delta = -1 and prev = 0",
        BAG,
    ),
    "bag_sample": _sql(
        "select bag_value from bag order by -ln((cast(cast('0x' || substr(md5('0|' || bag_value), 1, 8) as bigint) "
        "as double) + 0.5) / 4294967296) / n, bag_value limit 20",
        BAG,
    ),
}

# A stream over the whole source ends in the table of its batch form.
for _name in (
    "topic_scan", "lookup_key", "word_count", "latest_by_key", "live_index", "orphan_tombstones", "lag_report", "topic_groups",
    "group_snapshot",
):
    ORACLES[f"stream_{_name}"] = ORACLES[_name]
ORACLES["stream_word_count_topic"] = ORACLES["word_count"]
ORACLES["stream_index"] = ORACLES["index_topic_group"]
ORACLES["stream_key_value_sets"] = ORACLES["key_value_pairs"]
ORACLES["stream_index_dump"] = _sql(
    "select 1 as index_kind, topic as entry_key, grp as entry_name, part_id from idx "
    "union all select 2, grp, topic, part_id from idx",
    COMMIT_LOG, INDEX,
)
