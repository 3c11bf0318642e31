"""Registered queries over the driver's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive import cases  # noqa: F401  registers its queries
from missive.functions import display, html, mail
from missive.functions.normalise import normalised
from missive.operators import export, index, intervals, measure, store, sync
from missive.operators import search as s
from missive.plans.filters import Condition, day_bounds, wanted, write_cursor
from missive.plans.query import parse_query
from missive.scratch import scratch_path
from missive.sources import files, log, mailbox
from missive.sources.snapshots import Snapshots
from missive.streaming import cursors, flags
from missive.registry import QUERIES, SQL, over_store, over_tables, over_views
from missive.views import EPOCH, _stamp, sql, stored

COLUMNS = "id, account_id, folder_id, subject, sort_key"


# Search: term kinds, modes and exclusions.

KEY = "coalesce(m.date_sent, m.internal_date, '')"
HIT = "(contains(coalesce(subject_norm, ''), '{0}') OR contains(coalesce(sender_norm, ''), '{0}') OR contains(coalesce(body_text, ''), '{0}') OR contains(coalesce(attachment_names, ''), '{0}'))"
SEARCHES = {
    "match_3": ("the", "and"), "match_5": ("tions", "and"), "match_10": ("intionable", "and"), "match_and_high": ("the tion", "and"),
    "match_or": ("ingestion estion", "or"), "match_exclude": ("the -tion", "and"), "match_exclude_two": ("the -tion -ing", "and"),
    "match_or_exclude": ("ment tion -que", "or"), "match_phrase": ('"of the"', "and"), "like_high": ("th", "and"), "like_low": ("@", "and"),
    "like_and_match": ("ou tion", "and"), "attachment": ("xlsx", "and"), "sender": ("src7@example", "and"), "wide": ("ＴＨＥ", "and"), "percent": ("%%%", "and"),
}


def _search(name: str, query: str, mode: str) -> None:
    plan = parse_query(query, mode)
    where = f" {mode.upper()} ".join(HIT.format(t) for t in plan.include)
    less = "".join(f" AND NOT {HIT.format(t)}" for t in plan.exclude)
    oracle = f"SELECT m.id, m.account_id, {KEY} AS sort_key FROM messages m WHERE local_state = 'active' AND m.id IN (SELECT message_id FROM contents WHERE ({where}){less})"

    @over_store(f"x_search_{name}", oracle)
    def run(v):
        return s.selected(v, wanted(), plan).select("id", "account_id", s.sort_key().alias("sort_key"))


for _name, (_query, _mode) in SEARCHES.items():
    _search(_name, _query, _mode)


@over_store("x4_exclusions_compat", f"SELECT id FROM messages WHERE local_state = 'active' AND id IN (SELECT message_id FROM contents WHERE ({HIT.format('the')} AND NOT {HIT.format('tion')}) OR {HIT.format('ing')})")
def x4_exclusions_compat(v):
    return s.selected(v, wanted(), parse_query("the -tion -ing"), compat=True).select("id")


@over_store("a1_count_search", f"SELECT count(*) AS n FROM messages WHERE local_state = 'active' AND id IN (SELECT message_id FROM contents WHERE {HIT.format('the')})")
def a1_count_search(v):
    return s.count(v, plan=parse_query("the"))


@over_store("a1_count_filter", "SELECT count(*) AS n FROM messages WHERE has_attachment AND remote_state IN ('present', 'moved')")
def a1_count_filter(v):
    return s.count(v, wanted(attachment=True, local=None, remote=("present", "moved")))


# Filters.

FILTERS: dict[str, tuple[tuple[Condition, ...], str]] = {
    "f1_accounts": (wanted(accounts=("account-a", "account-b")), "account_id IN ('account-a', 'account-b') AND local_state = 'active'"),
    "f1_no_account": (wanted(accounts=()), "false"),
    "f1_folders": (wanted(folders=(1, 2, 7)), "folder_id IN (1, 2, 7) AND local_state = 'active'"),
    "f2_date_from": (wanted(since=datetime(2026, 7, 1, 6, tzinfo=UTC)), f"{KEY} >= '2026-07-01T06:00:00Z' AND local_state = 'active'"),
    "f3_date_to": (wanted(until=day_bounds(None, "2026-07-01")[1]), f"{KEY} <= '2026-07-01T23:59:59Z' AND local_state = 'active'"),
    "f4_attachment": (wanted(attachment=False), "NOT has_attachment AND local_state = 'active'"),
    "f5_trashed": (wanted(local=("trashed",)), "local_state = 'trashed'"),
    "f5_no_state": (wanted(local=()), "false"),
    "f6_remote": (wanted(remote=("moved", "deleted")), "remote_state IN ('moved', 'deleted') AND local_state = 'active'"),
    "f7_thread": (wanted(thread="7"), "thread_key = '7' AND local_state = 'active'"),
}


def _filtered(name: str, f: tuple[Condition, ...], where: str) -> None:
    @over_views(name, f"SELECT m.id, m.folder_id, {KEY} AS sort_key FROM messages m WHERE {where}")
    def run(v):
        return s.selected(v, f).select("id", "folder_id", s.sort_key().alias("sort_key"))


for _name, (_filter, _where) in FILTERS.items():
    _filtered(_name, _filter, _where)

# Pages, threads, details.

_SHOWN = f"""m.id, m.account_id, m.folder_id, f.raw_name AS folder_raw_name, f.display_name AS folder_name, coalesce(m.subject, '') AS subject, coalesce(m.sender, '') AS sender, m.date_sent, m.internal_date,
 m.size_bytes, m.has_attachment, m.imap_flags, m.flags_seen_at, m.local_state, m.remote_state, m.moved_to_folder_id, g.display_name AS moved_to_folder_name, m.thread_key, x.error_class AS failure_class, m.uid, {KEY} AS sort_key"""
_JOINS = """FROM messages m JOIN folders f ON f.id = m.folder_id LEFT JOIN folders g ON g.id = m.moved_to_folder_id
 LEFT JOIN failures x ON x.account_id = m.account_id AND x.folder_id = m.folder_id AND x.uidvalidity = m.uidvalidity AND x.uid = m.uid"""
_ORDER = f"ORDER BY {KEY} DESC, m.id DESC"
PLACE = ("2026-07-01T05:00:00Z", 300)


@over_store("o2_first_page", f"SELECT {_SHOWN} {_JOINS} WHERE m.local_state = 'active' {_ORDER} LIMIT 200")
def o2_first_page(v):
    return s.page_rows(v, wanted())


@over_store("o3_next_page", f"SELECT {_SHOWN} {_JOINS} WHERE m.local_state = 'active' AND ({KEY} < '{PLACE[0]}' OR ({KEY} = '{PLACE[0]}' AND m.id < {PLACE[1]})) {_ORDER} LIMIT 200")
def o3_next_page(v):
    return s.page_rows(v, wanted(), cursor=write_cursor(*PLACE))


@over_store("o3_search_page", f"SELECT {_SHOWN} {_JOINS} WHERE m.local_state = 'active' AND m.has_attachment AND m.account_id = 'account-a' AND m.id IN (SELECT message_id FROM contents WHERE {HIT.format('tion')}) {_ORDER} LIMIT 50")
def o3_search_page(v):
    return s.page_rows(v, wanted(accounts=("account-a",), attachment=True), parse_query("tion"), limit=50)


@over_store("o8_deep_page", f"SELECT m.id, {KEY} AS sort_key FROM messages m WHERE local_state = 'active' {_ORDER} LIMIT 200 OFFSET greatest(0, least(10000, (SELECT count(*) FROM messages WHERE local_state = 'active') - 200))")
def o8_deep_page(v):
    """The page at offset 10,000, or the last one of fewer rows."""
    return s.deep_page(v, wanted(), 10_000)


@over_store("o4_thread", f"SELECT {_SHOWN} {_JOINS} WHERE m.thread_key = '7' AND m.local_state = 'active'")
def o4_thread(v):
    return s.thread(v, "7")


@over_store("s4_detail", f"SELECT {_SHOWN}, m.recipient, m.cc, m.message_id, m.in_reply_to, m.references_ids, m.relative_path, m.file_hash {_JOINS} WHERE m.id = 21")
def s4_detail(v):
    return s.detail(v, 21)


_JSON = """'{"id":' || m.id || ',"account_id":"' || m.account_id || '","local_state":"' || m.local_state || '"}' """


@over_views("k25_json_lines", f"SELECT {_JSON} AS line FROM messages m WHERE local_state = 'active'")
def k25_json_lines(v):
    return export.json_lines(s.selected(v, wanted()), ("id", "account_id", "local_state"))


@over_views("k25_tab_lines", f"SELECT m.id || chr(9) || {KEY} || chr(9) || coalesce(translate(m.sender, chr(9) || chr(13) || chr(10), '   '), '') || chr(9) || coalesce(translate(m.subject, chr(9) || chr(13) || chr(10), '   '), '') AS line FROM messages m JOIN folders f ON f.id = m.folder_id WHERE local_state = 'active'")
def k25_tab_lines(v):
    return export.tab_lines(s.summaries(s.with_names(s.selected(v, wanted()), v.folders, v.failures)))


# Scans.


@over_views("s1_accounts", "SELECT id, provider_type, is_enabled FROM accounts")
def s1_accounts(v):
    return v.accounts.select("id", "provider_type", "is_enabled").orderBy("id")


@over_views("s2_folders", "SELECT id, raw_name, display_name FROM folders WHERE account_id = 'account-a'")
def s2_folders(v):
    return v.folders.where("account_id = 'account-a'").select("id", "raw_name", "display_name").orderBy("id")


@over_views("s3_sync_targets", "SELECT id, raw_name FROM folders WHERE account_id = 'account-b' AND is_sync_target")
def s3_sync_targets(v):
    return v.folders.where("account_id = 'account-b' AND is_sync_target").select("id", "raw_name").orderBy("id")


@over_views("s5_natural_key", "SELECT id, message_id FROM messages WHERE account_id = 'account-b' AND folder_id = 1 AND uidvalidity = 1 AND uid = 21")
def s5_natural_key(v):
    return store.by_key(v.messages, "account-b", 1, 1, 21).select("id", "message_id")


@over_views("s6_local_uids", "SELECT uid FROM messages WHERE account_id = 'account-b' AND folder_id = 1 AND uidvalidity = 1 AND uid IS NOT NULL")
def s6_local_uids(v):
    return store.known_uids(v.messages, "account-b", 1, 1)


@over_views("s7_exists", "SELECT count(*) > 0 AS found FROM messages WHERE account_id = 'account-b' AND message_id = '<m21@example.org>'")
def s7_exists(v):
    return store.exists(v.messages, "account-b", "<m21@example.org>")


@over_views("s8_first_stored", "SELECT account_id, file_hash, arg_min(relative_path, id) AS relative_path, min(id) AS id FROM messages WHERE relative_path IS NOT NULL GROUP BY ALL")
def s8_first_stored(v):
    return store.first_stored(v.messages)


@over_views("s9_flag_window", "SELECT id, uid FROM messages WHERE uid IS NOT NULL AND internal_date >= '2026-07-01T08:00:00Z'")
def s9_flag_window(v):
    return sync.flag_window(v.messages, "2026-07-01T08:00:00Z").select("id", "uid")


@over_views("s10_pending_failures", "SELECT uid, error_class, attempt_count FROM failures WHERE attempt_count < 10")
def s10_pending_failures(v):
    return store.pending(v.failures).select("uid", "error_class", "attempt_count")


@over_views("s11_reparse_targets", "SELECT id FROM messages m WHERE relative_path IS NOT NULL AND EXISTS (SELECT 1 FROM failures x WHERE x.error_class = 'parse' AND x.account_id = m.account_id AND x.folder_id = m.folder_id AND x.uidvalidity = m.uidvalidity AND x.uid = m.uid)")
def s11_reparse_targets(v):
    return sync.reparse_targets(v.messages, v.failures, True).select("id")


# Synchronisation.

_GONE = "SELECT * FROM messages m WHERE uid IS NOT NULL AND uid % 5 = 0"


def _remote(v) -> DataFrame:
    """A mailbox that lists four fifths of what is stored, with other flags for some."""
    rows = v.messages.where("uid IS NOT NULL AND uid % 5 <> 0")
    flags = F.when(F.col("uid") % 3 == 0, "\\Seen").otherwise(F.col("imap_flags"))
    return rows.select(*sync.PLACE, flags.alias("flags"), (F.col("uid") % 100).alias("modseq"))


@over_views("j6_missing", "SELECT id FROM messages WHERE uid IS NOT NULL AND uid % 5 = 0")
def j6_missing(v):
    return sync.missing(v.messages, _remote(v)).select("id")


@over_views("i16_moves", f"""
SELECT g.id, count(c.id) AS candidates, CASE WHEN count(c.id) = 1 THEN 'moved' WHEN count(c.id) = 0 THEN 'deleted' ELSE 'unknown' END AS remote_state,
 CASE WHEN count(c.id) = 1 THEN min(c.folder_id) END AS moved_to_folder_id
FROM ({_GONE}) g LEFT JOIN messages c ON c.account_id = g.account_id AND c.content_key = g.content_key AND c.file_hash = g.file_hash AND c.folder_id <> g.folder_id AND c.remote_state = 'present'
GROUP BY g.id""")  # fmt: skip
def i16_moves(v):
    return sync.moves(sync.missing(v.messages, _remote(v)), v.messages)


NOW = "2026-07-02T00:00:00Z"
_EXPIRED = f"(flags_seen_at IS NULL OR flags_seen_at <= '{'2026-07-01T23:00:00Z'}')"
_NEW = "CASE WHEN uid % 3 = 0 THEN '\\Seen' ELSE imap_flags END"
_WINDOW = "uid IS NOT NULL AND internal_date >= '2026-07-01T01:00:00Z'"


def _flags(name: str, where: str, changed: str, path: str, modseq: int = 0) -> None:
    @over_views(name, f"SELECT id, CASE WHEN {changed} THEN {_NEW} ELSE imap_flags END AS imap_flags, '{NOW}' AS flags_seen_at, {changed} AS changed FROM messages WHERE {_WINDOW} AND {where}")
    def run(v):
        return sync.refreshed_flags(sync.flag_window(v.messages, "2026-07-01T01:00:00Z"), _remote(v), NOW, path, modseq)


_flags("i11_flags_baseline", "uid % 5 <> 0", f"(imap_flags <> {_NEW})", "baseline")
_flags("i12_flags_delta", f"((uid % 5 <> 0 AND uid % 100 > 40) OR {_EXPIRED})", f"(uid % 5 <> 0 AND uid % 100 > 40 AND imap_flags <> {_NEW})", "delta", 40)
_flags("i13_flags_ttl", f"uid % 5 <> 0 AND {_EXPIRED}", f"(imap_flags <> {_NEW})", "ttl")


@over_views("j8_folder_changes", "SELECT 'src99' AS raw_name, 'new' AS change UNION ALL SELECT raw_name, 'removed' FROM folders WHERE id >= 15")
def j8_folder_changes(v):
    remote = v.folders.where("id < 15").select("raw_name").unionByName(v.folders.limit(1).select(F.lit("src99").alias("raw_name")))
    return sync.folder_changes(remote, v.folders)


@over_views("i2_to_fetch", "SELECT uid, CASE WHEN uid > 600 THEN 'forward' ELSE 'backfill' END AS part, size_bytes > 4000 AS oversize FROM messages WHERE uidvalidity = 1 AND uid IS NOT NULL AND uid % 5 = 0 AND (uid > 600 OR uid <= 300)")
def i2_to_fetch(v):
    remote = v.messages.where("uid IS NOT NULL").select(*sync.PLACE, "size_bytes")
    at = v.folders.select(F.col("id").alias("folder_id"), F.lit(1).cast("long").alias("uidvalidity"), F.lit(600).alias("last_seen_uid"), F.lit(300).alias("backfill_next_uid"))
    return sync.admitted(sync.to_fetch(remote, _remote(v), at), 4000).select("uid", "part", "oversize")


@over_views("i1_cursors", "SELECT folder_id, uidvalidity, coalesce(max(uid), 0) AS last_seen_uid, coalesce(max(uid), 0) AS backfill_next_uid, coalesce(max(uid), 0) = 0 AS initial_sync_completed FROM messages GROUP BY ALL")
def i1_cursors(v):
    top = v.messages.groupBy("folder_id", "uidvalidity").agg(F.max("uid").alias("max_uid"))
    return store.cursors(top).drop("highest_modseq")


@over_views("a2_run_statistics", "SELECT sum((uid % 4 IN (0, 1))::INT)::BIGINT AS fetched, coalesce(sum(size_bytes) FILTER (uid % 4 = 0), 0)::BIGINT AS transferred_bytes, sum((uid % 4 IN (1, 2))::INT)::BIGINT AS skipped, sum((uid % 4 IN (1, 3))::INT)::BIGINT AS failed FROM messages WHERE uid IS NOT NULL")
def a2_run_statistics(v):
    kinds = F.array(*map(F.lit, ("stored", "oversize", "known", "transient")))
    return sync.run_statistics(v.messages.where("uid IS NOT NULL").select(F.element_at(kinds, (F.col("uid") % 4 + 1).cast("int")).alias("outcome"), "size_bytes"))


# Upserts.


@over_views("k1_upsert_accounts", "SELECT id, 'imap' AS provider_type, account_id_enabled AS is_enabled FROM (SELECT id, CASE WHEN id = 'account-c' THEN true ELSE is_enabled END AS account_id_enabled FROM accounts) UNION ALL SELECT 'account-z', 'imap', true")
def k1_upsert_accounts(v):
    named = v.accounts.where("id = 'account-c'")
    changes = named.select("id", "provider_type", F.lit(True).alias("is_enabled"), F.lit(1).alias("seq"))
    changes = changes.unionByName(named.select(F.lit("account-z").alias("id"), "provider_type", F.lit(True).alias("is_enabled"), F.lit(2).alias("seq")))
    return store.upsert(v.accounts, changes, ("id",))


@over_views("k2_upsert_folders", "SELECT id, account_id, raw_name, CASE WHEN id % 2 = 0 THEN 'new ' || raw_name ELSE display_name END AS display_name, uidvalidity, is_sync_target FROM folders")
def k2_upsert_folders(v):
    changes = v.folders.where("id % 2 = 0").select("account_id", "raw_name", F.concat(F.lit("new "), "raw_name").alias("display_name"), F.lit(False).alias("is_sync_target"), F.lit(1).alias("seq"))
    return store.upsert(v.folders, changes, ("account_id", "raw_name"), ("display_name",))


@over_views("k3_upsert_messages", "SELECT count(*) AS n, count(DISTINCT id) AS ids, sum((remote_state = 'present')::INT)::BIGINT AS present, max(id) AS last FROM (SELECT id, CASE WHEN uid % 2 = 0 THEN 'present' ELSE remote_state END AS remote_state FROM messages UNION ALL SELECT row_number() OVER () + (SELECT max(id) FROM messages), 'present' FROM messages WHERE uid % 10 = 1)")
def k3_upsert_messages(v):
    columns = ["id", "account_id", "folder_id", "uidvalidity", "uid", "remote_state", "size_bytes"]
    table = v.messages.select(*columns, F.col("message_id").alias("source_item_key"))
    known = table.where("uid % 2 = 0").select(*columns[1:5], F.lit("present").alias("remote_state"), "size_bytes", "source_item_key")
    fresh = table.where("uid % 10 = 1").select("account_id", "folder_id", (F.col("uidvalidity") + 10).alias("uidvalidity"), "uid", F.lit("present").alias("remote_state"), "size_bytes", "source_item_key")
    out = store.upsert_messages(table, known.unionByName(fresh).withColumn("seq", F.lit(1)))
    return out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum((F.col("remote_state") == "present").cast("long")).alias("present"), F.max("id").alias("last"))


@over_views("k11_failures", "SELECT account_id, folder_id, uidvalidity, uid, CASE WHEN n = 2 THEN 'permanent' ELSE 'transient' END AS error_class, n AS attempt_count, 'T0' AS first_failed_at, CASE WHEN n = 2 THEN 'T1' ELSE 'T0' END AS last_failed_at FROM (SELECT *, CASE WHEN uid % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM failures)")
def k11_failures(v):
    first = v.failures.select(*store.FAILURE_KEY, F.lit("transient").alias("error_class"), F.lit("T0").alias("at"), F.lit(0).alias("seq"))
    again = first.where("uid % 3 = 0").select(*store.FAILURE_KEY, F.lit("permanent").alias("error_class"), F.lit("T1").alias("at"), F.lit(1).alias("seq"))
    return store.failures(first.unionByName(again))


@over_views("k12_cleared", "SELECT uid, error_class FROM failures WHERE uid % 2 = 1")
def k12_cleared(v):
    return store.without(v.failures, v.failures.where("uid % 2 = 0")).select("uid", "error_class")


@over_views("k9_set_flags", "SELECT id, CASE WHEN uid % 3 = 0 THEN '\\Seen' ELSE imap_flags END AS imap_flags FROM messages")
def k9_set_flags(v):
    changes = v.messages.where("uid % 3 = 0").select(*sync.PLACE, F.lit("\\Seen").alias("imap_flags"))
    return store.set_columns(v.messages, changes, sync.PLACE).select("id", "imap_flags")


_CLOCK = "o_orderdate + to_seconds(o_orderkey % 86400)"
_DAY, _TIME = f"strftime({_CLOCK}, '%Y-%m-%d')", f"strftime({_CLOCK}, '%H:%M:%S')"


@over_tables("k23_canonical_times", f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS t, CASE o_orderkey % 7
  WHEN 0 THEN {_DAY} || 'T' || {_TIME} || 'Z' WHEN 1 THEN strftime({_CLOCK} - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN {_DAY} || 'T00:00:00Z'
  WHEN 3 THEN strftime({_CLOCK}, '%Y') || '-02-30 ' || {_TIME} WHEN 4 THEN {_DAY} || 'T' || {_TIME} || '+09:00' WHEN 5 THEN {_DAY} || strftime({_CLOCK}, 'T%H:%M:00Z')
  ELSE {_DAY} || 'T' || {_TIME} || 'Z' END AS other FROM orders""")
def k23_canonical_times(t):
    """Each order's time as it is, and in other forms: a fraction, a zone, a day alone, no day of any month, one that is written so
    already, minutes, and UTC."""
    k = F.col("o_orderkey")
    seconds = F.pmod(k, F.lit(86_400)).cast("long")
    clock = F.substring(display.utc_seconds(seconds), 12, 8)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = (
        F.concat(day, F.lit(" "), clock, F.lit(".5")), F.concat(day, F.lit(" "), clock, F.lit("+09:00")), day, F.concat(F.substring(day, 1, 4), F.lit("-02-30 "), clock),
        F.concat(day, F.lit("T"), clock, F.lit("+09:00")), F.concat(day, F.lit(" "), F.substring(clock, 1, 5)), F.concat(day, F.lit(" "), clock, F.lit("Z")),
    )
    other = F.element_at(F.array(*forms), (F.pmod(k, F.lit(7)) + 1).cast("int"))
    plain = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t("orders").select("o_orderkey", store.canonical_time(plain).alias("t"), store.canonical_time(other).alias("other"))


# Files and log.


@over_views("k16_stored_once", "SELECT id, row_number() OVER (PARTITION BY account_id, file_hash ORDER BY id) > 1 OR EXISTS (SELECT 1 FROM messages o WHERE o.account_id = m.account_id AND o.file_hash = m.file_hash AND o.id % 10 = 0) AS deduplicated FROM messages m WHERE id % 10 <> 0")
def k16_stored_once(v):
    incoming = v.messages.where("id % 10 <> 0").select("id", "account_id", F.col("file_hash").alias("sha256"), F.col("id").alias("seq"))
    return files.stored_once(incoming, v.messages.where("id % 10 = 0")).select("id", "deduplicated")


# DuckDB has no CRC-32, so a checksum is compared as the answer to whether it is that of the text.
@over_views("k14_event_lines", """SELECT id, '{"account_id":"' || account_id || '","event":"fetch","uid":' || coalesce(CAST(uid AS VARCHAR), 'null') || '}' AS event, true AS right FROM messages""")
def k14_event_lines(v):
    line = log.line({"account_id": F.col("account_id"), "event": F.lit("fetch"), "uid": F.col("uid")})
    text, told = F.substring_index(line, log.MARK, 1), F.substring_index(line, log.MARK, -1)
    return v.messages.select("id", text.alias("event"), (F.conv(told, 16, 10).cast("long") == F.crc32(text.cast("binary"))).alias("right"))


@over_views("s14_log_round_trip", "SELECT account_id, 'fetch' AS event, uid FROM messages")
def s14_log_round_trip(v):
    """Events written to the log's files and read back, with a torn line at the end of one more file."""
    spark = v.messages.sparkSession
    path = scratch_path(spark, "log")
    log.write(v.messages.select("account_id", F.lit("fetch").alias("event"), "uid", F.lit(NOW).alias("timestamp")), path)
    torn = spark.createDataFrame([('{"event":"fetch","uid":1}|CRC32:0000',)], "value string")
    torn.coalesce(1).write.mode("append").text(f"{path}/account=torn/month=202601")
    return log.read(spark, path).select("account_id", "event", "uid")


@over_views("k15_valid_events", "SELECT id, id % 3 = 0 AND uid IS NOT NULL OR id % 3 = 2 AS ok FROM messages")
def k15_valid_events(v):
    kind = F.element_at(F.array(*map(F.lit, ("fetch", "fetch_skipped", "moved"))), (F.col("id") % 3 + 1).cast("int"))
    rows = v.messages.select(
        "id", kind.alias("event"), F.lit(NOW).alias("timestamp"), "account_id", "folder_id", F.lit("x").alias("folder_raw_name"), "uid", "uidvalidity",
        F.lit("1:2").alias("source_item_key"), "relative_path", "file_hash", "size_bytes", F.lit("oversize").alias("reason"),
    )
    return rows.select("id", log.valid().alias("ok"))


@over_tables("i22_replay", "SELECT user_id AS uid, count(*) AS n_events, arg_max(CASE event_type WHEN 'click' THEN 'moved' WHEN 'purchase' THEN 'deleted' ELSE 'present' END, event_id) AS remote_state FROM events GROUP BY 1")
def i22_replay(t):
    kind = F.when(F.col("event_type") == "click", "moved").when(F.col("event_type") == "purchase", "delete_detected").otherwise("fetch")
    rows = t("events").select(
        F.lit("a").alias("account_id"), F.lit(1).alias("folder_id"), F.lit(1).alias("uidvalidity"), F.col("user_id").alias("uid"), kind.alias("event"),
        display.utc_seconds(F.col("event_id")).alias("timestamp"), F.col("event_id").alias("place"), F.lit("p").alias("relative_path"), F.lit(None).cast("long").alias("moved_to_folder_id"),
    )
    return log.replay(rows).select("uid", "n_events", "remote_state")


# Functions.


@over_tables("n1_normalise", r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS text FROM documents")
def n1_normalise(t):
    return t("documents").select("doc_id", normalised(F.col("text")).alias("text"))


@over_tables("n23_sizes", "SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size FROM (SELECT doc_id, n_chars * (doc_id % 7) * (doc_id % 5) * 64 + 1 AS n FROM documents)")
def n23_sizes(t):
    n = F.col("n_chars") * (F.col("doc_id") % 7) * (F.col("doc_id") % 5) * 64 + 1
    return t("documents").select("doc_id", display.size_text(n).alias("size"))


@over_tables("n25_masked", r"SELECT doc_id, regexp_replace(regexp_replace(text, '([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+)', '\1***@\2', 'g'), '(?i)\b(password|token|secret)([ \t\n\r\f\v]*[=:][ \t\n\r\f\v]*)[^ \t\n\r\f\v]+', '\1\2***', 'g') AS text FROM documents")
def n25_masked(t):
    return t("documents").select("doc_id", display.masked(F.col("text")).alias("text"))


@over_views("n26_subjects", "SELECT id, CASE WHEN length(subject) > 20 THEN substr(subject, 1, 20) || '...' ELSE subject END AS short, CASE WHEN local_state = 'purged' THEN '(purged)' WHEN id % 6 = 0 THEN coalesce(subject, '') || ' [oversize]' ELSE coalesce(subject, '') END AS shown FROM messages")
def n26_subjects(v):
    failed = F.when(F.col("id") % 6 == 0, "oversize")
    return v.messages.select("id", display.short_subject(F.col("subject")).alias("short"), display.shown_subject(F.col("subject"), F.col("local_state"), failed).alias("shown"))


@over_views("f19_status", "SELECT id, CASE WHEN remote_state = 'deleted' THEN 'deleted' WHEN NOT list_contains(string_split(imap_flags, ' '), '\\Seen') THEN 'unread' WHEN list_contains(string_split(imap_flags, ' '), '\\Flagged') THEN 'flagged' ELSE 'none' END AS status FROM messages")
def f19_status(v):
    return v.messages.select("id", display.status(F.col("remote_state"), F.col("imap_flags")).alias("status"))


@over_tables("f21_urls", r"SELECT page_id, length(url) <= 4096 AND regexp_matches(url, '(?i)^https?://[^/?#@:\s]+(:[0-9]{0,5})?([/?#].*)?$') AS ok FROM pages")
def f21_urls(t):
    return t("pages").select("page_id", display.allowed_url(F.col("url")).alias("ok"))


@over_views("n6_keys", "SELECT id, CASE WHEN id % 3 = 0 THEN '<root@x>' WHEN id % 3 = 1 THEN '<m' || id - 1 || '@example.org>' ELSE message_id END AS thread_key, CASE WHEN id % 2 = 0 THEN message_id ELSE 'sha256:' || substr(sha256(subject), 1, 32) END AS content_key FROM messages")
def n6_keys(v):
    i = F.col("id")
    refs, reply = F.when(i % 3 == 0, " <root@x> <b@x>"), F.when(i % 3 <= 1, F.concat(F.lit("<m"), (i - 1).cast("string"), F.lit("@example.org>")))
    mid = F.when(i % 2 == 0, F.concat(F.lit(" "), "message_id"))
    return v.messages.select("id", mail.thread_key_of(F.col("message_id"), reply, refs).alias("thread_key"), mail.content_key_of(mid, F.col("subject").cast("binary")).alias("content_key"))


@over_views("n11_paths", "SELECT id, 'eml/' || account_id || '/' || coalesce(replace(substr(internal_date, 1, 7), '-', '/'), 'unknown') || '/' || substr(file_hash, 1, 32) || '.eml' AS path FROM messages")
def n11_paths(v):
    return v.messages.select("id", display.message_path(F.col("account_id"), F.col("internal_date"), F.col("file_hash")).alias("path"))


@over_tables("u7_trigrams", "SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS g FROM benchmark) GROUP BY ALL")
def u7_trigrams(t):
    return t("benchmark").select("item_id", F.explode(display.trigrams(F.col("text"))).alias("g")).groupBy("item_id", "g").agg(F.count("*").alias("n"))


@over_tables("n16_html_text")
def n16_html_text(t):
    return t("pages").select("page_id", html.html_texts(F.col("html")).alias("text"))


@over_tables("n17_sanitised")
def n17_sanitised(t):
    return t("pages").select("page_id", html.sanitised(F.col("html")).alias("html"), html.remote_images(F.col("html")).alias("remote"))


@over_tables("u1_parsed")
def u1_parsed(t):
    """Each conversation turn as a message, parsed."""
    raw = F.concat(F.lit("Message-ID: <"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("@x>\r\nSubject: "), "role", F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), "text")
    m = mail.parsed(raw.cast("binary"), F.lit(NOW), datetime(2026, 7, 30, tzinfo=UTC))
    return t("conversations").select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", "m.subject", "m.message_id", "m.thread_key", F.col("m.body_text").alias("body_text"), "m.parse_error")


SQL["u1_parsed"] = "SELECT conv_id, turn, role AS subject, '<' || conv_id || '.' || turn || '@x>' AS message_id, '<' || conv_id || '.' || turn || '@x>' AS thread_key, CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN '' ELSE text END AS body_text, CAST(NULL AS VARCHAR) AS parse_error FROM conversations"


@over_tables("n19_safe_names")
def n19_safe_names(t):
    name = F.concat(F.lit("../"), F.col("text"), F.lit("?.txt. "))
    return t("documents").select("doc_id", mail.safe_names(name).alias("n")).select("doc_id", "n.name", F.array_join("n.warnings", ",").alias("warnings"))


# Aggregates and the tree.


@over_views("j13_folder_counts", "SELECT a.id AS account_id, f.id AS folder_id, f.display_name, count(m.id) AS n FROM accounts a JOIN folders f ON f.account_id = a.id LEFT JOIN messages m ON m.folder_id = f.id GROUP BY ALL")
def j13_folder_counts(v):
    return measure.folder_counts(v.accounts, v.folders, v.messages)


_TREE = """SELECT 'mail-accounts' AS key, CAST(NULL AS VARCHAR) AS parent, 'root' AS kind, 'Accounts' AS display_name, CAST(NULL AS VARCHAR) AS account_id, CAST(NULL AS BIGINT) AS folder_id
UNION ALL SELECT 'all-accounts', 'mail-accounts', 'all_accounts', 'All accounts', NULL, NULL
UNION ALL SELECT 'account:' || id, 'mail-accounts', 'account', id, id, NULL FROM accounts
UNION ALL SELECT 'folder:' || f.id, 'account:' || f.account_id, 'folder', f.display_name, f.account_id, f.id FROM folders f JOIN accounts a ON a.id = f.account_id"""


@over_views("u8_folder_tree", _TREE)
def u8_folder_tree(v):
    return measure.folder_tree(v.accounts, v.folders)


@over_tables("a10_percentiles", "SELECT source, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY source")
def a10_percentiles(t):
    return measure.percentiles(t("documents"), "source", "n_chars")


@over_views("a11_payload_bytes", "SELECT sum(strlen(coalesce(subject_norm, '')) + strlen(coalesce(sender_norm, '')) + strlen(coalesce(body_text, '')) + strlen(coalesce(attachment_names, '')))::BIGINT AS bytes, count(*) AS n FROM contents")
def a11_payload_bytes(v):
    return measure.payload_bytes(v.contents)


@over_tables("a12_extrapolation", "SELECT source, round(greatest(0, regr_slope(n_chars, doc_id) * 50000 + regr_intercept(n_chars, doc_id)), 2) AS at_50000 FROM documents GROUP BY source")
def a12_extrapolation(t):
    return measure.extrapolated(t("documents"), "source", "doc_id", "n_chars", 50_000)


# The search index itself: built anew, and after changes, as the messages that hold each piece.

_PIECES = """pieces AS (SELECT DISTINCT message_id, substr(t, i, 3) AS gram FROM (SELECT message_id, t, unnest(range(1, length(t) - 1)) AS i FROM
  (SELECT message_id, unnest([subject_norm, sender_norm, body_text, attachment_names]) AS t FROM now) WHERE length(t) >= 3))
SELECT gram, count(*) AS messages, min(message_id) AS first_id, max(message_id) AS last_id FROM pieces GROUP BY gram"""


def _of_index(built: index.Index) -> DataFrame:
    return built.pieces().where(F.length("gram") == 3).groupBy("gram").agg(F.count("*").alias("messages"), F.min("message_id").alias("first_id"), F.max("message_id").alias("last_id"))


@over_views("k24_index_build")
def k24_index_build(v):
    return _of_index(index.build(v.contents, scratch_path(v.contents.sparkSession, "index")))


SQL["k24_index_build"] = sql("SELECT * FROM contents").replace("SELECT * FROM contents", ", now AS (SELECT * FROM contents), " + _PIECES)


@over_store("k24_index_update")
def k24_index_update(v):
    """A tenth of the messages go, another has its subjects as bodies, and there are new ones."""
    spark = v.contents.sparkSession
    built = index.build(v.contents, scratch_path(spark, "index"))
    old, new = v.contents, F.col("message_id")
    gone = old.where(new % 10 == 3).withColumn("removed", F.lit(True))
    other = old.where(new % 10 == 4).withColumn("body_text", F.col("subject_norm")).withColumn("removed", F.lit(False))
    fresh = old.where(new % 10 == 5).withColumns({"message_id": new + 1_000_000, "removed": F.lit(False)})
    changes = gone.unionByName(other).unionByName(fresh)
    return _of_index(index.updated(built, changes))


SQL["k24_index_update"] = sql("SELECT * FROM contents").replace(
    "SELECT * FROM contents",
    """, now AS (SELECT message_id, subject_norm, sender_norm, CASE WHEN message_id % 10 = 4 THEN subject_norm ELSE body_text END AS body_text, attachment_names FROM contents WHERE message_id % 10 <> 3
  UNION ALL SELECT message_id + 1000000, subject_norm, sender_norm, body_text, attachment_names FROM contents WHERE message_id % 10 = 5), """ + _PIECES,
)


# The commit log: batches that are seen whole or not at all, buckets that are rewritten, look-ups by hash.


def _log_of(v) -> Snapshots:
    spark = v.messages.sparkSession
    return Snapshots(spark, scratch_path(spark, "commits"))


@over_views("k13_committed_batches", "SELECT id, file_hash, id % 3 AS batch FROM messages WHERE id % 3 <> 2")
def k13_committed_batches(v):
    """Messages in three batches, of which the last has been written but not published."""
    store_ = _log_of(v)
    for batch in range(3):
        commit = store_.begin()
        commit.append("messages", v.messages.where(F.col("id") % 3 == batch).select("id", "file_hash", F.lit(batch).cast("long").alias("batch")))
        if batch < 2:
            commit.publish()
    return store_.read("messages").select("id", "file_hash", "batch")


_NATURAL = (*sync.PLACE, "source_item_key")
_NEAR = ("account_id", "folder_id", "uidvalidity", "uid div 1000")


def _keyed(v) -> Snapshots:
    """The message table in buckets, in which neighbouring uids of a folder lie together."""
    store_ = _log_of(v)
    commit = store_.begin()
    commit.create("messages", v.messages.select("id", *sync.PLACE, F.col("message_id").alias("source_item_key"), "remote_state", "imap_flags", "size_bytes"), _NEAR, 32)
    commit.publish()
    return store_


@over_views("k3_merged_messages", """SELECT account_id, folder_id, uidvalidity, uid, message_id AS source_item_key, CASE WHEN folder_id = 1 AND uid % 2 = 0 THEN 'present' ELSE remote_state END AS remote_state, imap_flags, size_bytes, id AS known_id FROM messages
 UNION ALL SELECT account_id, folder_id, uidvalidity + 10, uid, message_id, 'present', NULL, size_bytes, NULL FROM messages WHERE folder_id = 2 AND uid % 2 = 1""")
def k3_merged_messages(v):
    """Changes of one folder and a new generation of another: only their buckets are rewritten, and new rows get the next ids."""
    store_ = _keyed(v)
    rows = v.messages.select(*sync.PLACE, F.col("message_id").alias("source_item_key"), F.lit("present").alias("remote_state"), "size_bytes", F.lit(1).alias("seq"))
    known = rows.where("folder_id = 1 AND uid % 2 = 0")
    fresh = rows.where("folder_id = 2 AND uid % 2 = 1").withColumn("uidvalidity", F.col("uidvalidity") + 10)
    commit = store_.begin()
    commit.merge("messages", known.unionByName(fresh), _NATURAL, supplied=("remote_state",), ids=("id", _NATURAL))
    commit.publish()
    out = store_.read("messages")
    return out.select(*_NATURAL, "remote_state", "imap_flags", "size_bytes", F.when(F.col("uidvalidity") < 10, F.col("id")).alias("known_id"))


@over_views("k9_merged_flags", "SELECT id, CASE WHEN folder_id = 3 AND uid % 3 = 0 THEN '\\Seen' ELSE imap_flags END AS imap_flags, remote_state FROM messages WHERE NOT (folder_id = 4 AND uid % 2 = 0 AND uid IS NOT NULL)")
def k9_merged_flags(v):
    """Flags of one folder are set, and messages of another removed, in one commit each."""
    store_ = _keyed(v)
    commit = store_.begin()
    changes = v.messages.where("folder_id = 3 AND uid % 3 = 0").select(*_NATURAL[:4], F.col("message_id").alias("source_item_key"), F.lit("\\Seen").alias("imap_flags"), F.lit(None).cast("string").alias("remote_state"), F.lit(1).alias("seq"))
    commit.merge("messages", changes, _NATURAL, insert=False, nulls=())
    commit.publish()
    commit = store_.begin()
    commit.remove("messages", v.messages.where("folder_id = 4 AND uid % 2 = 0").select(*sync.PLACE), sync.PLACE)
    commit.publish()
    return store_.read("messages").select("id", "imap_flags", "remote_state")


@over_views("j11_known_contents", "SELECT id, EXISTS (SELECT 1 FROM messages o WHERE o.account_id = m.account_id AND o.file_hash = m.file_hash AND o.id % 2 = 0) AS known FROM messages m WHERE id % 2 = 1")
def j11_known_contents(v):
    """Contents that earlier commits stored, looked up in the runs of their hashes."""
    store_ = _log_of(v)
    for part in range(3):
        commit = store_.begin()
        commit.add_run("hashes", v.messages.where((F.col("id") % 2 == 0) & (F.col("id") % 3 == part)).select("account_id", "file_hash"), "file_hash")
        commit.publish()
    known = store_.read("hashes").distinct().withColumn("_known", F.lit(True))
    rows = v.messages.where("id % 2 = 1").join(known, ["account_id", "file_hash"], "left")
    return rows.select("id", F.coalesce("_known", F.lit(False)).alias("known"))


@over_tables("i22_incremental_replay", "SELECT user_id AS uid, count(*) AS n_events, arg_max(CASE event_type WHEN 'click' THEN 'moved' WHEN 'purchase' THEN 'deleted' ELSE 'present' END, event_id) AS remote_state, max(event_id) FILTER (event_type = 'click') AS moved_to_folder_id FROM events GROUP BY 1")
def i22_incremental_replay(t):
    """The log in a few commits, each of which is folded into the state without reading those before."""
    kind = F.when(F.col("event_type") == "click", "moved").when(F.col("event_type") == "purchase", "delete_detected").otherwise("fetch")
    rows = t("events").select(
        "event_id", F.lit("a").alias("account_id"), F.lit(1).cast("long").alias("folder_id"), F.lit(1).cast("long").alias("uidvalidity"), F.col("user_id").alias("uid"), kind.alias("event"),
        display.utc_seconds(F.lit(EPOCH) + F.col("event_id")).alias("timestamp"), F.lit("p").alias("relative_path"), F.col("event_id").alias("moved_to_folder_id"),
    )
    spark = rows.sparkSession
    store_ = Snapshots(spark, scratch_path(spark, "replay"))
    last = rows.agg(F.max("event_id")).first()[0] or 0
    for low, high in ((0, last * 9 // 10), (last * 9 // 10 + 1, last)):
        commit = store_.begin()
        commit.append("events", rows.where(F.col("event_id").between(low, high)).drop("event_id"))
        commit.publish()
        log.fold_new(store_, "events", "state")
    return store_.read("state").select("uid", "n_events", "remote_state", "moved_to_folder_id")


@over_views("j6_missing_intervals", "SELECT account_id, folder_id, uidvalidity, uid FROM messages WHERE uid IS NOT NULL AND uid % 5 = 0")
def j6_missing_intervals(v):
    """The uids that are stored and no longer listed, as a difference of intervals."""
    of = lambda rows: intervals.intervals(rows, sync.PLACE[:3], "uid")
    return intervals.spread(intervals.difference(of(v.messages), of(_remote(v)), sync.PLACE[:3]), "uid")


@over_views("s6_uid_intervals", """SELECT account_id, folder_id, uidvalidity, min(uid) AS low, max(uid) AS high FROM (
 SELECT account_id, folder_id, uidvalidity, uid, uid - row_number() OVER (PARTITION BY account_id, folder_id, uidvalidity ORDER BY uid) AS run FROM (SELECT DISTINCT account_id, folder_id, uidvalidity, uid // 3 AS uid FROM messages WHERE uid IS NOT NULL)) GROUP BY account_id, folder_id, uidvalidity, run""")
def s6_uid_intervals(v):
    rows = v.messages.withColumn("uid", F.floor(F.col("uid") / 3))
    return intervals.intervals(rows, sync.PLACE[:3], "uid")


_LISTED = "CASE WHEN lo <= last // 2 THEN last // 2 WHEN lo <= last * 3 // 4 THEN last * 3 // 4 ELSE last END"


def _streamed(spark: SparkSession, path: str, rounds, write) -> None:
    """A stream with state that takes each of ``rounds`` whole: one is written aside and then renamed into the stream's folder."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(f"{path}/in"))
    spark.conf.set(key, cursors.PROVIDER)
    query = None
    try:
        for i, rows in enumerate(rounds):
            rows.write.parquet(f"{path}/aside/{i}")
            fs.rename(at(f"{path}/aside/{i}"), at(f"{path}/in/{i}"))
            if query is None:  # one query for all rounds: each that starts makes state stores anew
                source = spark.readStream.schema(rows.schema).parquet(f"{path}/in/*")
                query = write(source).writeStream.format("parquet").option("checkpointLocation", f"{path}/at").start(f"{path}/out")
            query.processAllAvailable()
    finally:
        spark.conf.set(key, before)
        if query is not None:
            query.stop()


@over_views("i3_streamed_work", f"""SELECT account_id, folder_id, uidvalidity, uid, CASE WHEN uid > top THEN 'forward' ELSE 'backfill' END AS part FROM (
 SELECT *, row_number() OVER (PARTITION BY account_id, folder_id, uidvalidity, uid > top ORDER BY uid DESC) AS n FROM (
  SELECT *, CASE WHEN lo <= last // 2 THEN 3 WHEN lo <= last * 3 // 4 THEN 2 ELSE 1 END AS listings, max(uid) FILTER (uid <= {_LISTED}) OVER (PARTITION BY account_id, folder_id, uidvalidity) AS top FROM (
   SELECT account_id, folder_id, uidvalidity, uid, min(uid) OVER (PARTITION BY account_id, folder_id, uidvalidity) AS lo, max(id) OVER () AS last FROM messages QUALIFY uid IS NOT NULL)))
WHERE uid > top OR n <= 10 * listings""")
def i3_streamed_work(v):
    """Three listings of a growing mailbox as a stream with cursors as its state: new uids and, ten in each listing,
    the old ones, newest first."""
    spark = v.messages.sparkSession
    path = scratch_path(spark, "listings")
    rows = v.messages.select(*sync.PLACE, "id")
    last = rows.agg(F.max("id")).first()[0] or 0
    listings = [rows.where((F.col("uid") <= limit) & F.col("uid").isNotNull()).drop("id") for limit in (last // 2, last * 3 // 4, last)]
    _streamed(spark, path, listings, lambda source: cursors.fetched(source, most=10))
    found = spark.read.schema(cursors.WORK).parquet(f"{path}/out").where("part IS NOT NULL")
    return intervals.spread(found.select(*cursors.KEYS, "part", "low", "high"), "uid")


_ROUND = EPOCH + flags.FLAG_WINDOW_DAYS * 86_400 + 18_000
_SEEN = f"{_ROUND} + r * 1800"


@over_views("i10_i15_streamed_flags", f"""SELECT * FROM (WITH seen AS (
 SELECT account_id, folder_id, uidvalidity, uid, r, {EPOCH} + 30 + id * 60 AS sent, CASE WHEN r > 2 AND uid % 4 = 0 THEN '\\Seen' ELSE imap_flags END AS imap_flags
 FROM messages, range(5) t(r) WHERE uid IS NOT NULL AND internal_date IS NOT NULL AND (uid + r) % 3 <> 0 AND {EPOCH} + 30 + id * 60 >= {_SEEN} - 2592000),
steps AS (SELECT *, lag(imap_flags) OVER w AS old, lead(r) OVER w AS next FROM seen WINDOW w AS (PARTITION BY account_id, folder_id, uidvalidity, uid ORDER BY r))
SELECT account_id, folder_id, uidvalidity, uid, 'update' AS kind, imap_flags, {_stamp(_SEEN)} AS flags_seen_at FROM steps WHERE old IS DISTINCT FROM imap_flags
UNION ALL SELECT account_id, folder_id, uidvalidity, uid, 'due', imap_flags, {_stamp(_SEEN)} FROM steps
WHERE r + 2 < 5 AND coalesce(next > r + 2, true) AND sent + 2592000 >= {_SEEN} + 3600)""")
def i10_i15_streamed_flags(v):
    """Five rounds of observed flags as a stream with timers, half an hour apart: flags that changed, and those that grew
    an hour old.  What was seen unchanged waits in the state to be written together."""
    spark = v.messages.sparkSession
    path = scratch_path(spark, "flags")

    def seen(r: int) -> DataFrame:
        new = F.when((F.lit(r) > 2) & (F.col("uid") % 4 == 0), "\\Seen").otherwise(F.col("imap_flags"))
        rows = v.messages.where((F.col("uid") + r) % 3 != 0)
        return rows.select(*sync.PLACE, new.alias("flags"), "internal_date", F.timestamp_seconds(F.lit(_ROUND + r * 1800)).alias("at"))

    _streamed(spark, path, map(seen, range(5)), lambda source: flags.refreshed(source, late="0 seconds"))
    return spark.read.schema(flags.OUT).parquet(f"{path}/out").where("kind <> 'touch'")


def _filed(t) -> DataFrame:
    """Documents as messages of a mailbox."""
    return t("documents").selectExpr("source AS raw_name", "doc_id AS uid", "text AS content").where("raw_name IS NOT NULL AND uid > 0")


_MAIL = "source AS raw_name, doc_id AS uid, octet_length(encode(coalesce(text, ''))) AS size_bytes, sha256(coalesce(text, '')) AS file_hash"


@over_tables("s17_mailbox_ranges", f"""SELECT {_MAIL}, CASE WHEN doc_id > top // 2 THEN 'new' WHEN source = first THEN 'old, first folder' ELSE 'old' END AS part
FROM documents, (SELECT max(doc_id) AS top, min(source) AS first FROM documents) WHERE source IS NOT NULL AND doc_id > 0""")
def s17_mailbox_ranges(t):
    """All messages of a mailbox by scans of ranges of uids and of folders, which list and open only their blocks' files."""
    rows = _filed(t)
    spark = rows.sparkSession
    path = scratch_path(spark, "mailbox")
    mailbox.write(rows, path)
    top, first = rows.agg(F.max("uid"), F.min("raw_name")).first()
    half = (top or 0) // 2
    others = [r[0] for r in rows.where(F.col("raw_name") > first).select("raw_name").distinct().collect()]  # a name a folder
    parts = {
        "new": mailbox.read(spark, path, low=half + 1), "old, first folder": mailbox.read(spark, path, high=half, names=[first]),
        "old": mailbox.read(spark, path, high=half, names=others),
    }
    found = [rows.select("raw_name", "uid", "size_bytes", F.sha2("content", 256).alias("file_hash"), F.lit(name).alias("part")) for name, rows in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@over_tables("s17_mailbox_stream", f"SELECT {_MAIL} FROM documents WHERE source IS NOT NULL AND doc_id > 0")
def s17_mailbox_stream(t):
    """A mailbox that grows between two runs of a stream, each of which reads what is new."""
    rows = _filed(t)
    spark = rows.sparkSession
    path, out = scratch_path(spark, "mailbox"), scratch_path(spark, "followed")
    half = (rows.agg(F.max("uid")).first()[0] or 0) // 2
    for part in (rows.where(F.col("uid") <= half), rows.where(F.col("uid") > half)):
        mailbox.write(part, path)
        news = mailbox.follow(spark, path).select("raw_name", "uid", "size_bytes", F.sha2("content", 256).alias("file_hash"))
        query = news.writeStream.format("parquet").option("checkpointLocation", f"{out}/at").trigger(availableNow=True)
        query.start(f"{out}/rows").awaitTermination()
    return spark.read.schema("raw_name string, uid long, size_bytes long, file_hash string").parquet(f"{out}/rows")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of search results with all its joins."""
    return s.page_rows(stored(spark, sf_dir), wanted(), parse_query("tion"))


__all__ = ["EPOCH", "QUERIES", "SQL", "flagship"]
