"""The query syntax, filters, search, paging and joins on small tables with known answers."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.functions.normalise import normalise, normalised, stored_form, without_surrogates
from missive.operators import index, pages
from missive.operators import search as s
from missive.plans.filters import Page, day_bounds, read_cursor, utc_text, wanted, write_cursor
from missive.plans.query import QuerySyntaxError, parse_query
from missive.views import Views


def test_terms_are_split_normalised_and_routed():
    plan = parse_query("Müller\u2003Rechnung\n2024")
    assert plan.match_terms == ('"müller"', '"rechnung"', '"2024"') and not plan.has_slow_path
    plan = parse_query("ｖ２ ＯＫ　STRASSE straße")
    assert plan.match_terms == ('"strasse"', '"strasse"') and plan.like_terms == ("v2", "ok") and plan.has_slow_path
    assert parse_query('"so long, and" "a ""b"" c"').match_terms == ('"so long, and"', '"a ""b"" c"')
    plan = parse_query('ship -"sail boat" -tug -x y', "or")
    assert plan.exclude_match_terms == ('"sail boat"', '"tug"') and plan.exclude_like_terms == ("x",) and plan.include == ("ship", "y") and plan.mode == "or"
    assert parse_query("5% _a \\").like_terms == ("5\\%", "\\_a", "\\\\")


@pytest.mark.parametrize("text", [" \t\n", "-none -at -all", '"open phrase', 'glue"d"', '"shut"too', "one -", '""', 'x "\u3000"', '-"" y'])
def test_broken_queries(text):
    with pytest.raises(QuerySyntaxError):
        parse_query(text)


def test_modes_are_two():
    with pytest.raises(QuerySyntaxError):
        parse_query("word", "near")


def test_cursors():
    for place in (("2025-12-24T18:00:00Z", 77), ("", 0), ("ö\"", -1)):
        assert read_cursor(write_cursor(*place)) == place
    for bad in ("", "null", "7", '{"sort_key":"k"}', '{"sort_key":"k","message_id":"7"}', '{"sort_key":null,"message_id":7}', '{"sort_key":"k","message_id":false}', '{"sort_key":"k","message_id":7,"page":2}', '{"sort_key":"k","message_id":7.0}'):
        with pytest.raises(ValueError):
            read_cursor(bad)


def test_days_and_conditions():
    first, last = day_bounds("2024-02-29", "2024-02-29")
    assert (utc_text(first), utc_text(last)) == ("2024-02-29T00:00:00Z", "2024-02-29T23:59:59Z") and day_bounds(None, "") == (None, None)
    for broken in (("2024-03-01", "2024-02-29"), ("2024-02-30", None), (None, "soon")):
        with pytest.raises(ValueError):
            day_bounds(*broken)
    assert [c.column for c in wanted()] == ["local_state"] and wanted(local=None) == () and wanted(since=first)[-1].value == utc_text(first)
    with pytest.raises(TypeError):
        wanted(colour="red")


def test_normaliser(spark):
    assert normalise("\u3000Ｔｅｌ．\u2007０９ ") == "tel. 09" and normalise("x\v\r y") == "x y" and normalise("ひ") != normalise("ヒ")
    assert without_surrogates("\udfffhalf \ud83d") == "?half ?" and normalise("A\ud83d") == "a?"
    rows = spark.createDataFrame([(" ＡＢＣ　ẞ ",), (None,)], "t string")
    assert [r[0] for r in rows.select(normalised("t")).collect()] == ["abc ss", None]


MESSAGE = {
    "account_id": "a", "folder_id": 1, "message_id": None, "uid": None, "uidvalidity": 1, "remote_state": "present", "moved_to_folder_id": None, "local_state": "active",
    "subject": None, "sender": None, "recipient": None, "date_sent": "2026-07-31T12:00:00Z", "internal_date": None, "size_bytes": 1, "has_attachment": False,
    "imap_flags": "", "thread_key": None, "relative_path": None, "file_hash": None, "flags_seen_at": None, "cc": "c@x", "in_reply_to": None, "references_ids": None,
}
MESSAGES = (
    "id long, account_id string, folder_id long, message_id string, uid long, uidvalidity long, remote_state string, moved_to_folder_id long, local_state string, subject string, sender string, "
    "recipient string, date_sent string, internal_date string, size_bytes long, has_attachment boolean, imap_flags string, thread_key string, relative_path string, file_hash string, "
    "flags_seen_at string, cc string, in_reply_to string, references_ids string"
)


def model(spark, rows: list[dict], failures=()) -> Views:
    """Messages, and contents for those with a ``text``."""
    names = [c.split()[0] for c in MESSAGES.split(", ")]
    full = [MESSAGE | {"id": i + 1} | r for i, r in enumerate(rows)]
    contents = [(r["id"], normalise(r.get("subject") or ""), "", normalise(r["text"]), r.get("names")) for r in full if "text" in r]
    folders = [(1, "a", "INBOX", "受信箱", 1, True), (2, "b", "Archive", "保存", 1, True), (3, "a", "Moved", "移動先", 1, False)]
    return Views(
        spark.createDataFrame([("a", "imap", True), ("b", "imap", True)], "id string, provider_type string, is_enabled boolean"),
        spark.createDataFrame(folders, "id long, account_id string, raw_name string, display_name string, uidvalidity long, is_sync_target boolean"),
        spark.createDataFrame([tuple(r[n] for n in names) for r in full], MESSAGES),
        spark.createDataFrame(contents, "message_id long, subject_norm string, sender_norm string, body_text string, attachment_names string"),
        spark.createDataFrame(list(failures), "account_id string, folder_id long, uidvalidity long, uid long, error_class string"),
    )


def ids(page: Page) -> list[int]:
    return [r.id for r in page.items]


def test_terms_find_text_and_attachment_names(spark):
    v = model(spark, [{"text": "Invoice 2026"}, {"text": "two character marker", "names": "report.xlsx"}, {"text": "Unrelated"}, {}])
    assert [ids(s.search(v, q)) for q in ("voic", '"o c"', '"r m"', "lsx")] == [[1], [2], [2], [2]]
    plans = []
    assert s.search(v, "ma", on_plan=plans.append).slow and plans[0].like_terms == ("ma",)
    assert ids(s.search(v, None)) == [4, 3, 2, 1]  # without contents: listed, not found


def test_modes_and_exclusions(spark):
    v = model(spark, [{"text": "alpha beta"}, {"text": "alpha only"}, {"text": "beta only"}, {"text": "gamma"}])
    assert ids(s.search(v, "alpha beta")) == [1] and ids(s.search(v, "alpha beta", mode="or")) == [3, 2, 1]
    assert ids(s.search(v, "alpha -beta")) == [2] and ids(s.search(v, "alpha -beta -gamma")) == [2]
    compat = s.selected(v, wanted(), parse_query("alpha -beta -gamma"), compat=True)
    assert {r.id for r in compat.collect()} == {2, 4}


def test_filters(spark):
    base = {"text": "needle"}
    v = model(spark, [base | {"has_attachment": True, "remote_state": "deleted"}, base | {"account_id": "b", "folder_id": 2}, base | {"local_state": "purged"}, base | {"local_state": "trashed"}])
    only = wanted(accounts=("a",), folders=(1,), attachment=True, remote=("deleted",), since=datetime(2026, 7, 1, tzinfo=UTC), until=datetime(2026, 8, 1, tzinfo=UTC))
    assert ids(s.search(v, "needle", only)) == [1] and ids(s.search(v, "needle")) == [2, 1]
    for none in ("accounts", "folders", "local", "remote"):
        assert ids(s.search(v, "needle", wanted(**{none: ()}))) == []


def test_undated_rows_and_the_last_second_of_a_day(spark):
    v = model(spark, [{"date_sent": None}, {"date_sent": "2026-07-30T23:59:59Z"}])
    last = day_bounds(None, "2026-07-30")[1]
    assert ids(s.search(v, None, wanted(until=last))) == [2, 1]
    assert ids(s.search(v, None, wanted(since=datetime(2026, 1, 1, tzinfo=UTC)))) == [2]


def test_pages_by_keyset(spark):
    v = model(spark, [{}, {}, {"date_sent": None, "internal_date": "2026-07-30T00:00:00Z"}, {"date_sent": None}])
    first = s.search(v, None, limit=2)
    assert ids(first) == [2, 1] and read_cursor(first.next_cursor) == ("2026-07-31T12:00:00Z", 1) and not first.exhausted
    second = s.search(v, None, cursor=first.next_cursor, limit=2)
    assert ids(second) == [3, 4] and second.exhausted and second.next_cursor is None
    with pytest.raises(ValueError):
        s.page_rows(v, wanted(), limit=0)


def test_joined_names_and_failures(spark):
    failures = [("a", 1, 1, 7, "oversize"), ("a", 1, 99, 8, "parse")]
    v = model(spark, [{"uid": 7, "moved_to_folder_id": 3}, {"uid": 8}, {}], failures)
    rows = {r.id: r for r in s.search(v, None).items}
    assert (rows[1].folder_name, rows[1].moved_to_folder_name, rows[1].failure_class) == ("受信箱", "移動先", "oversize")
    assert rows[2].failure_class is None and rows[3].subject == ""


def test_counts_threads_and_details(spark):
    v = model(spark, [{"thread_key": "t", "text": "x1"}, {"thread_key": "t", "date_sent": None, "text": "x2"}, {"text": "y"}, {"thread_key": "t", "local_state": "trashed"}])
    assert s.count(v).first().n == 3 and s.count(v, plan=parse_query("x1")).first().n == 1
    assert {r.id for r in s.thread(v, "t").collect()} == {1, 2}
    assert s.detail(v, 4).first().cc == "c@x" and s.detail(v, 4).first().folder_raw_name == "INBOX"
    assert s.detail(v, 4).first().local_state == "trashed" and s.detail(v, 9).first() is None


def test_plans_push_filters_and_take_the_top_rows(spark, tmp_path):
    v = model(spark, [{"text": "needle", "uid": i} for i in range(5)])
    v.messages.write.parquet(f"{tmp_path}/m")
    v.contents.write.parquet(f"{tmp_path}/c")
    v.messages, v.contents = spark.read.parquet(f"{tmp_path}/m"), spark.read.parquet(f"{tmp_path}/c")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    rows = s.page_rows(v, wanted(), parse_query("needle -x1"), write_cursor("2026-08-01T00:00:00Z", 3))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "local_state" in plan.split("PushedFilters", 1)[1]
    assert "StringContains(body_text,needle)" in plan and "Not(StringContains(body_text,x1))" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert rows.agg(F.count("*")).first()[0] == 5


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Contents with and without the index: four columns, blanks, short texts and a null one."""
    rng = random.Random(11)
    words = ["an", "ant", "antler", "tlera", "red", "reddish", "ß", "x1", "日本語", "本語の", "5%", "a b", "zz"]
    rows = [{"text": " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), "subject": rng.choice(words), "names": rng.choice([None, *words])} for _ in range(150)] + [{"text": ""}, {"text": "a"}, {"text": "rare antlers"}]
    v = model(spark, rows)
    path = str(tmp_path_factory.mktemp("index"))
    return v, replace(v, index=index.build(v.contents, path))


def test_the_index_finds_what_a_scan_finds(indexed):
    plain, v = indexed
    queries = ["ant", "antler", "red antler", "reddish", '"tler an"', "日本語", "日本語の", "an", "ß", "zz ant", "ant -red", "ant -reddish -x1", "antlers", "nothing", '"red red"', "ant -ß -日本語", '"r r"', '"ish 5%"']
    for query in queries:
        for mode in ("and", "or"):
            plan = parse_query(query, mode)
            want = sorted(r.id for r in s.selected(plain, wanted(), plan).select("id").collect())
            assert sorted(r.id for r in s.selected(v, wanted(), plan).select("id").collect()) == want, (query, mode)
    assert s.count(v, plan=parse_query("ant")).first().n == s.count(plain, plan=parse_query("ant")).first().n > 10
    assert ids(s.search(v, "antlers")) == [153]


CHANGE = "message_id long, subject_norm string, sender_norm string, body_text string, attachment_names string, removed boolean"


def trigrams_and_shorter(rows) -> set:
    return {(t[i : i + k], r["message_id"]) for r in rows for t in (r[c] for c in s.TEXT_COLUMNS) if t for k in (1, 2, 3) for i in range(len(t) - k + 1)}


def test_the_index_after_changes(indexed, spark, tmp_path):
    plain, _ = indexed
    old = index.build(plain.contents, str(tmp_path / "index"))
    changes = spark.createDataFrame([(1, "new subject", "", "wholly other words", None, False), (2, None, None, None, None, True), (900, "", "", "antlered", "names.txt", False)], CHANGE)
    new = index.updated(old, changes)
    now = new.contents()
    assert now.where("message_id IN (1, 2, 900)").count() == 2 and now.count() == 153 and len(new.segments) == 2
    assert {tuple(r) for r in new.pieces().collect()} == trigrams_and_shorter(now.collect())
    assert [r.found_id for r in index.found(new, parse_query("antlered")).collect()] == [900] and [r.found_id for r in index.found(new, parse_query("wholly")).collect()] == [1]
    # What is open stays as it was, and an update writes in proportion to the change.
    assert old.contents().count() == 153 and index.found(old, parse_query("antlered")).isEmpty()
    fresh = trigrams_and_shorter(changes.where("NOT removed").collect())
    assert {tuple(r) for r in index.spread(new.postings_of(new.segments[1])).select("gram", "message_id").collect()} == fresh
    assert new.contents_of(new.segments[1]).count() == 2 and new.segments[0] == old.segments[0]


def test_many_changes_leave_few_segments_and_the_same_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SMALL", 3)
    rng = random.Random(3)
    words = ["ant", "antler", "red", "reddish", "x1", "zz"]
    text = lambda: " ".join(rng.choice(words) for _ in range(4))
    now = {i: text() for i in range(40)}
    kind = CHANGE.removesuffix(", removed boolean")
    frame = lambda rows: spark.createDataFrame([(i, "", None, t, None) for i, t in rows.items()], kind)
    built = index.build(frame(now), str(tmp_path / "i"))
    for _ in range(7):
        new, gone = {rng.randrange(50): text() for _ in range(4)}, {rng.randrange(50) for _ in range(2)}
        gone -= new.keys()
        now = {i: t for i, t in (now | new).items() if i not in gone}
        changes = frame(new).withColumn("removed", F.lit(False)).unionByName(spark.createDataFrame([(i, None, None, None, None, True) for i in gone], CHANGE))
        built = index.updated(built, changes)
    assert len(built.segments) <= 4 and {r.message_id: r.body_text for r in built.contents().collect()} == now
    for query in ("antler", "ant -red", "zz", "x1 red", "an", "reddish -zz", "nothing"):
        words_of = parse_query(query)
        want = sorted(i for i, t in now.items() if all(x in t for x in words_of.include) and not any(x in t for x in words_of.exclude))
        assert sorted(r.found_id for r in index.found(built, words_of).collect()) == want, query


def test_ranges_in_which_a_piece_is_missing_are_skipped(spark, tmp_path, monkeypatch):
    rows = [(i, "", None, "abcdef" if i == 77 else "abc" if i < 100 else "def", None) for i in range(200)]
    monkeypatch.setattr(index, "PAIRS", 60)
    codes = spark.createDataFrame([(0, *r) for r in rows], index.CONTENT.replace(", block int", "").replace("message_id long", "block int, message_id long")).coalesce(1)
    got = codes.mapInArrow(index._pack, index.POSTING).collect()  # tasks here have the module's own bound
    assert {r.gram for r in got} >= {"a", "ab", "abc", "cde"} and all(r.n == len(r.ids) and r.low == r.base + r.ids[0] and r.high == r.base + r.ids[-1] for r in got)
    assert index.texts_of(np.concatenate(index.codes_of("a\0é日🙂"))) == ["a", "\0", "é", "日", "🙂", "a\0", "\0é", "é日", "日🙂", "a\0é", "\0é日", "é日🙂"]


def test_pages_open_only_the_files_that_they_need(spark, tmp_path):
    rng = random.Random(8)
    rows = [{"date_sent": f"2026-07-{rng.randint(1, 28):02d}T00:00:00Z" if i % 9 else None, "local_state": "trashed" if i % 4 == 0 else "active", "uid": i, "has_attachment": i == 200} for i in range(240)]
    plain = model(spark, rows)
    order = [F.desc("sort_key"), F.desc("id")]
    s.keyed(plain.messages).repartitionByRange(6, *order).sortWithinPartitions(*order).write.parquet(f"{tmp_path}/m")
    stored = spark.read.parquet(f"{tmp_path}/m")
    v = replace(plain, messages=stored, directory=pages.Directory(stored, pages.directory(stored)))
    read = []
    monkey = v.directory.open
    v.directory.open = lambda files: read.append(len(files)) or monkey(files)
    cursor = None
    for _ in range(5):
        want, got = s.search(plain, None, cursor=cursor, limit=20), s.search(v, None, cursor=cursor, limit=20)
        assert ids(got) == ids(want) and got.next_cursor == want.next_cursor
        cursor = want.next_cursor
    assert max(read) <= 2 and len(v.directory.files) == 6
    for filters in (wanted(attachment=True, local=None), wanted(local=("trashed", "active")), wanted(local=())):
        assert ids(s.search(v, None, filters, limit=7)) == ids(s.search(plain, None, filters, limit=7))
        for offset in (0, 33, 150, 5000):
            assert [r.id for r in s.deep_page(v, filters, offset, 10).collect()] == [r.id for r in s.deep_page(plain, filters, offset, 10).collect()]


def test_only_the_blocks_of_candidates_are_read(indexed, spark, tmp_path):
    plain, _ = indexed
    wide = plain.contents.withColumn("message_id", F.col("message_id") * 1000)
    built = index.build(wide, str(tmp_path))
    rows = index.found(built, parse_query("antlers"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "gram" in plan.split("PushedFilters", 1)[1]
    assert [r.found_id for r in rows.collect()] == [153_000]
    # Terms of three characters are answered without any text.
    assert "body_text" not in index.found(built, parse_query("ant -red"))._jdf.queryExecution().executedPlan().toString()


def test_stored_forms_of_any_text(spark):
    texts = ["Straße ÀÉ", "ＴＥＬ． ０９", "é ﬁ ² ª x", "a\x1cb\x85c\n\t d ", "日本 ｶﾞ", "", None, "¨ ¯´µ¸ ¼", "\x00", "ÿ ½"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", stored_form(F.col("t")).alias("got")).collect()
    assert all(r.got == (None if r.t is None else normalise(r.t)) for r in rows), rows


def test_postings_are_packed_once_and_not_shuffled(spark, tmp_path, monkeypatch):
    from missive.operators import index

    packed = spark.sparkContext.accumulator(0)
    inner = index._pack

    def counted(batches):
        def seen():
            for batch in batches:
                packed.add(batch.num_rows)
                yield batch

        yield from inner(seen())

    monkeypatch.setattr(index, "_pack", counted)
    rows = spark.range(300).select(F.col("id").alias("message_id"), F.concat(F.lit("abc "), "id").alias("body_text"), *(F.lit(None).cast("string").alias(c) for c in ("subject_norm", "sender_norm", "attachment_names")))
    built = index.build(rows, f"{tmp_path}/index")
    assert packed.value == 300
    places = built._table("postings", built.segments[0]).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "gram").collect()
    for file in {r.file for r in places}:
        grams = [r.gram for r in sorted(places, key=lambda r: r.at) if r.file == file]
        assert grams == sorted(grams)


def test_queries_hold_few_rows_in_python(spark):
    from missive.queries import QUERIES

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        QUERIES["n17_sanitised"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
