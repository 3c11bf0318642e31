from __future__ import annotations

import json
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from missive.functions.mail import rendered
from missive.operators import export


def test_lines(spark):
    row = {c: None for c in export.LINE} | {"id": 1, "subject": "a\tb\nc", "sender": "s", "sort_key": "k"}
    types = {"id": "long", "folder_id": "long", "size_bytes": "long", "has_attachment": "boolean"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {types.get(c, 'string')}" for c in row))
    assert json.loads(export.json_lines(df).first().line) == {c: row[c] for c in export.LINE}
    assert export.tab_lines(df).first().line == "1\tk\ts\ta b c"


def test_attachments_get_safe_and_free_names(spark):
    m = EmailMessage()
    m.set_content("x")
    for name in ("a/b.txt", "B.txt", "run.exe", "b.txt"):
        m.add_attachment(name.encode(), maintype="application", subtype="octet-stream", filename=name)
    m.add_attachment(b"png", maintype="image", subtype="png", cid="<logo>", filename="l.png", disposition="inline")
    df = spark.createDataFrame([(1, m.as_bytes())], "id long, content binary")
    got = {r.part_index: (r.file_name, r.is_executable, bytes(r.payload)) for r in export.attachments(df).collect()}
    assert got == {0: ("b.txt", False, b"a/b.txt"), 1: ("B (1).txt", False, b"B.txt"), 2: ("run.exe", True, b"run.exe"), 3: ("b (2).txt", False, b"b.txt")}
    parts = df.select(rendered(F.col("content"))["parts"].alias("p"))
    found = parts.select(export.inline_part(F.col("p"), F.lit("logo"))["filename"], export.inline_part(F.col("p"), F.lit("none"))).first()
    assert tuple(found) == ("l.png", None)


def test_older_tables(spark):
    old = {
        "folders": spark.createDataFrame([(1, "2026-07-31 12:00:00")], "id long, last_synced_at string"),
        "messages": spark.createDataFrame([(1, "2026-07-31 12:00:00", "odd")], "id long, date_sent string, internal_date string"),
        "sync_failures": spark.createDataFrame([(7,)], "uid long"),
    }
    new = export.migrate(old, 1)
    assert new["folders"].first().asDict() == {"id": 1, "last_synced_at": "2026-07-31T12:00:00Z", "backfill_next_uid": None, "initial_sync_completed": False, "highest_modseq": None}
    assert tuple(new["messages"].first()) == (1, "2026-07-31T12:00:00Z", "odd", None) and new["sync_failures"].first().uidvalidity == 0
    assert export.migrate(new, 4) is new
    with pytest.raises(ValueError):
        export.migrate(old, 5)
