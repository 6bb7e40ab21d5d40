"""Text functions, sinks, preset store, URL rules, events and sessions."""

import glob
import json
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as TX
from gleaner.operators import events as E
from gleaner.operators import presetstore as PS
from gleaner.operators import urls as U
from gleaner.operators import view as V
from gleaner.sinks import writers as K
from gleaner.streaming import sessions as S


def one(spark, expr, value, ddl="s string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("o")).first().o


def test_text_functions(spark):
    assert one(spark, TX.js_trim("s"), " ﻿ x \n") == "x"
    assert one(spark, TX.normalize_space("s"), "  a \t\n b ") == "a b"
    assert one(spark, TX.substring_before("s", "/"), "a.com") == ""
    assert one(spark, TX.substring_after("s", "://"), "https://a/b") == "a/b"
    assert one(spark, TX.substring_after("s", "://"), "nothing") == ""
    assert one(spark, TX.translate("s", "www.", ""), "www.twitter") == "titter"
    assert one(spark, TX.tsv_escape("s"), "a\\b\tc\nd\re") == "a\\\\b\\tc\\nd\\re"
    assert one(spark, TX.csv_quote("s"), 'say "hi"') == '"say ""hi"""'
    assert one(spark, TX.truncate_cell("s", 3), "abcdef") == "abc..."
    assert one(spark, TX.single_line("s"), "a\r\n\nb") == "a b"
    assert one(spark, TX.width_px(F.col("s").cast("int"), 7, 20, 80, 300), "100") == 300
    assert one(spark, TX.export_name(F.col("s"), F.lit("2024-05-01 10:00:00").cast("timestamp")), " ") == "Data Export - 2024-05-01"


@pytest.fixture()
def res(spark):
    return spark.createDataFrame(
        [(1, 0, False, "Alpha", 'q"1'), (1, 1, True, "", ""), (1, 2, False, "beta\tx", "z"), (2, 0, False, "Gamma", None)],
        "page_id long, original_index int, is_empty boolean, name string, val string",
    )


def test_view_ops(spark, res):
    assert V.search(res, "ALP").count() == 1
    assert V.drop_empty(res).count() == 3
    assert V.filter_contains(res, {"name": "a", "val": "z"}).count() == 1
    keys = spark.createDataFrame([(1, 0), (1, 2)], "page_id long, original_index int")
    assert V.select_rows_by_key(res, keys).count() == 2
    exp = V.rows_to_export(res, keys, show_empty=False).orderBy("page_id", "original_index").collect()
    assert [(r.page_id, r.original_index) for r in exp] == [(1, 0), (1, 2), (2, 0)]
    pg = V.page_per_group(res, 5, 2).orderBy("page_id", "original_index").collect()
    assert [(r.page_id, r.original_index, r.display_index) for r in pg] == [(1, 2, 3), (2, 0, 1)]
    srt = V.sort_by(res, [("name", True)]).collect()
    assert [r.name for r in srt][:2] == ["", "Alpha"]
    cnt = {r.page_id: (r.rows, r.empty_rows) for r in V.row_counts(res).collect()}
    assert cnt == {1: (3, 1), 2: (1, 0)}
    vc = {r.page_id: (r.filtered_rows, r.selected_rows) for r in V.view_counts(res, "a", keys).collect()}
    assert vc[1] == (2, 2)
    w = {(r.page_id, r.column): r.width for r in V.column_widths(res, sample=100, char_px=8, pad=24, lo=100, hi=400).collect()}
    assert w[(1, "name")] == 100
    assert one(spark, V.page_count(F.col("s").cast("long"), 20), "41") == 3
    uses = spark.createDataFrame([(1, " a ", 1), (1, "b", 2), (1, "a", 3), (1, "", 4)], "user_id long, selector string, ts long")
    rec = V.recent_selectors(uses, k=5).orderBy("rank").collect()
    assert [r.selector for r in rec] == ["a", "b"]


def test_sinks(spark, res):
    d = tempfile.mkdtemp(prefix="gleaner-sink-")
    K.write_csv(res.coalesce(1), os.path.join(d, "csv"), columns=["name", "val"], names=["Name", "Value"])
    body = open(glob.glob(os.path.join(d, "csv", "part-*.csv"))[0]).read()
    assert body.splitlines()[0] == '"Name","Value"'
    assert '"Alpha","q""1"' in body and '"Gamma",""' in body
    K.write_tsv(res.coalesce(1), os.path.join(d, "tsv"), columns=["name", "val"])
    tsv = open(glob.glob(os.path.join(d, "tsv", "part-*.csv"))[0]).read().splitlines()
    assert tsv[0] == "name\tval" and "beta\\tx\tz" in tsv
    out = K.write_xlsx(res, os.path.join(d, "xlsx")).collect()
    assert sorted(r.rows for r in out) == [1, 3]
    with zipfile.ZipFile(os.path.join(d, "xlsx", "page_id=1.xlsx")) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "Alpha" in sheet and 'name="Data"' in z.read("xl/workbook.xml").decode()
    vals = K.sheet_values(res).filter("page_id = 1").orderBy("row_number").collect()
    assert json.loads(vals[0].values_json) == ["name", "val"] and json.loads(vals[2].values_json) == ["", ""]
    with pytest.raises(K.NoDataError):
        K.write_csv(res.limit(0), os.path.join(d, "none"))
    assert K.tsv_line([]) is not None


def test_preset_store(spark):
    sysp = PS.system_presets(spark)
    assert sysp.count() == 11
    cur = spark.createDataFrame([("u1", "One", ("//a", [("A", ".", None)]), 5, 0), ("u2", "Two", ("//b", []), 6, 1)], PS.PRESET_DDL)
    new = spark.createDataFrame([("u2", "Two!", ("//b", []), 7, 0), ("u3", "Three", ("//c", []), 8, 1)], PS.PRESET_DDL)
    up = PS.upsert_presets(cur, new).orderBy("seq").collect()
    assert [(r.id, r.name, r.seq) for r in up] == [("u1", "One", 0), ("u2", "Two!", 1), ("u3", "Three", 2)]
    ids = spark.createDataFrame([("u1",)], "id string")
    assert PS.delete_presets(cur, ids).count() == 1
    status = PS.hide_preset(PS.reset_status(spark), "sys-images")
    allp = PS.all_presets(cur, sysp, status)
    assert allp.count() == 2 + 10
    assert V.suggest_presets(allp, " IMAGES ").count() == 0
    assert V.suggest_presets(allp, "head").count() == 1


def test_validate_presets(spark):
    good = {"version": 1, "presets": [{"id": "p1", "name": "P", "config": {"mainSelector": "//a", "columns": [{"name": "T", "selector": "."}]}, "createdAt": 1}]}
    with_sys = {"version": 1, "presets": [good["presets"][0], {**good["presets"][0], "id": "sys-images"}]}
    bad_item = {"version": 1, "presets": [good["presets"][0], {"id": "", "name": "x"}]}
    files = [
        ("good", json.dumps(good)), ("sys", json.dumps(with_sys)), ("v99", json.dumps({"version": 99, "presets": []})),
        ("syntax", "{not json"), ("null", "null"), ("num", "3"), ("str", '"x"'), ("nover", json.dumps({"presets": []})),
        ("vstr", json.dumps({"version": "1", "presets": []})), ("nopresets", json.dumps({"version": 1})),
        ("presetsobj", json.dumps({"version": 1, "presets": {}})), ("bad", json.dumps(bad_item)),
        ("empty", json.dumps({"version": 1, "presets": []})),
    ]
    df = spark.createDataFrame(files, "file string, raw string")
    report, valid = PS.validate_presets(df)
    rep = {r.file: (r.error, r.imported, r.skipped_system) for r in report.collect()}
    assert rep["good"] == (None, 1, 0)
    assert rep["sys"] == (None, 1, 1)
    assert rep["v99"][0].startswith("Unsupported preset file version")
    assert rep["null"][0] == "Invalid preset file: expected an object." and rep["num"][0] == rep["null"][0]
    assert rep["nover"][0] == 'Invalid preset file: missing "version" field.'
    assert rep["vstr"][0].startswith("Unsupported")
    assert rep["nopresets"][0] == 'Invalid preset file: missing "presets" field.'
    assert rep["presetsobj"][0] == 'Invalid preset file: "presets" must be an array.'
    assert rep["bad"][0].startswith("Invalid preset at index 1:") and rep["bad"][1] == 0
    assert rep["empty"] == (None, 0, 0) and rep["syntax"][0] == "Invalid JSON file."
    v = valid.collect()
    assert sorted((r.file, r.id) for r in v) == [("good", "p1"), ("sys", "p1")]
    assert v[0].config.columns[0].selector == "."


def test_urls(spark):
    df = spark.createDataFrame(
        [("chrome://x",), ("https://chrome.google.com/webstore/detail",), ("https://chrome.google.com/a/webstore/",),
         ("https://example.com",), ("",), (None,), ("file:///a",), ("chrome-extension://id/sidepanel.html",)], "url string")
    got = df.select("url", U.is_scrapable("url").alias("ok"), U.rejection_pattern("url").alias("why"), U.classify_context("url").alias("ctx")).collect()
    m = {r.url: (r.ok, r.why, r.ctx) for r in got}
    assert m["chrome://x"] == (False, "chrome://", "unknown")
    assert m["https://chrome.google.com/webstore/detail"][0] is False
    assert m["https://chrome.google.com/a/webstore/"][1] == U.BLOCKED_PATTERNS[0]
    assert m["https://example.com"] == (True, None, "unknown")
    assert m[""][:2] == (False, None) and m[None][:2] == (False, None)
    assert m["chrome-extension://id/sidepanel.html"][2] == "sidepanel"


def test_events(spark):
    raw = spark.createDataFrame([(None,), ("",), ('""',), ("true",), ("false",), ('"x"',), ("0",)], "r string")
    assert [r.c for r in raw.select(E.consent_state("r").alias("c")).collect()] == [None, None, None, True, False, True, False]
    ev = spark.createDataFrame(
        [(i, 1, "e", {"extension_context": "content_script" if i == 0 else ""}, i) for i in range(1001)] + [(2000, 2, "", {}, 5)],
        "event_id long, user_id long, name string, props map<string,string>, ts long",
    )
    assert E.bounded_queue(ev, 1000).filter("user_id = 1").agg(F.min("event_id")).first()[0] == 1
    valid, dead = E.valid_events(ev)
    assert dead.count() == 1
    en = E.enrich(valid, "production", "9", "background").orderBy("event_id").limit(2).collect()
    assert en[0].props["extension_context"] == "content_script" and en[1].props["extension_context"] == "background"
    consent = spark.createDataFrame([(1, False), (2, None)], "user_id long, consent boolean")
    routes = {r.user_id: r.route for r in E.route_events(ev, consent).select("user_id", "route").distinct().collect()}
    assert routes == {1: "drop", 2: "queue"}
    masked = E.mask_preset_props(spark.createDataFrame([({"preset_id": "u1", "preset_name": "mine", "$referrer": "r"},)], "props map<string,string>"))
    p = E.deny_props(masked).first().props
    assert p["preset_id"] is None and "$referrer" not in p


def test_session_fold_and_stream(spark):
    cfg1 = json.dumps({"mainSelector": "//a", "columns": [{"name": "T", "selector": "."}]})
    cfg2 = json.dumps({"mainSelector": "//b"})
    upd = spark.createDataFrame(
        [(1, 1, "url", '"u1"'), (1, 3, "url", '"u2"'), (1, 2, "currentScrapeConfig", cfg1), (1, 4, "currentScrapeConfig", cfg2),
         (2, 1, "url", '"x"'), (2, 2, S.REMOVED, None), (2, 3, "title", '"t"'), (1, 0, "url", '"late"')],
        S.UPDATES_DDL,
    )
    st = {(r.tab_id, r.field): r.value_json for r in S.fold_sessions(upd).collect()}
    assert st[(1, "url")] == '"u2"'
    assert st[(1, "currentScrapeConfig.mainSelector")] == '"//b"'
    assert json.loads(st[(1, "currentScrapeConfig.columns")])[0]["name"] == "T"
    assert (2, "url") not in st and st[(2, "title")] == '"t"'
    d = tempfile.mkdtemp(prefix="gleaner-stream-")
    upd.write.parquet(os.path.join(d, "in"))
    q = S.stream_sessions(spark, os.path.join(d, "in"), os.path.join(d, "state"), os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    streamed = {(r.tab_id, r.field): r.value_json for r in S.read_sessions(spark, os.path.join(d, "state")).collect()}
    assert streamed == st
    tabs = spark.createDataFrame([(1,), (3,)], "tab_id long")
    init = S.init_sessions(tabs, S.fold_sessions(upd), {"url": '""'})
    assert init.filter("tab_id = 3").count() == 1


def test_late_update_does_not_revive_a_removed_tab(spark, tmp_path):
    batches = [
        [(1, 1, "url", '"a"'), (2, 2, "url", '"b"')],
        [(1, 5, S.REMOVED, None)],
        [(2, 6, "title", '"t"')],
        [(1, 3, "url", '"late"'), (1, 9, "title", '"new"')],
    ]
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, S.UPDATES_DDL).coalesce(1).write.mode("append").parquet(src)
        S.stream_sessions(spark, src, str(tmp_path / "state"), str(tmp_path / "ckpt")).awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], S.UPDATES_DDL)
    want = {(r.tab_id, r.field): r.value_json for r in S.fold_sessions(every).collect()}
    got = {(r.tab_id, r.field): r.value_json for r in S.read_sessions(spark, str(tmp_path / "state"), 4).collect()}
    assert got == want == {(1, "title"): '"new"', (2, "url"): '"b"', (2, "title"): '"t"'}
