"""Committed versions, their feed, stored results, changelog streams and the consent flow."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from gleaner.sources import results as RS
from gleaner.sources import versions as VT
from gleaner.streaming import changelog as CL
from gleaner.streaming import consent as CO
from gleaner.streaming import sessions as S

DDL = "id long, name string, tags array<string>, n int"
T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def table(spark, tmp_path):
    return VT.VersionedTable.of(spark, str(tmp_path / "t"), DDL, ("id",))


def test_versions_deltas_and_snapshots(spark, table):
    make = lambda data: spark.createDataFrame(data, DDL)
    assert table.latest() == 0 and table.read().count() == 0
    one = [(1, "a", ["x"], 1), (2, "b", None, 2), (None, "null key", [], 3)]
    assert table.commit(make(one)) == 1
    gone = spark.createDataFrame([(2, None, None, None, True), (3, "c", ["z"], 4, False)], DDL + ", _deleted boolean")
    assert table.commit(gone) == 2
    two = [(1, "a", ["x"], 1), (None, "null key", [], 3), (3, "c", ["z"], 4)]
    assert rows(table.read()) == sorted(two, key=repr)
    assert rows(table.read(1)) == sorted(one, key=repr)  # older versions stay readable
    assert table.commit(make([(1, "A", ["x"], 1)])) == 3
    assert table.compact() == 4
    assert [c.kind for c in table.commits_of(4)] == ["snapshot"]
    assert rows(table.read(4)) == rows(table.read(3))
    assert table.changes(4).count() == 0
    got = {r["id"]: (r["change"], r["before"] and r["before"]["name"], r["after"] and r["after"]["name"]) for r in table.changes(2).collect()}
    assert got == {2: ("delete", "b", None), 3: ("insert", None, "c")}
    # an unfinished commit file and rows of a job that died are not seen; the number is passed over once it is old
    broken = os.path.join(table.path, "commits", f"{5:020d}.json")
    with open(broken, "w") as f:
        f.write('{"version": 5, "ki')
    make(one).write.parquet(f"{table.path}/data/commit=dead")
    assert table.latest() == 4 and rows(table.read()) == rows(table.read(4))
    with pytest.raises(VT.Conflict):
        table.commit(make(one))
    os.utime(broken, (0, 0))
    assert table.commit(make([(9, "n", [], 9)])) == 6
    assert table.read().count() == 4 and table.changes(6).collect()[0]["change"] == "insert"
    assert set(table.vacuum(versions=1, unnamed_ms=-1)) >= {"commit=dead"}
    assert table.versions() == [4, 6] and table.read().count() == 4
    with pytest.raises(ValueError, match="no version"):
        table.read(1)


def test_second_writer_conflicts_and_retries(spark, table):
    make = lambda data: spark.createDataFrame(data, DDL)
    table.commit(make([(1, "a", [], 0)]))
    base = table.latest()
    table.commit(make([(2, "b", [], 0)]), base=base)
    with pytest.raises(VT.Conflict):
        table.commit(make([(3, "c", [], 0)]), base=base)
    assert table.latest() == 2
    calls = []

    def add_one(cur, _):
        calls.append(cur.count())
        if len(calls) == 1:  # another writer is first
            table.commit(make([(4, "d", [], 10)]))
        return cur.withColumn("n", F.col("n") + 1)

    assert table.update(add_one) == 4
    assert calls == [2, 3] and {r["id"]: r["n"] for r in table.read().collect()} == {1: 1, 2: 1, 4: 11}


def test_feed_applies_to_the_next_version(spark):
    r = random.Random(1)
    make = lambda: spark.createDataFrame([(i if i else None, r.choice("abc"), r.choice([None, [], ["x"], ["x", None]]), r.choice([None, 1, 2])) for i in range(60) if r.random() < 0.7], DDL)
    empty = spark.createDataFrame([], DDL)
    a, b = make().cache(), make().cache()
    for before, after in ((a, b), (empty, a), (a, empty), (a, a), (empty, empty)):
        feed = VT.changes(before, after, ["id"])
        assert rows(VT.apply_changes(before, feed, ["id"])) == rows(after)
        old, new = {x[0]: x for x in map(tuple, before.collect())}, {x[0]: x for x in map(tuple, after.collect())}
        want = {k: "insert" if k not in old else "delete" if k not in new else "update" for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
        assert {x["id"]: x["change"] for x in feed.collect()} == want


def test_feed_as_a_stream(spark, table, tmp_path):
    out, check = str(tmp_path / "feed"), str(tmp_path / "check")
    make = lambda data: spark.createDataFrame(data, DDL)
    table.commit(make([(1, "a", [], 0), (2, "b", [], 0)]))
    table.commit(make([(1, "a2", [], 0)]))
    VT.stream_changes(table, out, check).awaitTermination()
    table.commit(make([(3, "c", [], 0)]), "snapshot")
    VT.stream_changes(table, out, check).awaitTermination()
    VT.stream_changes(table, out, str(tmp_path / "another")).awaitTermination()  # from the start: nothing twice
    feed = VT.read_feed(spark, out)
    now = spark.createDataFrame([], DDL)
    for v in table.versions():
        now = VT.apply_changes(now, feed.filter(F.col("version") == v).drop("version"), ["id"])
        assert rows(now) == rows(table.read(v))
    assert [r["count"] for r in feed.groupBy("version").count().orderBy("version").collect()] == [2, 1, 3]


# ---- stored results


def scrape(tab, seq, n, closed=False, ts=None):
    return (tab, seq, ts or T0 + dt.timedelta(hours=seq), "//a" if seq % 2 else None, ["T"], [[f"{tab}/{seq}/{i}"] for i in range(n)], closed)


SCRAPE_DDL = "tab_id long, seq long, ts timestamp, main_selector string, columns array<string>, data array<array<string>>, closed boolean"


def test_stored_results_with_tabs(spark, tmp_path):
    table = RS.results_table(spark, str(tmp_path / "r"))
    RS.commit_results(table, spark.createDataFrame([scrape(1, 1, 2), scrape(1, 3, 1), scrape(2, 2, 2), scrape(3, 5, 1)], SCRAPE_DDL))
    RS.commit_results(table, spark.createDataFrame([scrape(2, 6, 0), scrape(3, 4, 9), scrape(4, 8, 3), scrape(5, 9, 1), scrape(5, 10, 1, True)], SCRAPE_DDL))
    assert {(r["tab_id"], r["seq"], len(r["data"])) for r in RS.read_results(table).collect()} == {(1, 3, 1), (3, 5, 1), (4, 8, 3)}
    assert {r["tab_id"] for r in RS.read_results(table, 1).collect()} == {1, 2, 3}
    tabs = spark.createDataFrame([(1, "https://a/", "A"), (3, "", None), (4, None, "D"), (0, "u", "t"), (None, "u", "t"), (77, "u", "t")], "tab_id long, url string, title string")
    tabs.write.parquet(str(tmp_path / "tabs"))
    got = RS.results_with_tabs(spark.read.parquet(str(tmp_path / "tabs")), table)
    assert {(r["tab_id"], r["tab_url"], r["tab_title"], r["main_selector"], tuple(r["columns"])) for r in got.collect()} == {
        (1, "https://a/", "A", "//a", ("T",)), (3, "Unknown URL", "Unknown Title", "//a", ("T",)), (4, "Unknown URL", "D", "", ("Text",))}
    assert rows(RS.result_rows(got).filter("tab_id = 4")) == [(4, 0, ["4/8/0"]), (4, 1, ["4/8/1"]), (4, 2, ["4/8/2"])]
    few = RS.results_with_tabs(spark.read.parquet(str(tmp_path / "tabs")).filter("title = 'A'"), table)
    assert "dynamicpruning" in few._jdf.queryExecution().executedPlan().toString()
    assert [r["tab_id"] for r in few.collect()] == [1]


def test_results_of_an_extraction(spark, make_dom, tmp_path):
    from gleaner.operators.extract import ScrapeConfig, extract

    dom = make_dom("<ul><li>a</li><li>b</li></ul>", "<p>none</p>")
    res = extract(dom, ScrapeConfig.of("//li", [("Text", ".")]))
    table = RS.results_table(spark, str(tmp_path / "r"))
    RS.commit_results(table, RS.scrapes_of(res, ["Text"], F.lit(1), "//li"))
    assert [(r["tab_id"], r["data"], r["main_selector"]) for r in RS.read_results(table).collect()] == [(0, [["a"], ["b"]], "//li")]


# ---- changelog streams


def test_state_stays_bounded_over_fifty_batches(spark, tmp_path):
    r = random.Random(7)
    hour = dt.timedelta(hours=1)
    table = S.session_table(spark, str(tmp_path / "state"))
    ddl = S.UPDATES_DDL + ", ts timestamp"
    every, mark, top, sizes = [], None, None, []
    for epoch in range(50):
        batch = []
        for _ in range(8):
            seq = epoch * 10 + r.randrange(10) - (r.randrange(200) if r.random() < 0.2 else 0)
            tab = seq % 3 + epoch // 10 * 3  # tabs come and go
            field = S.REMOVED if r.random() < 0.2 else r.choice(["url", "title", "x"])
            batch.append((tab, seq, field, f'"{seq}"', T0 + seq * hour))
        if epoch % 10 == 9:  # all tabs of the last ten batches are closed
            batch += [(t, epoch * 10 + 10, S.REMOVED, None, T0 + (epoch * 10 + 10) * hour) for t in range(epoch // 10 * 3, epoch // 10 * 3 + 3)]
        df = spark.createDataFrame(batch, ddl).coalesce(1)
        CL.append_batch(table, df, S.fold_updates, delay=30 * hour, stream="s", epoch=epoch, compact_every=5, expire=S.expire_removals)
        assert CL.append_batch(table, df, S.fold_updates, delay=30 * hour, stream="s", epoch=epoch, compact_every=5, expire=S.expire_removals) == table.latest()  # run again: nothing
        fresh = [b for b in batch if mark is None or b[4] >= mark]
        every += fresh
        if fresh:
            top = max(b[4] for b in fresh)
            mark = max(mark, top - 30 * hour) if mark else top - 30 * hour
        assert CL.watermark(table) == mark
        if epoch % 10 == 9:
            want = {(x.tab_id, x.field): x.value_json for x in S.fold_sessions(spark.createDataFrame(every, ddl).drop("ts")).collect()}
            assert {(x.tab_id, x.field): x.value_json for x in S.read_sessions(spark, table.path).collect()} == want
            sizes.append(table.read().count())
        assert len(table.commits_of(table.latest())) <= 6 and len(table._names("data")) <= 7
    assert max(sizes) <= 15  # three tabs' fields and removals that the watermark has not passed


def test_restarted_stream_keeps_its_state(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(1, 1, "url", '"a"')], S.UPDATES_DDL).write.parquet(src)
    S.stream_sessions(spark, src, state, str(tmp_path / "c1")).awaitTermination()
    other = str(tmp_path / "in2")
    spark.createDataFrame([(2, 5, "url", '"b"')], S.UPDATES_DDL).write.parquet(other)
    S.stream_sessions(spark, other, state, str(tmp_path / "c2")).awaitTermination()
    assert {(r.tab_id, r.value_json) for r in S.read_sessions(spark, state).collect()} == {(1, '"a"'), (2, '"b"')}


def test_live_results_stream(spark, tmp_path):
    r = random.Random(2)
    src = str(tmp_path / "in")
    all_rows = [scrape(r.randrange(1, 9), seq, r.choice([0, 1, 2]), r.random() < 0.1) for seq in range(1, 60)]
    r.shuffle(all_rows)
    table = RS.results_table(spark, str(tmp_path / "live"))
    for i in range(0, len(all_rows), 12):
        spark.createDataFrame(all_rows[i : i + 12], SCRAPE_DDL).coalesce(1).write.mode("append").parquet(src)
        RS.stream_results(spark, src, table, str(tmp_path / "c"), SCRAPE_DDL, compact_every=3).awaitTermination()
        sofar = {}
        for row in sorted(all_rows[: i + 12], key=lambda x: x[1]):
            sofar[row[0]] = row
        want = {(t, x[1], len(x[5])) for t, x in sofar.items() if x[5] and not x[6]}
        assert {(x["tab_id"], x["seq"], len(x["data"])) for x in RS.read_results(table).collect()} == want
    flat = spark.createDataFrame([(x[0], x[1], len(x[5]), x[6]) for x in all_rows], "tab_id long, seq long, row_count int, closed boolean")
    assert {(x.tab_id, x.seq, x.row_count) for x in S.live_results(flat).collect()} == want


# ---- consent


def walk(events, consents, limit, timeout, upto):
    """The flow, one user's rows after the other."""
    out = {}
    users = {e[1] for e in events}
    for u in users:
        state, queue = None, []
        todo = sorted([(c[2], 0, c[0], c[3]) for c in consents if c[1] == u] + [(e[2], 1, e[0], None) for e in events if e[1] == u], key=lambda x: x[:3])
        for ts, kind, i, value in todo:
            if kind == 0:
                state = value
                if state is not None:
                    for t, q in queue:
                        out[q] = "evicted" if timeout and ts - t > timeout else "flush" if state else "clear"
                    queue = []
            elif state is None:
                queue.append((ts, i))
                if len(queue) > limit:
                    out[queue.pop(0)[1]] = "evicted"
            else:
                out[i] = "deliver" if state else "drop"
        for t, q in queue:
            out[q] = "evicted" if timeout and upto - t > timeout else "queue"
    return out


def consent_data(seed, users=6, n=150):
    r = random.Random(seed)
    minute = lambda: T0 + dt.timedelta(minutes=r.randrange(6000))
    events = [(i, 0 if r.random() < 0.4 else r.randrange(users), minute()) for i in range(n)]
    consents = [(i, r.randrange(users), minute(), r.choice([True, False, None])) for i in range(n // 6)]
    return events, consents


@pytest.mark.parametrize("limit,timeout", [(3, None), (1000, dt.timedelta(hours=20)), (4, dt.timedelta(hours=9))])
def test_consent_flow_against_a_walk(spark, limit, timeout):
    events, consents = consent_data(limit)
    e = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp")
    c = spark.createDataFrame(consents, "consent_id long, user_id long, ts timestamp, consent boolean")
    upto = max([x[2] for x in events] + [x[2] for x in consents])
    want = walk(events, consents, limit, timeout, upto)
    for width in (dt.timedelta(hours=5), dt.timedelta(days=30)):
        got = CO.consent_flow(e, c, limit, timeout, bin_width=width).collect()
        assert {r.event_id: r.route for r in got} == want and len(got) == len(events)
    assert {"flush", "clear", "deliver", "drop", "evicted"} <= set(want.values())


def test_consent_stream_equals_the_flow(spark, tmp_path):
    limit, timeout = 4, dt.timedelta(hours=30)
    events, consents = consent_data(11)
    end = T0 + dt.timedelta(days=30)
    last = [(10_000, 0, end)]  # pushes the watermark over all others
    e = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp")
    c = spark.createDataFrame(consents, "consent_id long, user_id long, ts timestamp, consent boolean")
    src = str(tmp_path / "in")
    shuffled = CO.consent_rows(e, c).orderBy(F.rand(3)).collect()
    for i in range(0, len(shuffled), 30):  # rows of any time in any file, consents after what they decide too
        spark.createDataFrame(shuffled[i : i + 30], CO.ROWS_DDL).coalesce(1).write.mode("append").parquet(src)
    session = CO.stream_session(spark)
    args = (src, str(tmp_path / "out"), str(tmp_path / "c"))
    CO.stream_consent(session, *args, delay="10 days", limit=limit, timeout=timeout, max_files=1).awaitTermination()
    session.createDataFrame(last, "id long, user_id long, ts timestamp").selectExpr("user_id", "ts", "1 AS kind", "id", "cast(null AS boolean) AS consent").write.mode("append").parquet(src)
    for _ in range(2):
        CO.stream_consent(session, *args, delay="10 days", limit=limit, timeout=timeout).awaitTermination()
    got = [(r.event_id, r.route, r.decided_at) for r in session.read.schema(CO.OUT_DDL).parquet(str(tmp_path / "out")).collect()]
    flow = CO.consent_flow(e, c, limit, timeout, upto=F.lit(end - dt.timedelta(days=10)))
    want = [(r.event_id, r.route, r.decided_at) for r in flow.collect() if r.route != "queue"]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {"flush", "clear", "deliver", "drop", "evicted"} == {r for _, r, _ in got}


# ---- the preset library


def test_preset_library(spark, tmp_path):
    from gleaner.operators import presetstore as PS
    from gleaner.sources import library as LB

    make = lambda *ps: spark.createDataFrame([(i, n, ("//" + n, []), 1, s) for i, n, s in ps], PS.PRESET_DDL)
    lib = LB.preset_library(spark, str(tmp_path / "lib"))
    names = lambda: [(r.id, r.name) for r in LB.list_presets(lib).orderBy(*LB.ORDER).collect()]
    assert names() == []
    LB.save_presets(lib, make(("u1", "One", 0), ("u2", "Two", 1)))
    LB.save_presets(lib, make(("u3", "Three", 0), ("u1", "One!", 1), ("u4", "x", 2), ("u4", "Four", 3)))
    assert names() == [("u1", "One!"), ("u2", "Two"), ("u3", "Three"), ("u4", "Four")]
    LB.delete_presets(lib, spark.createDataFrame([("u2",), ("nope",)], "id string"))
    assert names() == [("u1", "One!"), ("u3", "Three"), ("u4", "Four")]
    other = LB.preset_library(spark, lib.path)
    taken = lib.latest()
    LB.save_presets(other, make(("u9", "Nine", 0)))
    with pytest.raises(VT.Conflict):
        lib.commit(LB.list_presets(lib, taken), "snapshot", taken)
    LB.save_presets(lib, make(("u5", "Five", 0)))
    assert names() == [("u1", "One!"), ("u3", "Three"), ("u4", "Four"), ("u9", "Nine"), ("u5", "Five")]
    status = PS.hide_preset(PS.reset_status(spark), "sys-images")
    every = LB.listed_presets(lib, PS.system_presets(spark), status).orderBy("origin_rank", *LB.ORDER).collect()
    assert [r.id for r in every[:5]] == ["u1", "u3", "u4", "u9", "u5"] and len(every) == 5 + 10
    LB.replace_presets(lib, LB.list_presets(lib).filter("id = 'u9'").drop("added"))  # reads what it replaces
    assert names() == [("u9", "Nine")] and [c.kind for c in lib.commits_of(lib.latest())] == ["snapshot"]


# ---- far pages and numbers


def test_ranked_pages(spark, tmp_path):
    from gleaner.operators import paging as PG

    r = random.Random(4)
    data = [(i, r.choice(["b", "A", "a", "C", None]), r.randrange(50)) for i in range(997)]
    df = spark.createDataFrame(data, "id long, name string, n int").repartition(7)
    path = str(tmp_path / "ranked")
    assert PG.write_ranked(df, path, [("name", True), ("n", False)], ["id"], rows_per_part=100) == 997
    want = sorted(data, key=lambda x: ((x[1] is not None, (x[1] or "").lower()), -x[2], x[0]))
    for index in (0, 1, 7, 33, 49, 50, 10_000, -3):
        page = min(max(index, 0), 49)
        got = PG.ranked_page(spark, path, index, 20).orderBy("display_index").collect()
        assert [(x["id"], x["name"], x["n"]) for x in got] == want[page * 20 : page * 20 + 20]
        assert [x["display_index"] for x in got] == list(range(page * 20 + 1, page * 20 + 1 + len(got)))
    assert PG.ranked_page_count(spark, path, 20) == 50
    scan = PG.ranked_page(spark, path, 40, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in scan or "PartitionFilters: [isnotnull(_part" in scan
    assert len([d for d in os.listdir(os.path.join(path, "rows")) if d.startswith("_part=")]) == 10
    PG.write_ranked(df.limit(0), str(tmp_path / "none"), [("n", True)], ["id"])
    assert PG.ranked_page_count(spark, str(tmp_path / "none"), 20) == 1


def test_numbers_of_large_groups(spark):
    from gleaner.operators import paging as PG

    r = random.Random(5)
    rows_ = [(1 if r.random() < 0.5 else r.choice([None, 2, 3]), T0 + dt.timedelta(minutes=r.choice([0, 0, r.randrange(10_000)])), i) for i in range(800)]
    df = spark.createDataFrame(rows_, "user_id long, ts timestamp, event_id long").repartition(5)
    want = {}
    for u in {x[0] for x in rows_}:
        for n, x in enumerate(sorted((x for x in rows_ if x[0] == u), key=lambda x: x[1:]), 1):
            want[x[2]] = n
    for limit in (20, 150, 10_000):
        got = PG.numbered(df, ["user_id"], ["ts", "event_id"], limit=limit).collect()
        assert {x["event_id"]: x["number"] for x in got} == want and len(got) == 800


def test_import_with_migrations_in_one_pass(spark):
    import json

    from gleaner.operators import presetstore as PS

    item = lambda i, **more: {"id": f"u{i}", "name": "P", "config": {"mainSelector": "//a", "columns": [{"name": "T", "selector": "."}]}, "createdAt": i, **more}
    old = lambda i: {"id": f"u{i}", "title": "Old", "config": {"mainSelector": "//a", "columns": []}}
    files = {
        "v3": {"version": 3, "presets": [item(1), item(2, id="sys-images"), item(3)]},
        "v2": {"version": 2, "presets": [{k: x for k, x in item(4).items() if k != "createdAt"}]},
        "v1": {"version": 1, "presets": [old(5), {**old(6), "id": "sys-forms"}]},
        "bad": {"version": 1, "presets": [old(7), {"id": ""}, 5]},
        "no": {"version": 1, "presets": [7]},
        "half": {"version": 1.5, "presets": []},
        "four": {"version": 4, "presets": []},
    }
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in files.items()], "file string, raw string")
    name = lambda i: F.try_variant_get(i, "$.title", "variant")
    migrations = {
        2: lambda items: F.when(F.forall(items, lambda i: F.try_variant_get(i, "$.id", "string").isNotNull()), F.transform(items, lambda i: PS.with_field(i, "name", name(i)))),
        3: lambda items: F.transform(items, lambda i: PS.with_field(i, "createdAt", F.parse_json(F.lit("99")))),
    }
    got = PS.validate_import(df, current=3, migrations=migrations)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rep = {r.file: r for r in got.collect()}
    assert [(p.item_index, p.id, p.name, p.created_at) for p in rep["v3"].presets] == [(0, "u1", "P", 1), (2, "u3", "P", 3)] and rep["v3"].skipped_system == 1
    assert [(p.id, p.created_at) for p in rep["v2"].presets] == [("u4", 99)]
    assert [(p.id, p.name, p.created_at) for p in rep["v1"].presets] == [("u5", "Old", 99)] and (rep["v1"].imported, rep["v1"].skipped_system) == (1, 1)
    assert rep["bad"].error == "Failed to migrate presets: version 2" and rep["bad"].presets == []
    assert rep["no"].error == "Failed to migrate presets: version 2"
    assert rep["half"].error == "Unsupported preset file version: migration to v2.5 not defined."
    assert rep["four"].error == "Unsupported preset file version. Expected version between 1 and 3."
    gap = {r.file: r.error for r in PS.validate_import(df, current=3, migrations={3: migrations[3]}).collect()}
    assert gap["v1"] == "Unsupported preset file version: migration to v2 not defined." and gap["v2"] is None
    odd = ['{"a":1}', " [1] ", '{"a":1},', "1],[2", '1,"v":2', "1}", "{} x", "", "null", '"x"']
    whole = spark.createDataFrame([(t,) for t in odd], "t string").select(F.schema_of_variant(PS.whole_json(F.col("t"))).alias("k")).collect()
    assert [r.k is not None for r in whole] == [True, True, False, False, False, False, False, False, True, True]


def test_ranked_partitions_stay_few(spark, tmp_path):
    """Partitions do not multiply with the rows; pages across their borders, equal and null keys are right."""
    from gleaner.operators import paging as PG

    data = [(i, None if i % 5 == 0 else f"k{i % 3}", i % 7) for i in range(500)]
    df = spark.createDataFrame(data, "id long, name string, n int").repartition(5)
    path = str(tmp_path / "ranked")
    assert PG.write_ranked(df, path, [("name", True), ("n", False)], ["id"], rows_per_part=2) == 500
    assert len([d for d in os.listdir(os.path.join(path, "rows")) if d.startswith("_part=")]) <= PG.SMALL_PARTS
    want = sorted(data, key=lambda x: (x[1] is not None, x[1] or "", -x[2], x[0]))
    for index in (0, 3, 12, 99):
        page = min(index, 12)
        got = PG.ranked_page(spark, path, index, 40).orderBy("display_index").collect()
        assert [(x["id"], x["name"], x["n"]) for x in got] == want[page * 40 : page * 40 + 40]
        assert [x["display_index"] for x in got] == list(range(page * 40 + 1, page * 40 + 1 + len(got)))
