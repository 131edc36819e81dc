"""Loads on small stores: idempotence, routing, guards, and the laws between reports."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from sendledger import schemas as C
from sendledger.operators import enrich, existence, feed_b, mapping as M, quality, reports as R
from sendledger.operators.feed_a import feed_a_counts
from sendledger.operators.feed_c import funnel
from sendledger.operators.paging import page, page_info
from sendledger.operators.templates import refresh_templates
from sendledger.plans import ingest as I
from sendledger.plans.feeds import (
    LOADED, append_feed, first_per_phone, load_feed, read_ledger, read_stored_feed,
)
from sendledger.plans.lookup import client_base, stored_rows
from sendledger.plans.tables import change_mappings, load_templates, save_mappings
from sendledger import session
from sendledger.session import settle
from sendledger.sources import store as S
from sendledger.sources.commits import Commits
from sendledger.sources.reports import read_delivery_reports
from sendledger.streaming.watch import hourly_counts, running_counts, stream_table, watch_reports
from sendledger.workload import files
from sendledger.workload.fixtures import frame
from sendledger.workload.registry import Inputs
from test_sources import CAMPAIGN, HEADER, put

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame(
        [
            (2, "send", "C 1", "P", "sms", "late", "late_done"),
            (1, "SEND", "c 1", "P", "sms", "early", "early_done"),
        ],
        C.MAPPING,
    )


@pytest.fixture(scope="module")
def region(spark):
    return spark.createDataFrame([("9876", "West"), ("9876", "East"), ("1111", "None")], C.REGION)


def staged(spark, rows):
    """Rows given as dicts; the rest is filled."""
    base = dict.fromkeys(C.STAGED_COLUMNS)
    base.update(
        mobileNo="919876000001", sender="SEND", status="Delivered", cause="Delivered", circle="Unknown",
        client="C 1", product="P", submit_time="2025-04-05 10:00:00", delivered_time="2025-04-05 10:01:00",
        source="s1",
    )
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], C.STAGED)


def report(folder, name, days, cause="Delivered"):
    lines = [
        f"{i},{i},919876000001,SEND,hi,T,1,1,Delivered,{cause},ch,{day} 9:07,{day} 9:08,1.1.1.1,e,t"
        for i, day in enumerate(days)
    ]
    put(folder, name, "\n".join([HEADER, *lines]) + "\n")


def counts(store):
    return {t.folder: store.read(t).count() for t in (I.LOG, I.DND, I.DONE, I.PROMO)}


def test_load_is_idempotent_and_routed(spark, tmp_path, mapping, region):
    os.mkdir(tmp_path / "in")
    report(tmp_path / "in", "one.csv", ["4/5/2025", "5/1/2025"], cause="NCPR Fail")
    report(tmp_path / "in", "two.csv", ["4/6/2025"])
    store = I.Store(spark, str(tmp_path / "store"))
    rows, _ = read_delivery_reports(spark, str(tmp_path / "in"), CAMPAIGN)
    first = I.ingest(rows, store, mapping, region)
    assert first.duplicates == [] and first.sources == ["one", "two"]
    after = counts(store)
    assert after == {"message_log": 3, "dnd": 2, "campaign_done": 3, "promotions_log": 3}
    # The month of each row counts, not that of the file's last row.
    log = store.read(I.LOG)
    assert {(r["source"], r["month"]) for r in log.collect()} == {
        ("one", "2025-04"), ("one", "2025-05"), ("two", "2025-04"),
    }
    assert {(r["mapping_key"], r["circle"]) for r in log.collect()} == {("early", "East")}
    assert {r["done_key"] for r in store.read(I.DONE).collect()} == {"early_done"}
    # A third file beside two known ones: only it is loaded.
    report(tmp_path / "in", "three.csv", ["4/7/2025"])
    rows, _ = read_delivery_reports(spark, str(tmp_path / "in"), CAMPAIGN)
    second = I.ingest(rows, store, mapping, region)
    assert second.duplicates == ["one", "two"] and second.sources == ["three"]
    assert counts(store) == {"message_log": 4, "dnd": 2, "campaign_done": 4, "promotions_log": 4}


class Crash(Exception):
    pass


@pytest.mark.parametrize("writes", range(7))
def test_interrupted_load_is_absent(spark, tmp_path, mapping, region, monkeypatch, writes):
    """A load may stop inside any write, with some of its files in place, or before its commit; nothing of it is seen,
    and run again it gives every row once."""
    store = I.Store(spark, str(tmp_path))
    I.ingest(staged(spark, [{"source": "s0"}]), store, mapping, region)
    rows = staged(spark, [{"cause": "NCPR Fail"}, {"source": "s2"}, {"source": "s2", "submit_time": "2025-05-05 10:00:00"}])
    left = [writes]

    def broken(write):
        def run(commits, *args, **options):
            if left[0]:
                left[0] -= 1
                return write(commits, *args, **options)
            if write.__name__ == "write":
                for e in write(commits, *args, **options)[1:]:  # the first partition is in place, the others are not
                    shutil.rmtree(f"{commits.root}/{e.folder}")
            raise Crash

        return run

    before = counts(store)
    with monkeypatch.context() as patch:
        patch.setattr(Commits, "write", broken(Commits.write))
        patch.setattr(Commits, "commit", broken(Commits.commit))
        if writes < 6:
            with pytest.raises(Crash):
                I.ingest(rows, store, mapping, region)
            assert counts(store) == before
        else:
            I.ingest(rows, store, mapping, region)
    again = I.ingest(rows, store, mapping, region)
    assert counts(store) == {"message_log": 4, "dnd": 1, "campaign_done": 4, "promotions_log": 4}
    assert (again.sources, again.duplicates) == (([], ["s1", "s2"]) if writes == 6 else (["s1", "s2"], []))
    assert I.ingest(rows, store, mapping, region).duplicates == ["s1", "s2"]
    assert counts(store)["promotions_log"] == 4


def test_a_load_leaves_no_settled_files(spark, tmp_path, mapping, region, monkeypatch):
    folder = tmp_path / "shared"
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(folder))
    os.mkdir(tmp_path / "in")
    report(tmp_path / "in", "one.csv", ["4/5/2025"])
    store = I.Store(spark, str(tmp_path / "store"))

    def load():
        with session.scratch(spark):
            rows, _ = read_delivery_reports(spark, str(tmp_path / "in"), CAMPAIGN)
            return I.ingest(rows, store, mapping, region)

    assert load().sources == ["one"]
    assert os.listdir(folder) == []
    monkeypatch.setattr(I, "to_promo", lambda df: df.select("no such column"))
    report(tmp_path / "in", "two.csv", ["4/5/2025"])
    with pytest.raises(Exception):
        load()
    assert os.listdir(folder) == []
    assert settle(spark.range(3)).count() == 3 and len(os.listdir(folder)) == 1


def test_shared_folder_must_be_named(spark, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: None)
    with pytest.raises(RuntimeError):
        session.work_folder(spark)


def test_a_load_takes_few_jobs(spark, tmp_path, mapping, region):
    store, group = I.Store(spark, str(tmp_path)), "few-jobs"
    rows = settle(staged(spark, [{"cause": "NCPR Fail"}, {"source": "s2"}]))
    mapping, region = settle(mapping), settle(region)
    spark.sparkContext.setJobGroup(group, "")
    try:
        I.ingest(rows, store, mapping, region)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 15


def test_unreadable_month_is_guarded_too(spark, tmp_path, mapping, region):
    store = I.Store(spark, str(tmp_path))
    rows = staged(spark, [{"submit_time": "soon"}, {"submit_time": None}])
    for _ in range(2):
        I.ingest(rows, store, mapping, region)
    assert store.read(I.LOG).where("month = 'unknown'").count() == 2


def test_null_source_always_passes(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "source string, n int")
    stored = spark.createDataFrame([(None,), ("a",)], "source string")
    assert sorted(r["n"] for r in existence.unseen(rows, stored, ["source"]).collect()) == [1, 3]


def test_key_keeps_its_text_form(spark, tmp_path, region):
    mapping = spark.createDataFrame([(1, "SEND", "C 1", "P", "sms", "007", "1e3")], C.MAPPING)
    store = I.Store(spark, str(tmp_path))
    I.ingest(staged(spark, [{}]), store, mapping, region)
    assert store.read(I.LOG).first()["mapping_key"] == "007"
    assert store.read(I.DONE).first()["done_key"] == "1e3"


def test_number_lists_skip_the_log(spark, tmp_path, mapping, region):
    store = I.Store(spark, str(tmp_path))
    for _ in range(2):
        I.ingest_numbers(staged(spark, [{}, {}]), store, mapping, region, "2025-04-05")
    assert counts(store) == {"message_log": 0, "dnd": 0, "campaign_done": 2, "promotions_log": 2}


def test_unknown_transaction_is_an_error(spark, tmp_path, mapping, region):
    store = I.Store(spark, str(tmp_path))
    cdr = spark.createDataFrame([], C.CDR)
    codes = spark.createDataFrame([], C.ERROR_CODES)
    with pytest.raises(ValueError):
        I.ingest_cdr(cdr, "t1", {"date": "2025-04-05"}, store, mapping, region, codes)


def test_enrichment_never_adds_rows(spark, region):
    rows = staged(spark, [{}, {"mobileNo": "919999000001"}, {"mobileNo": None}])
    got = enrich.with_circle(rows, region)
    assert sorted(r["circle"] for r in got.collect()) == ["East", "Unknown", "Unknown"]
    codes = spark.createDataFrame([("delivered", "b", "x"), ("DELIVERED", "a", None)], C.ERROR_CODES)
    got = enrich.with_error_text(rows, codes)
    assert {(r["status"], r["cause"]) for r in got.collect()} == {("a", None)}
    assert enrich.with_error_text(rows, codes, "other").first()["status"] == "Delivered"


def test_log_reads_are_pruned(spark, tmp_path, mapping, region, capsys):
    store = I.Store(spark, str(tmp_path))
    I.ingest(staged(spark, [{}, {"source": "s2", "submit_time": "2025-05-05 10:00:00"}]), store, mapping, region)
    log = S.read_months(store.read(I.LOG), "2025-04-01", "2025-04-30")
    R.campaign_summary(log, "SEND", "2025-04-01", "2025-04-30").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "GreaterThanOrEqual(submit_date" in plan
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "text:" not in schema and "entity_id" not in schema


def test_reports_by_name_read_their_folders_only(spark, tmp_path, mapping, region, capsys):
    store = I.Store(spark, str(tmp_path))
    I.ingest(staged(spark, [{}, {"sender": "other", "client": "c 2"}, {"source": "s2", "submit_time": "2025-05-05 10:00:00"}]), store, mapping, region)
    days = ("2025-04-01", "2025-04-30")
    log = stored_rows(store, I.LOG, mapping, "SEND", *days)
    assert log.count() == 1
    R.campaign_summary(log, "SEND", *days).explain("formatted")
    R.base_check(stored_rows(store, I.DONE, mapping, "C 1", *days), "C 1", *days).explain("formatted")
    plan = capsys.readouterr().out
    for key, line in zip(("mapping_key", "done_key"), [x for x in plan.splitlines() if x.startswith("PartitionFilters")]):
        assert "month" in line and f"{key}#" in line
    assert plan.count("GreaterThanOrEqual(submit_date,2025-04-01)") == 2
    assert client_base(store, mapping, "C 1", *days).count() == 1
    assert stored_rows(store, I.LOG, mapping, "other").count() == 1
    with pytest.raises(LookupError, match="no mapping"):
        client_base(store, mapping, "c 2", *days)
    with pytest.raises(LookupError, match="no rows"):
        client_base(store, mapping, "C 1", "2031-01-01", "2031-01-02")


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    path = str(tmp_path / "table")
    os.makedirs(f"{path}/claims")
    open(f"{path}/claims/1", "w").close()
    with pytest.raises(RuntimeError):
        S.replace_table(spark.range(3), path)
    os.remove(f"{path}/claims/1")
    S.replace_table(spark.range(3), path)
    assert S.read_current(spark, path, spark.range(0).schema).count() == 3


def test_report_laws(spark):
    log = frame(spark, SF, "log")
    days = ("2024-01-01", "2024-12-31")
    summary = R.campaign_summary(log, "SENDA", *days).agg(
        F.sum("submitted_count"), F.sum("delivered_count"), F.sum("notsent_count"), F.sum("failed_count")
    ).first()
    groups = R.group_totals(log, "SENDA", *days).agg(
        F.sum("total_submitted"), F.sum("total_delivered"), F.sum("total_notsent"), F.sum("total_failed")
    ).first()
    assert tuple(summary) == tuple(groups)
    # A NULL status is in no counter, a NULL cause neither failed nor not sent.
    assert summary[0] < log.where("sender = 'SENDA'").count()
    assert R.monthly_trend(log).agg(F.sum("total_delivered")).first()[0] == (
        R.daily_trend(log).agg(F.sum("delivered_count")).first()[0]
    )
    leads = frame(spark, SF, "lead_feed_b")
    both = feed_b.feed_b_qualified(leads).join(feed_b.feed_b_qualified(leads, "total"), "lead_date", "full")
    assert both.where("NOT count_of_lead_category <=> total_cpql").count() == 0


@pytest.mark.parametrize("direction", ["next", "prev"])
def test_pages_make_the_whole(spark, direction):
    promo, days = frame(spark, SF, "promo"), ("client", "2024-01-01", "2024-12-31")
    uploads = R.upload_list(promo, *days)
    cursor, seen = ("zzz" if direction == "prev" else None), []
    for _ in range(100):
        rows = page(uploads, cursor, 40, direction).collect()
        info = page_info(promo, *days, 40, cursor, direction).first()
        seen += rows
        if not info["has_next"]:
            break
        cursor = info["previous_cursor"] if direction == "prev" else info["next_cursor"]
    assert sorted(seen, key=repr) == sorted(uploads.collect(), key=repr)
    assert info["total_records"] == R.source_count(promo, *days).first()[0]
    assert info["total_pages"] == -(-info["total_records"] // 40)


def test_a_page_finds_its_sources_first(spark):
    """No window over all rows; the sources are read from the columns of the filter and the key alone."""
    promo, days = frame(spark, SF, "promo"), ("client", "2024-01-01", "2024-12-31")
    plan = page(R.upload_list(promo, *days), "CM")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Window" not in physical and physical.count("FileScan parquet") == 2
    assert "LeftSemi" in physical and "rangepartitioning" in physical
    hot = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("source"), "id")
    assert page(hot, limit=1).count() == 1667


def test_source_without_name_is_on_the_first_page(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "source string, n int")
    assert [r["n"] for r in page(rows, limit=2).collect()] == [1, 2]


def test_days_must_share_a_month(spark):
    with pytest.raises(ValueError):
        R.base_check(frame(spark, SF, "done"), "c", "2024-01-31", "2024-02-01")


def test_first_phone(spark):
    rows = spark.createDataFrame(
        [("a", 1, 5, "x"), ("a", 0, 9, "first"), (None, 0, 1, "n"), (None, 0, 2, "n"), ("b", 0, 1, "known"), ("", 0, 0, "e")],
        "phone string, block long, pos long, city string",
    ).withColumn("file_path", F.lit("f"))
    stored = spark.createDataFrame([("b",)], "phone string")
    got = sorted(("-" if r["phone"] is None else r["phone"], r["city"]) for r in first_per_phone(rows, stored).collect())
    assert got == [("", "e"), ("-", "n"), ("-", "n"), ("a", "first")]


def test_append_feed_keeps_repeats_of_the_batch(spark):
    rows = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "lead_id string")
    stored = spark.createDataFrame([("2",)], "lead_id string")
    assert sorted(str(r[0]) for r in append_feed(rows, stored, "lead_id").collect()) == ["1", "1", "None"]


def test_mapping_ids_are_consecutive(spark):
    new = spark.range(1000).select(
        F.col("id").cast("string").alias("sender"), *[F.lit("x").alias(n) for n in ("client", "product", "channel", "mapping", "log_mapping")]
    )
    old = spark.createDataFrame([(7, "3", "x", "x", "x", "m", "l")], C.MAPPING)
    added, exists = M.add_mappings(old, new.unionByName(new))
    assert sorted(r["id"] for r in added.collect()) == list(range(8, 1007))
    assert exists.count() == 2
    assert added.collect() is not None and set(added.collect()) == set(added.collect())
    empty = spark.createDataFrame([], C.MAPPING)
    assert M.add_mappings(empty, new.limit(1))[0].first()["id"] == 1


def test_mapping_null_is_never_the_same(spark):
    row = (None, "c", "p", "sms", "m", "l")
    names = "sender string, client string, product string, channel string, mapping string, log_mapping string"
    old = spark.createDataFrame([(1, *row)], C.MAPPING)
    added, exists = M.add_mappings(old, spark.createDataFrame([row, row], names))
    assert added.count() == 2 and exists.count() == 0


def test_mapping_change_needs_all_fields(spark, mapping):
    change = (1, "S", "C", "P", "rcs", "m2", "r", "l2")
    names = C.MAPPING.names[:6] + ["rcs_mapping", "log_mapping"]
    changes = spark.createDataFrame([change, (2, *change[1:6], "", "l2")], names)
    got = {r["id"]: r["mapping"] for r in M.update_mapping(mapping, changes).collect()}
    assert got == {1: "m2", 2: "late"}


def test_templates_read_twice_change_nothing(spark):
    new = spark.createDataFrame([("'1", "s", "1", "t"), ("'2", "s", "1", "t")], "tempid string, sender string, count string, text string")
    none = spark.createDataFrame([], C.TEMPLATES)
    listed = spark.createDataFrame([("2",)], "tempid string")
    once = refresh_templates(none, new, listed, "K", "apr25")
    twice = refresh_templates(once, new, listed, "K", "apr25")
    assert once.collect() == twice.collect()
    assert [(r["tempid"], r["type"], r["month"]) for r in once.collect()] == [("1", "K", "apr25")]


def test_quality(spark, region):
    rows = staged(spark, [{"cause": "x" * 51}, {"mobileNo": "917777000001"}])
    (r,) = quality.length_violations(rows).collect()
    assert tuple(r) == ("cause", 50, 1, 51)
    assert [r["mobileNo"] for r in quality.without_circle(rows, region).collect()] == ["917777000001"]


def test_watch_loads_each_file_once(spark, tmp_path, mapping, region):
    landing, store = tmp_path / "land", I.Store(spark, str(tmp_path / "store"))
    os.mkdir(landing)

    def drain():
        watch_reports(
            spark, str(landing), store, str(tmp_path / "cp"), CAMPAIGN, mapping, region, files_per_batch=2
        ).awaitTermination()

    for i in range(3):
        report(landing, f"f {i} [a]{{b}}.csv", ["4/5/2025"])
    put(landing, "bad.csv", "a,b\n1,2\n")
    drain()
    assert counts(store)["message_log"] == 3
    assert [r["source"] for r in store.read(I.REJECTED).collect()] == ["bad"]
    report(landing, "g.csv", ["4/6/2025"])
    drain()
    log = store.read(I.LOG)
    assert sorted(r["source"] for r in log.collect()) == ["f 0 [a]{b}", "f 1 [a]{b}", "f 2 [a]{b}", "g"]
    # A fresh checkpoint sends all files again; the store stays as it is.
    watch_reports(
        spark, str(landing), store, str(tmp_path / "cp2"), CAMPAIGN, mapping, region
    ).awaitTermination()
    assert store.read(I.LOG).count() == 4 and store.read(I.REJECTED).count() == 1


def run_stream(spark, counted, mode, name, checkpoint):
    counted.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_running_counts_equal_the_batch(spark, tmp_path):
    log = frame(spark, SF, "log")
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    stream = stream_table(spark, str(tmp_path / "log"), log.schema, files_per_batch=1)
    updates = run_stream(spark, running_counts(stream), "update", "updates", str(tmp_path / "cp"))
    assert updates.count() > log.select("source").distinct().count()
    # The last update of a source holds its largest submitted count.
    last = updates.groupBy("source").agg(F.max("submitted_count").alias("n"), F.max("failed_count").alias("f"))
    batch = log.groupBy("source").agg(*R.counters()).select("source", "submitted_count", "failed_count")
    assert sorted(last.collect()) == sorted(batch.collect())


def test_hourly_counts_close_hours(spark, tmp_path):
    rows = staged(spark, [{"submit_time": f"2025-04-0{d} 10:{m}0:00"} for d in (1, 2, 9) for m in (0, 5)])
    rows.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = stream_table(spark, str(tmp_path / "log"), rows.schema)
    closed = run_stream(spark, hourly_counts(stream), "append", "closed", str(tmp_path / "cp")).collect()
    assert sorted((r["hour"]["start"].day, r["submitted_count"]) for r in closed) == [(1, 2), (2, 2)]


def sheet(folder, feed, kind, rows):
    names = C.FEEDS[(feed, kind)]
    lines = [",".join(names)] + [",".join(r.get(n, "") for n in names) for r in rows]
    put(folder, f"{kind}.csv", "\n".join(lines) + "\n")


def test_feed_a_load(spark, tmp_path):
    root = str(tmp_path / "store")
    day = {"report_date": "4/5/25", "utm_medium": "x_05_04_2025"}
    sheet(tmp_path, "A", "leads", [{**day, "phone": "1"}, {**day, "phone": "1", "city": "late"}, {**day, "phone": "2"}])
    sheet(tmp_path, "A", "sales", [{**day, "phone": "1", "amount": "10.5"}])
    assert load_feed(spark, str(tmp_path), "Leads 5-Apr'25.xlsx", "A", root, "2025-04")
    assert not load_feed(spark, str(tmp_path), "Leads 5-Apr'25.xlsx", "A", root, "2025-04")
    sheet(tmp_path, "A", "leads", [{**day, "phone": "2"}, {**day, "phone": "3"}])
    assert load_feed(spark, str(tmp_path), "Leads 6-Apr'25.xlsx", "A", root, "2025-04")
    leads = read_stored_feed(spark, root, "A", "leads", "2025-04")
    assert sorted((r["id"], r["phone"]) for r in leads.collect())[2] == (3, "3")
    assert leads.where("city = ''").count() == 3
    (r,) = feed_a_counts(leads, read_stored_feed(spark, root, "A", "sales")).collect()
    assert (r["extracted_date"], r["lead_count"], r["sale_count"]) == ("05_04_2025", 3, 1)
    assert sorted(r["date"] for r in read_ledger(spark, root, "A").collect()) == ["05/04/2025", "06/04/2025"]


def test_feed_a_ids_go_on_over_months(spark, tmp_path):
    root = str(tmp_path / "store")
    day = {"report_date": "5/1/25", "utm_medium": "x_05_04_2025"}
    for i, (month, phone) in enumerate([("2025-05", "1"), ("2025-06", "2")]):
        for kind in ("leads", "sales"):
            sheet(tmp_path, "A", kind, [{**day, "phone": phone}])
        assert load_feed(spark, str(tmp_path), f"Leads {i}.xlsx", "A", root, month)
    leads, sales = (read_stored_feed(spark, root, "A", kind) for kind in ("leads", "sales"))
    assert sorted(r["id"] for r in leads.collect()) == [1, 2]
    (r,) = feed_a_counts(leads, sales).collect()
    assert (r["lead_count"], r["sale_count"]) == (2, 2)


def test_feed_b_load_replaces(spark, tmp_path):
    root = str(tmp_path / "store")
    for i, ids in enumerate((["1", "2"], ["3"])):
        sheet(tmp_path, "B", "leads", [{"lead_date": "5-Apr-25".zfill(9), "lead_id": x} for x in ids])
        assert load_feed(spark, str(tmp_path), f"Leads {i}.xlsx", "B", root, "2025-04")
    rows = read_stored_feed(spark, root, "B", "leads", "2025-04").collect()
    assert [(r["lead_id"], str(r["lead_date"])) for r in rows] == [("3", "2025-04-05")]


def test_feed_c_load_appends(spark, tmp_path):
    root = str(tmp_path / "store")
    for i, ids in enumerate((["1", "1"], ["1", "2"])):
        sheet(tmp_path, "C", "leads", [{"offer_id": x, "utm_campaign": "A_SM_0504", "bt_f": "BT"} for x in ids])
        for kind in ("login", "approval", "disbursal"):
            sheet(tmp_path, "C", kind, [{"customer_id": x, "utm_campaign": "A_SM_0504", "bt": "Fresh"} for x in ids])
        assert load_feed(spark, str(tmp_path), f"Leads {i}.xlsx", "C", root, "2025-04")
    stages = {k: read_stored_feed(spark, root, "C", k, "2025-04") for k in LOADED["C"]}
    (r,) = funnel(stages, "2025-04-05", "2025-04-05").collect()
    assert (r["lead_count"], r["lead_bt_count"], r["login_fresh_count"], r["disb_count"]) == (3, 3, 3, 3)
    assert (r["campaign_type"], str(r["formatted_date"])) == ("SMS", "2025-04-05")


@pytest.mark.parametrize("feed, kind", [("C", "leads"), ("A", "leads")])
def test_stored_keys_are_broadcast_by_their_size_in_memory(spark, tmp_path, feed, kind):
    """A key of a wide sheet takes a small share of its files, however many rows there are."""
    names, key = C.FEEDS[(feed, kind)], {"C": "offer_id", "A": "phone"}[feed]

    def joins(n):
        rows = spark.range(n).select([(F.col("id") if c == key else F.lit("")).cast("string").alias(c) for c in names])
        rows.coalesce(1).write.parquet(str(tmp_path / str(n)))
        stored = spark.read.parquet(str(tmp_path / str(n)))
        if feed == "C":
            found = append_feed(rows.limit(3), stored, key)
        else:
            found = first_per_phone(rows.limit(3).withColumn("place", F.lit(1)), stored, ["place"])
        assert found.count() == 0
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        return "strategy=merge" in plan

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "400k")
    try:
        assert joins(20_000) and not joins(50)
    finally:
        spark.conf.set(name, before)


def test_mapping_table(spark, tmp_path, mapping):
    path = str(tmp_path / "mapping")
    new = mapping.drop("id")
    added, exists = save_mappings(new, path)
    assert (added.count(), exists.count()) == (2, 0)
    added, exists = save_mappings(new, path)
    assert (added.count(), exists.count()) == (0, 2)
    stored = S.read_current(spark, path, C.MAPPING)
    assert sorted(r["id"] for r in stored.collect()) == [1, 2]
    change_mappings(stored.withColumn("mapping", F.lit("new")).withColumn("rcs_mapping", F.lit("r")), path)
    assert {r["mapping"] for r in S.read_current(spark, path, C.MAPPING).collect()} == {"new"}


def test_template_table(spark, tmp_path):
    put(tmp_path, "t.csv", "TemplateId,Sender,Count,Text\n'1,S,2,\"a,\nb\"\n'2,S,1,c\n")
    listed = spark.createDataFrame([("'2",)], "tempid string")
    for _ in range(2):
        load_templates(spark, str(tmp_path / "t.csv"), str(tmp_path / "templates"), listed, "K", "apr25")
    (r,) = S.read_current(spark, str(tmp_path / "templates"), C.TEMPLATES).collect()
    assert r.asDict() == {"tempid": "1", "sender": "S", "count": "2", "text": "a,\nb", "type": "K", "month": "apr25"}


def test_hot_source_needs_no_shuffle_of_rows(spark, tmp_path, mapping, region):
    """Rows meet the known sources by broadcast, so a hot source stays spread."""
    rows = staged(spark, [{"source": "hot"}] * 50 + [{"source": "cold"}])
    known = settle(existence.known_keys(rows, rows.where("source = 'cold'"), ["source"]))
    plan = existence.unseen(rows, known, ["source"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan.split("BroadcastHashJoin")[0]


def test_few_groups_of_a_large_table_need_no_shuffle_of_rows(spark):
    # An aggregate's estimated size is that of what it reads, here 32 MB and more.
    large = spark.range(4_000_000).select((F.col("id") % 3).alias("k"), "id")
    groups = large.groupBy("k").agg(F.min("id").alias("id"))
    name = F.concat(F.lit("S"), F.col("k"))
    mapping = groups.select("id", name.alias("sender"), F.concat(F.lit("m"), F.col("k")).alias("mapping"))
    rows = spark.range(8).select("id", F.concat(F.lit("s"), F.col("id") % 4).alias("sender"))
    keyed = enrich.mapping_key(rows, mapping, "sender", "mapping")
    codes = groups.select(name.alias("code"), F.lit("sent").alias("status"), F.concat(F.lit("c"), F.col("k")).alias("cause"))
    told = enrich.with_error_text(rows.select("id", F.col("sender").alias("status"), F.lit("").alias("cause")), codes)
    for found in (keyed, told):
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in keyed.collect()) == [
        (i, f"s{i % 4}", f"m{i % 4}" if i % 4 < 3 else "s3") for i in range(8)
    ]
    assert sorted(tuple(r) for r in told.collect()) == [
        (i, "sent", f"c{i % 4}") if i % 4 < 3 else (i, "s3", "") for i in range(8)
    ]


def test_reports_sent_twice_are_parsed_once(spark, tmp_path, monkeypatch):
    events = spark.range(20).select(
        F.col("id").alias("event_id"), F.lit("2024-01-05 10:00:00").cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.range(2).select(F.col("id").alias("n_nationkey"), F.lit("North").alias("n_name")).write.parquet(f"{tmp_path}/nation.parquet")
    given = []
    monkeypatch.setattr(files, "ingest", lambda rows, *rest: given.append(rows))
    files._loaded_twice(Inputs(spark, str(tmp_path)))
    assert [rows.count() for rows in given] == [20, 20]
    for rows in given:
        assert "csv" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
