import pytest
from pyspark.sql import functions as F

from logsieve.operators import results, zones
from logsieve.operators.window import Cursor, Window, page_rows


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(folder, zones, schema): 120 files whose times overlap a little; some events have no time."""
    folder = str(tmp_path_factory.mktemp("zones") / "events")
    rows = spark.range(6000).selectExpr("id as event_id", "if(id % 3 = 0, 'alb_access', 'cloudtrail') as log_type", "concat('n', id % 50) as event_name", "cast(id div 100 as int) as p")
    time = F.timestamp_micros((F.col("event_id") * 60_000_000 + (F.col("event_id") * 7919 % 400) * 1_000_000 - F.col("event_id") % 7 * 60_000_000).cast("long")).cast("timestamp_ntz")
    rows = rows.withColumn("event_time", F.when(F.col("event_id") % 37 != 0, time)).repartitionByRange(60, "p").sortWithinPartitions("log_type", "event_id").drop("p")
    rows.write.partitionBy("log_type").parquet(folder)
    events = spark.read.parquet(folder)
    table = zones.zones(events).cache()
    assert table.count() >= 100
    return folder, table, events.schema


WINDOWS = [
    Window(limit=50), Window(limit=50, newest_first=False), Window(limit=1000), Window(limit=40, log_type="alb_access"), Window(limit=40, search="n7"), Window(limit=40, search="nothing like it"),
    Window(limit=30, start="1970-01-02", stop="1970-01-03"), Window(limit=30, start="1970-01-02", newest_first=False), Window(limit=100, log_type="none"),
]


@pytest.mark.parametrize("window", WINDOWS, ids=str)
def test_pages_are_those_of_the_whole_table(spark, made, window):
    folder, table, schema = made
    events, pages = spark.read.parquet(folder), 0
    while pages < 3:
        want = page_rows(results.canonical(events), window).select("event_id", "event_time").collect()
        ids, opened = zones.page(spark, folder, table, schema, window)
        assert ids == [r.event_id for r in want]
        if window.limit <= 50 and not window.search and window.log_type != "none" and pages == 0:
            assert len(opened) <= 24
        if len(want) < window.size:
            break
        last = want[-1]
        window = Window(**{**window.__dict__, "after": Cursor(last.event_id, None if last.event_time is None else zones._micros(last.event_time))})
        pages += 1


def test_the_last_pages_hold_events_without_a_time(spark, made):
    folder, table, schema = made
    events = results.canonical(spark.read.parquet(folder))
    for newest in (True, False):
        last = page_rows(events.where("event_time is not null"), Window(limit=1, newest_first=not newest)).first()
        for after in (Cursor(last.event_id, zones._micros(last.event_time)), Cursor(3000, None)):
            window = Window(limit=60, newest_first=newest, after=after)
            want = [r.event_id for r in page_rows(events, window).select("event_id").collect()]
            assert want and zones.page(spark, folder, table, schema, window)[0] == want


def test_rows_are_those_of_the_list(spark, made):
    folder, table, schema = made
    window = Window(limit=25)
    want = results.list_events(spark.read.parquet(folder), window).collect()
    assert zones.list_events(spark, folder, table, schema, window).collect() == want
    assert zones.list_events(spark, folder, table, schema, Window(log_type="none")).collect() == []
