"""The paged source against a server that fails, malformed rows kept apart, counts from the writing pass, and stateful streams."""

import datetime
import http.server
import threading
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.session import ship
from tidemark.sources import paged, readers, sinks
from tidemark.streaming import counts, running


@pytest.fixture(scope="module", autouse=True)
def package_on_workers(spark):
    ship(spark)


SIZES = {"cat:a": 23, "cat:b": 10, "cat:c": 0}


def entry(q, i):
    return f'<entry><id>http://x/abs/{q[-1]}.{i}</id><title>T {i} &amp; more</title><summary>S</summary><published>2024-01-{1 + i % 28:02d}T00:00:00Z</published><author><name>A</name></author><author><name>B</name></author><p:primary_category xmlns:p="http://p" term="cs.A"/><category term="cs.A"/><category term="cs.B"/></entry>'


@pytest.fixture()
def server():
    """Fails the first try of every third page, and page 10 of a whenever ``broken`` is set."""
    hits, state = Counter(), {"broken": True}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            q, start, n = asked["search_query"], int(asked["start"]), int(asked["max_results"])
            hits[q, start] += 1
            if state["broken"] and (q, start) == ("cat:a", 10) or (start // n) % 3 == 0 and hits[q, start] == 1:
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            body = f"<feed xmlns='http://www.w3.org/2005/Atom'>{''.join(entry(q, i) for i in range(start, min(start + n, SIZES[q])))}</feed>".encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/api", hits, state
    httpd.shutdown()


def test_paged_source_loses_no_page_and_reads_none_twice(spark, server, tmp_path):
    url, hits, state = server
    go = lambda: paged.fetch(spark, str(tmp_path / "pages"), url, list(SIZES), page_size=5, max_rows=50, pause=0, wait=0.01, max_retries=2, pages_per_task=2)
    first = go()
    assert {(r["query"], r["start"]) for r in first.where("status <> 'ok'").collect()} == {("cat:a", 10)}
    good = {(r["query"], r["start"]) for r in first.where("status = 'ok'").collect()}
    before = dict(hits)
    state["broken"] = False
    second = go()
    assert all(hits[k] == before[k] for k in good), "a stored page was read again"
    third = hits.copy()
    go()
    assert hits == third, "nothing was missing"
    rows = second.where("status = 'ok'").groupBy("query", "start").count().collect()
    assert all(r["count"] == 1 for r in rows)
    found = paged.papers(second)
    assert found.columns == readers.PAPERS.names
    ids = Counter(r["paper_id"] for r in found.collect())
    assert ids == Counter({f"{q[-1]}.{i}": 1 for q, n in SIZES.items() for i in range(n)})
    one = found.where("paper_id = 'a.3'").first()
    assert one["categories"] == "cs.A|cs.B" and one["authors"] == "A|B" and one["title"] == "T 3 & more" and one["primary_category"] == "cs.A"


def test_back_off_doubles_and_gives_up(server):
    waits = []
    status, tries, body = paged.get("http://127.0.0.1:1/none", 4, 0.5, waits.append)
    assert status.startswith("failed") and tries == 4 and body is None and waits == [0.5, 1.0, 2.0]


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('category,count\na,1\nb,many\n"c\nd",3\ne,4,5\n')
    columns = readers.schema(("category", readers._S), ("count", readers._I))
    good, bad = readers.read_csv_apart(spark, str(path), columns)
    assert sorted((r["category"], r["count"]) for r in good.collect()) == [("a", 1), ("c\nd", 3)]
    got = [(r["file"].rsplit("/", 1)[1], r["number"], r["record"].strip()) for r in bad.orderBy("number").collect()]
    assert got == [("x.csv", 1, "b,many"), ("x.csv", 2, "e,4,5")]


def test_counts_come_from_the_writing_pass(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    seen = sinks.write_counted(df, str(tmp_path / "t"), "numbers", most=F.max("x"), odd=F.count_if(F.col("id") % 2 == 1))
    assert seen == {"rows": 100, "most": 6, "odd": 50} and spark.read.parquet(str(tmp_path / "t")).count() == 100


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=n)


def events(spark, per_day, key="k", last=None):
    return [(day(d, h % 24), key) for d, n in enumerate(per_day) for h in range(n)]


def stream_of(spark, folder, batches):
    """A stream that takes a file at a time, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, key string").coalesce(1).write.mode("append").parquet(str(folder))
        files = sorted(p for p in folder.iterdir() if p.suffix == ".parquet" and not p.name.startswith("f"))
        files[0].rename(folder / f"f{n:03d}.parquet")
    schema = spark.createDataFrame([], "ts timestamp, key string").schema
    return counts.windowed_counts(counts.read_stream(spark, str(folder), schema, files_per_trigger=1), "ts", "key")


def test_trailing_means_across_batches_and_late_rows(spark, tmp_path):
    per_day = [3, 5, 2, 8, 1, 4, 9, 2, 6, 3, 7, 5]
    rows = events(spark, per_day)
    early, late = [r for r in rows if r[0] < day(6)], [r for r in rows if r[0] >= day(6)]
    too_late = [(day(1), "k")] * 4  # the watermark has long closed that day
    got = running.run_appended(running.trailing_means(stream_of(spark, tmp_path / "in", [early, late, too_late]), 3), str(tmp_path)).orderBy("start").collect()
    closed = [d for d in range(len(per_day)) if day(d + 3) <= max(r[0] for r in rows)]
    assert [r["count"] for r in got] == [per_day[d] for d in closed]
    for d, r in zip(closed, got):
        last = per_day[max(0, d - 2) : d + 1]
        assert r["n"] == len(last) and r["mean"] == pytest.approx(sum(last) / len(last))


def test_bursts_close_by_a_row_or_by_silence(spark, tmp_path):
    quiet = [2, 3, 2, 3, 2, 3, 2, 3]
    rows = events(spark, [*quiet, 20, 22, 2, 3, 2, 3])  # a run of two days, closed by the next
    rows += events(spark, [*quiet, 23], key="silent")  # a run that nothing follows
    tail = [(day(100), "other"), (day(101), "other"), (day(104), "other")]
    got = running.run_appended(running.bursts(stream_of(spark, tmp_path / "in", [rows, tail, [(day(140), "other")]]), 12, 2.0, 6, quiet_days=30), str(tmp_path)).collect()
    found = {r["category"]: (r["start"], r["end"], r["peak"], r["peak_count"], r["rows"]) for r in got}
    assert found == {"k": (day(8), day(10), day(9), 22, 2), "silent": (day(8), None, day(8), 23, 1)}
