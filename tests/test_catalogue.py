import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quillon.sources import catalogue

WORKS = [{"id": f"W{k}", "publication_year": 2000 + k % 4, "type": "article" if k % 3 else "book", "language": "en" if k % 2 else "es", "open_access": {"is_oa": k % 5 == 0}, "display_name": f"Work {k}"} for k in range(30)]


class Service(BaseHTTPRequestHandler):
    """A catalogue with cursor paging; every fourth request is answered 'busy' once."""

    asked: list[dict] = []
    busy = 0

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query).items()}
        Service.busy += 1
        if Service.busy % 4 == 0:
            self.send_response(429)
            self.end_headers()
            return
        Service.asked.append(q)
        found = WORKS
        for part in filter(None, q.get("filter", "").split(",")):
            key, _, value = part.partition(":")
            if key == "publication_year":
                a, _, b = value.partition("-")
                found = [w for w in found if int(a or 0) <= w["publication_year"] <= int(b or 9999)]
            elif key in ("type", "language"):
                found = [w for w in found if w[key] in value.split("|")]
            elif key == "is_oa":
                found = [w for w in found if str(w["open_access"]["is_oa"]).lower() == value]
        at = 0 if q["cursor"] == "*" else int(q["cursor"])
        page = found[at : at + 4]
        body = json.dumps({"results": page, "meta": {"next_cursor": str(at + 4) if at + 4 < len(found) else None}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def base(spark, monkeypatch):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked.clear()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(catalogue.WorksSource)
    yield f"http://127.0.0.1:{server.server_port}/works"
    server.shutdown()


def test_years_are_partitions_and_conditions_are_pushed(spark, base):
    df = spark.read.format("works").option("base", base).option("yearFrom", 2000).option("yearTo", 2003).load()
    got = df.where("publication_year >= 2001 and type = 'article' and language in ('en', 'de') and id != 'W5'")
    assert {r["id"] for r in got.collect()} == {w["id"] for w in WORKS if w["publication_year"] >= 2001 and w["type"] == "article" and w["language"] == "en" and w["id"] != "W5"}
    asked = {q["filter"] for q in Service.asked}
    assert asked == {f"publication_year:{y}-{y},type:article,language:en|de" for y in (2001, 2002, 2003)}
    assert got.rdd.getNumPartitions() == 3
    plan = got._jdf.queryExecution().toString()
    assert "W5" in plan.split("== Physical Plan ==")[1] and "Filter" in plan.split("== Physical Plan ==")[1]
    open_ones = df.where("is_oa = true")
    assert {r["id"] for r in open_ones.collect()} == {w["id"] for w in WORKS if w["open_access"]["is_oa"]}


def test_stream_goes_from_cursor_to_cursor(spark, base, tmp_path):
    def run():
        stream = spark.readStream.format("works").option("base", base).load().select("id")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(120):
                q.awaitTermination(1)
                if (tmp_path / "out").exists() and spark.read.schema("id string").parquet(str(tmp_path / "out")).count() >= len(WORKS):
                    break
        finally:
            q.stop()

    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(w["id"] for w in WORKS)


def test_topics_headings_and_funding(spark):
    work = {
        "id": "W1", "display_name": "T", "keywords": [{"display_name": "Salt"}], "topics": [{"display_name": "Sea", "subfield": {"display_name": "Ecology"}, "field": {"display_name": "Biology"}}, {"display_name": "salt"}],
        "concepts": [{"display_name": "Water", "level": 1, "score": 0.4}, {"display_name": "Weak", "level": 1, "score": 0.1}], "mesh": [{"descriptor_name": "Oceans"}],
        "awards": [{"funder_id": "F1", "funder_display_name": "Fund A", "funder_award_id": "9"}], "funders": [{"id": "F1", "display_name": "Fund A"}, {"id": "F2", "display_name": "Fund B"}],
    }
    r = catalogue.map_works(spark.createDataFrame([(json.dumps(work),), ('{"id": "W2"}',)], "value string")).orderBy("originId").collect()
    assert (r[0]["indexKeywords"], r[0]["areas"], r[0]["funding"]) == (["Salt", "Sea", "Water", "Oceans"], ["Ecology", "Biology"], "Fund A (9); Fund B")
    assert (r[1]["indexKeywords"], r[1]["areas"], r[1]["funding"]) == ([], [], "")
