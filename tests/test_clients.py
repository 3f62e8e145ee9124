"""Clients, reports and the scans of zipped and derived files, without a network."""

import io
import json
import urllib.error
import zipfile

import pytest

from tessera.sources import clients, readers, reports


def error(code, body=b""):
    return urllib.error.HTTPError("https://x", code, "no", {}, io.BytesIO(body))


def test_series(tmp_path, spark):
    asked, slept = [], []

    def opener(request):
        asked.append(request.full_url)
        if "S0" in request.full_url:
            raise error(400, b"The series does not exist.")
        if len(asked) == 2:
            raise error(503)
        return json.dumps({"observations": [{"date": "2020-01-01", "value": "."}, {"date": "2021-01-01", "value": "2.5", "more": 1}]}).encode()

    c = clients.Series("https://x/series", "key", opener, clients.Throttle(100, sleep=slept.append))
    path = str(tmp_path / "s.json")
    assert c.land(["S0", "S1", "S2"], path) == ["S0"] and len(asked) == 4 and len(slept) == 1
    assert {tuple(r) for r in readers.observations(spark, f"file://{path}").collect()} == {("S1", 2021, 2.5), ("S2", 2021, 2.5)}
    with pytest.raises(urllib.error.HTTPError):
        clients.Series("https://x", "k", lambda r: (_ for _ in ()).throw(error(500)), clients.Throttle(100, sleep=slept.append)).observations("S")


def test_throttle():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = clients.Throttle(2, 60, lambda: now[0], sleep)
    for _ in range(5):
        t.wait()
        now[0] += 1
    assert slept == [58, 58]


def test_articles(tmp_path):
    logins = []

    def opener(request):
        if request.full_url == "https://login":
            logins.append(1)
            return b'{"access_token": "t%d"}' % len(logins)
        if request.get_header("Authorization") == "Bearer t1" and request.full_url.endswith("/C"):
            raise error(401)
        if request.full_url.endswith("/Gone"):
            raise error(404)
        return json.dumps([{"article_body": {"html": f"<p>{request.full_url}</p>"}}] if not request.full_url.endswith("/Empty") else []).encode()

    c = clients.Articles("https://login", "https://a", "u", "p", opener, {"B": "Other name"})
    failed = c.land(["A", "B", "Gone", "Empty", "C"], str(tmp_path / "a.json"))
    landed = [json.loads(x) for x in open(tmp_path / "a.json")]
    assert [x["name"] for x in landed] == ["A", "B", "C"] and "Other_name" in landed[1]["html"] and set(failed) == {"Gone", "Empty"} and len(logins) == 2
    with pytest.raises(clients.Refused):
        clients.Articles("https://login", "https://a", "u", "p", lambda r: (_ for _ in ()).throw(error(403))).land(["A"], str(tmp_path / "b.json"))


def test_zipped_and_derived(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("g.txt", "USPS\tGEOID\tNAME\tINTPTLAT\tINTPTLONG \nNM\t35013\tDoña Ana County\t32.3\t -106.8\n".encode("latin-1"))
    assert [tuple(r) for r in readers.centroids(spark, f"file://{tmp_path}/g.zip").collect()] == [("35013", 32.3, -106.8)]
    (tmp_path / "s.csv").write_text("model,reference,v\na,,1.5\nb,size,2\n")
    got = readers.artifact(spark, f"file://{tmp_path}/s.csv", "model string, reference string, v double", ["reference"]).collect()
    assert [tuple(r) for r in got] == [("a", "", 1.5), ("b", "size", 2.0)]
    keys = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    places = spark.createDataFrame([("a", 5.0)], "k string, lat double")
    assert readers.panel(keys.where("k = 'a'"), [keys.withColumnRenamed("x", "z")], places, "k", ["lat"]).count() == 1
    with pytest.raises(ValueError, match="lat"):
        readers.panel(keys, [], places, "k", ["lat"])


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1.0, 2.0), ("c", -3.0, 4.0), ("d", None, 1.0)], "n string, x double, y double")
    assert reports.scatter(df, "x", "y", "t", "y").count("<circle") == 2
    drawn = reports.bars(df, "n", "x", "Sizes & more")
    assert "a&lt;b" in drawn and "Sizes &amp; more" in drawn
    cells = spark.createDataFrame([(1, 1, 4), (2, 3, 1)], "bx int, by int, n int")
    assert reports.density(cells, "bx", "by", "n", "d").count("fill=\"hsl") == 2
    with pytest.raises(ValueError):
        reports.rows_of(spark.range(11), ["id"], 10)
    book = json.loads(reports.notebook([("markdown", "# A\nb"), ("code", "1 + 1")]))
    assert [c["cell_type"] for c in book["cells"]] == ["markdown", "code"] and book["cells"][0]["source"] == ["# A\n", "b"]
    with pytest.raises(ValueError):
        reports.notebook([("raw", "")])
    reports.write(spark, "x", f"file://{tmp_path}/r/page.html")
    assert (tmp_path / "r/page.html").read_text() == "x"
