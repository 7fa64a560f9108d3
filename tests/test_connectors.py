import io
import urllib.error

import pytest

from weftline.sources import connectors
from weftline.sources.connectors import fetch, id_batches, records_of, wait_seconds


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def test_fetch_tries_again_only_where_it_helps():
    calls = []

    def opener(url, codes=iter([429, 503, 200])):
        calls.append(url)
        code = next(codes)
        if code != 200:
            raise urllib.error.HTTPError(url, code, "no", None, None)
        return Answer(b"[1]")

    assert fetch("u", base=0, opener=opener) == b"[1]" and len(calls) == 3

    def never(url):
        raise urllib.error.HTTPError(url, 404, "no", None, None)

    with pytest.raises(urllib.error.HTTPError):
        fetch("u", base=0, opener=never)


def test_waits_double_up_to_a_bound():
    assert [wait_seconds(k, 1, 60, lambda: 0.5) for k in (0, 1, 2, 10)] == [1, 2, 4, 60]
    assert wait_seconds(0, 1, 60, lambda: 0) == 0.75


def test_records_and_batches():
    assert records_of({"status": "ok", "data": {"x": [1, 2]}}, "data.x") == [1, 2]
    assert records_of({"data": None}, "data.x") == [] and records_of({"data": {"x": 5}}, "data.x") == [5]
    with pytest.raises(ValueError, match="quota"):
        records_of({"status": "error", "messages": "quota"}, "data")
    assert id_batches(list(range(5)), 2) == ["0,1", "2,3", "4"] and id_batches([]) == []


def test_paged_json_reads_each_url(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"id": 1, "name": "x", "more": {}}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('{"results": []}')
    connectors.register(spark)
    import json

    urls = json.dumps([f"file://{tmp_path}/{n}.json" for n in "ab"])
    df = spark.read.format("paged_json").schema("id long, name string").options(urls=urls, records="results").load()
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, None)]


def test_feed_is_read_by_ranges_and_goes_on(spark, tmp_path):
    connectors.register(spark)
    path = tmp_path / "feed.txt"
    lines = ["x" * (k % 37) + f" é{k}" for k in range(500)]
    path.write_text("\n".join(lines[:300]) + "\nhalf a li")

    def run():
        q = spark.readStream.format("frame_feed").options(url=f"file://{path}", rangeBytes="97").load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return [r.frame for r in spark.read.schema("number long, frame string").parquet(f"{tmp_path}/out").orderBy("number").collect()]

    assert run() == lines[:300]
    path.write_text("\n".join(lines) + "\n")
    assert run() == lines


def test_answers_are_kept_for_a_time():
    t, asked = [0.0], []
    cache = connectors.AnswerCache(10, 2, lambda: t[0])
    ask = lambda u: asked.append(u) or u.encode()
    assert [cache.get("a", ask), cache.get("a", ask), cache.get("b", ask)] == [b"a", b"a", b"b"] and asked == ["a", "b"]
    t[0] = 11
    cache.get("a", ask)
    cache.get("c", ask)
    assert asked == ["a", "b", "a", "c"] and set(cache.held) == {"a", "c"}
    assert connectors.newest_day(["f-20240102.csv", "f-20231231.csv", "g-20990101.csv", "f-x"], "f-") == "f-20240102.csv" and connectors.newest_day([]) is None
