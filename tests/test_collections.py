"""Large collections cut by byte ranges against a JSON parser."""

import json
import random

import pytest

from temblor.sources import collections, geojson


def made(seed, count):
    random.seed(seed)
    odd = ['plain', 'br{ace', ']', 'quo"te', 'back\\', '\\"', 'é字', '', '\n', '[{', '}],', '\\\\']
    return [{"type": "Feature", "id": f"ev{k}", "properties": {"mag": k / 10, "place": "".join(random.choices(odd, k=3)),
             "products": [{"a": [1, {"b": "x"}]}]}, "geometry": {"type": "Point", "coordinates": [1.5, -2.5, k]}}
            for k in range(count)]


def texts(seed, count):
    rows = made(seed, count)
    yield rows, json.dumps({"type": "FeatureCollection", "metadata": {"title": 'a "list" [{', "n": {"x": 1}},
                            "features": rows, "bbox": [1, 2]}, ensure_ascii=False)
    yield rows, json.dumps(rows, indent=3)
    yield rows, json.dumps({"features": rows, "type": "FeatureCollection"}, separators=(",", ":"))


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 10**6])
def test_ranges_of_any_size_give_each_feature_once(step):
    for rows, text in texts(step, 12):
        data, found = text.encode(), []
        state, depth = collections.OUT, 0
        for begin in range(0, len(data), step):
            end = min(len(data), begin + step)
            found += collections.features_in(lambda a, b: data[a:b], begin, end, len(data), state, depth)
            state, deeper = collections.advance(data[begin:end], state)
            depth += deeper
        assert (state, depth) == (collections.OUT, 0)
        assert [json.loads(x) for x in found] == rows


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    rows, text = next(iter(texts(5, 400)))
    (tmp_path / "2001").mkdir()
    (tmp_path / "2001" / "large.json").write_text(text)
    (tmp_path / "2001" / "small.json").write_text(json.dumps(rows[0] | {"id": "single"}))
    (tmp_path / "2001" / "broken.json").write_text(text.replace('"mag": 1.0,', '"mag": 1.0,,')[:-400])
    docs = geojson.read_documents(spark, str(tmp_path), large=2000, range_bytes=1024)
    assert docs.rdd.getNumPartitions() > 50
    parsed = geojson.parse_documents(docs, keep=["path"]).collect()
    by_file = {}
    for r in parsed:
        by_file.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert sorted(r["id"] for r in by_file["large.json"]) == sorted(r["id"] for r in rows)
    assert all(r["supported"] for r in by_file["large.json"])
    assert {r["id"]: r["place"] for r in by_file["large.json"]} == {r["id"]: r["properties"]["place"] for r in rows}
    assert [r["id"] for r in by_file["small.json"]] == ["single"]
    lost = [r for r in by_file["broken.json"] if not r["supported"]]
    assert len(lost) == 2  # the one with two commas, and the one that is cut off
    assert len(by_file["broken.json"]) >= 396


def test_short_ranges_read_little_and_share_tasks():
    rows, text = next(iter(texts(3, 3000)))
    data, seen, found = text.encode(), [], []

    def read(a, b):
        seen.append(b - a)
        return data[a:b]

    state, depth, step = collections.OUT, 0, 8192
    for begin in range(0, len(data), step):
        end = min(len(data), begin + step)
        found += collections.features_in(read, begin, end, len(data), state, depth)
        state, deeper = collections.advance(data[begin:end], state)
        depth += deeper
    assert [json.loads(x) for x in found] == rows
    assert sum(seen) < 4 * len(data)  # was the first megabyte and the one before, for each range
    assert collections._tasks(150, 10 ** 6) == 150 and collections._tasks(300_000, 300_000 << 13) == 300
    assert collections._first_mark(lambda a, b: (b" " * 5000 + b"[1]")[a:b], 5003) == b"["
    assert collections._last_mark(lambda a, b: (b"," + b"\n" * 5000)[a:b], 5001) == b","
