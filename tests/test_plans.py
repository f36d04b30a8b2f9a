"""Jobs end to end, and that a second run reads finished stages."""

import json

from temblor.operators.sequences import sequence_stats
from temblor.plans import jobs
from temblor.sources.catalog import raw_catalog
from temblor.sources.geojson import to_document
from temblor.sources.store import StageStore


def test_clean_job_from_files(spark, sf, tmp_path):
    rows = raw_catalog(spark, sf).limit(40)
    for i, text in enumerate(r[0] for r in rows.select(to_document(rows)).collect()):
        folder = tmp_path / "docs" / str(2000 + i % 3)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"event_1_{i}.json").write_text(json.dumps(json.loads(text), indent=1))
    done = jobs.clean_job(spark, str(tmp_path / "docs"), str(tmp_path / "out"))
    assert done.count() == rows.where("type = 'earthquake'").count()
    assert done.where("gap is null or nst is null").count() == 0
    assert jobs.clean_job(spark, str(tmp_path / "docs"), str(tmp_path / "out")).count() == done.count()
    assert StageStore(spark, str(tmp_path / "out")).latest()["version"] == 2
    assert sequence_stats(done).select("seq").distinct().count() == done.count()


def test_exploration_job(spark, sf, tmp_path):
    tables = jobs.exploration_job(spark, raw_catalog(spark, sf), str(tmp_path))
    total = tables["overview"].first()["analysis_rows"]
    assert sum(r["event_count"] for r in tables["regions"].collect()) == total
    assert sum(r["event_count"] for r in tables["yearly"].collect()) == total
    assert tables["numeric_summary"].count() == 7


def test_two_runs_at_once_get_two_versions(spark, tmp_path):
    from threading import Barrier, Thread

    together, failed = Barrier(2), []

    def run(name):
        def make():
            return spark.range(3)
        stages = StageStore(spark, str(tmp_path))
        latest = stages.latest
        stages.latest = lambda step=None: (latest(step), together.wait(60))[0]  # both look before either writes
        try:
            stages.run(name, make)
        except Exception as error:
            failed.append(error)

    threads = [Thread(target=run, args=(name,)) for name in ("left", "right")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = StageStore(spark, str(tmp_path)).stages().collect()
    assert not failed and sorted(r["version"] for r in rows) == [1, 2]
    assert {r["step"] for r in rows} == {"left", "right"} and len({r["path"] for r in rows}) == 2
