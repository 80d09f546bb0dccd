"""New-or-changed selection, commit windows, atomic runs."""

from datetime import datetime, timedelta
from itertools import product

import pytest

from pagemill.operators import incremental as I  # noqa: E741

T0 = datetime(2025, 1, 1)
H = timedelta(hours=1)
SCHEMA = "page_id bigint, url string, status string, started timestamp_ntz, stored_at timestamp_ntz, response_changed boolean, entity_tag string, last_modified timestamp_ntz, extra string"
RUNS = "proc_id bigint, started timestamp_ntz, finished timestamp_ntz, proc_state string"


def brute(pages, runs):
    best = {}
    for r in pages:
        if r[2] == "Success" and r[0] is not None and r[4] is not None and (r[0] not in best or r[4] < best[r[0]][4]):
            best[r[0]] = r
    rows = sorted(best.values(), key=lambda r: (r[3], r[0]))
    last, out = {}, set()
    tag = lambda t: None if t is None or not t.strip() else t.strip().removeprefix("W/")
    ok = sorted((r[1], r[0]) for r in runs if r[3] == "succeeded" and r[1] is not None)
    for r in rows:
        p = last.get(r[1]) if r[1] is not None else None
        last[r[1]] = r
        if p is None:
            hit = True
        elif r[5] is not None:
            hit = r[5]
        elif tag(r[6]) and tag(p[6]):
            hit = tag(r[6]) != tag(p[6])
        elif r[7] and p[7]:
            hit = r[7] != p[7]
        else:
            hit = True
        if hit:
            run = next((i for s, i in ok if s > r[4]), None)
            if run is not None:
                out.add((run, r[0]))
    return out


def test_matches_brute_force_over_months_ties_and_repeats(spark):
    pages = []
    for n, (tag, changed, mod) in enumerate(product((None, '"a"', 'W/"a"', '"b"', ""), (None, True, False), (None, T0, T0 + H))):
        pages.append((n, f"u{n % 3}", "Success", T0 + 200 * H * (n // 2), T0 + 200 * H * (n // 2) + H, changed, tag, mod, "x"))
    pages += [(*pages[3][:4], pages[3][4] + 9 * H, *pages[3][5:]), pages[7], pages[7]]
    pages += [(900, "u0", "Failed", T0, T0, None, None, None, None), (901, None, "Success", T0, T0, None, None, None, None), (902, None, "Success", T0, T0, None, None, None, None), (None, "u9", "Success", T0, T0, None, None, None, None), (903, "u9", "Success", T0, None, None, None, None, None)]
    runs = [(i, T0 + 331 * H * i, None, s) for i, s in enumerate(("failed", "succeeded", "aborted", "succeeded", "succeeded", "running", "succeeded"))] + [(50, T0 + 331 * H * 3, None, "succeeded"), (51, None, None, "succeeded")]
    got = I.run_assignment(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(runs, RUNS))
    assert {tuple(r) for r in got.collect()} == brute(pages, runs)
    assert got.count() == len({r[1] for r in brute(pages, runs)})


def test_empty_tables(spark):
    assert I.run_assignment(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], RUNS)).count() == 0
    one = spark.createDataFrame([(1, "u", "Success", T0, T0, None, None, None, None)], SCHEMA)
    assert I.run_assignment(one, spark.createDataFrame([], RUNS)).count() == 0
    assert I.run_assignment(one, spark.createDataFrame([(1, T0, None, "succeeded")], RUNS)).count() == 0


def test_attempt_by_attempt_and_all_at_once(spark, tmp_path):
    pages = [(n, f"u{n % 5}", "Success", T0 + H * (n * 7 % 50), T0 + H * (n * 11 % 90), None, None, None, None) for n in range(80)]
    runs = [(i, T0 + 12 * H * i, None, "failed" if i % 3 == 1 else "succeeded") for i in range(7)]
    P, R = spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(runs, RUNS)
    once, step = I.IncrementalJob(spark, str(tmp_path / "once")), I.IncrementalJob(spark, str(tmp_path / "step"))
    I.catch_up(once, P, R)
    for i in range(1, 8):
        I.catch_up(step, P, R.where(f"proc_id < {i}"))
    assert len(step.manifests()) == 5 and I.catch_up(step, P, R) is None
    want = brute(pages, runs)
    assert {tuple(r) for r in once.read().collect()} == want == {tuple(r) for r in step.read().collect()} and once.read().count() == step.read().count() == len(want)
    assert I.catch_up(I.IncrementalJob(spark, str(tmp_path / "none")), P, R.limit(0)) is None


def test_one_number_is_published_once(spark, tmp_path):
    src = spark.createDataFrame([(i, i) for i in range(60)], "id int, seq int")
    a, b = I.IncrementalJob(spark, str(tmp_path / "t")), I.IncrementalJob(spark, str(tmp_path / "t"))
    a.run(src, "seq", 1, lambda d: d)

    def overtaken(d):
        b.run(src, "seq", 3, lambda x: x)
        return d

    with pytest.raises(RuntimeError):
        a.run(src, "seq", 2, overtaken)
    assert a.watermark() == "3"
    for k in range(4, 26):
        a._publish({"n": k - 2, "low": str(k - 1), "upper": str(k), "folder": a.manifests()[0]["folder"]}, {"before": a.manifests()} if (k - 2) % a.COMPACT == 0 else {})
    assert [m["n"] for m in a.manifests()] == list(range(24)) and a.watermark() == "25"
    a.run(src, "seq", 60, lambda d: d)
    assert a.manifests()[-1]["low"] == "25"


def test_job_publishes_output_and_watermark_together(spark, tmp_path):
    src = spark.createDataFrame([(i, i % 10) for i in range(40)], "id int, seq int")
    job = I.IncrementalJob(spark, str(tmp_path / "t"))
    assert job.read() is None
    job.run(src, "seq", 4, lambda d: d)

    def broken(d):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        job.run(src, "seq", 8, broken)
    assert job.watermark() == "4"
    job.run(src, "seq", 9, lambda d: d)
    got = [r["id"] for r in job.read().collect()]
    assert sorted(got) == sorted(i for i in range(40) if i % 10 < 9)
