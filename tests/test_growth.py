import datetime as dt
import json
import random

import pytest

from tests.conftest import at, table
from tidewatch.plans import growth

D = dt.date


def crawl(date, *urls):
    return dict(ingestion_date=at(date), datasets=json.dumps(list(urls)))


def run(date, dataset, updated=1, future=1, status="COMPLETE", deleted=0):
    return dict(
        feed_id="f", dataset_id=dataset, ingestion_date=at(date), status=status,
        updated=updated, deleted=deleted, total_future_opportunities=future,
    )


def months(spark, crawls, runs, as_of, n=12):
    frame = growth.ecosystem_growth(
        table(spark, "feed_ingestion", crawls), table(spark, "opportunity_ingestion", runs), as_of, n
    )
    return {r.period_start: r for r in frame.collect()}


def listed(spark, no_names, crawls, runs, as_of, n=12):
    frame = growth.ecosystem_growth_datasets(
        table(spark, "feed_ingestion", crawls), table(spark, "opportunity_ingestion", runs),
        no_names[1], as_of, n,
    )
    out = {}
    for r in frame.collect():
        out.setdefault((r.period_start, r.figure), []).append(r.dataset_url)
    return out


def test_candidate_months():
    assert growth.candidate_months(D(2026, 9, 15), 2) == [D(2026, 7, 1), D(2026, 8, 1), D(2026, 9, 1)]
    assert growth.candidate_months(D(2026, 9, 30), 2) == [D(2026, 8, 1), D(2026, 9, 1)]
    assert growth.candidate_months(D(2026, 1, 31), 3) == [D(2025, 11, 1), D(2025, 12, 1), D(2026, 1, 1)]
    assert len(growth.candidate_months(D(2026, 9, 30), 500)) == 500
    with pytest.raises(ValueError, match="months"):
        growth.candidate_months(D(2026, 9, 30), 0)
    assert growth.month_end(D(2024, 2, 10)) == D(2024, 2, 29)
    assert growth.shift_month(D(2026, 1, 1), -13) == D(2024, 12, 1)


def test_figures_of_a_month(spark, no_names):
    crawls = [
        crawl(D(2026, 5, 2), "a", "b", "gone"),
        crawl(D(2026, 6, 2), "a", "b", "c", "listed-only", "", None, {"x": 1}),
        crawl(D(2026, 6, 3)),
    ]
    runs = [
        run(D(2026, 5, 3), "a"), run(D(2026, 5, 3), "unlisted"),
        run(D(2026, 6, 3), "a", updated=5, future=0), run(D(2026, 6, 4), "a", updated=0, future=3),
        run(D(2026, 6, 3), "b", updated=0, future=9),
        run(D(2026, 6, 3), "c", updated=None, future=None, status="ERROR"),
        run(D(2026, 6, 9), "unlisted", updated=0, deleted=1, future=0),
        run(D(2026, 6, 9), None), run(D(2026, 6, 10), ""),
    ]
    june = months(spark, crawls, runs, D(2026, 6, 30))[D(2026, 6, 1)]
    assert (june.period_end, june.in_progress) == (D(2026, 6, 30), False)
    assert (june.days_with_data, june.days_with_feed_data) == (2, 4)
    assert june.datasets_crawled == 5
    assert (june.datasets_added, june.datasets_removed) == (2, 1)
    assert (june.datasets_with_future, june.datasets_without_future) == (2, 2)
    assert (june.datasets_stopped, june.datasets_stopped_all_runs_failed) == (2, 1)
    assert june.datasets_not_ingested == 1
    assert june.datasets_with_future + june.datasets_without_future + june.datasets_not_ingested == 5
    lists = listed(spark, no_names, crawls, runs, D(2026, 6, 30))
    june = {figure: urls for (month, figure), urls in lists.items() if month == D(2026, 6, 1)}
    assert june == {
        "added": ["c", "listed-only"], "removed": ["gone"], "without_future": ["c", "unlisted"],
        "stopped": ["b", "c"], "stopped_all_runs_failed": ["c"], "not_ingested": ["listed-only"],
    }
    may = months(spark, crawls, runs, D(2026, 6, 30))[D(2026, 5, 1)]
    assert may.datasets_added is None and may.datasets_removed is None


def test_gaps_in_the_history(spark):
    crawls = [crawl(D(2026, 3, 1), "a"), crawl(D(2026, 5, 1), "a", "b")]
    runs = [run(D(2026, 5, 2), "a")]
    got = months(spark, crawls, runs, D(2026, 5, 31))
    assert sorted(got) == [D(2026, 3, 1), D(2026, 4, 1), D(2026, 5, 1)]
    april, may = got[D(2026, 4, 1)], got[D(2026, 5, 1)]
    assert (april.datasets_crawled, april.datasets_added, april.datasets_removed) == (0, 0, 1)
    assert may.datasets_added is None and may.datasets_removed is None
    # Listings without a feed run: the crawl figures stand, the publishing ones are unknown.
    march = got[D(2026, 3, 1)]
    assert march.datasets_crawled == 1 and march.datasets_with_future is None
    assert march.datasets_not_ingested is None and may.datasets_not_ingested == 1


@pytest.mark.parametrize("days, reported", [(4, False), (5, True)])
def test_the_running_month_needs_five_crawl_days(spark, days, reported):
    crawls = [crawl(D(2026, m, 1), "a") for m in (1, 2, 3, 4)]
    crawls += [crawl(D(2026, 5, n), "a") for n in range(1, days + 1)]
    got = months(spark, crawls, [], D(2026, 5, 20), 2)
    want = [D(2026, 4, 1), D(2026, 5, 1)] if reported else [D(2026, 3, 1), D(2026, 4, 1)]
    assert sorted(got) == want
    assert got[want[-1]].in_progress is reported
    # The months window starts one month early, so the first one has its baseline.
    assert got[want[0]].datasets_added == 0


def test_ten_years_are_reported_when_asked_for(spark):
    crawls = [crawl(D(2016, 6, 2), "a"), crawl(D(2026, 5, 2), "a")]
    got = months(spark, crawls, [], D(2026, 5, 31), 120)
    assert len(got) == 120 and min(got) == D(2016, 6, 1)
    # Months before the first one with data are not reported.
    assert len(months(spark, crawls[1:], [], D(2026, 5, 31), 120)) == 1


def test_rows_after_the_snapshot_are_not_read(spark):
    crawls = [crawl(D(2026, 4, 1), "a"), crawl(D(2026, 5, 10), "late")]
    assert sorted(months(spark, crawls, [], D(2026, 5, 5))) == [D(2026, 4, 1)]
    assert months(spark, [], [], D(2026, 5, 5)) == {}


def test_crawled_follows_from_the_month_before(spark):
    import random

    rng = random.Random(8)
    crawls = [
        crawl(D(2025, m, 3), *[f"d{n}" for n in range(30) if rng.random() < 0.7]) for m in range(1, 13)
    ]
    runs = [run(D(2025, m, 4), f"d{n}", future=rng.randrange(2)) for m in range(1, 13) for n in range(0, 30, 3)]
    got = [r for _, r in sorted(months(spark, crawls, runs, D(2025, 12, 31)).items())]
    assert len(got) == 12
    for before, now in zip(got, got[1:]):
        assert now.datasets_crawled == before.datasets_crawled - now.datasets_removed + now.datasets_added
        assert now.datasets_crawled == (
            now.datasets_with_future + now.datasets_without_future + now.datasets_not_ingested
        )


def test_ten_years_of_months_against_sets(spark, no_names):
    """Bitmaps of two words: every figure of 120 months equals that of plain sets."""
    rng, as_of, months = random.Random(9), dt.date(2026, 8, 31), 120
    starts = [growth.shift_month(dt.date(2026, 8, 1), -back) for back in range(months, -1, -1)]
    crawls, runs, sets = [], [], {m: {n: set() for n in ("listed", "ran", "changed", "future", "ok")} for m in starts}
    for m in starts:
        here = sets[m]
        here["listed"] = {f"d{n}" for n in range(15) if rng.random() < 0.5}
        crawls.append(dict(ingestion_date=at(m + dt.timedelta(days=rng.randrange(28))), datasets=json.dumps(sorted(here["listed"]))))
        for name in [f"d{n}" for n in range(15) if rng.random() < 0.5] + ["", None]:
            failed, changed, future = rng.random() < 0.5, rng.choice([0, 0, 4]), rng.choice([0, None, 7])
            runs.append(dict(ingestion_date=at(m + dt.timedelta(days=rng.randrange(28))), dataset_id=name, updated=changed,
                             status="ERROR" if failed else "COMPLETE", total_future_opportunities=future))
            if name:
                here["ran"].add(name)
                here["changed"] |= {name} if changed else set()
                here["future"] |= {name} if future else set()
                here["ok"] |= set() if failed else {name}
    tables = table(spark, "feed_ingestion", crawls), table(spark, "opportunity_ingestion", runs)
    got = growth.ecosystem_growth(*tables, as_of, months).collect()
    want, listed = [], set()
    for before, m in zip(starts, starts[1:]):
        x, now, then = sets[m], sets[m]["listed"] | sets[m]["ran"], sets[before]["listed"] | sets[before]["ran"]
        stopped = x["ran"] - x["changed"]
        figures = dict(added=now - then, removed=then - now, with_future=x["ran"] & x["future"], without_future=x["ran"] - x["future"],
                       stopped=stopped, stopped_all_runs_failed=stopped - x["ok"], not_ingested=now - x["ran"])
        want.append((m, len(now), *(len(figures[n]) for n in growth.FIGURES)))
        listed |= {(m, n, d) for n in growth.LISTED_FIGURES for d in figures[n]}
    assert [(r.period_start, r.datasets_crawled, *(r[f"datasets_{n}"] for n in growth.FIGURES)) for r in got] == want
    rows = growth.ecosystem_growth_datasets(*tables, no_names[1], as_of, months).collect()
    assert {(r.period_start, r.figure, r.dataset_url) for r in rows} == listed and len(rows) == len(listed)
    bitmaps = growth.dataset_bitmaps(*tables, starts[0], as_of)
    assert bitmaps.count() == 15 and len(bitmaps.first().crawled) == 2
