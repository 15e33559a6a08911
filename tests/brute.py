"""Day-by-day evaluation of the monitor rules over small Python histories."""

import datetime as dt


def latest_before(days, as_of):
    return max((d for d in days if d <= as_of), default=None)


def feed_stalls(published, owners, as_of, th):
    """{feed: days silent} of the open single-feed stalls on one day."""
    silent = {}
    for feed in owners:
        last = latest_before(published.get(feed, ()), as_of)
        silent[feed] = None if last is None else (as_of - last).days
    alive = {owners[f] for f, s in silent.items() if s is not None and s < th.stall_days}
    return {
        f: s
        for f, s in silent.items()
        if s is not None and th.stall_days <= s <= th.lookback_days and owners[f] in alive
    }


def dataset_stalls(published, owners, as_of, th):
    open_ = {}
    for dataset in set(owners.values()):
        days = [d for f, o in owners.items() if o == dataset for d in published.get(f, ())]
        last = latest_before(days, as_of)
        if last is not None and th.stall_days <= (as_of - last).days <= th.lookback_days:
            open_[dataset] = (as_of - last).days
    return open_


def errors(statuses, as_of, th):
    """{feed: days failing}; statuses = {feed: {day: (status, code)}}."""
    open_ = {}
    for feed, days in statuses.items():
        status, code = days.get(as_of, (None, None))
        if status != "error" or (code or "").lower() in ("401", "403"):
            continue
        last = latest_before([d for d, (s, _) in days.items() if s == "complete"], as_of)
        if last is not None and th.error_days <= (as_of - last).days <= th.success_lookback_days:
            open_[feed] = (as_of - last).days
    return open_


def percent(drop, start):
    return 0.0 if start <= 0 else round(max(0, drop) * 100.0 / start, 2)


def decline(days, as_of, th):
    """None or (reason, start day, first, last, qualify, steepest percent); days = {day: (level, upd, del)}."""
    def levels(span):
        first = as_of - dt.timedelta(days=span - 1)
        return [(d, *days[d]) for d in sorted(days) if first <= d <= as_of]

    window = levels(th.window_days)
    if len(window) < th.min_observations or window[0][1] < th.min_future_opportunities:
        return None
    steps = [(a, b, percent(a[1] - b[1], a[1]) if b[1] < a[1] else None) for a, b in zip(window, window[1:])]
    monotonic = all(p is not None for _, _, p in steps)
    steepest = max((p or 0.0 for _, _, p in steps), default=0.0)
    sharp = steepest >= th.drop_percent
    qualify_start, latest = levels(th.qualify_days)[0][1], window[-1][1]
    delta = sum(w[2] for w in window) - sum(w[3] for w in window)
    if not (monotonic or sharp):
        return None
    if percent(qualify_start - latest, qualify_start) < th.qualify_drop_percent and delta >= 0:
        return None
    start = window[-1][0]
    for a, b, p in reversed(steps):
        if p is None:
            break
        start = a[0]
    if start == window[-1][0] and steepest > 0:
        start = next(a[0] for a, _, p in steps if p == steepest)
    reason = "both" if monotonic and sharp else "monotonic_decline" if monotonic else "sharp_drop"
    return reason, start, window[0][1], latest, qualify_start, steepest
