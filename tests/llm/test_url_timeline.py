from graphloom.llm import url_timeline as u

CAPTURES = [(1, "http://a.example.com/x", 5, "z"), (2, "https://user:p@A.example.com.:80/y", 10, "z"), (3, "http://b.example.com", 10, "z"), (4, "http://other.org?q", 10, "z"), (5, "no url", 10, "z"), (6, None, 10, "z"), (7, "http://a.example.com", None, "z"), (8, "http://b.example.com/", 30, "z"), (8, "http://b.example.com/", 30, "z"), (9, "http://xexample.com", 10, "z")]
ENTRIES = [("example.com", "block", 8), ("example.com", "clear", 20), ("A.example.com", "clear", 9), ("a.example.com", "block", 12), ("org", "block", 10), ("org", "clear", 10), (None, "block", 1), ("other.org", None, None), ("b.example.com", "block", 31)]


def plain(captures, entries):
    out = []
    for page, url, at, _ in captures:
        host = u_host(url)
        best = None
        if host and at is not None:
            parts = host.split(".")
            for i in range(len(parts)):
                p = ".".join(parts[i:])
                days = {}
                for q, action, day in entries:
                    if q is not None and day is not None and q.lower() == p and day <= at:
                        days.setdefault(day, []).append(action)
                if days:
                    best = (p, min(days[max(days)]) == "block")
                    break
        out.append((page, bool(best and best[1]), best and best[0]))
    return sorted(out, key=str)


def u_host(url):
    import re

    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    return m and m[1].lower().rstrip(".") or None


def test_as_of_join(spark):
    c = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at long, since string")
    e = spark.createDataFrame(ENTRIES, "pattern string, action string, listed_at long")
    got = u.judge(c, e)
    assert got.columns == ["page_id", "url", "fetched_at", "since", "host", "blocked", "decided_by"]
    assert sorted(((r.page_id, r.blocked, r.decided_by) for r in got.collect()), key=str) == plain(CAPTURES, ENTRIES)
    assert u.judge(c.limit(0), e).count() == 0
    assert u.judge(c, e.limit(0)).where("blocked").count() == 0


def test_clashing_columns_and_large_lists(spark, monkeypatch):
    rows = [(*r, "mine", 7, "d") for r in CAPTURES] + [(10, "http://" + "a." * 40 + "b.example.com/" + "x" * 100_000, 40, "z", "mine", 7, "d")]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched_at long, pattern string, Host string, blocked int, _h string")
    e = spark.createDataFrame(ENTRIES, "pattern string, action string, listed_at long")
    want = plain([r[:4] for r in rows], ENTRIES)
    got = u.judge(c, e)
    assert got.columns == ["page_id", "url", "fetched_at", "pattern", "input_Host", "input_blocked", "_h", "host", "blocked", "decided_by"]
    assert sorted(((r.page_id, r.blocked, r.decided_by) for r in got.collect()), key=str) == want
    assert {(r.input_Host, r.input_blocked, r._h) for r in got.collect()} == {("mine", 7, "d")}
    spans, shuffled = u.intervals(e), u.as_of
    monkeypatch.setattr(u, "as_of", lambda looked, spans: shuffled(looked, spans, 0, 1))
    assert sorted(((r.page_id, r.blocked, r.decided_by) for r in u.judge(c, e).collect()), key=str) == want
    assert spans.count() == 6
