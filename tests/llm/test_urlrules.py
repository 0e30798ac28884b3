"""Mined URL rules: none is lost to supersets of better ones, and a long list judges as a short one does."""

from __future__ import annotations

from measurelake.llm import urlrules

SCHEMA = "page_id long, url string"


def test_supersets_do_not_crowd_out_weaker_rules(spark) -> None:
    urls, bad = [], []
    for h in range(40):  # 60 combinations each have share 1
        urls += [f"http://a.b.bad{h}.org/x{h}/y{h}" for _ in range(20)]
        bad += [1] * 20
    urls += ["http://weak.org/"] * 40
    bad += [1] * 28 + [0] * 12
    urls += [f"http://good{k % 50}.org/" for k in range(3000)]
    bad += [0] * 3000
    pages = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    mined = urlrules.mine(pages, labels)
    rules = {r: (share, n) for r, share, n in mined}
    assert rules[frozenset({"host=weak.org"})] == (0.7, 40)
    assert not any(a < b for a in rules for b in rules)
    assert all(rules[frozenset({f"host=bad{h}.org"})] == (1.0, 20) for h in range(40))
    got = {r.page_id: r.verdict for r in urlrules.judge(pages, mined, []).collect()}
    assert [got[i] for i in range(len(urls))] == ["block" if i < 840 else "allow" for i in range(len(urls))]


def test_long_list_is_joined(spark, monkeypatch) -> None:
    urls = [f"http://w.h{k % 700}.org/f{k % 11}/?q={k % 3}" for k in range(2000)] + [None, "", "none"]
    mined = [(frozenset({f"host=h{k}.org", f"folder=f{j}"}), 1.0, 20) for k in range(0, 600, 2) for j in "0"] + [(frozenset({f"host=h{k}.org"}), 0.6, 20) for k in range(0, 600, 3)]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0])], SCHEMA)
    short = sorted(urlrules.judge(pages, mined, [("allow", "h3.org/")]).collect())
    monkeypatch.setattr(urlrules, "RULES", 100)
    long = sorted(urlrules.judge(pages, mined, [("allow", "h3.org/")]).collect())
    assert long == short and len(long) == len(urls) + 1
    assert {r.verdict for r in long} == {"allow", "block"}
