"""URL rules against a plain version, both ways of looking them up, and held-out accuracy of the trees."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.llm import url_filter as U

SCHEMA = "page_id long, url string, host string, row string, label string, n long, probability string, f_length string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "own", f"r{i}", "x", i, "p", "f") for i, u in urls], SCHEMA)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def plain_rule(host, path, rules):
    best = None
    for verdict, rule in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


ODD = [
    (1, None), (2, ""), (3, "example.org/es/1"), (4, "http://EXAMPLE.org/es/x?y#z"), (5, "http://example.org/en/17"),
    (6, "http://example.org/en/27"), (7, "http://badexample.org/es/"), (8, "http://a.b.example.org/es/?q"), (9, "http://org"),
    (10, "http://org/"), (11, "https://x.com/fr/"), (12, "https://x.com/de/1#a/b"), (13, "x://y://z.com/de/"), (14, "http://x.net/de/"),
    (15, "http://ex.com?u=http://example.org/es/"), (None, "http://ex.org#/es/"), (15, "http://ex.com?u=http://example.org/es/"),
    (16, "http://" + "a." * 50_000 + "org/" + "x/" * 50_000), (17, "http://é.Ä.org/en/1\n2"), (18, "://com/de/"), (19, "http://com/de"),
]


@pytest.mark.parametrize("in_row", [128, 0])
def test_rules_as_a_plain_version_finds_them(spark, in_row):
    got = U.filter_urls(pages(spark, ODD), in_row=in_row, trees=2).collect()
    want = []
    for i, u in ODD:
        host, path = plain_parts(u)
        want.append((i, host, path, *(plain_rule(host, path, U.RULES) or (None, None))))
    key = lambda r: (str(r[0]), r[1], r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (g.page_id, g.host, g.path, g.rule) == (w[0], w[1], w[2], w[4])
        assert g.verdict in ("allow", "block") and (w[3] is None or g.verdict == w[3])


def test_many_rules_both_ways(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abc")
    rules = [(rng.choice(["allow", "block"]), ".".join(word() for _ in range(rng.randint(1, 3))) + "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3)))) for _ in range(60)]
    rules = list({r: (v, r) for v, r in rules}.values())
    urls = [(i, "http://" + ".".join(word() for _ in range(rng.randint(1, 4))) + "/" + "".join(rng.choice("ab/") for _ in range(4))) for i in range(300)]
    rows = U._rows(pages(spark, urls), "url", ("page_id",))
    a, b = (
        {(r.row.page_id): r.ruled for r in U.with_rules(rows, rules, n).select("row", "ruled").collect()} for n in (1000, 0)
    )
    assert a == b
    for i, u in urls:
        want = plain_rule(*plain_parts(u), rules)
        # Rules that both fit are suffixes or beginnings of one another, so equal lengths may differ in text.
        assert (a[i] is None) == (want is None) and (want is None or len(a[i].rule) == len(want[1]))


def test_trees_tell_unseen_hosts_apart(spark):
    rng = random.Random(5)
    name = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    good = lambda: f"https://{name(6)}.org/{rng.choice(['en', 'fr'])}/{name(8)}.html"
    bad = lambda: f"http://{name(4)}-{rng.randint(100, 9999)}-{name(5)}.{rng.choice(['biz', 'org'])}/x/{rng.randint(0, 9999999)}?a={rng.randint(0, 99)}&b={name(3)}&c=1"
    made = [(good(), 0) if i % 2 else (bad(), 1) for i in range(1200)]
    labelled = spark.createDataFrame(made[:800], "url string, label int")
    held = pages(spark, list(enumerate(u for u, _ in made[800:])))
    got = {r.page_id: r.verdict for r in U.filter_urls(held, rules=(), labelled=labelled, trees=8).collect()}
    right = sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(made[800:]))
    assert right >= 0.98 * 400


def test_rules_teach_the_trees(spark):
    """Blocked by rule in two domains, a segment is blocked in a third that no rule names; the allowed ones are not."""
    urls = [f"http://h{i % 40}.{d}/{s}/{i}" for i in range(120) for d in ("aa", "bb", "cc") for s in ("fine", "spam")]
    rules = [(v, f"{d}/{s}/") for d in ("aa", "bb") for v, s in (("allow", "fine"), ("block", "spam"))]
    got = U.filter_urls(pages(spark, list(enumerate(urls))), rules, trees=8).where("rule is null").collect()
    assert len(got) == 240 and all((r.verdict == "block") == r.path.startswith("/spam/") for r in got)


def test_without_rows_labels_or_rules(spark):
    none = pages(spark, ODD).limit(0)
    assert U.filter_urls(none).count() == 0 and U.allowed_pages(none).columns == none.columns
    got = U.filter_urls(pages(spark, ODD), rules=()).collect()
    assert len(got) == len(ODD) and {r.verdict for r in got} == {"allow"} and {r.rule for r in got} == {None}


def test_allowed_pages_keep_their_own_columns(spark):
    whole = pages(spark, ODD)
    kept = U.allowed_pages(whole, trees=2)
    assert kept.columns == whole.columns
    assert {(r.host, r.label) for r in kept.collect()} == {("own", "x")}
    told = {r.page_id for r in U.filter_urls(whole, trees=2).where("verdict = 'allow'").collect()}
    assert {r.page_id for r in kept.collect()} == told


def test_large_tables_of_values_are_looked_up_without_broadcast(spark):
    rows = U._rows(pages(spark, ODD), "url", ("page_id",)).withColumn("label", F.lit(1))
    model = U.fit_urls(rows, seen=1)
    slow = U.UrlModel(model.counts, False, model.prior, None)
    a, b = (sorted(map(str, U.with_features(rows, m).select("row", *U.FEATURES).collect())) for m in (model, slow))
    assert a == b
