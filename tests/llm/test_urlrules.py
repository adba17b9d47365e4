import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.llm import urlrules
from plumbline.llm.urlrules import Mined, Rule, Settings

RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]


def pages(spark, urls):
    return spark.createDataFrame(
        [(i, u, "html", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string"
    )


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    end = min(ends, default=len(rest))
    after = rest[end:]
    stop = min([after.index(c) for c in "?#" if c in after], default=len(after))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), after[:stop]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    "http://Example.COM/en/1", "https://www.example.com/en/", "https://a.www.example.com/en/x?y=/z#w", "http://myexample.com/en/2",
    "http://com/", "http://com", "http://x.net/es/5", "http://net/fr/", "http://net.fr/fr/", "ftp://a.net/es", "http://a.net/esx",
    None, "", "no scheme", "://only", "http://", "http://h?q://x/y", "http://h#/es/", "a://b://c.net/es/", "http://ÉÀ.Net/fr/É?x",
    "http://example.com/EN/1", "http://x\ny.com/en/", "http://" + "long." * 3000 + "com/" + "p/" * 3000,
]


def test_parts_and_given_rules(spark):
    found = {r["page_id"]: r for r in urlrules.split(pages(spark, URLS), RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        assert (found[i]["host"], found[i]["path"]) == (host, path), url
        assert (found[i]["rule"], found[i]["verdict"]) == ((rule.name, rule.verdict) if rule else (None, None)), url


def test_tokens(spark):
    row = pages(spark, ["HTTPS://A.example.org/En/12/a3b.HTML?x=1&y=2&x=3#f"]).select(urlrules.tokens(F.col("url"))).first()[0]
    assert sorted(row) == sorted(
        ["scheme:https", "host:a", "host:example", "host:org", "path:en", "path:#", "path:a#b.html", "type:html", "query:x", "query:y", "fragment"]
    )


def plain_rules(labelled, settings):
    """All rules by counting every subset of every URL."""
    total, blocked = len(labelled), sum(v == "block" for _, v in labelled)
    n, bad = Counter(), Counter()
    for own, verdict in labelled:
        n.update(own)
        if verdict == "block":
            bad.update(own)
    known = [t for t in n if settings.min_support * total <= n[t] < total]
    known.sort(key=lambda t: (-abs(bad[t] / n[t] - blocked / total), t))
    place = {t: i for i, t in enumerate(known)}
    sets, judged = Counter(), Counter()
    for own, verdict in labelled:
        kept = sorted((t for t in own if t in place), key=place.__getitem__)[: settings.width]
        for size in range(1, settings.longest + 1):
            for part in combinations(sorted(kept), size):
                sets[part] += 1
                judged[part, verdict] += 1
    least = math.ceil(settings.min_support * total)
    rules = [
        Mined(tuple(sorted(part, key=lambda t: (n[t], t))), verdict, count / sets[part], count / total)
        for (part, verdict), count in judged.items()
        if count >= least and count / sets[part] >= settings.min_confidence
    ]
    kept = []
    for rule in rules:
        parts = [set(r.tokens) for r in rules if r.verdict == rule.verdict and r.confidence >= rule.confidence]
        if not any(p < set(rule.tokens) for p in parts):
            kept.append(rule)
    return sorted(kept, key=lambda r: (-r.confidence, -r.support, len(r.tokens), r.tokens, r.verdict))


@pytest.fixture
def urls():
    rng = random.Random(2)

    def one():
        return (
            f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['a', 'b', 'spam'])}.example."
            f"{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'fr', 'es', 'de'])}/{rng.randint(1, 99)}{rng.choice(['', '.html', '?ref=1', '#top'])}"
        )

    return [one() for _ in range(600)] + ["http://hot.example.net/es/1"] * 300 + [None, "x"]


@pytest.mark.parametrize("settings", [Settings(min_support=0.02), Settings(0.05, 0.6, 4, 3)])
def test_against_every_subset(spark, urls, settings):
    split = urlrules.split(pages(spark, urls), RULES)
    labelled = [(r["tokens"], r["verdict"]) for r in split.where("rule IS NOT NULL").collect()]
    expected = plain_rules(labelled, settings)
    found = urlrules.mine(split.where("rule IS NOT NULL"), settings)
    assert [(r.tokens, r.verdict) for r in found] == [(r.tokens, r.verdict) for r in expected]
    assert expected

    rows = {r["page_id"]: r for r in urlrules.judge(pages(spark, urls), RULES, settings).collect()}
    every = {r["page_id"]: r for r in split.collect()}
    assert len(rows) == len(urls)
    for i, row in rows.items():
        own = set(every[i]["tokens"])
        fits = next((r for r in expected if set(r.tokens) <= own), None)
        assert row["verdict"] == (every[i]["verdict"] or (fits.verdict if fits else "allow"))
        assert row["pattern"] == (None if every[i]["rule"] or not fits else " ".join(fits.tokens))
    assert any(r["pattern"] and r["verdict"] == "block" for r in rows.values())


def test_without_labels_or_rows(spark, rows):
    found = urlrules.judge(pages(spark, ["http://a.org/x", None]), RULES)
    assert rows(found, "verdict", "rule", "host") == [("allow", None, ""), ("allow", None, "a.org")]
    assert rows(urlrules.judge(pages(spark, URLS).limit(0), RULES)) == []
    same = urlrules.judge(pages(spark, ["http://a.com/x"] * 3), RULES)
    assert {r["verdict"] for r in same.collect()} == {"allow"}
