"""URLs with more frequent tokens than are mined at once lose no rule."""

import random
from dataclasses import replace

from plumbline.llm import urlrules
from plumbline.llm.urlrules import Settings

from llm.test_urlrules import RULES, pages, plain_rules


def wide(n, seed):
    """URLs with up to ``n`` query keys; what blocks them is told least by any single key."""
    rng = random.Random(seed)
    urls = []
    for i in range(300):
        keys = [f"k{j:02}" for j in range(n) if rng.random() < 0.8]
        blocked = ("k02" in keys) == ("k05" in keys)
        urls.append(f"http://a.net/{'es' if blocked else 'x'}/?" + "&".join(f"{k}=1" for k in keys))
    return urls + [f"http://www.example.com/en/?{u.partition('?')[2]}" for u in urls if "/x/" in u]


def check(spark, urls, settings):
    labelled = urlrules.split(pages(spark, urls), RULES).where("rule IS NOT NULL")
    expected = plain_rules([(r["tokens"], r["verdict"]) for r in labelled.collect()], replace(settings, width=1000))
    found = urlrules.mine(labelled, settings)
    assert [(r.tokens, r.verdict, round(r.support, 9)) for r in found] == [(r.tokens, r.verdict, round(r.support, 9)) for r in expected]
    return expected


def test_all_tokens_by_default(spark):
    assert check(spark, wide(13, 3), Settings(min_support=0.1, longest=3))


def test_groups_change_no_rule(spark):
    for at_once in (3, 5):
        check(spark, wide(8, 4), Settings(min_support=0.05, longest=3, at_once=at_once))
