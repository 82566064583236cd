"""The measures of op2 against plain counts of contexts, on more contexts than 2**18; its verdicts on hosts it never saw."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracewright.llm.url_filter import ORDER, SEED_WORDS, junk_page, listed_host, url_filter


def test_measures(spark):
    rng = random.Random(3)
    rows = [(k, f"http://{'casino.' if k % 3 == 0 else ''}h{k % 7}.org/", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60))) for k in range(8_000)]
    pages = spark.createDataFrame([(k, a + b) for k, a, b in rows], "page_id long, url string")
    texts = {k: "\0" * ORDER + (a + b)[7:] + "\1" for k, a, b in rows}
    count, after = {}, {}
    for bad in (False, True):
        c, f = Counter(), defaultdict(set)
        for k, t in texts.items():
            if (k % 3 == 0) == bad:
                for i in range(ORDER, len(t)):
                    for n in range(ORDER + 1):
                        c[t[i - n : i + 1]] += 1
                        c["context", t[i - n : i]] += 1
                        f[t[i - n : i]].add(t[i])
        count[bad], after[bad] = c, f
    assert len({x for c in count.values() for x in c if len(x) == ORDER + 1}) > 1 << 18

    def gain(t, i, bad):
        p = 1 / 256
        for n in range(ORDER + 1):
            total, kinds = count[bad]["context", t[i - n : i]], len(after[bad].get(t[i - n : i], ()))
            p = (count[bad][t[i - n : i + 1]] + kinds * p) / (total + kinds) if total else p
        return math.log(p)

    some = range(0, 8_000, 40)
    got = {r.page_id: r.measure for r in url_filter(pages).where(F.col("page_id") % 40 == 0).collect()}
    assert sorted(got) == list(some)
    for k in some:
        t = texts[k]
        want = sum(gain(t, i, False) - gain(t, i, True) for i in range(ORDER, len(t))) / (len(t) - ORDER)
        assert abs(got[k] - want) < 1e-9


def test_verdicts_on_unseen_hosts(spark):
    """Hosts of a style are blocked though they are not labelled; the share of accepted ones that is blocked is as stated."""
    rng = random.Random(4)
    word = lambda *parts: "".join(rng.choice(p) for p in parts)
    good = [f"http://{word('blmnst', 'aeiou', 'lnrst', 'aeiou', 'klmn')}{k}.org/{word('abc', 'def')}" for k in range(4000)]
    bad = [f"http://{word('wxz', 'qx')}-win{k}.biz/{word('abc', 'def')}" for k in range(900)]
    rows = [(k, u, False) for k, u in enumerate(good)] + [(10_000 + k, u, True if k < 600 else None) for k, u in enumerate(bad)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, mark boolean"), rejected=F.col("mark"), blocked=0.08).collect()
    verdict = {r.page_id: r.verdict for r in got}
    assert sum(verdict[k] == "block" for k in range(4000)) <= 0.05 * 4000
    assert sum(verdict[10_600 + k] == "block" for k in range(300)) >= 0.95 * 300


def test_one_word_left_out(spark):
    """Each listed word in turn is left out of training: its hosts are judged by what the others have taught."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = {w for r in pages.where(listed_host(F.col("url"))).select("url").distinct().collect() for w in SEED_WORDS if f"{w}-" in r.url or f"-{w}" in r.url}
    caught = total = 0
    for w in sorted(found)[:3]:
        mine = F.col("url").rlike(rf"[./-]{w}[.-]")
        got = url_filter(pages, rejected=F.when(~mine, listed_host(F.col("url"))))
        rows = got.join(pages.where(mine).select("page_id"), "page_id").select("verdict").collect()
        caught, total = caught + sum(r.verdict == "block" for r in rows), total + len(rows)
    print("left out and blocked", caught, "of", total)
    assert caught >= 0.5 * total > 0


def test_junk_pages(spark):
    rows = [(1, "<p>plain words of a page, with marks. Here - and there!</p>"), (2, "<p>wo%%% rds*** of### ju$$$ nk</p>"), (3, None), (4, ""), (5, "<p>one&amp;&amp;&amp; two</p><script>a===b&&&c|||d</script>"), (6, "<style>***</style><p>fine</p>")]
    got = spark.createDataFrame(rows, "id long, html string").select("id", junk_page(F.col("html")).alias("x")).collect()
    assert {r.id for r in got if r.x} == {2, 5}


def test_odd_pages(spark):
    """No labels, repeated and null ids, no URL rejected, all rejected, an empty table, clashing names."""
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://b.org/"), (None, None), (5, ""), (6, "://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as gram", "false as held")
    for label in (F.lit(None).cast("boolean"), F.lit(False), F.lit(True), F.col("url").contains("b.org")):
        got = url_filter(pages, rejected=label).collect()
        assert len(got) == len(rows) and {r.verdict for r in got if r.host == ""} == {"allow"}
    assert url_filter(pages.where("false")).count() == 0
