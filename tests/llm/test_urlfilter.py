import math
import re
from collections import Counter

import pytest

from docpairs.llm import urlfilter as U


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host):])[0]


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def best_split(label, counts, total):
    """The most probable split, over all of them."""
    def cost(p):
        return math.log(counts[p] / total) if counts.get(p) else -math.log(total) - 2.3 * len(p)

    def splits(s):
        if not s:
            yield []
        for i in range(1, min(len(s), U.MAX_WORD) + 1):
            for rest in splits(s[i:]):
                yield [s[:i], *rest]
    return max(splits(label), key=lambda w: sum(map(cost, w)))


def brute(rows):
    """(rule, verdict) of each row by definition, with the operator's own Viterbi."""
    counts = Counter()
    for _, _, html in rows:
        counts.update(w for w in re.split(r"[\W_]+", re.sub(r"<[^>]*>", " ", lower(html))) if 0 < len(w) <= U.MAX_WORD)
    total, tokens, rules = sum(counts.values()) or 1, [], []
    for _, url, _ in rows:
        host, path = parts(url)
        ws = [w for x in re.split(r"[\W_]+", host) if x for w in U.viterbi(x, counts, total)]
        tokens.append(["h:" + w for w in ws] + ["p:" + w for w in re.split(r"[\W_]+", lower(path)) if w])
        rules.append(rule_of(host, path))
    seen = {"allow": Counter(), "block": Counter()}
    for t, r in zip(tokens, rules):
        if r:
            seen[r[0]].update(t)
    a, b = seen["allow"], seen["block"]
    v = len(a | b)
    n = Counter(r[0] for r in rules if r)
    out = []
    for t, r in zip(tokens, rules):
        score = math.log((n["allow"] + 1) / (n["block"] + 1))
        for w in t:
            score += math.log((a[w] + 1) / (b[w] + 1)) + math.log((b.total() + v + 1) / (a.total() + v + 1))
        out.append((r[1] + r[2] if r else None, r[0] if r else "allow" if score >= 0 else "block"))
    return out


URLS = ["http://a.EXAMPLE.net/en/1", "http://example.net/de/1", "https://x.example.com/de/7?q=1", "https://x.example.com/en/7#t",
        "http://b.org/fr/", "http://b.org/fr", "http://notexample.com/de/1", "http://net/x", "http://net", "mailto:x@y", None, "", "://",
        "a://b://c/d", "http://cheapthreat.example.com/en/x", "http://goodnews.example.com/en/x", "http://h.io:80/p?x=1/2#3", "HTTP://É.Org/FR/x",
        "http://x.org?u=/fr/", "http://www.cheap-pills.example.com/en/1", "http://" + "q" * 70 + ".com/"]


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x", 1.0) for i, u, h in rows], "page_id long, url string, html string, host string, score double")
    return make


def test_verdicts_against_brute_force(pages):
    html = ["<p>cheap threat news good</p>", None, "", "<a href='x'>good news</a> pills the the"]
    rows = [(i, u, html[i % 4]) for i, u in enumerate(URLS * 3, 1)]
    got = {r.page_id: r for r in U.judge(pages(rows)).collect()}
    for (i, url, _), (rule, verdict) in zip(rows, brute(rows)):
        r = got[i]
        assert (r.host, r.path) == parts(url), url
        assert (r.rule, r.verdict) == (rule, verdict), url


def test_query_against_brute_force(spark, sf):
    from docpairs.llm import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.rule, r.verdict) for r in queries.queries()["op9_url_filter"](spark, sf).collect()}
    assert got == {i: rv for (i, _, _), rv in zip(rows, brute(rows))}
    assert {v for _, v in got.values()} == {"allow", "block"}


@pytest.mark.parametrize("label", ["goodnews", "thethe", "xq", "newsgoodx", "a", "therapistnews"])
def test_viterbi_finds_the_best_split(label):
    counts = {"good": 50, "news": 40, "the": 100, "new": 5, "s": 3, "therapist": 4, "rapist": 1, "pi": 2, "a": 9}
    assert U.viterbi(label, counts, 214) == best_split(label, counts, 214)


def test_frequent_and_rare_keys_join_alike(spark):
    rows = spark.range(3000).selectExpr("id AS row", "if(id % 3 = 0, 'hot', concat('k', id)) AS token")
    table = rows.groupBy("token").count().withColumnRenamed("count", "n").withColumn("weight", U.F.length("token") * 1.0)
    got = U._hot_join(rows, table, "token", 3000)
    assert got.count() == 3000 and got.where("weight IS NULL").count() == 0


def test_nulls_repeated_rows_and_empty_table(pages):
    rows = [(None, None, None), (1, "http://x.org/fr/a", ""), (1, "http://x.org/fr/a", "")]
    got = [tuple(r) for r in U.judge(pages(rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, "", "", None, "allow")] + 2 * [(1, "x.org", "/fr/a", "org/fr/", "allow")], key=str)
    assert U.judge(pages(rows).limit(0)).count() == 0
    assert {r.verdict for r in U.judge(pages([(1, "http://a.b/c", "x")])).collect()} == {"allow"}


def test_long_words_and_labels_of_any_alphabet(spark):
    """Words over 20 characters and labels over 63 are words and labels like any other."""
    long = "donaudampfschifffahrtsgesellschaft"
    html = f"<p>{long} größe straße größe {long} haus haus</p>" * 30
    hosts = [long + "größe", "hausgrößestraße", "haus" * 20 + long]
    rows = [(i, f"http://{h}.example/x", html) for i, h in enumerate(hosts)]
    counts = U.word_counts(spark.createDataFrame(rows, "page_id long, url string, html string"), "html")
    assert {r.word: r.n for r in counts.collect()} == {long: 180, "größe": 180, "straße": 90, "haus": 180}
    got = {r.label: r.words for r in U.segment_labels(spark.createDataFrame([(h,) for h in hosts], "label string"), counts).collect()}
    assert got == {hosts[0]: [long, "größe"], hosts[1]: ["haus", "größe", "straße"], hosts[2]: ["haus"] * 20 + [long]}
