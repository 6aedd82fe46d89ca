"""URL filter: rules first, then naive Bayes over segmented host and path words.

Rules are ``(verdict, host, path)``; a rule fits its host and all subdomains when the
url's path starts with the rule's, and the longest rule wins. Urls that no rule fits get
the verdict of a multinomial naive Bayes model learned from the urls that a rule decides.

Host names run words together (``threaton``), so each distinct host label is first split
into words by a Viterbi search over unigram probabilities. The unigrams are counted over
the words of all page texts. A label only needs the words it contains, so the pieces of
the distinct labels are joined with the counts: each label brings its own short list to
the search and no vocabulary is broadcast.

Both joins on frequent keys (tokens of the urls) broadcast only the tokens that make up
at least one thousandth of all occurrences, which are at most a thousand by arithmetic;
the others go through a shuffle join.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
is judged by the prior; null or empty html adds no words; with no rule-decided urls
every verdict is ``allow``; repeated rows (also of one page_id) are judged each; extra
columns do not reach the result; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, read, written

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What stands between words, in texts and in the names of a host alike.
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Characters of a word that can stand in a host name: a whole label has no more.
MAX_WORD = 63
HOT_SHARE = 1000
SMOOTHING = 1.0


def split_url(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` of ``url``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    return (pages.withColumn("after_scheme", rest)
            .withColumns({"host": lower_ascii(F.regexp_extract("after_scheme", r"^([^/?#]*)", 1)),
                          "path": F.regexp_extract("after_scheme", r"^[^/?#]*([^?#]*)", 1)})
            .drop("after_scheme"))


def rule_columns(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` (like ``net/``) and ``rule_verdict`` of the longest rule that fits."""
    text = {r: r[1] + r[2] for r in rules}
    ordered = sorted(rules, key=lambda r: -len(text[r]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
        rule = F.when(fits, F.lit(text[r])).otherwise(rule)
        verdict = F.when(fits, F.lit(r[0])).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``word, n``: runs of letters and digits in the texts, A-Z lower-cased, mark-up left
    out, of at most ``MAX_WORD`` characters (no label can hold a longer one)."""
    plain = F.regexp_replace(lower_ascii(F.coalesce(F.col(column), F.lit(""))), r"<[^>]*>", " ")
    words = texts.select(F.explode(F.split(plain, NOT_WORD)).alias("word"))
    return (words.where(F.length("word").between(1, MAX_WORD)).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")))


def viterbi(label: str, counts: dict[str, int], total: float) -> list[str]:
    """The most probable split of ``label`` into words; a piece that is no known word
    costs more with each character."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(label)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - MAX_WORD), end):
            piece = label[start:end]
            n = counts.get(piece, 0)
            p = math.log(n / total) if n else -math.log(total) - 2.3 * len(piece)
            if best[start][0] + p > best[end][0]:
                best[end] = (best[start][0] + p, start)
    words, end = [], len(label)
    while end > 0:
        words.append(label[best[end][1]:end])
        end = best[end][1]
    return words[::-1]


def segment_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """``label, words`` for distinct ``label`` of any length. A label brings at most
    ``MAX_WORD`` pieces for each of its characters."""
    total = counts.agg(F.sum("n")).first()[0] or 1

    @F.pandas_udf("array<string>")
    def segment(label: pd.Series, words: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, dict(zip(w, n)), float(total)) for x, w, n in zip(label, words, ns)], dtype=object)

    starts = labels.select("label", F.explode(F.expr("sequence(1, length(label))")).alias("s"))
    pieces = starts.select("label", F.explode(F.expr(
        f"transform(sequence(1, least({MAX_WORD}, length(label) - s + 1)), k -> substring(label, s, k))")).alias("word"))
    known = (pieces.distinct().join(counts, "word").groupBy("label")
             .agg(F.collect_list(F.struct("word", "n")).alias("known")))
    with_words = labels.join(known, "label", "left")
    empty = F.expr("cast(array() as array<struct<word: string, n: bigint>>)")
    listed = with_words.withColumn("known", F.coalesce("known", empty))
    return listed.select("label", segment("label", "known.word", "known.n").alias("words"))


def _hot_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per key; keys whose ``n`` is at least a
    thousandth of ``total`` are joined by broadcast."""
    hot = F.col("n") >= max(1.0, total / HOT_SHARE)
    marked = rows.join(F.broadcast(table.where(hot).select(F.col(key), F.struct("*").alias("hot_row"))), key, "left")
    value = [c for c in table.columns if c != key]
    cold = marked.where("hot_row IS NULL").drop("hot_row").join(table.where(~hot), key, "left")
    warm = marked.where("hot_row IS NOT NULL").select(*rows.columns, *[F.col(f"hot_row.{c}").alias(c) for c in value])
    return warm.unionByName(cold.select(*rows.columns, *value))


def url_tokens(urls: DataFrame, segments: DataFrame) -> DataFrame:
    """``row, rule_verdict, token``: ``h:`` words of the host and ``p:`` words of the path."""
    hosts = urls.select("row", "rule_verdict", F.explode(F.split("host", NOT_WORD)).alias("label")).where("label <> ''")
    n = hosts.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    table = written(segments.join(n, "label"), "segments")
    joined = _hot_join(hosts, table, "label", hosts.count())
    host = joined.select("row", "rule_verdict", F.explode(F.transform("words", lambda w: F.concat(F.lit("h:"), w))).alias("token"))
    path = urls.select("row", "rule_verdict", F.explode(F.split(lower_ascii("path"), NOT_WORD)).alias("w"))
    path = path.where("w <> ''").select("row", "rule_verdict", F.concat(F.lit("p:"), "w").alias("token"))
    return host.unionByName(path)


def token_weights(tokens: DataFrame) -> tuple[DataFrame, int]:
    """``token, n, weight`` (log odds of allow against block, learned from the urls that a
    rule decides) for every token, and the number of occurrences."""
    counts = (tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("a"),
        F.count_if(F.col("rule_verdict") == "block").alias("b")))
    counts = written(counts, "url-tokens")
    t = counts.agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"),
                   F.count_if(F.expr("a + b > 0")).alias("v")).first()
    a, b, v = t.a or 0, t.b or 0, t.v or 0
    balance = math.log((b + SMOOTHING * (v + 1)) / (a + SMOOTHING * (v + 1)))
    weight = F.log((F.col("a") + SMOOTHING) / (F.col("b") + SMOOTHING)) + F.lit(balance)
    return counts.select("token", "n", weight.alias("weight")), t.n or 0


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``
    (``page_id, url, html``)."""
    urls = rule_columns(split_url(pages.select("page_id", "url")), rules).drop("url")
    urls = written(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = urls.select(F.explode(F.split("host", NOT_WORD)).alias("label")).where("label <> ''").distinct()
    counts = written(word_counts(pages, "html"), "words")
    segments = segment_labels(labels, counts)
    tokens = written(url_tokens(urls, segments), "url-words")
    weights, n = token_weights(tokens)
    seen = urls.where("rule_verdict IS NOT NULL").groupBy("rule_verdict").count().collect()
    decided = {r.rule_verdict: r["count"] for r in seen}
    prior = math.log((decided.get("allow", 0) + 1) / (decided.get("block", 0) + 1))
    undecided = tokens.where("rule_verdict IS NULL").select("row", "token")
    scored = (_hot_join(undecided, weights, "token", n).groupBy("row").agg(F.sum("weight").alias("score")))
    method = F.when(F.coalesce("score", F.lit(0.0)) + prior >= 0, "allow").otherwise("block")
    return (urls.join(scored, "row", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict")))


def op9_url_filter(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages"))
