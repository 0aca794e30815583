"""URL filter and quality rules: against SQL, against brute force, and without Python."""

import math

import duckdb
import pytest
from helpers import WORD, docs, prose, repeated_words
from pyspark.sql import functions as F

from stockyard.llm import oracle, quality_rules, url_filter

SF = "/root/testdata/sf0.001"


def _python_free(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def _compare(spark, name, found, table, frame, tmp_path):
    path = str(tmp_path / "table")
    frame.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    expected = con.sql(oracle.oracle_sql()[name])
    columns = expected.columns
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert found.columns == columns
    rows = sorted((tuple(r) for r in found.collect()), key=key)
    assert rows == sorted(expected.fetchall(), key=key)


TEXTS = [
    None, "", " \t\n ", "one", "a b c d e", "a b c d e a b c d e", "x y " * 12, "same line\nsame line\n\nsame line ",
    "#tag $5 50% <b>|&*", "\x0b\x0c ten words are enough for the rule to let pass.", "no\u00a0break\u2003space é à",
    "a a a a a a a a a a a", "l1 w\r\nl1 w\r\nl2", prose(4, 200), prose(4, 200) + "\n" + prose(5, 30) + "\n" + prose(5, 30),
    "w " * 30_000,
]


def _documents(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", None)[i % 2]) for i, t in enumerate(TEXTS)]
    rows += [(100 + k, prose(k, 60 + k), "en", "hot") for k in range(70)] + [(None, prose(1, 50), "fr", "b")] * 2
    return docs(spark, *rows)


def test_base_counts(spark):
    table = _documents(spark).withColumn("bucket", F.lit(1)).withColumn("n_words", F.lit("clash"))
    for row in quality_rules.base(table, others=["doc_id", "text"]).collect():
        text = row["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeats = repeated_words(words)
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_lines"] == len(lines)
        assert row["n_repeat_words"] == repeats, text[:40]
        assert row["base_failed"] == (len(words) < 10 or 100 * repeats > 20 * len(words))


def test_rules_equal_their_sql(spark, tmp_path):
    table = _documents(spark)
    _compare(spark, "op7_quality_rules", quality_rules.judge(table), "documents", table, tmp_path)


def test_sketch_quantiles_are_near(spark):
    values = [int(math.exp(k / 40)) for k in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "x long")
    rows = rows.withColumn("e", F.greatest(F.length(F.bin("x")) - quality_rules.DIGITS, F.lit(0)))
    sketch = rows.select(F.lit("r").alias("rate"), F.expr("shiftleft(shiftright(x, e), e)").alias("bucket"), F.lit(1).alias("n"))
    found = quality_rules._quantiles(sketch, []).first()
    for name, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        exact = sorted(values)[math.ceil(share * len(values)) - 1]
        assert exact * (1 - 2 ** (1 - quality_rules.DIGITS)) <= found[name] <= exact


def test_cutoffs_follow_language_and_source(spark):
    wide = [(k, " ".join(w + "zzzzzzzz" for w in prose(k, 80).split()), "en", "long") for k in range(60)]
    slim = [(100 + k, prose(k, 80), "en", "short") for k in range(60)]
    odd = [(300, wide[0][1], "en", "short"), (301, slim[0][1], "en", "long"), (302, slim[1][1], "xx", "rare")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs(spark, *wide, *slim, *odd)).collect()}
    assert all(kept[k] for k in [*range(60), *range(100, 160)])
    assert not kept[300] and not kept[301] and kept[302]


def test_rules_keep_whole_rows(spark):
    table = _documents(spark).withColumn("kept", F.lit("mine")).withColumn("rate", F.lit(1))
    kept = quality_rules.keep(table)
    assert kept.columns == table.columns
    expected = [r["doc_id"] for r in quality_rules.judge(table).collect() if r["kept"]]
    assert sorted(map(str, expected)) == sorted(str(r["doc_id"]) for r in kept.collect())


def test_rules_run_without_python(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert _python_free(quality_rules.judge(table)) and _python_free(quality_rules.keep(table))
    assert quality_rules.judge(table.limit(0)).count() == 0


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q=/de/", "http://example.net", "http://net/",
    "http://fakeexample.net/en/1", "ftp://sub.example.com/de/#x", "http://example.com?/de/", "http://Ünï.org/fr/",
    "http://a.org/fr", "x://y://net/z", "http://b.example.com/fr/1\n2", "http://h/" + "p" * 5000,
]


def _pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")


def _parse(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def _rule(host, path):
    fitting = []
    for verdict, rule in url_filter.RULES:
        rule_host, _, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            fitting.append((len(rule), rule, verdict))
    return max(fitting)[1:] if fitting else (None, None)


def _all_urls():
    return URLS + [f"https://s{k}.example.{t}/{p}/{k}.html" for k in range(12) for t in ("net", "com", "org") for p in ("en", "de", "fr")]


def test_hosts_paths_and_rules(spark):
    urls = _all_urls()
    rows = {r["page_id"]: r for r in url_filter.judge(_pages(spark, urls).withColumn("gram", F.lit(1))).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        host, path = _parse(url)
        rule, verdict = _rule(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule), url
        assert rows[i]["verdict"] in (("allow", "block") if verdict is None else (verdict,))


def test_scores_are_those_of_the_definition(spark):
    urls = _all_urls()
    counts, order = {"allow": {}, "block": {}}, url_filter.ORDER
    parts = [_parse(u) for u in urls]
    grams = []
    for host, path in parts:
        padded = url_filter.START * order + host + path + url_filter.END
        grams.append([padded[i : i + order + 1] for i in range(len(padded) - order)])
    for (host, path), found in zip(parts, grams):
        verdict = _rule(host, path)[1]
        if verdict:
            for gram in found:
                for k in range(order + 1):
                    for key in ((k, gram[order - k :]), (k, gram[order - k : order], "context")):
                        counts[verdict][key] = counts[verdict].get(key, 0) + 1

    def chance(verdict, gram):
        p = 1 / url_filter.ALPHABET
        for k in range(order + 1):
            seen = counts[verdict].get((k, gram[order - k :]), 0)
            p = (seen + url_filter.STRENGTH * p) / (counts[verdict].get((k, gram[order - k : order], "context"), 0) + url_filter.STRENGTH)
        return p

    rows = {r["page_id"]: r["score"] for r in url_filter.judge(_pages(spark, urls)).collect()}
    for i, found in enumerate(grams):
        ratio = sum(math.log(chance("allow", g)) - math.log(chance("block", g)) for g in found) / len(found)
        assert rows[i] == pytest.approx(ratio, abs=2e-6)


def test_urls_equal_their_sql(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/pages.parquet").unionByName(_pages(spark, _all_urls()))
    _compare(spark, "op4_url_filter", url_filter.judge(table), "pages", table, tmp_path)


def test_learned_words_decide(spark):
    urls = [f"http://good{k}.example.net/en/garden{k}" for k in range(30)]
    urls += [f"http://bad{k}.example.net/de/casino{k}" for k in range(30)]
    urls += ["http://one.example.com/garden7", "http://two.example.com/casino7"]
    rows = {r["page_id"]: r["verdict"] for r in url_filter.judge(_pages(spark, urls)).collect()}
    assert (rows[60], rows[61]) == ("allow", "block")


def test_without_rules_all_pass(spark):
    rows = url_filter.judge(_pages(spark, URLS), rules=[]).collect()
    assert {r["verdict"] for r in rows} == {"allow"} and {r["rule"] for r in rows} == {None}
    repeated = url_filter.judge(_pages(spark, ["http://a.net/x"] * 3 + [None, None])).collect()
    assert len(repeated) == 5
    assert url_filter.judge(_pages(spark, URLS).limit(0)).count() == 0


def test_urls_run_without_python(spark):
    assert _python_free(url_filter.judge(spark.read.parquet(f"{SF}/pages.parquet")))
