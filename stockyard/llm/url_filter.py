"""URL filter: rules first, then the ratio of two character language models.

Built-in expressions only. URLs that a rule blocks or allows teach two variable-order
Markov models, one of rejected and one of accepted URLs. In each, the chance of a
character after ``k`` others is that after ``k - 1`` others, corrected by what was seen
after those ``k``, as if it had been seen ``STRENGTH`` times before: contexts never
seen fall back to shorter ones. A URL's score is the difference of the models' log
likelihoods, divided by its length; the cutoff lies where, on the URLs that rules
decide, as many standard deviations separate it from the mean of either side.

All that is counted is grouped by strings of ``ORDER + 1`` characters, so tables of
counts are bounded by the alphabet, while counting follows the input.
"""

from pyspark.sql import functions as F

from stockyard.session import materialize

ORDER = 4
STRENGTH = 2.0
ALPHABET = 256  # characters that share the chance of one never seen
START, END = "\x02", "\x03"
# The rules of this deployment: (verdict, host and path).
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parse(url):
    """(host, path) of a URL column; both empty without a ``://`` or for a null."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def _first_rule(rules, host, path, value):
    """``value(rule)`` of the longest rule that fits, else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        found = (F if found is None else found).when(fits, F.lit(value((verdict, rule))))
    return found if found is not None else F.lit(None).cast("string")


def _grams(rows):
    """One row for each character of each URL, with the ``ORDER`` before it."""
    padded = F.concat(F.lit(START * ORDER), F.col("host"), F.col("path"), F.lit(END))
    n = F.length(padded) - ORDER
    return rows.withColumn("_padded", padded).withColumn("_at", F.explode(F.sequence(F.lit(1), n))).withColumn(
        "gram", F.substring(F.col("_padded"), F.col("_at"), F.lit(ORDER + 1))
    ).drop("_padded", "_at")


def _log_ratio(grams, counts):
    """(gram, ratio): log chance of the gram's last character under the accepted model
    less that under the rejected one."""
    sides = [("accepted", "allow"), ("rejected", "block")]
    chance = {side: F.lit(1.0 / ALPHABET) for side, _ in sides}
    table = grams
    for k in range(ORDER + 1):
        tail, context = F.right("gram", F.lit(k + 1)), F.substring("gram", ORDER + 1 - k, k)
        sums = [F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)) for _, v in sides]
        seen = counts.groupBy(tail.alias(f"t{k}")).agg(*[s.alias(f"s{k}_{side}") for s, (side, _) in zip(sums, sides)])
        base = counts.groupBy(context.alias(f"c{k}")).agg(*[s.alias(f"b{k}_{side}") for s, (side, _) in zip(sums, sides)])
        table = table.join(seen, F.right("gram", F.lit(k + 1)) == F.col(f"t{k}"), "left")
        table = table.join(base, F.substring("gram", ORDER + 1 - k, k) == F.col(f"c{k}"), "left")
        for side, _ in sides:
            table = table.withColumn(
                f"p{k}_{side}",
                (F.coalesce(f"s{k}_{side}", F.lit(0)) + F.lit(STRENGTH) * chance[side])
                / (F.coalesce(f"b{k}_{side}", F.lit(0)) + F.lit(STRENGTH)),
            )
            chance[side] = F.col(f"p{k}_{side}")
    return table.select("gram", (F.ln(chance["accepted"]) - F.ln(chance["rejected"])).alias("ratio"))


def judge(pages, rules=RULES):
    """page_id, host, path, rule, verdict and score of every row.

    Null URLs have an empty host and path and are scored like others; repeated rows
    and null ids are rows like others. If the rules give no accepted or no rejected
    URL, what they leave undecided is allowed.
    """
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select(
        F.monotonically_increasing_id().alias("_row"), "page_id", "host", "path",
        _first_rule(rules, F.col("host"), F.col("path"), lambda r: r[1]).alias("rule"),
        _first_rule(rules, F.col("host"), F.col("path"), lambda r: r[0]).alias("decided"),
    )
    rows = materialize(rows, "url_rows")
    grams = _grams(rows)
    counted = grams.groupBy("gram", F.col("decided").alias("verdict")).agg(F.count("*").alias("n"))
    counts = materialize(counted, "url_counts")
    known = counts.where("verdict IS NOT NULL")
    ratios = materialize(_log_ratio(counts.select("gram").distinct(), known), "url_ratios")
    scores = grams.select("_row", "gram").join(ratios, "gram").groupBy("_row").agg(
        (F.sum("ratio") / F.count("*")).alias("score")
    )
    scored = materialize(rows.join(scores, "_row"), "url_scores")
    cutoff = calibrate(scored)
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("score") >= cutoff, "allow").otherwise("block")).alias("verdict"),
        F.round("score", 6).alias("score"),
    )


def calibrate(scored):
    """The cutoff, one number; without both kinds of decided URL it lets all pass."""
    found = {
        r["decided"]: r for r in scored.where("decided IS NOT NULL").groupBy("decided").agg(
            F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread")
        ).collect()
    }
    if len(found) < 2:
        return float("-inf")
    a, b = found["allow"], found["block"]
    if a["spread"] + b["spread"] == 0:
        return (a["mean"] + b["mean"]) / 2
    return (a["mean"] * b["spread"] + b["mean"] * a["spread"]) / (a["spread"] + b["spread"])
