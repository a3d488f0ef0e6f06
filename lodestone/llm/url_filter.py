"""Operator 5, URL filters: rules, and a character language-model ratio for the rest, in SQL functions only.

A rule (action, host, path) fits its host and all subdomains if the URL's path starts with
the rule's; of several the longest wins. Other URLs are judged by two smoothed
variable-order Markov models over the characters of host and path, one for accepted and
one for rejected URLs: the probability of a character after a context of three backs off
to contexts of two, one and none, each order weighing by how often its context was seen.
The difference of both log-likelihoods, divided by the number of characters, is compared
with a threshold calibrated on a fifth of the labelled URLs, chosen by a hash, that the
models have not seen (on all of them where that fifth lacks a class): the point between both
classes' means that lies equally many standard deviations from each.

Labels come from a table of labelled URLs where the caller has one; then nothing below about
words applies. Else they come from the table itself and from ``REJECTED``, a bundled list of words. A URL is an
example of what to reject when a word of its host is one of ``SEEDS`` or its host contains
one of ``REJECTED`` of ``CONTAINED`` characters or more, else of what to accept unless a
rule blocks it. Rules that block a section say nothing about how a bad URL looks, so their
URLs are not learned from. Every accepted example also gives one made example to reject:
itself with one label of its host replaced by words of ``REJECTED``, so that the rejected
class has examples whatever the table holds, and both classes share endings and paths.

All orders are sums over one table of four-character windows. A table of at most
``HEAD_GRAMS`` rows is broadcast. Of a larger one the windows that make up one in
``HEAD_GRAMS`` of all windows' places are, which are no more than that by count; the others
are joined by shuffle, and as none of them is frequent, no task gets a hot one.

Edge cases: a null URL, or one without ``://``, has empty host and path and no windows; its
score is 0 and the method allows it. Where no URL is accepted, the method blocks the
rejected examples. Repeated rows give one result each. Very long URLs are judged whole.
Labelled URLs without a host, or with another label than accept and reject, teach nothing; if
the labelled table lacks a class, nothing is blocked. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, let

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that mark a host as an example of what to reject.
SEEDS = ("ads", "adult", "bets", "casino", "cheap", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
REJECTED = tuple(
    "ads adult adulte apuestas bet bets betting bingo blackjack bonus camgirl cams cannabis casino cheap cialis clickbait coupons cracked crypto dating drogen drugs erotic erotica erotik escort escorts fake fetish freebies gambling glücksspiel hacked hentai hookup jackpot juegos kasino keygen kredit levitra loans lottery lotto milf naked nude nudes onlyfans paris-sportif payday pharma pharmacy phishing pills poker porn porno prestamos replica replicas roulette sex sexy slots spam spielbank steroids strip swingers tabletten torrents tramadol viagra warez wetten xanax xxx".split()
)
CONTAINED = 5
ORDER = 4
HEAD_GRAMS = 1 << 17
STRENGTH = 2.0
#: One part of so many is held out of the models for the threshold.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; nulls where none fits."""
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return (name, action) if rules else (F.lit(None).cast("string"),) * 2


def windows(text: Column) -> Column:
    """Each character of a text after its three predecessors (tildes before the first)."""
    characters = F.split(F.concat(F.lit("~" * (ORDER - 1)), text), "")
    grams = let(characters, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER), lambda i: F.concat(*[F.get(c, i + j) for j in range(ORDER)])))
    return F.when(text != "", grams).otherwise(F.array().cast("array<string>"))


def made(host: Column, path: Column) -> Column:
    """Host and path with one label before the last replaced by one or two words of ``REJECTED``, chosen by a hash."""
    words, pick = F.array(*map(F.lit, REJECTED)), F.xxhash64(host, path)

    def word(k: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64(pick, F.lit(k)), F.lit(len(REJECTED))).cast("int"))

    mark = F.get(F.array(*map(F.lit, ("", "-", None))), F.pmod(F.xxhash64(pick, F.lit(2)), F.lit(3)).cast("int"))
    name = F.coalesce(F.concat(word(0), mark, word(1)), word(0))

    def replaced(labels: Column) -> Column:
        at = F.pmod(F.xxhash64(pick, F.lit(3)), F.greatest(F.size(labels) - 1, F.lit(1)))
        return F.array_join(F.transform(labels, lambda x, i: F.when(i == at, name).otherwise(x)), ".")

    return F.concat(let(F.split(host, r"\."), replaced), path)


def ratios(counts: DataFrame) -> DataFrame:
    """gram and log P(accepted) - log P(rejected) of its last character, from (gram, n, a, r)."""
    last = F.substr("gram", F.lit(ORDER))
    whole = counts.agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count_distinct(last).alias("alphabet")).first()
    out = counts
    for name in ("a", "r"):
        p = F.lit(1 / ((whole.alphabet or 0) + 1))
        for order in range(ORDER):
            context = F.substr("gram", F.lit(ORDER - order), F.lit(order)) if order else F.lit("")
            seen = F.sum(name).over(Window.partitionBy(context, last))
            total = F.sum(name).over(Window.partitionBy(context)) if order else F.lit(whole[name] or 0)
            out = out.withColumn(f"s{order}", seen).withColumn(f"t{order}", total)
            p = (F.col(f"s{order}") + STRENGTH * p) / (F.col(f"t{order}") + STRENGTH)
        out = out.withColumn(f"log_{name}", F.log(p)).drop(*[f"{x}{k}" for k in range(ORDER) for x in "st"])
    return out.select("gram", "n", (F.col("log_a") - F.col("log_r")).alias("ratio"))


def with_ratios(grams: DataFrame, table: DataFrame, head: int = HEAD_GRAMS) -> DataFrame:
    """The windows with their ratios from a table (gram, n, ratio), n being how often the window occurs."""
    if table.limit(head + 1).count() <= head:
        return grams.join(F.broadcast(table), "gram")
    total = table.agg(F.sum("n")).first()[0]
    often = F.col("n") * head >= total
    first = F.broadcast(table.where(often))
    return grams.join(first, "gram").unionByName(grams.join(first, "gram", "left_anti").join(table.where(~often), "gram"))


def threshold_parts(spread: list) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of each label's scores, from rows (label, n, m, q) of parts."""
    out = {}
    for label in {x.label for x in spread}:
        part = [x for x in spread if x.label == label]
        n = sum(x.n for x in part)
        mean, square = sum(x.n * x.m for x in part) / n, sum(x.n * x.q for x in part) / n
        out[label] = mean, max(square - mean * mean, 0.0) ** 0.5
    return out


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row; ``labelled`` (url, label: accept or reject) takes the place of the words."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, seeds))) | F.col("host").rlike("|".join(w for w in REJECTED if len(w) >= CONTAINED))
    rows = rows.withColumns({"rule": rule, "action": action})
    if labelled is None:
        rows = rows.withColumns({"label": F.when(bad, "r").when(F.coalesce("action", F.lit("allow")) == "allow", "a"), "asked": F.lit(True)})
    else:
        known = F.when(host != "", F.when(F.col("label") == "accept", "a").when(F.col("label") == "reject", "r"))
        taught = labelled.select((-1 - F.monotonically_increasing_id()).alias("rid"), host.alias("host"), path.alias("path"), known.alias("label"), F.lit(False).alias("asked")).where("label is not null")
        rows = rows.withColumns({"label": F.lit(None).cast("string"), "asked": F.lit(True)}).unionByName(taught, allowMissingColumns=True)
    rows = cut(rows)
    text = F.concat("host", "path")
    fakes = rows.where(F.lit(labelled is None)).where("label = 'a' and host != ''").select("rid", F.lit("m").alias("label"), made(F.col("host"), F.col("path")).alias("text"))
    held = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    grams = rows.select("rid", "label", text.alias("text")).unionByName(fakes).select("rid", "label", held.alias("held"), F.explode(windows(F.col("text"))).alias("gram"))
    learn = ~F.col("held")
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"), F.count_if((F.col("label") == "a") & learn).alias("a"), F.count_if(F.col("label").isin("r", "m") & learn).alias("r"))
    scores = cut(with_ratios(grams, cut(ratios(cut(counts)))).groupBy("rid", (F.coalesce("label", F.lit("")) == "m").alias("made")).agg(F.avg("ratio").alias("score"), F.first("held").alias("held")))
    scored = cut(rows.join(scores.where("not made").drop("made"), "rid", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
    examples = scored.where("label is not null and host != ''").select("label", "score", "held").unionByName(scores.where("made").select(F.lit("r").alias("label"), "score", "held"))
    spread = examples.groupBy("label", "held").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.avg(F.col("score") * F.col("score")).alias("q")).collect()
    fit = threshold_parts([x for x in spread if x.held]) if len({x.label for x in spread if x.held}) == 2 else threshold_parts(spread)
    if len(fit) == 2:
        (am, a_s), (rm, rs) = fit["a"], fit["r"]
        limit = (am * (rs + 1e-9) + rm * (a_s + 1e-9)) / (a_s + rs + 2e-9)
        method = F.when((F.col("score") >= limit) | (F.col("host") == "") & (F.col("path") == ""), "allow").otherwise("block")
    else:
        method = F.when(F.col("label") == "r", "block").otherwise("allow")
    return scored.where("asked").select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"), "score")
