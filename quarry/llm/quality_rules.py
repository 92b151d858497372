"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation
over the counts of vote patterns (at most 3 ** rules, whatever the corpus)
estimates each rule's accuracy and the share of good documents without labels,
and a document is kept when its posterior probability of being good reaches
``KEEP``.  A few base checks reject documents outright.

A null text has no words; empty texts, ties and repeated rows need no care, as
every row is judged by itself once the accuracies are known.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

SPACE = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
KEEP = 0.5
ROUNDS = 40


def measures(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Per row: words, code points in words, symbols, repeated lines, words in repeated 3-word windows, and a few shares.

    whole: with ``row``, a struct of all columns of ``docs``, whatever their names.
    """
    more = ["row"] if whole else []
    t = work.texts(docs, *([F.struct(*[F.col(work.quoted(c)) for c in docs.columns]).alias("row")] if whole else []))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(SOLID))
    t = t.select("*", F.array_remove(F.split("text", SPACE), "").alias("w"), lines.alias("lines"))
    # windows of three words as (hash, place), in the order of hashes: equal ones are neighbours
    window = F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, i as i)))")
    t = t.select(
        "doc_id",
        *more,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>!](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_marked"),
        F.regexp_count("text", F.lit(r"[^\p{L}\x20\x09-\x0D]")).cast("long").alias("n_signs"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.array_sort(window).alias("g"),
    )
    twice = F.expr("filter(g, (x, k) -> x.h = get(g, k - 1).h or x.h = get(g, k + 1).h)")
    t = t.withColumn("twice", F.transform(twice, lambda x: x["i"])).drop("g")
    return t.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(F.transform("twice", lambda i: F.array(i, i + 1, i + 2))))).cast("long")).drop("twice")


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """The rules; each divides by at least one."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / n
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    signs = F.col("n_signs") / F.greatest(F.col("word_chars"), F.lit(1))
    repeat, dup = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines
    return [
        vote(n >= 80, n < 50),
        vote((mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 14)),
        vote(F.col("n_symbols") / n <= 0.02, F.col("n_symbols") / n > 0.1),
        vote(dup <= 0.1, dup > 0.3),
        vote(repeat <= 0.15, repeat > 0.3),
        vote(F.col("n_marked") / n <= 0.03, F.col("n_marked") / n > 0.15),
        vote(signs <= 0.12, signs > 0.2),
        vote(upper <= 0.15, upper > 0.3),
        vote(F.col("n_distinct") / F.sqrt(n) >= 5, F.col("n_distinct") / F.sqrt(n) < 2),
    ]


def base_failed() -> Column:
    """Fixed values of the contract."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def accuracies(voted: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row: the share of good documents, and each rule's chances of voting right among good and among bad documents.

    All rounds are one fold over the array of vote patterns, which has at most
    3 ** rules entries.  Only documents that pass the base checks count.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    row = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    # a rule's votes given good: chance of 1 and of -1; given bad likewise; abstaining says nothing
    chance = "aggregate(sequence(0, %d), 0D, (s, j) -> s + case get(%s.votes, j) when 1 then ln(get(%s, j)) when -1 then ln(1 - get(%s, j)) else 0D end)" % (rules - 1, "x", "%s", "%s")
    good, bad = chance % ("a.good", "a.good"), chance % ("a.bad", "a.bad")
    posterior = f"1 / (1 + exp(least(600D, ({bad}) + ln(1 - a.prior) - ({good}) - ln(a.prior))))"
    weighed = f"transform(p, x -> struct(x.votes as votes, x.n as n, {posterior} as q))"

    def share(of: str) -> str:
        up = f"aggregate(e, 0D, (s, y) -> s + if(get(y.votes, j) = 1, y.n * {of}, 0D))"
        any_ = f"aggregate(e, 0D, (s, y) -> s + if(get(y.votes, j) <> 0, y.n * {of}, 0D))"
        return f"transform(sequence(0, {rules - 1}), j -> least(0.999D, greatest(0.001D, ({up} + 1) / ({any_} + 2))))"

    prior = "least(0.999D, greatest(0.001D, (aggregate(e, 0D, (s, y) -> s + y.n * y.q) + 1) / (aggregate(e, 0D, (s, y) -> s + y.n) + 2)))"
    update = f"transform(array({weighed}), e -> named_struct('prior', {prior}, 'good', {share('y.q')}, 'bad', {share('(1 - y.q)')}))[0]"
    start = f"named_struct('prior', 0.8D, 'good', array_repeat(0.995D, {rules}), 'bad', array_repeat(0.6D, {rules}))"
    return row.select("p", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (a, r) -> {update})").alias("a")).select(F.explode(F.expr(weighed)).alias("x")).select(F.col("x.votes").alias("votes"), F.col("x.q").alias("p_good"))


def judge(docs: DataFrame, whole: bool = False) -> DataFrame:
    """measures() of every row with base_failed, votes, p_good (null where the base checks failed) and kept."""
    rules = votes()
    measured = measures(docs, whole).withColumn("votes", F.array(*rules)).withColumn("base_failed", base_failed())
    measured = work.written(measured, "quality")
    chances = accuracies(measured.filter(~F.col("base_failed")), len(rules))
    # at most 3 ** rules rows: a proven bound
    out = measured.join(F.broadcast(chances), "votes", "left")
    verdict = F.coalesce(F.col("p_good") >= KEEP, F.lit(False))
    return out.withColumn("p_good", F.when(~F.col("base_failed"), F.col("p_good"))).withColumn("kept", ~F.col("base_failed") & verdict)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every document of ``documents``."""
    out = judge(work.read_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
