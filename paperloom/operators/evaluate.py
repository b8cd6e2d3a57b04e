"""Ranking metrics, pooled grades, comparisons, signals, latencies, samples and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators.search import blocks, union
from paperloom.session import kept

CUTS = (1, 3, 5, 10)
#: The rank of a missing page where two systems are compared.
MISSING = 1_000_000


def gold_ranks(queries: DataFrame, ranked: DataFrame, id: str) -> DataFrame:
    """``queries`` (qid, gold, ...) with the ``rank`` of the gold page; null if it wasn't found."""
    hits = ranked.select("qid", F.col(id).alias("gold"), "rank")
    return queries.join(hits, ["qid", "gold"], "left")


def first_containing(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``qid, gold``: the first document that contains the text of an item (qid, item); null if there is none.

    A text that contains an item has the item's inner words whole. So candidates share its longest inner
    word, by an equi-join, and the text itself is compared with those few only. Shorter words than any item's longest
    are left out before. An item without an inner word is looked for in all texts, if there is one.
    """
    inner = "filter(slice(split(item, ' '), 2, greatest(size(split(item, ' ')) - 2, 0)), x -> x <> '')"
    keyed = items.withColumn("word", F.expr(f"array_max(transform({inner}, x -> struct(length(x) AS n, x AS word))).word"))
    keyed = kept(keyed, "items")
    least = keyed.agg(F.min(F.length("word")).alias("_least"))  # one row
    long = F.filter(F.split(text, " "), lambda w: F.length(w) >= F.col("_least"))
    words = docs.crossJoin(F.broadcast(least)).select(id, F.explode(F.array_distinct(long)).alias("word"))
    near = kept(words.join(keyed.filter("word IS NOT NULL"), "word").select(id, "qid", "item"), "near")  # Spark knows its size
    hits = [near.join(docs, id).filter(F.contains(text, "item"))]
    short = keyed.filter("word IS NULL AND item IS NOT NULL").select("qid", "item")
    if short.limit(1).count():
        hits += [docs.join(F.broadcast(b), F.contains(text, "item")) for b in blocks(short)]
    found = union([h.select("qid", id) for h in hits]).groupBy("qid").agg(F.min(id).alias("gold"))
    return items.select("qid").join(found, "qid", "left")


def metric_columns(rank: Column, cuts=CUTS) -> list[Column]:
    at = lambda k: F.coalesce(rank <= k, F.lit(False))
    recall = [F.round(F.avg(F.when(at(k), 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in cuts]
    ndcg = [F.round(F.avg(F.when(at(k), 1.0 / F.log2(rank + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}") for k in cuts]
    return [*recall, *ndcg, F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n")]


def metrics_by_group(ranks: DataFrame, *groups: str) -> DataFrame:
    """Metrics over all queries and for each value of each group column (the others null); ``grouping``
    names the column. Without queries there are no rows."""
    name = F.concat_ws("", *(F.when(F.grouping(g) == 0, g) for g in groups))
    sets = [[], *([F.col(g)] for g in groups)]
    out = ranks.groupingSets(sets, *groups).agg(F.when(name == "", "overall").otherwise(name).alias("grouping"), *metric_columns(F.col("rank")))
    return out.filter("n > 0")


def pool(ranked: DataFrame, id: str, k: int = 5) -> DataFrame:
    """``qid, id, first_system, ranks``: pages that any system (qid, system, id, rank) has in its first ``k``, once each."""
    entries = F.array_sort(F.collect_list(F.struct("system", "rank")))
    return ranked.filter(F.col("rank") <= k).groupBy("qid", id).agg(F.min_by("system", F.struct("rank", "system")).alias("first_system"), F.map_from_entries(entries).alias("ranks"))


def pool_entries(pooled: DataFrame, documents: DataFrame, gold: DataFrame, id: str, text: str = "text", size: int = 1500) -> DataFrame:
    """``pooled`` with ``snippet`` (what a judge reads: the first ``size`` characters of a page) and ``is_gold``."""
    full = pooled.join(documents.select(id, F.substring(text, 1, size).alias("snippet")), id, "left").join(gold.select("qid", F.col("gold").alias("_gold")), "qid", "left")
    return full.withColumn("is_gold", F.col(id).eqNullSafe(F.col("_gold")) & F.col(id).isNotNull()).drop("_gold")


def upsert_grades(spark: SparkSession, path: str, pooled: DataFrame, id: str, parts: int = 64) -> None:
    """Merge pooled pages (qid, id) into the stored grades (qid, id, grade): what is graded stays, new pages come without a grade.

    The table is partitioned by a hash of the query. Only partitions with a pooled query are read, merged and replaced, the
    others stay as they are; a write that fails leaves the old partitions, and running again gives the same table.
    """
    from paperloom.sources import readers

    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")
    new = pooled.select("qid", id).distinct().withColumn("part", part)
    if readers.exists(spark, path):
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # parts at most
        old = spark.read.parquet(path).filter(F.col("part").isin(touched))
        new = merge_grades(old.select("qid", id, "grade"), new, id).withColumn("part", part)
    else:
        new = new.withColumn("grade", F.lit(None).cast("int"))
    new.select("qid", id, F.col("grade").cast("int").alias("grade"), "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def set_grades(spark: SparkSession, path: str, given: DataFrame, id: str, parts: int = 64) -> None:
    """Store grades (qid, id, grade) that a judge gave to pages of the table at ``path``; others keep theirs. As ``upsert_grades`` it
    replaces only the partitions it touches."""
    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")
    new = given.filter("grade IS NOT NULL").groupBy("qid", id).agg(F.max("grade").alias("_new")).withColumn("part", part)
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # parts at most
    old = spark.read.parquet(path).filter(F.col("part").isin(touched))
    out = old.join(new.drop("part"), ["qid", id], "left").select("qid", id, F.coalesce("_new", "grade").cast("int").alias("grade"), "part")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merge_grades(old: DataFrame, pooled: DataFrame, id: str) -> DataFrame:
    """Grades of all pages graded before or pooled now; what was graded stays, what is new is null."""
    return old.join(pooled.select("qid", id).distinct(), ["qid", id], "full").select("qid", id, "grade")


def _dcg(order: str, grade: str) -> Column:
    return F.sum(F.col(grade) / F.log2(F.col(order) + 1))


def judge_metrics(ranked: DataFrame, grades: DataFrame, queries: DataFrame, id: str, k: int = 5) -> DataFrame:
    """Graded metrics for each system, over all its queries and by bucket (corpus/type).

    ``queries``: qid, corpus, type, gold (may be null), expect_answer. A page without a grade has 0. The ideal
    order is that of all graded pages of the query. A query whose ideal is zero counts in all means
    but nDCG's; queries that expect no answer are left out (see ``false_positives``).
    """
    full = grades.withColumn("grade", F.coalesce("grade", F.lit(0)))
    best = Window.partitionBy("qid").orderBy(F.desc("grade"), id)
    ideal = full.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= k).groupBy("qid").agg(_dcg("_at", "grade").alias("idcg"))
    wanted = queries.filter("expect_answer").select("qid", "corpus", "type", "gold")
    rows = ranked.filter(F.col("rank") <= k).join(full, ["qid", id], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    rows = rows.join(wanted, "qid").withColumn("_gold", F.col(id) == F.col("gold"))
    per = rows.groupBy("system", "qid", "corpus", "type").agg(
        _dcg("rank", "grade").alias("dcg"), F.max((F.col("grade") >= 2).cast("double")).alias("recall"), (F.count_if(F.col("grade") == 0) / F.greatest(F.count("*"), F.lit(1))).alias("irrelevant"),
        F.max(F.col("_gold").cast("double")).alias("in_top"),
    )
    per = per.join(ideal, "qid", "left").withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).withColumn("bucket", F.concat_ws("/", "corpus", "type"))
    mean = lambda c: F.round(F.avg(c), 6)
    out = per.groupingSets([[F.col("system")], [F.col("system"), F.col("bucket")]], "system", "bucket").agg(F.count("*").alias("n"), mean("ndcg").alias("ndcg"), mean("recall").alias("recall"), mean("irrelevant").alias("irrelevant"), mean("in_top").alias("gold_in_top"))
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def false_positives(ranked: DataFrame, grades: DataFrame, queries: DataFrame, id: str, k: int = 5) -> DataFrame:
    """For each system, queries that expect no answer, and those of them with any graded page."""
    none = queries.filter("NOT expect_answer").select("qid")
    rows = ranked.filter(F.col("rank") <= k).join(none, "qid").join(grades, ["qid", id], "left")
    per = rows.groupBy("system", "qid").agg(F.max(F.coalesce("grade", F.lit(0))).alias("top"))
    return per.groupBy("system").agg(F.count("*").alias("n"), F.count_if(F.col("top") > 0).alias("false_positives"))


def win_loss(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Wins, losses and ties by the gold page's rank (qid, rank); a missing page is last."""
    both = ours.select("qid", F.coalesce("rank", F.lit(MISSING)).alias("a")).join(theirs.select("qid", F.coalesce("rank", F.lit(MISSING)).alias("b")), "qid")
    return both.agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") > F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count("*").alias("n"))


def abstain_signals(ranked: DataFrame, grades: DataFrame, id: str, document: str, k: int = 5) -> DataFrame:
    """For each query its best page, score and grade, the margin to the second, scores, documents and grades of the first ``k``."""
    rows = ranked.filter(F.col("rank") <= k).join(grades, ["qid", id], "left").withColumn("score", F.round("score", 4))
    listed = F.array_sort(F.collect_list(F.struct("rank", "score", "grade", F.col(id).alias("page"))))
    out = rows.groupBy("qid").agg(listed.alias("l"), F.countDistinct(document).alias("n_documents"))
    second = F.get("l.score", 1)
    return out.select(
        "qid", F.get("l.page", 0).alias("top_page"), F.get("l.score", 0).alias("top_score"), F.get("l.grade", 0).alias("top_grade"), F.round(F.get("l.score", 0) - second, 4).alias("margin"),
        F.col("l.score").alias("scores"), "n_documents", F.col("l.grade").alias("grades"),
    )


#: Accuracy of the sketch that proposes splitters, and how far from a share they are, in shares.
ACCURACY, STEPS = 10_000, (0.0004, 0.01)


def _same(a: str, b: str, keys) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or [F.lit(True)]


def _beside(rows: DataFrame, name: str, keys) -> DataFrame:
    """The small side of a join: without keys it is a row a share at most."""
    return rows.alias(name) if keys else F.broadcast(rows.alias(name))


def brackets(rows: DataFrame, value: str, shares: dict[str, float], *keys: str, weight: Column | None = None) -> DataFrame:
    """For each key and share ``name, _all, _low, _high, _place``: the place lies above ``_low`` (null: no bound) and up to ``_high``, and where among those values.

    A mergeable sketch of a key's values proposes splitters close to each share, whatever the values' spread. Exact
    counts up to each splitter, made in one pass, tell the narrowest pair that has the
    place between them, no bound and the greatest value at worst. A row counts ``weight`` times, once if none is given.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    near = sorted({round(min(max(s + sign * step, 0.0), 1.0), 6) for s in shares.values() for step in STEPS for sign in (-1, 1)})
    sketch = known.groupBy(*keys).agg(F.percentile_approx("_v", near, ACCURACY).alias("_s"), F.max("_v").alias("_high"))
    split = sketch.select(*keys, F.array_distinct(F.concat(F.col("_s"), F.array("_high"))).alias("_s"))
    both = known.alias("r").join(_beside(split, "e", keys), _same("r", "e", keys)).select("r.*", "e._s")
    upto = [F.sum(F.when(F.col("_v") <= F.get("_s", F.lit(i)), F.col("_w")).otherwise(0)) for i in range(len(near) + 1)]
    counts = both.groupBy(*keys).agg(F.sum("_w").alias("_all"), F.first("_s").alias("_s"), F.array(*upto).alias("_upto"))
    place = lambda s: F.least(F.floor(F.col("_all") * s), F.col("_all") - 1)
    wanted = counts.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), place(s).alias("place")) for n, s in shares.items()))).alias("w"))
    zipped = wanted.withColumn("_c", F.expr("transform(_s, (v, i) -> struct(v AS v, _upto[i] AS upto))"))
    low = F.array_max(F.filter("_c", lambda c: c["upto"] <= F.col("w.place")))
    high = F.array_min(F.filter("_c", lambda c: c["upto"] > F.col("w.place")))
    return zipped.select(*keys, "_all", F.col("w.name").alias("name"), low.alias("_l"), high.alias("_h"), F.col("w.place").alias("_at")).select(*keys, "_all", "name", F.col("_l.v").alias("_low"), F.col("_h.v").alias("_high"), (F.col("_at") - F.coalesce(F.col("_l.upto"), F.lit(0))).alias("_place"))


def percentile(rows: DataFrame, value: str, shares: dict[str, float], *keys: str, weight: Column | None = None) -> DataFrame:
    """The value at place floor(n * share), from 0 and at most the last, for each key; exact at any size.

    Only values within ``brackets`` are counted one by one and sorted: about a thousandth of a key, or one
    row for a value that occurs very often. With ``weight`` a row counts that many times.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    bounds = brackets(rows, value, shares, *keys, weight=weight)
    inside = (F.col("b._low").isNull() | (F.col("r._v") > F.col("b._low"))) & (F.col("r._v") <= F.col("b._high"))
    few = known.alias("r").join(_beside(bounds, "b", keys), [*_same("r", "b", keys), inside]).select("b.*", "r._v", "r._w")
    per = few.groupBy(*keys, "name", "_place", "_all", "_v").agg(F.sum("_w").alias("_n"))
    reached = per.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "name").orderBy("_v"))).filter(F.col("_upto") > F.col("_place"))
    found = reached.groupBy(*keys, "name").agg(F.min("_v").alias("_v"), F.first("_all").alias("_all"))
    return found.groupBy(*keys).agg(F.max("_all").alias("n"), *(F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in shares))


def latency_summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    out = percentile(rows, value, {"p50": 0.5, "p95": 0.95}, *keys)
    return out.withColumns({c: F.round(c, 3) for c in ("p50", "p95")})


def stratified_sample(rows: DataFrame, stratum: str, id: str, each: int, seed: int) -> DataFrame:
    """``each`` rows of every stratum in the order of a seeded hash, the same wherever it runs."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))
    order = Window.partitionBy(stratum).orderBy("_draw", id)
    return rows.withColumn("_draw", draw).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).drop("_draw")


def not_done(work: DataFrame, done: DataFrame, id: str) -> DataFrame:
    return work.join(done.select(id).distinct(), id, "left_anti")


def latest(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value logged for each key; empty values were never logged."""
    return log.filter(F.coalesce(value, F.lit("")) != "").groupBy(key).agg(F.max_by(value, order).alias(value))


def usable_queries(queries: DataFrame, stop_phrases: list[str], query: str = "query") -> DataFrame:
    """Queries that say something and don't point at a page that the reader can't see."""
    said = F.length(F.trim(query)) > 0
    return queries.filter(said & ~F.exists(F.array(*map(F.lit, stop_phrases)), lambda s: F.contains(F.col(query), s)))


def numbered(rows: DataFrame, *order: str, prefix: str = "J") -> DataFrame:
    """A sample's rows with ``sample_id``: J01, J02, ... in the order of the columns; few rows, one task."""
    at = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("sample_id", F.concat(F.lit(prefix), F.when(at < 10, F.concat(F.lit("0"), at.cast("string"))).otherwise(at.cast("string"))))


def judge_sample(qa: DataFrame, synthetic: DataFrame, manual: DataFrame, each: int = 5, made: int = 15, seed: int = 20260917) -> DataFrame:
    """``sample_id, corpus, source, type, query, gold, expect_answer``: ``each`` questions of every type of ``qa`` (id,
    type, query), ``made`` of ``synthetic`` (page_id, query), and all of ``manual`` (query, expect_answer), numbered in that order."""
    asked = stratified_sample(qa.select("id", "type", "query"), "type", "id", each, seed)
    drawn = stratified_sample(synthetic.select("page_id", "query", F.lit("image").alias("type")), "type", "page_id", made, seed)
    own = lambda n, corpus, source, rows, gold, expect: rows.select(F.lit(n).alias("part"), F.lit(corpus).alias("corpus"), F.lit(source).alias("source"), "type", "query", gold.cast("string").alias("gold"), expect.alias("expect_answer"), "place")
    rest = manual.select("query", "expect_answer", F.lit("manual").alias("type")).withColumn("place", F.row_number().over(Window.orderBy("query")))
    parts = [own(1, "pages", "qa", asked, F.col("id"), F.lit(True)), own(2, "pages", "synthetic", drawn, F.col("page_id"), F.lit(True)), own(3, "filings", "manual", rest, F.lit(None), F.col("expect_answer"))]
    out = numbered(parts[0].unionByName(parts[1]).unionByName(parts[2]), "part", "type", "place")
    return out.select("sample_id", "corpus", "source", "type", "query", "gold", "expect_answer")


def caption_report(log: DataFrame, elapsed: str = "elapsed_sec", caption: str = "caption") -> DataFrame:
    """One row: captions made and failed, mean and 95th percentile of the seconds of those made."""
    made = log.filter(F.coalesce(caption, F.lit("")) != "")
    counts = log.agg(F.count_if(F.coalesce(caption, F.lit("")) != "").alias("captioned"), F.count_if(F.coalesce(caption, F.lit("")) == "").alias("failed"))
    times = made.agg(F.round(F.avg(elapsed), 6).alias("mean_sec"))
    return counts.crossJoin(times).join(percentile(made, elapsed, {"p95_sec": 0.95}).drop("n"), F.lit(True), "left")  # one row each


def report_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a report in ascending order, those without a value last."""
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in columns))
