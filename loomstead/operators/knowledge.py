"""Knowledge and memory stores: lists, imports, statistics, retrieval logs, pruning, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """old with new rows put over those of the same key, but for the columns in keep."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh = F.col(f"n.{key}").isNotNull()

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[pick(c).alias(c) for c in old.columns])


def import_entries(old: DataFrame, new: DataFrame, mode: str, key: str = "id") -> DataFrame:
    """append: skip known keys; overwrite: new alone; merge: upsert."""
    if mode == "append":
        return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)
    if mode == "overwrite":
        return new
    if mode == "merge":
        return upsert(old, new, key)
    raise ValueError(f"unknown mode {mode}")


def bulk_counts(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One row: processed, created, existing of a bulk insert."""
    flagged = new.join(old.select(F.col(key).alias("_k")).distinct().withColumn("_old", F.lit(1)), F.col(key) == F.col("_k"), "left")
    return flagged.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old").isNotNull()).alias("existing"))


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key: last write wins."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def list_entries(entries: DataFrame, status: str | None = None, tags: list[str] | None = None, query: str | None = None, min_occurrences: int = 0, limit: int = 0, offset: int = 0) -> DataFrame:
    """Entries that pass all filters, last seen first, ties by id; paging works without a limit too."""
    if status:
        entries = entries.where(F.col("status") == status)
    if min_occurrences:
        entries = entries.where(F.col("occurrences") >= min_occurrences)
    if tags:
        wanted = [t.lower() for t in tags]
        entries = entries.where(F.exists("tags", lambda t: F.lower(t).isin(*wanted)))
    if query:
        text = F.lower(F.concat_ws(" ", "question", "answer"))
        entries = entries.where(F.contains(text, F.lit(query.lower())))
    out = entries.orderBy(F.desc("last_seen"), F.asc("id"))
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def entry_stats(entries: DataFrame) -> DataFrame:
    """One row: entries, by status, distinct tags and variants, last update."""
    tags = entries.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("n_tags"))
    rest = entries.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "promoted").alias("promoted"), F.sum("occurrences").alias("occurrences"), F.max("last_seen").alias("last_seen"))
    return rest.crossJoin(tags)


def entry_totals(entries: DataFrame) -> DataFrame:
    """One row: entries, distinct sprints, variants and tags (arrays of the entries; null is none)."""
    out = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.coalesce("variants", F.array().cast("array<string>")))), F.lit(0)).alias("variants"))
    for c in ("sprints", "tags"):
        out = out.crossJoin(F.broadcast(entries.select(F.explode(c).alias("x")).agg(F.count_distinct("x").alias(f"n_{c}"))))
    return out


def stats_table(entries: DataFrame, log: DataFrame, min_retrievals: int = 0, status: str | None = None, tag: str | None = None, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, totals): entries (memory_id, status, tags) with their retrievals that pass the filters, most retrieved first; totals are counted before any filter."""
    totals = entries.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "promoted").alias("promoted"))
    rows = retrieval_stats(entries, log, min_retrievals)
    if status:
        rows = rows.where(F.col("status") == status)
    if tag:
        rows = rows.where(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))
    rows = rows.orderBy(F.desc("n"), "memory_id")
    return (rows.limit(limit) if limit else rows), totals


def retrieval_stats(stats: DataFrame, log: DataFrame, min_retrievals: int = 0) -> DataFrame:
    """stats (memory_id, ...) with n, avg_score and last of each memory's log (memory_id, score, timestamp); the log is summed before the join."""
    summed = log.groupBy(F.col("memory_id").alias("_m")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.max("timestamp").alias("last"))
    out = stats.join(summed, stats.memory_id == F.col("_m"), "left").drop("_m").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where(F.col("n") >= min_retrievals)


def retrieval_history(log: DataFrame, memory_id, limit: int = 0, offset: int = 0) -> DataFrame:
    out = log.where(F.col("memory_id") == memory_id).orderBy(F.desc("timestamp"), F.desc("id"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def prune_log(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The log without what is older than so many days."""
    return log.where(F.col("timestamp") >= as_of - F.make_dt_interval(F.lit(days)))


def duration_days(text: Column) -> Column:
    """`30d`, `2w`, `6m`, `1y` in days: a month is 30, a year 365; null if it is no duration."""
    n, unit = F.regexp_extract(text, r"^(\d+)([dwmy])$", 1), F.regexp_extract(text, r"^(\d+)([dwmy])$", 2)
    days = F.create_map(*[F.lit(x) for x in ("d", 1, "w", 7, "m", 30, "y", 365)])
    return F.when(n != "", n.cast("int") * days[unit])


def stale_entries(entries: DataFrame, as_of: Column, older_than_days: int) -> DataFrame:
    return entries.where(F.col("last_seen") < F.date_sub(as_of.cast("date"), older_than_days))


def stale_references(entries: DataFrame, files: DataFrame, pattern: str = r"[\w./-]+\.[A-Za-z]{1,5}") -> DataFrame:
    """(id, missing): references in an entry's text that no file of the relation has."""
    refs = entries.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("ref"))
    return refs.join(files.select(F.col("path").alias("ref")).distinct(), "ref", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("missing"))


def question_words(question: Column) -> Column:
    """Lower-case words of more than three bytes, with repeats."""
    return F.filter(F.split(F.regexp_replace(F.lower(question), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: F.octet_length(w) > 3)


def similar_classes(questions: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members (id, class), pairs (a_class, b_class, common)) of questions (id, question): the classes of the same words, and those that share half the words of the shorter, counted by occurrences in a; a class with itself too.

    Pairs of classes come from a prefix filter: with the rarest words first, a
    pair that meets the share has a common word among the first of its shorter
    side, and only those meet the words of the other. What passes is counted
    exactly. No pair of ids is made. Questions without words are in no class;
    repeated rows are members each; an empty table gives none.
    """
    w = questions.select("id", F.array_sort(question_words(F.col("question"))).alias("w")).where(F.size("w") > 0)
    members = w.select("id", F.xxhash64(F.to_json("w")).alias("class"), "w")
    classes = members.groupBy("class").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("held")).withColumn("n", F.size("w"))
    each = classes.select("class", "n", F.posexplode("w").alias("at", "word"))
    rare = each.groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    order = [F.asc("f"), F.asc("word")]
    least = F.greatest(F.lit(1), F.ceil(share * F.col("n") - 1e-9))  # common occurrences that a shorter side of n words needs
    ranked = each.join(rare, "word").withColumns({"rank": F.row_number().over(W.partitionBy("class").orderBy(*order, "at")), "repeats": F.count(F.lit(1)).over(W.partitionBy("class", "word")), "least": least})
    ranked = ranked.withColumn("repeats", F.max("repeats").over(W.partitionBy("class")))
    left = ranked.groupBy("class", "word", "n", "repeats").agg(F.min("rank").alias("rank"), F.first("least").alias("least"))
    once = left.withColumns({"rank": F.row_number().over(W.partitionBy("class").orderBy("rank")), "d": F.count(F.lit(1)).over(W.partitionBy("class"))})
    x = left.select("word", *[F.col(c).alias(f"a_{c}") for c in ("class", "n", "repeats", "rank", "least")])
    y = once.select("word", *[F.col(c).alias(f"b_{c}") for c in ("class", "n", "rank", "d", "least")])
    most = F.broadcast(left.agg(F.max("repeats").alias("most")))  # a row
    short_a = x.where(F.col("a_rank") <= F.col("a_n") - F.col("a_least") + 1).join(y, "word").where("a_n <= b_n")
    short_b = y.crossJoin(most).where(F.col("b_rank") <= F.col("b_d") - F.ceil(F.col("b_least") / F.col("most")) + 1).join(x, "word")
    short_b = short_b.where((F.col("a_n") > F.col("b_n")) & (F.col("b_rank") <= F.col("b_d") - F.ceil(F.col("b_least") / F.col("a_repeats")) + 1))
    near = short_a.select("a_class", "b_class").unionByName(short_b.select("a_class", "b_class")).distinct()
    wa, wb = (classes.select(F.col("class").alias(f"{s}_class"), F.col("w").alias(f"{s}_w"), F.col("n").alias(f"{s}_n")) for s in "ab")
    common = F.size(F.filter("a_w", lambda v: F.array_contains("b_w", v))).cast("long")
    alike = near.join(wa, "a_class").join(wb, "b_class").withColumn("common", common).where(F.col("common") >= share * F.least("a_n", "b_n")).select("a_class", "b_class", "common")
    return members.select("id", "class"), alike


def similar_questions(questions: DataFrame, share: float = 0.5, chunk: int = 256) -> DataFrame:
    """(a, b, common): pairs of questions (id, question) sharing half the words of the shorter, counted by occurrences in a.

    All pairs of ids are the result, and may be the square of the questions;
    similar_classes gives the same in classes. They are made last, from chunks
    of bounded size, so no class is one task.
    """
    members, alike = similar_classes(questions, share)
    held = members.groupBy(F.col("class").alias("_c")).agg(F.count(F.lit(1)).alias("held"))
    dealt = members.join(held, F.col("class") == F.col("_c")).withColumn("chunk", F.expr(f"pmod(xxhash64(id), ceil(held / {chunk}))"))
    ids = dealt.groupBy("class", "chunk").agg(F.collect_list("id").alias("ids"))
    a = ids.select(F.col("class").alias("a_class"), F.col("ids").alias("a_ids"), F.array_min("ids").alias("a_least"))
    b = ids.select(F.col("class").alias("b_class"), F.col("ids").alias("b_ids"), F.array_max("ids").alias("b_most"))
    tasks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as blocks are small beside their pairs
    blocks = alike.join(a, "a_class").join(b, "b_class").where("a_least < b_most").select("a_ids", "b_ids", "common").repartition(tasks, "a_ids", "b_ids")
    return blocks.select(F.explode("a_ids").alias("a"), "b_ids", "common").select("a", F.explode("b_ids").alias("b"), "common").where("a < b")


def diff_states(old: DataFrame, new: DataFrame, key: str = "file_path", value: str = "content_hash") -> DataFrame:
    """(key, change): added, changed, deleted or same, from two states."""
    o, n = old.select(F.col(key).alias("ok"), F.col(value).alias("ov")), new.select(F.col(key).alias("nk"), F.col(value).alias("nv"))
    change = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "deleted").when(F.col("ov").eqNullSafe(F.col("nv")), "same").otherwise("changed")
    return o.join(n, F.col("ok") == F.col("nk"), "full").select(F.coalesce("ok", "nk").alias(key), change.alias("change"))


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, action) from (id, hash): reuse pairs equal hashes one to one, embed has no old left, delete no new."""
    o = old.select(F.col("id").alias("old_id"), F.col("hash").alias("oh")).withColumn("orn", F.row_number().over(W.partitionBy("oh").orderBy("old_id")))
    n = new.select(F.col("id").alias("new_id"), F.col("hash").alias("nh")).withColumn("nrn", F.row_number().over(W.partitionBy("nh").orderBy("new_id")))
    action = F.when(F.col("new_id").isNull(), "delete").when(F.col("old_id").isNull(), "embed").otherwise("reuse")
    return o.join(n, (F.col("oh") == F.col("nh")) & (F.col("orn") == F.col("nrn")), "full").select("old_id", "new_id", action.alias("action"))


def memory_markdown(question: Column, answer: Column, tags: Column, status: Column, created: Column) -> Column:
    """An entry as a markdown document with front matter."""
    return F.concat(F.lit("---\nstatus: "), status, F.lit("\ntags: ["), F.array_join(tags, ", "), F.lit("]\ncreated: "), created.cast("string"), F.lit("\n---\n\n# "), question, F.lit("\n\n"), answer, F.lit("\n"))
