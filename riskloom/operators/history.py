"""Change-history features per commit, each as one set-based job.

``changes`` has one row per commit and file: project, commit_id, author, day, path and the
columns a function names. History means earlier days, and earlier commits of the same day
by commit id. Running counts are chunked by day and range of commit ids, so neither a busy
file nor a busy author meets in one task, not even on one day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions.numeric import ratio_or_null
from riskloom.operators import scans as sc
from riskloom.operators import tables as tb
from riskloom.operators import windows as wn
from riskloom.session import settle

COMMIT = ["project", "commit_id"]
FILE = ["project", "path"]
AUTHOR = ["project", "author"]
LISTED = 512  # authors of a file that are kept as numbers before bitmaps set in
SHORT_FILE, SHORT_AUTHOR = LISTED, 10_000  # changes of a key up to which one window holds its history
RECENT_DAYS = 90


def commits_of(changes: DataFrame) -> DataFrame:
    return changes.select("project", "commit_id", "author", "day").distinct()


def _split(changes: DataFrame, keys: list[str], most: int, label: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key has at most ``most`` of them, with a hash ``_key`` of the key, and the other rows, if any.

    Keys are counted by their hash, so that keys that share one only count as longer than they are.
    """
    rows = changes.withColumn("_key", F.xxhash64(*keys))
    long = settle(rows.groupBy("_key").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > most).select("_key"), label)
    if long.isEmpty():
        return rows, None
    return rows.join(long, "_key", "left_anti"), rows.join(long, "_key", "left_semi").drop("_key")


def with_file_runs(changes: DataFrame, rows: int, windows: Sequence[int] = (30, 90, 180), most: int = SHORT_FILE) -> DataFrame:
    """``changes``, about ``rows`` of them, with what their file had before, written commit by commit.

    ``age``, ``previous_size``, ``developers`` and ``file_history_features`` then read the columns
    and shuffle nothing by file. A file with at most ``most`` changes has all of them from one
    sort; its windows begin with a hash of the file, which sorts without comparing paths.
    Files with more go through the operators that cut a file into chunks, and have no ``authors``.
    """
    short, long = _split(changes, FILE, most, "long-files")
    none = F.lit(-(1 << 31))
    short = tb.dealt(short.withColumns({"_d": F.unix_date("day"), "_event": F.coalesce(F.col("flagged") == 1, F.lit(False))}), rows, "_key")
    file = Window.partitionBy("_key", "path", "project")
    in_order, by_day = file.orderBy("_d", "commit_id"), file.orderBy("_d")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumns(
        {
            "size_before": F.coalesce(F.sum(F.col("added") - F.col("deleted")).over(before), F.lit(0)),
            "authors": F.collect_set(F.struct("author")).over(in_order),  # rows of one commit all see each other
            "_seen": F.max(F.when(F.col("_event"), F.coalesce("_d", none))).over(before),
        }
    )
    first_event = F.col("_event") & F.coalesce(F.col("_seen") < F.coalesce("_d", none), F.lit(True))
    earlier = by_day.rangeBetween(Window.unboundedPreceding, -1)
    same_day = F.col("commit_id") > F.min("commit_id").over(by_day.rangeBetween(0, 0))
    marked = short.withColumn("_first", first_event.cast("int"))
    short = marked.select(
        *changes.columns,
        "size_before",
        F.col("authors.author").alias("authors"),
        F.lit(False).alias("long"),
        F.when(same_day, F.col("day")).otherwise(F.max("day").over(earlier)).alias("previous_day"),
        F.coalesce(F.sum("_first").over(earlier), F.lit(0)).alias("count_ever"),
        F.max(F.when(F.col("_event"), F.col("day"))).over(earlier).alias("last_day"),
        *[F.coalesce(F.sum("_first").over(by_day.rangeBetween(-(n - 1), -1)), F.lit(0)).alias(f"count_{n}d") for n in windows],
    )
    if long is not None:
        sized = wn.history_counts(long, FILE, ["commit_id"], {"size_before": F.col("added") - F.col("deleted")}, include_current=False)
        keys = [*FILE, "day"]
        keyless = sized.filter(" OR ".join(f"{k} IS NULL" for k in keys))
        dated = wn.previous_change_day(sized, FILE, ["commit_id"]).unionByName(keyless, allowMissingColumns=True)
        counted = dated.join(wn.past_event_counts(long, long.filter("flagged = 1"), FILE, windows), keys, "left")
        short = short.unionByName(counted.withColumn("long", F.lit(True)), allowMissingColumns=True)
    return settle(tb.dealt(short, rows, "commit_id"), "file-runs")


def with_author_runs(changes: DataFrame, rows: int, most: int = SHORT_AUTHOR) -> DataFrame:
    """What the author of each commit had done before, from about ``rows`` changes, written.

    A row has ``exp`` and ``rexp`` of a commit, or ``earlier`` of a commit and top directory;
    ``experience``, ``recent_experience`` and ``subsystem_experience`` read them. Authors with at most
    ``most`` changes are sorted whole, the others go through the operators that cut an author into chunks.
    """
    columns = [*COMMIT, "author", "day"]
    short, long = _split(changes.select(*columns, "path"), AUTHOR, most, "long-authors")
    # days of a year follow each other, and years lie further apart than any frame reaches
    day = (F.unix_date("day") + F.year("day") * 1000).alias("_d")
    author = Window.partitionBy("_key", "author", "project")
    in_order, by_day = author.orderBy("_d", "commit_id"), author.orderBy("_d")
    within = lambda a, b: F.count("*").over(by_day.rangeBetween(a, b))
    commits = short.select("_key", *columns).distinct().select("*", day)
    runs = tb.dealt(commits, rows, "_key").withColumn("exp", (F.row_number().over(in_order) - 1).cast("bigint"))
    recent = within(-RECENT_DAYS, -1) + within(-1000 - RECENT_DAYS, -1001) / 2.0 + F.col("exp") - within(Window.unboundedPreceding, -1)
    known = F.col("project").isNotNull() & F.col("author").isNotNull() & F.col("day").isNotNull()
    runs = runs.select(*COMMIT, "exp", F.when(known, recent).alias("rexp"))

    touched = short.filter(F.contains("path", F.lit("/"))).select("_key", *columns, tx.top_directory("path").alias("subsystem"))
    of_subsystem = Window.partitionBy("_key", "author", "project", "subsystem").orderBy("_d", "commit_id")
    earlier = (F.row_number().over(of_subsystem) - 1).cast("bigint").alias("earlier")
    runs = runs.unionByName(tb.dealt(touched, rows, "_key").distinct().select("*", day).select(*COMMIT, earlier), allowMissingColumns=True)
    if long is not None:
        for part in (experience(long), recent_experience(long), _subsystem_runs(long).select(*COMMIT, "earlier")):
            runs = runs.unionByName(part, allowMissingColumns=True)
    return settle(runs, "author-runs")


def spread(changes: DataFrame) -> DataFrame:
    """Files, top directories and directories a commit touches.

    Directories nest in top directories, so two small group-bys count all three.
    """
    top = F.when(F.contains("path", F.lit("/")), tx.top_directory("path")).otherwise(F.col("path"))
    dirs = changes.groupBy(*COMMIT, top.alias("_top"), tx.parent_directory("path").alias("_dir")).agg(F.countDistinct("path").alias("_files"))
    tops = dirs.groupBy(*COMMIT, "_top").agg(F.sum("_files").alias("_files"), F.max((F.col("_dir") == "").cast("int")).alias("_bare"), F.count_if(F.col("_dir") != "").alias("_dirs"))
    return tops.groupBy(*COMMIT).agg(
        F.sum("_files").alias("files_changed"),
        F.count("*").alias("subsystems_changed"),
        (F.sum("_dirs") + F.max("_bare")).alias("directories_changed"),
    )


def file_count(changes: DataFrame) -> DataFrame:
    return changes.select(*COMMIT, "path").distinct().groupBy(*COMMIT).agg(F.count("*").alias("nuc"))


def past_fixes(changes: DataFrame) -> DataFrame:
    """Repair changes of the touched files up to and with this one."""
    run = wn.history_counts(changes, FILE, ["commit_id"], {"_fixes": F.col("is_fix")})
    return run.groupBy(*COMMIT).agg(F.sum("_fixes").alias("past_bug_fixes"))


def _author_numbers(authors: DataFrame) -> DataFrame:
    """Authors of each project numbered from 1, in the order of a hash that also cuts them into chunks."""
    hashed = authors.withColumn("_h", F.md5(F.col("author").cast("string")))
    return sc.running_totals(hashed, ["project"], F.substring("_h", 1, 3), ["_h", "author"], {"_no": F.lit(1).cast("long")}).drop("_h")


def developers(changes: DataFrame, listed: int = LISTED) -> DataFrame:
    """Distinct authors of the touched files up to and with this commit.

    Only an author's first change of a file matters. A file with at most ``listed`` authors is one
    row with their first changes, of which a commit reads those up to its own; its developers
    are the union over its files. Files with more authors are scanned in chunks and their
    authors are kept as bitmaps of 32,768 authors each. No commit is joined with authors: a commit
    adds one list, or one bitmap per 32,768 authors, for each file it touches.
    """
    at = ["day", "commit_id"]
    union = F.size(F.array_distinct(F.flatten(F.collect_list("_list")))).cast("long")
    everything, listed_rows = changes, None
    if "authors" in changes.columns:
        known = changes.dropna(subset=FILE)
        listed_rows = known.filter("NOT long").select(*FILE, *at, F.col("authors").alias("_list"))
        changes = known.filter("long")
        if changes.isEmpty():
            return listed_rows.groupBy(*COMMIT).agg(union.alias("ndev"))
    changes = settle(changes.select(*FILE, *at, "author").distinct(), "developers-changes")
    first = settle(changes.groupBy(*FILE, "author").agg(F.min(F.struct(*at)).alias("_at")).select(*FILE, "_at.*", "author"), "developers-first")
    busy = settle(first.groupBy(*FILE).agg((F.count("*") > listed).alias("_busy")).filter("_busy"), "developers-busy")

    by_file = first.join(busy, FILE, "left_anti").groupBy(*FILE).agg(F.collect_list(F.struct(*at, "author")).alias("_met"))
    earlier = F.filter("_met", lambda e: F.struct(e["day"], e["commit_id"]) <= F.struct(*at))
    rows = changes.drop("author").join(by_file, FILE).select(*FILE, *at, F.transform(earlier, lambda e: e["author"]).alias("_list"))

    order = [F.asc("day"), F.asc("commit_id"), F.desc("_new")]  # a first change comes before the commit's own row
    marks = first.withColumn("_new", F.lit(1)).unionByName(changes.drop("author").withColumn("_new", F.lit(0)), allowMissingColumns=True)
    marks = sc.in_ranges(marks.join(busy, FILE), FILE, order, "developers-marks")
    marks = settle(sc.prefix_scan(marks, FILE, order, {"_n": ("sum", F.col("_new").cast("long"))}), "developers-counted")

    rows = rows if listed_rows is None else rows.unionByName(listed_rows)
    asked = rows.unionByName(marks.filter("_new = 0"), allowMissingColumns=True)
    per = asked.groupBy(*COMMIT).agg(F.count("*").alias("_files"), F.max("_n").alias("_n"), union.alias("_union"), F.max("_busy").alias("_busy"))
    plain = per.filter("_files = 1 OR _busy IS NULL").select(*COMMIT, F.coalesce("_n", "_union").alias("ndev"))
    hard = asked.join(per.filter("_files > 1 AND _busy").select(*COMMIT), COMMIT, "left_semi")
    met = first if listed_rows is None else everything
    numbers = _author_numbers(met.join(busy.select("project").distinct(), "project", "left_semi").select(*AUTHOR).distinct())
    return plain.unionByName(_busy_developers(marks.filter("_new = 1"), hard, numbers, order))


def _busy_developers(new: DataFrame, asked: DataFrame, numbers: DataFrame, order: list[Column]) -> DataFrame:
    """``ndev`` of commits with several files of which one has many authors, by bitmaps of author numbers.

    ``new`` has the first changes of files with many authors, ``asked`` all files of the commits.
    Of each file a commit takes two bitmaps: authors of its own chunk so far, and those of all
    chunks before, which are merged once per chunk.
    """
    bucket, bits = F.bitmap_bucket_number("_no"), F.bitmap_construct_agg(F.bitmap_bit_position("_no"))
    new = new.join(numbers, AUTHOR).withColumn("_bucket", bucket).drop("author")
    last = numbers.groupBy("project").agg(F.max(bucket).alias("_last"))
    probes = asked.filter("_busy").drop("author", "_list").join(last, "project")
    probes = probes.withColumn("_bucket", F.explode(F.sequence(F.lit(1).cast("long"), "_last"))).drop("_last")
    place = [*FILE, "_bucket"]
    so_far = Window.partitionBy(*place, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = new.unionByName(probes.withColumn("_no", F.lit(None).cast("long"))).withColumn("_bits", bits.over(so_far)).filter("_new = 0")
    stops = probes.select(*place, "_chunk").distinct().unionByName(new.select(*place, "_chunk", "_no"), allowMissingColumns=True)
    stops = stops.groupBy(*place, "_chunk").agg(bits.alias("_bits"))
    earlier = Window.partitionBy(*place).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = probes.join(stops.withColumn("_bits", F.bitmap_or_agg("_bits").over(earlier)), [*place, "_chunk"])
    loose = asked.filter("_busy IS NULL").select(*COMMIT, F.explode("_list").alias("author")).distinct().join(numbers, AUTHOR)
    loose = loose.groupBy(*COMMIT, bucket.alias("_bucket")).agg(bits.alias("_bits"))
    met = loose.unionByName(inside.select(*loose.columns)).unionByName(before.select(*loose.columns))
    return met.groupBy(*COMMIT, "_bucket").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_c")).groupBy(*COMMIT).agg(F.sum("_c").alias("ndev"))


def age(changes: DataFrame) -> DataFrame:
    """Mean days since the previous change of each file; 0 without one."""
    if "previous_day" in changes.columns:
        prev = changes.dropna(subset=[*FILE, "day"])
    else:
        prev = wn.previous_change_day(changes.select(*COMMIT, "path", "day"), FILE, ["commit_id"])
    gap = F.avg(F.datediff("day", "previous_day"))
    return prev.groupBy(*COMMIT).agg(F.coalesce(gap, F.lit(0.0)).alias("age"))


def experience(changes: DataFrame) -> DataFrame:
    """The author's earlier commits."""
    if "exp" in changes.columns:
        return changes.filter("exp IS NOT NULL").select(*COMMIT, "exp")
    return wn.history_counts(commits_of(changes), AUTHOR, ["commit_id"], {"exp": F.lit(1)}, include_current=False).select(*COMMIT, "exp")


def _in_day_rank(commits: DataFrame, keys: list[str]) -> DataFrame:
    return wn.running_totals(commits, [*keys, "day"], wn.order_range(commits, "commit_id"), ["commit_id"], {"_nth": F.lit(1)})


def recent_experience(changes: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """The author's earlier commits of the last ``days`` days, each weighted 1 / (1 + years apart)."""
    if "rexp" in changes.columns and days == RECENT_DAYS:
        return changes.filter("rexp IS NOT NULL").select(*COMMIT, "rexp")
    commits = commits_of(changes)
    daily = commits.groupBy(*AUTHOR, "day").agg(F.count("*").alias("_n")).withColumn("_year", F.year("day"))
    everything = wn.by_day_number(AUTHOR).rangeBetween(-days, -1)
    same_year = wn.by_day_number([*AUTHOR, "_year"]).rangeBetween(-days, -1)
    total, same = F.coalesce(F.sum("_n").over(everything), F.lit(0)), F.coalesce(F.sum("_n").over(same_year), F.lit(0))
    past = daily.withColumn("_past", same + (total - same) / 2.0).select(*AUTHOR, "day", "_past")
    rows = _in_day_rank(commits, AUTHOR).join(past, [*AUTHOR, "day"])
    return rows.select(*COMMIT, (F.col("_past") + F.col("_nth") - 1).alias("rexp"))


def _subsystem_runs(changes: DataFrame) -> DataFrame:
    rows = changes.filter(F.contains("path", F.lit("/"))).select(*COMMIT, "author", "day", tx.top_directory("path").alias("subsystem")).distinct()
    return wn.history_counts(rows, [*AUTHOR, "subsystem"], ["commit_id"], {"earlier": F.lit(1)}, include_current=False)


def subsystem_experience(changes: DataFrame) -> DataFrame:
    """Most earlier commits of the author in any one of the touched top directories."""
    run = changes.filter("earlier IS NOT NULL") if "earlier" in changes.columns else _subsystem_runs(changes)
    return run.groupBy(*COMMIT).agg(F.max("earlier").alias("sexp"))


def previous_size(changes: DataFrame) -> DataFrame:
    """Lines the touched files had before, from the running balance of added and deleted lines."""
    run = changes
    if "size_before" not in changes.columns:
        balance = F.col("added") - F.col("deleted")
        run = wn.history_counts(changes, FILE, ["commit_id"], {"size_before": balance}, include_current=False)
    return run.groupBy(*COMMIT).agg(F.sum(F.greatest("size_before", F.lit(0))).alias("total_prev_loc"))


def days_since_creation(changes: DataFrame) -> DataFrame:
    born = changes.groupBy(*FILE).agg(F.min("day").alias("_born"))
    return changes.join(born, FILE).groupBy(*COMMIT).agg(F.avg(F.datediff("day", "_born")).alias("mean_days_since_creation"))


def past_changes(changes: DataFrame) -> DataFrame:
    run = wn.history_counts(changes, FILE, ["commit_id"], {"_n": F.lit(1)}, include_current=False)
    return run.groupBy(*COMMIT).agg(F.avg("_n").alias("mean_past_changes"))


def _trailing(commits: DataFrame, keys: list[str], days: int, name: str) -> DataFrame:
    daily = commits.groupBy(*keys, "day").agg(F.count("*").alias("_n"))
    return daily.select(*keys, "day", F.sum("_n").over(wn.by_day_number(keys).rangeBetween(-days, 0)).alias(name))


def author_share(changes: DataFrame, days: int = 30) -> DataFrame:
    """The author's share of all commits so far, and of those of the last ``days`` days."""
    commits = commits_of(changes)
    run = wn.history_counts(commits, AUTHOR, ["commit_id"], {"_own": F.lit(1)}, include_current=False)
    run = wn.history_counts(run, ["project"], ["commit_id"], {"_all": F.lit(1)})
    recent = run.join(_trailing(commits, AUTHOR, days, "_own_recent"), [*AUTHOR, "day"]).join(_trailing(commits, ["project"], days, "_all_recent"), ["project", "day"])
    return recent.select(*COMMIT, ratio_or_null("_own", "_all").alias("share_ever"), ratio_or_null("_own_recent", "_all_recent").alias("share_recent"))


def recent_commits(changes: DataFrame, days: int = 30) -> DataFrame:
    """Commits of the project and of the author in the last ``days`` days."""
    commits = commits_of(changes)
    out = commits.join(_trailing(commits, ["project"], days, "commits_recent"), ["project", "day"])
    return out.join(_trailing(commits, AUTHOR, days, "author_recent"), [*AUTHOR, "day"]).select(*COMMIT, "commits_recent", "author_recent")


def project_age(changes: DataFrame) -> DataFrame:
    commits = commits_of(changes)
    start = commits.groupBy("project").agg(F.min("day").alias("_start"))
    return commits.join(start, "project").select(*COMMIT, F.datediff("day", "_start").alias("days_after_creation"))


def numbered_revisions(changes: DataFrame) -> DataFrame:
    """Each file's changes numbered from 1, oldest first."""
    rows = changes.select(*FILE, "commit_id", "day")
    return wn.history_counts(rows, FILE, ["commit_id"], {"position": F.lit(1)})


def revision_positions(changes: DataFrame) -> DataFrame:
    """``position`` of every change in its file, oldest first, and the ``previous_commit`` of the file.

    The earlier revisions of any change are the positions below its own, so this answers for all
    of them with one row each. Positions meet their successors by a key, whatever file is busy.
    """
    here = F.col("commit_id")
    none = F.when(F.lit(False), here)  # null of the same type
    own = F.struct(F.col("position").alias("position"), here.alias("commit_id"), none.alias("previous_commit"))
    following = F.struct((F.col("position") + 1).alias("position"), none.alias("commit_id"), here.alias("previous_commit"))
    both = numbered_revisions(changes).select(*FILE, F.inline(F.array(own, following)))
    return both.groupBy(*FILE, "position").agg(F.max("commit_id").alias("commit_id"), F.max("previous_commit").alias("previous_commit")).filter("commit_id IS NOT NULL")


def earlier_revisions(changes: DataFrame, probes: DataFrame | None = None, most_rows: int | None = None) -> DataFrame:
    """Earlier changes of the file of each probe, oldest first, as rows.

    ``probes`` has project, path and commit_id; without it every file is asked for as of its
    latest change, so the output is linear in the input. Several probes of a file each list all
    before them, which grows with the square of its changes: a list that would give more than
    ``most_rows`` rows is refused. ``revision_positions`` answers for all changes at once.
    """
    numbered = numbered_revisions(changes)
    if probes is None:
        last = numbered.groupBy(*FILE).agg(F.max("position").alias("_at"), F.max_by("commit_id", "position").alias("probe_commit"))
    else:
        last = probes.join(numbered, [*FILE, "commit_id"]).select(*FILE, F.col("position").alias("_at"), F.col("commit_id").alias("probe_commit"))
    if most_rows is not None and (last.agg(F.sum(F.col("_at") - 1)).first()[0] or 0) > most_rows:
        raise ValueError("the probes have more earlier revisions than most_rows")
    return numbered.join(last, FILE).filter("position < _at").select(*FILE, "probe_commit", "position", "commit_id")


def commit_window(commits: DataFrame, start: Column, end: Column) -> DataFrame:
    """Commits of a date window, oldest first."""
    return commits.filter(F.col("day").between(start, end)).orderBy("day", "commit_id")
