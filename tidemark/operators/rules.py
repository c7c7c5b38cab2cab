"""A library of constraints: each gives its violations as rows (severity, check_name, row_key, message); see ``checks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.checks import violations
from tidemark.tables import small


def found(df: DataFrame, check: str, key: Column | str, message: Column | str, severity: str = "FAIL") -> DataFrame:
    """All rows of ``df`` as violations."""
    text = message if isinstance(message, Column) else F.lit(message)
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check_name"), (key if isinstance(key, Column) else F.col(key)).cast("string").alias("row_key"), text.alias("message"))


def least_rows(df: DataFrame, least: int, check: str, severity: str = "FAIL") -> DataFrame:
    """One violation if the table has fewer rows."""
    n = df.agg(F.count("*").alias("n"))
    return found(n.where(F.col("n") < least), check, F.lit("table"), F.concat(F.col("n").cast("string"), F.lit(f" rows, {least} at least")), severity)


def shrunk(now: DataFrame, before: DataFrame, check: str, share: float = 0.9, severity: str = "FAIL") -> DataFrame:
    """One violation if the table has fewer rows than ``share`` of those before."""
    x = now.agg(F.count("*").alias("n")).crossJoin(before.agg(F.count("*").alias("m")))  # one row each
    return found(x.where(F.col("n") < share * F.col("m")), check, F.lit("table"), F.format_string("%d rows after %d", "n", "m"), severity)


def header_count(header: DataFrame, rows: DataFrame, key: str, n: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Headers whose stated count is not that of their rows."""
    actual = rows.groupBy(key).agg(F.count("*").alias("_n"))
    x = header.select(key, n).join(actual, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return found(x.where(~F.col(n).eqNullSafe(F.col("_n"))), check, key, F.format_string("states %d, has %d", F.col(n).cast("long"), F.col("_n")), severity)


def required_if(df: DataFrame, check: str, key: str, when: Column, needed: list[str], severity: str = "FAIL") -> DataFrame:
    """Rows that meet ``when`` but lack a needed field (null or blank)."""
    lacks = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in needed]))
    x = df.where(when).withColumn("_lacks", lacks).where(F.size("_lacks") > 0)
    return found(x, check, key, F.concat(F.lit("lacks "), F.array_join("_lacks", ", ")), severity)


def forbidden_if(df: DataFrame, check: str, key: str, when: Column, barred: list[str], severity: str = "FAIL") -> DataFrame:
    """Rows that meet ``when`` and yet have a barred field."""
    has = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in barred]))
    x = df.where(when).withColumn("_has", has).where(F.size("_has") > 0)
    return found(x, check, key, F.concat(F.lit("may not have "), F.array_join("_has", ", ")), severity)


def date_order(df: DataFrame, check: str, key: str, first: str, last: str, as_of: str | None = None, severity: str = "FAIL") -> DataFrame:
    """Rows whose first date is after the last one, or after ``as_of``."""
    a, b = F.col(first).cast("date"), F.col(last).cast("date")
    future = F.coalesce(a > F.lit(as_of).cast("date"), F.lit(False)) if as_of else F.lit(False)
    return found(df.where(F.coalesce(a > b, F.lit(False)) | future), check, key, F.when(future, f"{first} in the future").otherwise(f"{first} after {last}"), severity)


def stale(df: DataFrame, check: str, key: str, day: str, as_of: str, warn: int, fail: int) -> DataFrame:
    """Rows not looked at for over ``warn`` days (WARN) or ``fail`` days (FAIL); without a date they fail."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(day).cast("date"))
    severity = F.when(age.isNull() | (age > fail), "FAIL").when(age > warn, "WARN")
    x = df.withColumn("_s", severity).where("_s is not null")
    return x.select(F.col("_s").alias("severity"), F.lit(check).alias("check_name"), F.col(key).cast("string").alias("row_key"), F.concat(F.coalesce(age.cast("string"), F.lit("no")), F.lit(" days")).alias("message"))


def group_share(rows: DataFrame, group: str, flag: Column, most: float, check: str, severity: str = "WARN") -> DataFrame:
    """Groups of which more than ``most`` is flagged: too many to be plausible."""
    x = rows.groupBy(group).agg(F.count("*").alias("_n"), F.count_if(flag).alias("_f")).where(F.col("_f") > most * F.col("_n"))
    return found(x, check, group, F.format_string("%d of %d", "_f", "_n"), severity)


def share_of_all(rows: DataFrame, group: str, most: float, check: str, severity: str = "FAIL") -> DataFrame:
    """Groups that hold more than ``most`` of all rows."""
    x = rows.groupBy(group).agg(F.count("*").alias("_n"))
    total = F.broadcast(x.agg(F.sum("_n").alias("_all")))  # one row
    return found(x.crossJoin(total).where(F.col("_n") > most * F.col("_all")), check, group, F.format_string("%d of %d", "_n", "_all"), severity)


def bounds(rows: DataFrame, table: DataFrame, name: str, value: str, key: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Values outside the range (lo, hi) that a small table gives their name; a name without a range fails too."""
    x = rows.join(small(table), name, "left")
    out = F.col("lo").isNull() | ~F.col(value).between(F.col("lo"), F.col("hi"))
    return found(x.where(out), check, key, F.when(F.col("lo").isNull(), "no range").otherwise("out of range"), severity)


def rederived(stored: DataFrame, derived: DataFrame, key: str, value: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Stored values that are not what the sources give when they are derived again; missing rows of either side too."""
    x = stored.select(key, F.col(value).alias("_s"), F.lit(True).alias("_a")).join(derived.select(key, F.col(value).alias("_d"), F.lit(True).alias("_b")), key, "full")
    bad = ~F.col("_s").eqNullSafe(F.col("_d")) | F.col("_a").isNull() | F.col("_b").isNull()
    message = F.when(F.col("_a").isNull(), "not stored").when(F.col("_b").isNull(), "not derived").otherwise("differs")
    return found(x.where(bad), check, key, message, severity)


def non_increasing(rows: DataFrame, group: str, place: str, value: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Ranked rows whose value is above the one before them."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(place))
    return found(rows.withColumn("_b", before).where(F.col(value) > F.col("_b")), check, F.concat_ws("/", group, place), "rises", severity)


def absent_months(rows: DataFrame, key: str, month: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Months without rows between a key's first and last."""
    ends = rows.groupBy(key).agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    wanted = ends.select(key, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias(month))
    gone = wanted.join(rows.select(key, month).distinct(), [key, month], "left_anti")
    return found(gone, check, F.concat_ws("/", key, F.date_format(month, "yyyy-MM")), "month without rows", severity)


def cap(rows: DataFrame, group: str, most: int, check: str, severity: str = "FAIL") -> DataFrame:
    """Groups with more than ``most`` rows."""
    return found(rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > most), check, group, F.format_string("%d rows", "_n"), severity)


def disjoint(a: DataFrame, b: DataFrame, key: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Keys that two lists that exclude each other both have."""
    return found(a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi"), check, key, "in both lists", severity)


def closed_fields(df: DataFrame, known: list[str], check: str, severity: str = "FAIL") -> DataFrame:
    """Columns that are none of the known ones."""
    unknown = [c for c in df.columns if c not in known]
    return found(df.sparkSession.createDataFrame([(c,) for c in unknown], "c string"), check, "c", "unknown field", severity)


def bag_shape(df: DataFrame, check: str, key: str, bag: str, severity: str = "FAIL") -> DataFrame:
    """Word bags that are not sorted or repeat a word."""
    words = F.split(bag, " ")
    return violations(df, check, key, F.array_join(F.array_sort(F.array_distinct(words)), " ") != F.col(bag), "not sorted and unique", severity)


def compared(stored: DataFrame, reference: DataFrame, key: str, value: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Stored values held against a reference: a key that it lacks is a warning, another value a violation. Rows only the reference has are none."""
    x = stored.select(key, F.col(value).alias("_s")).join(reference.select(key, F.col(value).alias("_r"), F.lit(True).alias("_there")), key, "left")
    absent = F.col("_there").isNull()
    bad = x.where(absent | ~F.col("_s").eqNullSafe(F.col("_r")))
    return bad.select(F.when(absent, "WARN").otherwise(severity).alias("severity"), F.lit(check).alias("check_name"), F.col(key).cast("string").alias("row_key"), F.when(absent, "no reference").otherwise("differs from the reference").alias("message"))


def dated(df: DataFrame, check: str, key: str, day: str, kind: str, past: list[str], future: list[str], as_of: str, severity: str = "FAIL") -> DataFrame:
    """Rows whose kind of date is none, whose past kinds lie after ``as_of`` or whose future ones before it."""
    d, now = F.col(day).cast("date"), F.lit(as_of).cast("date")
    message = F.when(~F.coalesce(F.col(kind).isin(past + future), F.lit(False)), "unknown kind of date").when(F.col(kind).isin(past) & (d > now), "in the future").when(F.col(kind).isin(future) & (d < now), "already past")
    return found(df.withColumn("_m", message).where("_m is not null"), check, key, F.col("_m"), severity)


def suppressed(df: DataFrame, barred: DataFrame, key: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Rows that a list of suppressed keys names and that are there nevertheless."""
    return found(df.join(barred.select(key).distinct(), key, "left_semi"), check, key, "suppressed, yet there", severity)


def cluster_members(df: DataFrame, key: str, cluster: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Rows whose cluster is not named after one of its own members, or that leave another's cluster nameless."""
    leads = df.select(F.col(key).alias("_lead"), F.col(cluster).alias("_own"))
    x = df.select(key, cluster).join(leads, F.col(cluster) == F.col("_lead"), "left")
    message = F.when(F.col(cluster).isNull(), "no cluster").when(F.col("_lead").isNull(), "its cluster's lead is not there").when(~F.col("_own").eqNullSafe(F.col(cluster)), "its cluster's lead is in another one")
    return found(x.withColumn("_m", message).where("_m is not null"), check, key, F.col("_m"), severity)


def figures_as_stated(df: DataFrame, check: str, key: str, value: str, disclosed: Column, severity: str = "FAIL") -> DataFrame:
    """Figures that are 0 where none is disclosed, or null where one is."""
    message = F.when(~disclosed & (F.col(value) == 0), "0 for a figure not disclosed").when(~disclosed & F.col(value).isNotNull(), "a figure not disclosed").when(disclosed & F.col(value).isNull(), "null for a figure")
    return found(df.withColumn("_m", message).where("_m is not null"), check, key, F.col("_m"), severity)


#: Months by name, which tell an index nothing.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def leaked_words(bags: DataFrame, check: str, key: str, bag: str, furniture: list[str], least: int = 6) -> DataFrame:
    """Bags that hold ``least`` words of a page's furniture or more (FAIL), or the name of a month (WARN)."""
    words = F.split(bag, " ")
    held = F.size(F.array_intersect(words, F.array(*map(F.lit, furniture))))
    month = F.get(F.array_intersect(words, F.array(*map(F.lit, MONTHS))), F.lit(0))
    x = bags.select(key, held.alias("_n"), month.alias("_m"))
    return found(x.where(F.col("_n") >= least), check, key, F.format_string("%d words of the furniture", "_n")).union(found(x.where("_m is not null"), check, key, F.concat(F.lit("names "), "_m"), "WARN"))


def most_bytes(df: DataFrame, text: str, most: int, check: str, severity: str = "FAIL") -> DataFrame:
    """One violation if the texts of a table are larger together."""
    n = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n"))
    return found(n.where(F.col("n") > most), check, F.lit("table"), F.format_string(f"%d bytes, {most} at most", "n"), severity)


def flags_and_shards(header: DataFrame, shards: DataFrame, key: str, flag: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Headers whose flag says otherwise than whether there are rows for them, and rows without a header."""
    x = header.select(key, F.coalesce(F.col(flag), F.lit(False)).alias("_f"), F.lit(True).alias("_h")).join(shards.select(key).distinct().withColumn("_s", F.lit(True)), key, "full")
    message = F.when(F.col("_h").isNull(), "rows without a header").when(F.col("_f") & F.col("_s").isNull(), "flagged, without rows").when(~F.col("_f") & F.col("_s").isNotNull(), "has rows, not flagged")
    return found(x.withColumn("_m", message).where("_m is not null"), check, key, F.col("_m"), severity)


def comparable(groups: DataFrame, members: DataFrame, key: str, stated: str, check: str) -> DataFrame:
    """Groups whose stated number of members is not theirs (FAIL), and those of one member, which compare with nothing (WARN)."""
    single = members.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1")
    return header_count(groups, members, key, stated, check).union(found(single, check, key, "a single one", "WARN"))


def required_by_type(df: DataFrame, check: str, key: str, kind: str, needed: dict[str, list[str]], severity: str = "FAIL") -> DataFrame:
    """Rows of an unknown type, and rows that lack a field (null or blank) that their type needs."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    lacks = F.array_compact(F.array(*[F.when((F.col(kind) == t) & blank(c), F.lit(c)) for t, fields in needed.items() for c in fields]))
    message = F.when(~F.coalesce(F.col(kind).isin(list(needed)), F.lit(False)), "unknown type").when(F.size("_lacks") > 0, F.concat(F.lit("lacks "), F.array_join("_lacks", ", ")))
    return found(df.withColumn("_lacks", lacks).withColumn("_m", message).where("_m is not null"), check, key, F.col("_m"), severity)


def link_rules(df: DataFrame, check: str, key: str, url: str, inside: Column, hosts: list[str], severity: str = "FAIL") -> DataFrame:
    """Links inside that are no path of their own site, and others that are not https on one of ``hosts`` or their subdomains. Null links break no rule."""
    path = F.col(url).rlike("^/(?!/)")
    host = F.regexp_extract(url, "^https://([^/?#:]+)", 1)
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (host == h) | host.endswith(f".{h}")
    message = F.when(F.col(url).isNull(), F.lit(None)).when(inside & ~path, "not a path").when(~inside & (host == ""), "not https").when(~inside & ~allowed, F.concat(F.lit("links to "), host))
    return found(df.withColumn("_m", message).where("_m is not null"), check, key, F.col("_m"), severity)


def rival_lists(df: DataFrame, check: str, key: str, own: str, items: str, severity: str = "FAIL") -> DataFrame:
    """Lists that are empty, name their owner, or name one with the owner's first word: a company is not its own rival."""
    root = lambda c: F.get(F.split(F.lower(c), "[^a-z0-9]+"), F.lit(0))
    message = F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "empty list").when(F.array_contains(items, F.col(own)), "names its owner").when(F.exists(items, lambda i: root(i) == root(F.col(own))), "names its owner's group")
    return found(df.withColumn("_m", message).where("_m is not null"), check, key, F.col("_m"), severity)


def alias_steals(before: DataFrame, after: DataFrame, alias: str, owner: str, check: str, severity: str = "FAIL") -> DataFrame:
    """Aliases that only other owners hold now than before, while one that lost them is still there: they were taken, not moved with a merger."""
    was, now = before.select(F.col(alias).alias("_a"), F.col(owner).alias("_was")).distinct(), after.select(F.col(alias).alias("_a"), F.col(owner).alias("_now")).distinct()
    lost = was.join(now, (was._a == now._a) & (F.col("_was") == F.col("_now")), "left_anti")
    taken = lost.join(now, "_a").join(now.select(F.col("_now").alias("_was")).distinct(), "_was", "left_semi").groupBy("_a").agg(F.min("_was").alias("_was"), F.min("_now").alias("_now"))
    return found(taken, check, "_a", F.concat(F.lit("taken from "), "_was", F.lit(" by "), "_now"), severity)


def malformed_names(df: DataFrame, check: str, key: str, name: str, severity: str = "FAIL") -> DataFrame:
    """Names without a letter, with markup left in, blanks at the ends or doubled, brackets that do not pair, or a mark at the end."""
    x = F.col(name)
    pairs = F.length(F.regexp_replace(x, r"[^(]", "")) != F.length(F.regexp_replace(x, r"[^)]", ""))
    message = F.when(~F.coalesce(x.rlike("[A-Za-z]"), F.lit(False)), "no letter").when(x.rlike("&[a-z]+;|<[^>]*>"), "markup").when(x.rlike(r"^ | $|  "), "odd blanks").when(pairs, "brackets").when(x.rlike("[,;:/-]$"), "a mark at its end")
    return found(df.withColumn("_m", message).where("_m is not null"), check, key, F.col("_m"), severity)


def vocabulary_ratchet(counts: DataFrame, baseline: DataFrame, measure: str, n: str, check: str) -> DataFrame:
    """Counts of offenders against a baseline: a rise fails, a fall and standing still warn; a measure without a baseline was cleared and fails at one."""
    x = counts.select(measure, F.col(n).alias("_n")).join(baseline.select(measure, F.col(n).alias("_b")), measure, "left")
    severity = F.when(F.col("_b").isNull(), F.when(F.col("_n") > 0, "FAIL")).when(F.col("_n") > F.col("_b"), "FAIL").otherwise("WARN")
    message = F.when(F.col("_b").isNull(), F.format_string("%d, cleared before", "_n")).when(F.col("_n") > F.col("_b"), F.format_string("rose from %d to %d", "_b", "_n")).when(F.col("_n") < F.col("_b"), F.format_string("fell from %d to %d", "_b", "_n")).otherwise(F.format_string("%d as before", "_n"))
    return x.withColumn("_s", severity).where("_s is not null").select(F.col("_s").alias("severity"), F.lit(check).alias("check_name"), F.col(measure).cast("string").alias("row_key"), message.alias("message"))
