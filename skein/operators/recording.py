"""Batches of findings recorded beside what was recorded before: runs, readings, mentions, links, ideas, quotations.

Each function takes the recorded tables by name and a batch, and gives the tables after it, for the caller to write as
the next version (`skein.sources.states`). What is recorded stays as it is, so a batch that comes again, whole or in
part, changes nothing. Rows of a batch without their key are not recorded; of several rows of one key the least counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import dates
from skein.operators.merging import inserted
from skein.tables import broadcast_below, written

Tables = dict[str, DataFrame]
#: A broadcast list of subjects has no more rows than this.
SUBJECTS = 200_000


def extraction(recorded: Tables, attempts: DataFrame, items: DataFrame) -> Tables:
    """Runs over fragments of text: what could be placed exactly is evidence, the rest are candidates with their reasons.

    recorded: runs(run, status, attempts), evidence(run, item), candidates(run, item, reason, status).
    attempts(run, failure), items(run, item, reason; null where the item was placed). A run that succeeded is not tried
    again. One that failed is: its attempts are counted on, and its open candidates are discarded, as they come from an
    attempt that gave nothing. An attempt that fails leaves one candidate, with the failure as its reason, and no item.
    """
    tried = attempts.where("run is not null").groupBy("run").agg(F.bool_or(F.col("failure").isNull()).alias("worked"), F.min("failure").alias("failure"))
    # runs grow with the batch but are small in files, where a join would take millions of them for few and send them through the driver
    before = recorded["runs"].select("run", F.col("status").alias("was"), F.col("attempts").alias("so_far")).hint("merge")
    due = written(tried.join(before, "run", "left").where("was is null or was <> 'succeeded'"), "due-runs")
    done = due.select("run", F.when(F.col("worked"), "succeeded").otherwise("failed").alias("status"), (F.coalesce("so_far", F.lit(0)) + 1).alias("attempts"))
    placed = F.bool_or(F.col("reason").isNull())
    found = items.where("item is not null").groupBy("run", "item").agg(F.when(~placed, F.min("reason")).alias("reason"))
    found = written(found.join(due.where("worked").select("run").hint("merge"), "run"), "found-items")
    again = recorded["candidates"].join(due.select("run", F.lit(True).alias("again")).hint("merge"), "run", "left")
    status = F.when(F.col("again") & (F.col("status") == "open"), "discarded").otherwise(F.col("status"))
    none = F.lit(None).cast(recorded["candidates"].schema["item"].dataType)
    failed = due.where("not worked").select("run", none.alias("item"), F.col("failure").alias("reason"), F.lit("open").alias("status"))
    left = found.where("reason is not null").select("run", "item", "reason", F.lit("open").alias("status"))
    return {
        "runs": recorded["runs"].join(due.select("run").hint("merge"), "run", "left_anti").unionByName(done),
        "evidence": recorded["evidence"].unionByName(found.where("reason is null").select("run", "item")),
        "candidates": again.select("run", "item", "reason", status.alias("status")).unionByName(left).unionByName(failed),
    }


def readings(recorded: Tables, batch: DataFrame, subjects: DataFrame, days: dict[str, int]) -> Tables:
    """Readings of statements, the known subjects that they name, and a gap for each that names none of them.

    recorded: readings(statement, kind, admission, valid_until), placements(statement, subject), gaps(statement,
    missing). batch(statement, kind, admission, dated, named), named an array of subjects; subjects(subject, accepted).
    A subject that is not known and accepted places nothing; what the reading rejected leaves no gap. The gap says which
    names were not known.
    """
    rest = ["kind", "admission", "dated", "named"]
    once = batch.where("statement is not null").groupBy("statement").agg(F.min(F.struct(*rest)).alias("r")).select("statement", "r.*")
    once = written(once.withColumn("named", F.array_sort(F.array_distinct(F.array_compact("named")))), "readings")
    read = once.select("statement", "kind", "admission", dates.valid_until(F.col("dated"), F.col("kind"), days).alias("valid_until"))
    known = broadcast_below(subjects.where("accepted").select("subject").distinct(), SUBJECTS)
    placed = written(once.select("statement", F.explode("named").alias("subject")).join(known, "subject").select("statement", "subject"), "placements")
    missing = F.when(F.size("named") > 0, F.concat(F.lit("not known: "), F.array_join("named", ", "))).otherwise(F.lit("no subject named"))
    gaps = once.where("admission is distinct from 'rejected'").join(placed.select("statement"), "statement", "left_anti").select("statement", missing.alias("missing"))
    return {
        "readings": inserted(recorded["readings"], read, ["statement"], ["kind"]),
        "placements": inserted(recorded["placements"], placed, ["statement", "subject"], []),
        "gaps": inserted(recorded["gaps"], gaps, ["statement"], ["missing"]),
    }


def mentions(recorded: Tables, batch: DataFrame, read: DataFrame) -> Tables:
    """Entities that statements name, how they name them, and which statements were read, also those that name none.

    recorded: entities(kind, name), mentions(statement, kind, name, role, form), aliases(kind, name, alias),
    reads(statement). batch(statement, kind, name, role, form); read(statement). A form that differs from the name in
    more than case is an alias of the entity. Copies of a mention are one row before anything is shuffled for them.
    """
    once = batch.where("statement is not null and kind is not null and name is not null").groupBy("statement", "kind", "name", "role").agg(F.min("form").alias("form"))
    once = written(once, "mentions")
    other = once.where("lower(form) <> lower(name)").select("kind", "name", F.col("form").alias("alias"))
    return {
        "entities": inserted(recorded["entities"], once.select("kind", "name"), ["kind", "name"], []),
        "mentions": inserted(recorded["mentions"], once, ["statement", "kind", "name", "role"], ["form"]),
        "aliases": inserted(recorded["aliases"], other, ["kind", "name", "alias"], []),
        "reads": inserted(recorded["reads"], read.where("statement is not null").select("statement"), ["statement"], []),
    }


def links(recorded: Tables, judged: DataFrame) -> Tables:
    """Pairs that were judged: those with a link, and those left alone, so that they are not offered again.

    recorded: links(a, b, link, judge), alone(a, b, judge). judged(a, b, link; null where left alone, judge). A pair may
    have several links, and may be left alone by one batch and linked by another.
    """
    pairs = judged.where("a is not null and b is not null").select("a", "b", "link", "judge")
    return {
        "links": inserted(recorded["links"], pairs.where("link is not null"), ["a", "b", "link"], ["judge"]),
        "alone": inserted(recorded["alone"], pairs.where("link is null").select("a", "b", "judge"), ["a", "b"], ["judge"]),
    }


def ideas(recorded: Tables, members: DataFrame, least: int = 2) -> Tables:
    """Groups of statements as ideas, each with its verdict: admitted if enough different sources stand behind it.

    recorded: ideas(idea, statements, sources, unknown, admitted), evidence(idea, statement). members(part, statement,
    source). Ideas that are not admitted are recorded too. An idea's name is a digest of how many statements it has,
    their least and greatest, and a sum over their own digests, so a large group is never listed in one row; a group
    that comes again under another `part` is the same idea. Statements without a source count as unknown.
    """
    own = F.conv(F.left(F.sha2(F.col("statement").cast("string"), 256), F.lit(10)), 16, 10).cast("decimal(38,0)")
    once = written(members.where("part is not null and statement is not null").groupBy("part", "statement").agg(F.min("source").alias("source")), "members")
    # per source first: a large group's statements are merged before they meet in one task
    by_source = once.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("statement").alias("low"), F.max("statement").alias("high"), F.sum(own).alias("total"))
    whole = by_source.groupBy("part").agg(F.sum("n").alias("statements"), F.count("source").alias("sources"), F.coalesce(F.sum(F.when(F.col("source").isNull(), F.col("n"))), F.lit(0)).alias("unknown"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
    named = whole.withColumns({"idea": F.left(F.sha2(F.concat_ws(":", "statements", "low", "high", F.col("total").cast("string")), 256), F.lit(24)), "admitted": F.col("sources") >= least})
    named = written(named, "ideas")
    columns = ["idea", "statements", "sources", "unknown", "admitted"]
    new = named.join(recorded["ideas"].select("idea"), "idea", "left_anti")
    # one part of those that are the same idea
    first = new.groupBy("idea").agg(F.min(F.struct("part", *columns[1:])).alias("r")).select("idea", "r.*")
    evidence = once.join(first.select("part", "idea"), "part").select("idea", "statement")
    return {"ideas": recorded["ideas"].unionByName(first.select(*columns)), "evidence": recorded["evidence"].unionByName(evidence)}


#: Conditions of publication in the order in which they are told.
CONDITIONS = ("not an exact span", "provenance missing", "blocked", "longer than a paragraph", "figures changed")


def quotations(recorded: Tables, batch: DataFrame, language: str) -> Tables:
    """Quotations that clear all conditions are published, others wait in quarantine with each condition that they fail.

    recorded: published(claim, sources), quarantine(claim, condition, state). batch(claim, language, translated, exact,
    block, one_paragraph, figures, sources); figures is null where nothing was translated. A foreign quotation without
    a translation waits, which is no failure. There is one open entry a claim and condition; entries of published claims
    are closed, whichever batch made them. How many sources agree is told, not required. A claim's rows of one batch
    fail together; an unknown answer fails its condition.
    """
    fails = F.array_compact(F.array(
        F.when(~F.coalesce("exact", F.lit(False)), CONDITIONS[0]),
        F.when(F.col("block") == "provenance missing", CONDITIONS[1]),
        F.when(F.col("block") != "provenance missing", CONDITIONS[2]),
        F.when(~F.coalesce("one_paragraph", F.lit(False)), CONDITIONS[3]),
        F.when(~F.col("figures"), CONDITIONS[4]),
    ))
    rows = batch.where("claim is not null").join(recorded["published"].select("claim"), "claim", "left_anti")
    waits = ~F.col("language").eqNullSafe(F.lit(language)) & ~F.coalesce("translated", F.lit(False))
    rows = written(rows.select("claim", "sources", waits.alias("waits"), fails.alias("fails")), "decisions")
    ready = rows.where("not waits")
    failed = ready.select("claim", F.explode("fails").alias("condition")).distinct()
    clear = ready.groupBy("claim").agg(F.max(F.size("fails")).alias("fails"), F.min("sources").alias("sources")).where("fails = 0").select("claim", "sources")
    published = written(inserted(recorded["published"], clear, ["claim"], ["sources"]), "published")
    still = recorded["quarantine"].join(published.select("claim", F.lit(True).alias("out")), "claim", "left")
    state = F.when(F.col("out") & (F.col("state") == "open"), "closed").otherwise(F.col("state"))
    still = still.select("claim", "condition", state.alias("state"))
    new = failed.join(still.where("state = 'open'").select("claim", "condition"), ["claim", "condition"], "left_anti").withColumn("state", F.lit("open"))
    waiting = rows.groupBy("claim").agg(F.bool_and("waits").alias("waits")).where("waits").select("claim")
    return {"published": published, "quarantine": still.unionByName(new), "waiting": waiting}
