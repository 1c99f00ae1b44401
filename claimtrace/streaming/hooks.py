"""Editor hooks as streams: stateless, one decision per event, and a batch check of each saved document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimtrace.text.frames import analysed_documents, rows

GENERATED = r"(?:^|/)(?:results/[^/]+\.json|[^/]+\.sha256|build/.*|reporting/(?!.*\.recipe\.yaml$).*\.yaml)$"
SUBMISSION = r"(?i)\b(?:submit|submission)\b|\bgit\s+tag\b.*\bsubmi"
SHOWN = 6


def write_decision(path: Column) -> Column:
    """Whether an edit may go ahead: files that the analysis generates aren't edited by hand."""
    return F.when(path.rlike(GENERATED), "deny").otherwise("allow")


def is_submission(command: Column) -> Column:
    return command.rlike(SUBMISSION)


def guarded_writes(events: DataFrame) -> DataFrame:
    """A stream of file events (``path``) with decisions."""
    return events.withColumn("decision", write_decision(F.col("path")))


def loose_numbers(saved: DataFrame) -> DataFrame:
    """Of each saved document (``path, text``) how many numbers are loose, and the first of them."""
    found = rows(analysed_documents(saved), "atoms", "path").filter("kind = 'unclassified'")
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("start", "atom"))), lambda x: x["atom"]), 1, SHOWN).alias("first"))


def after_edit(saved: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Checks each batch of saved documents; ``handle`` gets what is loose."""
    return saved.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: handle(loose_numbers(batch))).start()


def before_submission(commands: DataFrame, check: Callable[[], DataFrame], handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """A stream of commands (``command``): for each batch in which one looks like a submission, all gates run once, and
    ``handle`` gets the failures beside the commands, which these deny."""

    def batch(rows: DataFrame, _: int) -> None:
        asked = rows.filter(is_submission(F.col("command")))
        if not asked.isEmpty():
            failed = check().filter("severity = 'fail'").agg(F.count(F.lit(1)).alias("n_failures"))
            handle(asked.crossJoin(F.broadcast(failed)).withColumn("decision", F.when(F.col("n_failures") > 0, "deny").otherwise("allow")))

    return commands.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
