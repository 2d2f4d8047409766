"""Recorded robots rules against urls: the longest rule that a path begins with decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gated(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """url_id, host, path, allowed, rule (the prefix that decides; null: none does, which allows).

    urls: url_id (unique), url. rules: host (lower case), agent (lower case, or ``*``), allow, prefix. A host's rules for
    ``agent`` stand for themselves; where it has none, those for ``*`` count. The longest prefix wins; of an allowing and a
    forbidding rule of one prefix the allowing one. A rule with an empty prefix says nothing. A path is what follows the
    host, up to ``#``, with its query, and ``/`` where it is empty; urls without ``://`` have no host and are allowed.

    A path is cut to the lengths that its host's rules have, and each piece is looked up by (host, prefix): the work grows
    with the rules' lengths, not with their number, and no url meets a rule that does not fit it.
    """
    named = rules.where("prefix <> ''").withColumn("agent", F.lower("agent"))
    own = named.where(F.col("agent") == agent.lower()).select("host").distinct()
    mine = named.where(F.col("agent") == agent.lower()).unionByName(named.where("agent = '*'").join(own, "host", "left_anti"))
    table = mine.groupBy("host", "prefix").agg(F.max("allow").alias("allow"))
    lengths = table.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    path = F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    parts = urls.select("url_id", host.alias("host"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("path"))
    cuts = parts.join(lengths, "host").select("url_id", "host", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    met = cuts.select("url_id", "host", F.left("path", F.col("n")).alias("prefix"), "n").join(table, ["host", "prefix"])
    best = met.groupBy("url_id").agg(F.max_by(F.struct("allow", "prefix"), "n").alias("r"))
    out = parts.join(best, "url_id", "left")
    return out.select("url_id", "host", "path", F.coalesce("r.allow", F.lit(True)).alias("allowed"), F.col("r.prefix").alias("rule"))
