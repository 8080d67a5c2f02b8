"""robots.txt as a table: rules per origin and agent, and the check of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.columns import as_column, strip
from linkloom.functions.urls import origin, path_and_query
from linkloom.operators.skew import skew_join


def access_policy(status: Column | str) -> Column:
    """What the status of the robots.txt fetch says: allow, deny or read the body.

    No status stands for a network error, which allows everything.
    """
    code = as_column(status)
    return (
        F.when(code.isNull(), "allow")
        .when(code.isin(401, 403) | (code >= 500), "deny")
        .when(code >= 400, "allow")
        .otherwise("body")
    )


def _unescaped(text: Column) -> Column:
    """Percent escapes decoded; text that is not valid stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


_RULE_FIELDS = ("allow", "disallow", "crawl-delay", "request-rate")


def robots_rules(robots: DataFrame) -> DataFrame:
    """Rules of readable robots.txt bodies (origin, status, body), in file order.

    A run of User-agent lines opens a group, the rules after it belong to it, and
    an empty line ends it. Rules outside a group and groups without rules do not
    count. One row per group and rule: origin, group_no, agents, rule_no, allow,
    path_prefix (null for rules on pace, which only keep their group alive).
    """
    value = F.substr("line", F.instr("line", ":") + 1)
    lines = (
        robots.filter(access_policy("status") == "body")
        .select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "raw"))
        .withColumn("line", strip(F.regexp_replace("raw", r"#.*", "")))
        .withColumn(
            "field",
            F.when(F.col("raw") == "", "blank").when(
                F.instr("line", ":") > 0, F.lower(strip(F.substring_index("line", ":", 1)))
            ),
        )
        .filter(F.col("field").isin("blank", "user-agent", *_RULE_FIELDS))
        .select("origin", "line_no", "field", _unescaped(strip(value)).alias("value"))
    )
    # One file per origin: these windows are bounded by the size of a robots.txt.
    in_file = Window.partitionBy("origin").orderBy("line_no")
    is_agent = F.col("field") == "user-agent"
    before = F.lag("field", 1, "blank").over(in_file)
    so_far = lambda condition: F.sum(condition.cast("int")).over(in_file)
    blocks = (
        lines.withColumn("opens", is_agent & (before != "user-agent"))
        .withColumn("group_no", so_far(F.col("opens")))
        .withColumn("blanks", so_far(F.col("field") == "blank"))
        .withColumn(
            "blanks_at_agent",
            F.last(F.when(is_agent, F.col("blanks")), ignorenulls=True).over(in_file),
        )
        .filter((F.col("field") != "blank") & (F.col("blanks") == F.col("blanks_at_agent")))
    )
    agents = (
        blocks.filter(is_agent)
        .groupBy("origin", "group_no")
        .agg(F.collect_set(F.lower("value")).alias("agents"))
    )
    on_path = F.col("field").isin("allow", "disallow")
    rules = blocks.filter(~is_agent).select(
        "origin",
        "group_no",
        F.col("line_no").alias("rule_no"),
        # An empty Disallow allows everything.
        F.when(on_path, (F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        F.when(on_path, F.col("value")).alias("path_prefix"),
    )
    return agents.join(rules, ["origin", "group_no"]).select(
        "origin", "group_no", "agents", "rule_no", "allow", "path_prefix"
    )


def agent_rules(robots: DataFrame, agent: str) -> DataFrame:
    """One row per origin: access policy and the ordered rules that bind ``agent``.

    The first group naming the agent counts, else the first group for ``*``. A
    group that lists ``*`` among others is a group for ``*``.
    """
    name = F.lit(agent.split("/")[0].lower())
    general = F.array_contains("agents", "*")
    named = ~general & F.exists("agents", lambda a: F.contains(name, a))
    groups = (
        robots_rules(robots)
        .filter(general | named)
        .groupBy("origin", "group_no")
        .agg(
            F.max(general).alias("general"),
            # The rules of one group of one file.
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("path_prefix").isNotNull(), F.struct("rule_no", "allow", "path_prefix")
                    )
                )
            ).alias("rules"),
        )
    )
    chosen = groups.groupBy("origin").agg(
        F.min_by("rules", F.struct("general", "group_no")).alias("rules")
    )
    return robots.select("origin", access_policy("status").alias("policy")).join(
        chosen, "origin", "left"
    )


def robots_allowed(urls: DataFrame, bound_rules: DataFrame, match: str = "first") -> DataFrame:
    """URLs with an ``allowed`` flag by the rules of ``agent_rules``.

    Prefixes are compared with path and query, without wildcards. ``match`` picks
    the first matching rule or the longest. Without a rule, a URL is allowed, as
    is one whose origin has no robots.txt. Hosts with very many URLs are spread.
    """
    path = _unescaped(path_and_query("url"))
    hits = F.filter(
        "rules", lambda r: (r["path_prefix"] == "*") | path.startswith(r["path_prefix"])
    )
    if match == "longest":
        hits = F.reverse(
            F.array_sort(
                F.transform(
                    hits, lambda r: F.struct(F.length(r["path_prefix"]).alias("n"), r["allow"].alias("allow"))
                )
            )
        )
    verdict = F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))
    joined = skew_join(
        urls.withColumn("origin", origin("url")), bound_rules, ["origin"], ["url"]
    )
    allowed = F.when(F.col("policy") == "deny", False).when(F.col("policy") == "body", verdict)
    return joined.withColumn("allowed", F.coalesce(allowed, F.lit(True))).select(
        *urls.columns, "allowed"
    )
