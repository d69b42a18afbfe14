"""robots.txt: parsing into rule rows, choice of the group, and verdicts by an equi-join on hosts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def texts_of(fetches: DataFrame) -> DataFrame:
    """fetches (host, status, body) of robots.txt -> (host, robots_txt): one that was not found or not reached (null) says
    nothing, so its host is open."""
    return fetches.select("host", F.when((F.col("status") < 400) & F.col("body").isNotNull(), F.col("body")).otherwise("").alias("robots_txt"))


def lines(texts: DataFrame) -> DataFrame:
    """(host, robots_txt) -> (host, line_no, field, value, is_agent): lines that say something."""
    raw = texts.select("host", F.posexplode(F.split("robots_txt", r"\r\n|\r|\n")).alias("line_no", "line"))
    raw = raw.withColumn("line", F.trim(F.split_part("line", F.lit("#"), F.lit(1)))).where(F.col("line").contains(":"))
    name = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    value = F.trim(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1))
    return raw.select("host", "line_no", name.alias("field"), value.alias("value")).withColumn("is_agent", F.col("field") == "user-agent")


def groups(texts: DataFrame) -> DataFrame:
    """The lines with group_no: an agent line that does not follow another one opens a group. Lines before it have 0."""
    by = Window.partitionBy("host").orderBy("line_no")
    said = lines(texts).withColumn("opens", F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(by), F.lit(False)))
    return said.withColumn("group_no", F.sum(F.col("opens").cast("int")).over(by)).drop("opens")


def chosen_groups(texts: DataFrame, user_agent: str) -> DataFrame:
    """(host, group_no): the first group with the longest agent token that is part of our name; else the last ``*``."""
    agents = groups(texts).where("is_agent").withColumn("token", F.lower("value"))
    own = F.when((F.col("token") != "*") & F.lit(user_agent.lower()).contains(F.col("token")), F.struct(F.length("token").alias("n"), (-F.col("group_no")).alias("g")))
    star = F.max(F.when(F.col("token") == "*", F.col("group_no")))
    best = agents.groupBy("host").agg(F.max(own).alias("own"), star.alias("star"))
    return best.select("host", F.coalesce(-F.col("own.g"), F.col("star")).alias("group_no")).where("group_no IS NOT NULL")


def pattern_regex(pattern: Column) -> Column:
    """``*`` is any run, a last ``$`` the end, all else itself; anchored at the start."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    body = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|#&~\-])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(ends, r"\z").otherwise(""))


def rules(texts: DataFrame, user_agent: str) -> DataFrame:
    """(host, allow, pattern, length, regex) of the chosen groups."""
    own = groups(texts).join(chosen_groups(texts, user_agent), ["host", "group_no"])
    own = own.where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return own.select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), F.length("value").alias("length"), pattern_regex(F.col("value")).alias("regex"))


def crawl_delays(texts: DataFrame, user_agent: str) -> DataFrame:
    """(host, crawl_delay): the last valid one of the chosen group."""
    own = groups(texts).join(chosen_groups(texts, user_agent), ["host", "group_no"]).where("field = 'crawl-delay'")
    own = own.withColumn("delay", F.expr("try_cast(value AS double)")).where("delay IS NOT NULL")
    return own.groupBy("host").agg(F.max_by("delay", "line_no").alias("crawl_delay"))


def can_fetch(urls: DataFrame, robot_rules: DataFrame) -> DataFrame:
    """urls (host, path, and more; path with its query) with allowed: the longest matching rule decides, allow wins ties,
    and without one all is allowed."""
    matched = urls.select("host", "path").distinct().join(robot_rules, "host").where(F.rlike("path", F.col("regex")))
    verdict = matched.groupBy("host", "path").agg(F.max_by("allow", F.struct("length", "allow")).alias("allowed"))
    return urls.join(verdict, ["host", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


@dataclass(frozen=True)
class Rules:
    """One host's rules, for fetchers: (allow, length of the pattern, expression) each."""

    rules: tuple[tuple[bool, int, re.Pattern], ...] = ()
    crawl_delay: float | None = None

    def can_fetch(self, path: str) -> bool:
        return max(((n, allow) for allow, n, regex in self.rules if regex.match(path)), default=(0, True))[1]


def parse(text: str, user_agent: str) -> Rules:
    """The rules for us in one robots.txt; the same choice as ``chosen_groups``."""
    found: list[tuple[list[str], list[tuple[str, str]]]] = []
    agents_open = False
    for line in text.splitlines():
        name, colon, value = (x.strip() for x in line.partition("#")[0].partition(":"))
        if not colon:
            continue
        if name.lower() == "user-agent":
            if not agents_open:
                found.append(([], []))
            found[-1][0].append(value.lower())
        elif found:
            found[-1][1].append((name.lower(), value))
        agents_open = name.lower() == "user-agent"
    own = [(len(a), -i) for i, (agents, _) in enumerate(found) for a in agents if a != "*" and a in user_agent.lower()]
    star = [i for i, (agents, _) in enumerate(found) if "*" in agents]
    if not own and not star:
        return Rules()
    said = found[-max(own)[1] if own else star[-1]][1]
    delay = None
    for name, value in said:
        if name == "crawl-delay":
            try:
                delay = float(value)
            except ValueError:
                pass
    return Rules(tuple((name == "allow", len(v), _regex(v)) for name, v in said if name in ("allow", "disallow") and v), delay)


def _regex(pattern: str) -> re.Pattern:
    body = ".*".join(map(re.escape, pattern.removesuffix("$").split("*")))
    return re.compile(body + (r"\Z" if pattern.endswith("$") else ""), re.DOTALL)
