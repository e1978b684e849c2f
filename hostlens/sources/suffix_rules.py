"""Public suffix rules as a small lookup table."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits of `kind`; one text can carry several.
PLAIN, WILDCARD, EXCEPTION = 1, 2, 4
_LIST_IN_JAR = "mozilla/public-suffix-list.txt"
_END_OF_ICANN = "===END ICANN DOMAINS==="
MAX_RULES = 100_000


@lru_cache(maxsize=1)
def _bundled_lines() -> tuple[str, ...]:
    """The public suffix list that Spark's own HTTP client jar carries."""
    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    for home in filter(None, homes):
        for jar in sorted(glob.glob(os.path.join(home, "jars", "httpclient-*.jar"))):
            with zipfile.ZipFile(jar) as z:
                if _LIST_IN_JAR in z.namelist():
                    return tuple(z.read(_LIST_IN_JAR).decode("utf-8").splitlines())
    raise FileNotFoundError("no public suffix list found in Spark's jars; pass a path to one")


def parse_rules(lines, include_private: bool = False) -> dict[str, int]:
    """Rule text in DNS (ASCII) form -> kind bits; the private section only on request."""
    rules: dict[str, int] = {}
    for line in lines:
        if not include_private and _END_OF_ICANN in line:
            break
        rule = line.split(" ")[0].strip().lower()
        if not rule or rule.startswith("//"):
            continue
        kind = PLAIN
        if rule.startswith("!"):
            kind, rule = EXCEPTION, rule[1:]
        elif rule.startswith("*."):
            kind, rule = WILDCARD, rule[2:]
        try:
            rule = rule.encode("idna").decode("ascii")
        except UnicodeError:
            continue
        rules[rule] = rules.get(rule, 0) | kind
    return rules


@lru_cache(maxsize=4)
def _bundled(include_private: bool) -> dict[str, int]:
    return parse_rules(_bundled_lines(), include_private)


@lru_cache(maxsize=8)
def _bundled_table(spark: SparkSession, include_private: bool) -> SuffixRules:
    return SuffixRules(spark, _bundled(include_private))


class SuffixRules:
    """The rule table and its depth.

    The table is bounded (MAX_RULES; about 7,000 short rows) and always broadcast: a session without Arrow gives
    Catalyst no size for it, and a join that shuffles by a host's tail puts all hosts of `com` in one task.
    """

    def __init__(self, spark: SparkSession, rules: dict[str, int]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} suffix rules are more than a lookup table may hold")
        self.depth = max(rule.count(".") + 1 for rule in rules)
        self._frame = spark.createDataFrame(
            pd.DataFrame({"rule": list(rules), "kind": list(rules.values())}), "rule string, kind int"
        )

    def table(self, rule: str, kind: str) -> DataFrame:
        return F.broadcast(self._frame.toDF(rule, kind))


def load_suffix_rules(
    spark: SparkSession, path: str | None = None, include_private: bool = False
) -> SuffixRules:
    """Rules from `path` (a public suffix list file), or from the list that ships with Spark."""
    if path is None:
        return _bundled_table(spark, include_private)
    head = spark.read.text(path).limit(4 * MAX_RULES + 1).toPandas()["value"]
    if len(head) > 4 * MAX_RULES:
        raise ValueError(f"{path} is too long to be a suffix list")
    return SuffixRules(spark, parse_rules(head, include_private))
