"""S11, F-7: node lists "id=host:port,..."; blanks are trimmed, empty tokens and tokens without = are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conf_or(spark, name: str, default: str) -> str:
    """A setting of the session, or the default where it is unset or empty."""
    return spark.conf.get(name, "") or default


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def parse_nodes(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """node, addr of each token, in order."""
    token = specs.select(F.explode(F.split(spec, ",")).alias("t")).select(trimmed(F.col("t")).alias("t")).filter(F.instr("t", "=") > 0)
    return token.select(F.expr("substring(t, 1, instr(t, '=') - 1)").alias("node"), F.expr("substring(t, instr(t, '=') + 1)").alias("addr"))
