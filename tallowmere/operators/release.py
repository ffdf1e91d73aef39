"""Releases: cells of a plan certified by replay of stored responses, assertions over several tables, and a chain of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest, together


def planned(cases: DataFrame, options: DataFrame, repeats: int, version: str) -> DataFrame:
    """The cells of a plan: every case with every option, ``repeats`` times; ``cell_id`` is the digest of the version and all that a cell asks for.

    ``options`` is the plan's table of configurations; cases are not bounded.
    """
    asked = [*cases.columns, *options.columns, "repeat"]
    small = [r.asDict() for r in options.collect()]
    kinds = options.schema
    each = F.array(*[F.struct(*[F.lit(o[f.name]).cast(f.dataType).alias(f.name) for f in kinds]) for o in small])
    p = cases.withColumn("__o", F.explode(each)).select(*cases.columns, "__o.*").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return p.withColumn("cell_id", digest(F.lit(version), *[F.col(c) for c in asked]))


def replayed(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """``plan`` with what is stored for each cell: ``status``, ``parts`` and ``response_digest``; and responses without a cell.

    ``responses(cell_id, part, of, payload, payload_sha256)``: a response comes in ``of`` parts.  A cell is CERTIFIED if each of its parts is there once and
    unaltered; else ALTERED (a payload isn't that of its digest), DUPLICATED (a part twice), INCONSISTENT (parts disagree on their number), INCOMPLETE or MISSING.
    Nothing is generated.  Responses of cells that are not planned come as rows with status UNPLANNED.
    """
    bad = F.sha2(F.coalesce("payload", F.lit("")), 256) != F.coalesce("payload_sha256", F.lit(""))
    g = responses.groupBy("cell_id").agg(
        F.count("*").alias("parts"), F.count_if(bad).alias("__bad"), F.array_sort(F.collect_list(F.struct("part", "payload_sha256"))).alias("__all"), F.min("of").alias("__of"), F.max("of").alias("__most"),
    )
    numbers = F.transform("__all", lambda x: x["part"])
    inside = F.size(F.filter(numbers, lambda n: (n >= 1) & (n <= F.col("__of"))))
    g = g.select(
        "cell_id", "parts",
        F.when(F.col("__bad") > 0, "ALTERED").when(F.size(F.array_distinct(numbers)) < F.size(numbers), "DUPLICATED").when(F.col("__of") != F.col("__most"), "INCONSISTENT")
        .when((inside < F.col("__of")) | (inside < F.size(numbers)), "INCOMPLETE").otherwise("CERTIFIED").alias("__status"),
        F.sha2(F.array_join(F.transform("__all", lambda x: x["payload_sha256"]), "|"), 256).alias("response_digest"),
    )
    j = plan.join(g, "cell_id", "full_outer")
    first = plan.columns[0] if plan.columns[0] != "cell_id" else plan.columns[1]
    status = F.when(F.col(first).isNull(), "UNPLANNED").otherwise(F.coalesce("__status", F.lit("MISSING")))
    return j.select(*plan.columns, status.alias("status"), F.coalesce("parts", F.lit(0)).alias("parts"), F.when(status == "CERTIFIED", F.col("response_digest")).alias("response_digest"))


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, ``rows`` and ``digest``: of all rows whatever their order, repeated ones counted.

    Each row's SHA-256 is cut into four numbers, which are added up by table: one changed, missing or doubled row changes a sum.
    """
    cols = list(columns or df.columns)
    h = F.sha2(together("|", *[F.col(f"`{c}`") for c in sorted(cols)]), 256)
    words = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    s = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"s{i}") for i, w in enumerate(words)])
    return s.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("digest"))


def chained(steps: Mapping[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """``(name, rows, digest, chain)`` of tables in order; each link covers the one before, so the last is the release's."""
    out, before = [], ""
    for name, df in steps.items():
        r = table_digest(df).first()
        before = hashlib.sha256(f"{before}|{name}|{r.rows}|{r.digest}".encode()).hexdigest()
        out.append((name, r.rows, r.digest, before))
    return out


@dataclass(frozen=True)
class Assertion:
    """What must hold of a table: ``never`` is an SQL condition on rows that must not be; ``key`` columns that tell rows apart; ``refers`` (columns, table, its columns) rows that must exist there."""

    name: str
    table: str
    never: str | None = None
    key: tuple[str, ...] = ()
    refers: tuple[tuple[str, ...], str, tuple[str, ...]] | None = None
    blocking: bool = True


def verified(tables: Mapping[str, DataFrame], assertions: Sequence[Assertion]) -> DataFrame:
    """``(assertion, table, rows, violations, blocking, status)`` of each assertion.

    All conditions on the rows of one table are counted in one pass; keys and references take a shuffle of their columns each.
    A missing value is no reference and violates none.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in tables.items():
        own = [a for a in assertions if a.table == name and a.never is not None]
        if own:
            one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.expr(a.never), F.lit(False))).alias(f"v{i}") for i, a in enumerate(own)])
            parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(a.name).alias("assertion"), F.col("rows").alias("rows"), F.col(f"v{i}").alias("violations")) for i, a in enumerate(own)])).alias("x")).select("x.*"))
    for a in assertions:
        df = tables[a.table]
        if a.key:
            n = df.groupBy(*a.key).agg(F.count("*").alias("n"))
            parts.append(n.agg(F.lit(a.name).alias("assertion"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")))
        if a.refers:
            cols, other, theirs = a.refers
            there = tables[other].select(*[F.col(t).alias(f"__{c}") for c, t in zip(cols, theirs, strict=True)]).distinct().withColumn("__there", F.lit(True))
            some = df.select(*cols).where(F.greatest(*[F.col(c).isNull() for c in cols], F.lit(False)) == F.lit(False))
            j = some.join(there, [F.col(c) == F.col(f"__{c}") for c in cols], "left")
            parts.append(j.agg(F.lit(a.name).alias("assertion"), F.count("*").alias("rows"), F.count_if(F.col("__there").isNull()).alias("violations")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    table = spark.createDataFrame([(a.name, a.table, a.blocking) for a in assertions], "assertion string, table string, blocking boolean")
    status = F.when(F.col("violations") == 0, "PASS").when(F.col("blocking"), "FAIL").otherwise("WARN")
    return rows.join(table, "assertion").select("assertion", "table", "rows", "violations", "blocking", status.alias("status"))


def json_keys(text: Column) -> Column:
    """The names of all keys of a JSON text, at any depth: of its strings those that a colon follows."""
    string = r'"((?:[^"\\]|\\.)*+)"(\s*+:)?'
    names, colons = F.regexp_extract_all(text, F.lit(string), 1), F.regexp_extract_all(text, F.lit(string), 2)
    pairs = F.filter(F.arrays_zip(names.alias("n"), colons.alias("c")), lambda x: F.coalesce(x["c"], F.lit("")) != "")
    return F.array_distinct(F.transform(pairs, lambda x: x["n"]))


def forbidden_keys(df: DataFrame, key: str, payload: str, names: Sequence[str]) -> DataFrame:
    """``(key, name)``: forbidden names, whatever their case, among the keys of a JSON text at any depth."""
    low = [n.lower() for n in names]
    return df.select(key, F.explode(F.filter(F.transform(json_keys(F.col(payload)), F.lower), lambda x: x.isin(*low))).alias("name")).distinct()
