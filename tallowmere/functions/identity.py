"""Identities made of content: digests, case and claim ids, hash order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def together(separator: str, *parts: Column) -> Column:
    r"""The parts as one text from which they can be told again: a separator or a backslash in a part gets a backslash before it, NULL is ``\0``."""
    safe = lambda p: F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(separator), F.lit("\\" + separator))
    return F.concat_ws(separator, *[F.coalesce(safe(p), F.lit("\\0")) for p in parts])


def digest(*parts: Column, separator: str = "|") -> Column:
    """The SHA-256 of all parts; different parts have different texts, missing ones too."""
    return F.sha2(together(separator, *parts), 256)


def canonical_json(**fields: Column) -> Column:
    """The fields as JSON in the order of their names, nulls left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def case_id(dataset: str, entity: Column) -> Column:
    """``case_<dataset>_<entity>_<20 hex digits of the digest of both>``."""
    short = F.substring(F.sha2(canonical_json(dataset_id=F.lit(dataset), source_entity_id=entity.cast("string")), 256), 1, 20)
    return F.concat(F.lit(f"case_{dataset}_"), entity.cast("string"), F.lit("_"), short)


def scoped(dataset: str, key: Column) -> Column:
    return F.concat(F.lit(f"{dataset}::"), key.cast("string"))


def hash_order(seed: str, *keys: Column) -> Column:
    """A key that orders rows at random, alike in every run and however they are partitioned."""
    return F.md5(together(":", F.lit(seed), *keys))


def draw(seed: str, n: Column, *keys: Column) -> Column:
    """A number from 0 to n - 1 drawn by hash: 28 bits of the digest modulo n."""
    return F.pmod(F.conv(F.substring(hash_order(seed, *keys), 1, 7), 16, 10).cast("long"), n)
