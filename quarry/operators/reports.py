"""Reports: digests, trends, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

SPLIT_ABOVE = 50


def in_period(modified: Column, indexed: Column, start: Column, end: Column) -> Column:
    """Either time lies in the period, ends included."""
    return F.coalesce(modified.between(start, end), F.lit(False)) | F.coalesce(indexed.between(start, end), F.lit(False))


def topic_groups(docs: DataFrame, kind: str, *named: str, most: int = SPLIT_ABOVE) -> DataFrame:
    """Adds ``topic``: the kind, split by the first keyword of the named columns where the kind has over ``most`` documents."""
    sizes = docs.groupBy(kind).agg(F.count(F.lit(1)).alias("__n"))
    words = T.topic_keywords(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in named]))
    name = T.title_case(kind)
    keyword = F.when(F.size(words) > 0, F.initcap(F.get(words, F.lit(0)))).otherwise(F.lit("Other"))
    # the sizes are summed before the exchange, a row for each kind
    joined = docs.join(sizes, docs[kind].eqNullSafe(sizes[kind])).drop(sizes[kind])
    return joined.withColumn("topic", F.when(F.col("__n") <= most, name).otherwise(F.concat(name, F.lit(" - "), keyword))).drop("__n")


def digest(docs: DataFrame, kind: str, *named: str, most: int = SPLIT_ABOVE) -> DataFrame:
    """Groups of a period's documents, the largest first."""
    return topic_groups(docs, kind, *named, most=most).groupBy("topic").agg(F.count(F.lit(1)).alias("n_docs")).orderBy(F.desc("n_docs"), "topic")


def digest_facts(docs: DataFrame, kind: str, *named: str, most: int = SPLIT_ABOVE) -> DataFrame:
    """Documents, groups and the most frequent kind of a period, in one row."""
    groups = topic_groups(docs, kind, *named, most=most).agg(F.count(F.lit(1)).alias("total_documents"), F.countDistinct("topic").alias("n_groups"))
    return groups.crossJoin(F.broadcast(top_kind(docs, kind)))  # one row each


def top_kind(docs: DataFrame, kind: str) -> DataFrame:
    return docs.groupBy(F.col(kind).alias("top_type")).agg(F.count(F.lit(1)).alias("top_count")).orderBy(F.desc("top_count"), "top_type").limit(1)


def trends(docs: DataFrame, created: Column, as_of: Column, days: int, kind: str) -> DataFrame:
    """New and all documents by kind."""
    new = created >= as_of - F.make_dt_interval(F.lit(days))
    return docs.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("kind")).agg(F.count_if(new).alias("new_documents"), F.count(F.lit(1)).alias("total_documents"))


def trend_text(total: int, new: int, days: int, kinds: dict[str, int], topics: list[str], titles: list[str]) -> str:
    """Sentences about a collected, bounded result."""
    lines = [f"Knowledge base has {total} total documents.", f"In the last {days} days, {new} new documents were added."]
    if kinds:
        lines.append("Document types: " + ", ".join(f"{n} {k}" for k, n in kinds.items()) + ".")
    if topics:
        lines.append("Key topics include: " + ", ".join(topics[:5]) + ".")
    if titles:
        lines.append("Recent document titles: " + ", ".join(f'"{t}"' for t in titles[:3]) + ".")
    return "\n".join(lines)


def digest_markdown(period: str, groups: list[tuple[str, int]]) -> str:
    """A digest of collected groups."""
    if not groups:
        return f"# Digest {period}\n\nNo documents in this period.\n"
    total = sum(n for _, n in groups)
    body = "\n".join(f"## {i}. {topic}\n\n{n} document{'' if n == 1 else 's'}\n" for i, (topic, n) in enumerate(groups, 1))
    return f"# Digest {period}\n\n{total} document{'' if total == 1 else 's'} in {len(groups)} group{'' if len(groups) == 1 else 's'}\n\n{body}"


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of a listing with the number of pages; ``order`` ends in a unique column."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return shown.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))  # one row


def recent(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def grouped_overflow(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, with how many more there are."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    more = F.greatest(F.lit(0), F.count(F.lit(1)).over(W.partitionBy(group)) - most)
    return rows.withColumn("rank", rank.cast("long")).withColumn("more", more).where(F.col("rank") <= most)
