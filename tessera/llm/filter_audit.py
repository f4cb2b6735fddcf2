"""Audit of how filters interact: what each removes in every order, in long form.

Each document gets a mask with a bit for each filter that it fails. Documents
of a part with equal masks are one cell with its counts, so all that follows
grows with parts and masks, not with documents. Cells are unpivoted against
the steps of every order; a running bit-or over the steps before tells what a
cell has failed earlier, conditional sums give the counts of a step, and a
window over a filter adds up what it removes in all orders.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Conditions under which a text fails the filters A to D; words: its words in order."""
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": (F.length(text) - F.length(F.translate(text, _UPPER, ""))) * 100 > F.length(text) * 3,
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail; A is bit 1, E bit 16.

    E fails a document whose text a document with a smaller id has too. Rows
    meet by id first, which brings their labels; then rows of one part, mask
    and label with equal texts are one row that knows its least id, so a text
    that a third of all rows have is counted where the rows are and travels as
    one row a task. Equal texts are told by SHA-256.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.select("id", "part", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    failed = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_filters(F.col("text"), F.col("words")).values())]
    rows = base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), sum(failed[1:], failed[0]).alias("mask"))
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), "quality", "toxic").filter("id is not null").groupBy("id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    kind = ["part", "mask", "good", "toxic"]
    by_id = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"]).groupBy("id", "same", *kind).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    loose = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    by_text = by_id.groupBy("same", *kind).agg(F.sum("n").alias("n"), loose.alias("loose"), least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("same"))  # a row for each part, mask and label of a text
    kept = F.col("loose") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = by_text.withColumn("first", first).select(*kind, F.explode(F.array(F.struct(F.lit(0).alias("bit"), kept.alias("n")), F.struct(F.lit(16).alias("bit"), (F.col("n") - kept).alias("n")))).alias("x"))
    cell = split.filter("x.n > 0").groupBy("part", (F.col("mask") + F.col("x.bit")).alias("mask"))
    return cell.agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def interactions(cells: DataFrame, filters: Mapping[str, int]) -> DataFrame:
    """(part, filter_order, step, kept and the measures, shapley) of cells as ``masks`` gives them, for all orders of filters (name: bit).

    The steps of all orders are a literal (five filters: 600), one row a cell and step. Every part has all rows, zeros included.
    """
    orders = F.array(*(F.array(*map(F.lit, o)) for o in permutations(filters)))
    bit = F.create_map(*(x for name, b in filters.items() for x in (F.lit(name), F.lit(b))))
    long = cells.select("*", F.explode(orders).alias("order")).select("*", F.array_join("order", "").alias("filter_order"), F.posexplode("order").alias("at", "filter")).drop("order")
    own = F.col("mask").bitwiseAND(F.element_at(bit, F.col("filter")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("own", own).withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    fails, fresh = F.col("own") != 0, F.col("earlier") == 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "at", "filter").agg(
        count(fresh & ~fails).alias("kept"), count(fresh & fails).alias("removed"), count(~fresh & fails).alias("redundant"), count(fails & (F.col("mask") == F.col("own"))).alias("unique_fails"),
        count(fresh & fails, "good").alias("good_lost"), count(fresh & fails, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")
    return steps.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "kept", *MEASURES, shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What the filters A to E keep, remove and overlap in, for each part and each of their 120 orders.

    A null text is empty (it fails A and no other of A to D), a null part is
    the empty string. Repeated rows are documents each; E holds an id against
    smaller ones only, so rows with one id and text fail it together or not at
    all, and a null id neither fails E nor makes others fail. Labels other than
    1, null or missing ones lose nothing; of several labels of an id 1 counts.
    An empty table gives no rows. Other columns are not read. Long texts are
    counted whole.
    """
    return interactions(masks(docs, labels, id_col, text_col, part_col), {c: 1 << k for k, c in enumerate("ABCDE")})


#: Words by DuckDB's regular expressions; each order and step by joins of literal lists.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS lo FROM d),
     m AS (SELECT w.doc_id, part, coalesce(q.quality = 1, false) AS good, coalesce(q.toxic = 1, false) AS toxic,
                  map {'A': len(words) < 200,
                       'B': 100 * list_unique(words) < 50 * len(words),
                       'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
                       'D': regexp_matches(text, '[#$%&*|]'),
                       'E': coalesce(lo < w.doc_id, false)} AS f
           FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) q ON q.doc_id = w.doc_id),
     c AS (SELECT part, f, count(*) AS n, sum(good::int) AS good, sum(toxic::int) AS toxic FROM m GROUP BY ALL),
     l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT part, filter_order, step::int AS step, filter_order[step] AS filter, n, good, toxic, f[filter_order[step]] AS fails,
                  len(list_filter(range(1, step), lambda j: f[filter_order[j]])) = 0 AS fresh,
                  len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: f[y])) AS all_fails
           FROM c, o, unnest([1, 2, 3, 4, 5]) AS t(step)),
     g AS (SELECT part, filter_order, step, filter,
                  coalesce(sum(n) FILTER (fresh AND NOT fails), 0)::bigint AS kept, coalesce(sum(n) FILTER (fresh AND fails), 0)::bigint AS removed,
                  coalesce(sum(n) FILTER (fails AND NOT fresh), 0)::bigint AS redundant, coalesce(sum(n) FILTER (fails AND all_fails = 1), 0)::bigint AS unique_fails,
                  coalesce(sum(good) FILTER (fresh AND fails), 0)::bigint AS good_lost, coalesce(sum(toxic) FILTER (fresh AND fails), 0)::bigint AS toxic_lost
           FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::bigint AS shapley FROM g
"""
