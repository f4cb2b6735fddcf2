"""License scans: sparse TF-IDF cosine to templates, and inheritance along directories.

DataFrame and SQL functions only. Texts that speak of a license at all are cut
into lines and sentences. Each of them that speaks, each run of two and four of
them with one that does (notices are wrapped over comment lines), and each such
text as a whole is compared with every template by the cosine of TF-IDF vectors
(idf from the templates, the largest one for words that no template has). The
best segment above the threshold is a file's header.

A license file speaks for its directory. It is one by its name (LICENSE,
COPYING, NOTICE and the like) if anything in it matches, or, among files without
a suffix or with one of plain text, by its content: as a whole it is close to a
license text (over ``THRESHOLD``) or nothing but a notice (over ``ALONE``).
Source files never are. A file without a match of its own inherits from the
nearest directory above it that has a license file: directories, not files, are
joined with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import checkpoint
from .license_texts import TEMPLATES

THRESHOLD, ALONE, BROADCAST = 0.6, 0.85, 1_000_000
#: Lines of a segment.
WIDTHS = (1, 2, 4)
NAMED = "(?i)^(un)?(licen[sc]e|copying|copyright|notice|legal)([-_.][^/]*)?$"
PLAIN = "(?i)^([^.]+|.*[.](txt|text|md|rst|html?))$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPEAKS = "licen[sc]|copyright|permission is|redistribution"


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, bool, str, float, float]], float]:
    """(template, license, whether it is a license text, word, idf, unit weight) of every template word, and the idf of other words."""
    bags = [Counter(_words(t)) for _, _, t in templates]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for i, (b, (name, kind, _)) in enumerate(zip(bags, templates)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
        out += [(i, name, kind == "text", w, idf[w], n * idf[w] / norm) for w, n in sorted(b.items())]
    return out, math.log(1 + len(bags)) + 1


def template_tables(spark: SparkSession, templates=TEMPLATES) -> tuple[DataFrame, DataFrame, float]:
    """Word idf and template weights as tables (their size is that of the templates)."""
    rows, other = weights(templates)
    vector = spark.createDataFrame([(i, n, k, w, x) for i, n, k, w, _, x in rows], "template int, license string, is_text boolean, word string, weight double").coalesce(1)
    idf = spark.createDataFrame(sorted({(w, v) for _, _, _, w, v, _ in rows}), "word string, idf double").coalesce(1)
    return F.broadcast(idf), F.broadcast(vector), other


def segments(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seg, s): of each ``_raw`` the lines and sentences that speak, runs of them with one that does, and (seg -1) the whole."""
    cut = F.split(F.regexp_replace("_raw", "([.!?])[ \t\r\n]+([A-Z])", "$1\n$2"), "\n")
    lines = texts.select(*keys, "_raw", F.transform(cut, lambda s: F.translate(s, UPPER, LOWER)).alias("_lines"))
    said = lines.select(*keys, "_raw", "_lines", F.transform("_lines", lambda s: s.rlike(SPEAKS)).alias("_said"))  # columns of their own: a lambda would work them out again and again

    def runs(w: int):
        first = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.exists(F.slice("_said", i + 1, F.lit(w)), lambda x: x))
        return F.transform(first, lambda i: F.struct((i * 8 + w).alias("seg"), F.array_join(F.slice("_lines", i + 1, F.lit(w)), " ").alias("s")))

    whole = F.array(F.struct(F.lit(-1).alias("seg"), F.translate("_raw", UPPER, LOWER).alias("s")))
    return said.select(*keys, F.explode(F.concat(whole, *map(runs, WIDTHS))).alias("p")).select(*keys, "p.seg", "p.s")


def matches(files: DataFrame, id_col: str, text_col: str, path, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(_k1, _k2, _path, _head, _text, _any): the best (similarity, license) of a file's segments, of its whole against license texts, and against any template.

    Rows are told apart by id, text and path, so ids may repeat or be null.
    """
    idf, vector, other = template_tables(files.sparkSession, templates)
    raw = F.col(f"`{text_col}`").cast("string")
    some = files.select(*row_key(id_col, text_col), path.alias("_path"), raw.alias("_raw")).filter(F.translate("_raw", UPPER, LOWER).rlike(SPEAKS))
    key = ["_k1", "_k2", "_path", "seg"]
    seg = segments(some.dropDuplicates(key[:3]), key[:3]).select(*key, F.explode(F.regexp_extract_all("s", F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    tf = seg.groupBy(*key, "word").agg(F.count("*").alias("tf")).join(idf, "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    one = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "x"))).alias("known"))
    dot = one.select(*key, "norm", F.explode("known").alias("w")).select(*key, "norm", "w.word", "w.x").join(vector, "word")
    near = dot.groupBy(*key, "template", "license", "is_text").agg(F.round(F.sum(F.col("x") * F.col("weight")) / F.first("norm"), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    best = lambda when: F.max(F.when(when, F.struct("similarity", (-F.col("template")).alias("t"), "license")))
    whole = F.col("seg") < 0
    return near.groupBy(*key[:3]).agg(best(~whole).alias("_head"), best(whole & F.col("is_text")).alias("_text"), best(whole).alias("_any"))


def row_key(id_col: str, text_col: str) -> tuple:
    ident = F.col(f"`{id_col}`").cast("long")
    return F.coalesce(ident, F.lit(0)).alias("_k1"), F.xxhash64(F.col(f"`{text_col}`").cast("string"), ident.isNull()).alias("_k2")


def parent(path):
    """Directory of a path without a slash at its end; the root is the empty string."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(directory):
    """A directory and all above it up to the root, with their depths."""
    names = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(names, F.lit(1), n), "/").alias("above")))


def small(rows: DataFrame) -> DataFrame:
    """The rows, written once, and broadcast if they are at most ``BROADCAST``."""
    rows = checkpoint(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def license_scan(files: DataFrame, id_col: str, text_col: str, path, threshold: float = THRESHOLD, alone: float = ALONE, templates=TEMPLATES) -> DataFrame:
    """(id_col, path, license, similarity, how, from_dir) of every row; path: a column expression. Ids are integers.

    how is file (it speaks for its directory), header, inherited or null. Null
    and empty texts only inherit; a null path has no directory, inherits
    nothing and speaks for none. Of equal similarities the first template
    counts; of several license files of a directory the most similar, then the
    last license by name. Texts of any length are read whole. Repeated rows
    give repeated results; an empty table gives an empty one; other columns are
    left out.
    """
    name = F.regexp_extract("_path", "([^/]*)$", 1)
    own = matches(files, id_col, text_col, path, threshold, templates).withColumn("_all", F.greatest("_head", "_any"))
    plain = name.rlike(PLAIN)
    speaks = F.when(name.rlike(NAMED), F.col("_all")).when(plain & F.col("_text").isNotNull(), F.col("_text")).when(plain & (F.col("_any.similarity") >= alone), F.col("_any"))
    own = small(own.select("_k1", "_k2", F.col("_path").alias("_own_path"), speaks.alias("_file"), "_all"))
    rows = files.select(*row_key(id_col, text_col), F.col(f"`{id_col}`").alias("_id"), path.alias("_path"))
    rows = rows.join(own, (rows["_k1"] == own["_k1"]) & (rows["_k2"] == own["_k2"]) & rows["_path"].eqNullSafe(own["_own_path"]), "left").select("_id", "_path", "_file", "_all", parent(F.col("_path")).alias("_dir"))
    clean = lambda d: F.array_join(F.filter(F.split(d, "/"), lambda x: x != ""), "/")
    lic = F.struct("_file.similarity", "_file.license")
    speakers = own.filter("_file is not null and _own_path is not null").groupBy(clean(parent(F.col("_own_path"))).alias("above")).agg(F.max(lic).alias("_lic"))
    folders = files.select(parent(path).alias("_dir")).filter("_dir is not null").distinct()
    near = small(folders.select("_dir", F.explode(ancestors(F.col("_dir"))).alias("a")).select("_dir", "a.depth", "a.above").join(speakers, "above").groupBy("_dir").agg(F.max(F.struct("depth", "above", "_lic")).alias("_near")))
    out = rows.join(near, "_dir", "left")
    best = F.coalesce("_file", "_all")
    how = F.when(F.col("_file").isNotNull(), "file").when(F.col("_all").isNotNull(), "header").when(F.col("_near").isNotNull(), "inherited")
    return out.select(
        F.col("_id").alias(id_col), F.col("_path").alias("path"), F.coalesce(best["license"], F.col("_near._lic.license")).alias("license"), F.coalesce(best["similarity"], F.col("_near._lic.similarity")).alias("similarity"),
        how.alias("how"), F.when(how == "inherited", F.col("_near.above")).alias("from_dir"),
    )


def document_path():
    """Paths of ``documents``, which has none: source, source/lang or source/lang/hundred as directories, by the id."""
    ident = F.col("doc_id")
    where = F.when(ident % 3 == 0, F.col("source")).when(ident % 3 == 1, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", F.floor(ident / 100).cast("string")))
    return F.concat_ws("/", where, F.concat(ident.cast("string"), F.lit(".txt")))


def oracle(threshold: float = THRESHOLD, alone: float = ALONE, templates=TEMPLATES) -> str:
    """The scan of ``documents`` under ``document_path`` in ANSI SQL."""
    rows, other = weights(templates)
    vector = ", ".join(f"({i}, '{n}', {str(k).lower()}, '{w}', {x!r}e0)" for i, n, k, w, _, x in rows)
    idf = ", ".join(f"('{w}', {v!r}e0)" for w, v in sorted({(w, v) for _, _, _, w, v, _ in rows}))
    widths = " UNION ALL ".join(f"SELECT doc_id, i * 8 + {w} AS seg, array_to_string(parts[i + 1 : i + {w}], ' ') AS s FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM cut)" for w in WIDTHS)
    return f"""
WITH idf(word, idf) AS (VALUES {idf}), vec(template, license, is_text, word, weight) AS (VALUES {vector}),
p AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || '/' || lang ELSE source || '/' || lang || '/' || (doc_id // 100) END AS dir, source, source || '/' || lang AS up FROM documents),
d AS (SELECT *, dir || '/' || doc_id || '.txt' AS path FROM p),
hit AS (SELECT doc_id, text, translate(text, '{UPPER}', '{LOWER}') AS low FROM d WHERE regexp_matches(translate(text, '{UPPER}', '{LOWER}'), '{SPEAKS}')),
cut AS (SELECT doc_id, string_split(translate(regexp_replace(text, '([.!?])[ \\t\\r\\n]+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), '{UPPER}', '{LOWER}'), chr(10)) AS parts FROM hit),
seg AS (SELECT * FROM ({widths}) WHERE regexp_matches(s, '{SPEAKS}') UNION ALL SELECT doc_id, -1, low FROM hit),
tok AS (SELECT doc_id, seg, unnest(regexp_extract_all(s, '[a-z0-9]+')) AS word FROM seg),
tf AS (SELECT t.doc_id, t.seg, t.word, t.n * coalesce(idf.idf, {other!r}e0) AS x FROM (SELECT doc_id, seg, word, count(*) AS n FROM tok GROUP BY ALL) t LEFT JOIN idf USING (word)),
norm AS (SELECT doc_id, seg, sqrt(sum(x * x)) AS norm FROM tf GROUP BY ALL),
dot AS (SELECT doc_id, seg, template, license, is_text, sum(x * weight) AS dot FROM tf JOIN vec USING (word) GROUP BY ALL),
near AS (SELECT doc_id, seg < 0 AS whole, is_text, template, license, round(dot / norm, 6) AS similarity FROM dot JOIN norm USING (doc_id, seg) WHERE round(dot / norm, 6) >= {threshold}),
one AS (SELECT doc_id, license, similarity FROM near QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, template) = 1),
txt AS (SELECT doc_id, license, similarity FROM near WHERE whole AND is_text QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, template) = 1),
lone AS (SELECT doc_id, license, similarity FROM near WHERE whole QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, template) = 1),
own AS (SELECT d.*, coalesce(t.license, CASE WHEN l.similarity >= {alone} THEN l.license END) AS fl, coalesce(t.similarity, CASE WHEN l.similarity >= {alone} THEN l.similarity END) AS fs, o.license AS ol, o.similarity AS os
        FROM d LEFT JOIN txt t USING (doc_id) LEFT JOIN lone l USING (doc_id) LEFT JOIN one o USING (doc_id)),
spk AS (SELECT dir, fl, fs FROM own WHERE fl IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY fs DESC, fl DESC) = 1)
SELECT own.doc_id, own.path, coalesce(own.fl, own.ol, a.fl, b.fl, c.fl) AS license, coalesce(own.fs, own.os, a.fs, b.fs, c.fs) AS similarity,
       CASE WHEN own.fl IS NOT NULL THEN 'file' WHEN own.ol IS NOT NULL THEN 'header' WHEN coalesce(a.fl, b.fl, c.fl) IS NOT NULL THEN 'inherited' END AS how,
       CASE WHEN own.fl IS NULL AND own.ol IS NULL THEN coalesce(a.dir, b.dir, c.dir) END AS from_dir
FROM own LEFT JOIN spk a ON a.dir = own.dir LEFT JOIN spk b ON b.dir = own.up AND own.dir <> own.up AND own.dir <> own.source LEFT JOIN spk c ON c.dir = own.source AND own.dir <> own.source
"""
