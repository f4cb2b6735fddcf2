"""Text scalars as column builders; pandas UDFs only where Spark has no function (NFKC, Ratcliff-Obershelp)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .scalars import clamp

CJK = "\\x{4e00}-\\x{9fff}"


@pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC normal form; null stays null."""
    return s.str.normalize("NFKC")


@pandas_udf(T.StringType())
def normalize_key(s: pd.Series) -> pd.Series:
    """STR-05. NFKC, case-folded, white space collapsed."""
    return s.str.normalize("NFKC").str.casefold().str.split().str.join(" ")


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR-13. Ratcliff-Obershelp ratio (not symmetric)."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def fingerprint(text: Column) -> Column:
    """STR-03. SHA-256 of the lower-cased text with white space collapsed."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, "\\s+", " "))), 256)


def content_hash(text: Column) -> Column:
    """STR-04."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def alnum_key(text: Column) -> Column:
    """STR-06. Lower-cased letters, digits, underscores and CJK characters only."""
    return F.regexp_replace(F.lower(text), f"[^\\w{CJK}]+", "")


#: STR-01. Fixed query keys that only track.
TRACKING = ("from", "ref", "source", "spm")


def canonical_url(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """STR-01. Host without www and default ports, single slashes, no fragment, sorted query without tracking keys."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.regexp_replace(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)), "/+", "/"), "(.)/$", "$1")
    pairs = F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike("^utm_") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*tracking))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def identity_url(url: Column) -> Column:
    """STR-02. Lower-cased scheme and host, no default port, fragment or slash at the end; the query stays."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", "")), F.regexp_extract(rest, "(\\?.*)$", 1))


def char_grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; empty for shorter texts."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def shingles(text: Column) -> Column:
    """STR-08. Character 3- and 4-grams without spaces, or the text itself if too short."""
    t = F.replace(text, F.lit(" "), F.lit(""))
    g = F.array_union(char_grams(t, 3), char_grams(t, 4))
    return F.when(F.size(g) > 0, g).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """SET-01. Jaccard similarity of arrays as sets; ``empty`` if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(empty))


def dice(a: Column, b: Column) -> Column:
    """SET-03. Dice coefficient; 1 for two empty sets, 0 if only one is empty."""
    n = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(n == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / n)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """SET-02. Sum of minima over sum of maxima of two maps; 0 if both are empty."""
    lo = F.map_zip_with(a, b, lambda k, x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    hi = F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    return F.when(total(hi) > 0, total(lo) / total(hi)).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    """STR-07. Jaccard of character 3-grams of normalised texts; two texts without any are equal."""
    return jaccard(char_grams(a, 3), char_grams(b, 3), 1.0)


def edit_ratio(a: Column, b: Column) -> Column:
    """STR-09. Levenshtein distance by the longer length; 0 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n > 0, F.levenshtein(a, b) / n).otherwise(0.0)


def mixed_tokens(text: Column) -> Column:
    """STR-10. ASCII words and character bigrams of each CJK run (single characters as they are)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[0-9a-z]+|[{CJK}]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[0-9a-z]"), F.array(r)).when(F.length(r) < 2, F.array(r)).otherwise(char_grams(r, 2)))))


def bigrams(text: Column) -> Column:
    """STR-11. Bigrams of all ASCII runs put together, and of each CJK segment."""
    t = F.lower(text)
    ascii_run = F.array_join(F.regexp_extract_all(t, F.lit("[0-9a-z]+"), F.lit(0)), "")
    one = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(char_grams(r, 2))
    cjk = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(f"[{CJK}]+"), F.lit(0)), one))
    return F.array_distinct(F.concat(one(ascii_run), cjk))


def lexical_similarity(a: Column, b: Column) -> Column:
    """STR-12. 0.35 Dice of ASCII terms, 0.40 and 0.25 Jaccard of CJK 2- and 3-grams; 0 if a text is empty."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)))
    runs = lambda t, n: F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(f"[{CJK}]+"), F.lit(0)), lambda r: char_grams(r, n))))

    def sim(x: Column, y: Column) -> Column:
        nx, ny = F.size(x), F.size(y)
        return F.when((nx == 0) & (ny == 0), 1.0).when((nx == 0) | (ny == 0), 0.0).otherwise(jaccard(x, y))

    score = 0.35 * dice(words(a), words(b)) + 0.40 * sim(runs(a, 2), runs(b, 2)) + 0.25 * sim(runs(a, 3), runs(b, 3))
    return F.when((a == "") | (b == ""), 0.0).otherwise(score)


def posting_similarity(a: Column, b: Column, skills_a: Column, skills_b: Column) -> Column:
    """JOI-16. 0.65 shingle overlap, 0.20 skill overlap, 0.15 length similarity."""
    la, lb = F.length(F.replace(a, F.lit(" "), F.lit(""))), F.length(F.replace(b, F.lit(" "), F.lit("")))
    most = F.greatest(la, lb)
    return 0.65 * jaccard(shingles(a), shingles(b)) + 0.20 * jaccard(skills_a, skills_b) + 0.15 * F.when(most > 0, 1 - F.abs(la - lb) / most).otherwise(0.0)


def years_months(text: Column) -> Column:
    """STR-16. Months of an experience requirement like ``3-5 years`` (the lower bound); null if it is none."""
    p = "(?i)^\\s*(\\d+(?:\\.\\d+)?)\\s*(?:[-~至到]\\s*\\d+(?:\\.\\d+)?\\s*)?(years?|months?|年|个月|月)\\s*(?:以上|及以上|\\+|or\\s+more)?\\s*$"
    n = F.regexp_extract(text, p, 1)
    unit = F.lower(F.regexp_extract(text, p, 2))
    return F.when(n != "", n.try_cast("double") * F.when(unit.isin("year", "years", "年"), 12).otherwise(1))


def salary(text: Column) -> Column:
    """STR-15. Struct status, minimum, maximum, period of the first salary range (K, 千, 万, 元); malformed ones have status invalid."""
    p = "(月薪|年薪|日薪|时薪|周薪|薪资|工资|薪酬)?\\s*[:：]?\\s*(\\d+(?:\\.\\d+)?)\\s*([Kk千万元])?\\s*[-~至到]\\s*(\\d+(?:\\.\\d+)?)\\s*([Kk千万元])(?:\\s*/\\s*(月|年|天|日|小时|周))?"
    g = lambda i: F.regexp_extract(text, p, i)
    unit = lambda u: F.when(F.lower(u) == "k", 1000.0).when(u == "千", 1000.0).when(u == "万", 10000.0).when(u == "元", 1.0)
    hi_unit = g(5)
    lo_unit = F.when(g(3) == "", hi_unit).otherwise(g(3))
    lo, hi = g(2).try_cast("double") * unit(lo_unit), g(4).try_cast("double") * unit(hi_unit)
    period = F.when(g(6) != "", F.when(g(6) == "天", "日").when(g(6) == "小时", "时").otherwise(g(6))).when(g(1).rlike("^[月年日时周]薪"), F.substring(g(1), 1, 1)).when(F.lower(lo_unit) == "k", "月")
    status = F.when(text.rlike("面议|可谈"), "negotiable").when(text.rlike("保密"), "not_disclosed").when(hi.isNull(), None).when((lo > hi) | period.isNull(), "invalid").otherwise("specified")
    ok = status == "specified"
    return F.struct(status.alias("status"), F.when(ok, lo).alias("minimum"), F.when(ok, hi).alias("maximum"), F.when(ok, period).alias("period"))


#: STR-17. Fixed degree levels, rising, with the words that name them, strongest first.
DEGREES = (("doctor", "博士|phd|ph\\.d|doctor"), ("master", "硕士|研究生|master"), ("bachelor", "本科|学士|bachelor|undergraduate"), ("associate", "大专|专科|associate|college|diploma"), ("high_school", "高中|high school"))


def degree(text: Column) -> Column:
    """STR-17. The highest degree a text names, or null."""
    out = F
    for name, words in DEGREES:
        out = out.when(F.lower(text).rlike(words), name)
    return out.otherwise(F.lit(None).cast("string"))


def degree_rank(name: Column) -> Column:
    """STR-17. Ordinal of a degree, 0 for the lowest."""
    out = F
    for i, (d, _) in enumerate(reversed(DEGREES)):
        out = out.when(name == d, F.lit(i).cast("bigint"))
    return out.otherwise(F.lit(None).cast("bigint"))


def occurrence(text: Column, quote: Column, n: int = 0) -> Column:
    """STR-19. Start (from 0) of the n-th exact occurrence, by code points; null if there are fewer."""
    found = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0), lambda p, _: F.when(p < 0, p).otherwise(F.coalesce(F.nullif(F.call_function("locate", quote, text, p + 1), F.lit(0)), F.lit(-1))))
    return F.when((quote != "") & (found > 0), found - 1)


#: STR-20. Patterns of personal data by name; fixed values.
PII = (
    ("email", "[\\w.+-]+@[\\w-]+(\\.[\\w-]+)+"), ("phone", "(?<![0-9A-Za-z_])(\\+?86[ .-]*)?1[3-9]([ .-]*\\d){9}(?![0-9A-Za-z_])"), ("identity", "(?<![0-9A-Za-z])\\d{17}[0-9Xx](?![0-9A-Za-z])"),
    ("card", "(?<!\\d)\\d{16}(?!\\d)"), ("ip", "(?<![\\d.])\\d{1,3}(\\.\\d{1,3}){3}(?![\\d.])"), ("handle", "(?<![\\w@.])@[A-Za-z0-9_][A-Za-z0-9_.-]{2,31}(?![\\w@])"),
    ("address", "(?i)\\b\\d{1,6}\\s+[A-Za-z][A-Za-z .'-]{2,50}\\s+(street|road|avenue|lane|drive|boulevard)\\b"), ("secret", "(?i)(token|api_key|password)\\s*=\\s*\\S+"),
)


#: Signs without which a pattern cannot match; looked for first.
SIGNS = {"email": "@", "handle": "@", "secret": "="}


def _holds(text: Column, kind: str, pattern: str) -> Column:
    return F.contains(text, F.lit(SIGNS[kind])) & text.rlike(pattern) if kind in SIGNS else text.rlike(pattern)


def pii_kinds(text: Column, kinds: Sequence[str] | None = None) -> Column:
    """STR-20. Names of the kinds of personal data in a text, of those asked for (all where none are named), in fixed order."""
    return F.array_compact(F.array(*[F.when(_holds(text, n, p), F.lit(n)) for n, p in PII if kinds is None or n in kinds]))


def redact(text: Column, replacement: str = "[redacted]") -> Column:
    """STR-21. The whole text is replaced if it holds personal data; the first kind found ends the search."""
    found = F.lit(False)
    for n, p in PII:
        found = found | _holds(text, n, p)
    return F.when(found, F.lit(replacement)).otherwise(text)


def structured_id(text: Column) -> Column:
    """STR-22. Whether a text is a valid system identifier: a namespace, a UUID, or a word; contact prefixes are not."""
    contact = text.rlike("(?i)^(phone|mobile|tel|contact|email|wechat|qq|whatsapp|telegram|social)[_.-]+")
    form = text.rlike("^([a-z][a-z0-9]*:.*|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?=.*[a-zA-Z])[\\w:.-]+)$")
    return form & ~contact


def keyword_topic(text: Column, topics: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """STR-23. The topic with the largest sum of lengths of its words in the text; ties go to the first one."""
    t = F.lower(text)
    scores = [F.struct(sum((F.when(F.contains(t, F.lit(w)), len(w)).otherwise(0) for w in words), F.lit(0)).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("n")) for i, (name, words) in enumerate(topics.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["s"] > 0, best["n"]).otherwise(default)


def keyword_tags(text: Column, topics: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """STR-24, SRC-08. All topics with a word in the text, or the default."""
    t = F.lower(text)
    hit = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)), F.lit(n)) for n, words in topics.items()]
    tags = F.array_compact(F.array(*hit))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(default)))


def keyword_hit(text: Column, word: str) -> Column:
    """STR-25, FLT-14. Whether a word occurs; ASCII words only at word boundaries."""
    if word.isascii():
        return F.lower(text).rlike(f"(?<![a-z0-9]){_escape(word.lower())}(?![a-z0-9])")
    return F.contains(F.lower(text), F.lit(word.lower()))


def _escape(s: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c for c in s)


def token_f1(a: Column, b: Column) -> Column:
    """STR-28. F1 of the token sets of a prediction and an expectation; 1 if both are empty."""
    t = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(f"[a-z0-9]+|[{CJK}]"), F.lit(0)))
    return dice(t(a), t(b))


def best_span_f1(spans: Column, expected: Column) -> Column:
    """STR-28. The best token F1 of several predictions; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(spans, lambda s: token_f1(s, expected))), F.lit(0.0))


def hallucinations(quotes: Column, text: Column) -> Column:
    """STR-29. Quotes that a text does not hold."""
    return F.filter(quotes, lambda q: ~F.contains(text, q))


def split_skills(name: Column) -> Column:
    """STR-31. Parts of a composite skill name."""
    return F.filter(F.transform(F.split(name, "\\s*(?:/|、|,|，|;|；|\\||\\band\\b|&)\\s*"), F.trim), lambda x: x != "")


def inflation(title: Column, responsibilities: Column, years: Column, skills: Column) -> Column:
    """STR-27. Seniority inflation: junior titles or little experience with senior responsibilities, 1 at most."""
    low = F.lower(title).rlike("intern|junior|entry|助理|实习|初级")
    short = years <= 2
    own, lead, arch = (F.lower(responsibilities).rlike(p) for p in ("own|end-to-end|主导|端到端", "lead|manage|团队管理|带领", "architect|架构|技术选型"))
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    return clamp(part(low & arch, 0.25) + part(short & (own | lead | arch), 0.25) + part((low | short) & own, 0.25) + part((low | short) & lead, 0.15) + part(F.size(F.array_distinct(skills)) >= 9, 0.10))


def quality_scores(similarity: Column, text: Column, markers: str) -> list[Column]:
    """STR-33. Duplicate, copy risk and inflation scores from the best peer similarity and the count of marker words."""
    n = F.regexp_count(text, F.lit(f"(?i){markers}"))
    return [similarity.alias("duplicate_score"), F.when(similarity >= 0.8, similarity).otherwise(similarity * 0.75).alias("copy_risk_score"), clamp((n - 8) / 12.0).alias("inflation_score")]
