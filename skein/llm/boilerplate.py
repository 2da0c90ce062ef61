"""Site-relative line dedup, in DataFrame functions only.

For each site, the pages that contain a line are divided by the pages of the site.  A line
whose share exceeds the boilerplate ratio, on at least a few pages, is dropped from every page
of that site.

A page counts once for a line however often it repeats it.  Counting is pre-aggregated before
its shuffle, so a hot site or line costs one row per task.  A site has fewer boilerplate lines
than its mean number of lines per page divided by the ratio (every one of them is on that share
of its pages), so they travel as one array per site, repeated for each salt; the pages meet
them by (site, salt), which spreads a hot site over many tasks; the salt follows from all of a
row's columns, so equal pages of a site do not meet in one task.

Defined results: a null site is a site of its own; a null text has no lines and stays null;
blank lines are never dropped; repeated rows count as pages of their own; an empty table gives
an empty result; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(line)


def row_salt(rows: DataFrame) -> Column:
    """A salt from all columns of a row, so that equal texts of a site are spread as well.

    It follows from the row alone: a task that runs again gives the same salts.
    """
    plain = [F.col(f"`{f.name}`") for f in rows.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int") if plain else F.lit(0)


def boilerplate_lines(pages: DataFrame, site: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """One row per site with boilerplate: ``site``, ``n_pages`` and ``drop``, its lines' keys."""
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.coalesce(text, F.lit(""))), lambda x: F.trim(x) != ""), _key))
    flat = pages.select(F.coalesce(site, F.lit("")).alias("site"), site.isNull().alias("none"), keys.alias("keys"))
    totals = flat.groupBy("site", "none").agg(F.count(F.lit(1)).alias("n_pages"))
    seen = flat.select("site", "none", F.explode("keys").alias("key")).groupBy("site", "none", "key").agg(F.count(F.lit(1)).alias("n"))
    common = seen.where(F.col("n") >= min_pages).join(totals, ["site", "none"]).where(F.col("n") > ratio * F.col("n_pages"))
    return common.groupBy("site", "none").agg(F.first("n_pages").alias("n_pages"), F.collect_set("key").alias("drop"))


def drop_boilerplate(
    pages: DataFrame, site: Column, text_col: str = "text", ratio: float = 0.2, min_pages: int = 5, keep_whole: bool = False, counts: tuple[str, str] | None = None
) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text_col``.

    With ``keep_whole``, a page of which nothing but blank lines would stay is left as it is.
    ``counts`` names two further columns: lines of the page, and lines dropped.
    """
    text = F.col(text_col)
    common = boilerplate_lines(pages, site, text, ratio, min_pages).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    common = common.select(*(F.col(c).alias(f"__{c}") for c in ("site", "none", "salt", "drop")))
    salted = pages.withColumns({"__s": F.coalesce(site, F.lit("")), "__n": site.isNull(), "__r": row_salt(pages)})
    met = salted.join(common, (F.col("__s") == F.col("__site")) & (F.col("__n") == F.col("__none")) & (F.col("__r") == F.col("__salt")), "left")
    # The page's own boilerplate, so that a line is not held against all of the site's.
    met = met.withColumn("__gone", F.when(F.col("__drop").isNotNull(), F.array_intersect(F.transform(lines_of(text), _key), "__drop")))
    met = met.withColumn("__gone", F.when(F.size("__gone") > 0, F.col("__gone")))
    kept = F.filter(lines_of(text), lambda x: (F.trim(x) == "") | ~F.array_contains("__gone", _key(x)))
    if keep_whole:
        kept = F.when(F.exists(kept, lambda x: F.trim(x) != ""), kept).otherwise(lines_of(text))
    columns = {text_col: F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n"))}
    if counts:
        n = F.coalesce(F.size(lines_of(text)), F.lit(0)).cast("long")
        columns |= {counts[0]: n, counts[1]: F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.coalesce(n - F.size(kept), F.lit(0))).cast("long")}
    order = [c for c in pages.columns if c not in columns]
    return met.select(*(F.col(f"`{c}`") for c in order), *(v.alias(k) for k, v in columns.items())).select(*(F.col(f"`{c}`") for c in (*pages.columns, *(c for c in columns if c not in pages.columns))))


def drop_passages(docs: DataFrame, min_docs: int, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with long lines that documents of any site share kept in one document only.

    A passage is a line of at least ``min_words`` words; on ``min_docs`` documents or more it
    stays in the one with the smallest id.  Documents of which nothing but blank lines is left
    go.  Rows that share an id are one document; rows without an id are left as they are.
    """
    text = F.col(text_col)
    long = lambda x: F.size(F.split(F.trim(x), r"\s+")) >= min_words
    keys = F.array_distinct(F.transform(F.filter(lines_of(text), long), _key))
    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.explode(keys).alias("__key")).distinct()
    shared = held.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first")).where(F.col("n") >= min_docs)
    # A hot passage is spread over many tasks, as a hot site is.
    shared = shared.select(F.col("__key").alias("__shared"), "__first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = held.withColumn("__r", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
    gone = salted.join(shared, (F.col("__key") == F.col("__shared")) & (F.col("__r") == F.col("__salt"))).where("__id <> __first")
    gone = gone.groupBy("__id").agg(F.collect_set("__key").alias("__gone"))
    kept = F.filter(lines_of(text), lambda x: ~(long(x) & F.array_contains("__gone", _key(x))))
    met = docs.join(gone, F.col(id_col) == F.col("__id"), "left").where(F.col("__gone").isNull() | F.exists(kept, lambda x: F.trim(x) != ""))
    done = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(text_col)
    return met.select(*(done if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def html_lines(html: Column) -> Column:
    """The text lines of a web page: scripts, styles and comments out, block tags break lines."""
    out = F.regexp_replace(html, r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)", " ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|br|li|ul|ol|nav|article|section|header|footer|h[1-6]|title|table|tr|td|th|body|head|html|main|aside|blockquote|pre)\b[^>]*+>", "\n")
    out = F.regexp_replace(out, r"<[^>]*+>", "")
    out = F.regexp_replace(F.translate(out, "\t\r", "  "), r"  ++", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]++| \n", "\n"), F.lit("\n "))


def host_of(url: Column) -> Column:
    """The lower-case host of an address; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)
