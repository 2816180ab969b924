"""Page analytics of filings: flags, tables, section bounds, spans, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages scanned, span of a section, and window where no end is found (fixed values).
MAX_PAGES, MAX_SPAN, NO_END_SPAN = 35, 25, 6

#: Headings and phrases (fixed patterns).
ANCHORS = {
    "s5_strict": r"(?i)\(\s*5\s*\)\s*Pending",
    "s5_loose": r"(?i)Pending\s+Criminal\s+Cases",
    "s6_strict": r"(?i)\(\s*6\s*\)\s*Cases\s+of\s+conviction",
    "s6_loose": r"(?i)have\s+not\s+been\s+convicted|convicted\s+for\s+the\s+offences|(?<!all\s)Cases?\s+of\s+Convict",
    "s7_strict": r"(?i)\(\s*7\s*\)\s*(?:That\s+I\s+give|details\s+of\s+the\s+assets)",
    "s7_loose": r"(?im)^\s*\(\s*7\s*\)\s*$|movable\s+(?:and\s+immovable\s+)?assets|details\s+of\s+(?:the\s+|movable|immovable|deposit|investment)",
    "pending_trigger": r"(?i)following\s+\S+\s+cases\s+are\s+pending|criminal\s+cases\s+are\s+pending",
    "conviction_trigger": r"(?i)convicted\s+for\s+the\s+offences",
    "no_pending": r"(?i)no\s+pending\s+criminal\s+case",
    "no_conviction": r"(?i)have\s+not\s+been\s+convicted",
}
_TOTAL = r"(?i)(?:total\s+(?:number\s+of\s+|no\.?\s+of\s+)?|number\s+of\s+|no\.?\s+of\s+)"
TOTALS = {
    "stated_pending": _TOTAL + r"pending\s+criminal\s+cases?\s*[:\-]?\s*([0-9]+)",
    "stated_convictions": _TOTAL + r"(?:cases?\s+of\s+conviction|convict(?:ed|ion)\s+cases?)\s*[:\-]?\s*([0-9]+)",
}
#: References, table rows and headers on a page (fixed patterns).
QUALIFIED = r"(?i)(?:cr(?:ime)?\.?\s*n?o?\.?|f\.?i\.?r\.?\s*n?o?\.?|case\s*no\.?)\s*[:.]?\s*[0-9]{1,5}\s*(?:/|of)\s*(?:19|20)?[0-9]{2}"
BARE = r"(?<![0-9A-Za-z_])[0-9]{1,5}\s*/\s*(?:19|20)[0-9]{2}(?![0-9A-Za-z_])"
ROW_LETTER = r"(?i)\(\s*([a-g])\s*\)"
PENAL = r"(?i)\bu/s\b|\bsec(?:tion)?s?\.?\s*[0-9]|\b[0-9]{2,3}\s*(?:r/?w\s*[0-9]+\s*)?(?:i\.?p\.?c|cr\.?p\.?c|ipc)\b"
CASE_HEADER = r"(?i)\bcase\s*[-:]?\s*([0-9]{1,3})\b"
TOP_ROW = r"(?m)^\W*(1(?:\W+2(?:\W+3(?:\W+4(?:\W+5(?:\W+6)?)?)?)?))\W*$"
ANNEXURE = r"(?i)annexure\s*[-:]?\s*[a-z]\s*[-:]?\s*legal\s+cases|legal\s+cases\s*[-:]?\s*annexure"
SEPARATE = r"(?i)as\s+per\s+separate"


#: What a page must hold, in lower case, for a pattern to have a chance: one of each group.  Plain
#: searches are far quicker than patterns, and most pages hold none of these.
NEEDS = {
    "s5_strict": [("pending",), ("5",)], "s5_loose": [("pending",)], "s6_strict": [("conviction",), ("6",)], "s6_loose": [("convict",)],
    "s7_strict": [("(",), ("7",)], "s7_loose": [("movable", "details", "7")], "pending_trigger": [("pending",)], "conviction_trigger": [("convicted",)],
    "no_pending": [("pending",)], "no_conviction": [("convicted",)], "stated_pending": [("pending",)], "stated_convictions": [("convict",)],
    "qualified": [("/", "of"), ("cr", "f.i", "fi", "case")], "bare": [("/",)], "case_header": [("case",)], "top_row": [("1",)], "row_letter": [("(",)],
    "penal": [("u/s", "sec", "pc", "p.c")], "annexure": [("annexure",)], "separate": [("separate",)], "applicable": [("appli",)],
}


def _lowered(pages: DataFrame) -> DataFrame:
    return pages.withColumn("__low", F.lower("text"))


def _may(name: str) -> Column:
    """Whether the pattern of that name has a chance on a page."""
    out = None
    for group in NEEDS[name]:
        any_ = F.contains("__low", F.lit(group[0]))
        for word in group[1:]:
            any_ = any_ | F.contains("__low", F.lit(word))
        out = any_ if out is None else out & any_
    return out


def page_flags(pages: DataFrame) -> DataFrame:
    """Which anchors a page holds, and the totals it states."""
    text = F.col("text")
    hit = {name: _may(name) & text.rlike(pattern) for name, pattern in ANCHORS.items()}
    stated = {name: F.when(_may(name), F.regexp_extract(text, pattern, 1)).try_cast("long") for name, pattern in TOTALS.items()}
    return _lowered(pages).withColumns({**hit, **stated}).drop("__low")


def page_table(pages: DataFrame) -> DataFrame:
    """What a page shows of case tables: references, headers, numbered top row, style."""
    text = F.col("text")
    none = F.array().cast("array<string>")

    def every(name: str, pattern: str, group=0) -> Column:
        return F.when(text.isNull() | _may(name), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)

    squeezed = F.transform(F.concat(every("qualified", QUALIFIED), every("bare", BARE)), lambda x: F.regexp_replace(x, r"\s+", ""))
    headers = F.filter(F.transform(every("case_header", CASE_HEADER, 1), lambda x: x.cast("int")), lambda x: x.between(1, 200))
    top = F.when(_may("top_row"), F.nullif(F.regexp_extract(text, TOP_ROW, 1), F.lit("")))
    found = _lowered(pages).withColumns({
        "firs": F.array_distinct(squeezed),
        "headers": F.array_sort(F.array_distinct(headers)),
        "top_max": F.size(F.split(top, r"\W+")),
        "letters": F.array_distinct(F.transform(every("row_letter", ROW_LETTER, 1), F.lower)),
        "penal": _may("penal") & text.rlike(PENAL),
        "annexure": _may("annexure") & text.rlike(ANNEXURE),
        "redirect": (F.size(every("separate", SEPARATE)) >= 3) & _may("annexure"),
        "inapplicable": _may("applicable") & F.col("__low").rlike("not appliciable|not applicable"),
    }).drop("__low")
    # The size of a null is not a number of its own in every mode.
    found = found.withColumn("top_max", F.when(F.col("top_max") >= 2, F.col("top_max")))
    any_fir, any_head = F.size("firs") > 0, F.size("headers") > 0
    grid = (F.size("letters") >= 3) & (any_fir | F.col("penal"))
    table = any_fir | any_head | F.col("top_max").isNotNull() | grid
    later = F.arrays_overlap("letters", F.array(*map(F.lit, "defg")))
    return found.withColumns({
        "has_table": table,
        "continuation": table & ~any_fir & ~F.array_contains("letters", "a") & later,
        "style": F.when(any_head, "style_3").when(F.col("top_max").isNotNull(), "style_2").when(table, "style_1"),
        "signal": table | F.col("inapplicable") | (F.size("letters") >= 2),
    }).drop("inapplicable")


#: What the index needs of a page: never its text.
KEPT = ("s5_strict", "s5_loose", "s6_strict", "s6_loose", "s7_strict", "s7_loose", "pending_trigger", "conviction_trigger", "stated_pending", "stated_convictions", "has_table", "style", "firs", "headers", "top_max", "annexure", "redirect", "signal")


def _first(flag: str, after: Column) -> Column:
    """First page after ``after`` on which ``flag`` is set."""
    return F.array_min(F.transform(F.filter("p", lambda x: x[flag] & (x["page"] > after)), lambda x: x["page"]))


def section_bounds(docs: DataFrame) -> DataFrame:
    """First page and way of finding of each section, each after the one before.

    A strict heading anywhere later wins over a loose one before it.
    """
    out = docs
    after = F.lit(0)
    for s in ("s5", "s6", "s7"):
        out = out.withColumns({f"{s}_a": _first(f"{s}_strict", after), f"{s}_b": _first(f"{s}_loose", after)})
        out = out.withColumns({s: F.coalesce(f"{s}_a", f"{s}_b"), f"{s}_how": F.when(F.col(f"{s}_a").isNotNull(), "header").when(F.col(f"{s}_b").isNotNull(), "fallback")}).drop(f"{s}_a", f"{s}_b")
        after = F.coalesce(*(F.col(x) for x in (("s5",) if s == "s5" else ("s6", "s5"))), F.lit(0))
    return out


def _span(start: Column, end: Column) -> Column:
    """Pages of a section: up to the next heading, capped; trailing pages without a sign of a table go."""
    last = F.least(F.when(end.isNotNull(), F.least(end - 1, start + MAX_SPAN - 1)).otherwise(start + NO_END_SPAN - 1), F.size("p"))
    seen = F.array_max(F.transform(F.filter("p", lambda x: x["signal"] & x["page"].between(start, last)), lambda x: x["page"]))
    empty = F.array().cast("array<int>")
    stop = F.greatest(start, F.coalesce(seen, start))
    return F.when(start.isNull() | (last < start), empty).otherwise(F.sequence(start, F.when(start.isNotNull() & (last >= start), stop)))


def _annexure() -> Column:
    """P5: pages from the first annexure on while they belong to it or show a table."""
    first = F.array_min(F.transform(F.filter("p", lambda x: x["annexure"]), lambda x: x["page"]))
    stop = F.array_min(F.transform(F.filter("p", lambda x: (x["page"] > first) & ~x["annexure"] & ~x["has_table"]), lambda x: x["page"]))
    run = F.sequence(first, F.coalesce(stop - 1, F.size("p")))
    return F.when(first.isNull(), F.array().cast("array<int>")).otherwise(F.slice(run, 1, MAX_SPAN))


def _stated(name: str) -> Column:
    """The first total that any page states."""
    return F.get(F.transform(F.filter("p", lambda x: x[name].isNotNull()), lambda x: x[name]), F.lit(0))


def _hint(pages: str) -> tuple[Column, Column]:
    """Style of a section's table and its count of cases."""
    of = F.filter("p", lambda x: F.array_contains(pages, x["page"]))
    heads = F.array_distinct(F.flatten(F.transform(of, lambda x: x["headers"])))
    firs = F.array_distinct(F.flatten(F.transform(of, lambda x: x["firs"])))
    tops = F.aggregate(of, F.lit(0), lambda a, x: a + F.coalesce(x["top_max"], F.lit(0)))
    styles = F.transform(of, lambda x: x["style"])
    three, two = F.array_contains(styles, "style_3") & (F.size(heads) > 0), F.array_contains(styles, "style_2")
    any_ = F.exists(styles, lambda s: s.isNotNull())
    yes = lambda c: F.coalesce(c, F.lit(False))
    style = F.when(yes(three), "style_3").when(yes(two), "style_2").when(yes(any_), "style_1")
    count = F.when(yes(three), F.size(heads)).when(yes(two), tops).when(yes(any_), F.nullif(F.size(firs), F.lit(0)))
    return style, count


def page_index(pages: DataFrame) -> DataFrame:
    """One row per document from (doc, page, text, method): sections, spans, styles, status.

    The text is dropped before the only shuffle; what is gathered of a document is at
    most ``MAX_PAGES`` rows of flags, pages counted from 1 without gaps.  ``total_pages``
    are the pages that were scanned.
    """
    flagged = page_table(page_flags(pages.where(F.col("page") <= MAX_PAGES))).select("doc", F.struct("page", "method", *KEPT).alias("x"))
    docs = flagged.groupBy("doc").agg(F.sort_array(F.collect_list("x")).alias("p"))
    out = section_bounds(docs)
    out = out.withColumns({
        "pending_pages": _span(F.col("s5"), F.coalesce("s6", "s7")),
        "conviction_pages": _span(F.col("s6"), F.col("s7")),
        "annexure_pages": _annexure(),
        "stated_pending": _stated("stated_pending"),
        "stated_convictions": _stated("stated_convictions"),
    })
    redirected = F.exists("p", lambda x: x["redirect"] & F.array_contains("pending_pages", x["page"]))
    out = out.withColumn("from_annexure", (F.size("annexure_pages") > 0) & (redirected | (F.size("pending_pages") == 0)))
    none = F.array().cast("array<int>")
    out = out.withColumns({
        "pending_pages": F.when(F.col("stated_pending") == 0, none).when(F.col("from_annexure"), F.col("annexure_pages")).otherwise(F.col("pending_pages")),
        "conviction_pages": F.when(F.col("stated_convictions") == 0, none).otherwise(F.col("conviction_pages")),
    })
    facts = {}
    for part in ("pending", "conviction"):
        facts[f"{part}_style"], facts[f"{part}_hint"] = _hint(f"{part}_pages")
    methods = F.array_distinct(F.transform("p", lambda x: x["method"]))
    return out.withColumns({
        **facts,
        "pending_trigger_page": _first("pending_trigger", F.lit(0)),
        "conviction_trigger_page": _first("conviction_trigger", F.lit(0)),
        "total_pages": F.size("p"),
        "extraction_method": F.when(F.size(methods) == 0, "empty").when(F.size(methods) == 1, F.get(methods, F.lit(0))).otherwise("mixed"),
        "status": F.when(F.col("s5").isNotNull() | F.col("s6").isNotNull(), "ok").otherwise("headers_missed"),
    }).drop("p")


def page_window(pages: DataFrame, first: int = 0, last: int = 0, backwards: bool = False, doc: str = "doc") -> DataFrame:
    """The texts of a document's first and last pages, joined in order (or backwards)."""
    up, down = Window.partitionBy(doc).orderBy("page"), Window.partitionBy(doc).orderBy(F.desc("page"))
    numbered = pages.withColumn("__up", F.row_number().over(up)).withColumn("__down", F.row_number().over(down))
    kept = numbered.where((F.col("__up") <= first) | (F.col("__down") <= last))
    listed = F.sort_array(F.collect_list(F.struct("page", "text")), asc=not backwards)
    return kept.groupBy(doc).agg(F.array_join(F.transform(listed, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def text_layer(pages: DataFrame, first: int = 5, sparse: int = 50, doc: str = "doc") -> DataFrame:
    """P10: whether any of the first pages has text, and how many pages have next to none."""
    length = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return pages.groupBy(doc).agg(F.bool_or((F.col("page") <= first) & (length > 0)).alias("has_text"), F.count_if(length < sparse).alias("sparse_pages"))


def summary_page(pages: DataFrame, last: int = 13, doc: str = "doc") -> DataFrame:
    """The first of the last pages that says PART B or SUMMARY."""
    text = F.upper("text")
    end = Window.partitionBy(doc)
    tail = pages.withColumn("__n", F.max("page").over(end)).where(F.col("page") > F.col("__n") - last)
    return tail.groupBy(doc).agg(F.min(F.when(F.contains(text, F.lit("PART B")) | F.contains(text, F.lit("SUMMARY")), F.col("page"))).alias("summary_page"))
