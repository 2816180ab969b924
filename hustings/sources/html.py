"""Tables in crawled pages (U2): Arrow batches through the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.functions.numbers import to_float, to_int


class _Tables(HTMLParser):
    """Rows of cells of each table; a nested table is a table of its own as well."""

    SKIP = frozenset({"script", "style", "sup"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipping += 1
        elif tag == "table":
            self.open.append({"caption": None, "rows": [], "cell": None, "in_caption": False})
            self.tables.append(self.open[-1])
        elif self.open:
            top = self.open[-1]
            if tag == "tr":
                top["rows"].append([])
                top["cell"] = None
            elif tag in ("td", "th"):
                if not top["rows"]:
                    top["rows"].append([])
                top["cell"] = []
                top["rows"][-1].append(top["cell"])
            elif tag == "caption":
                top["caption"], top["in_caption"] = [], True

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipping = max(self.skipping - 1, 0)
        elif self.open:
            top = self.open[-1]
            if tag in ("td", "th", "tr"):
                top["cell"] = None
            elif tag == "caption":
                top["in_caption"] = False
            elif tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.skipping or not data.strip():
            return
        for top in self.open:  # the text of a nested table is also text of the cell around it
            if top["in_caption"]:
                top["caption"].append(data.strip())
            elif top["cell"] is not None:
                top["cell"].append(data.strip())


def _tables(html: str | None):
    """(caption, rows of cells) of each table in order; caption None where there is none."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    for table in parser.tables:
        caption = None if table["caption"] is None else " ".join(table["caption"])
        yield caption, [[" ".join(" ".join(c).split()) for c in row] for row in table["rows"]]


def table_cells(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """All table rows of all pages: page_id, table, caption, row, cells."""

    def rows_of(html):
        for t, (caption, rows) in enumerate(_tables(html)):
            if caption and not rows:
                yield t, caption, -1, []  # a caption alone says something too
            for r, row in enumerate(rows):
                yield t, caption, r, row

    def parse(batches):
        for pdf in batches:
            out = [(i, *x) for i, html in zip(pdf["id"], pdf["html"], strict=True) for x in rows_of(html)]
            yield pd.DataFrame(out, columns=["page_id", "table", "caption", "row", "cells"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(parse, "page_id long, table int, caption string, row int, cells array<string>")


def chosen_tables(pages: DataFrame, wanted, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """The first table of each page for which ``wanted`` (caption, rows) gives the row above its content:
    (page_id, caption, head, rows below).  Pages without one go; only this table leaves the task."""

    def parse(batches):
        for pdf in batches:
            out = []
            for i, html in zip(pdf["id"], pdf["html"], strict=True):
                for caption, rows in _tables(html):
                    head = wanted(caption, rows)
                    if head is not None:
                        out.append((i, caption, head, rows[head + 1 :]))
                        break
            yield pd.DataFrame(out, columns=["page_id", "caption", "head", "rows"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(parse, "page_id long, caption string, head int, rows array<array<string>>")


def html_table_rows(pages: DataFrame, header_words, min_cells: int, header_anywhere: bool = False, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Rows below the header of the first table whose header row holds all words.

    The header is the first row of a table, or any row of any table
    (``header_anywhere``); rows with fewer cells go, and with ``header_anywhere`` rows
    without party and votes too.
    """
    words = tuple(header_words)

    def header(_, rows):
        return next((r for r, row in enumerate(rows if header_anywhere else rows[:1]) if all(w in " | ".join(row) for w in words)), None)

    chosen = chosen_tables(pages, header, html_col, id_col).select("page_id", "head", F.posexplode("rows").alias("at", "cells"))
    below = chosen.where(F.size("cells") >= min_cells)
    if header_anywhere:
        blank = (F.coalesce(F.get("cells", F.lit(2)), F.lit("")) == "") & (to_int(F.get("cells", F.lit(5)), 0) == 0)
        below = below.where(~blank)
    return below.select("page_id", (F.col("head") + 1 + F.col("at")).alias("row"), "cells")


def vote_rows(rows: DataFrame) -> DataFrame:
    """T6 rows of S5 and S6: serial, candidate, party, EVM, postal, total, percent."""
    at = lambda i: F.get("cells", F.lit(i))
    return rows.select(
        F.col("page_id").alias("contest"), F.col("row").alias("pos"), at(1).alias("name"), at(2).alias("party"),
        to_int(at(3), 0).alias("evm_votes"), to_int(at(4), 0).alias("postal_votes"), to_int(at(5), 0).alias("votes"), to_float(at(6), 0).alias("percent"),
    )


#: Row labels in order of preference (fixed values).
ELECTOR_LABELS = ("registered electors", "total electors", "electors")
VOTE_LABELS = ("turnout", "total votes polled", "votes polled", "total valid votes")


def labelled_table_facts(pages: DataFrame, caption_pattern: str, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Electors, votes, percent of the first table whose caption matches (``re.search``).

    Electors are the last whole number of the first row with such a label, else the
    number in brackets that ends the caption; votes are the first whole number, the
    percent the first decimal from 0 to 100.
    """
    pattern = re.compile(caption_pattern)
    own = chosen_tables(pages, lambda caption, rows: -1 if caption and pattern.search(caption) else None, html_col, id_col)

    def facts(cells: Column) -> Column:
        label = F.lower(F.array_join(F.slice(cells, 1, 3), " "))
        has = lambda labels: F.coalesce(*(F.when(F.contains(label, F.lit(w)), w) for w in labels))
        decimals = F.filter(F.transform(F.filter(cells, lambda c: F.contains(c, F.lit("."))), lambda c: to_float(c)), lambda x: x.between(0, 100))
        return F.struct(has(ELECTOR_LABELS).alias("e"), has(VOTE_LABELS).alias("v"), F.array_compact(F.transform(cells, lambda c: to_int(c))).alias("ints"), decimals.alias("decimals"))

    first = lambda on: F.get(F.filter("facts", on), F.lit(0))
    rows = own.select("page_id", "caption", F.transform("rows", facts).alias("facts")).select(
        "page_id", "caption", first(lambda x: x["e"].isNotNull() & (F.size(x["ints"]) > 0)).alias("electors_row"),
        first(lambda x: x["v"].isNotNull() & (F.size(x["ints"]) > 0)).alias("votes_row"), first(lambda x: x["v"].isNotNull() & (F.size(x["decimals"]) > 0)).alias("percent_row"),
    )
    in_caption = to_int(F.nullif(F.regexp_extract("caption", r"\(([0-9,]+)\)\s*$", 1), F.lit("")))
    return rows.select(
        "page_id", "caption", F.get("votes_row.ints", F.lit(0)).alias("votes"), F.col("votes_row.v").alias("votes_source"), F.get("percent_row.decimals", F.lit(0)).alias("percent"),
        F.coalesce(F.try_element_at("electors_row.ints", F.lit(-1)), in_caption).alias("electors"),
    )
