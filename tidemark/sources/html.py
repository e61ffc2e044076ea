"""Numbers and tables out of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(pages: DataFrame, key: str, text: str, pattern: str, out: str) -> DataFrame:
    """(key, out): the first group of the pattern, null if there is no match."""
    return pages.select(key, F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias(out))


def only_match(pages: DataFrame, key: str, text: str, pattern: str, out: str) -> DataFrame:
    """(key, out, n_matches): null unless there is exactly one match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return pages.select(key, F.when(F.size(found) == 1, found[0]).alias(out), F.greatest(F.size(found), F.lit(0)).alias("n_matches"))


def all_matches(pages: DataFrame, key: str, text: str, pattern: str, out: str) -> DataFrame:
    return pages.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias(out))


class _Tables(HTMLParser):
    """Cells (table, row, column, head, text). Tables are numbered as they open; one inside a cell is a table of its own and adds
    nothing to the text of the cell. A cell that spans rows or columns stands at each of its places."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, bool, str]] = []
        self.n_tables = 0
        #: The open tables, innermost last.
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"table": self.n_tables, "row": -1, "col": 0, "taken": set(), "cell": None})
            self.n_tables += 1
        elif not self.open:
            return
        elif tag == "tr":
            self._close()
            self.open[-1]["row"] += 1
            self.open[-1]["col"] = 0
        elif tag in ("td", "th") and self.open[-1]["row"] >= 0:
            self._close()
            spans = dict(attrs)
            size = [min(1000, int(v)) if (v := spans.get(k) or "").isascii() and v.isdigit() and int(v) else 1 for k in ("rowspan", "colspan")]
            self.open[-1]["cell"] = (tag == "th", size, [])

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][2].append(data)

    def close(self):
        super().close()
        while self.open:
            self._close()
            self.open.pop()

    def _close(self):
        own = self.open[-1]
        if own["cell"]:
            head, (rows, cols), parts = own["cell"]
            text = " ".join("".join(parts).replace("\xa0", " ").split())
            while (own["row"], own["col"]) in own["taken"]:
                own["col"] += 1
            for i in range(rows):
                for j in range(cols):
                    own["taken"].add((own["row"] + i, own["col"] + j))
                    self.cells.append((own["table"], own["row"] + i, own["col"] + j, head, text))
            own["col"] += cols
            own["cell"] = None


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, col, head, cell) of every table of every page."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    names = ("table", "row", "col", "head", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                parser = _Tables()
                parser.feed(page or "")
                parser.close()
                rows += parser.cells
                at += [i] * len(parser.cells)
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, *names])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, table long, row long, col long, head boolean, cell string")


def year_columns(cells: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, table, col, year): columns under the first row that names `least` years or more."""
    years = cells.select(key, "table", "row", "col", F.regexp_extract("cell", r"^\s*((?:19|20)\d{2})\s*$", 1).try_cast("int").alias("year")).where(F.col("year").isNotNull())
    heads = years.groupBy(key, "table", "row").agg(F.count_distinct("year").alias("n")).where(F.col("n") >= least).groupBy(key, "table").agg(F.min("row").alias("row"))
    return years.join(heads, [key, "table", "row"]).select(key, "table", "col", "year")
