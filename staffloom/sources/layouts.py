"""Sheet layouts: what must be known of every sheet before its rows become a table with named columns.

Two phases.  ``discover`` writes one row of facts for each sheet: its header names, where its key column is, and where its data
ends.  ``Sheets.table`` is then one plan over the rows, without a shuffle of them: the columns come from the stored facts, so
headers that only some files have are columns too (null elsewhere), and the facts of a sheet are joined to its rows by
broadcast while there are few sheets.

Facts come from header rows, whose filter reaches the scan, and (for sheets whose data ends at a blank) from one aggregate
over the rows, with partial results before the shuffle: the first row with a blank key, or the first and last row with a key
in each stretch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from staffloom.functions.text import header_key, is_blank, normalize_header
from staffloom.operators.projection import MissingColumns
from staffloom.sources.scratch import stored
from staffloom.sources.sheets import header_end, is_footer, join_sheet_facts, sheet_headers, sheet_key, with_chunk
from staffloom.specs import rules

#: Facts are sent to every task while sheets times columns are no more: 16 MB of positions.
BROADCAST_POSITIONS = 4_000_000
#: Sheets whose key positions are sent to every task.
BROADCAST_SHEETS = 100_000
FIRST_BLANK, BLANK_ROW, BLANK_RUN = "first_blank", "blank_row", "blank_run"
Key = str | int | Callable[[Column], Column] | None


def last_position(headers: Column, name: str) -> Column:
    """1-based place of the last header called ``name``; null without one."""
    backwards = F.nullif(F.array_position(F.reverse(headers), F.lit(name)), F.lit(0).cast("long"))
    return F.size(headers) - backwards + 1


def first_with_words(*words: str) -> Callable[[Column], Column]:
    """Place of the first header that holds all words, in any case."""

    def place(headers: Column) -> Column:
        def hit(header: Column) -> Column:
            found = F.lit(True)
            for word in words:
                found = found & F.upper(header).contains(word.upper())
            return F.coalesce(found, F.lit(False))

        return F.nullif(F.array_position(F.transform(headers, hit), F.lit(True)), F.lit(0).cast("long"))

    return place


def _key_cell(key: Key, headers: Column, start_col: int) -> Column:
    """0-based cell of the key column."""
    if key is None:
        return F.lit(None).cast("int")
    if isinstance(key, int):
        return F.lit(key)
    place = last_position(headers, key) if isinstance(key, str) else key(headers)
    return (place - 1 + start_col).cast("int")


def _with_facts(rows: DataFrame, facts: DataFrame, broadcast: bool, how: str = "inner") -> DataFrame:
    """Rows with the facts of their sheet: by broadcast, or (very many sheets) on stretches of row numbers."""
    if broadcast:
        return rows.join(F.broadcast(facts), sheet_key(rows), how)
    return join_sheet_facts(with_chunk(rows), facts, how).drop("chunk")


def _ends(rows: DataFrame, heads: DataFrame, header_row: int, start_col: int, cut: str | None, run: int) -> DataFrame:
    """Where the data of each sheet ends, and its number of rows below the header; sheets without a header are there too."""
    by, row = sheet_key(rows), F.col("row_idx")
    few = heads.count() <= BROADCAST_SHEETS
    width = F.size("headers").alias("width")
    below = _with_facts(rows.filter(row > header_row), heads.select(*by, "key_cell", width), few, "left")
    landed = F.count(F.lit(1)).alias("landed")
    if cut is None:
        return below.groupBy(*by).agg(landed, F.lit(None).cast("long").alias("cut"))
    if cut == BLANK_ROW:
        window = F.slice("cells", F.lit(start_col + 1), F.greatest(F.col("width"), F.lit(0)))
        blank = F.col("width").isNotNull() & F.forall(window, is_blank)
    else:
        blank = F.when(F.col("key_cell").isNotNull(), is_blank(F.get(F.col("cells"), F.col("key_cell"))))
    if cut != BLANK_RUN:
        return below.groupBy(*by).agg(landed, F.min(F.when(blank, row)).alias("cut"))
    # rows with a key that lie further apart than the run are in different stretches of that length
    stretch = F.expr(f"row_idx div {run}L").alias("stretch")
    parts = below.groupBy(*by, stretch).agg(landed, F.min(F.when(~blank, row)).alias("first"), F.max(F.when(~blank, row)).alias("last"))
    later = Window.partitionBy(*by).orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last("first", ignorenulls=True).over(later)
    parts = parts.withColumn("end", F.when(following - F.col("last") > run, F.col("last")))
    return parts.groupBy(*by).agg(F.sum("landed").alias("landed"), F.min("end").alias("cut"))


@dataclass
class Sheets:
    """Rows with the stored facts of their sheets."""

    rows: DataFrame
    facts: DataFrame
    count: int
    header_row: int
    start_col: int
    cut: str | None
    _names: list[str] | None = None

    def names(self) -> list[str]:
        """Headers of all sheets: in order of their smallest position, then by name.

        The names become columns, so the driver has to know them.
        """
        if self._names is not None:
            return self._names
        found = self.facts.select(F.posexplode("headers").alias("pos", "name")).where(F.col("name").isNotNull())
        first = found.groupBy("name").agg(F.min("pos").alias("pos"))
        self._names = [row["name"] for row in first.orderBy("pos", "name").collect()]
        return self._names

    def undeclared(self, declared: Sequence[str], reserved: Sequence[str] = ()) -> list[str]:
        """Headers that are not among ``declared``, and whose names the table does not need for itself.

        Where the session does not tell names apart by case, of names that differ by case only the first one counts
        (and feeds on all of them: see ``table``).
        """
        plain = _fold(self.facts)
        taken = {plain(n) for n in (*declared, *reserved, *sheet_key(self.rows), "row_idx", "cells")}
        out = []
        for name in self.names():
            if plain(name) not in taken:
                taken.add(plain(name))
                out.append(name)
        return out

    def header_sets(self) -> DataFrame:
        """The dictionary of layouts: every distinct list of headers, with the number of its sheets and one of its files."""
        return self.facts.groupBy("headers").agg(F.count(F.lit(1)).alias("sheets"), F.min("source_file").alias("example"))

    def headless(self) -> DataFrame:
        """Sheets that have rows but no header."""
        by = sheet_key(self.facts)
        return self.facts.where(F.coalesce(F.size(F.filter("headers", lambda h: h.isNotNull())), F.lit(0)) <= 0).select(*by)

    def missing(self, wanted: Sequence[str]) -> DataFrame:
        """One row per sheet and wanted header it lacks; names are compared in normal form."""
        keys = F.transform(F.filter("headers", lambda h: h.isNotNull()), header_key)
        asked = F.array(*[F.lit(w) for w in wanted])
        lacking = F.filter(asked, lambda w: ~F.coalesce(F.array_contains(keys, header_key(w)), F.lit(False)))
        return self.facts.select(*sheet_key(self.facts), F.explode(lacking).alias("header"))

    def require(self, wanted: Sequence[str]) -> Sheets:
        """Fail when a sheet lacks a header; the error has all names that the first such sheet (by file and name) lacks."""
        lacking = self.missing(wanted).groupBy(*sheet_key(self.facts)).agg(F.sort_array(F.collect_set("header")).alias("names"))
        return self._fail(lacking)

    def require_key(self, name: str) -> Sheets:
        """Fail when a sheet has no key column."""
        return self._fail(self.facts.where(F.col("key_cell").isNull()).select(*sheet_key(self.facts), F.array(F.lit(name)).alias("names")))

    def _fail(self, lacking: DataFrame) -> Sheets:
        first = lacking.orderBy(*sheet_key(self.facts)).first()
        if first:
            raise MissingColumns(f"{first['source_file']} [{first['sheet']}]", first["names"])
        return self

    def _joined(self, rows: DataFrame, facts: DataFrame, width: int) -> DataFrame:
        return _with_facts(rows, facts, self.count * width <= BROADCAST_POSITIONS)

    def _kept(self) -> Column:
        """Rows before the sheet's end; where a run of blanks ends it, rows without a key go too."""
        row, cut = F.col("row_idx"), F.col("__cut")
        if self.cut == BLANK_RUN:
            key = F.get(F.col("cells"), F.col("__key"))
            return (F.col("__key").isNull() | ~is_blank(key)) & F.coalesce(row <= cut, F.lit(True))
        return F.coalesce(row < cut, F.lit(True))

    def table(
        self,
        wanted: Sequence[str],
        aliases: Mapping[str, str] | None = None,
        keyed: str | None = None,
        keep_cells: bool = False,
    ) -> DataFrame:
        """Data rows: sheet and row number, then the wanted headers as columns.

        A header that a sheet lacks gives null, which makes this the union by name of any number of differing sheets.
        Of two equal headers the last one counts.  ``aliases`` maps a header to the column it feeds; the column
        ``keyed`` is fed by the key's cell where its own name is not there.
        """
        plain = _fold(self.facts)
        spelled: dict[str, list[str]] = {name: [name] for name in wanted}
        if plain("A") == plain("a"):
            place = {plain(name): name for name in wanted}
            for header in self.names():
                target = place.get(plain(header))
                if target and header not in spelled[target]:
                    spelled[target].append(header)
        for header, target in (aliases or {}).items():
            if target in spelled and header not in spelled[target]:
                spelled[target].append(header)

        def cell_of(name: str) -> Column:
            own = [last_position(F.col("headers"), s) - 1 + self.start_col for s in spelled[name]]
            return F.coalesce(*own, *([F.col("key_cell")] if name == keyed else [])).cast("int")

        by = sheet_key(self.rows)
        places = F.array(*[cell_of(n) for n in wanted]).cast("array<int>")
        facts = self.facts.where(F.col("headers").isNotNull()).select(*by, places.alias("__at"), F.col("cut").alias("__cut"), F.col("key_cell").alias("__key"))
        data = self._joined(self.rows.filter(F.col("row_idx") > self.header_row), facts, len(wanted))
        if self.cut:
            data = data.filter(self._kept())
        cell = lambda i: F.get(F.col("cells"), F.get(F.col("__at"), F.lit(i)))
        return data.select(*by, "row_idx", *(["cells"] if keep_cells else []), *[cell(i).alias(n) for i, n in enumerate(wanted)])

    def accounting(self, footers: bool = False) -> DataFrame:
        """One row per sheet: data rows landed, cut off at the end, left out for want of a key, or (``footers``) as footers or for
        a missing first cell, kept, and the first row cut.  Landed is the sum of the other counts; a sheet without a header
        keeps nothing.

        The rows are read once more, and not shuffled: counts are made before the exchange.
        """
        by = sheet_key(self.rows)
        facts = self.facts.select(*by, F.col("headers").isNull().alias("__headless"), F.col("cut").alias("__cut"), F.col("key_cell").alias("__key"))
        data = self._joined(self.rows.filter(F.col("row_idx") > self.header_row), facts, 1)
        row, cut = F.col("row_idx"), F.col("__cut")
        beyond = F.coalesce(row > cut if self.cut == BLANK_RUN else row >= cut, F.lit(False))
        key = F.col("__key")
        no_key = key.isNotNull() & is_blank(F.get(F.col("cells"), key)) if self.cut == BLANK_RUN else F.lit(False)
        footer = is_footer(F.col("cells")) if footers else F.lit(False)
        empty = F.get(F.col("cells"), F.lit(0)).isNull() if footers else F.lit(False)
        fate = (
            F.when(F.col("__headless"), "headless").when(beyond, "cut").when(no_key, "no_key").when(footer, "footer").when(empty, "no_first_cell").otherwise("kept")
        )
        fates = ("headless", "cut", "no_key", "footer", "no_first_cell", "kept")
        told = data.select(*by, row, fate.alias("fate"))
        counts = [F.count_if(F.col("fate") == f).alias(f) for f in fates]
        return told.groupBy(*by).agg(F.count(F.lit(1)).alias("landed"), *counts, F.min(F.when(F.col("fate") == "cut", row)).alias("first_cut"))


def _fold(df: DataFrame) -> Callable[[str], str]:
    """How the session compares column names."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    return (lambda name: name) if sensitive else (lambda name: name.lower())


def discover(
    rows: DataFrame,
    header_row: int,
    start_col: int = 0,
    stop: str = "skip_blank",
    key: Key = None,
    cut: str | None = None,
    run: int = rules.BLANK_RUN,
    every: bool = False,
) -> Sheets:
    """Read the layouts of all sheets of ``rows`` and store them.

    ``key`` is the key column: a header, a 0-based cell, or a function from the headers to a 1-based place.  ``cut`` says what
    ends the data: the first row with a blank key, the first row blank under all headers, or ``run`` rows without a key
    after one with it; None if nothing does: then only header rows are read, unless ``every`` asks for the facts of sheets without
    one.  A sheet without the key column is not cut.
    """
    by = sheet_key(rows)
    heads = sheet_headers(rows, header_row, start_col, stop)
    heads = heads.select(*by, "headers", _key_cell(key, F.col("headers"), start_col).alias("key_cell"))
    if cut is None and not every:
        facts = stored(heads.withColumn("cut", F.lit(None).cast("long")), "sheet-facts")
    else:
        heads = stored(heads, "sheet-heads")
        facts = stored(heads.join(_ends(rows, heads, header_row, start_col, cut, run), by, "full"), "sheet-facts")
    return Sheets(rows, facts, facts.count(), header_row, start_col, cut)


def promote_header(
    rows: DataFrame,
    wanted: Sequence[str],
    header_row: int,
    start_col: int = 0,
    stop: str = "skip_blank",
    aliases: Mapping[str, str] | None = None,
    keep_cells: bool = False,
) -> DataFrame:
    """Data rows below the header: sheet and row number, then the wanted headers as columns."""
    return discover(rows, header_row, start_col, stop).table(wanted, aliases, keep_cells=keep_cells)


def select_by_header(rows: DataFrame, wanted: Sequence[str], header_row: int, start_col: int = 0) -> DataFrame:
    """Only the wanted columns; a sheet without one of them is an error that names the headers."""
    return discover(rows, header_row, start_col).require(wanted).table(wanted)


def missing_headers(rows: DataFrame, wanted: Sequence[str], header_row: int, start_col: int = 0) -> DataFrame:
    """One row per sheet and wanted header it lacks."""
    return discover(rows, header_row, start_col).missing(wanted)
