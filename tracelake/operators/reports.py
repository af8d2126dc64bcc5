"""The data of report tables: cells with intervals, the best of each column, significance marks; and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = "---"
#: Rows of a rendered table; a larger one is no report.
MOST_ROWS = 10_000


def cell(mean: Column, lo: Column, hi: Column) -> Column:
    """'0.123 (0.10-0.15)', without the interval if it is missing; a dash without a mean."""
    alone = F.format_string("%.3f", mean)
    both = F.format_string("%.3f (%.2f-%.2f)", mean, lo, hi)
    return F.when(mean.isNull(), GAP).when(lo.isNull() | hi.isNull(), alone).otherwise(both)


def marked_cells(cells: DataFrame, column: str, row: str, mean: str = "mean", lo: str = "ci_lo", hi: str = "ci_hi", significant: str | None = None) -> DataFrame:
    """row, column, text, best: each cell's text, the best of its column (ties: the first row by name), and '+' on cells whose
    difference is significant. Cells are summary rows."""
    w = Window.partitionBy(column).orderBy(F.desc_nulls_last(mean), row)
    mark = F.when(F.coalesce(F.col(significant), F.lit(False)), "+").otherwise("") if significant else F.lit("")
    x = cells.withColumn("best", (F.row_number().over(w) == 1) & F.col(mean).isNotNull())
    return x.select(row, column, F.concat(cell(F.col(mean), F.col(lo), F.col(hi)), mark).alias("text"), "best")


def table(cells: DataFrame, row: str, column: str, columns: list[str], bold: tuple[str, str] = ("**", "**")) -> DataFrame:
    """One row a row name, one text column a column name, the best in bold, missing cells as dashes."""
    t = F.when(F.col("best"), F.concat(F.lit(bold[0]), "text", F.lit(bold[1]))).otherwise(F.col("text"))
    x = cells.withColumn("text", t).groupBy(row).pivot(column, columns).agg(F.first("text"))
    return x.na.fill(GAP, columns).orderBy(row)


def _rows(summary: DataFrame) -> list:
    """A summary's rows on the driver; an error if there are more than MOST_ROWS."""
    rows = summary.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows: write the table instead")
    return rows


def markdown(summary: DataFrame) -> str:
    """A summary table as Markdown."""
    rows = [summary.columns, ["-"] * len(summary.columns), *([str(v) for v in r] for r in _rows(summary))]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def latex(summary: DataFrame) -> str:
    """The same as the body of a LaTeX tabular."""
    clean = lambda v: str(v).replace("_", r"\_").replace("%", r"\%")
    return "".join(" & ".join(map(clean, r)) + r" \\" + "\n" for r in [summary.columns, *_rows(summary)])


def acceptance(overall: DataFrame, strata: DataFrame, least_gain: float = 0.02, least_significant: int = 2, least_closed: float = 0.3) -> DataFrame:
    """Three checks of a router: gain over the base, strata with holm_p < .05, share of the oracle's gap closed; and all of them.
    overall: one row (routed, base, oracle); strata: holm_p."""
    n = strata.agg(F.count_if(F.coalesce(F.col("holm_p"), F.lit(1.0)) < 0.05).alias("n_significant"))
    gain, gap = F.col("routed") - F.col("base"), F.col("oracle") - F.col("base")
    x = overall.join(n, F.lit(True)).withColumn("gain", gain).withColumn("closed", F.when(gap > 0, gain / gap).when(gain > 0, F.lit(float("inf"))).otherwise(0.0))
    x = x.withColumn("check_gain", F.col("gain") >= least_gain).withColumn("check_strata", F.col("n_significant") >= least_significant).withColumn("check_gap", F.col("closed") >= least_closed)
    return x.select("gain", "n_significant", "closed", "check_gain", "check_strata", "check_gap", (F.col("check_gain") & F.col("check_strata") & F.col("check_gap")).alias("accepted"))


def search_summary(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, summary: the tool text of a search (hits: query_id, rank, id, module, heading). Its sentences are fixed values."""
    line = F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("] ("), "module", F.lit(" :: "), F.substring("heading", 1, 60), F.lit(")"))
    each = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("r"))
    told = each.select("query_id", F.concat(F.lit("Found "), F.size("r").cast("string"), F.lit(" requirements:\n"), F.array_join("r.line", "\n")).alias("summary"))
    return asked.select("query_id").join(told, "query_id", "left").withColumn("summary", F.coalesce("summary", F.lit("No matching requirements found.")))
