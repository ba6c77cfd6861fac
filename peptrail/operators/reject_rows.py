"""Rows that fail to parse, apart from those that load: explode cells, join a rule table, aggregate errors, anti-join the clean rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptrail.operators.skew import join_checked
from peptrail.session import cut_lineage
from peptrail.sources.pin_lines import data_lines, headers

# How text says that a value is missing.
MISSING = ("", "na", "n/a", "#n/a", "<na>", "n.a.", "nan", "null", "none", "nil", "-", "--", "?", ".", "missing", "unknown")
# Reasons in their order.
REASONS = ("broken_quote", "column_count", "invalid_value")
# Fixed values: (role, check) of the rule table; a cell fails if its check does.
RULES = (("identifier", "token"), ("proteins", "present"), ("label", "sign"), ("scannr", "unsigned"), ("expmass", "positive"), ("feature", "number"))

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WHOLE = r"^[+-]?[0-9]+$"


#: How a value is written: empty, whole, decimal, anything else; whole and decimal numbers that are too large for a double.
EMPTY, WHOLE_KIND, DECIMAL, OTHER, HUGE_WHOLE, HUGE = range(6)


def kind_of(v: Column) -> Column:
    """The kind of a value without blanks around it. Only numbers are cast: a cast that fails costs far more than a pattern."""
    finite = lambda kind, huge: F.when(F.abs(v.try_cast("double")) < F.lit(float("inf")), kind).otherwise(huge)
    whole = F.when(F.length(v) < 300, WHOLE_KIND).otherwise(finite(WHOLE_KIND, HUGE_WHOLE))
    return F.when(v == "", EMPTY).when(v.rlike(WHOLE), whole).when(v.rlike(NUMBER), finite(DECIMAL, HUGE)).otherwise(OTHER).cast("tinyint")


def role_of(no: Column, name: Column, width: Column) -> Column:
    """The role of column ``no`` (from 0): by place for identifier, peptide and proteins, by name for the rest."""
    low = F.lower(name)
    return (
        F.when(no == 0, "identifier").when(no == width - 1, "proteins").when(no == width - 2, "peptide").when(low.isin("label", "scannr", "expmass"), low).otherwise("feature")
    )


def holds(check: Column, v: Column, kind: Column) -> Column:
    """Whether value v (never null, without blanks around it) of a kind passes a check."""
    present = ~F.lower(v).isin(*MISSING)
    return (
        F.when(check == "token", present & ~v.rlike(r"(?U)[\s\p{Cc}�]"))
        .when(check == "present", present)
        .when(check == "sign", v.isin("1", "-1"))
        .when(check == "unsigned", kind.isin(WHOLE_KIND, HUGE_WHOLE) & ~v.startswith("-") & ~v.startswith("+"))
        .when(check == "positive", kind.isin(WHOLE_KIND, DECIMAL) & (v.try_cast("double") > 0))
        .when(check == "number", kind.isin(EMPTY, WHOLE_KIND, DECIMAL))
        .otherwise(True)
    )


def parsed_lines(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(line_id, file_id, header, roles, rank, values): every data line; rank 0 where the quoting is broken, 1 where the number of fields is
    wrong, else null, and then one value per header column; surplus fields belong to the last one."""
    d = data_lines(lines, heads)
    n, width = F.size("cells"), F.size("header")
    rank = F.when(F.col("cells").isNull(), 0).when((n < width) | ((n > width) & (F.col("suffix") != "pin")), 1)
    rest = F.array_join(F.filter(F.slice("cells", width, n), lambda c: c != ""), "\t")
    values = F.when(n == width, F.col("cells")).otherwise(F.concat(F.slice("cells", 1, width - 1), F.array(rest)))
    return d.select("line_id", "file_id", "header", "roles", rank.alias("rank"), F.when(rank.isNull(), values).alias("values"))


def _exploded(data: DataFrame) -> DataFrame:
    """(line_id, file_id, no, role, value, kind): the cells of lines that fit their header."""
    cells = data.where("rank is null").select("line_id", "file_id", F.posexplode(F.arrays_zip(F.col("roles").alias("role"), F.col("values").alias("value"))).alias("no", "c"))
    return cells.select("line_id", "file_id", "no", "c.role", "c.value").withColumn("kind", kind_of(F.col("value")))


def text_features(cells: DataFrame) -> DataFrame:
    """(file_id, no): the features (by place) that are text in their file.

    A feature is text if more than half of its non-empty values, over all lines that fit the header, are no numbers: single bad values
    don't turn a number column into text.
    """
    values = cells.where((F.col("role") == "feature") & (F.col("kind") != EMPTY))
    bad = F.count_if(~F.col("kind").isin(WHOLE_KIND, DECIMAL))
    return values.groupBy("file_id", "no").agg(bad.alias("bad"), F.count(F.lit(1)).alias("n")).where("2 * bad > n").select("file_id", "no")


def errors(data: DataFrame) -> DataFrame:
    """(line_id, reason): each failing line of parsed lines once, with the first reason that holds.

    Only cells that fail their check are joined with the text features, for which a word is no failure.
    """
    rules = F.broadcast(data.sparkSession.createDataFrame(list(RULES), "role string, check string"))
    cells = _exploded(data)
    wrong = cells.join(rules, "role").where(~holds(F.col("check"), F.col("value"), F.col("kind"))).select("line_id", "file_id", "no", "role")
    words = cut_lineage(text_features(cells)).withColumn("text", F.lit(True))
    invalid = join_checked(wrong, words, ["file_id", "no"], "line_id").where("role <> 'feature' or text is null").select("line_id")
    every = data.where("rank is not null").select("line_id", "rank").unionByName(invalid.withColumn("rank", F.lit(2)))
    return every.groupBy("line_id").agg(F.element_at(F.array(*map(F.lit, REASONS)), F.min("rank") + 1).alias("reason"))


def load_lines_with_headers(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, rejected, headers): as load_lines, and the headers (see pin_lines), made once."""
    width = F.size("header")
    roles = F.transform("header", lambda name, no: role_of(no, name, width))
    heads = cut_lineage(headers(lines, files).withColumn("roles", roles))
    data = cut_lineage(parsed_lines(lines, heads))  # lines are parsed once, whatever is asked of them
    rejected = errors(data)
    clean = data.where("rank is null").join(rejected.select("line_id"), "line_id", "left_anti")
    return clean.select("line_id", "file_id", "header", "values"), rejected, heads


def load_lines(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) of files given line by line.

    ``clean`` has line_id, file_id, header and values (one per header column) of each valid data line; ``rejected`` has line_id and the
    first reason of REASONS that holds. lines: line_id (unique), file_id, line_no, line_text; files: file_id, file_name. Null and blank
    lines, comments, DefaultDirection rows and repeats of a header are neither. Empty tables give empty tables; repeated lines count each
    time; a line of unbounded length is one cell row at a time. Files that hold most lines are salted where the headers are too many to be
    sent to all tasks (see join_checked).
    """
    return load_lines_with_headers(lines, files)[:2]
