"""JSON from models and files as it comes: fenced, with words around it, in wrappers; what isn't JSON is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys under which a document may hold its rows.
WRAPPERS = ["rows", "golden_rows", "predictions"]
#: A member that follows a value which ends where it should.
END = "the value ends here"


def between(text: Column, opened: str, closed: str) -> Column:
    """From the first opening to the last closing bracket; null where there is none."""
    i = F.instr(text, opened)
    j = F.char_length(text) - F.instr(F.reverse(text), closed) + 1
    return F.when((i > 0) & (F.instr(text, closed) > 0) & (i < j), F.substring(text, i, j - i + 1))


def strict_json(text: Column) -> Column:
    """A text as VARIANT if the whole of it is one JSON value, else null. The parser itself stops after a value, so the text is read as the first of two members of a list."""
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))
    members = F.try_variant_get(pair, "$", "array<variant>")
    return F.when((F.size(members) == 2) & (F.try_variant_get(pair, "$[1]", "string") == END), F.get(members, F.lit(0)))


def loose_json(text: Column) -> Column:
    """A text as VARIANT: the whole text, without fences, or else its outermost braces or brackets; null where none is JSON."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = F.regexp_replace(F.regexp_replace(bare, r"^`+|`+$", ""), r"(?i)^json", "")
    bare = F.when(bare.startswith("```"), fenced).otherwise(bare)
    return F.coalesce(strict_json(bare), strict_json(between(bare, "{", "}")), strict_json(between(bare, "[", "]")))


def answer_text(body: Column) -> Column:
    """The text of a chat answer: message.content, or response; '' where it has neither."""
    v = strict_json(body)
    return F.coalesce(F.try_variant_get(v, "$.message.content", "string"), F.try_variant_get(v, "$.response", "string"), F.lit(""))


def field(value: Column, name: str, kind: str) -> Column:
    """A field of an object as `kind`; null where it is absent, of another kind, or not a number where one is asked for."""
    out = F.try_variant_get(value, f"$.{name}", kind)
    return F.when(~F.isnan(out), out) if kind in ("double", "float") else out


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of evaluation inputs: Parquet files, or JSON documents that hold a list, bare or under a wrapper's key.

    Columns are those of schema; an absent or unusable field is null, and so is NaN. A document without a list is an error. A document is read
    by one task, as JSON needs; many documents are read by many.
    """
    wanted = spark.createDataFrame([], schema).schema
    if path.lower().endswith((".parquet", ".pq")):
        rows = spark.read.parquet(path)
        same = {f.name: (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType) for f in wanted}
        return rows.select(*((F.when(~F.isnan(c), c) if wanted[n].dataType.typeName() in ("double", "float") else c).alias(n) for n, c in same.items()))
    documents = spark.read.text(path, wholetext=True).select(strict_json(F.col("value")).alias("v"))
    lists = F.coalesce(*(F.try_variant_get("v", f"$.{k}", "array<variant>") for k in WRAPPERS), F.try_variant_get("v", "$", "array<variant>"))
    found = documents.select(F.coalesce(lists, F.raise_error(F.lit("a document holds no list of rows")).cast("array<variant>")).alias("rows"))
    return found.select(F.explode("rows").alias("row")).select(*(field(F.col("row"), f.name, f.dataType.simpleString()).alias(f.name) for f in wanted))
