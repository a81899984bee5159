"""Reading raw judge output, scoring verdicts, building judge inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICT = "struct<checklist:array<struct<id:string,satisfied:boolean,reason:string>>,distractor_leakage:boolean,leakage_reason:string>"
ITEMS = "array<struct<id:string,satisfied:boolean,reason:string>>"

# Placeholder of an empty list and headings of the judge input.
NOTHING = "(none)"
JUDGE_HEADINGS = ("The user's question:\n", "\n\nChecklist:\n", "\n\nDistractor turns:\n", "\n\nAssistant's answer:\n")


def _valid(text: Column) -> Column:
    """The text if it is exactly one JSON value.

    The parser stops after the first value; inside brackets whatever follows it is
    a fault, or a second element.  Text that cannot be JSON is not parsed at all.
    """
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = v.isNotNull() & F.try_variant_get(v, "$[1]", "string").isNull()
    return F.when(text.rlike(r"^\s*[{\[]") & one, text)


def _computed(d: DataFrame, column: str) -> DataFrame:
    """``d`` with ``column`` behind a generator of one row, so that a filter reads its value.

    The optimizer moves a filter below projections and writes the whole expressions into it, where each use of a step
    is computed again; it does not move one below a generator of the column it reads.
    """
    return d.select(*[c for c in d.columns if c != column], F.explode(F.array(column)).alias(column))


def with_json_text(raw: DataFrame, text: str, out: str) -> DataFrame:
    """The JSON in a model response: fences stripped, else the outermost brackets.

    Each step is a column of its own, so that it is computed once per row.
    """
    d = raw.withColumn("_s", F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"(?s)^.*</think>\s*", ""))
    fenced = F.regexp_replace(F.regexp_replace("_s", r"^```[^\n]*\n?", ""), r"\s*```\s*$", "")
    d = d.withColumn("_b", F.when(F.col("_s").startswith("```"), fenced).otherwise(F.col("_s")))
    inner = lambda p: F.regexp_extract("_b", p, 1)
    d = d.withColumn(out, F.coalesce(_valid(F.col("_b")), _valid(inner(r"(?s)(\{.*\})")), _valid(inner(r"(?s)(\[.*\])"))))
    return _computed(d.drop("_s", "_b"), out)


def parse_verdicts(raw: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``items``, ``distractor_leakage`` and ``parsed``.

    A bare list is a checklist whose leakage is unknown.
    """
    d = with_json_text(raw, text, "_j")
    whole = F.when(F.ltrim("_j").startswith("["), F.concat(F.lit('{"checklist":'), "_j", F.lit("}"))).otherwise(F.col("_j"))
    return _computed(d.withColumn("_v", F.from_json(whole, VERDICT)), "_v").select(
        *raw.columns, F.col("_j").isNotNull().alias("parsed"), F.col("_v.checklist").alias("items"),
        F.col("_v.distractor_leakage").cast("int").alias("distractor_leakage"))


def item_map(items: Column) -> Column:
    """id -> satisfied; the last entry of an id counts, a missing verdict is false."""
    have = F.filter(items, lambda x: x["id"].isNotNull())
    return F.aggregate(
        have, F.create_map().cast("map<string,boolean>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["id"]),
                                  F.create_map(x["id"], F.coalesce(x["satisfied"], F.lit(False)))))


def items_from_text(text: Column) -> Column:
    """Items from a JSON list or from the literal form with single quotes and True / False."""
    literal = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("'"), F.lit('"')), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.coalesce(F.from_json(text, ITEMS), F.from_json(literal, ITEMS))


def score_verdicts(verdicts: DataFrame, checklists: DataFrame) -> DataFrame:
    """Share of required items satisfied; a missing item is not; NULL if none is required.

    verdicts(key, items), checklists(key, item, required).
    """
    j = checklists.select("key", "item", "required").join(verdicts.select("key", "items"), "key")
    last = F.try_element_at(F.filter("items", lambda x: x["id"] == F.col("item")), F.lit(-1))
    j = j.select("key", "required", last["satisfied"].alias("satisfied"))
    ok = F.coalesce(F.col("satisfied"), F.lit(False)).cast("int")
    return j.groupBy("key").agg(
        F.count_if("required").alias("n_required"), F.coalesce(F.sum(F.when(F.col("required"), ok)), F.lit(0)).alias("n_satisfied"),
        F.avg(F.when(F.col("required"), ok)).alias("checklist_score"),
        F.coalesce(F.min(F.when(F.col("required"), ok)), F.lit(1)).alias("all_required_satisfied"))


def judge_input(query: Column, checklist_json: Column, distractors: Column, answer: Column) -> Column:
    heads = [F.lit(h) for h in JUDGE_HEADINGS]
    listed = F.when(F.coalesce(distractors, F.lit("")) == "", F.lit(NOTHING)).otherwise(distractors)
    return F.concat(heads[0], query, heads[1], checklist_json, heads[2], listed, heads[3], answer)


def distractor_block(turn_id: Column, rendered: Column) -> Column:
    return F.concat(F.lit("--- "), turn_id, F.lit(" ---\n"), rendered)
