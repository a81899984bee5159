"""Inputs derived from the driver tables: the same view as DataFrame and as SQL.

The SQL strings in ``VIEWS`` run in any engine that has the tables as views; the
functions build the same rows as DataFrames, with keys of any size in mind.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convgraph.functions.lineage import BATCH, cut_lineage, setting, small_parts
from convgraph.functions.splitwin import split_row_number
from convgraph.operators import graph

BUDGETS = (1024, 2048)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), "ts", "event_id", "event_type", "props")
    n = split_row_number(ev, ["sid"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")], "_pos", "_n")
    eid = F.col("event_id")
    return n.select(
        "sid", (F.col("_pos") - 1).alias("idx"), (F.col("_n") - F.col("_pos")).alias("rev"), "event_id",
        (20 + (eid * 37) % 180).alias("cost"), (eid % 500).alias("vec_id"), "event_type", "props",
        F.concat(F.lit("family_"), F.col("sid") % 13).alias("family"))


def edges(turns_: DataFrame) -> DataFrame:
    i = F.col("idx")
    parents = (F.when(i % 5 == 0, F.array(i - 1, i - 4)).when(i % 3 == 0, F.array(i - 3)).otherwise(F.array(i - 1)))
    return turns_.where("idx % 7 <> 0").select(
        "sid", i.alias("child"), F.posexplode(parents).alias("pos", "parent")
    ).select("sid", "child", "parent", "pos")


def evidence(closed: DataFrame) -> DataFrame:
    """The closure; one conversation in ten leaves out its earliest turn."""
    first = closed.where("sid % 10 = 0").groupBy("sid").agg(F.min("idx").alias("idx"))
    return closed.join(first, ["sid", "idx"], "left_anti")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def items(turns_: DataFrame) -> DataFrame:
    """Entities of each turn: the value of ``k`` and the event type, (sid, idx, item)."""
    k = F.get_json_object("props", "$.k")
    return turns_.select("sid", "idx", F.explode(F.array(F.concat(F.lit("k"), k), "event_type")).alias("item"))


class Conversations(NamedTuple):
    turns: DataFrame
    edges: DataFrame
    closed: DataFrame


def conversation_graph(spark: SparkSession, sf_dir: str) -> Conversations:
    # numbering turns shuffles the log once; every later step reads the result
    with small_parts(spark), setting(spark, BATCH, "1000"):
        t = cut_lineage(turns(spark, sf_dir))
        e = edges(t)
        return Conversations(t, e, cut_lineage(graph.closure(t, e)))


def one_conversation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All events as one conversation in order of time, with a near first parent and, for some turns, a far second one."""
    ev = table(spark, sf_dir, "events").select(F.lit(0).cast("bigint").alias("sid"), "ts", "event_id", F.col("user_id").alias("u"))
    n = split_row_number(ev, ["sid"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")], "_pos", "_n")
    t = cut_lineage(n.select("sid", (F.col("_pos") - 1).alias("idx"), (F.col("_n") - F.col("_pos")).alias("rev"), "u"))
    i, u = F.col("idx"), F.col("u")
    parents = F.array(F.struct(F.lit(0).alias("pos"), (i - 1 - u % 3).alias("parent")), F.struct(F.lit(1).alias("pos"), F.when(u % 40 == 0, F.floor(i / 2)).alias("parent")))
    e = t.select("sid", i.alias("child"), F.inline(parents)).where("parent >= 0").select("sid", "child", "parent", "pos")
    return t, e


VIEWS: dict[str, str] = {
    "turns": """
      SELECT user_id AS sid,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
             count(*) OVER (PARTITION BY user_id)
               - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev,
             event_id, 20 + (event_id * 37) % 180 AS cost, event_id % 500 AS vec_id,
             event_type, props, concat('family_', user_id % 13) AS family
      FROM events""",
    "edges": """
      SELECT sid, idx AS child,
             CASE WHEN idx % 5 <> 0 AND idx % 3 = 0 THEN idx - 3 ELSE idx - 1 END AS parent, 0 AS pos
      FROM turns WHERE idx % 7 <> 0
      UNION ALL
      SELECT sid, idx, idx - 4, 1 FROM turns WHERE idx % 7 <> 0 AND idx % 5 = 0""",
    "clo_all": """
      SELECT sid, idx FROM turns WHERE rev = 0
      UNION
      SELECT e.sid, e.parent FROM clo_all c JOIN edges e ON e.sid = c.sid AND e.child = c.idx""",
    "clo": """
      SELECT c.sid, c.idx FROM clo_all c JOIN turns t ON t.sid = c.sid AND t.idx = c.idx WHERE t.rev > 0""",
    "tree_all": """
      SELECT sid, idx FROM turns WHERE rev = 0
      UNION
      SELECT e.sid, e.parent FROM tree_all c JOIN edges e ON e.sid = c.sid AND e.child = c.idx AND e.pos = 0""",
    "tree": """
      SELECT c.sid, c.idx FROM tree_all c JOIN turns t ON t.sid = c.sid AND t.idx = c.idx WHERE t.rev > 0""",
    "ev": """
      SELECT sid, idx FROM clo
      WHERE NOT (sid % 10 = 0 AND idx = (SELECT min(c2.idx) FROM clo c2 WHERE c2.sid = clo.sid))""",
    "flagged": """
      SELECT t.*, e.idx IS NOT NULL AS is_evidence, e.idx IS NULL AND t.rev > 0 AS is_distractor
      FROM turns t LEFT JOIN ev e ON e.sid = t.sid AND e.idx = t.idx""",
    "budgets": "SELECT * FROM (VALUES (1024), (2048)) v(budget)",
    "unitv": """
      SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x
               / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u
      FROM embeddings""",
    "cosine": """
      SELECT h.sid, h.idx, list_inner_product(hv.u, qv.u) AS cosine
      FROM turns h JOIN turns q ON q.sid = h.sid AND q.rev = 0
      JOIN unitv hv ON hv.vec_id = h.vec_id JOIN unitv qv ON qv.vec_id = q.vec_id
      WHERE h.rev > 0""",
    "win": """
      SELECT sid, budget, idx, cost FROM (
        SELECT sid, idx, cost, rev, sum(cost) OVER (PARTITION BY sid ORDER BY rev) AS run
        FROM turns WHERE rev > 0) w JOIN budgets ON run <= budget""",
    "queue": """
      SELECT t.sid, b.budget, t.idx, t.cost,
             row_number() OVER (PARTITION BY t.sid, b.budget ORDER BY c.cosine DESC, t.idx) AS rk
      FROM turns t JOIN cosine c ON c.sid = t.sid AND c.idx = t.idx CROSS JOIN budgets b""",
    "fill": """
      SELECT sid, budget, rk, idx, cost, CASE WHEN cost <= budget THEN cost ELSE 0 END AS used,
             cost <= budget AS taken
      FROM queue WHERE rk = 1
      UNION ALL
      SELECT q.sid, q.budget, q.rk, q.idx, q.cost,
             CASE WHEN f.used + q.cost <= q.budget THEN f.used + q.cost ELSE f.used END,
             f.used + q.cost <= q.budget
      FROM fill f JOIN queue q ON q.sid = f.sid AND q.budget = f.budget AND q.rk = f.rk + 1""",
    "retr": "SELECT sid, budget, idx, cost FROM fill WHERE taken",
    "mqueue": """
      SELECT t.sid, b.budget, t.idx, t.cost,
             row_number() OVER (PARTITION BY t.sid ORDER BY c.cosine DESC, t.idx) AS rk
      FROM turns t JOIN cosine c ON c.sid = t.sid AND c.idx = t.idx
      JOIN (SELECT t2.sid, CAST(sum(t2.cost) AS BIGINT) AS budget FROM turns t2
            JOIN clo ON clo.sid = t2.sid AND clo.idx = t2.idx GROUP BY t2.sid) b ON b.sid = t.sid""",
    "mfill": """
      SELECT sid, budget, rk, idx, cost, CASE WHEN cost <= budget THEN cost ELSE 0 END AS used,
             cost <= budget AS taken
      FROM mqueue WHERE rk = 1
      UNION ALL
      SELECT q.sid, q.budget, q.rk, q.idx, q.cost,
             CASE WHEN f.used + q.cost <= q.budget THEN f.used + q.cost ELSE f.used END,
             f.used + q.cost <= q.budget
      FROM mfill f JOIN mqueue q ON q.sid = f.sid AND q.rk = f.rk + 1""",
    "mretr": "SELECT sid, budget, idx, cost FROM mfill WHERE taken",
    "items": """
      SELECT sid, idx, concat('k', json_extract_string(props, '$.k')) AS item FROM turns
      UNION ALL SELECT sid, idx, event_type FROM turns""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "edges": ("turns",), "clo_all": ("turns", "edges"), "clo": ("clo_all",), "tree_all": ("turns", "edges"),
    "tree": ("tree_all",), "ev": ("clo",), "flagged": ("turns", "ev"), "cosine": ("turns", "unitv"),
    "win": ("turns", "budgets"), "queue": ("turns", "cosine", "budgets"), "fill": ("queue",), "retr": ("fill",),
    "mqueue": ("turns", "cosine", "clo"), "mfill": ("mqueue",), "mretr": ("mfill",), "items": ("turns",),
}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the named views and everything they need."""
    done: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in done:
            done.append(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in done)
    return f"WITH RECURSIVE {ctes}\n{body}"
