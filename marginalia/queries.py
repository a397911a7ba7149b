"""The named queries over the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.catalog import table
from marginalia.domain import Domain
from marginalia.functions import weights
from marginalia.functions.cells import cantor_pair
from marginalia.operators import encode, evaluate, factor, marginals, matrix, partition, privacy, ranges, shard, updates, workload
from marginalia.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# -- fixtures derived from the tables ----------------------------------------------------------

#: Encoded lineitem.
ITEMS = Domain.of({"rf": 3, "ls": 2, "qb": 8, "pb": 8, "db": 8, "tb": 8, "mo": 12, "ln": 7})

ITEMS_SQL = """
r AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0, max(l_extendedprice) AS p1,
             min(l_discount) AS d0, max(l_discount) AS d1, min(l_tax) AS t0, max(l_tax) AS t1 FROM lineitem),
enc AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS rf,
               CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS ls,
               CAST(greatest(0, ceil((l_quantity - q0) / ((q1 - q0) / 8)) - 1) AS INTEGER) AS qb,
               CAST(greatest(0, ceil((l_extendedprice - p0) / ((p1 - p0) / 8)) - 1) AS INTEGER) AS pb,
               CAST(greatest(0, ceil((l_discount - d0) / ((d1 - d0) / 8)) - 1) AS INTEGER) AS db,
               CAST(greatest(0, ceil((l_tax - t0) / ((t1 - t0) / 8)) - 1) AS INTEGER) AS tb,
               CAST(month(l_shipdate) - 1 AS INTEGER) AS mo, l_linenumber - 1 AS ln, l_orderkey, l_extendedprice FROM lineitem, r)"""


def items(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Lineitem as eight categorical columns."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_quantity").alias("qb"), F.col("l_extendedprice").alias("pb"),
        F.col("l_discount").alias("db"), F.col("l_tax").alias("tb"), (F.month("l_shipdate") - 1).alias("mo"), (F.col("l_linenumber") - 1).alias("ln"), *extra,
    )
    coded = encode.value_map(encode.value_map(raw, "rf", {"A": 0, "N": 1, "R": 2}), "ls", {"F": 0, "O": 1})
    return encode.discretise(coded, {"qb": 8, "pb": 8, "db": 8, "tb": 8})


def cell_sql(q: tuple[str, ...], domain: Domain = ITEMS, prefix: str = "") -> str:
    out = "0"
    for a in q:
        out = f"({out}) * {domain[a]} + {prefix}{a}"
    return f"CAST({out} AS BIGINT)"


def sets_sql(work, domain: Domain = ITEMS, of: str = "enc", by: str = "") -> str:
    """One row per cell with rows, of every query."""
    parts = [f"SELECT {by} '{','.join(q)}' AS query_id, {cell_sql(q, domain)} AS cell, count(*) AS cnt FROM {of} GROUP BY ALL" for q in work]
    return " UNION ALL ".join(parts)


FIVE = ["rf", "ls", "qb", "mo", "ln"]
CLOSURE = workload.closure(workload.k_way(FIVE, 3))


def uniform_sql(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"((CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def filled_sql(work, domain: Domain = ITEMS) -> str:
    cells = " UNION ALL ".join(f"SELECT '{','.join(q)}' AS query_id, CAST(range AS BIGINT) AS cell FROM range({domain.size(q)})" for q in work)
    return f"SELECT c.query_id, c.cell, coalesce(m.cnt, 0) AS cnt FROM ({cells}) c LEFT JOIN ({sets_sql(work, domain)}) m ON c.query_id = m.query_id AND c.cell = m.cell"


# -- sources, encoding -------------------------------------------------------------------------


@query("marginal_1way", "SELECT l_returnflag, count(*) AS cnt FROM lineitem GROUP BY l_returnflag")
def marginal_1way(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("cnt"))


@query("discretise_equal_width", f"WITH {ITEMS_SQL} SELECT qb, pb, db, tb, count(*) AS n FROM enc GROUP BY ALL")
def discretise_equal_width(spark, sf_dir):
    return items(spark, sf_dir).groupBy("qb", "pb", "db", "tb").agg(F.count("*").alias("n"))


@query("factorise_sorted", "SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code FROM orders")
def factorise_sorted(spark, sf_dir):
    return encode.factorise_sorted(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")


@query(
    "factorise_first_seen",
    """WITH f AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY min(c_custkey)) - 1 AS BIGINT) AS code FROM customer GROUP BY c_mktsegment)
    SELECT c_custkey, c_mktsegment, code FROM customer JOIN f USING (c_mktsegment)""",
)
def factorise_first_seen(spark, sf_dir):
    return encode.factorise_first_seen(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", "code")


@query("active_domain", "SELECT min(l_quantity) AS l_quantity_low, max(l_quantity) AS l_quantity_high, min(l_tax) AS l_tax_low, max(l_tax) AS l_tax_high FROM lineitem")
def active_domain(spark, sf_dir):
    return encode.ranges(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])


@query("infer_domain", f"WITH {ITEMS_SQL} SELECT CAST(max(qb) + 1 AS BIGINT) AS qb, CAST(count(DISTINCT rf) AS BIGINT) AS rf, CAST(max(mo) + 1 AS BIGINT) AS mo FROM enc")
def infer_domain(spark, sf_dir):
    found = encode.infer_domain(items(spark, sf_dir).select("qb", "rf", "mo"), "rf")
    return spark.createDataFrame([tuple(found.shape)], "qb bigint, rf bigint, mo bigint")


@query("value_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS o_orderstatus FROM orders")
def value_map(spark, sf_dir):
    return encode.value_map(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 0, "O": 1, "P": 2}, -1)


@query("one_hot", f"WITH {ITEMS_SQL} SELECT l_orderkey, [CAST(rf=0 AS INTEGER), CAST(rf=1 AS INTEGER), CAST(rf=2 AS INTEGER), CAST(ls=0 AS INTEGER), CAST(ls=1 AS INTEGER)] AS x FROM enc")
def one_hot(spark, sf_dir):
    return items(spark, sf_dir, "l_orderkey").select("l_orderkey", encode.one_hot_row(ITEMS.project(["rf", "ls"])).alias("x"))


@query("row_ids", "SELECT r_regionkey, r_name, CAST(row_number() OVER (ORDER BY r_regionkey, r_name) AS BIGINT) AS row_id FROM region")
def row_ids(spark, sf_dir):
    return encode.row_ids(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("where_and_project", "SELECT l_orderkey, l_tax FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'")
def where_and_project(spark, sf_dir):
    return encode.project(encode.where(table(spark, sf_dir, "lineitem"), "l_quantity > 40 AND l_returnflag = 'R'"), ["l_orderkey", "l_tax"])


@query("cantor_pairs", "SELECT c_custkey, CAST((c_custkey + c_nationkey) * (c_custkey + c_nationkey + 1) // 2 + c_nationkey AS BIGINT) AS pair FROM customer")
def cantor_pairs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", cantor_pair(F.col("c_custkey"), F.col("c_nationkey")).alias("pair"))


@query(
    "events_json",
    "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type",
)
def events_json(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


# -- marginals ---------------------------------------------------------------------------------


@query("marginal_grouping_sets", f"WITH {ITEMS_SQL} {filled_sql(CLOSURE)}")
def marginal_grouping_sets(spark, sf_dir):
    """All one- to three-way marginals of five attributes, zero cells included."""
    return marginals.zero_filled(marginals.marginals(items(spark, sf_dir), ITEMS, CLOSURE), ITEMS, CLOSURE)


@query("marginal_sql_path", f"WITH {ITEMS_SQL} {sets_sql(CLOSURE)}")
def marginal_sql_path(spark, sf_dir):
    """The same by GROUPING SETS, cells with rows only."""
    return marginals.grouping_sets(items(spark, sf_dir), ITEMS, CLOSURE)


@query("marginal_dense_path", f"WITH {ITEMS_SQL} {sets_sql(workload.some_way(list(ITEMS.attrs), (1, 2, 3)))}")
def marginal_dense_path(spark, sf_dir):
    """All 92 one- to three-way marginals of eight attributes, counted by Arrow batches."""
    return marginals.dense(items(spark, sf_dir), ITEMS, workload.some_way(list(ITEMS.attrs), (1, 2, 3)))


@query("marginal_2way_zero_fill", f"WITH {ITEMS_SQL} {filled_sql([('rf', 'mo'), ('qb', 'pb')])}")
def marginal_2way_zero_fill(spark, sf_dir):
    work = [("rf", "mo"), ("qb", "pb")]
    return marginals.zero_filled(marginals.grouping_sets(items(spark, sf_dir), ITEMS, work), ITEMS, work)


@query("marginal_weighted", f"WITH {ITEMS_SQL} SELECT {cell_sql(('rf', 'ls'))} AS cell, round(sum(l_extendedprice), 2) AS cnt FROM enc GROUP BY ALL")
def marginal_weighted(spark, sf_dir):
    rows = items(spark, sf_dir, "l_extendedprice")
    return marginals.datavector(rows, ITEMS, ("rf", "ls"), "l_extendedprice").select("cell", F.round("cnt", 2).alias("cnt"))


@query("histogram_edges", "SELECT CAST(CASE WHEN v = 4 THEN 3 ELSE v END AS BIGINT) AS cell, count(*) AS cnt FROM (SELECT l_linenumber AS v FROM lineitem) WHERE v <= 4 GROUP BY ALL")
def histogram_edges(spark, sf_dir):
    """A domain of 4 values over line numbers: 4 falls into the last cell, more than 4 nowhere."""
    return marginals.datavector(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("v")), Domain.of({"v": 4}), ("v",))


@query(
    "histogram_statistics",
    f"WITH {ITEMS_SQL}, m AS (SELECT qb, pb, count(*) AS cnt FROM enc GROUP BY ALL) SELECT CAST(sum(cnt) AS BIGINT) AS total, max(cnt) AS largest, count(*) / 64.0 AS nonzero_share FROM m",
)
def histogram_statistics(spark, sf_dir):
    return marginals.statistics(marginals.datavector(items(spark, sf_dir), ITEMS, ("qb", "pb")), 64)


@query(
    "marginal_normalised",
    f"WITH {ITEMS_SQL}, m AS ({sets_sql([('rf',), ('qb', 'ls')])}) SELECT query_id, cell, cnt / sum(cnt) OVER (PARTITION BY query_id) AS cnt FROM m",
)
def marginal_normalised(spark, sf_dir):
    return marginals.normalised(marginals.dense(items(spark, sf_dir), ITEMS, [("rf",), ("qb", "ls")]))


@query("marginal_batched", f"WITH {ITEMS_SQL} SELECT query_id, list(CAST(cnt AS DOUBLE) ORDER BY cell) AS y FROM ({filled_sql([('rf',), ('mo', 'ls')])}) GROUP BY query_id")
def marginal_batched(spark, sf_dir):
    work = [("rf",), ("mo", "ls")]
    return marginals.batched(marginals.zero_filled(marginals.dense(items(spark, sf_dir), ITEMS, work), ITEMS, work))


CLIENTS = Domain.of({"st": 3, "pr": 5, "tp": 16})
CLIENTS_SQL = """
r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders),
enc AS (SELECT c_nationkey AS client, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS st,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS pr,
               CAST(greatest(0, ceil((o_totalprice - a) / ((b - a) / 16)) - 1) AS INTEGER) AS tp
        FROM orders JOIN customer ON o_custkey = c_custkey, r)"""


def client_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as three categorical columns, held by 25 clients."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("st"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("pr"), F.col("o_totalprice").alias("tp"))
    coded = encode.discretise(encode.value_map(orders, "st", {"F": 0, "O": 1, "P": 2}), {"tp": 16})
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("client"))
    return coded.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("client", "st", "pr", "tp")


CLIENT_WORK = workload.closure([("st", "pr", "tp")])


@query("marginals_by_client", f"WITH {CLIENTS_SQL} {sets_sql(CLIENT_WORK, CLIENTS, by='client,')}")
def marginals_by_client(spark, sf_dir):
    return marginals.marginals(client_rows(spark, sf_dir), CLIENTS, CLIENT_WORK, "client", 25)


@query("marginals_by_client_sql_path", f"WITH {CLIENTS_SQL} {sets_sql(CLIENT_WORK, CLIENTS, by='client,')}")
def marginals_by_client_sql_path(spark, sf_dir):
    return marginals.grouping_sets(client_rows(spark, sf_dir), CLIENTS, CLIENT_WORK, ["client"])


@query("marginals_summed_over_clients", f"WITH {CLIENTS_SQL} {sets_sql(CLIENT_WORK, CLIENTS)}")
def marginals_summed_over_clients(spark, sf_dir):
    return marginals.summed_over(marginals_by_client(spark, sf_dir))


# -- workloads ---------------------------------------------------------------------------------


def _scores_sql() -> str:
    work, found = workload.k_way(FIVE, 3), CLOSURE
    w = ", ".join(f"({list(q)!r})" for q in work)
    c = ", ".join(f"('{','.join(q)}', {list(q)!r})" for q in found)
    return f"SELECT query_id, CAST(sum(len(list_intersect(attrs, w))) AS BIGINT) AS score FROM (VALUES {c}) c(query_id, attrs), (VALUES {w}) w(w) GROUP BY query_id"


@query("workload_scores", _scores_sql())
def workload_scores(spark, sf_dir):
    return workload.score_frame(workload.as_frame(spark, workload.k_way(FIVE, 3)), workload.as_frame(spark, CLOSURE))


@query("workload_complement", "SELECT * FROM (VALUES ('rf,qb'), ('ls,qb'), ('rf,mo'), ('ls,mo'), ('qb,mo')) v(query_id)")
def workload_complement(spark, sf_dir):
    found = workload.complement(["rf", "ls", "qb", "mo"], [("rf", "ls")], 2)
    return workload.as_frame(spark, found).select("query_id")


@query("workload_closure", "SELECT * FROM (VALUES ('1'), ('2'), ('3'), ('1,2'), ('2,3')) v(query_id)")
def workload_closure(spark, sf_dir):
    return workload.as_frame(spark, workload.closure([("1", "2"), ("2", "3")])).select("query_id")


@query("workload_target", "SELECT * FROM (VALUES ('rf,qb,ls'), ('rf,mo,ls'), ('qb,mo,ls')) v(query_id)")
def workload_target(spark, sf_dir):
    return workload.as_frame(spark, workload.k_way_target(["rf", "ls", "qb", "mo"], "ls", 3)).select("query_id")


@query("grid_product", "SELECT a.e AS eps, b.k AS k FROM (VALUES (0.5), (1.0), (2.0)) a(e), (VALUES (2), (3)) b(k) WHERE NOT (a.e = 2.0 AND b.k = 3)")
def grid_product(spark, sf_dir):
    from marginalia.plans import sweep

    tasks = sweep.grid(spark, {"eps": [0.5, 1.0, 2.0], "k": [2, 3]})
    return tasks.where("NOT (eps = 2.0 AND k = 3)").select("eps", F.col("k").cast("int").alias("k"))


# -- evaluation --------------------------------------------------------------------------------


def _errors_sql(columns: str) -> str:
    work = [("rf",), ("qb", "rf"), ("mo", "ls")]
    return f"""WITH {ITEMS_SQL}, a AS ({sets_sql(work, of="(SELECT * FROM enc WHERE l_orderkey % 2 = 0) x")}), b AS ({sets_sql(work, of="(SELECT * FROM enc WHERE l_orderkey % 2 = 1) x")}),
    n AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.cnt, 0) AS x, coalesce(b.cnt, 0) AS y FROM a FULL JOIN b ON a.query_id = b.query_id AND a.cell = b.cell),
    t AS (SELECT query_id, sum(x) AS sx, sum(y) AS sy FROM n GROUP BY query_id)
    SELECT {columns}"""


def _halves(spark, sf_dir):
    work = [("rf",), ("qb", "rf"), ("mo", "ls")]
    rows = items(spark, sf_dir, "l_orderkey")
    return tuple(marginals.dense(rows.where(F.col("l_orderkey") % 2 == k), ITEMS, work) for k in (0, 1))


@query(
    "workload_error",
    _errors_sql("n.query_id, round(sum(abs(x/sx - y/sy)), 9) AS l1, round(sqrt(sum((x/sx - y/sy) * (x/sx - y/sy))), 9) AS l2, round(sum(abs(x/sx - y/sy)) / 2, 9) AS tv, CAST(max(abs(x - y)) AS DOUBLE) AS largest FROM n JOIN t ON n.query_id = t.query_id GROUP BY n.query_id"),
)
def workload_error(spark, sf_dir):
    return evaluate.query_errors(*_halves(spark, sf_dir)).select("query_id", *(F.round(c, 9).alias(c) for c in ("l1", "l2", "tv")), "largest")


@query("relative_error", _errors_sql("CAST(sum(abs(x - y)) AS DOUBLE) / sum(abs(x)) AS error FROM n"))
def relative_error(spark, sf_dir):
    return evaluate.relative_l1(*_halves(spark, sf_dir))


@query(
    "heterogeneity_by_client",
    f"""WITH {CLIENTS_SQL}, m AS ({sets_sql(CLIENT_WORK, CLIENTS, by="client,")}),
    g AS (SELECT query_id, cell, sum(cnt) AS g FROM m GROUP BY ALL), gt AS (SELECT query_id, sum(g) AS gt FROM g GROUP BY ALL),
    c AS (SELECT client, query_id, sum(cnt) AS ct FROM m GROUP BY ALL),
    d AS (SELECT c.client, g.query_id, sum(abs(coalesce(m.cnt, 0) / ct - g.g / gt)) / 2 AS tv FROM c JOIN g ON c.query_id = g.query_id JOIN gt ON gt.query_id = g.query_id
          LEFT JOIN m ON m.client = c.client AND m.query_id = g.query_id AND m.cell = g.cell GROUP BY ALL),
    e AS (SELECT client, avg(tv) AS tv FROM d GROUP BY client)
    SELECT round(avg(tv), 9) AS mean, round(stddev_pop(tv), 9) AS deviation, round(min(tv), 9) AS least, round(max(tv), 9) AS largest FROM e""",
)
def heterogeneity_by_client(spark, sf_dir):
    found = evaluate.heterogeneity(marginals_by_client(spark, sf_dir), "client")
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query("quantiles_exact", "SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type")
def quantiles_exact(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.percentile("value", F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))))


@query(
    "running_statistics",
    "SELECT round(avg(value), 6) AS mean, round(sqrt(avg(value * value) - avg(value) * avg(value) + 1e-6), 6) AS deviation, min(value) AS least, max(value) AS largest, count(value) AS n FROM events",
)
def running_statistics(spark, sf_dir):
    found = evaluate.running_statistics(table(spark, sf_dir, "events"), "value")
    return found.select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "least", "largest", "n")


@query(
    "communication_totals",
    """WITH m AS (SELECT user_id AS client_id, event_type AS direction, CAST(8 * length(props) AS BIGINT) AS bytes FROM events), c AS (SELECT client_id, direction, sum(bytes) AS b FROM m GROUP BY ALL)
    SELECT direction, avg(b) AS per_client, CAST(sum(b) AS BIGINT) AS total FROM c GROUP BY direction""",
)
def communication_totals(spark, sf_dir):
    sent = table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), F.col("event_type").alias("direction"), (8 * F.length("props")).cast("long").alias("bytes"))
    return evaluate.communication_totals(sent)


# -- ranges, hierarchies, wavelets ---------------------------------------------------------------

LINE_SQL = """p AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
h AS (SELECT CAST(greatest(0, ceil((l_extendedprice - a) / ((b - a) / 64)) - 1) AS BIGINT) AS v, count(*) AS cnt FROM lineitem, p GROUP BY ALL),
line AS (SELECT CAST(range AS BIGINT) AS v, coalesce(cnt, 0) AS cnt FROM range(64) LEFT JOIN h ON v = range)"""


def price_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of prices in 64 bins, a row per bin."""
    rows = encode.discretise(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("v")), {"v": 64})
    return ranges.dense_line(rows.groupBy(F.col("v").cast("long").alias("v")).agg(F.count("*").alias("cnt")), 64)


@query("prefix_sums", f"WITH {LINE_SQL} SELECT v, CAST(sum(cnt) OVER (ORDER BY v) AS BIGINT) AS total FROM line")
def prefix_sums(spark, sf_dir):
    return ranges.prefix_sums(price_line(spark, sf_dir), stride=16)


@query("suffix_sums", f"WITH {LINE_SQL} SELECT v, CAST(sum(cnt) OVER (ORDER BY v DESC) AS BIGINT) AS total FROM line")
def suffix_sums(spark, sf_dir):
    return ranges.suffix_sums(price_line(spark, sf_dir))


@query("all_ranges", f"WITH {LINE_SQL} SELECT a.v AS low, b.v AS high, (SELECT CAST(sum(cnt) AS BIGINT) FROM line c WHERE c.v BETWEEN a.v AND b.v) AS total FROM line a JOIN line b ON a.v <= b.v")
def all_ranges(spark, sf_dir):
    return ranges.all_ranges(price_line(spark, sf_dir))


@query("width_k_ranges", f"WITH {LINE_SQL} SELECT low, total FROM (SELECT v AS low, CAST(sum(cnt) OVER (ORDER BY v ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT) AS total FROM line) WHERE low <= 59")
def width_k_ranges(spark, sf_dir):
    return ranges.width_k(price_line(spark, sf_dir), 5)


@query("range_queries", f"WITH {LINE_SQL}, q AS (SELECT CAST(k * 3 % 40 AS BIGINT) AS low, CAST(k * 3 % 40 + k % 20 AS BIGINT) AS high FROM (SELECT range AS k FROM range(30))) SELECT low, high, (SELECT CAST(sum(cnt) AS BIGINT) FROM line WHERE v BETWEEN low AND high) AS total FROM q")
def range_queries(spark, sf_dir):
    asked = spark.range(30).select((F.col("id") * 3 % 40).alias("low"), (F.col("id") * 3 % 40 + F.col("id") % 20).alias("high"))
    return ranges.range_queries(price_line(spark, sf_dir), asked)


@query("hierarchy_h2", f"WITH {LINE_SQL} SELECT level, node, CAST(sum(cnt) AS BIGINT) AS total FROM (SELECT CAST(k AS INTEGER) AS level, v >> k AS node, cnt FROM line, (SELECT range AS k FROM range(7))) GROUP BY ALL")
def hierarchy_h2(spark, sf_dir):
    return ranges.hierarchy(price_line(spark, sf_dir), 64, 2)


@query("hierarchy_hb", f"WITH {LINE_SQL} SELECT level, node, CAST(sum(cnt) AS BIGINT) AS total FROM (SELECT CAST(k AS INTEGER) AS level, CAST(v // CAST(power({ranges.best_branching(64)}, k) AS BIGINT) AS BIGINT) AS node, cnt FROM line, (SELECT range AS k FROM range(9) WHERE power({ranges.best_branching(64)}, range) < 64 * {ranges.best_branching(64)})) GROUP BY ALL")
def hierarchy_hb(spark, sf_dir):
    return ranges.hierarchy(price_line(spark, sf_dir), 64, ranges.best_branching(64))


@query(
    "haar_wavelet",
    f"""WITH {LINE_SQL} SELECT 0 AS level, CAST(0 AS BIGINT) AS node, CAST(sum(cnt) AS BIGINT) AS coefficient FROM line UNION ALL
    SELECT level, v // (64 >> (level - 1)) AS node, CAST(sum(CASE WHEN (v // (64 >> level)) % 2 = 0 THEN cnt ELSE -cnt END) AS BIGINT) FROM line, (SELECT CAST(range AS INTEGER) AS level FROM range(1, 7)) GROUP BY ALL""",
)
def haar_wavelet(spark, sf_dir):
    return ranges.haar(price_line(spark, sf_dir), 64)


@query("line_moments", f"WITH {LINE_SQL} SELECT CAST(k AS INTEGER) AS power, CAST(sum(power(v, k) * cnt) AS DOUBLE) AS total FROM line, (SELECT range AS k FROM range(3)) GROUP BY k")
def line_moments(spark, sf_dir):
    return ranges.moments(price_line(spark, sf_dir), 3)


GRID_SQL = """p AS (SELECT min(l_quantity) AS qa, max(l_quantity) AS qb, min(l_extendedprice) AS pa, max(l_extendedprice) AS pb FROM lineitem),
h AS (SELECT CAST(greatest(0, ceil((l_quantity - qa) / ((qb - qa) / 64)) - 1) AS INTEGER) AS x, CAST(greatest(0, ceil((l_extendedprice - pa) / ((pb - pa) / 64)) - 1) AS INTEGER) AS y, count(*) AS cnt FROM lineitem, p GROUP BY ALL)"""


def price_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of (quantity, price) on a grid of 64 by 64, cells with rows only."""
    rows = encode.discretise(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), {"x": 64, "y": 64})
    return rows.groupBy("x", "y").agg(F.count("*").alias("cnt"))


@query("quad_tree", f"WITH {GRID_SQL} SELECT CAST(k AS INTEGER) AS level, x >> CAST(k AS INTEGER) AS x, y >> CAST(k AS INTEGER) AS y, CAST(sum(cnt) AS BIGINT) AS total FROM h, (SELECT range AS k FROM range(7)) GROUP BY ALL")
def quad_tree(spark, sf_dir):
    return ranges.quad_tree(price_grid(spark, sf_dir), 64)


@query("grid_2d", f"WITH {GRID_SQL} SELECT CAST(x // 10 AS BIGINT) AS gx, CAST(y // 10 AS BIGINT) AS gy, CAST(sum(cnt) AS BIGINT) AS total FROM h GROUP BY ALL")
def grid_2d(spark, sf_dir):
    return ranges.uniform_grid(price_grid(spark, sf_dir), 10)


@query("grid_adaptive", f"WITH {GRID_SQL}, g AS (SELECT x // 16 AS gx, y // 16 AS gy, sum(cnt) AS noisy FROM h GROUP BY ALL), w AS (SELECT gx, gy, CAST(ceil(16.0 / greatest(1, least(16, ceil(sqrt(noisy * 0.1 / 5.0))))) AS INTEGER) AS w FROM g) SELECT CAST(x // 16 AS BIGINT) AS gx, CAST(y // 16 AS BIGINT) AS gy, CAST((x % 16) // w AS INTEGER) AS sx, CAST((y % 16) // w AS INTEGER) AS sy, CAST(sum(cnt) AS BIGINT) AS total FROM h JOIN w ON x // 16 = gx AND y // 16 = gy GROUP BY ALL")
def grid_adaptive(spark, sf_dir):
    grid = price_grid(spark, sf_dir)
    first = ranges.uniform_grid(grid, 16).select("gx", "gy", F.col("total").cast("double").alias("noisy"))
    return ranges.adaptive_grid(grid, first, 16, 0.1)


@query("range_queries_2d", f"WITH {GRID_SQL}, q AS (SELECT CAST(k % 30 AS INTEGER) AS x_low, CAST(k % 30 + 20 AS INTEGER) AS x_high, CAST(k * 7 % 25 AS INTEGER) AS y_low, CAST(k * 7 % 25 + k AS INTEGER) AS y_high FROM (SELECT range AS k FROM range(35))) SELECT q.*, (SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) FROM h WHERE x BETWEEN x_low AND x_high AND y BETWEEN y_low AND y_high) AS total FROM q")
def range_queries_2d(spark, sf_dir):
    cells = spark.range(64 * 64).select(F.expr("CAST(id div 64 AS INT)").alias("x"), (F.col("id") % 64).cast("int").alias("y"))
    full = cells.join(price_grid(spark, sf_dir), ["x", "y"], "left").select("x", "y", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    k = F.col("id")
    asked = spark.range(35).select((k % 30).cast("int").alias("x_low"), (k % 30 + 20).cast("int").alias("x_high"), (k * 7 % 25).cast("int").alias("y_low"), (k * 7 % 25 + k).cast("int").alias("y_high"))
    return ranges.range_queries_2d(full, asked)


# -- factors -----------------------------------------------------------------------------------


def _factor(spark, sf_dir, q):
    return items(spark, sf_dir).groupBy(*q).agg(F.count("*").cast("double").alias("v"))


_F = "WITH {e}, f AS (SELECT rf, qb, CAST(count(*) AS DOUBLE) AS v FROM enc GROUP BY ALL), g AS (SELECT qb, ls, CAST(count(*) AS DOUBLE) AS v FROM enc GROUP BY ALL) ".format(e=ITEMS_SQL)


@query("factor_product", _F + "SELECT rf, qb, ls, f.v * g.v AS v FROM f JOIN g USING (qb)")
def factor_product(spark, sf_dir):
    return factor.product(_factor(spark, sf_dir, ["rf", "qb"]), _factor(spark, sf_dir, ["qb", "ls"]))


@query("factor_divide", _F + "SELECT rf, qb, ls, CASE WHEN g.v > 0 THEN f.v / g.v ELSE 0 END AS v FROM f JOIN g USING (qb)")
def factor_divide(spark, sf_dir):
    return factor.divided(_factor(spark, sf_dir, ["rf", "qb"]), _factor(spark, sf_dir, ["qb", "ls"]))


@query("factor_log_add", _F + "SELECT rf, qb, ls, round(ln(f.v + g.v), 9) AS v FROM f JOIN g USING (qb)")
def factor_log_add(spark, sf_dir):
    log = lambda q: _factor(spark, sf_dir, q).withColumn("v", F.log("v"))
    return factor.log_added(log(["rf", "qb"]), log(["qb", "ls"])).withColumn("v", F.round("v", 9))


@query("factor_marginalise", _F + "SELECT rf, sum(v) AS v FROM f GROUP BY rf")
def factor_marginalise(spark, sf_dir):
    return factor.summed(_factor(spark, sf_dir, ["rf", "qb"]), ["rf"])


@query("factor_max", _F + "SELECT qb, max(v) AS v FROM f GROUP BY qb")
def factor_max(spark, sf_dir):
    return factor.maximised(_factor(spark, sf_dir, ["rf", "qb"]), ["qb"])


@query("factor_logsumexp", _F + "SELECT rf, round(ln(sum(v)), 9) AS v FROM f GROUP BY rf")
def factor_logsumexp(spark, sf_dir):
    return factor.log_summed(_factor(spark, sf_dir, ["rf", "qb"]).withColumn("v", F.log("v")), ["rf"]).withColumn("v", F.round("v", 9))


@query("factor_condition", _F + "SELECT qb, v FROM f WHERE rf = 1")
def factor_condition(spark, sf_dir):
    return factor.conditioned(_factor(spark, sf_dir, ["rf", "qb"]), {"rf": 1})


# -- matrices, partitions ------------------------------------------------------------------------


def _vector(spark, sf_dir):
    return price_line(spark, sf_dir).select(F.col("v").alias("cell"), F.col("cnt").cast("double").alias("x"))


@query("matrix_multiply", f"WITH {LINE_SQL} SELECT v AS q, CAST(sum(cnt) OVER (ORDER BY v) AS DOUBLE) AS y FROM line")
def matrix_multiply(spark, sf_dir):
    return matrix.multiply(matrix.prefix(spark, 64), _vector(spark, sf_dir))


@query("matrix_gram", "SELECT CAST(a.range AS BIGINT) AS q, CAST(b.range AS BIGINT) AS cell, CAST(16 - greatest(a.range, b.range) AS DOUBLE) AS val FROM range(16) a, range(16) b")
def matrix_gram(spark, sf_dir):
    return matrix.gram(matrix.prefix(spark, 16))


@query("matrix_sensitivity", "SELECT 17.0 AS sensitivity")
def matrix_sensitivity(spark, sf_dir):
    both = matrix.vstack([(matrix.identity(spark, 16), 16), (matrix.prefix(spark, 16), 16)])
    return matrix.sensitivity_l1(both)


@query("matrix_kronecker", f"WITH {LINE_SQL} SELECT CAST((a.v // 8) * 8 + a.v % 8 AS BIGINT) AS q, CAST((SELECT sum(cnt) FROM line b WHERE b.v // 8 <= a.v // 8 AND b.v % 8 <= a.v % 8) AS DOUBLE) AS y FROM line a")
def matrix_kronecker(spark, sf_dir):
    """Prefix sums in both directions of an 8 by 8 table."""
    p = matrix.prefix(spark, 8)
    return matrix.multiply_kronecker(p, p, _vector(spark, sf_dir), 8, 8)


@query("partition_grid_reduce", f"WITH {LINE_SQL} SELECT CAST((v // 8) // 4 * 4 + (v % 8) // 2 AS BIGINT) AS \"group\", CAST(sum(cnt) AS BIGINT) AS cnt FROM line GROUP BY ALL")
def partition_grid_reduce(spark, sf_dir):
    mapping = partition.grid(spark, (8, 8), (4, 2))
    return partition.reduce_by(price_line(spark, sf_dir).withColumnRenamed("v", "cell"), mapping)


@query("partition_striped_split", f"WITH {LINE_SQL} SELECT v % 8 AS \"group\", v // 8 AS place, cnt FROM line")
def partition_striped_split(spark, sf_dir):
    return partition.split_by(price_line(spark, sf_dir).withColumnRenamed("v", "cell"), partition.striped(spark, (8, 8), 0))


@query("partition_expand", f"WITH {LINE_SQL} SELECT v AS cell, sum(cnt) OVER (PARTITION BY v // 8) / 8 AS cnt FROM line")
def partition_expand(spark, sf_dir):
    mapping = partition.by_coordinate(spark, (8, 8), 0)
    return partition.expand_by(partition.reduce_by(price_line(spark, sf_dir).withColumnRenamed("v", "cell"), mapping), mapping)


@query("partition_by_workload", "SELECT CAST(range AS BIGINT) AS cell, CAST(CASE WHEN range < 4 THEN 0 WHEN range < 10 THEN 1 ELSE 2 END AS BIGINT) AS \"group\" FROM range(12)")
def partition_by_workload(spark, sf_dir):
    rows = [(0, k, 1.0) for k in range(4)] + [(1, k, 2.0) for k in range(10)]
    return partition.by_workload(spark.createDataFrame(rows, "q bigint, cell bigint, val double"), partition.cells_of(spark, (12,)))


@query("partition_boxes", "SELECT CAST((x // 2) * 2 + y // 3 AS BIGINT) AS \"group\", CAST(min(x) AS INTEGER) AS low0, CAST(max(x) AS INTEGER) AS high0, CAST(min(y) AS INTEGER) AS low1, CAST(max(y) AS INTEGER) AS high1, true AS rectangular FROM (SELECT range // 6 AS x, range % 6 AS y FROM range(24)) GROUP BY ALL")
def partition_boxes(spark, sf_dir):
    return partition.bounding_boxes(partition.grid(spark, (4, 6), (2, 3)), (4, 6))


@query("hilbert_order")
def hilbert_order(spark, sf_dir):
    """Each cell's place on the Hilbert curve of a 64 by 64 grid."""
    return partition.hilbert(spark, 64)


# -- noise and private choice ----------------------------------------------------------------------


@query("noisy_marginal_laplace", f"WITH {ITEMS_SQL}, m AS ({filled_sql([('rf', 'mo')])}), u AS (SELECT *, {uniform_sql('7', 'query_id', 'cell')} - 0.5 AS u FROM m) SELECT query_id, cell, round(cnt + 2.0 * (-sign(u) * ln(1 - 2 * abs(u))), 6) AS noisy FROM u")
def noisy_marginal_laplace(spark, sf_dir):
    work = [("rf", "mo")]
    full = marginals.zero_filled(marginals.dense(items(spark, sf_dir), ITEMS, work), ITEMS, work)
    return privacy.laplace(full, "cnt", 2.0, 1.0, "7", ["query_id", "cell"]).select("query_id", "cell", F.round("noisy", 6).alias("noisy"))


@query("noisy_marginal_gauss", f"WITH {ITEMS_SQL}, m AS ({filled_sql([('rf', 'mo'), ('qb',)])}), u AS (SELECT *, {uniform_sql('7a', 'query_id', 'cell')} AS u, {uniform_sql('7b', 'query_id', 'cell')} AS v FROM m) SELECT query_id, cell, round(cnt + 3.0 * sqrt(-2 * ln(u)) * cos(6.283185307179586 * v), 6) AS noisy FROM u")
def noisy_marginal_gauss(spark, sf_dir):
    work = [("rf", "mo"), ("qb",)]
    full = marginals.zero_filled(marginals.dense(items(spark, sf_dir), ITEMS, work), ITEMS, work)
    return privacy.gaussian(full, "cnt", 3.0, 1.0, "7", ["query_id", "cell"]).select("query_id", "cell", F.round("noisy", 6).alias("noisy"))


@query("exp_mech_gumbel", f"WITH q AS (SELECT c_mktsegment AS item, count(*) AS quality FROM customer GROUP BY ALL) SELECT item FROM q ORDER BY quality * 0.05 - ln(-ln({uniform_sql('11', 'item')})) DESC LIMIT 1")
def exp_mech_gumbel(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("item")).agg(F.count("*").alias("quality"))
    return privacy.exponential_choice(scored, "item", "quality", 0.1, 1.0, "11")


@query("exp_mech_probabilities", "WITH q AS (SELECT c_mktsegment AS item, count(*) AS quality FROM customer GROUP BY ALL) SELECT item, round(exp((quality - (SELECT max(quality) FROM q)) * 0.05) / (SELECT sum(exp((quality - (SELECT max(quality) FROM q)) * 0.05)) FROM q), 9) AS p FROM q")
def exp_mech_probabilities(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("item")).agg(F.count("*").alias("quality"))
    return privacy.exponential_probabilities(scored, "quality", 0.1, 1.0).select("item", F.round("p", 9).alias("p"))


@query("permute_and_flip", f"WITH q AS (SELECT c_mktsegment AS item, count(*) AS quality FROM customer GROUP BY ALL) SELECT item FROM q ORDER BY quality * 0.05 - ln({uniform_sql('12', 'item')}) DESC LIMIT 1")
def permute_and_flip(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("item")).agg(F.count("*").alias("quality"))
    return privacy.permute_and_flip(scored, "item", "quality", 0.1, 1.0, "12")


@query("noisy_max", f"WITH q AS (SELECT c_mktsegment AS item, count(*) AS score FROM customer GROUP BY ALL), u AS (SELECT *, {uniform_sql('13', 'item')} - 0.5 AS u FROM q) SELECT item FROM u ORDER BY score + 20.0 * (-sign(u) * ln(1 - 2 * abs(u))) DESC LIMIT 1")
def noisy_max(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("item")).agg(F.count("*").alias("score"))
    return privacy.noisy_max(scored, "item", "score", 0.1, 1.0, "13")


@query("pareto_front", "SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal >= a.s_acctbal AND b.s_nationkey <= a.s_nationkey AND (b.s_acctbal > a.s_acctbal OR b.s_nationkey < a.s_nationkey))")
def pareto_front(spark, sf_dir):
    return privacy.pareto(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_acctbal", "s_nationkey").select("s_suppkey")


@query("rare_values_merged", "WITH c AS (SELECT p_size AS v, CAST(count(*) AS DOUBLE) AS noisy FROM part GROUP BY ALL), k AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM c WHERE noisy >= 40) SELECT c.v, coalesce(k.code, (SELECT CAST(count(*) AS INTEGER) FROM k)) AS code FROM c LEFT JOIN k ON c.v = k.v")
def rare_values_merged(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("v")).agg(F.count("*").cast("double").alias("noisy"))
    return privacy.rare_cells_merged(counts, "v", "noisy", 40.0)


# -- sharding, cohorts ------------------------------------------------------------------------------


@query("iid_split", f"SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY {uniform_sql('3', 'o_orderkey')}, o_orderkey) - 1 AS INTEGER) AS client_id FROM orders")
def iid_split(spark, sf_dir):
    return shard.iid(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 3)


@query("round_robin_shard", "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 10 AS INTEGER) AS shard FROM events")
def round_robin_shard(spark, sf_dir):
    return shard.round_robin(table(spark, sf_dir, "events").select("event_id"), "event_id", 10)


@query("sequential_shard", "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 64 AS INTEGER) AS shard FROM events")
def sequential_shard(spark, sf_dir):
    return shard.sequential(table(spark, sf_dir, "events").select("event_id"), "event_id", 64)


@query("random_shard", f"SELECT event_id, CAST(CASE WHEN k < 10 THEN k ELSE floor({uniform_sql('5', 'event_id')} * 10) END AS INTEGER) AS shard FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events)")
def random_shard(spark, sf_dir):
    return shard.random(table(spark, sf_dir, "events").select("event_id"), "event_id", 10, 5)


@query("broadcast_shard", "SELECT n_nationkey, CAST(range AS INTEGER) AS shard FROM nation, range(10)")
def broadcast_shard(spark, sf_dir):
    return shard.broadcasted(table(spark, sf_dir, "nation").select("n_nationkey"), 10)


def _weights_sql(w) -> str:
    total, at, out = sum(w), 0.0, []
    for x in w[:-1]:
        at += x
        out.append(at / total)
    return " + ".join(f"CAST({u!r} <= u AS INTEGER)" for u in out)


@query("zipf_sample_skew", f"SELECT event_id, {_weights_sql([1 / k**1.5 for k in range(1, 9)])} AS client_id FROM (SELECT event_id, {uniform_sql('6', 'event_id')} AS u FROM events)")
def zipf_sample_skew(spark, sf_dir):
    return shard.sample_skew(table(spark, sf_dir, "events").select("event_id"), "event_id", 8, 1.5, 6)


@query("power_law_shard", f"SELECT event_id, {_weights_sql([(k / 6) ** 2 for k in range(1, 7)])} AS shard FROM (SELECT event_id, {uniform_sql('8', 'event_id')} AS u FROM events)")
def power_law_shard(spark, sf_dir):
    return shard.by_weights(table(spark, sf_dir, "events").select("event_id"), "event_id", shard.power_law_weights(6, 3.0), 8)


def _dirichlet_sql(of: str, key: str, label: str, seed: int, classes: int, clients: int, beta: float, out: str) -> str:
    """Sizes from drawn shares and rows cut at them, by windows; ``of`` has the columns key and y."""
    rng = np.random.default_rng(seed)
    shares = ", ".join(f"({k}, {j}, CAST('{float(x)!r}' AS DOUBLE))" for k in range(classes) for j, x in enumerate(rng.dirichlet(np.full(clients, beta))))
    return f"""WITH t AS ({of}), c AS (SELECT y, count(*) AS n, row_number() OVER (ORDER BY y) - 1 AS k FROM t GROUP BY y), p(k, j, share) AS (VALUES {shares}),
    z AS (SELECT y, n, j, greatest(CAST(floor(share * n) AS BIGINT), 1) AS m FROM c JOIN p USING (k)),
    d AS (SELECT *, n - sum(m) OVER (PARTITION BY y) AS gap, row_number() OVER (PARTITION BY y ORDER BY m, j) AS low, row_number() OVER (PARTITION BY y ORDER BY m DESC, j) AS high FROM z),
    e AS (SELECT y, sum(m + CASE WHEN (gap > 0 AND low = 1) OR (gap < 0 AND high = 1) THEN gap ELSE 0 END) OVER (PARTITION BY y ORDER BY j) AS stop FROM d),
    r AS (SELECT {key}, y, row_number() OVER (PARTITION BY y ORDER BY {uniform_sql(str(seed), key)}, {key}) AS place FROM t)
    SELECT {out}, CAST(sum(CASE WHEN stop < place THEN 1 ELSE 0 END) AS INTEGER) AS client_id FROM r JOIN e USING (y) GROUP BY {key}, y"""


@query("label_skew_dirichlet", _dirichlet_sql("SELECT o_orderkey, o_orderstatus AS y FROM orders", "o_orderkey", "o_orderstatus", 1, 3, 10, 0.5, "o_orderkey, y AS o_orderstatus"))
def label_skew_dirichlet(spark, sf_dir):
    """Rows of each order status to ten clients by Dirichlet proportions."""
    return shard.label_skew(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 10, 0.5, 1)


@query("sample_skew_dirichlet", _dirichlet_sql("SELECT event_id, 0 AS y FROM events", "event_id", "y", 2, 1, 8, 1.5, "event_id"))
def sample_skew_dirichlet(spark, sf_dir):
    """Events to eight clients of Dirichlet sizes."""
    return shard.sample_skew_dirichlet(table(spark, sf_dir, "events").select("event_id"), "event_id", 8, 1.5, 2)


@query("label_skew_capped")
def label_skew_capped(spark, sf_dir):
    """Rows of each order priority to six clients, of which full ones take no more; tests hold it to brute force."""
    return shard.label_skew_capped(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 6, 0.5, 3)


@query("poisson_cohort", f"SELECT CAST(r.range AS BIGINT) AS round, CAST(n_nationkey AS INTEGER) AS client_id FROM nation, range(20) r WHERE {uniform_sql('9', 'r.range', 'n_nationkey')} < 0.2")
def poisson_cohort(spark, sf_dir):
    clients = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("client_id"))
    return shard.poisson(clients, 0.2, spark.range(20).withColumnRenamed("id", "round"), 9)


@query("uniform_cohort", f"SELECT round, client_id FROM (SELECT CAST(r.range AS BIGINT) AS round, CAST(n_nationkey AS INTEGER) AS client_id, row_number() OVER (PARTITION BY r.range ORDER BY {uniform_sql('4', 'r.range', 'n_nationkey')}, n_nationkey) AS k FROM nation, range(20) r) WHERE k <= 5")
def uniform_cohort(spark, sf_dir):
    clients = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("client_id"))
    return shard.uniform(clients, 5, spark.range(20).withColumnRenamed("id", "round"), 4)


@query("round_robin_cohort", f"SELECT CAST((row_number() OVER (ORDER BY {uniform_sql('2', '0', 'n_nationkey')}, n_nationkey) - 1) // 4 AS BIGINT) AS round, CAST(n_nationkey AS INTEGER) AS client_id FROM nation")
def round_robin_cohort(spark, sf_dir):
    clients = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("client_id"))
    return shard.round_robin_cohorts(clients, 4, 2)


@query("importance_cohort", f"WITH c AS (SELECT c_nationkey AS client_id, count(*) AS n FROM customer GROUP BY ALL) SELECT CAST(r.range AS BIGINT) AS round, client_id FROM c, range(20) r WHERE {uniform_sql('10', 'r.range', 'client_id')} < n * 5 / (SELECT sum(n) FROM c)")
def importance_cohort(spark, sf_dir):
    clients = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("client_id")).agg(F.count("*").alias("n"))
    return shard.importance(clients, 5, 10, spark.range(20).withColumnRenamed("id", "round"))


@query("user_batches", "SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS BIGINT) AS batch FROM events")
def user_batches(spark, sf_dir):
    return shard.batches(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 4)


@query("train_test_split", f"SELECT doc_id, {uniform_sql('1', 'doc_id')} < 0.8 AS train FROM labels")
def train_test_split(spark, sf_dir):
    a, b = shard.train_test(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 0.8, 1)
    return a.withColumn("train", F.lit(True)).unionByName(b.withColumn("train", F.lit(False)))


# -- federated updates --------------------------------------------------------------------------------

UPDATES_SQL = "u AS (SELECT vec_id AS client_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def vector_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("client_id"), (F.col("label") + 1).cast("double").alias("weight"))


@query("fedavg_weighted", f"WITH {UPDATES_SQL} SELECT idx, round(sum((label + 1) * v) / sum(label + 1), 9) AS v FROM u GROUP BY idx")
def fedavg_weighted(spark, sf_dir):
    return updates.reduced(vectors(spark, sf_dir), vector_weights(spark, sf_dir), "weighted_average").select("idx", F.round("v", 9).alias("v"))


@query("reduce_average", f"WITH {UPDATES_SQL} SELECT idx, round(avg(v), 9) AS v FROM u GROUP BY idx")
def reduce_average(spark, sf_dir):
    return updates.reduced(vectors(spark, sf_dir)).select("idx", F.round("v", 9).alias("v"))


_NORMS = f"WITH {UPDATES_SQL}, n AS (SELECT client_id, sqrt(sum(v * v)) AS norm FROM u GROUP BY client_id) "


@query("clip_updates", _NORMS + "SELECT client_id, idx, round(v * least(1.0, 0.5 / (norm + 1e-10)), 9) AS v FROM u JOIN n USING (client_id)")
def clip_updates(spark, sf_dir):
    return updates.clipped(vectors(spark, sf_dir), 0.5).select("client_id", "idx", F.round("v", 9).alias("v"))


@query("private_average", _NORMS + f"SELECT idx, round(sum(v * least(1.0, 0.5 / (norm + 1e-10))) / (SELECT count(*) FROM n) + 0.5 * 0.1 / (SELECT count(*) FROM n) * sqrt(-2 * ln({uniform_sql('5a', 'idx')})) * cos(6.283185307179586 * {uniform_sql('5b', 'idx')}), 9) AS v FROM u JOIN n USING (client_id) GROUP BY idx")
def private_average(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return updates.private_average(vectors(spark, sf_dir), n, 0.5, 0.1, 5).select("idx", F.round("v", 9).alias("v"))


@query("topk_sparse_mask", f"WITH {UPDATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY abs(v), idx) AS k, count(*) OVER (PARTITION BY client_id) AS n FROM u) SELECT client_id, idx, CASE WHEN k <= floor(0.9 * n) THEN 0.0 ELSE v END AS v FROM r")
def topk_sparse_mask(spark, sf_dir):
    return updates.top_k_masked(vectors(spark, sf_dir), 0.9)


@query("scalar_quantise", f"WITH {UPDATES_SQL}, s AS (SELECT client_id, least(min(v), 0.0) AS a, greatest(max(v), 0.0) AS b FROM u GROUP BY client_id), z AS (SELECT *, (b - a) / 255 AS s FROM s), q AS (SELECT client_id, idx, least(greatest(round_even(v / s, 0) - round_even(a / s, 0), 0), 255) AS q, s, -round_even(a / s, 0) AS z FROM u JOIN z USING (client_id)) SELECT client_id, idx, round((q - z) * s, 9) AS v, CAST(q AS BIGINT) AS q FROM q")
def scalar_quantise(spark, sf_dir):
    return updates.quantised(vectors(spark, sf_dir)).select("client_id", "idx", F.round("v", 9).alias("v"), "q")


@query("fixed_point_secagg", f"WITH {UPDATES_SQL}, f AS (SELECT idx, CAST(round_even(greatest(-32768, least(32767, v * 100)), 0) AS BIGINT) AS f FROM u), s AS (SELECT idx, CAST(sum(f) AS BIGINT) AS s FROM f GROUP BY idx) SELECT idx, CAST(s % 32768 AS BIGINT) AS fixed, (s % 32768) / 100.0 AS v, CAST(0 AS BIGINT) AS overflowed FROM s")
def fixed_point_secagg(spark, sf_dir):
    return updates.secure_sum(vectors(spark, sf_dir), 100.0, 2, 2)


@query("diversity_metrics", f"WITH {UPDATES_SQL}, i AS (SELECT idx, sum(v) AS s, sum(v * v) AS q FROM u GROUP BY idx), t AS (SELECT sum(s * s) AS a, sum(q) AS b FROM i) SELECT round(a, 6) AS norm_of_sum, round(b, 6) AS sum_of_norms, round(b / a, 6) AS diversity, round(b / (a - b), 6) AS orthogonality FROM t")
def diversity_metrics(spark, sf_dir):
    found = updates.diversity(vectors(spark, sf_dir))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query("message_bytes", f"WITH {UPDATES_SQL} SELECT client_id, CAST(least((count(*) - floor(0.9 * count(*))) * 12, (count(*) - floor(0.9 * count(*))) * 4 + ceil(count(*) / 8)) AS BIGINT) AS bytes FROM u GROUP BY client_id")
def message_bytes(spark, sf_dir):
    return updates.message_bytes(vectors(spark, sf_dir), "sparse", 0.9)


# -- events ---------------------------------------------------------------------------------------------

ARRIVALS_SQL = "a AS (SELECT event_id, user_id AS client_id, epoch_us(ts) / 1e6 AS start_time, 60 + 600 * abs(value) AS duration FROM events), o AS (SELECT *, start_time + duration AS end_time FROM a)"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trainings that start at an event and last by its value."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    base = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client_id"), start.alias("start_time"), (60 + 600 * F.abs("value")).alias("duration"))
    return base.withColumn("end_time", F.col("start_time") + F.col("duration"))


@query("fedbuff_batches", f"WITH {ARRIVALS_SQL} SELECT event_id, CAST((row_number() OVER (ORDER BY end_time, event_id) - 1) // 10 AS BIGINT) AS version FROM o")
def fedbuff_batches(spark, sf_dir):
    from marginalia.streaming import simulate

    return simulate.buffered(arrivals(spark, sf_dir), 10).select("event_id", "version")


@query(
    "staleness_asof",
    f"""WITH {ARRIVALS_SQL}, v AS (SELECT *, CAST((row_number() OVER (ORDER BY end_time, event_id) - 1) // 10 AS BIGINT) AS version FROM o),
    s AS (SELECT version + 1 AS made, max(end_time) AS at FROM v GROUP BY version HAVING count(*) = 10)
    SELECT event_id, version - coalesce((SELECT max(made) FROM s WHERE s.at <= v.start_time), 0) AS staleness FROM v""",
)
def staleness_asof(spark, sf_dir):
    from marginalia.streaming import simulate

    return simulate.staleness(arrivals(spark, sf_dir), 10).select("event_id", "staleness")


@query("event_order", f"WITH {ARRIVALS_SQL}, e AS (SELECT event_id, 'start' AS kind, start_time AS t FROM o UNION ALL SELECT event_id, 'end', end_time FROM o) SELECT event_id, kind, CAST(sum(CASE kind WHEN 'start' THEN 1 ELSE -1 END) OVER (ORDER BY t, kind DESC, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM e")
def event_order(spark, sf_dir):
    from marginalia.streaming import simulate

    return simulate.timeline(arrivals(spark, sf_dir)).select("event_id", "kind", "running")


@query("staleness_weights", "SELECT CAST(range AS BIGINT) AS s, 1.0 AS constant, CASE WHEN range < 5 THEN 1.0 ELSE 0.5 END AS threshold, round(1 / power(1 + range, 0.5), 9) AS polynomial FROM range(20)")
def staleness_weights(spark, sf_dir):
    s = F.col("id")
    return spark.range(20).select(s.alias("s"), weights.constant(s).alias("constant"), weights.threshold(s, 5, 0.5).alias("threshold"), F.round(weights.polynomial(s, 0.5), 9).alias("polynomial"))


@query("example_weights", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, 1.0 AS equal, CAST(n AS DOUBLE) AS linear, sqrt(n) AS root, round(log10(1 + n), 9) AS logarithm FROM c")
def example_weights(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    return c.select("user_id", weights.equal(n).alias("equal"), weights.linear(n).alias("linear"), weights.root(n).alias("root"), F.round(weights.logarithm(n), 9).alias("logarithm"))


@query("sma_window", "SELECT user_id, event_id, round(avg(value) OVER w, 9) AS mean, round(stddev_pop(value) OVER w, 6) AS deviation FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def sma_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 9).alias("mean"), F.round(F.stddev_pop("value").over(w), 6).alias("deviation"))


@query("round_times", f"WITH {ARRIVALS_SQL}, r AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 10 AS round, least(duration, 900) AS d FROM o) SELECT round(sum(m), 6) AS sync_seconds, (SELECT round(max(end_time) - min(start_time), 6) FROM o) AS async_seconds FROM (SELECT round, max(d) AS m FROM r GROUP BY round)")
def round_times(spark, sf_dir):
    from marginalia.streaming import simulate

    return simulate.time_estimates(arrivals(spark, sf_dir), 10, 900.0)


@query("tumbling_windows", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


# -- relational core ---------------------------------------------------------------------------------------


@query("cube_counts", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("rollup_counts", "SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def rollup_counts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_name").agg(F.count("*").alias("n"))


@query("topk_per_group", "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS k FROM orders) WHERE k <= 3")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "k")


# -- synthetic rows ------------------------------------------------------------------------------------------


@query("synthetic_rows")
def synthetic_rows(spark, sf_dir):
    """As many rows as lineitem from a tree model of its pairwise marginals, taken without noise."""
    from marginalia.plans import mechanisms, pgm, synth

    cliques = [("rf", "ls"), ("ls", "mo"), ("qb", "pb"), ("pb", "rf"), ("mo", "ln"), ("db", "qb"), ("tb", "db")]
    known = mechanisms.answers(marginals.dense(items(spark, sf_dir), ITEMS, cliques), ITEMS, cliques)
    model = pgm.estimate(ITEMS, [pgm.Measurement(q, known[q], 1.0) for q in cliques], iterations=200)
    return synth.rows(spark, model, seed=1)


@query("aim_synthesis")
def aim_synthesis(spark, sf_dir):
    """Rows from AIM at eps 1 on the pairwise workload of orders."""
    from marginalia.plans import mechanisms

    made = mechanisms.aim(client_rows(spark, sf_dir), CLIENTS, workload.k_way(CLIENTS.attrs, 2), 1.0, 1e-6, seed=1, rounds=6)
    return made.rows(spark, seed=1)


@query("mst_synthesis")
def mst_synthesis(spark, sf_dir):
    """Rows from MST at eps 1 on orders."""
    from marginalia.plans import mechanisms

    return mechanisms.mst(client_rows(spark, sf_dir), CLIENTS, 1.0, 1e-6, seed=1).rows(spark, seed=1)


@query("distributed_aim_synthesis")
def distributed_aim_synthesis(spark, sf_dir):
    """Rows from AIM over 25 clients, a Poisson cohort of them a round."""
    from marginalia.plans import mechanisms

    return mechanisms.distributed_aim(client_rows(spark, sf_dir), "client", CLIENTS, workload.k_way(CLIENTS.attrs, 2), 1.0, 1e-6, q=0.5, seed=1, rounds=4).rows(spark, seed=1)


# -- rounds -----------------------------------------------------------------------------------------------------


@query("rank_error", "WITH r AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC, c_custkey) AS b FROM customer) SELECT c_nationkey, avg(abs(a - b)) AS error FROM r GROUP BY c_nationkey")
def rank_error(spark, sf_dir):
    from marginalia.operators import rounds

    return rounds.rank_error(table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey")), "c_nationkey", "c_custkey", "c_acctbal", "k")


@query("majority_vote", "SELECT event_type, count(*) AS votes FROM events GROUP BY event_type ORDER BY votes DESC, min(event_id) LIMIT 3")
def majority_vote(spark, sf_dir):
    from marginalia.operators import rounds

    return rounds.majority(table(spark, sf_dir, "events"), "event_type", 3, "event_id")


@query(
    "ema_window",
    """WITH s AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM events),
    e AS (SELECT user_id, event_id, len(l) AS n, l, unnest(generate_series(1, len(l))) AS k FROM s)
    SELECT user_id, event_id, round(sum(l[k] * power(0.7, n - k)) / sum(power(0.7, n - k)), 9) AS mean FROM e GROUP BY user_id, event_id""",
)
def ema_window(spark, sf_dir):
    from marginalia.operators import rounds

    found = rounds.exponential_moving(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 5, 0.3)
    return found.select("user_id", "event_id", F.round("mean", 9).alias("mean"))


@query("target_reached", "WITH m AS (SELECT user_id, event_id, avg(value) OVER w AS m, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT user_id, min(CASE WHEN n >= 3 AND m > 50 THEN event_id END) AS reached FROM m GROUP BY user_id")
def target_reached(spark, sf_dir):
    from marginalia.operators import rounds

    return rounds.target_reached(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 3, 50.0)


@query(
    "prefix_noise",
    f"""WITH s AS (SELECT CAST(range + 1 AS BIGINT) AS step FROM range(40)), n AS (SELECT step, CAST(range AS BIGINT) AS lv, (step >> range) - 1 AS node FROM s, range(10) WHERE (step >> range) & 1 = 1)
    SELECT step, round(sum(2.0 * sqrt(-2 * ln({uniform_sql('1a', 'lv', 'node')})) * cos(6.283185307179586 * {uniform_sql('1b', 'lv', 'node')})), 6) AS noise FROM n GROUP BY step""",
)
def prefix_noise(spark, sf_dir):
    from marginalia.operators import rounds

    return rounds.prefix_noise(spark.range(40).select((F.col("id") + 1).alias("step")), 2.0, "1").select("step", F.round("noise", 6).alias("noise"))


@query("worst_queries", f"WITH {CLIENTS_SQL}, m AS ({sets_sql(CLIENT_WORK, CLIENTS, by='client,')}), s AS (SELECT client, query_id, max(cnt) AS score FROM m GROUP BY ALL) SELECT client, query_id, CAST(k AS INTEGER) AS place FROM (SELECT client, query_id, row_number() OVER (PARTITION BY client ORDER BY score DESC, query_id) AS k FROM s) WHERE k <= 3")
def worst_queries(spark, sf_dir):
    from marginalia.operators import rounds

    scored = marginals_by_client(spark, sf_dir).groupBy("client", "query_id").agg(F.max("cnt").alias("score"))
    return rounds.worst(scored, "client", "query_id", "score", 3)


@query("covering_clique", "SELECT * FROM (VALUES ('a', 'a,b'), ('b', 'a,b'), ('b,c', 'b,c'), ('a,c', 'a,b,c')) v(query_id, clique_id)")
def covering_clique(spark, sf_dir):
    from marginalia.operators import rounds

    cliques = spark.createDataFrame([("a,b", ["a", "b"], 6), ("b,c", ["b", "c"], 12), ("a,b,c", ["a", "b", "c"], 24)], "clique_id string, attrs array<string>, size int")
    return rounds.covering(workload.as_frame(spark, [("a",), ("b",), ("b", "c"), ("a", "c")]), cliques)


@query("weighted_total", f"WITH {ITEMS_SQL}, m AS ({filled_sql([('rf',), ('mo', 'ls')])}), s AS (SELECT query_id, sum(cnt) AS s, count(*) AS n FROM m GROUP BY query_id) SELECT CAST(sum(s / (4.0 * n)) / sum(1 / (4.0 * n)) AS DOUBLE) AS total FROM s")
def weighted_total(spark, sf_dir):
    from marginalia.operators import rounds

    return rounds.weighted_total(marginal_batched(spark, sf_dir).withColumn("sigma", F.lit(2.0)))


@query(
    "running_average",
    "WITH m AS (SELECT event_type AS query_id, CAST(0 AS BIGINT) AS cell, CAST(date_part('day', ts) AS INTEGER) AS round, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL) SELECT query_id, cell, round, round(sum(v * n) OVER (PARTITION BY query_id ORDER BY round) / sum(n) OVER (PARTITION BY query_id ORDER BY round), 9) AS v FROM m",
)
def running_average(spark, sf_dir):
    by_day = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("query_id"), F.lit(0).cast("long").alias("cell"), F.dayofmonth("ts").alias("round")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return updates.running_average(by_day).withColumn("v", F.round("v", 9))


@query("trust_ratio", f"WITH {UPDATES_SQL}, n AS (SELECT client_id, idx % 4 AS layer, sqrt(sum(v * v)) AS n FROM u GROUP BY ALL) SELECT w.client_id, CAST(w.layer AS INTEGER) AS layer, round(CASE WHEN w.n > 0 AND g.n > 0 THEN w.n / g.n ELSE 1.0 END, 9) AS ratio FROM n w JOIN n g ON g.layer = w.layer AND g.client_id = w.client_id + 1")
def trust_ratio(spark, sf_dir):
    """Every client's layers against those of the next."""
    rows = vectors(spark, sf_dir).withColumn("layer", (F.col("idx") % 4).cast("int"))
    following = rows.withColumn("client_id", F.col("client_id") - 1)
    return updates.trust_ratio(rows, following, ("client_id", "layer")).withColumn("ratio", F.round("ratio", 9))


@query("random_sparse_mask", f"WITH {UPDATES_SQL}, m AS (SELECT idx, row_number() OVER (ORDER BY {uniform_sql('21', 'idx')}, idx) AS k FROM (SELECT DISTINCT idx FROM u)) SELECT client_id, u.idx, CASE WHEN k <= 32 THEN 0.0 ELSE v END AS v FROM u JOIN m ON u.idx = m.idx")
def random_sparse_mask(spark, sf_dir):
    return updates.random_masked(vectors(spark, sf_dir), 0.5, 21)


@query("model_combination", f"WITH {UPDATES_SQL} SELECT a.client_id, a.idx, round(0.25 * a.v + 2.0 * b.v, 9) AS v FROM u a JOIN u b ON a.idx = b.idx AND b.client_id = a.client_id + 1")
def model_combination(spark, sf_dir):
    """Every client's model with the next one's."""
    rows = vectors(spark, sf_dir).select("client_id", "idx", "v")
    following = rows.withColumn("client_id", F.col("client_id") - 1)
    return updates.combined(rows, 0.25, following, 2.0, ("client_id", "idx")).withColumn("v", F.round("v", 9))


@query("client_probabilities", "WITH c AS (SELECT c_nationkey AS client_id, avg(c_acctbal) / 1000 AS utility FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY utility, client_id) - 1 AS k, count(*) OVER () AS n, max(utility) OVER () AS m FROM c), e AS (SELECT client_id, CASE WHEN k < floor(0.4 * n) THEN 0 ELSE exp(2.0 * (utility - m)) END AS e FROM r) SELECT client_id, round(e / sum(e) OVER (), 9) AS p FROM e")
def client_probabilities(spark, sf_dir):
    utility = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("client_id")).agg((F.avg("c_acctbal") / 1000).alias("utility"))
    return shard.to_probability(utility, 0.4, 2.0).withColumn("p", F.round("p", 9))


@query("capped_participation", f"WITH c AS (SELECT CAST(r.range AS BIGINT) AS round, CAST(n_nationkey AS INTEGER) AS client_id FROM nation, range(20) r WHERE {uniform_sql('9', 'r.range', 'n_nationkey')} < 0.2) SELECT round, client_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round) AS k FROM c) WHERE k <= 2")
def capped_participation(spark, sf_dir):
    return shard.capped(poisson_cohort(spark, sf_dir), 2)


@query("poisson_arrivals", f"SELECT event_id, round(sum(-ln({uniform_sql('22', 'event_id')}) / 0.5) OVER (ORDER BY event_id), 6) AS start_time FROM events")
def poisson_arrivals(spark, sf_dir):
    from marginalia.streaming import simulate

    return simulate.poisson_starts(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.5, 22).select("event_id", F.round("start_time", 6).alias("start_time"))


@query("training_durations", f"SELECT event_id, round(greatest(1.0, 30 * -ln({uniform_sql('23', 'event_id')})), 6) AS duration FROM events")
def training_durations(spark, sf_dir):
    from marginalia.streaming import simulate

    return simulate.durations(table(spark, sf_dir, "events").select("event_id"), "exponential", 30.0, 0.0, "event_id", 23, 1.0).select("event_id", F.round("duration", 6).alias("duration"))


@query("timed_out_trainings", f"WITH {ARRIVALS_SQL} SELECT event_id, duration >= 900 AS timed_out, least(duration, 900.0) AS duration FROM o")
def timed_out_trainings(spark, sf_dir):
    from marginalia.streaming import simulate

    return simulate.timed_out(arrivals(spark, sf_dir), 900.0).select("event_id", "timed_out", "duration")


@query("uniform_synthetic_rows", f"SELECT CAST(floor({uniform_sql('3st', 'range')} * 3) AS INTEGER) AS st, CAST(floor({uniform_sql('3pr', 'range')} * 5) AS INTEGER) AS pr, CAST(floor({uniform_sql('3tp', 'range')} * 16) AS INTEGER) AS tp FROM range(2000)")
def uniform_synthetic_rows(spark, sf_dir):
    from marginalia.sources import tabular

    return tabular.uniform_rows(spark, CLIENTS, 2000, 3)


@query("exact_fraction", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {uniform_sql('1034', 'o_orderkey')}, o_orderkey) AS k, count(*) OVER () AS n FROM orders) WHERE k <= floor(n * 0.2 + 0.5)")
def exact_fraction(spark, sf_dir):
    from marginalia.sources import tabular

    return tabular.fraction(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2)


def _zipf_clients_sql(clients: int, rows: int, attrs: int, a: float, size: int, seed: str) -> str:
    w = 1.0 / np.arange(1, size + 1) ** a
    ends = ", ".join(f"CAST('{float(e)!r}' AS DOUBLE)" for e in np.cumsum(w / w.sum())[:-1])
    normal = [f"sqrt(-2 * ln({uniform_sql(f'{seed}v{k}a', 'id')})) * cos(6.283185307179586 * {uniform_sql(f'{seed}v{k}b', 'id')})" for k in range(attrs)]
    means = ", ".join(f"1 + (SELECT count(*) FROM e WHERE e.x <= {uniform_sql(f'{seed}m{k}', 'client_id')}) AS m{k}" for k in range(attrs))
    values = ", ".join(f'CAST(least(greatest(floor(m{k} + {z}), 0), {size}) AS INTEGER) AS "{k}"' for k, z in enumerate(normal))
    return f"WITH e AS (SELECT unnest([{ends}]) AS x), c AS (SELECT client_id, {means} FROM (SELECT CAST(range AS INTEGER) AS client_id FROM range({clients}))), i AS (SELECT CAST(range AS BIGINT) AS id, CAST(range // {rows} AS INTEGER) AS client_id FROM range({clients * rows})) SELECT client_id, {values} FROM i JOIN c USING (client_id)"


@query("zipf_client_rows", _zipf_clients_sql(100, 50, 10, 2.0, 40, "1"))
def zipf_client_rows(spark, sf_dir):
    """Rows of 100 clients around client means from a Zipf law."""
    from marginalia.sources import tabular

    return tabular.zipf_clients(spark, 100, 50, 10, 2.0, 40, 1)


@query("local_aim_synthesis")
def local_aim_synthesis(spark, sf_dir):
    """Rows from AIM with local selection over 25 clients."""
    from marginalia.plans import federated

    return federated.local_aim(client_rows(spark, sf_dir), "client", CLIENTS, workload.k_way(CLIENTS.attrs, 2), 5.0, 1e-6, 3, 0.6, seed=1).rows(spark, seed=1)


@query("local_generators")
def local_generators(spark, sf_dir):
    """Rows that each of 25 clients makes on its own."""
    from marginalia.plans import federated

    return federated.local_generators(client_rows(spark, sf_dir), "client", CLIENTS, 1.0)


@query("public_reweighting")
def public_reweighting(spark, sf_dir):
    """Weights on uniform rows that fit noiseless marginals of orders."""
    from marginalia.plans import mechanisms, pgm, public

    work = [("st", "pr"), ("tp",)]
    known = mechanisms.answers(marginals.dense(client_rows(spark, sf_dir), CLIENTS, work), CLIENTS, work)
    return public.reweighted(uniform_synthetic_rows(spark, sf_dir), CLIENTS, [pgm.Measurement(q, known[q], 10.0) for q in work], 12)


# -- plans -----------------------------------------------------------------------------------------------------


@query("linear_plans")
def linear_plans(spark, sf_dir):
    """Estimates of the price line by every plan at eps 1."""
    import numpy as np

    from marginalia.plans import linear

    x = np.zeros(64)
    for r in price_line(spark, sf_dir).collect():
        x[r.v] = r.cnt
    rows = [(name, k, float(v)) for name, plan in sorted(linear.PLANS.items()) for k, v in enumerate(plan(x, 1.0, np.random.default_rng(1)))]
    return spark.createDataFrame(rows, "plan string, cell bigint, estimate double")


@query("linear_plans_2d")
def linear_plans_2d(spark, sf_dir):
    """Estimates of a grid of quantity and price by every plan in two dimensions at eps 1."""
    import numpy as np

    from marginalia.plans import linear

    x = np.zeros((16, 16))
    for r in ranges.uniform_grid(price_grid(spark, sf_dir), 4).collect():
        x[r.gx, r.gy] = r.total
    rows = [(name, k, float(v)) for name, plan in sorted(linear.PLANS_2D.items()) for k, v in enumerate(plan(x, 1.0, np.random.default_rng(1)).ravel())]
    return spark.createDataFrame(rows, "plan string, cell bigint, estimate double")


@query(
    "log_likelihood_independent",
    f"""WITH {CLIENTS_SQL}, n AS (SELECT count(*) AS n FROM enc),
    s AS (SELECT st AS v, count(*) AS c FROM enc GROUP BY ALL), p AS (SELECT pr AS v, count(*) AS c FROM enc GROUP BY ALL)
    SELECT round((SELECT -sum(c * ln(c / n)) FROM s, n) + (SELECT -sum(c * ln(c / n)) FROM p, n) + (SELECT n * ln(16.0) FROM n), 3) AS nll""",
)
def log_likelihood_independent(spark, sf_dir):
    """Rows of orders under a model of two single attributes that leaves the third uniform."""
    import numpy as np

    from marginalia.plans import mechanisms, pgm, utility

    ones = [("st",), ("pr",)]
    rows = client_rows(spark, sf_dir)
    known = mechanisms.answers(marginals.dense(rows, CLIENTS, ones), CLIENTS, ones)
    model = pgm.GraphicalModel(CLIENTS, [("st",), ("pr",), ("tp",)], float(known[("st",)].sum()))
    for q in ones:
        with np.errstate(divide="ignore"):
            model.potentials[q] = pgm.Factor(CLIENTS.project(q), np.maximum(np.log(known[q]), -700))
    model.marginals = model.belief_propagation(model.potentials)
    return utility.negative_log_likelihood(rows, model).select(F.round("nll", 3).alias("nll"))


@query("private_bayes_rows")
def private_bayes_rows(spark, sf_dir):
    """Rows of a private Bayes network of orders at eps 5."""
    from marginalia.plans import structure, synth

    model, _ = structure.private_bayes(client_rows(spark, sf_dir), CLIENTS, 5.0, 2, 1)
    return synth.rows(spark, model, seed=1)


@query("synthetic_utility")
def synthetic_utility(spark, sf_dir):
    """Scores of a classifier of order status, trained on rows from MST and on the rows themselves."""
    from marginalia.plans import utility

    real = client_rows(spark, sf_dir).drop("client")
    rows = [(name, k, float(v)) for name, train in (("real", real), ("mst", mst_synthesis(spark, sf_dir))) for k, v in utility.classifier_utility(train, real, "st", trees=5).items()]
    return spark.createDataFrame(rows, "trained_on string, score string, value double")


@query("federated_training")
def federated_training(spark, sf_dir):
    """Log loss by round of a logistic model of order status, trained over clients' rows."""
    from marginalia.operators import training

    rows = client_rows(spark, sf_dir).select(F.col("client").cast("bigint").alias("client_id"), F.array(F.lit(1.0), F.col("pr") / 4.0, F.col("tp") / 16.0).alias("x"), (F.col("st") == 0).cast("int").alias("y"))
    clients = rows.select("client_id").distinct()
    _, losses = training.train(rows, lambda t: clients, 3, 3, 0.5, training.ServerOptimizer("fedavg"))
    return spark.createDataFrame(list(enumerate(losses)), "round bigint, loss double")


@query("half_precision_channel")
def half_precision_channel(spark, sf_dir):
    """Embeddings after a channel of 16-bit floats."""
    from marginalia.operators import training

    return table(spark, sf_dir, "embeddings").select("vec_id", training.half_precision(F.col("embedding").cast("array<double>")).alias("v"))


@query("product_quantisation")
def product_quantisation(spark, sf_dir):
    """Codes of embeddings' blocks of eight components."""
    from marginalia.operators import training

    return training.product_quantised(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("client_id"), F.col("embedding").cast("array<double>").alias("v")), 8, 16)


# -- set operations, streams --------------------------------------------------------------------------------------


@query("merged_clients", f"WITH {CLIENTS_SQL} SELECT client, st, pr, tp FROM enc")
def merged_clients(spark, sf_dir):
    """The union of the rows of three groups of clients."""
    from marginalia.operators import sets

    rows = client_rows(spark, sf_dir)
    return sets.merged([rows.where(F.col("client") % 3 == k) for k in range(3)])


@query("region_intersections", "SELECT * FROM (VALUES ('a,b,c'), ('b,c,d'), ('c,d,e'), ('b,c'), ('c,d'), ('c')) v(query_id)")
def region_intersections(spark, sf_dir):
    from marginalia.operators import sets

    closed = sets.intersections(workload.as_frame(spark, [("a", "b", "c"), ("b", "c", "d"), ("c", "d", "e")]))
    return closed.select(F.concat_ws(",", "attrs").alias("query_id"))


@query("disjunct_queries", "SELECT CAST(a.range AS BIGINT) AS q, CAST(b.range AS BIGINT) AS r, CAST(x.range AS BIGINT) AS x, CAST(y.range AS BIGINT) AS y, CAST(CASE WHEN x.range <= a.range OR y.range = b.range THEN 1 ELSE 0 END AS DOUBLE) AS val FROM range(4) a, range(3) b, range(4) x, range(3) y")
def disjunct_queries(spark, sf_dir):
    from marginalia.operators import sets

    pairs = spark.range(16).select(F.expr("id div 4").alias("q"), (F.col("id") % 4).alias("x"))
    same = spark.range(9).select(F.expr("id div 3").alias("r"), (F.col("id") % 3).alias("y"))
    return sets.disjunct(pairs.withColumn("val", (F.col("x") <= F.col("q")).cast("double")), same.withColumn("val", (F.col("y") == F.col("r")).cast("double")))


@query("intersect_except", "(SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect_except(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    of = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c"))
    return of("F").intersect(of("O")).subtract(of("P"))


@query("cluster_feature_skew")
def cluster_feature_skew(spark, sf_dir):
    """Orders to five clients by clusters of their columns."""
    return shard.by_clusters(client_rows(spark, sf_dir).drop("client"), ["st", "pr", "tp"], 5, seed=1)


def streamed(frame: DataFrame, mode: str) -> DataFrame:
    """The result of a stream over what is there now, run to its end and written to the shared folder: a
    folder for each batch, so that one that runs again replaces itself, or one for all if each is whole."""
    import uuid

    spark = frame.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], frame.schema).write.parquet(f"{folder}/rows/none")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'all' if mode == 'complete' else number}")

    running = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows/*")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    folder = sf_dir.rstrip("/")
    # a pattern, as a stream takes a plain path for a folder
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{folder}/events.parque[t]")


@query("streaming_windows", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streaming_windows(spark, sf_dir):
    """Hourly counts and sums from Structured Streaming."""
    from marginalia.streaming import buffers

    stream = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = streamed(buffers.windowed(stream, "1 hour", "10 minutes"), "complete")
    return found.select("event_type", F.col("start").alias("hour"), "n", F.round("total", 6).alias("total"))


@query(
    "streaming_fed_buffer",
    """WITH o AS (SELECT event_id, CAST(user_id % 4 AS INTEGER) AS cohort, epoch_us(ts) / 1e6 + 60 + 600 * abs(value) AS end_time, 1.0 + user_id % 3 AS w, value AS v FROM events),
    b AS (SELECT *, (row_number() OVER (PARTITION BY cohort ORDER BY end_time, event_id) - 1) // 10 AS version FROM o)
    SELECT cohort, CAST(version AS BIGINT) AS version, round(sum(w), 6) AS weight, round(sum(w * v) / sum(w), 6) AS v FROM b GROUP BY cohort, version HAVING count(*) = 10""",
)
def streaming_fed_buffer(spark, sf_dir):
    """Steps of four buffered aggregators from a stream with state."""
    from marginalia.streaming import buffers

    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    stream = event_stream(spark, sf_dir).select("event_id", (F.col("user_id") % 4).cast("int").alias("cohort"), (start + 60 + 600 * F.abs("value")).alias("end_time"), (1.0 + F.col("user_id") % 3).alias("weight"), F.col("value").alias("v"))
    found = streamed(buffers.fed_buffer(stream, 10), "append")
    return found.select("cohort", "version", F.round("weight", 6).alias("weight"), F.round("v", 6).alias("v"))


@query("prefix_marginal", f"WITH {ITEMS_SQL}, m AS (SELECT a.range AS rf, b.range AS qb, c.range AS mo FROM range(3) a, range(8) b, range(12) c) SELECT CAST(m.rf AS INTEGER) AS rf, CAST(m.qb AS INTEGER) AS qb, CAST(m.mo AS INTEGER) AS mo, count(e.rf) AS cnt FROM m LEFT JOIN enc e ON e.rf = m.rf AND e.qb <= m.qb AND e.mo <= m.mo GROUP BY ALL")
def prefix_marginal(spark, sf_dir):
    """A three-way marginal with prefix sums along two attributes."""
    from marginalia.functions.cells import coordinates

    work = [("rf", "qb", "mo")]
    full = marginals.zero_filled(marginals.dense(items(spark, sf_dir), ITEMS, work), ITEMS, work)
    placed = full.select(*coordinates("cell", ["rf", "qb", "mo"], [3, 8, 12]), "cnt")
    return ranges.prefix_marginal(placed, ["rf", "qb", "mo"], ["qb", "mo"])


@query("random_boxes", "SELECT CAST(range AS BIGINT) AS box, " + ", ".join(f"CAST(least(floor({uniform_sql(f'3a{k}', 'range')} * {n}), floor({uniform_sql(f'3b{k}', 'range')} * {n})) AS INTEGER) AS low{k}, CAST(greatest(floor({uniform_sql(f'3a{k}', 'range')} * {n}), floor({uniform_sql(f'3b{k}', 'range')} * {n})) AS INTEGER) AS high{k}" for k, n in enumerate((64, 32))) + " FROM range(200)")
def random_boxes(spark, sf_dir):
    return ranges.random_boxes(spark, (64, 32), 200, 3)


# -- what is written and read again, and figures of runs --------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("model_saved_and_loaded", f"WITH {ITEMS_SQL} SELECT query_id, cell, round(CAST(cnt AS DOUBLE), 3) AS cnt FROM ({sets_sql([('rf', 'ls'), ('qb',), ('mo',)])})")
def model_saved_and_loaded(spark, sf_dir):
    """Marginals of a model whose potentials are logarithms of counts, after it was saved and read again."""
    from marginalia.plans import mechanisms, pgm
    from marginalia.sources import sinks

    work = [("rf", "ls"), ("qb",), ("mo",)]
    known = mechanisms.answers(marginals.dense(items(spark, sf_dir), ITEMS, work), ITEMS, work)
    own = ITEMS.project(["rf", "ls", "qb", "mo"])
    model = pgm.GraphicalModel(own, work, float(known[("qb",)].sum()))
    for q in model.cliques:
        asked = next(w for w in work if set(w) == set(q))
        model.potentials[q] = pgm.Factor(own.project(asked), np.asarray(known[asked], dtype=float).reshape(own.project(asked).shape)).log()
    folder = _folder(spark, "model")
    sinks.save_model(spark, model, folder)
    found = sinks.load_model(spark, folder)
    rows = [(",".join(q), k, float(x)) for q in work for k, x in enumerate(found.project(q).flat()) if x > 0.5]
    return spark.createDataFrame(rows, "query_id string, cell bigint, cnt double").withColumn("cnt", F.round("cnt", 3))


@query("split_cached", ORACLE_SQL["random_shard"])
def split_cached(spark, sf_dir):
    """A split that is made for the first caller and read by the second."""
    from marginalia.sources import sinks

    folder, settings = _folder(spark, "splits"), {"dataset": "events", "seed": 5, "clients": 10, "method": "random"}
    for _ in range(2):
        found = sinks.cached(spark, folder, settings, lambda: random_shard(spark, sf_dir))
    return found


@query("answers_cached", ORACLE_SQL["marginals_by_client"])
def answers_cached(spark, sf_dir):
    """Clients' answers, kept by query."""
    from marginalia.sources import sinks

    made = marginals_by_client(spark, sf_dir)
    found = sinks.cached(spark, _folder(spark, "answers"), {"dataset": "orders", "workload": CLIENT_WORK}, lambda: made, by=["query_id"])
    return found.select(made.columns)


@query("rows_as_csv", ORACLE_SQL["uniform_synthetic_rows"])
def rows_as_csv(spark, sf_dir):
    """Synthetic rows written as CSV and read again."""
    from marginalia.sources import sinks

    rows, folder = uniform_synthetic_rows(spark, sf_dir), _folder(spark, "csv")
    sinks.write_csv(rows, folder)
    return spark.read.schema(rows.schema).option("header", True).csv(folder)


@query("sweep_results", "SELECT o_orderstatus AS task_id, count(*) AS orders, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1")
def sweep_results(spark, sf_dir):
    """A row for each task of a sweep, then all of them; the last task runs twice."""
    from marginalia.plans import sweep
    from marginalia.sources import sinks

    orders, folder = table(spark, sf_dir, "orders"), _folder(spark, "sweep")
    for status in ("F", "O", "P", "P"):
        found = orders.where(F.col("o_orderstatus") == status).agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("price")).first()
        sinks.append_result(spark, folder, status, found.asDict())
    return sweep.merged_results(spark, folder).select("task_id", F.col("orders").cast("long").alias("orders"), F.col("price").cast("double").alias("price"))


@query("column_means", "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 8) AS l_discount FROM lineitem")
def column_means(spark, sf_dir):
    means = evaluate.column_means(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return means.select(F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"), F.round("l_discount", 8).alias("l_discount"))


@query("class_distribution", "SELECT user_id % 10 AS client, event_type, count(*) AS n FROM events GROUP BY ALL")
def class_distribution(spark, sf_dir):
    return evaluate.class_distribution(table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("client"), "event_type"), "client", "event_type")


@query("averaged_metrics", "SELECT event_type, count(*) AS seeds, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def averaged_metrics(spark, sf_dir):
    return evaluate.averaged(table(spark, sf_dir, "events"), ["event_type"], ["value"]).withColumn("value", F.round("value", 6))


@query("best_metric", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1")
def best_metric(spark, sf_dir):
    """Each user's largest value and the event that has it."""
    return evaluate.best_metric(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query(
    "pending_jobs",
    """WITH j AS (SELECT epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + 60 + 600 * abs(value) AS b FROM events), e AS (SELECT a AS t, 0 AS o FROM j UNION ALL SELECT b, 1 FROM j),
    n AS (SELECT o, sum(1 - o) OVER w - sum(o) OVER w + 1 AS pending FROM e WINDOW w AS (ORDER BY t, o ROWS UNBOUNDED PRECEDING)) SELECT round(avg(pending), 6) AS pending FROM n WHERE o = 1""",
)
def pending_jobs(spark, sf_dir):
    """Trainings under way when one ends, on average."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    jobs = table(spark, sf_dir, "events").select(start.alias("a"), (start + 60 + 600 * F.abs("value")).alias("b"))
    return evaluate.pending_jobs(jobs, "a", "b").select(F.round("pending", 6).alias("pending"))


@query(
    "efficient_prefix_noise",
    f"""WITH z AS (SELECT CAST(l.range AS BIGINT) AS lv, CAST(i.range AS BIGINT) AS node FROM range(6) l, range(40) i WHERE ((i.range + 1) << l.range) <= 40),
    d AS (SELECT lv, node, 2.0 * sqrt(-2 * ln({uniform_sql('1a', 'lv', 'node')})) * cos(6.283185307179586 * {uniform_sql('1b', 'lv', 'node')}) AS x FROM z),
    v AS (SELECT z.lv, z.node, sum(d.x / (1 << (z.lv - d.lv))) AS x FROM z JOIN d ON d.lv <= z.lv AND (d.node >> (z.lv - d.lv)) = z.node GROUP BY ALL),
    s AS (SELECT CAST(range + 1 AS BIGINT) AS step FROM range(40))
    SELECT step, round(sum(x / (2.0 - 1.0 / (1 << lv))), 6) AS noise FROM s JOIN v ON (step >> lv) & 1 = 1 AND node = (step >> lv) - 1 GROUP BY step""",
)
def efficient_prefix_noise(spark, sf_dir):
    """Noise of running sums from trees whose nodes use what lies below them."""
    from marginalia.operators import rounds

    return rounds.efficient_prefix_noise(spark.range(40).select((F.col("id") + 1).alias("step")), 2.0, "1").select("step", F.round("noise", 6).alias("noise"))


# -- sources and small operators --------------------------------------------------------------------------------


def _bins_sql(x: str, n: int) -> str:
    return f"CAST(greatest(0, ceil(({x} - min({x}) OVER ()) / ((max({x}) OVER () - min({x}) OVER ()) / {n})) - 1) AS INTEGER)"


@query("named_csv_rows", f"SELECT c_nationkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment, {_bins_sql('c_acctbal', 32)} AS c_acctbal FROM customer")
def named_csv_rows(spark, sf_dir):
    """A CSV table with its domain beside it, encoded by that domain; the last column is the label."""
    from marginalia.sources import sinks, tabular

    root = _folder(spark, "named")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment"), f"{root}/customer.csv")
    sidecar = '{"c_nationkey": 25, "c_acctbal": -1, "c_mktsegment": 5}'
    spark.createDataFrame([(sidecar,)], "value string").coalesce(1).write.text(f"{root}/customer-domain.json")
    return tabular.named_csv(spark, root, "customer").df


@query("rows_by_metadata", f"SELECT CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus, {_bins_sql('o_totalprice', 32)} AS o_totalprice, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders")
def rows_by_metadata(spark, sf_dir):
    """Orders encoded by the kinds of their columns; ids are dropped."""
    from marginalia.sources import tabular

    kinds = {"o_orderkey": "id", "o_orderstatus": "categorical", "o_totalprice": "numerical", "o_orderpriority": "categorical"}
    return tabular.by_metadata(table(spark, sf_dir, "orders").select(*kinds), kinds).df


@query("histogram_file_cells", "SELECT CAST(l_linenumber - 1 AS INTEGER) AS line, count(*) AS cnt FROM lineitem GROUP BY 1")
def histogram_file_cells(spark, sf_dir):
    """Counts by line number, written as a file with a count a line and read with their attribute's name."""
    from marginalia.sources import tabular

    counts = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").count().orderBy("l_linenumber").collect()  # seven rows
    path = _folder(spark, "histogram")
    spark.createDataFrame([("\n".join(str(r["count"]) for r in counts),)], "value string").coalesce(1).write.text(path)
    found = tabular.with_coordinates(tabular.histogram_file(spark, path), ["line"], [len(counts)])
    return found.select(F.col("line").cast("int").alias("line"), "cnt")


@query("uniformity_cells", f"SELECT CAST(range AS BIGINT) AS cell, CAST(100000 // 250 AS BIGINT) AS cnt FROM (SELECT range FROM range(1000) ORDER BY {uniform_sql('6', 'range')}, range LIMIT 250)")
def uniformity_cells(spark, sf_dir):
    """A quarter of the cells with equal counts."""
    from marginalia.sources import tabular

    return tabular.uniformity(spark, 0.25, 1000, 100_000, 6)


@query(
    "sampled_cells",
    f"""WITH c AS (SELECT c_nationkey AS cell, count(*) AS cnt FROM customer GROUP BY 1), e AS (SELECT cell, sum(cnt) OVER (ORDER BY cell) AS stop, sum(cnt) OVER (ORDER BY cell) - cnt AS start, sum(cnt) OVER () AS total FROM c),
    d AS (SELECT {uniform_sql('4', 'range')} AS u FROM range(5000)) SELECT CAST(cell AS BIGINT) AS cell, count(*) AS cnt FROM d, e WHERE floor(u * total) >= start AND floor(u * total) < stop GROUP BY 1""",
)
def sampled_cells(spark, sf_dir):
    """Draws with replacement from the histogram of customers by nation."""
    from marginalia.sources import tabular

    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("cell")).agg(F.count("*").alias("cnt"))
    return tabular.sampled(counts, 5000, 4)


@query("exponential_fill_cells", "WITH r AS (SELECT range AS cell, CAST(0.1 AS DOUBLE) * pow(CAST(0.9 AS DOUBLE), range) AS raw FROM range(50)), x AS (SELECT cell, raw / sum(raw) OVER () * 12345 AS exact FROM r), k AS (SELECT cell, floor(exact) AS low, row_number() OVER (ORDER BY floor(exact) - exact, cell) AS place, 12345 - sum(floor(exact)) OVER () AS short FROM x) SELECT CAST(cell AS BIGINT) AS cell, CAST(low + CASE WHEN place <= short THEN 1 ELSE 0 END AS BIGINT) AS cnt FROM k")
def exponential_fill_cells(spark, sf_dir):
    from marginalia.sources import tabular

    return spark.createDataFrame(list(enumerate(tabular.exponential_fill(50, 12345, 0.1))), "cell bigint, cnt bigint")


@query("columns_dropped", f"WITH {ITEMS_SQL} SELECT rf, qb, mo FROM enc")
def columns_dropped(spark, sf_dir):
    """The encoded rows without five of their attributes."""
    return encode.project(items(spark, sf_dir), ITEMS.marginalize(["ls", "pb", "db", "tb", "ln"]).attrs)


@query("rows_within_domain", "SELECT user_id, event_type FROM (SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events) WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def rows_within_domain(spark, sf_dir):
    """Events whose columns of the domain are all there; every seventh user is made null."""
    rows = table(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    return encode.within(rows, Domain.of({"user_id": 1, "event_type": 1}))


@query("round_timeline", "SELECT CAST(e.range + 1 AS BIGINT) AS epoch, CAST(r.range + 1 AS BIGINT) AS round, CAST(e.range * 8 + r.range + 1 AS BIGINT) AS global_round, (e.range * 8 + r.range + 1) / CAST(8 AS DOUBLE) AS epochs FROM range(5) e, range(8) r")
def round_timeline(spark, sf_dir):
    from marginalia.operators import rounds

    frame = spark.range(40).select(F.expr("id div 8 + 1").alias("epoch"), (F.col("id") % 8 + 1).alias("round"))
    at, epochs = rounds.timeline(F.col("epoch"), F.col("round"), 8)
    return frame.select("epoch", "round", at.alias("global_round"), epochs.cast("double").alias("epochs"))


@query("answer_bytes", "WITH a(k, name, n) AS (VALUES " + ", ".join(f"({k}, '{a}', {n})" for k, (a, n) in enumerate(ITEMS.config.items())) + ") SELECT a.name || ',' || b.name AS query_id, CAST(8 * a.n * b.n AS BIGINT) AS bytes FROM a JOIN a b ON a.k < b.k")
def answer_bytes(spark, sf_dir):
    """What a client sends for each pair of attributes."""
    return evaluate.answer_bytes(ITEMS, workload.k_way(ITEMS.attrs, 2), spark)


@query("complement_queries", "WITH a(k, name) AS (VALUES " + ", ".join(f"({k}, '{a}')" for k, a in enumerate(ITEMS.attrs)) + ") SELECT a.name || ',' || b.name AS query_id, [a.name, b.name] AS attrs FROM a JOIN a b ON a.k < b.k WHERE b.name <> 'ln' AND a.name <> 'rf'")
def complement_queries(spark, sf_dir):
    """Pairs that no known query is."""
    from marginalia.operators import sets

    known = [q for q in workload.k_way(ITEMS.attrs, 2) if "ln" in q or "rf" in q]
    return sets.complement_queries(workload.as_frame(spark, workload.k_way(ITEMS.attrs, 2)), workload.as_frame(spark, known))


@query("workload_for_target", "WITH a(k, name) AS (VALUES " + ", ".join(f"({k}, '{a}')" for k, a in enumerate(ITEMS.attrs)) + ") SELECT name AS query_id FROM a UNION ALL SELECT a.name || ',' || b.name FROM a JOIN a b ON a.k < b.k WHERE 'mo' IN (a.name, b.name)")
def workload_for_target(spark, sf_dir):
    """Single attributes, and the pairs that hold the target."""
    return workload.as_frame(spark, workload.for_target(workload.some_way(ITEMS.attrs, (1, 2)), "mo")).select("query_id")


@query("column_shards", "SELECT event_id, user_id, user_id AS shard FROM events")
def column_shards(spark, sf_dir):
    return shard.by_column(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


@query("noise_scales", "SELECT CAST(k.range + 1 AS INTEGER) AS rounds, round(sqrt((k.range + 1) / (2 * 0.3e0)), 9) AS gaussian, round(sqrt(8 * 0.3e0 / (k.range + 1)), 9) AS exponential, round(1 / sqrt(2 * 0.3e0 / (k.range + 1)), 9) AS laplace FROM range(30) k")
def noise_scales(spark, sf_dir):
    """Scales that spend a zCDP budget of 0.3 over so many rounds."""
    from marginalia.plans import accounting as acc

    rows = [(k, *(round(f(0.3, k), 9) for f in (acc.gaussian_sigma, acc.exponential_epsilon, acc.laplace_scale))) for k in range(1, 31)]
    return spark.createDataFrame(rows, "rounds int, gaussian double, exponential double, laplace double")


from marginalia import cell_queries, model_queries  # noqa: E402,F401  (they register their queries here)
