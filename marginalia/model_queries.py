"""Named queries over graphical models and adaptive grids, fitted to the given tables."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import marginals, workload
from marginalia.plans import adaptive, mechanisms, pgm, regions
from marginalia.queries import ITEMS, ITEMS_SQL, cell_sql, items, query

CHAIN = list(zip(ITEMS.attrs, ITEMS.attrs[1:]))  # each attribute with the next
PAIRS = workload.k_way(list(ITEMS.attrs), 2)


def chain_model(spark, sf_dir) -> pgm.GraphicalModel:
    """The most likely model in which each attribute of lineitem follows from the one before it."""
    known = mechanisms.answers(marginals.dense(items(spark, sf_dir), ITEMS, CHAIN), ITEMS, CHAIN)
    return pgm.GraphicalModel(ITEMS, CHAIN).fit(known)


def _chain_sql(last: str) -> str:
    """Tables p_a_b with the model's counts of every two attributes: sums over the attribute before b."""
    parts = [f"n_{a}_{b} AS (SELECT {a}, {b}, count(*)::DOUBLE AS c FROM enc GROUP BY ALL)" for a, b in CHAIN]
    parts += [f"n_{a} AS (SELECT {a}, count(*)::DOUBLE AS c FROM enc GROUP BY ALL)" for a in ITEMS.attrs]
    for k, a in enumerate(ITEMS.attrs):
        for j in range(k + 1, len(ITEMS)):
            b, between = ITEMS.attrs[j], ITEMS.attrs[j - 1]
            body = f"SELECT {a}, {b}, c FROM n_{a}_{b}" if j == k + 1 else f"SELECT p.{a}, m.{b}, sum(p.c * m.c / s.c) AS c FROM p_{a}_{between} p JOIN n_{between}_{b} m USING ({between}) JOIN n_{between} s USING ({between}) GROUP BY ALL"
            parts.append(f"p_{a}_{b} AS ({body})")
    return f"WITH {ITEMS_SQL}, {', '.join(parts)} {last}"


def _pairs_sql() -> str:
    def each(q):
        return (
            f"SELECT '{','.join(q)}' AS query_id, CAST(i.range AS BIGINT) AS cell, round(coalesce(p.c, 0), 4) AS cnt FROM range({ITEMS.size(q)}) i "
            f"LEFT JOIN (SELECT {cell_sql(q)} AS cell, c FROM p_{q[0]}_{q[1]}) p ON p.cell = i.range"
        )

    return _chain_sql(" UNION ALL ".join(map(each, PAIRS)))


@query("model_all_pairs", _pairs_sql())
def model_all_pairs(spark, sf_dir):
    """The chain model's marginals on all pairs of attributes, from one calibration."""
    found = chain_model(spark, sf_dir).many(PAIRS)
    rows = [(marginals.name(q), k, float(v)) for q, f in found.items() for k, v in enumerate(f.flat())]
    return spark.createDataFrame(rows, "query_id string, cell bigint, cnt double").withColumn("cnt", F.round("cnt", 4))


@query("model_kronecker", _chain_sql("SELECT x.range AS qb, y.range AS mo, round(sum(p.c), 4) AS cnt FROM range(8) x, range(12) y, p_qb_mo p WHERE p.qb <= x.range AND p.mo >= y.range GROUP BY ALL"))
def model_kronecker(spark, sf_dir):
    """The chain model's counts of up to each quantity from each month on."""
    found = chain_model(spark, sf_dir).kronecker({"qb": np.tril(np.ones((8, 8))), "mo": np.triu(np.ones((12, 12)))})
    return spark.createDataFrame([(q, m, float(v)) for (q, m), v in np.ndenumerate(found)], "qb bigint, mo bigint, cnt double").withColumn("cnt", F.round("cnt", 4))


FEW = ("rf", "ls", "qb", "mo", "ln")


def _score_sql() -> str:
    """Brute force over all cells: the sum of counts of the pairs of neighbours, around a ring."""
    ring = list(zip(FEW, (*FEW[1:], FEW[0])))
    parts = [f"s_{a}_{b} AS (SELECT x.range AS {a}, y.range AS {b}, count(enc.l_orderkey) AS c FROM range({ITEMS[a]}) x CROSS JOIN range({ITEMS[b]}) y LEFT JOIN enc ON enc.{a} = x.range AND enc.{b} = y.range GROUP BY ALL)" for a, b in ring]
    tables = " ".join(f"{'FROM' if k == 0 else 'JOIN'} s_{a}_{b}" + ("" if k == 0 else f" USING ({a}{', ' + b if k == len(ring) - 1 else ''})") for k, (a, b) in enumerate(ring))
    total = " + ".join(f"s_{a}_{b}.c" for a, b in ring)
    return f"WITH {ITEMS_SQL}, {', '.join(parts)}, every AS (SELECT {', '.join(FEW)}, {total} AS score {tables}) SELECT CAST(max(score) AS BIGINT) AS score, CAST(1 AS BIGINT) AS found FROM every"


@query("best_response", _score_sql())
def best_response(spark, sf_dir):
    """The largest sum of pair counts around a ring of attributes that one row can have, by elimination."""
    ring = list(zip(FEW, (*FEW[1:], FEW[0])))
    asked = [ITEMS.canonical(q) for q in ring]
    known = mechanisms.answers(marginals.dense(items(spark, sf_dir), ITEMS, asked), ITEMS, asked)
    factors = [pgm.Factor(ITEMS.project(q), y.reshape(ITEMS.project(q).shape)) for q, y in known.items()]
    row, score = pgm.most_likely(factors, ITEMS.project(FEW))
    reached = sum(f.values[tuple(row[a] for a in f.domain.attrs)] for f in factors)
    return spark.createDataFrame([(int(score), int(reached == score))], "score bigint, found bigint")


GRID = workload.closure([("ls", "qb", "mo")])


def _grid_sql() -> str:
    """All cells with the rows that each is measured in, set by set."""
    parts = ["least AS (SELECT 0.02 * count(*) AS least FROM enc)"]
    for q in sorted(GRID, key=len):
        name, below = "_".join(q), [c for c in combinations(q, len(q) - 1) if c]
        values = ", ".join(f"range({ITEMS[a]}) {a}_(x)" for a in q)
        parts.append(f"d_{name} AS (SELECT {', '.join(f'{a}_.x AS {a}' for a in q)}, {_ravel(q)} AS own_cell FROM {values})")
        condition = " AND ".join(f"EXISTS (SELECT 1 FROM high_{'_'.join(c)} h WHERE {' AND '.join(f'h.{a} = d.{a}' for a in c)})" for c in below) or "TRUE"
        parts.append(f"own_{name} AS (SELECT * FROM d_{name} d WHERE {condition})")
        entries = [f"SELECT {', '.join(q)}, '' AS part, own_cell AS cell, 1.0 AS v FROM own_{name}"]
        listed = [f"SELECT '' AS part, own_cell AS cell FROM own_{name}"]
        for c in below:
            child = "_".join(c)
            path = f"CASE WHEN part = '' THEN '{','.join(c)}' ELSE '{','.join(c)}>' || part END"
            entries.append(f"SELECT {', '.join(f'd.{a}' for a in q)}, {path}, cell, v / {math.sqrt(len(below))!r} FROM d_{name} d JOIN e_{child} USING ({', '.join(c)}) WHERE own_cell NOT IN (SELECT own_cell FROM own_{name})")
            listed.append(f"SELECT {path}, cell FROM l_{child}")
        parts.append(f"e_{name} AS ({' UNION ALL '.join(entries)})")
        parts.append(f"l_{name} AS ({' UNION ALL '.join(listed)})")
        parts.append(f"c_{name} AS (SELECT {', '.join(q)}, count(*) AS cnt FROM enc GROUP BY ALL)")
        parts.append(f"m_{name} AS (SELECT part, cell, coalesce(sum(v * cnt), 0) AS v FROM l_{name} LEFT JOIN (SELECT part, cell, v, cnt FROM e_{name} JOIN c_{name} USING ({', '.join(q)})) USING (part, cell) GROUP BY ALL)")
        parts.append(f"high_{name} AS (SELECT d.* FROM d_{name} d JOIN m_{name} m ON m.part = '' AND m.cell = d.own_cell, least WHERE m.v >= least)")
    last = " UNION ALL ".join(f"SELECT '{','.join(q)}' AS query_id, part, CAST(cell AS BIGINT) AS cell, round(v, 6) AS v FROM m_{'_'.join(q)}" for q in GRID)
    return f"WITH {ITEMS_SQL}, {', '.join(parts)} {last}"


def _ravel(q) -> str:
    out = "0"
    for a in q:
        out = f"({out}) * {ITEMS[a]} + {a}_.x"
    return out


@query("adaptive_grid_rows", _grid_sql())
def adaptive_grid_rows(spark, sf_dir):
    """The rows of an adaptive grid over lineitem without noise, cells being occupied from 2 % of all rows on."""
    df = items(spark, sf_dir)
    _, found = adaptive.measured(df, ITEMS, GRID, 0.0, 0.02 * df.count())
    out: DataFrame | None = None
    for q, rows in found.items():
        own = rows.select(F.lit(marginals.name(q)).alias("query_id"), "part", "cell", F.round("v", 6).alias("v"))
        out = own if out is None else out.unionByName(own)
    return out


STEPS = list(zip(FEW, FEW[1:]))


def _regions_sql() -> str:
    """Brute force over all cells of the attributes: products of one more than the pairs' counts."""
    parts = [f"s_{a}_{b} AS (SELECT x.range AS {a}, y.range AS {b}, count(enc.l_orderkey)::DOUBLE + 1 AS c FROM range({ITEMS[a]}) x CROSS JOIN range({ITEMS[b]}) y LEFT JOIN enc ON enc.{a} = x.range AND enc.{b} = y.range GROUP BY ALL)" for a, b in STEPS]
    tables = f"s_{STEPS[0][0]}_{STEPS[0][1]} " + " ".join(f"JOIN s_{a}_{b} USING ({a})" for a, b in STEPS[1:])
    weight = " * ".join(f"s_{a}_{b}.c" for a, b in STEPS)
    parts.append(f"w AS (SELECT {', '.join(FEW)}, {weight} AS w FROM {tables})")
    parts.append("z AS (SELECT sum(w) AS z FROM w)")
    each = " UNION ALL ".join(f"SELECT '{a},{b}' AS query_id, {cell_sql((a, b))} AS cell, round(1000 * sum(w) / any_value(z), 5) AS v FROM w, z GROUP BY {a}, {b}" for a, b in STEPS)
    return f"WITH {ITEMS_SQL}, {', '.join(parts)} {each}"


@query("region_propagation", _regions_sql())
def region_propagation(spark, sf_dir):
    """Marginals, per thousand, of a chain whose potentials are logarithms of pair counts, by joins over regions."""
    graph = regions.RegionGraph.junction(ITEMS.project(FEW), STEPS)
    number = {q: k for k, q in enumerate(graph.regions)}
    known = marginals.zero_filled(marginals.dense(items(spark, sf_dir), ITEMS, STEPS), ITEMS, STEPS)
    names = spark.createDataFrame([(marginals.name(q), number[q]) for q in STEPS], "query_id string, region int")
    tables = known.join(F.broadcast(names), "query_id").select("region", "cell", F.log(F.col("cnt") + 1.0).alias("theta"))  # a name a pair
    found = regions.propagate(graph, tables, 1000.0, rounds=10)
    return found.join(F.broadcast(names), "region").select("query_id", "cell", F.round("v", 5).alias("v"))
