"""The queries of the operators against SQL, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: The columns of these queries that SQL can state.
BASE = {
    "op3_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
o AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM o) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f""",
    "op9_sharding": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, 'rows' AS law FROM documents",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY 1),
o AS (SELECT *, sum(w) OVER (ORDER BY n * 1.0 / w DESC, source NULLS LAST) AS free, coalesce(sum(2 * n) OVER (ORDER BY n * 1.0 / w, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(n) OVER () * 1.5 AS all_words FROM s),
l AS (SELECT max((all_words - used) / free) FILTER (WHERE 2 * n * free > w * (all_words - used)) AS level FROM o),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size, least(2.0 * n, w * coalesce(level, 1e300)) AS target FROM s, l)
SELECT doc_id, size, source_size, round(target, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
}


@pytest.fixture(scope="module")
def second():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted({*registry.ORACLES, *BASE}))
def test_query_equals_its_sql(spark, second, name):
    cursor = second.execute(registry.ORACLES.get(name) or BASE[name])
    columns = [d[0] for d in cursor.description]
    frame = registry.QUERIES[name](spark, SF)
    if name == "op7_mixing":
        frame = frame.withColumn("target", F.round("target", 6))
    assert name in BASE or sorted(frame.columns) == sorted(columns)
    assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted(map(tuple, cursor.fetchall()), key=str)
