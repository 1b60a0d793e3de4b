"""Tables derived from the driver's tables: a corpus of SQL text, predictions
for it and a schema catalog. The same text runs in Spark SQL and in DuckDB;
``{orders}`` names an input table, ``<<`` and ``>>`` enclose an array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORPUS_SQL = """
SELECT rec_id, source, db_id,
       concat('How many rows match ', cast(v AS string),
              ' in variant ', cast(rec_id % 3 AS string), '?') AS question,
       concat(CASE WHEN rec_id % 5 = 0
                   THEN replace(body, ' FROM ', concat('  FROM', chr(9), ' ')) ELSE body END,
              CASE rec_id % 13 WHEN 0 THEN ';' WHEN 1 THEN ' ; ' WHEN 2 THEN ' ;;'
                               ELSE '' END) AS sql_raw
FROM (
  SELECT rec_id, source, db_id, v,
    CASE
      WHEN k = 0 THEN concat('SELECT a FROM t', v, ' UNION SELECT b FROM u')
      WHEN k <= 2 THEN concat('SELECT a FROM t WHERE x IN (SELECT y FROM u WHERE z = ', v, ')')
      WHEN k <= 4 THEN concat('SELECT a, COUNT(*) FROM t GROUP BY a HAVING COUNT(*) > ', v)
      WHEN k <= 7 THEN
        concat('SELECT t.a FROM t JOIN u ON t.x = u.x JOIN w ON u.y = w.y WHERE w.z = ', v)
      WHEN k <= 9 THEN concat('SELECT a, SUM(b) FROM t GROUP BY a ORDER BY a LIMIT ', v)
      WHEN k <= 13 THEN
        concat('SELECT t.a FROM t JOIN u ON t.x = u.x WHERE u.n = ''it''''s  ', v, '''')
      WHEN k <= 16 THEN concat('SELECT COUNT(*) FROM t WHERE `col name` = ', v)
      WHEN k = 17 THEN concat('SELECT a FROM t WHERE x = ', v)
      WHEN k = 18 THEN
        concat('SELECT t.a FROM t', chr(10), 'JOIN u ON t.x = u.x WHERE u.z = ', v)
      ELSE concat('SELECT (a FROM t WHERE x = ', v)
    END AS body
  FROM (SELECT o_orderkey AS rec_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS source,
               concat('db_', cast(o_custkey % 40 AS string)) AS db_id,
               cast(o_custkey % 7 AS string) AS v,
               cast((o_orderkey * 7 + o_custkey) % 20 AS int) AS k
        FROM {orders}) x
) y
"""

# Answers of a generator: equal, other case, fenced, other spacing, wrong, broken.
PRED_SQL = """
SELECT rec_id,
  CASE rec_id % 6
    WHEN 0 THEN sql_raw
    WHEN 1 THEN lower(sql_raw)
    WHEN 2 THEN concat('Here it is: ```sql', chr(10), sql_raw, chr(10), '``` done')
    WHEN 3 THEN replace(sql_raw, ' = ', '=')
    WHEN 4 THEN concat('SELECT b FROM v WHERE q = ', cast(rec_id % 9 AS string))
    ELSE 'SELECT FROM WHERE'
  END AS pred_raw
FROM {corpus}
"""

# Texts for which the features and gates have both outcomes.
CASES_SQL = """
SELECT rec_id, source, db_id,
  CASE rec_id % 20
    WHEN 0 THEN concat('SELECT RANK() OVER (ORDER BY a) FROM t', cast(rec_id % 5 AS string))
    WHEN 1 THEN 'SELECT selected_at FROM t'
    WHEN 2 THEN 'SELECT a FROM t WHERE n = ''union all'''
    WHEN 3 THEN concat(sql_raw, ' ''open')
    WHEN 4 THEN concat(sql_raw, '))')
    WHEN 5 THEN ''
    WHEN 6 THEN 'SELECT a FROM t WHERE n = ''((( having'' AND "b)" = 1'
    WHEN 7 THEN 'SELECT a AS rover (b) FROM t'
    WHEN 8 THEN 'no statement at all'
    WHEN 9 THEN 'SELECT DISTINCT FROM t'
    WHEN 10 THEN ') SELECT a FROM t ('
    WHEN 11 THEN 'select sum( a) over(partition by b) from t'
    WHEN 12 THEN 'WITH x AS (SELECT 1) SELECT `it''s` FROM x'
    WHEN 13 THEN 'SELECT a -- it''s'
    WHEN 14 THEN 'SELECT a /* open'
    WHEN 15 THEN 'SELECT [it''s (] FROM t'
    WHEN 16 THEN 'SELECT /* a */ FROM t'
    WHEN 17 THEN concat('-- (', chr(10), 'SELECT a FROM t /* ) */')
    WHEN 18 THEN 'SELECT a FROM t WHERE n = ''--'' AND b = ''/*'''
    ELSE 'SELECT a FROM t LIMIT 1'
  END AS sql_raw,
  rec_id % 20 IN (0, 1, 2, 6, 7, 11, 12, 13, 15, 17, 18, 19) AS sound,
  CASE rec_id % 5
    WHEN 1 THEN << 'user', 'system', 'assistant' >>
    WHEN 2 THEN << 'system', 'user' >>
    WHEN 3 THEN << 'system', 'user', 'assistant', 'user' >>
    ELSE << 'system', 'user', 'assistant' >>
  END AS roles
FROM {corpus}
"""

# Result rows per candidate; 0 is gold. 1 is identical, 2 loses duplicates, 3
# differs on even questions, 4 exists for some questions only.
CANDIDATES_SQL = """
SELECT question_id, 0 AS cand_idx, row_json FROM {results}
UNION ALL SELECT question_id, 1, row_json FROM {results}
UNION ALL SELECT DISTINCT question_id, 2, row_json FROM {results}
UNION ALL SELECT question_id, 3,
                 CASE WHEN question_id % 2 = 0 THEN concat(row_json, 'x') ELSE row_json END
          FROM {results}
UNION ALL SELECT DISTINCT question_id, 4, row_json FROM {results} WHERE question_id % 4 = 0
"""
RESULTS_SQL = """
SELECT l_orderkey % 50 AS question_id,
       concat(cast(l_partkey % 5 AS string), '|', cast(l_linenumber AS string)) AS row_json
FROM {lineitem}
"""

# Result rows as arrays. 1 is gold in another order of columns, 2 has a column
# twice, 3 differs on odd questions, 4 loses duplicates, 5 lacks a column. Of every
# third question two columns are one.
COLUMN_RESULTS_SQL = """
SELECT question_id, a, b, CASE WHEN question_id % 3 = 0 THEN a ELSE c END AS c
FROM (SELECT l_orderkey % 50 AS question_id, cast(l_partkey % 5 AS string) AS a,
             cast(l_linenumber AS string) AS b, cast(l_suppkey % 4 AS string) AS c
      FROM {lineitem}) x
"""
COLUMN_CANDIDATES_SQL = """
SELECT question_id, 0 AS cand_idx, << a, b, c >> AS cells FROM {results}
UNION ALL SELECT question_id, 1, << c, a, b >> FROM {results}
UNION ALL SELECT question_id, 2, << a, b, b >> FROM {results}
UNION ALL SELECT question_id, 3,
                 << b, c, CASE WHEN question_id % 2 = 0 THEN a ELSE concat(a, 'x') END >>
          FROM {results}
UNION ALL SELECT DISTINCT question_id, 4, << b, a, c >> FROM {results}
UNION ALL SELECT question_id, 5, << a, b >> FROM {results}
"""

# One database per customer; a third of them has no foreign key.
CATALOG_SQL = """
SELECT concat('db_', cast(c_custkey AS string)) AS db_id,
  <<'t', 'u', concat('w', cast(c_custkey AS string))>> AS table_names_original,
  << <<'-1', '*'>>, <<'0', 'a'>>, <<'0', 'x'>>, <<'1', 'x'>>, <<'1', 'y'>>,
     <<'2', 'y'>>, <<'2', concat('z', cast(c_custkey AS string))>> >> AS column_names_original,
  CASE WHEN c_custkey % 3 = 0 THEN <<>>
       WHEN c_custkey % 3 = 1 THEN << <<2, 3>> >>
       ELSE << <<2, 3>>, <<4, 5>> >> END AS foreign_keys
FROM {customer}
"""

# Evidence is missing, empty or present.
EVIDENCE_SQL = """
CASE rec_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ''
                ELSE concat('z means ', cast(rec_id % 7 AS string)) END
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id, source, db_id, question, sql_raw``: one row per order."""
    return spark.sql(CORPUS_SQL, orders=table(spark, sf_dir, "orders"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id, pred_raw``: one row per corpus row."""
    return spark.sql(PRED_SQL, corpus=corpus(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema catalog, one database per customer."""
    text = CATALOG_SQL.replace("<<", "array(").replace(">>", ")")
    return spark.sql(text, customer=table(spark, sf_dir, "customer"))

def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id, source, db_id, sql_raw, sound, roles``: sound and broken texts."""
    text = CASES_SQL.replace("<<", "array(").replace(">>", ")")
    return spark.sql(text, corpus=corpus(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id, cand_idx, row_json``: result rows of candidate answers."""
    results = spark.sql(RESULTS_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    return spark.sql(CANDIDATES_SQL, results=results)


def column_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id, cand_idx, cells``: result rows as arrays of cells."""
    results = spark.sql(COLUMN_RESULTS_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    text = COLUMN_CANDIDATES_SQL.replace("<<", "array(").replace(">>", ")")
    return spark.sql(text, results=results)
