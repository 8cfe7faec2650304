"""Queries of submissions and result pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import submissions as S
from palimpsest.plans.governance import table


def submission_fields(spark, d):
    body = F.concat(F.lit("intro\r\n### Product\r\n\r\n"), F.col("n_name"), F.lit("\r\n\r\n##  Version \n _No response_ \n### Elsewhere\nx\n####notes\n#### Notes\nline "), F.col("n_nationkey").cast("string"), F.lit("\n# kept\n"))
    n = table(spark, d, "nation").select("n_nationkey", S.fields(body, {"product": "product", "version": "version", "notes": "notes", "link": "link"}).alias("f"))
    return n.select("n_nationkey", "f.*")


def request_paths(spark, d):
    k = F.col("c_custkey")
    claim = F.when(k % 4 == 0, "not-configured").when(k % 4 == 1, "configured").when(k % 4 == 2, "unknown")
    leaked = F.slice(F.array(F.lit("EMAIL"), F.lit("SSN")), F.lit(1), (k % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", S.request_path(k % 7 != 0, claim, leaked, k % 5 == 0).alias("label"), S.number(F.when(k % 6 != 0, (k % 16) / 8)).alias("rate"))


def result_tables(spark, d):
    return S.markdown(table(spark, d, "nation"), "n_regionkey", "n_nationkey", {"n_nationkey": "Key", "n_name": "Name"})


QUERIES = {f.__name__: f for f in (submission_fields, request_paths, result_tables)}
ORACLES = {
    "submission_fields": "SELECT n_nationkey, n_name AS product, '' AS version, 'line ' || n_nationkey || chr(10) || '# kept' AS notes, NULL::VARCHAR AS link FROM nation",
    "request_paths": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' (' || (c_custkey % 3) || ' types seen)' END AS seen FROM customer)
      SELECT k AS c_custkey, CASE WHEN k % 7 = 0 THEN 'not measured' WHEN k % 4 = 0 THEN 'not configured' || seen WHEN k % 4 = 1 THEN ['configured, clean', 'configured, leaked: EMAIL', 'configured, leaked: EMAIL, SSN'][1 + k % 3]
        WHEN k % 5 = 0 THEN 'not applicable' || seen ELSE 'claim not recorded' || seen END AS label,
        CASE WHEN k % 6 = 0 THEN 'n/a' WHEN k % 16 = 0 THEN '0' WHEN k % 8 = 0 THEN '1' ELSE rtrim(printf('%.4f', (k % 16) / 8.0), '0') END AS rate FROM c""",
    "result_tables": """SELECT n_regionkey, count(*) AS n_rows, '| Key | Name |' || chr(10) || '| :--- | :--- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS "table" FROM nation GROUP BY n_regionkey""",
}
