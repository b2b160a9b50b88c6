"""Queries of the quality profile of loads and of the differences of two copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import table_diff, value_counts as vc

MONTHS = tuple(f"m2022_{m:02d}" for m in range(1, 13))
TEXTS = ("state", "metro", "countyname", "fips", "regiontype", "as_of")
RULES = vc.Rules(
    texts=TEXTS,
    numbers=("sizerank", *MONTHS),
    patterns={"state": r"\A[A-Z]{2}\z", "fips": r"\A[0-9]{5}\z", "as_of": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"},
    dates=("as_of",),
    shares=("state", "metro", "regiontype"),
)
DIFF_COLUMNS = ("regionname", "state", "non_missing", "total", "missing_rate")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return vc.find_load_defects(table(spark, sf, "region_index"), table(spark, sf, "file_profiles"), RULES)


def p4_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of every column of every load."""
    groups = ["series", "load_no"]
    counts = vc.counted(table(spark, sf, "region_index"), *groups, RULES).counts()
    found = vc.profile(counts, groups, RULES).join(vc.medians(counts, groups, RULES), [*groups, "column"], "left")
    return found.select(
        *groups, F.col("column").alias("column_name"), "total", "missing", F.col("distinct").alias("distinct_values"),
        F.round("entropy", 5).alias("entropy"), "low", "high", "median", F.col("bad").alias("pattern_violations"),
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return table_diff.differences(table(spark, sf, "result_left"), table(spark, sf, "result_right"), "regionid", DIFF_COLUMNS, "updated_at")


_NO_VALUE = ", ".join("'" + v.replace("'", "''") + "'" for v in vc.NO_VALUE)
_LONG = "\nUNION ALL\n".join(
    [f"SELECT series, load_no, '{c}' AS col, CAST(NULL AS DOUBLE) AS num, {c} AS txt, ({c} IS NULL OR lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) IN ({_NO_VALUE})) AS miss FROM region_index WHERE load_no IS NOT NULL" for c in TEXTS]
    + [f"SELECT series, load_no, '{c}', CAST({c} AS DOUBLE), NULL, ({c} IS NULL OR isnan(CAST({c} AS DOUBLE))) FROM region_index WHERE load_no IS NOT NULL" for c in RULES.numbers]
)
_BAD = """CASE WHEN miss THEN FALSE WHEN col = 'state' THEN NOT regexp_full_match(txt, '[A-Z]{2}') WHEN col = 'fips' THEN NOT regexp_full_match(txt, '[0-9]{5}')
 WHEN col = 'as_of' THEN NOT regexp_full_match(txt, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(txt AS DATE) IS NULL ELSE FALSE END"""
_BASE = f"""long AS ({_LONG}),
base AS (SELECT series, load_no, col, count(*) AS total, count(*) FILTER (miss) AS missing, count(*) FILTER (NOT miss) AS present,
  min(num) FILTER (NOT miss) AS low, max(num) FILTER (NOT miss) AS high, median(num) FILTER (NOT miss) AS median, count(*) FILTER ({_BAD}) AS bad
  FROM long GROUP BY ALL)"""

P4_FOUND = f"""WITH {_BASE},
loads AS (SELECT series, load_no, lead(load_no) OVER (PARTITION BY series ORDER BY load_no) AS nxt FROM (SELECT DISTINCT series, load_no FROM base)),
prev AS (SELECT b.series, l.nxt AS load_no, b.col, b.missing, b.total, b.median, b.present FROM base b JOIN loads l USING (series, load_no) WHERE l.nxt IS NOT NULL),
vals AS (SELECT series, load_no, col, txt, count(*) AS n FROM long WHERE NOT miss AND col IN ('state', 'metro', 'regiontype') GROUP BY ALL),
cur AS (SELECT v.series, v.load_no, v.col, v.txt, v.n / b.present AS share FROM vals v JOIN base b USING (series, load_no, col)),
shift AS (SELECT series, load_no, col, max(abs(d)) AS shift FROM (
  SELECT series, load_no, col, txt, sum(s) AS d FROM (
    SELECT series, load_no, col, txt, share AS s FROM cur
    UNION ALL SELECT c.series, l.nxt, c.col, c.txt, -c.share FROM cur c JOIN loads l USING (series, load_no) WHERE l.nxt IS NOT NULL) GROUP BY ALL) GROUP BY ALL),
rec AS (SELECT series, load_no, arg_max(structure, profiled_at) AS s FROM file_profiles WHERE structure IS NOT NULL GROUP BY ALL),
flat AS (SELECT series, load_no, k.c AS col, CAST(json_extract(s, '$.missing_values.' || k.c) AS BIGINT) AS recorded, json_extract_string(s, '$.dtypes.' || k.c) AS dtype
  FROM rec, (SELECT DISTINCT col AS c FROM base) k),
usual AS (SELECT series, col, arg_min(dtype, (-n, dtype)) AS usual FROM (SELECT series, col, dtype, count(*) AS n FROM flat WHERE dtype IS NOT NULL GROUP BY ALL) GROUP BY ALL),
al AS (SELECT b.*, p.missing / p.total AS rate_before, p.median AS median_before, p.present AS present_before, s.shift, f.recorded, f.dtype, u.usual
  FROM base b LEFT JOIN prev p USING (series, load_no, col) LEFT JOIN shift s USING (series, load_no, col) LEFT JOIN flat f USING (series, load_no, col) LEFT JOIN usual u USING (series, col))
SELECT series, load_no, col AS column_name, kind FROM (
  SELECT *, 'null_rate' AS kind FROM al WHERE missing / total - rate_before >= 0.15 - 1e-9
  UNION ALL SELECT *, 'pattern' FROM al WHERE bad > 0
  UNION ALL SELECT *, 'value_range' FROM al WHERE low < 0 OR high > 20 * median
  UNION ALL SELECT *, 'distribution' FROM al WHERE (median_before > 0 AND (median >= 1.5 * median_before - 1e-9 OR median <= median_before * 2 / 3 + 1e-9)) OR (shift >= 0.2 - 1e-9 AND present > 0 AND present_before > 0)
  UNION ALL SELECT *, 'missing_values' FROM al WHERE recorded <> missing
  UNION ALL SELECT *, 'dtypes' FROM al WHERE dtype <> usual)"""

P4_PROFILE = f"""WITH {_BASE},
ent AS (SELECT series, load_no, col, count(*) AS d, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (
  SELECT series, load_no, col, num, txt, count(*) AS n FROM long WHERE NOT miss GROUP BY ALL) GROUP BY ALL)
SELECT b.series, b.load_no, b.col AS column_name, b.total, b.missing, coalesce(e.d, 0) AS distinct_values, round(e.h, 5) AS entropy, b.low, b.high, b.median, b.bad AS pattern_violations
FROM base b LEFT JOIN ent e USING (series, load_no, col)"""


def _side(name: str) -> str:
    text = "lower(trim({0}))"
    number = "CASE WHEN isnan(missing_rate) THEN NULL ELSE missing_rate END"
    return f"""SELECT regionid, arg_max({{'a': {text.format('regionname')}, 'b': {text.format('state')}, 'c': non_missing, 'd': total, 'e': {number}}}, updated_at) AS r FROM {name} GROUP BY ALL"""


P5_FOUND = f"""WITH l AS ({_side('result_left')}), r AS ({_side('result_right')}),
j AS (SELECT l.regionid AS lk, r.regionid AS rk, l.r AS x, r.r AS y FROM l FULL JOIN r ON l.regionid = r.regionid)
SELECT lk AS regionid, 'only_left' AS difference FROM j WHERE rk IS NULL
UNION ALL SELECT rk, 'only_right' FROM j WHERE lk IS NULL
UNION ALL SELECT lk, 'regionname' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND x.a IS DISTINCT FROM y.a
UNION ALL SELECT lk, 'state' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND x.b IS DISTINCT FROM y.b
UNION ALL SELECT lk, 'non_missing' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND x.c IS DISTINCT FROM y.c
UNION ALL SELECT lk, 'total' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND x.d IS DISTINCT FROM y.d
UNION ALL SELECT lk, 'missing_rate' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND ((x.e IS NULL) <> (y.e IS NULL) OR abs(x.e - y.e) > 1e-6 * (1 + 1e-9))"""

QUERIES = {f.__name__: f for f in (p4_found, p4_profile, p5_found)}
SQL = {"p4_found": P4_FOUND, "p4_profile": P4_PROFILE, "p5_found": P5_FOUND}
