"""Queries of schema drift and interval coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.operators.coverage import periods_and_gaps
from talkgrid.operators.drift import consistent_table, consistent_values, drift_report, load_records
from talkgrid.operators.latest import finite, latest_rows, squeezed, whole_ms
from talkgrid.plans.registry import Registry
from talkgrid.storage import Workspace

R = Registry()

@R.add()
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_rows(spark.read.parquet(f"{sf}/segments.parquet"), "seg_id", "ingested_at", ["file_id", "speaker_id", "start", "end"])
    rows = rows.filter(finite(F.col("start")) & finite(F.col("end")) & (squeezed(F.col("speaker_id")) != ""))
    spans = rows.select("file_id", "speaker_id", whole_ms(F.col("start")).alias("s"), whole_ms(F.col("end")).alias("e"))
    return periods_and_gaps(spans, ["file_id", "speaker_id"], "s", "e", min_members=2, max_gap=600_000)


R.sql["p3_found"] = r"""
WITH latest AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) = 1),
     spans AS (SELECT file_id, speaker_id, round("start" * 1000)::BIGINT AS s, round("end" * 1000)::BIGINT AS e, seg_id FROM latest
               WHERE NOT isnan("start") AND NOT isnan("end") AND trim(speaker_id) <> '' AND file_id IS NOT NULL),
     marked AS (SELECT *, max(e) OVER (PARTITION BY file_id, speaker_id ORDER BY s, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
                FROM spans WHERE e > s),
     numbered AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto THEN 1 ELSE 0 END)
                            OVER (PARTITION BY file_id, speaker_id ORDER BY s, seg_id ROWS UNBOUNDED PRECEDING) AS g FROM marked),
     periods AS (SELECT file_id, speaker_id, min(s) AS s, max(e) AS e, count(*) AS n FROM numbered GROUP BY file_id, speaker_id, g),
     following AS (SELECT *, lead(s) OVER (PARTITION BY file_id, speaker_id ORDER BY s) AS next_s FROM periods)
SELECT file_id, speaker_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods WHERE n >= 2
UNION ALL
SELECT file_id, speaker_id, 'gap' AS kind, e AS start_ms, next_s AS end_ms FROM following WHERE next_s - e <= 600000
"""


#: Exports and their order, records, cells, fields (kinds kept while they stay) and renamings.
_DRIFT = r"""raw AS (SELECT DISTINCT export_id, artefact, station, written_at, payload FROM raw_exports WHERE export_id IS NOT NULL),
 ex AS (SELECT export_id, artefact, station, row_number() OVER w AS seq, lag(export_id) OVER w AS before_id, lead(export_id) OVER w AS after_id
        FROM (SELECT export_id, artefact, station, min(written_at) AS written_at FROM raw GROUP BY ALL) WINDOW w AS (PARTITION BY station, artefact ORDER BY written_at, export_id)),
 rec AS (SELECT row_number() OVER () AS rid, export_id, artefact, payload AS j FROM raw WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
 ext AS (SELECT rid, export_id, artefact, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM rec)),
 txt AS (SELECT *, json_type(v) AS t, v ->> '$' AS x FROM ext),
 cell AS (SELECT rid, export_id, artefact, k, CASE WHEN t = 'NULL' OR (t = 'VARCHAR' AND x IN ('', 'NaN')) THEN NULL WHEN t = 'VARCHAR' THEN 'string' WHEN t IN ('BOOLEAN', 'OBJECT', 'ARRAY') THEN lower(t) ELSE 'number' END AS kind,
    CASE WHEN t IN ('NULL', 'VARCHAR', 'BOOLEAN', 'OBJECT', 'ARRAY') THEN x ELSE regexp_replace(x, '\.0*$|(\.\d*?[1-9])0+$', '\1') END AS value FROM txt),
 votes AS (SELECT export_id, k AS field_name, kind, count(*) AS n FROM cell WHERE k NOT IN ('file_id', 'start', 'end', 'speaker_id') GROUP BY ALL),
 best AS (SELECT export_id, field_name, sum(n)::BIGINT AS occurs, arg_min(kind, {'n': -n, 'k': kind}) FILTER (kind IS NOT NULL) AS kind FROM votes GROUP BY ALL),
 st AS (SELECT b.*, ex.* EXCLUDE (export_id), lag(seq) OVER w AS pseq, lead(seq) OVER w AS nseq FROM best b JOIN ex USING (export_id) WINDOW w AS (PARTITION BY station, artefact, field_name ORDER BY seq)),
 ch AS (SELECT *, pseq IS NULL OR pseq <> seq - 1 AS fresh, max(CASE WHEN pseq IS NULL OR pseq <> seq - 1 THEN seq END) OVER (PARTITION BY station, artefact, field_name ORDER BY seq) AS since FROM st),
 fl AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY station, artefact, field_name, since ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM ch),
 nw AS (SELECT export_id, field_name FROM fl WHERE fresh AND seq > 1), gn AS (SELECT after_id AS export_id, field_name FROM fl WHERE after_id IS NOT NULL AND (nseq IS NULL OR nseq > seq + 1)),
 ky AS (SELECT rid, export_id, any_value(artefact) AS artefact, max(kind || value) FILTER (k = 'file_id') AS f, max(kind || value) FILTER (k = 'speaker_id') AS p,
    CASE WHEN any_value(artefact) = 'segments' THEN max(kind || value) FILTER (k = 'start') ELSE '' END AS a FROM cell GROUP BY rid, export_id),
 pr AS (SELECT n.export_id, n.rid AS nr, o.rid AS r FROM ky n JOIN ex ON ex.export_id = n.export_id JOIN ky o ON o.export_id = ex.before_id AND o.f = n.f AND o.p = n.p AND o.a = n.a),
 cmp AS (SELECT pr.export_id, g.field_name AS old, w.field_name AS new, bool_and((x.kind || x.value) IS NOT DISTINCT FROM (y.kind || y.value)) AS same, count(x.kind) AS n
    FROM pr JOIN gn g ON g.export_id = pr.export_id JOIN nw w ON w.export_id = pr.export_id LEFT JOIN cell x ON x.rid = pr.r AND x.k = g.field_name LEFT JOIN cell y ON y.rid = pr.nr AND y.k = w.field_name GROUP BY ALL),
 one AS (SELECT *, row_number() OVER (PARTITION BY export_id, old ORDER BY n DESC, new) AS r FROM cmp WHERE same AND n > 0),
 two AS (SELECT *, row_number() OVER (PARTITION BY export_id, new ORDER BY n DESC, old) AS q FROM one),
 rn AS (SELECT export_id, old, new FROM two WHERE r = 1 AND q = 1)"""
#: The columns of the fields that get another name, the types of columns, and placed cells.
_PLACED = rf"""{_DRIFT}, ends AS (SELECT rn.export_id, rn.old, rn.new, fl.station, fl.artefact, fl.seq + 1 AS since, fl.since AS past FROM rn JOIN fl ON fl.after_id = rn.export_id AND fl.field_name = rn.old),
 walk(station, artefact, since, field_name, rs, rf) AS (SELECT DISTINCT station, artefact, since, field_name, since, field_name FROM fl WHERE NOT EXISTS (FROM ends WHERE ends.station IS NOT DISTINCT FROM fl.station AND ends.artefact IS NOT DISTINCT FROM fl.artefact AND ends.since = fl.since AND ends.new = fl.field_name)
    UNION ALL SELECT e.station, e.artefact, e.since, e.new, rs, rf FROM walk w JOIN ends e ON e.station IS NOT DISTINCT FROM w.station AND e.artefact IS NOT DISTINCT FROM w.artefact AND e.past = w.since AND e.old = w.field_name),
 pop AS (SELECT artefact, field_name, sum(occurs) AS n FROM fl GROUP BY ALL),
 own AS (SELECT fl.export_id, fl.field_name, fl.artefact, w.station, rs, rf FROM fl JOIN walk w ON w.station IS NOT DISTINCT FROM fl.station AND w.artefact IS NOT DISTINCT FROM fl.artefact AND w.since = fl.since AND w.field_name = fl.field_name),
 nm AS (SELECT DISTINCT station, artefact, rs, rf, field_name AS col FROM walk),
 bad AS (SELECT DISTINCT nm.* FROM nm JOIN own a ON a.station IS NOT DISTINCT FROM nm.station AND a.artefact IS NOT DISTINCT FROM nm.artefact AND a.rs = nm.rs AND a.rf = nm.rf JOIN own b ON b.export_id = a.export_id AND b.field_name = nm.col WHERE (b.rs, b.rf) <> (a.rs, a.rf)),
 line AS (SELECT nm.* FROM nm JOIN pop ON pop.artefact IS NOT DISTINCT FROM nm.artefact AND pop.field_name = nm.col WHERE NOT EXISTS (FROM bad WHERE bad.station IS NOT DISTINCT FROM nm.station AND bad.artefact IS NOT DISTINCT FROM nm.artefact AND bad.rs = nm.rs AND bad.rf = nm.rf AND bad.col = nm.col)
    QUALIFY row_number() OVER (PARTITION BY station, nm.artefact, rs, rf ORDER BY n DESC, nm.col) = 1),
 want AS (SELECT own.export_id, own.field_name, col FROM own JOIN line ON line.station IS NOT DISTINCT FROM own.station AND line.artefact IS NOT DISTINCT FROM own.artefact AND line.rs = own.rs AND line.rf = own.rf),
 mv AS (SELECT export_id, col, min(field_name) AS field_name FROM want WHERE col <> field_name AND NOT EXISTS (FROM fl WHERE fl.export_id = want.export_id AND fl.field_name = col) GROUP BY ALL),
 pl AS (SELECT c.*, coalesce(mv.col, c.k) AS col FROM cell c LEFT JOIN mv ON mv.export_id = c.export_id AND mv.field_name = c.k WHERE kind IS NOT NULL AND k NOT IN ('file_id', 'start', 'end', 'speaker_id')),
 kd AS (SELECT coalesce(mv.col, fl.field_name) AS col, fl.kind, sum(v.n) AS n FROM fl LEFT JOIN mv USING (export_id, field_name) JOIN (SELECT export_id, field_name, sum(n) AS n FROM votes WHERE kind IS NOT NULL GROUP BY ALL) v USING (export_id, field_name) WHERE fl.kind IS NOT NULL GROUP BY ALL),
 tk AS (SELECT col, arg_min(kind, {{'n': -n, 'k': kind}}) AS kind FROM kd GROUP BY ALL),
 sh AS (SELECT col, bool_and(regexp_matches(value, '^-?\d+$')) AS whole FROM pl WHERE try_cast(value AS DOUBLE) IS NOT NULL GROUP BY ALL),
 ty AS (SELECT col, CASE WHEN kind = 'number' THEN CASE WHEN whole THEN 'bigint' ELSE 'double' END WHEN kind = 'boolean' THEN kind ELSE 'string' END AS type FROM tk LEFT JOIN sh USING (col)),
 ok AS (SELECT pl.*, type, CASE type WHEN 'bigint' THEN try_cast(value AS BIGINT) IS NOT NULL WHEN 'double' THEN try_cast(value AS DOUBLE) IS NOT NULL WHEN 'boolean' THEN try_cast(value AS BOOLEAN) IS NOT NULL ELSE true END AS fits FROM pl JOIN ty USING (col))"""


@R.add(
    f"""WITH {_DRIFT} SELECT export_id, field_name, 'added' AS change FROM nw WHERE NOT EXISTS (FROM rn WHERE rn.export_id = nw.export_id AND new = field_name)
UNION ALL SELECT export_id, field_name, 'removed' FROM gn WHERE NOT EXISTS (FROM rn WHERE rn.export_id = gn.export_id AND old = field_name)
UNION ALL SELECT export_id, field_name, 'retyped' FROM fl WHERE NOT fresh AND kind <> kept UNION ALL SELECT export_id, new, 'renamed' FROM rn"""
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    records = load_records(spark.read.parquet(f"{sf}/raw_exports.parquet"))
    return drift_report(records).select("export_id", "field_name", "change")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return Workspace(spark).write(load_records(spark.read.parquet(f"{sf}/raw_exports.parquet")), "records")


@R.add()
def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    return consistent_table(_records(spark, sf))[0]


@R.add(
    f"""WITH RECURSIVE {_PLACED} SELECT export_id, k AS field_name, col AS column_name, type, count(*) AS "values", count(*) FILTER (NOT fits) AS failed FROM ok GROUP BY ALL"""
)
def p2_casts(spark: SparkSession, sf: str) -> DataFrame:
    return consistent_table(_records(spark, sf))[1]


@R.add(
    f"""WITH RECURSIVE {_PLACED}, id AS (SELECT rid, max(value) FILTER (k = 'file_id' AND kind IS NOT NULL) AS file_id, max(value) FILTER (k = 'speaker_id' AND kind IS NOT NULL) AS speaker_id, max(value) FILTER (k = 'start' AND kind IS NOT NULL) AS start FROM cell GROUP BY rid)
SELECT export_id, file_id, speaker_id, start, col AS column_name, value FROM ok JOIN id USING (rid) WHERE fits"""
)
def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent table as rows, one for each value."""
    return consistent_values(_records(spark, sf))
