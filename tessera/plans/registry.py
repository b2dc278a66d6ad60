"""Registered queries over the driver tables, each with its oracle in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, images, numbers, text
from ..operators import alignment, catalog, ingest, selection, state
from ..sources import driver_tables as tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def counted(spark: SparkSession, d: str) -> DataFrame:
    return tables.counted_series(spark, d)


def dated(spark: SparkSession, d: str) -> DataFrame:
    return catalog.dated_series(counted(spark, d))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return catalog.comparison_matrix(dated(spark, d))


def first_combo(found: DataFrame) -> DataFrame:
    """The combo that most dates have, as a table of one row."""
    return found.groupBy("combo_id").agg(F.countDistinct("date_iso").alias("n")).agg(F.min_by("combo_id", F.struct(-F.col("n"), "combo_id")).alias("combo_id"))


SERIES = """
WITH instance AS (SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '.' || lpad(l_suppkey::VARCHAR, 8, '0') AS series_uid, lpad(l_orderkey::VARCHAR, 12, '0') AS study_uid, * FROM lineitem),
counted AS (
  SELECT i.series_uid, i.study_uid, any_value(l_suppkey)::INT AS series_number, any_value(r_name) AS plane, any_value(o_orderpriority) AS weight, any_value(o_orderdate) AS day, count(*) AS instance_count
  FROM instance i JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2),
dated AS (SELECT *, regexp_replace(lower(plane || '-' || weight), '\\s+', '-', 'g') AS combo_id, plane || ' ' || weight AS label, strftime(day, '%Y-%m-%dT00:00:00') AS date_iso FROM counted),
matrix AS (
  SELECT combo_id, date_iso, study_uid, series_uid, instance_count
  FROM (SELECT *, row_number() OVER (PARTITION BY combo_id, date_iso ORDER BY instance_count DESC, series_uid) AS r FROM dated) WHERE r = 1),
dates AS (SELECT DISTINCT date_iso FROM dated),
combos AS (SELECT combo_id, arg_min(plane, series_uid) AS plane, arg_min(weight, series_uid) AS weight, arg_min(label, series_uid) AS label, count(DISTINCT date_iso) AS date_count, min(series_uid) AS first_series FROM dated GROUP BY 1),
first_combo AS (SELECT combo_id FROM (SELECT combo_id, count(DISTINCT date_iso) AS n FROM matrix GROUP BY 1) ORDER BY n DESC, combo_id LIMIT 1),
enabled AS (SELECT date_iso FROM dates ORDER BY date_iso DESC LIMIT 4)
"""


@query(SERIES + "SELECT combo_id, date_iso, study_uid, series_uid, instance_count FROM matrix")
def comparison_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d)


@query(SERIES + "SELECT combo_id, plane, weight, label, date_count, first_series FROM combos")
def combo_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.combos(dated(spark, d)).drop("sequence")


@query(SERIES + "SELECT DISTINCT plane FROM counted")
def planes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.planes(catalog.counted_series(tables.series(spark, d), tables.instances(spark, d)))


@query(SERIES + "SELECT date_iso FROM dates")
def dates(spark: SparkSession, d: str) -> DataFrame:
    return catalog.dates(catalog.dated_series(counted(spark, d), tables.studies(spark, d)))


@query(
    SERIES + """SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS study_uid, strftime(o_orderdate, '%Y%m%d') AS study_date, o_orderpriority AS study_description, lpad(o_custkey::VARCHAR, 12, '0') AS patient_id,
  coalesce(n, 0) AS series_count, coalesce(total, 0)::BIGINT AS total_instances
FROM orders LEFT JOIN (SELECT study_uid, count(*) AS n, sum(instance_count) AS total FROM counted GROUP BY 1) c ON c.study_uid = lpad(o_orderkey::VARCHAR, 12, '0')"""
)
def study_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.study_list(tables.studies(spark, d), counted(spark, d))


@query(SERIES + "SELECT series_uid, l_linenumber AS instance_number, l_partkey AS part, l_extendedprice AS price, (row_number() OVER (PARTITION BY series_uid ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1)::INT AS position FROM instance")
def instance_position(spark: SparkSession, d: str) -> DataFrame:
    return catalog.positions(tables.instances(spark, d).drop("study_uid"), "instance_number", "part", "price")


@query(SERIES + "SELECT date_iso FROM enabled")
def last4_dates(spark: SparkSession, d: str) -> DataFrame:
    return selection.default_dates(catalog.dates(dated(spark, d)))


@query(SERIES + "SELECT date_iso FROM dates WHERE date_iso IN (SELECT date_iso FROM matrix JOIN first_combo USING (combo_id))")
def selectable_dates(spark: SparkSession, d: str) -> DataFrame:
    found = matrix(spark, d)
    return selection.selectable_dates(catalog.dates(dated(spark, d)), found, first_combo(found))


@query(SERIES + "SELECT combo_id, label FROM combos WHERE combo_id IN (SELECT combo_id FROM matrix JOIN enabled USING (date_iso))")
def combos_with_data(spark: SparkSession, d: str) -> DataFrame:
    each = dated(spark, d)
    return selection.combos_with_data(catalog.combos(each), catalog.comparison_matrix(each), selection.default_dates(catalog.dates(each))).select("combo_id", "label")


def shown_cells(spark: SparkSession, d: str, how: str) -> DataFrame:
    found = matrix(spark, d)
    return selection.cells(catalog.dates(dated(spark, d)), found, first_combo(found), how).select("date_iso", "series_uid", "instance_count")


@query(SERIES + "SELECT d.date_iso, series_uid, instance_count FROM dates d LEFT JOIN (SELECT * FROM matrix JOIN first_combo USING (combo_id)) m USING (date_iso)")
def cells_left(spark: SparkSession, d: str) -> DataFrame:
    return shown_cells(spark, d, "left")


@query(SERIES + "SELECT date_iso, series_uid, instance_count FROM matrix JOIN first_combo USING (combo_id)")
def cells_inner(spark: SparkSession, d: str) -> DataFrame:
    return shown_cells(spark, d, "inner")


@query(SERIES + "SELECT date_iso, series_uid FROM matrix JOIN first_combo USING (combo_id) WHERE date_iso <> (SELECT max(date_iso) FROM matrix JOIN first_combo USING (combo_id))")
def target_dates(spark: SparkSession, d: str) -> DataFrame:
    own = shown_cells(spark, d, "inner")
    return selection.target_dates(own, own.agg(F.max("date_iso").alias("date_iso"))).select("date_iso", "series_uid")


@query(SERIES + "SELECT date_iso FROM dates WHERE date_iso NOT IN (SELECT date_iso FROM matrix JOIN first_combo USING (combo_id))")
def new_dates(spark: SparkSession, d: str) -> DataFrame:
    found = matrix(spark, d)
    return selection.new_dates(catalog.dates(dated(spark, d)), found.join(F.broadcast(first_combo(found)), "combo_id", "left_semi"))


@query(
    SERIES + """, near AS (SELECT combo_id, date_iso, lag(date_iso) OVER w AS older, lead(date_iso) OVER w AS newer FROM matrix WINDOW w AS (PARTITION BY combo_id ORDER BY date_iso))
SELECT combo_id, date_iso, CASE WHEN older IS NULL THEN newer WHEN newer IS NULL OR date_diff('day', older::TIMESTAMP, date_iso::TIMESTAMP) <= date_diff('day', date_iso::TIMESTAMP, newer::TIMESTAMP) THEN older ELSE newer END AS nearest FROM near"""
)
def nearest_date(spark: SparkSession, d: str) -> DataFrame:
    return selection.nearest_dates(matrix(spark, d).select("combo_id", "date_iso"), ["combo_id"])


@query(
    SERIES + """, listed AS (SELECT *, row_number() OVER (ORDER BY plane, first_series) AS place FROM combos),
wanted AS (SELECT combo_id AS current_id, weight AS own, coalesce(lead(plane) OVER (ORDER BY plane, first_series), first_value(plane) OVER (ORDER BY plane, first_series)) AS new_plane FROM combos)
SELECT current_id, new_plane, arg_min(l.combo_id, CASE WHEN l.weight = own THEN 0 ELSE 1000000 END + place) AS combo_id FROM wanted JOIN listed l ON l.plane = new_plane GROUP BY 1, 2"""
)
def best_match_combo(spark: SparkSession, d: str) -> DataFrame:
    found = catalog.combos(dated(spark, d))
    order = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("plane", F.lit("")), "first_series")
    current = found.select(F.col("combo_id").alias("current_id"), F.coalesce(F.lead("plane").over(order), F.first("plane").over(order)).alias("new_plane"))
    return selection.best_match(found, current)


@query(
    SERIES + """, own AS (SELECT combo_id, list_sort(list(DISTINCT date_iso)) AS held, max(date_iso) AS newest FROM matrix GROUP BY 1)
SELECT combo_id, array_to_string(list_filter(held, lambda x: x <> newest), ',') AS without_newest, array_to_string(list_sort(list_append(held, '1900-01-01T00:00:00')), ',') AS with_other FROM own"""
)
def date_toggle(spark: SparkSession, d: str) -> DataFrame:
    own = matrix(spark, d).groupBy("combo_id").agg(F.collect_set("date_iso").alias("held"), F.max("date_iso").alias("newest"))
    return own.select("combo_id", F.array_join(selection.toggled(F.col("held"), F.col("newest")), ",").alias("without_newest"), F.array_join(selection.toggled(F.col("held"), F.lit("1900-01-01T00:00:00")), ",").alias("with_other"))


def edits(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of settings: (combo, day, field, value, order)."""
    e = tables.read(spark, d, "events")
    return e.select(F.col("user_id").alias("combo"), F.date_format("ts", "yyyy-MM-dd").alias("date_iso"), F.col("event_type").alias("field"), "value", "ts", "event_id")


@query("SELECT user_id AS combo, strftime(ts, '%Y-%m-%d') AS date_iso, " + ", ".join(f"arg_max(CASE WHEN event_type = '{t}' THEN value END, CASE WHEN event_type = '{t}' THEN event_id END) AS {t}" for t in ("view", "click", "error")) + " FROM events GROUP BY 1, 2")
def settings_latest(spark: SparkSession, d: str) -> DataFrame:
    log = edits(spark, d)
    wide = log.select("combo", "date_iso", "event_id", *[F.when(F.col("field") == t, F.col("value")).alias(t) for t in ("view", "click", "error")])
    return state.latest(wide, ["combo", "date_iso"], ["view", "click", "error"], "event_id")


@query(
    """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') || '/' || user_id::VARCHAR AS date_iso FROM events),
stored AS (SELECT date_iso, arg_max(value, event_id) AS zoom FROM e WHERE event_type = 'view' GROUP BY 1), held AS (SELECT date_iso, arg_max(value, event_id) AS zoom FROM e WHERE event_type = 'click' GROUP BY 1),
enabled AS (SELECT DISTINCT date_iso FROM e WHERE event_type = 'purchase')
SELECT date_iso, coalesce(s.zoom, h.zoom, 1.0) AS zoom FROM enabled FULL JOIN stored s USING (date_iso) FULL JOIN (SELECT * FROM held WHERE date_iso IN (SELECT date_iso FROM enabled)) h USING (date_iso)"""
)
def settings_hydrated(spark: SparkSession, d: str) -> DataFrame:
    log = edits(spark, d).withColumn("date_iso", F.concat("date_iso", F.lit("/"), "combo"))
    last = lambda t: log.filter(F.col("field") == t).groupBy("date_iso").agg(F.max_by("value", "event_id").alias("zoom"))
    return state.hydrated(last("view"), last("click"), log.filter(F.col("field") == "purchase").select("date_iso"), values=("zoom",))


@query(
    """WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS combo, event_id, sum(starts) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM m"""
)
def undo_batches(spark: SparkSession, d: str) -> DataFrame:
    return state.batches(edits(spark, d), ["combo"], "field", "event_id").select("combo", "event_id", "run")


@query("SELECT user_id AS combo, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 40")
def history_cap(spark: SparkSession, d: str) -> DataFrame:
    return state.capped(edits(spark, d), ["combo"], "event_id", 40).select("combo", "event_id")


@query("SELECT user_id AS combo, max(event_id) AS updated_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def cookie_top25(spark: SparkSession, d: str) -> DataFrame:
    return state.recent(edits(spark, d).groupBy("combo").agg(F.max("event_id").alias("updated_at")), "updated_at", "combo")


@query("SELECT user_id AS combo, event_id FROM (SELECT *, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) WHERE gap IS NULL OR gap >= 3600000000")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return state.debounced(edits(spark, d), ["combo"], "ts", 3_600_000).select("combo", "event_id")


def sql_rules() -> str:
    """The classifier in SQL over columns up (upper-case text), words (tokens with blanks around) and run (compacted)."""
    digits = "[0-9]"
    weight = lambda w: f"len(list_filter(string_split(words, ' '), lambda t: instr(t, '{w}') > 0 AND NOT regexp_matches(substr(t, instr(t, '{w}') + 2, 1), '{digits}'))) > 0"
    named = lambda s: f"regexp_matches(words, ' {s}[0-9]* ')" + (f" OR contains(run, '{s}')" if len(s) > 3 else "")
    plane = """CASE WHEN contains(up, 'AXIAL') THEN 'Axial' WHEN contains(up, 'CORONAL') THEN 'Coronal' WHEN contains(up, 'SAGITTAL') THEN 'Sagittal' WHEN regexp_matches(words, ' (?:AX|TRA |TRANS|TRV)') THEN 'Axial'
WHEN contains(words, ' COR') THEN 'Coronal' WHEN contains(words, ' SAG') THEN 'Sagittal' WHEN contains(run, 'SAG') THEN 'Sagittal' WHEN contains(run, 'COR') THEN 'Coronal' WHEN regexp_matches(run, 'AX|TRA|TRV') THEN 'Axial' END"""
    sequence = "CASE " + " ".join(f"WHEN {named(s)} THEN '{'Localizer' if s == 'LOCALIZER' else s}'" for s in text.SEQUENCES) + " END"
    return f"{plane} AS plane, {sequence} AS sequence, CASE WHEN {weight('T1')} THEN 'T1' WHEN {weight('T2')} THEN 'T2' END AS told_weight"


def sql_list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(
    f"""WITH u AS (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS up FROM documents), w AS (SELECT doc_id, up, ' ' || regexp_replace(up, '[^A-Z0-9]+', ' ', 'g') || ' ' AS words, regexp_replace(up, '[^A-Z0-9]', '', 'g') AS run FROM u),
c AS (SELECT doc_id, {sql_rules()} FROM w)
SELECT doc_id, plane, coalesce(told_weight, CASE WHEN sequence IN ({sql_list(text.T1_SEQUENCES)}) THEN 'T1' WHEN sequence IN ({sql_list(text.T2_SEQUENCES)}) THEN 'T2' END) AS weight, sequence FROM c"""
)
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select("doc_id", text.classified(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]+'), lambda t: t <> '')) AS n_tokens FROM documents")
def token_lists(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand || '-' || p_type), '\\s+', '-', 'g') AS combo_id, p_name || ' ' || p_brand || ' ' || p_type AS label, p_name || ' | ' || p_type AS told FROM part")
def slug_label(spark: SparkSession, d: str) -> DataFrame:
    parts = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return tables.read(spark, d, "part").select("p_partkey", text.combo_id(*parts).alias("combo_id"), text.combo_label(*parts).alias("label"), text.classification_text(parts[0], F.lit(""), parts[2]).alias("told"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS date_iso, strftime(o_orderdate, '%Y-%m-%d') AS short, strftime(o_orderdate, '%b %-d, %Y') AS long, epoch_ms(date_trunc('day', o_orderdate)) AS millis FROM orders")
def date_iso(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    iso = text.iso_date(day)
    return tables.read(spark, d, "orders").select("o_orderkey", iso.alias("date_iso"), text.short_date(day).alias("short"), text.long_date(iso).alias("long"), text.utc_millis(text.short_date(day)).alias("millis"))


@query(
    """SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(url, '[\\\\/:"*?<>|]+', '_', 'g')), 1, 80), ''), 'unknown') AS file, CASE WHEN length(page_id::VARCHAR) < 4 THEN lpad(page_id::VARCHAR, 4, '0') ELSE page_id::VARCHAR END AS padded,
  regexp_extract(url, '[^/]*$') AS base, right(url, 12) AS tail FROM pages"""
)
def sanitize_pad(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return tables.read(spark, d, "pages").select("page_id", text.safe_filename(url).alias("file"), text.zero_padded(F.col("page_id"), 4).alias("padded"), text.basename(url).alias("base"), text.tail(url, 12).alias("tail"))


@query("SELECT c_custkey, base64(encode(c_name)) AS encoded, c_name AS decoded, replace(url_encode(c_name), '+', '%20') AS uri FROM customer")
def base64_rt(spark: SparkSession, d: str) -> DataFrame:
    c = F.base64(F.encode("c_name", "UTF-8"))
    return tables.read(spark, d, "customer").select("c_custkey", c.alias("encoded"), F.decode(F.unbase64(c), "UTF-8").alias("decoded"), text.uri_encoded(F.col("c_name")).alias("uri"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, round((value - 100 + 180) - 360 * floor((value - 100 + 180) / 360) - 180, 6) AS rotation FROM events")
def rotation_norm(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").select("event_id", F.round(numbers.normal_rotation(F.col("value") - 100), 6).alias("rotation"))


@query(
    SERIES + """, s AS (SELECT series_uid, instance_count, (series_number % 11) / 10.0 AS progress, series_number % 5 - 2 AS shift FROM counted),
i AS (SELECT *, greatest(0, least(instance_count - 1, floor(progress * (instance_count - 1) + 0.5) + shift))::INT AS slice FROM s)
SELECT series_uid, slice, (instance_count - 1 - slice)::INT AS reversed FROM i"""
)
def slice_index(spark: SparkSession, d: str) -> DataFrame:
    s = counted(spark, d).withColumn("slice", numbers.slice_index(F.col("instance_count"), (F.col("series_number") % 11) / 10.0, F.col("series_number") % 5 - 2))
    return s.select("series_uid", "slice", numbers.instance_index(F.col("slice"), F.col("instance_count"), F.lit(True)).alias("reversed"))


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as square images, each with the following one as its pair (the last with the first)."""
    e = tables.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    n = e.agg((F.max("vec_id") + 1).alias("n"))
    return e.join(F.broadcast(n)).withColumn("pair_id", (F.col("vec_id") + 1) % F.col("n")).drop("n").join(e.select(F.col("vec_id").alias("pair_id"), F.col("a").alias("b")), "pair_id")


def sql_stats(c: str, prefix: str = "") -> str:
    v = f"list_transform({c}, lambda x: x::DOUBLE)"
    return f"list_avg({v}) AS {prefix}mean, list_stddev_pop({v}) AS {prefix}stddev, list_min({v}) AS {prefix}min, list_max({v}) AS {prefix}max, " + ", ".join(f"list_sort({v})[floor(len({c}) * {p / 100})::INT + 1] AS {prefix}p{p}" for p in (10, 50, 90))


STATS = ("mean", "stddev", "min", "max", "p10", "p50", "p90")
PAIRS = "WITH pair AS (SELECT x.vec_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = (x.vec_id + 1) % (SELECT max(vec_id) + 1 FROM embeddings))"


@query(f"WITH s AS (SELECT vec_id, {sql_stats('embedding')} FROM embeddings) SELECT vec_id, {', '.join(f'round({k}, 6) AS {k}' for k in STATS)} FROM s")
def hist_stats(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "embeddings").select("vec_id", images.statistics(F.col("embedding")).alias("s"))
    return s.select("vec_id", *[F.round(f"s.{k}", 6).alias(k) for k in STATS])


@query(
    """WITH e AS (SELECT label, embedding, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings), p AS (SELECT label, low, high, unnest(embedding)::DOUBLE AS x FROM e)
SELECT label, least(15, greatest(0, floor((x - low) / (high - low) * 16)))::INT AS bin, count(*) AS n FROM p GROUP BY 1, 2"""
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "embeddings").withColumns({"low": F.array_min("embedding").cast("double"), "high": F.array_max("embedding").cast("double")})
    return e.select("label", "low", "high", F.explode("embedding").alias("x")).groupBy("label", images.bin_of(F.col("x"), F.col("low"), F.col("high"), 16).alias("bin")).agg(F.count("*").alias("n"))


@query(
    PAIRS + """, r AS (SELECT vec_id, list_min(a)::DOUBLE AS la, list_max(a)::DOUBLE AS ha, list_min(b)::DOUBLE AS lb, list_max(b)::DOUBLE AS hb, unnest(list_zip(a, b)) AS p FROM pair),
z AS (SELECT vec_id, least(7, greatest(0, floor((p[1]::DOUBLE - la) / (ha - la) * 8)))::INT AS i, least(7, greatest(0, floor((p[2]::DOUBLE - lb) / (hb - lb) * 8)))::INT AS j FROM r),
n AS (SELECT vec_id, count(*)::DOUBLE AS n FROM z GROUP BY 1),
ea AS (SELECT vec_id, sum(-(c / n) * ln(c / n)) AS h FROM (SELECT vec_id, i, count(*) AS c FROM z GROUP BY 1, 2) JOIN n USING (vec_id) GROUP BY 1),
eb AS (SELECT vec_id, sum(-(c / n) * ln(c / n)) AS h FROM (SELECT vec_id, j, count(*) AS c FROM z GROUP BY 1, 2) JOIN n USING (vec_id) GROUP BY 1),
eab AS (SELECT vec_id, sum(-(c / n) * ln(c / n)) AS h FROM (SELECT vec_id, i, j, count(*) AS c FROM z GROUP BY 1, 2, 3) JOIN n USING (vec_id) GROUP BY 1)
SELECT vec_id, round(ea.h + eb.h - eab.h, 6) AS mi, round((ea.h + eb.h) / eab.h, 6) AS nmi FROM ea JOIN eb USING (vec_id) JOIN eab USING (vec_id)"""
)
def mi_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = pictures(spark, d).select("vec_id", images.mutual_information(F.col("a"), F.col("b"), 8).alias("m"))
    return m.select("vec_id", F.round("m.mi", 6).alias("mi"), F.round("m.nmi", 6).alias("nmi"))


@query(PAIRS + ", q AS (SELECT vec_id, list_transform(list_zip(a, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)) AS d FROM pair) SELECT vec_id, round(list_avg(d), 6) AS mad, round(list_max(d), 6) AS max_abs FROM q")
def mad_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = pictures(spark, d).select("vec_id", images.differences(F.col("a"), F.col("b")).alias("m"))
    return m.select("vec_id", F.round("m.mad", 6).alias("mad"), F.round("m.max_abs", 6).alias("max_abs"))


@query(
    PAIRS + f""", s AS (SELECT vec_id, {sql_stats('a', 'r_')}, {sql_stats('b', 't_')} FROM pair), k AS (SELECT vec_id, r_stddev / t_stddev AS a, 1 - 2 * (r_mean - r_stddev / t_stddev * t_mean) AS c FROM s)
SELECT vec_id, floor(greatest(0, least(200, a / c * 100)) + 0.5)::INT AS brightness, floor(greatest(0, least(200, c * 100)) + 0.5)::INT AS contrast FROM k"""
)
def intensity_match(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).select("vec_id", images.intensity_match(images.statistics(F.col("a")), images.statistics(F.col("b"))).alias("m")).select("vec_id", "m.*")


@query("WITH s AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings) SELECT vec_id, round(sum(greatest(0, least(1, (x::DOUBLE * 1.2 - 0.5) * 0.8 + 0.5))::FLOAT::DOUBLE), 4) AS shown FROM s GROUP BY 1")
def displayed_pixels(spark: SparkSession, d: str) -> DataFrame:
    shown = images.displayed(F.col("embedding"), F.lit(120.0), F.lit(80.0))
    return tables.read(spark, d, "embeddings").select("vec_id", F.round(images.total(shown), 4).alias("shown"))


def element(i: int):
    return F.get("embedding", F.lit(i)).cast("double")


def maps(spark: SparkSession, d: str) -> DataFrame:
    """Two affine maps of the elements of every embedding."""
    make = lambda o: geometry.affine(geometry.matrix(1 + element(o), element(o + 1), element(o + 2), 1 + element(o + 3)), geometry.vector(element(o + 4), element(o + 5)))
    return tables.read(spark, d, "embeddings").select("vec_id", make(0).alias("one"), make(6).alias("two"))


MAPS = "WITH m AS (SELECT vec_id, " + ", ".join(f"{1 if k in 'ad' else 0} + embedding[{o + i + 1}]::DOUBLE AS {k}{o // 6 + 1}" for o in (0, 6) for i, k in enumerate("abcdxy")) + " FROM embeddings)"


@query(
    MAPS + """ SELECT vec_id, round(a2 * a1 + b2 * c1, 6) AS m00, round(a2 * b1 + b2 * d1, 6) AS m01, round(c2 * a1 + d2 * c1, 6) AS m10, round(c2 * b1 + d2 * d1, 6) AS m11,
round(a2 * x1 + b2 * y1 + x2, 6) AS x, round(c2 * x1 + d2 * y1 + y2, 6) AS y FROM m"""
)
def affine_compose(spark: SparkSession, d: str) -> DataFrame:
    both = maps(spark, d).select("vec_id", geometry.composed(F.col("two"), F.col("one")).alias("c"))
    return both.select("vec_id", *[F.round(f"c.a.{k}", 6).alias(k) for k in ("m00", "m01", "m10", "m11")], F.round("c.b.x", 6).alias("x"), F.round("c.b.y", 6).alias("y"))


@query(MAPS + " SELECT vec_id, round(degrees(atan2(c1 - b1, a1 + d1)), 6) AS rotation, round(sqrt(abs(a1 * d1 - b1 * c1)), 6) AS zoom, round(a1 * d1 - b1 * c1, 6) AS det FROM m")
def affine_decompose(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("one.a")
    return maps(spark, d).select("vec_id", geometry.decomposed(a).alias("d"), geometry.det(a).alias("det")).select("vec_id", F.round("d.rotation", 6).alias("rotation"), F.round("d.zoom", 6).alias("zoom"), F.round("det", 6).alias("det"))


@query(
    """WITH v AS (SELECT vec_id, embedding[2]::DOUBLE * embedding[6]::DOUBLE - embedding[3]::DOUBLE * embedding[5]::DOUBLE AS x, embedding[3]::DOUBLE * embedding[4]::DOUBLE - embedding[1]::DOUBLE * embedding[6]::DOUBLE AS y,
  embedding[1]::DOUBLE * embedding[5]::DOUBLE - embedding[2]::DOUBLE * embedding[4]::DOUBLE AS z FROM embeddings)
SELECT vec_id, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 'Sagittal' WHEN abs(y) >= abs(x) AND abs(y) >= abs(z) THEN 'Coronal' ELSE 'Axial' END AS plane FROM v"""
)
def orientation_planes(spark: SparkSession, d: str) -> DataFrame:
    six = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    return tables.read(spark, d, "embeddings").select("vec_id", geometry.plane_from_orientation(six).alias("plane"))


@query(
    """WITH p AS (SELECT p_partkey, 'scan/' || p_name || CASE p_partkey % 7 WHEN 0 THEN '.TXT' WHEN 1 THEN '/.hidden' ELSE '' END AS path, CASE WHEN p_partkey % 11 = 0 THEN 'bad' END AS error, p_size - 1 AS pixels, p_size AS side,
  CASE WHEN p_partkey % 13 = 0 THEN '1.2.840.10008.5.1.4.1.1.7.2' ELSE '1.2.840.10008.5.1.4.1.1.4' END AS kind, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 's' END AS study, (p_partkey % 1000)::VARCHAR AS uid FROM part),
r AS (SELECT *, CASE WHEN p_partkey % 7 IN (0, 1) THEN 'extension' WHEN error IS NOT NULL THEN 'not-dicom' WHEN pixels = 0 OR side = 0 THEN 'non-displayable' WHEN starts_with(kind, '1.2.840.10008.5.1.4.1.1.7') THEN 'secondary-capture' WHEN study = '' THEN 'missing-uids' END AS reason FROM p),
s AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY uid, reason IS NULL ORDER BY p_partkey) > 1 THEN 'duplicate' WHEN reason IS NULL THEN 'ingested' WHEN reason IN ('not-dicom', 'missing-uids') THEN 'error' ELSE 'skipped' END AS status FROM r)
SELECT status, coalesce(reason, '') AS reason, count(*) AS n FROM s GROUP BY 1, 2"""
)
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.when(k % 7 == 0, ".TXT").when(k % 7 == 1, "/.hidden").otherwise("")
    files = tables.read(spark, d, "part").select(
        k.alias("file_seq"), F.concat(F.lit("scan/"), "p_name", suffix).alias("path"), F.when(k % 11 == 0, "bad").alias("error"), (F.col("p_size") - 1).cast("long").alias("pixel_length"),
        F.col("p_size").cast("double").alias("rows"), F.col("p_size").cast("double").alias("columns"), F.when(k % 13 == 0, ingest.SECONDARY + ".2").otherwise("1.2.840.10008.5.1.4.1.1.4").alias("sop_class"),
        F.when(k % 17 == 0, "").otherwise("s").alias("study_uid"), F.lit("e").alias("series_uid"), (k % 1000).cast("string").alias("sop_uid"),
    )
    return ingest.judged(files, files.limit(0)).groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query()
def warp(spark: SparkSession, d: str) -> DataFrame:
    m = maps(spark, d).join(tables.read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    a, b = F.col("one.a"), F.col("one.b")
    return m.select("vec_id", images.warp("embedding", F.lit(8), a["m00"], a["m01"], a["m10"], a["m11"], b["x"], b["y"]).alias("warped"))


@query()
def slice_search(spark: SparkSession, d: str) -> DataFrame:
    """Of every label the slice most like the first image of all, in the order of vec_id."""
    e = tables.read(spark, d, "embeddings")
    slices = e.select("label", F.col("vec_id").alias("position"), F.col("embedding").alias("pixels"))
    reference = e.agg(F.min_by("embedding", "vec_id").alias("reference_pixels"))
    return alignment.best_slices(alignment.scored(slices, reference, 8), "label", 1, 3)


@query()
def candidate_choice(spark: SparkSession, d: str) -> DataFrame:
    m = maps(spark, d).join(tables.read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    a = geometry.about_origin(geometry.composed(F.col("two"), F.col("one")), geometry.vector(3.5, 3.5))
    rows = m.select(F.col("vec_id").alias("key"), F.col("embedding").alias("moving"), F.lit(8).alias("size"), F.array("one", "two").alias("maps"), images.warp("embedding", F.lit(8), a["a"]["m00"], a["a"]["m01"], a["a"]["m10"], a["a"]["m11"], a["t"]["x"], a["t"]["y"]).alias("resampled"))
    return alignment.chosen_candidate(rows)


#: The stacks, step by step: v is a map of settings by date, u and r are the stacks of entries (date, before, after).
UNDO = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, strftime(ts, '%Y-%m-%d') AS date_iso, event_type AS field, value::DOUBLE AS value FROM events),
s AS (SELECT key, 0::BIGINT AS i, MAP {}::MAP(VARCHAR, MAP(VARCHAR, DOUBLE)) AS v, []::STRUCT(d VARCHAR, b MAP(VARCHAR, DOUBLE), a MAP(VARCHAR, DOUBLE))[] AS u, []::STRUCT(d VARCHAR, b MAP(VARCHAR, DOUBLE), a MAP(VARCHAR, DOUBLE))[] AS r FROM e GROUP BY 1
  UNION ALL SELECT key, i,
    CASE WHEN field = 'signup' THEN CASE WHEN len(u) > 0 THEN map_concat(v, MAP {u[-1].d: u[-1].b}) ELSE v END WHEN field = 'error' THEN CASE WHEN len(r) > 0 THEN map_concat(v, MAP {r[-1].d: r[-1].a}) ELSE v END ELSE map_concat(v, MAP {date_iso: n}) END,
    CASE WHEN field = 'signup' THEN u[:-2] WHEN field = 'error' THEN CASE WHEN len(r) > 0 THEN list_append(u, r[-1]) ELSE u END WHEN told THEN list_append(u, {'d': date_iso, 'b': c, 'a': n})[-200:] ELSE u END,
    CASE WHEN field = 'signup' THEN CASE WHEN len(u) > 0 THEN list_append(r, u[-1]) ELSE r END WHEN field = 'error' THEN r[:-2] WHEN told THEN [] ELSE r END
  FROM (SELECT s.key, e.i, v, u, r, date_iso, field, value, c, map_concat(c, MAP {field: value}) AS n, c[field] IS DISTINCT FROM value AS told
    FROM (SELECT s.*, e.date_iso, e.field, e.value, e.i AS j, coalesce(v[e.date_iso], MAP {}::MAP(VARCHAR, DOUBLE)) AS c FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1) s JOIN (SELECT key, i FROM e) e ON e.key = s.key AND e.i = s.j)),
f AS (SELECT key, v FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1), d AS (SELECT key, unnest(map_entries(v)) AS m FROM f), x AS (SELECT key, (m).key AS date_iso, unnest(map_entries((m).value)) AS w FROM d)
SELECT key, date_iso, (w).key AS field, (w).value AS value FROM x"""


@query(UNDO)
def undo_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits, with sign-ups as undo and errors as redo, replayed for each user."""
    kind = F.when(F.col("field") == "signup", "undo").when(F.col("field") == "error", "redo").otherwise("edit")
    return state.replay(edits(spark, d).select(F.col("combo").cast("string").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), "date_iso", "field", "value", F.lit(None).cast("string").alias("batch")))
