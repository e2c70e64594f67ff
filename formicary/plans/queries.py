"""Named queries over the driver's tables, each with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formicary.operators import counts, graph, markov, sketches, store, windows
from formicary.plans.engine import Engine
from formicary.schema import HABITATS, ROLES, SPECIES, encode, judged, organisms
from formicary.streaming import streams

DAY = 86_400
#: The tables span 30 days at a few hundred events a day, so windows are days here.
DAYS = {"1day": DAY, "5day": 5 * DAY, "15day": 15 * DAY, "30day": 30 * DAY}
EVENT = "error"  # plays "predator attack"
WALKS, STEPS = 128, 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organisms(spark.read.parquet(f"{sf_dir}/events.parquet"))


def query(sql: str | None = None) -> Callable:
    """Register a function of (organism events) under its name, with its SQL over the view `org`."""

    def wrap(f: Callable[[DataFrame], DataFrame]) -> Callable:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH RECURSIVE {ORG}{',' + sql.removeprefix('WITH') if sql.lstrip().startswith('WITH') else ' ' + sql}"
        return f

    return wrap


def _case(index: str, values: list[str]) -> str:
    return "CASE " + index + "".join(f" WHEN {k} THEN '{v}'" for k, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


ORG = f"""org AS (SELECT event_id AS id, ts, event_type AS event, user_id, {_case("user_id % 4", SPECIES)} AS species,
 {_case("(user_id // 4) % 4", ROLES)} AS role, {_case("event_id % 4", HABITATS)} AS habitat, CAST(1 + user_id % 10 AS INT) AS age,
 CAST(json_extract_string(props, '$.k') AS INT) - 50 AS ecological_impact, 1 + 10 * CAST(json_extract_string(props, '$.k') AS INT) AS population_density,
 CAST((event_id * 37) % 18000 AS DOUBLE) / 100 - 90 AS latitude, CAST((event_id * 91) % 36000 AS DOUBLE) / 100 - 180 AS longitude FROM events),
now AS (SELECT max(ts) AS t FROM org), aged AS (SELECT org.*, (epoch_us(now.t) - epoch_us(ts)) / 1000000.0 AS age_s FROM org, now)"""

_WINDOWS = "(VALUES " + ", ".join(f"('{n}', {s})" for n, s in DAYS.items()) + ') AS w("window", s)'


def _stamp(column: str = "ts") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("event_time")


# --- store ------------------------------------------------------------------------------------


@query("""SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM org UNION ALL SELECT 'species', species, count(*) FROM org GROUP BY 2
UNION ALL SELECT 'role', role, count(*) FROM org GROUP BY 2 UNION ALL SELECT 'habitat', habitat, count(*) FROM org GROUP BY 2 UNION ALL SELECT 'event', event, count(*) FROM org GROUP BY 2""")
def stats(org: DataFrame) -> DataFrame:
    return store.stats(org)


@query("SELECT id, species, role, event, habitat FROM org WHERE species = 'bee' ORDER BY id LIMIT 10")
def species_lookup(org: DataFrame) -> DataFrame:
    return store.by_species(org, "bee").select("id", "species", "role", "event", "habitat")


@query(f"SELECT id, species, role, ecological_impact FROM org WHERE habitat = 'garden' AND event = '{EVENT}' ORDER BY id LIMIT 10")
def habitat_event_lookup(org: DataFrame) -> DataFrame:
    return store.by_habitat_event(org, "garden", EVENT).select("id", "species", "role", "ecological_impact")


@query("SELECT id, ecological_impact, population_density, species, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time FROM org ORDER BY id LIMIT 10")
def eco_density(org: DataFrame) -> DataFrame:
    return store.impact_and_density(org).select("id", "ecological_impact", "population_density", "species", _stamp())


@query(f"SELECT id, species, event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time FROM aged WHERE age_s <= {DAY}")
def recent_events(org: DataFrame) -> DataFrame:
    return store.recent(org, DAY, store.as_of(org)).select("id", "species", "event", _stamp())


@query("SELECT user_id, arg_max(id, id) AS id, arg_max(event, id) AS event, arg_max(habitat, id) AS habitat FROM org GROUP BY user_id")
def upsert_latest(org: DataFrame) -> DataFrame:
    return store.upsert(org.select("user_id", "id", "event", "habitat"), "user_id", "id")


@query(f"SELECT species, count(*) FILTER (WHERE age_s <= {10 * DAY}) AS kept, count(*) FILTER (WHERE age_s > {10 * DAY}) AS removed FROM aged GROUP BY species")
def retention(org: DataFrame) -> DataFrame:
    kept, removed = store.retain(org, 240, store.as_of(org))
    both = kept.select("species", F.lit(1).alias("k"), F.lit(0).alias("r")).unionByName(removed.select("species", F.lit(0).alias("k"), F.lit(1).alias("r")))
    return both.groupBy("species").agg(F.sum("k").alias("kept"), F.sum("r").alias("removed"))


@query("""WITH m AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'corrupt' WHEN id % 10 = 1 THEN 'missing event' WHEN id % 10 = 2 THEN 'missing ts' ELSE 'good' END AS outcome FROM org)
SELECT outcome, count(*) AS n FROM m GROUP BY outcome""")
def decode_events(org: DataFrame) -> DataFrame:
    """JSON messages, some of them spoilt, decoded: how many are good, and why the others are not."""
    lines = encode(org.withColumn("seq", F.col("id")))
    number = F.regexp_extract("value", '"_id":"(\\d+)"', 1).cast("long") % 10
    spoilt = F.when(number == 0, F.expr("left(value, length(value) - 5)")).when(number == 1, F.regexp_replace("value", '"event":"[a-z]+",', "")).when(number == 2, F.regexp_replace("value", '"eventTime":"[^"]*"', '"eventTime":"soon"')).otherwise(F.col("value"))
    return judged(lines.select(spoilt.alias("value"))).groupBy(F.coalesce("_reason", F.lit("good")).alias("outcome")).agg(F.count("*").alias("n"))


# --- windows ----------------------------------------------------------------------------------


@query(f'SELECT w."window", species, role, count(*) AS n FROM aged JOIN {_WINDOWS} ON age_s <= s GROUP BY ALL')
def asof_window_counts(org: DataFrame) -> DataFrame:
    return windows.group_counts(windows.as_of_windows(org, DAYS, store.as_of(org)))


@query(f'SELECT w."window", event, species, count(*) AS n FROM aged JOIN {_WINDOWS} ON age_s <= s GROUP BY ALL')
def event_trends(org: DataFrame) -> DataFrame:
    return windows.event_trends(windows.as_of_windows(org, DAYS, store.as_of(org)))


@query(f'SELECT w."window", species, count(*) AS n FROM aged JOIN {_WINDOWS} ON age_s <= s GROUP BY ALL')
def species_trends(org: DataFrame) -> DataFrame:
    return windows.species_trends(windows.as_of_windows(org, DAYS, store.as_of(org)))


@query(f'SELECT w."window", count(*) AS n FROM aged JOIN {_WINDOWS} ON age_s <= s GROUP BY ALL')
def window_totals(org: DataFrame) -> DataFrame:
    return windows.window_totals(windows.group_counts(windows.as_of_windows(org, DAYS, store.as_of(org))))


_LATE = "(id * 37) % 5400"


@query(f"""WITH late AS (SELECT *, {_LATE} AS s FROM org)
SELECT w."window", species, role, count(*) AS n FROM late JOIN (VALUES ('1min', 60), ('5min', 300), ('15min', 900), ('1hour', 3600)) AS w("window", most) ON s <= most GROUP BY ALL""")
def arrival_window_counts(org: DataFrame) -> DataFrame:
    """The counters that count at arrival and never forget (reference mode); events come up to 90 minutes late."""
    arrived = org.withColumn("arrival", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.expr(_LATE) * 1_000_000))
    return windows.group_counts(windows.arrival_windows(arrived, windows.COUNTER_WINDOWS))


@query("""SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS window_day, species, role, string_agg(event, ',' ORDER BY id) AS events FROM org GROUP BY ALL""")
def window_event_lists(org: DataFrame) -> DataFrame:
    lists = windows.event_lists(org.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return lists.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_day"), "species", "role", F.array_join("events", ",").alias("events"))


@query(f"SELECT DISTINCT species FROM aged WHERE age_s <= {DAY}")
def distinct_species(org: DataFrame) -> DataFrame:
    return windows.distinct_species(store.recent(org, DAY, store.as_of(org)))


@query("""SELECT strftime(time_bucket(INTERVAL 1 day, ts) - to_days(CAST(k AS INT)), '%Y-%m-%d') AS window_day, species, role, count(*) AS n FROM org, range(3) AS r(k) GROUP BY ALL""")
def hopping_window_counts(org: DataFrame) -> DataFrame:
    """The stream's hopping windows, of three days every day, over the whole table."""
    counted = streams.window_counts(org.withColumn("ts", F.col("ts").cast("timestamp")), "3 days", "1 day")
    return counted.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_day"), "species", "role", "n")


@query("SELECT species, role, count(*) AS n FROM org GROUP BY ALL")
def running_counts(org: DataFrame) -> DataFrame:
    """The stream's counts over all so far, of the whole table."""
    return streams.running_counts(org)


# --- counts and score -------------------------------------------------------------------------


@query("""SELECT item, count(*) AS n FROM (SELECT 'species:' || species AS item FROM org UNION ALL SELECT 'role:' || role FROM org UNION ALL SELECT 'event:' || event FROM org) GROUP BY item""")
def mapreduce_counts(org: DataFrame) -> DataFrame:
    return counts.map_reduce(org)


@query("""SELECT item, count(*) AS n FROM (SELECT 'species:' || species AS item FROM org UNION ALL SELECT 'role:' || role FROM org UNION ALL SELECT 'event:' || event FROM org) GROUP BY item""")
def merged_counts(org: DataFrame) -> DataFrame:
    """Counts of three parts of the table, added up."""
    return counts.merge_counts(*(counts.map_reduce(org.filter(F.col("id") % 3 == k)) for k in range(3)))


_SCORE = """m AS (SELECT species, avg(abs(ecological_impact)) AS a, avg(population_density) AS d FROM {0} GROUP BY species),
s AS (SELECT species, a, d, a / 50 * (1000.0 / d) AS score FROM m)
SELECT species, round(a, 8) AS avg_impact, round(d, 8) AS avg_density, round(score, 8) AS score, round(score / sum(score) OVER (), 8) AS share FROM s"""


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("species", *(F.round(c, 8).alias(c) for c in ("avg_impact", "avg_density", "score", "share")))


@query("WITH " + _SCORE.format("org"))
def species_score(org: DataFrame) -> DataFrame:
    return _rounded(counts.species_score(org))


@query("WITH ten AS (SELECT * FROM org ORDER BY id LIMIT 10), " + _SCORE.format("ten"))
def species_score_first10(org: DataFrame) -> DataFrame:
    """As the interactive query had it: the first ten stored rows only (reference mode)."""
    return _rounded(counts.species_score(org, limit=10))


# --- sketches ---------------------------------------------------------------------------------

_HLL = """WITH h AS (SELECT sha256(CAST({0} AS VARCHAR)) AS h FROM org),
r AS (SELECT substr(h, 1, 3) AS reg, regexp_replace(substr(h, 4), '^0+', '') AS rest FROM h),
g AS (SELECT reg, max(4 * (61 - length(rest)) + CASE WHEN substr(rest, 1, 1) = '1' THEN 3 WHEN substr(rest, 1, 1) IN ('2', '3') THEN 2 WHEN substr(rest, 1, 1) IN ('4', '5', '6', '7') THEN 1 ELSE 0 END + 1) AS rk FROM r GROUP BY reg),
e AS (SELECT 4096 - count(*) AS v, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (sum(power(2.0, -rk)) + 4096 - count(*)) AS e FROM g)
SELECT CAST(round(CASE WHEN e <= 2.5 * 4096 AND v > 0 THEN 4096 * ln(4096.0 / v) WHEN e > 4294967296.0 / 30 THEN -4294967296.0 * ln(1 - e / 4294967296.0) ELSE e END) AS BIGINT) AS estimate FROM e"""


@query(_HLL.format("user_id"))
def hll_user(org: DataFrame) -> DataFrame:
    return sketches.hll_estimate(sketches.hll_registers(org, F.col("user_id")))


@query(_HLL.format("id"))
def hll_event(org: DataFrame) -> DataFrame:
    return sketches.hll_estimate(sketches.hll_registers(org, F.col("id")))


@query(_HLL.format("species"))
def hll_species(org: DataFrame) -> DataFrame:
    return sketches.hll_estimate(sketches.hll_registers(org, F.col("species")))


_BLOOM = f"""WITH keys AS (SELECT DISTINCT species || '_' || role || '_' || event AS key FROM aged WHERE age_s <= {DAY}),
size AS (SELECT CAST(floor(-count(*) * ln(0.03) / power(ln(2), 2)) AS BIGINT) AS bits, count(*) AS n FROM keys),
par AS (SELECT bits, CAST(floor(bits / n * ln(2)) AS BIGINT) AS k FROM size),
fn AS (SELECT CAST(unnest(range(k)) AS BIGINT) AS i, bits FROM par),
bits AS (SELECT DISTINCT CAST('0x' || substr(sha256(i || ':' || key), 1, 8) AS BIGINT) % bits AS bit FROM keys, fn)"""


def _bloom_keys(org: DataFrame) -> tuple[DataFrame, int, int]:
    keys = store.recent(org, DAY, store.as_of(org)).select(sketches.key_of("species", "role", "event").alias("key")).distinct()
    return (keys, *sketches.bloom_size(keys.count()))


@query(_BLOOM + " SELECT bit FROM bits")
def bloom_bits(org: DataFrame) -> DataFrame:
    keys, bits, hashes = _bloom_keys(org)
    return sketches.bloom_build(keys, "key", bits, hashes)


@query(_BLOOM + """, probes AS (SELECT DISTINCT species || '_' || role || '_' || event AS key FROM org UNION SELECT species || '_' || role || '_molt' FROM org)
SELECT key, bool_and(bits.bit IS NOT NULL) AS maybe FROM probes CROSS JOIN fn LEFT JOIN bits ON bits.bit = CAST('0x' || substr(sha256(i || ':' || key), 1, 8) AS BIGINT) % fn.bits GROUP BY key""")
def bloom_probe(org: DataFrame) -> DataFrame:
    """Every combination ever seen, and as many never seen, against the last day's filter."""
    keys, bits, hashes = _bloom_keys(org)
    seen = org.select("species", "role", "event").distinct()
    probes = seen.select(sketches.key_of("species", "role", "event").alias("key")).union(seen.select(F.concat(sketches.key_of("species", "role"), F.lit("_molt"))))
    return sketches.bloom_probe(probes, "key", sketches.bloom_build(keys, "key", bits, hashes), bits, hashes)


_DAYKEY = "user_id || '_' || strftime(ts, '%Y-%m-%d')"
_SIGNED = f"""WITH k AS (SELECT DISTINCT event, {_DAYKEY} AS key FROM org), sig AS (SELECT event, i, min(substr(sha256(i || ':' || key), 1, 8)) AS min_hash FROM k, range(128) AS t(i) GROUP BY event, i)"""


def _day_sets(org: DataFrame) -> DataFrame:
    return org.select("event", F.concat_ws("_", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("key"))


@query(_SIGNED + " SELECT event, CAST(i AS INT) AS i, min_hash FROM sig")
def minhash_signatures(org: DataFrame) -> DataFrame:
    """Signatures of each event type's set of (user, day)."""
    return sketches.minhash(_day_sets(org), ["event"], "key")


@query(_SIGNED + " SELECT a.event AS event_a, b.event AS event_b, count(*) / 128.0 AS jaccard FROM sig a JOIN sig b ON a.i = b.i AND a.min_hash = b.min_hash AND a.event < b.event GROUP BY ALL")
def minhash_jaccard(org: DataFrame) -> DataFrame:
    return sketches.pairwise_jaccard(sketches.minhash(_day_sets(org), ["event"], "key"), "event")


@query("""WITH k AS (SELECT species || '_' || role || '_' || age AS key, min(id) AS first FROM org GROUP BY 1),
m AS (SELECT i, arg_min(key, (substr(sha256(i || ':' || key), 1, 8), first)) AS key, arg_min(first, (substr(sha256(i || ':' || key), 1, 8), first)) AS first FROM k, range(128) AS t(i) GROUP BY i)
SELECT CAST(i AS INT) AS i, key, first FROM m ORDER BY substr(sha256(i || ':sample'), 1, 8), i LIMIT 10""")
def minhash_sample(org: DataFrame) -> DataFrame:
    return sketches.representatives(org.withColumn("key", sketches.key_of("species", "role", "age")), "key", "id", 10)


@query(f"""WITH w AS (SELECT DISTINCT species || '_' || role || '_0' AS key FROM aged WHERE age_s <= {DAY}),
sig AS (SELECT i, min(substr(sha256(i || ':' || key), 1, 8)) AS m FROM w, range(128) AS t(i) GROUP BY i),
asked AS (SELECT DISTINCT species || '_' || role || '_0' AS key FROM org UNION SELECT DISTINCT species || '_drone_0' FROM org),
s AS (SELECT key, count(*) FILTER (WHERE substr(sha256(i || ':' || key), 1, 8) = m) / 128.0 AS similarity FROM asked, sig GROUP BY key)
SELECT key, similarity, CASE WHEN similarity >= 0.5 THEN 'redundant' ELSE 'new' END AS label FROM s""")
def minhash_redundancy(org: DataFrame) -> DataFrame:
    """Whether a combination is redundant against the last day, ages counted as 0 (reference mode)."""
    recent = store.recent(org, DAY, store.as_of(org)).select(F.concat(sketches.key_of("species", "role"), F.lit("_0")).alias("key"))
    asked = org.select("species", "role").distinct()
    keys = asked.select(F.concat(sketches.key_of("species", "role"), F.lit("_0")).alias("key")).union(asked.select(F.concat("species", F.lit("_drone_0"))))
    return sketches.redundancy(recent, keys, "key")


@query(f"""WITH l AS (SELECT species, role, id, CAST(event = '{EVENT}' AS INT) AS bit, row_number() OVER (PARTITION BY species, role ORDER BY id) AS r, count(*) OVER (PARTITION BY species, role) AS c FROM aged WHERE age_s <= {5 * DAY}),
g AS (SELECT min(id) AS first, sum(bit) AS every, sum(CASE WHEN c - r <= 300 THEN bit ELSE 0 END) AS late FROM l GROUP BY species, role),
o AS (SELECT CASE WHEN coalesce(sum(late) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN every ELSE late END AS kept FROM g)
SELECT CAST(greatest(coalesce(sum(kept), 0) - 1, 0) AS BIGINT) AS estimate FROM o""")
def dgim_reference(org: DataFrame) -> DataFrame:
    """The replayed counter over five days' lists (reference mode)."""
    rows = store.recent(org, 5 * DAY, store.as_of(org)).withColumn("bit", sketches.bit_of(EVENT))
    return sketches.dgim_replay(rows, "bit")


@query(f"""WITH o AS (SELECT species, role, ts, age_s, row_number() OVER (PARTITION BY species, role ORDER BY ts, id) AS r FROM aged WHERE event = '{EVENT}'),
t AS (SELECT species, role, count(*) AS n, count(*) FILTER (WHERE age_s <= {5 * DAY}) AS ones FROM o GROUP BY ALL),
d AS (SELECT species, role, n, CAST(1 AS BIGINT) AS size, n AS rest, CAST(0 AS BIGINT) AS newer, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS digit FROM t
 UNION ALL SELECT species, role, n, size * 2, (rest - digit) // 2, newer + digit * size, CASE WHEN ((rest - digit) // 2) % 2 = 0 THEN 2 ELSE 1 END FROM d WHERE (rest - digit) // 2 > 0),
b AS (SELECT species, role, size, n - newer AS r FROM d UNION ALL SELECT species, role, size, n - newer - size FROM d WHERE digit = 2),
l AS (SELECT species, role, sum(size) AS total, arg_min(size, r) AS oldest FROM b JOIN o USING (species, role, r) WHERE age_s <= {5 * DAY} GROUP BY ALL)
SELECT species, role, ones, CAST(coalesce(floor(total - oldest / 2), 0) AS BIGINT) AS estimate FROM t LEFT JOIN l USING (species, role)""")
def dgim_standard(org: DataFrame) -> DataFrame:
    """The published counter for each species and role, a window of five days in all of the history."""
    return sketches.dgim_estimate(org.withColumn("bit", sketches.bit_of(EVENT)), "bit", 5 * DAY, store.as_of(org))


# --- graph ------------------------------------------------------------------------------------

_PLACES = "v AS (SELECT habitat, arg_min(latitude, id) AS la, arg_min(longitude, id) AS lo FROM org GROUP BY habitat)"
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * power(sin(radians(b.lo - a.lo) / 2), 2))))"


@query(f"WITH {_PLACES} SELECT a.habitat AS h1, b.habitat AS h2, round({_KM}, 6) AS km FROM v a JOIN v b ON a.habitat < b.habitat WHERE {_KM} <= {graph.THRESHOLD_KM}")
def habitat_edges(org: DataFrame) -> DataFrame:
    return graph.edges(graph.vertices(org)).select("h1", "h2", F.round("km", 6).alias("km"))


def _starts(org: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, sorted(HABITATS)))
    return org.sparkSession.range(WALKS).select(F.col("id").alias("walk"), F.element_at(names, (F.col("id") % len(HABITATS) + 1).cast("int")).alias("habitat"))


@query(f"""WITH {_PLACES}, e AS (SELECT a.habitat AS h1, b.habitat AS h2 FROM v a JOIN v b ON a.habitat < b.habitat WHERE {_KM} <= 100),
nb AS (SELECT h, n, row_number() OVER (PARTITION BY h ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY h) AS d FROM (SELECT h1 AS h, h2 AS n FROM e UNION ALL SELECT h2, h1 FROM e)),
walk AS (SELECT CAST(w AS BIGINT) AS w, 0 AS step, list_sort({sorted(HABITATS)!r})[w % 4 + 1] AS h FROM range({WALKS}) AS t(w)
 UNION ALL SELECT walk.w, step + 1, nb.n FROM walk JOIN nb ON nb.h = walk.h AND nb.k = CAST('0x' || substr(sha256(walk.w || ':' || (step + 1)), 1, 8) AS BIGINT) % nb.d WHERE step < {STEPS})
SELECT h AS habitat, count(*) AS visits, round(count(*) * 100.0 / (SELECT count(*) FROM walk), 8) AS percent FROM walk GROUP BY h""")
def walk_frequency(org: DataFrame) -> DataFrame:
    """Visits of 128 walks of up to five steps over edges of up to 100 km."""
    paths = graph.walks(_starts(org), graph.edges(graph.vertices(org), 100.0), STEPS)
    return graph.visit_shares(paths).select("habitat", "visits", F.round("percent", 8).alias("percent"))


@query(f"""WITH {_PLACES}, e AS (SELECT a.habitat AS h1, b.habitat AS h2 FROM v a JOIN v b ON a.habitat < b.habitat WHERE {_KM} <= 100),
nb AS (SELECT h, n, row_number() OVER (PARTITION BY h ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY h) AS d FROM (SELECT h1 AS h, h2 AS n FROM e UNION ALL SELECT h2, h1 FROM e)),
walk AS (SELECT CAST(w AS BIGINT) AS w, 0 AS step, list_sort({sorted(HABITATS)!r})[w % 4 + 1] AS h FROM range({WALKS}) AS t(w)
 UNION ALL SELECT walk.w, step + 1, nb.n FROM walk JOIN nb ON nb.h = walk.h AND nb.k = CAST('0x' || substr(sha256(walk.w || ':' || (step + 1)), 1, 8) AS BIGINT) % nb.d WHERE step < {STEPS}),
c AS (SELECT h, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM walk), 2) AS p FROM walk GROUP BY h)
SELECT CAST(row_number() OVER (ORDER BY n DESC, h) AS INT) AS position, printf('%s: %d (%.2f%%)', h, n, p) AS line FROM c""")
def walk_ranking(org: DataFrame) -> DataFrame:
    """The same, from the most visited habitat on, as lines to show."""
    return graph.described(graph.visit_shares(graph.walks(_starts(org), graph.edges(graph.vertices(org), 100.0), STEPS)))


# --- Markov -----------------------------------------------------------------------------------

_CHAIN = """p AS (SELECT event, lead(event) OVER (ORDER BY ts, event) AS nxt FROM org),
c AS (SELECT event AS f, nxt AS t, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL), ch AS (SELECT f, t, n, n / sum(n) OVER (PARTITION BY f) AS p FROM c)"""


@query(f'WITH {_CHAIN} SELECT f AS "from", t AS "to", n, round(p, 10) AS p FROM ch')
def transitions(org: DataFrame) -> DataFrame:
    return markov.transitions(org).withColumn("p", F.round("p", 10))


@query(f'WITH {_CHAIN}, s AS (SELECT f AS s FROM ch UNION SELECT t FROM ch) SELECT a.s AS "from", b.s AS "to", coalesce(round(p, 10), 0) AS p FROM s a CROSS JOIN s b LEFT JOIN ch ON ch.f = a.s AND ch.t = b.s')
def transition_matrix(org: DataFrame) -> DataFrame:
    return markov.matrix(org, markov.transitions(org)).withColumn("p", F.round("p", 10))


@query("""WITH p AS (SELECT user_id, event, lead(event) OVER (PARTITION BY user_id ORDER BY ts, event) AS nxt FROM org),
c AS (SELECT user_id, event AS f, nxt AS t, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL)
SELECT user_id, f AS "from", t AS "to", n, round(n / sum(n) OVER (PARTITION BY user_id, f), 10) AS p FROM c""")
def user_transitions(org: DataFrame) -> DataFrame:
    """A chain for each user (an extension)."""
    return markov.keyed_transitions(org, ["user_id"]).withColumn("p", F.round("p", 10))


@query(f"""WITH {_CHAIN}, k AS (SELECT f, t FROM ch WHERE p > 0.2),
reach AS (SELECT f AS a, t AS b, 1 AS d FROM k UNION SELECT reach.a, k.t, d + 1 FROM reach JOIN k ON k.f = reach.b WHERE d < 5)
SELECT DISTINCT a AS state FROM reach WHERE a = b""")
def recurrent_states(org: DataFrame) -> DataFrame:
    """States on a cycle of transitions with p > 0.2 (reference mode)."""
    chain = markov.transitions(org)
    states = org.filter("ts is not null and event is not null").select("event").distinct().count()
    return markov.on_cycle(chain.filter("p > 0.2"), states).distinct()


_CLASSES = f"""{_CHAIN}, s AS (SELECT f AS s FROM ch UNION SELECT t FROM ch), k AS (SELECT f, t FROM ch WHERE p > 0.2), bound AS (SELECT 3 * count(*) AS most FROM s),
paths AS (SELECT f AS a, t AS b, 1 AS d FROM k UNION SELECT paths.a, k.t, d + 1 FROM paths JOIN k ON k.f = paths.b, bound WHERE d < most),
pair AS (SELECT DISTINCT a, b FROM paths),
class AS (SELECT s, least(s, coalesce((SELECT min(x.b) FROM pair x JOIN pair y ON y.a = x.b AND y.b = x.a WHERE x.a = s.s), s)) AS class FROM s)"""


@query(f"""WITH {_CLASSES},
open AS (SELECT DISTINCT c.class FROM k JOIN class c ON c.s = k.f JOIN class o ON o.s = k.t WHERE o.class <> c.class),
cyclic AS (SELECT a AS s, list_reduce(list(DISTINCT d), lambda x, y: gcd(x, y)) AS period FROM paths WHERE a = b GROUP BY a)
SELECT class.s AS state, class.class, cyclic.s IS NOT NULL AND open.class IS NULL AS recurrent, CAST(coalesce(period, 1) AS INT) AS period, coalesce(period, 1) = 1 AS aperiodic,
 cyclic.s IS NOT NULL AND open.class IS NULL AND coalesce(period, 1) = 1 AS ergodic
FROM class LEFT JOIN open ON open.class = class.class LEFT JOIN cyclic ON cyclic.s = class.s""")
def state_classes(org: DataFrame) -> DataFrame:
    """Classes are named by their least state."""
    found = markov.classify(markov.transitions(org), 0.2)
    least = found.groupBy("component").agg(F.min("state").alias("class"))
    return found.join(least, "component").select("state", "class", "recurrent", "period", "aperiodic", "ergodic")


@query()
def state_classes_reference(org: DataFrame) -> DataFrame:
    return markov.classify(markov.transitions(org), 0.2, mode="reference")


@query()
def engine_stats(org: DataFrame) -> DataFrame:
    """The same statistics, asked of the engine by name."""
    return Engine(org).run("stats")


ORACLE_SQL["engine_stats"] = ORACLE_SQL["stats"]
