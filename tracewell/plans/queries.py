"""The log operators on generic tables: an event's user is an entity, its type a layer or message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import clocks, identity, pairing, procedures, rules, search, sequences, summary, timeline
from ..sources import captures, consoles, logs, runs

HOUR = 3_600_000_000
SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("t", fn.micros("ts"))


E = "(select *, epoch_us(ts) t from events)"
LEVEL = "case when event_type='error' then 'E' when value>50 then 'W' else 'I' end"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as the lines of a radio-node log."""
    level = F.expr(LEVEL)
    text = F.concat(
        F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(" ["), F.rpad(F.upper("event_type"), 8, " "), F.lit("] ["), level, F.lit("] ue="), F.col("user_id").cast("string"),
        F.lit(" c-rnti="), fn.hex_display(F.col("user_id") + 17921), F.lit(" amt="), F.round(F.col("value") * 100).cast("bigint").cast("string"),
    )
    return read(spark, sf_dir, "events").select("event_id", text.alias("value"))


@query(f"select event_id, upper(event_type) layer, {LEVEL} as level, user_id ue, user_id+17921 rnti, epoch_us(ts) t from events")
def q01_parse_log_lines(spark, sf_dir):
    parsed = logs.parse_radio(log_lines(spark, sf_dir))
    return parsed.select("event_id", "layer", "level", F.col("ue").cast("bigint").alias("ue"), fn.hex_id(F.col("rnti")).alias("rnti"), fn.micros(F.to_timestamp_ntz("ts")).alias("t"))


@query(f"select upper(event_type) layer, count(*) n, count(*) filter ({LEVEL}='W') n_warn, count(distinct user_id) n_ue, min(epoch_us(ts)) first_t, max(epoch_us(ts)) last_t from events group by 1")
def q02_layer_summary(spark, sf_dir):
    parsed = q01_parse_log_lines(spark, sf_dir)
    return parsed.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "W").alias("n_warn"), F.count_distinct("ue").alias("n_ue"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(
    f"select event_id from events where upper(event_type)='CLICK' and {LEVEL} in ('I','W') and strftime(ts,'%H:%M') between '06:30' and '18:00' and regexp_matches(cast(cast(round(value*100) as bigint) as varchar), '7$') and user_id=46"
)
def q03_search(spark, sf_dir):
    frame = logs.parse_radio(log_lines(spark, sf_dir)).withColumn("text", F.col("value"))
    return frame.where(search.matches(layer="click", level="I|W", tokens={"ue": 46}, pattern=r"AMT=\d*7$", after="06:30", before="18:00")).select("event_id")


@query("select count(*) filter (strftime(ts,'%H:%M:%S')<='12:30:15') by_prefix, count(*) filter (strftime(ts,'%H:%M:%S.%f')<='12:30:15') by_string from events")
def q04_time_bounds(spark, sf_dir):
    frame = logs.parse_radio(log_lines(spark, sf_dir)).withColumn("text", F.col("value"))
    return frame.agg(F.count_if(search.matches(before="12:30:15")).alias("by_prefix"), F.count_if(search.matches(before="12:30:15", prefix=False)).alias("by_string"))


COUNTERS = {"views": "event_type='view'", "clicks": "event_type='click'", "purchases": "event_type='purchase'", "errors": "event_type='error'", "signups": "event_type='signup'", "large": "value>100", "small": "value<1", "late": "hour(ts)>=22", "big_clicks": "event_type='click' and value>50", "odd_users": "user_id%2=1"}


@query("select cast(ts as date) \"day\", " + ", ".join(f"count(*) filter ({t}) {n}" for n, t in COUNTERS.items()) + " from events group by 1")
def q05_counters(spark, sf_dir):
    frame = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return timeline.counters(frame, ["day"], {n: F.expr(t) for n, t in COUNTERS.items()})


@query(f"select user_id, count(*) n, min(t) \"first\", max(t) \"last\", max(t)-min(t) duration from {E} group by 1")
def q06_spans(spark, sf_dir):
    return timeline.span(events(spark, sf_dir), ["user_id"], "t")


@query(f"select user_id, event_id, event_type, before from (select *, lag(event_type) over w before, row_number() over w n from {E} window w as (partition by user_id order by t, event_id)) where n=1 or before is distinct from event_type")
def q07_state_changes(spark, sf_dir):
    return timeline.changes(events(spark, sf_dir), ["user_id"], "event_type", ["t", "event_id"]).select("user_id", "event_id", "event_type", "before")


@query("select final, count(*) n, min(seen) seen from (select user_id, arg_max(event_type, event_id) final, min(event_id) seen from events group by 1) group by 1")
def q08_final_states(spark, sf_dir):
    return timeline.breakdown(timeline.final_states(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id"))


@query("select distinct user_id from events where user_id not in (select user_id from events where event_type='purchase' and value>60)")
def q09_never_reached(spark, sf_dir):
    return timeline.never(read(spark, sf_dir, "events"), ["user_id"], F.expr("event_type='purchase' and value>60"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus='F' and o_custkey is not null)")
def q10_created_not_done(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_orderstatus='F'"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey")


@query("select event_type, event_id, nth, more from (select *, row_number() over (partition by event_type order by event_id) nth, greatest(count(*) over (partition by event_type)-20,0) more from events) where nth<=20")
def q11_first_events(spark, sf_dir):
    return search.first_events(read(spark, sf_dir, "events"), ["event_type"], ["event_id"]).select("event_type", "event_id", F.col("nth").cast("bigint").alias("nth"), "more")


@query("select \"day\", k, n, seen, nth from (select *, row_number() over (partition by \"day\" order by n desc, seen) nth from (select cast(ts as date) \"day\", cast(json_extract(props,'$.k') as bigint) k, count(*) n, min(event_id) seen from events group by 1,2)) where nth<=5")
def q12_top_labels(spark, sf_dir):
    frame = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id")
    return timeline.common(frame, ["day"], "k", "event_id", 5).withColumn("nth", F.col("nth").cast("bigint"))


@query("select event_type, array_to_string(list_sort(list(distinct user_id)), ',') ids from events group by 1")
def q13_distinct_ids(spark, sf_dir):
    return timeline.distinct_ids(read(spark, sf_dir, "events"), "event_type", "user_id").select("event_type", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"select count(*) filter (t>=1704412800000000 and t<1704499200000000) half_open, count(*) filter (t between 1704456000000000-{HOUR} and 1704456000000000+{HOUR}) centred from {E}")
def q14_windows(spark, sf_dir):
    centre = 1704456000000000
    return events(spark, sf_dir).agg(F.count_if(F.expr("t>=1704412800000000 and t<1704499200000000")).alias("half_open"), F.count_if(F.col("t").between(centre - HOUR, centre + HOUR)).alias("centred"))


TIMELINE = "select epoch_us(ts) t, 'event' src, 0 \"rank\", event_id id from events union all select epoch_us(o_orderdate), 'order', 1, o_orderkey from orders union all select epoch_us(l_shipdate), 'shipment', 2, l_orderkey*10+l_linenumber from lineitem"


def merged(spark, sf_dir, low=None, high=None):
    parts = {
        "event": events(spark, sf_dir).select("t", F.col("event_id").alias("id")),
        "order": read(spark, sf_dir, "orders").select(fn.micros("o_orderdate").alias("t"), F.col("o_orderkey").alias("id")),
        "shipment": read(spark, sf_dir, "lineitem").select(fn.micros("l_shipdate").alias("t"), F.expr("l_orderkey*10+l_linenumber").alias("id")),
    }
    return timeline.merged(parts, low, high)


@query(f"select * from ({TIMELINE}) where t>=789000000000000 and t<799000000000000")
def q16_timeline(spark, sf_dir):
    return merged(spark, sf_dir, 789000000000000, 799000000000000).orderBy("t", "rank", "id")


@query(f"select src, \"first\", \"last\", (select max(\"first\")>min(\"last\") from s) disjoint from s".replace("select src", f"with u as ({TIMELINE}), s as (select src, min(t) \"first\", max(t) \"last\" from u group by 1) select src", 1))
def q17_overlap(spark, sf_dir):
    return timeline.disjoint(merged(spark, sf_dir))


PAIRS = f"""with recursive ev as (select user_id, t, event_id id, event_type='click' b, row_number() over (partition by user_id, event_type order by t, event_id) n from {E} where event_type in ('view','click')),
a as (select * from ev where not b), b as (select * from ev where b), u as (select distinct user_id from ev),
w(user_id, i, j, a_id, b_id, a_t, b_t) as (
  select user_id, cast(1 as bigint), cast(1 as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint) from u
  union all
  select w.user_id, case when b.id is null or a.t<=b.t+{6 * HOUR} then w.i+(a.id is not null)::bigint else w.i end, case when a.id is null or b.t<=a.t+{6 * HOUR} then w.j+(b.id is not null)::bigint else w.j end,
    case when a.id is not null and (b.id is null or a.t<=b.t+{6 * HOUR}) then a.id end, case when b.id is not null and (a.id is null or b.t<=a.t+{6 * HOUR}) then b.id end,
    case when a.id is not null and (b.id is null or a.t<=b.t+{6 * HOUR}) then a.t end, case when b.id is not null and (a.id is null or b.t<=a.t+{6 * HOUR}) then b.t end
  from w left join a on a.user_id=w.user_id and a.n=w.i left join b on b.user_id=w.user_id and b.n=w.j where a.id is not null or b.id is not null)
"""
PAIRED = "p as (select user_id, a_id, b_id, a_t, b_t from w where a_id is not null or b_id is not null)"


def paired(spark, sf_dir):
    frame = events(spark, sf_dir).select("user_id", "t", F.col("event_id").alias("id"), "event_type")
    return pairing.pair(frame.where("event_type='view'"), frame.where("event_type='click'"), ["user_id"], 6 * HOUR)


@query(PAIRS + "select user_id, a_id, b_id, a_t, b_t from w where a_id is not null or b_id is not null")
def q18_tolerance_pairs(spark, sf_dir):
    return paired(spark, sf_dir)


@query(
    PAIRS + f", {PAIRED}, f as (select p.*, coalesce(e.value>50,false) bad, coalesce(e.value>80,false) silent, exists(select 1 from a where a.user_id=p.user_id and abs(a.t-p.b_t)<={6 * HOUR}) close, p.user_id%2=0 up from p left join events e on e.event_id=p.a_id) "
    "select status, count(*) n from (select case when up then case when a_id is not null and b_id is not null then case when bad then 'rx-ko/ue-tx' else 'rx-ok' end when a_id is not null then case when not bad then 'ue-missing' when silent then 'rx-ko/ue-silent' else 'rx-ko/ue-missing' end "
    "when close then 'ue-extra-tx/contention' else 'gnb-missing' end else case when a_id is not null and b_id is not null then 'tx-rx-ok' when a_id is not null then 'ue-missing-rx' else 'gnb-missing-tx' end end status from f) group by 1"
)
def q19_pair_outcomes(spark, sf_dir):
    pairs, frame = paired(spark, sf_dir), events(spark, sf_dir)
    views = frame.where("event_type='view'")
    lone = pairs.where("a_id is null").select("user_id", F.col("b_t").alias("t"), F.col("b_id").alias("id"))
    close = pairing.near(lone, views.select("user_id", "t"), ["user_id"], 6 * HOUR).select(F.col("id").alias("b_id"), "near")
    facts = pairs.join(views.select(F.col("event_id").alias("a_id"), (F.col("value") > 50).alias("bad"), (F.col("value") > 80).alias("silent")), "a_id", "left").join(close, "b_id", "left")
    no = F.lit(False)
    status = pairing.classify(F.col("user_id") % 2 == 0, F.col("a_id").isNotNull(), F.col("b_id").isNotNull(), F.coalesce("bad", no), F.coalesce("silent", no), F.coalesce("near", no))
    return facts.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(PAIRS + f", {PAIRED} select user_id, b_t t, b_id id, exists(select 1 from a where a.user_id=p.user_id and abs(a.t-p.b_t)<={6 * HOUR}) near from p where a_id is null")
def q20_contention(spark, sf_dir):
    lone = paired(spark, sf_dir).where("a_id is null").select("user_id", F.col("b_t").alias("t"), F.col("b_id").alias("id"))
    return pairing.near(lone, events(spark, sf_dir).where("event_type='view'").select("user_id", "t"), ["user_id"], 6 * HOUR)


@query(PAIRS + f", {PAIRED} select user_id, arg_min(a_id, a_t) a_id, arg_min(b_id, a_t) b_id, min(a_t) t from p where a_id is not null and b_id is not null group by 1")
def q21_earliest_common(spark, sf_dir):
    return paired(spark, sf_dir).where("a_id is not null and b_id is not null").groupBy("user_id").agg(F.min_by("a_id", "a_t").alias("a_id"), F.min_by("b_id", "a_t").alias("b_id"), F.min("a_t").alias("t"))


SECOND = "case when event_type in ('click','purchase') then cast(json_extract(props,'$.k') as bigint) end"


@query(f"select user_id, min(event_id) \"first\", arg_min({SECOND}, event_id) filter ({SECOND} is not null) k, count(*) n from events group by 1")
def q23_first_sightings(spark, sf_dir):
    frame = read(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_type").isin("click", "purchase"), F.get_json_object("props", "$.k").cast("bigint")))
    return identity.first_sightings(frame, "user_id", "k", "event_id")


@query("select user_id, epoch, count(*) n, min(event_id) \"first\" from (select *, sum((event_type='error')::bigint) over (partition by user_id order by event_id) - (event_type='error')::bigint epoch from events) group by 1,2")
def q24_epochs(spark, sf_dir):
    frame = timeline.epochs(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error", ["event_id"])
    return frame.groupBy("user_id", "epoch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def identified(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("run"), "event_id", "event_type", F.when(F.col("event_type") != "view", F.col("user_id")).alias("central"), k.alias("distributed"), F.when(F.col("event_type") == "click", k + 1000).alias("radio")
    )


IDENTIFIED = (
    "with recursive ids as (select *, case when event_type='click' then distributed + 1000 end radio from (select strftime(ts, '%Y-%m-%d') run, event_id, event_type, case when event_type<>'view' then user_id end central, "
    "cast(json_extract(props,'$.k') as bigint) distributed from events)), named as (select * from ids where central is not null or distributed is not null or radio is not null), "
)


@query(
    IDENTIFIED + "pointed as (select *, case when central is not null and event_id > min(event_id) over (partition by run, central) then min(event_id) over (partition by run, central) "
    "when distributed is not null then lag(event_id) over (partition by run, distributed order by event_id) end up from named), "
    "reached as (select run, event_id, event_id root from pointed where up is null union all select p.run, p.event_id, root from pointed p join reached r on p.run=r.run and p.up=r.event_id) "
    "select run, min(event_id) \"first\", arg_min(central, event_id) filter (central is not null) central_id, coalesce(string_agg(distinct distributed::varchar, ',' order by distributed::varchar), '') distributed_ids, "
    "coalesce(string_agg(distinct radio::varchar, ',' order by radio::varchar), '') radio_ids from reached join pointed using (run, event_id) group by run, root"
)
def q25_ordered_clusters(spark, sf_dir):
    found = identity.ordered_clusters(identified(spark, sf_dir), "run", "event_id", "central", "distributed", "radio")
    text = [F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",").alias(c) for c in ("distributed_ids", "radio_ids")]
    return found.select("run", "first", "central_id", *text)


@query(
    IDENTIFIED + "numbered as (select *, row_number() over (partition by run order by event_id) i from named), "
    "steps as (select distinct run, 0::bigint i, 0::bigint opened, []::struct(r bigint, c bigint, d bigint, x bigint)[] active, null::bigint \"at\", null::struct(r bigint, c bigint, d bigint, x bigint) told, null::varchar event from named "
    "union all select run, i, case when opens then opened + 1 else opened end, case when releases then list_filter(active, lambda a: a.r is distinct from hit.r) when opens then list_append(active, held) else list_transform(active, lambda a: case when a.r = hit.r then held else a end) end, "
    "event_id, case when releases then hit when held is distinct from hit then held end, case when not releases then 'changed' when hit is not null then 'released' end from "
    "(select *, not releases and (hit is null or event_type='signup') opens, case when not releases and (hit is null or event_type='signup') then {'r': opened, 'c': central, 'd': distributed, 'x': radio} "
    "else {'r': hit.r, 'c': coalesce(central, hit.c), 'd': coalesce(distributed, hit.d), 'x': coalesce(radio, hit.x)} end held from "
    "(select e.*, s.opened, s.active, event_type='error' releases, list_filter(s.active, lambda a: coalesce(a.c=e.central, false) or coalesce(a.d=e.distributed, false) or coalesce(a.x=e.radio, false))[1] hit "
    "from steps s join numbered e on e.run=s.run and e.i=s.i+1))) "
    "select run, \"at\", told.r record, event, told.c central, told.d distributed, told.x radio from steps where told is not null"
)
def q25_lifecycles(spark, sf_dir):
    return identity.lifecycles(identified(spark, sf_dir), "run", "event_id", "event_type", ["central", "distributed", "radio"], {"signup"}, {"error"})


@query("select event_id, cast(json_extract(props,'$.k') as bigint) k, coalesce(cast(json_extract(props,'$.missing') as bigint),0) missing from events")
def q26_json_fields(spark, sf_dir):
    parsed = F.from_json("props", "k bigint, missing bigint")
    return read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["missing"], F.lit(0)).cast("bigint").alias("missing"))


@query("select l_returnflag, sum(cast(l_quantity as bigint)) sent, sum(cast(l_quantity as bigint)) filter (l_linestatus='F') received, round(100.0*(sum(cast(l_quantity as bigint))-coalesce(sum(cast(l_quantity as bigint)) filter (l_linestatus='F'),0))/sum(cast(l_quantity as bigint)),6) loss from lineitem group by 1")
def q28_loss(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    sums = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(q).alias("sent"), F.sum(F.when(F.col("l_linestatus") == "F", q)).alias("received"))
    return sums.withColumn("loss", F.round(fn.percent_lost(F.col("sent"), F.coalesce("received", F.lit(0))), 6))


@query(
    "with m as (select user_id, count(*) filter (event_type='error') errors, count(*) filter (value>80) large, count(*) n from events group by 1) "
    "select user_id, metric, cast(v as double) as \"value\", threshold, metric || ' above limit' as message from (select user_id, 'errors' metric, errors v, 14.0::double threshold from m union all select user_id, 'large', large, 5.0::double from m union all select user_id, 'n', n, 75.0::double from m) where v>threshold"
)
def q29_rules(spark, sf_dir):
    tests = {"errors": F.expr("event_type='error'"), "large": F.expr("value>80"), "n": F.lit(True)}
    limits = [("errors", 14.0, "errors above limit"), ("large", 5.0, "large above limit"), ("n", 75.0, "n above limit")]
    return rules.fired(timeline.counters(read(spark, sf_dir, "events"), ["user_id"], tests), ["user_id"], spark.createDataFrame(limits, "metric string, threshold double, message string"))


MATCHED = (
    "with i as (select item_id issue, lower(split_part(text,'.',1)) title, lower(text) body from benchmark), p as (select failure, phrase from (select distinct doc_id failure, trim(unnest(regexp_split_to_array(lower(text),'[.!?\n]+'))) phrase from documents) where length(phrase)>=12), "
    "d as (select distinct phrase from p), h as (select phrase, issue, case when contains(title, phrase) then 1 else 2 end tier from d join i on contains(body, phrase)), m as (select failure, issue, min(tier) tier from p join h using (phrase) group by 1,2), "
    "r as (select *, row_number() over (partition by failure order by tier, issue desc) nth from m) "
)


def matched(spark, sf_dir):
    issues = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("issue"), F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("body"))
    return rules.match_issues(rules.phrases(read(spark, sf_dir, "documents"), "doc_id", "text"), issues)


@query(MATCHED + "select failure, issue, tier, nth from r where nth<=3")
def q31_match_issues(spark, sf_dir):
    return matched(spark, sf_dir).select("failure", "issue", "tier", F.col("nth").cast("bigint").alias("nth"))


@query(MATCHED + "select issue, count(*) n, string_agg(cast(failure as varchar), ',' order by cast(failure as varchar)) failures from r where nth=1 group by 1")
def q32_grouped_issues(spark, sf_dir):
    return rules.group_by_issue(matched(spark, sf_dir))


LINES = "(select conv_id, turn, i, line from (select conv_id, turn, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)),1) i from conversations) where line<>'')"
BLOCKS = f"(select conv_id, turn, block, arg_min(line,i) head, count(*) n_lines from (select *, sum(regexp_matches(line,'^[A-M]')::bigint) over (partition by conv_id, turn order by i)-1 block from {LINES}) where block>=0 group by 1,2,3)"


def conversation_blocks(spark, sf_dir):
    return logs.blocks(read(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", "^[A-M]")


@query(f"select conv_id, turn, block, head, n_lines from {BLOCKS}")
def q33_blocks(spark, sf_dir):
    return conversation_blocks(spark, sf_dir).select("conv_id", "turn", F.col("block").cast("bigint").alias("block"), "head", "n_lines")


@query(f"select conv_id, turn, block, used from (select *, sum(n_lines+1) over w used, row_number() over w n from {BLOCKS} window w as (partition by conv_id order by turn, block)) where used<=12 or n=1")
def q34_budget(spark, sf_dir):
    frame = conversation_blocks(spark, sf_dir).withColumn("cost", F.col("n_lines") + 1)
    return search.within_budget(frame, "cost", 12, ["turn", "block"], ["conv_id"]).select("conv_id", "turn", F.col("block").cast("bigint").alias("block"), "used")


@query("select user_id, event_type, arg_max(props, event_id) props from events group by 1,2")
def q35_last_wins(spark, sf_dir):
    return logs.last_values(read(spark, sf_dir, "events"), ["user_id"], "event_type", "props", "event_id")


@query("select user_id, count(*) n, min(event_id) \"start\" from (select *, sum((event_type<>'error')::bigint) over (partition by user_id order by event_id) run from events) where event_type='error' group by user_id, run")
def q36_run_lengths(spark, sf_dir):
    return timeline.run_lengths(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error", ["event_id"])


@query(
    "with e as (select user_id, event_id, event_type from events), a as (select u.user_id, min(event_id) s1 from (select distinct user_id from e) u left join e on e.user_id=u.user_id and event_type='signup' group by 1), "
    "b as (select a.user_id, s1, min(event_id) s2 from a left join e on e.user_id=a.user_id and event_type='view' and event_id>s1 group by 1,2), c as (select b.user_id, s1, s2, min(event_id) s3 from b left join e on e.user_id=b.user_id and event_type='click' and event_id>s2 group by 1,2,3), "
    "d as (select c.user_id, s1, s2, s3, min(event_id) s4 from c left join e on e.user_id=c.user_id and event_type='purchase' and event_id>s3 group by 1,2,3,4) "
    "select user_id, (s1 is not null)::int+(s2 is not null)::int+(s3 is not null)::int+(s4 is not null)::int reached, case when s4 is not null then 'purchase' when s3 is not null then 'click' when s2 is not null then 'view' when s1 is not null then 'signup' end last_step, "
    "case when s1 is null then 'signup' when s2 is null then 'view' when s3 is null then 'click' when s4 is null then 'purchase' end missing from d"
)
def q37_expected_sequence(spark, sf_dir):
    return timeline.steps(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", ["signup", "view", "click", "purchase"])


@query("select event_id, (event_id//10)%1024 frame, event_id%10 slot from events")
def q38_slots(spark, sf_dir):
    text = F.concat_ws(".", F.expr("(event_id div 10) % 1024").cast("string"), F.expr("event_id % 10").cast("string"))
    key = fn.slot_key(text)
    return read(spark, sf_dir, "events").select("event_id", key["frame"].cast("bigint").alias("frame"), key["slot"].cast("bigint").alias("slot"))


@query("select event_id from events where event_id < (select min(event_id) from events where value>120 or event_id=7000) order by event_id desc limit 200")
def q39_tail(spark, sf_dir):
    return search.tail(read(spark, sf_dir, "events"), "event_id", 200, F.expr("value>120 or event_id=7000")).select("event_id")


@query("select event_type, cast(json_extract(props,'$.k') as bigint)%10 k, count(*) n from events group by 1,2")
def q40_label_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "k")


# Events as frames of captures: the type is a message, k a procedure code or a cell, the user an entity.
K = "cast(json_extract(props,'$.k') as bigint)"


def with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


@query(f"select event_id, user_id, cast(props as varchar) props from {E} where t between 1704456000000000-{HOUR} and 1704456000000000+{HOUR}")
def q15_centred_window(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("t").between(1704456000000000 - HOUR, 1704456000000000 + HOUR)).select("event_id", "user_id", "props")


@query(
    f"with c as (select user_id, t, event_id id from {E} where event_type='click'), p as (select user_id, t, event_id id from {E} where event_type='purchase') "
    f"select c.user_id, c.t, c.id, arg_min(p.t, (p.t-c.t)*1000000+p.id) other_t, arg_min(p.id, (p.t-c.t)*1000000+p.id) other_id from c left join p on p.user_id=c.user_id and p.t between c.t and c.t+{12 * HOUR} group by 1,2,3"
)
def q22_nearest(spark, sf_dir):
    frame = events(spark, sf_dir).select("user_id", "t", F.col("event_id").alias("id"), "event_type")
    return procedures.nearest(frame.where("event_type='click'"), frame.where("event_type='purchase'"), ["user_id"], 12 * HOUR)


@query(
    "select l_returnflag, count(distinct l_orderkey) records, sum(case when l_linenumber%3=0 then 0 else cast(l_quantity as bigint) end)::bigint late_dl_harqs, max(cast(l_linenumber as double)) max_dl_brate, max(case when l_linenumber%2=0 then cast(l_linenumber as double) end) max_latency from lineitem group by 1"
)
def q27_metrics_rollup(spark, sf_dir):
    q = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("bigint"))
    cell = F.struct(
        F.struct(q.alias("late_dl_harqs"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("double")).alias("max_latency")).alias("cell_metrics"), F.array(F.struct(F.col("l_linenumber").cast("double").alias("dl_brate"))).alias("ue_list")
    )
    texts = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.collect_list(cell).alias("cells"))
    texts = texts.select("l_returnflag", F.to_json(F.array(F.struct(F.lit("now").alias("timestamp"), "cells"))).alias("text"))
    rolled = logs.metrics_rollup(logs.metrics(texts, ["l_returnflag"], "text"), ["l_returnflag"])
    return rolled.select("l_returnflag", "records", "late_dl_harqs", "max_dl_brate", "max_latency")


@query("select s_nationkey n, count(*) nodes, '10.0.0.' || s_nationkey address, min(4000+s_suppkey) port_from, max(4000+s_suppkey) port_to from supplier group by 1")
def q30_addresses(spark, sf_dir):
    node = F.concat(F.lit("'ue"), F.col("s_suppkey").cast("string"), F.lit("': NodeInfo(name='x', address='10.0.0."), F.col("s_nationkey").cast("string"), F.lit("', port="), (F.col("s_suppkey") + 4000).cast("string"), F.lit(")"))
    texts = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(node), ", ").alias("text"))
    nodes = logs.addresses(texts, ["s_nationkey"], "text")
    found = runs.with_addresses(texts.select("s_nationkey", F.lit("ue").alias("role")), nodes, ["s_nationkey"])
    return found.select(F.col("s_nationkey").alias("n"), "nodes", "address", F.col("port_from").cast("bigint").alias("port_from"), F.col("port_to").cast("bigint").alias("port_to"))


@query(f"select event_type proto, count(*) packets, min(t) \"first\", max(t) \"last\", max(t)-min(t) duration, count(*) filter (value>50) failures from {E} group by 1")
def q41_overview(spark, sf_dir):
    return procedures.overview(events(spark, sf_dir).withColumn("proto", F.col("event_type")), ["proto"], F.col("value") > 50)


@query(f"select event_type, label, count(distinct id) ids from (select event_type, 'user' label, user_id id from events union all select event_type, 'k', case when value<20 then {K} end from events) where id is not null group by 1,2")
def q42_ids_by_label(spark, sf_dir):
    frame = with_k(spark, sf_dir).select("event_type", F.col("user_id").alias("user"), F.expr("case when value<20 then k end").alias("k"))
    return procedures.ids_by_label(frame, ["event_type"], ["user", "k"])


def _codes(proto: str) -> str:
    return " ".join(f"when {c} then '{n}'" for p, c, n in captures.PROCEDURES if p == proto)


@query(f"select proc, count(*) n from (select case when code is null then '?' else coalesce(case code {_codes('ngap')} end, 'proc-' || code) end as proc from (select case when event_type<>'view' then {K} end code from events)) group by 1")
def q43_procedure_names(spark, sf_dir):
    frame = with_k(spark, sf_dir).select(F.lit("ngap").alias("proto"), F.when(F.col("event_type") != "view", F.col("k")).alias("code"))
    return captures.named(frame).groupBy(F.col("procedure").alias("proc")).agg(F.count("*").alias("n"))


@query("select user_id, count(*) filter (event_type='signup') begun, count(*) filter (event_type='error') ended, count(*) filter (event_type='signup')<>count(*) filter (event_type='error') unbalanced from events group by 1")
def q44_balance(spark, sf_dir):
    return procedures.balance(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "signup", F.col("event_type") == "error")


@query(f"select user_id, event_type, {K}%5 sn, count(*) n, min(t) \"first\", max(t) \"last\" from {E} where value>10 group by 1,2,3 having count(*)>=4")
def q45_storms(spark, sf_dir):
    frame = with_k(spark, sf_dir).withColumn("sn", F.col("k") % 5)
    return procedures.storms(frame, ["user_id", "event_type", "sn"], F.col("value") > 10, 4)


@query("select user_id, event_id from (select *, lead(event_type) over (partition by user_id order by event_id) follows from events where event_type in ('click','purchase')) where event_type='click' and follows is distinct from 'purchase'")
def q46_without_answer(spark, sf_dir):
    return procedures.without_answer(read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase").select("user_id", "event_id")


@query(
    "with a as (select o_custkey k, count(*) n from orders group by 1), b as (select c_custkey k, 10 n from customer) select k, coalesce(a.n,0)::bigint orders, coalesce(b.n,0)::bigint expected, coalesce(a.n,0)=coalesce(b.n,0) agree from a full join b using (k)"
)
def q47_reconcile(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    expected = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(10).alias("n"))
    return procedures.reconcile({"orders": orders, "expected": expected}, ["k"])


@query(f"select e.event_id, count(b.event_id) n_before, arg_max(b.event_type, b.t::hugeint*10000000+b.event_id) last_before from {E} e left join {E} b on b.user_id=e.user_id and b.t between e.t-{2 * HOUR} and e.t and (b.t<e.t or b.event_id<e.event_id) where e.event_type='error' group by 1")
def q48_before_errors(spark, sf_dir):
    return timeline.before_events(events(spark, sf_dir), ["user_id"], F.col("event_type") == "error", 2 * HOUR, "event_type", "event_id").select("event_id", "n_before", "last_before")


@query(
    "with l as (select user_id, value, event_type, sum((event_type='signup')::bigint) over (partition by user_id order by event_id) loop from events) select user_id, loop, count(*) filter (event_type='view') sent, count(*) filter (event_type='click') received, "
    "round(case when count(*) filter (event_type='view')=0 then 0 else 100.0*(count(*) filter (event_type='view')-count(*) filter (event_type='click'))/count(*) filter (event_type='view') end, 6)::double loss from l group by 1,2"
)
def q49_loss_by_loop(spark, sf_dir):
    looped = timeline.loops(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "signup", ["event_id"])
    sums = looped.groupBy("user_id", "loop").agg(F.count_if(F.col("event_type") == "view").alias("sent"), F.count_if(F.col("event_type") == "click").alias("received"))
    return sums.withColumn("loss", F.round(fn.percent_lost(F.col("sent"), F.col("received")), 6))


@query(
    f"select user_id, event_id, k, after place_after from (select *, lead(k) over w after, lead(event_type) over w then_type from (select *, {K} k from events where event_type in ('view','click')) window w as (partition by user_id order by event_id)) where event_type='view' and then_type='click' and after<>k"
)
def q50_moves(spark, sf_dir):
    return timeline.moves(with_k(spark, sf_dir), ["user_id"], F.col("event_type") == "view", F.col("event_type") == "click", "k", "event_id")


@query(
    "with r as (select l_returnflag f, l_orderkey o, l_linenumber bin, cast(l_quantity as bigint) n from lineitem), s as (select f, o*10+bin o, unnest([0,1]) bin, unnest([n, bin]) n from r) "
    "select f, bin, sum(n)::bigint total, arg_max(n, o)-arg_min(n, o) growth from s group by 1,2"
)
def q51_histogram_bins(spark, sf_dir):
    frame = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.expr("l_orderkey*10+l_linenumber").alias("o"), F.expr("array(cast(l_quantity as bigint), cast(l_linenumber as bigint))").alias("h"))
    return timeline.bins(frame, ["f"], "h", "o").select("f", F.col("bin").cast("bigint").alias("bin"), "total", "growth")


@query("select user_id, event_type, min(event_id) seen, row_number() over (partition by user_id order by min(event_id)) nth from events group by 1,2")
def q52_appearance(spark, sf_dir):
    return timeline.in_order_of_appearance(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").withColumn("nth", F.col("nth").cast("bigint"))


def radio_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of a radio-node log, a day a file."""
    user, k, level = F.col("user_id").cast("string"), F.col("k").cast("string"), F.expr(LEVEL)
    layer = F.expr("case event_type when 'view' then 'PHY' when 'click' then 'SCHED' when 'purchase' then 'CU-CP' when 'signup' then 'NGAP' else 'RRC' end")
    said = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("[   "), k, F.lit(".3] PUSCH: rnti=0x46"), F.lpad(F.col("user_id") % 100, 2, "0"), F.lit(" crc="), F.when(F.col("value") > 30, "KO").otherwise("OK"), F.lit(" sinr="), F.when(F.col("value") > 60, "infdB").otherwise("12.5dB")))
        .when(F.col("event_type") == "click", F.concat(F.lit("prach(ra-rnti=0x1 preamble="), k, F.lit(")")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("ue="), user, F.lit(" c-rnti=0x4601: UE created")))
        .when(F.col("event_type") == "signup", F.when(F.col("k") % 2 == 0, "NGSetupResponse").otherwise("NGSetupFailure"))
        .otherwise(F.lit("rrcReestablishmentRequest"))
    )
    line = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(" ["), F.rpad(layer, 8, " "), F.lit("] ["), level, F.lit("] "), said)
    return with_k(spark, sf_dir).select(F.to_date("ts").alias("day"), "event_id", line.alias("value"))


@query(
    f"select cast(ts as date) \"day\", count(*) \"lines\", count(*) filter ({LEVEL}='E') errors, count(*) filter ({LEVEL}='W') warnings, count(*) filter (event_type='click') random_accesses, count(*) filter (event_type='view' and value>30) crc_fails, count(*) filter (event_type='purchase') created, "
    f"count(*) filter (event_type='error') reestablishments, arg_max(case when {K}%2=0 then 'success' else 'failure' end, event_id) filter (event_type='signup') core_setup, count(distinct user_id) filter (event_type='purchase') n_ues from events group by 1"
)
def q53_radio_summary(spark, sf_dir):
    got = summary.radio_summary(radio_log(spark, sf_dir), ["day"], "event_id")
    return got.select("day", "lines", "errors", "warnings", "random_accesses", "crc_fails", "created", "reestablishments", "core_setup", F.size("ues").cast("bigint").alias("n_ues"))


@query(f"select event_id, {K} || '.3' slot, cast(('0x46' || lpad(cast(user_id%100 as varchar),2,'0')) as bigint) rnti, case when value>30 then 'KO' else 'OK' end crc, value>60 silent from events where event_type='view'")
def q54_radio_phy(spark, sf_dir):
    return summary.radio_phy(radio_log(spark, sf_dir), ["event_id"]).select("event_id", "slot", "rnti", "crc", "silent")


@query("select distinct user_id, e.k, c_nationkey nation, n_name from (select user_id, " + K + " k from events where event_type='purchase') e left join customer on c_custkey=e.k left join nation on n_nationkey=c_nationkey")
def q55_identity_chain(spark, sf_dir):
    first = with_k(spark, sf_dir).where("event_type='purchase'").select("user_id", "k")
    second = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return procedures.identity_chain(first, second, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name"))


@query(
    "with j as (select conv_id, turn, regexp_replace(text, chr(27) || '\\[[0-9;]*[A-Za-z]', '', 'g') line from (select conv_id, turn, chr(27) || '[31m' || turn || ' passed, ' || length(text) || ' failed' || chr(27) || '[0m' as text from conversations)) "
    "select conv_id, sum(turn)::bigint passed, sum(cast(regexp_extract(line, '(\\d+) failed', 1) as bigint))::bigint failed from j where turn<3 group by 1"
)
def q56_job_counts(spark, sf_dir):
    line = F.concat(F.lit("\x1b[31m"), F.col("turn").cast("string"), F.lit(" passed, "), F.length("text").cast("string"), F.lit(" failed\x1b[0m"), F.when(F.col("turn") == 3, " section_start:1:after_script").otherwise(""))
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("value"))
    return consoles.job_counts(consoles.job_lines(lines, ["conv_id"], "turn"), ["conv_id"]).select("conv_id", "passed", "failed")


@query(
    f"with u as (select user_id, t, event_id, row_number() over (partition by user_id order by event_id) n, min(cast(ts as date)) over (partition by user_id) d0 from {E}), r as (select * from u), "
    "x as (select *, t%86400000000 tod, lag(t%86400000000) over (partition by user_id order by event_id) pre from r) select user_id, event_id, epoch_us(d0::timestamp) + sum(case when pre-tod>43200000000 then 86400000000 else 0 end) over (partition by user_id order by event_id) + (tod//1000)*1000 t from x"
)
def q57_dated_times(spark, sf_dir):
    frame = read(spark, sf_dir, "events")
    anchors = frame.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("date"))
    times = frame.select("user_id", "event_id", F.date_format(F.col("ts").cast("timestamp_ntz"), "HH:mm:ss.SSS").alias("ts"))
    return clocks.dated(times, anchors, ["user_id"], "event_id").select("user_id", "event_id", F.col("t").cast("bigint").alias("t"))


@query(
    f"with l as (select user_id, event_id, case event_type when 'signup' then case when {K}%2=0 then 2 end when 'click' then 1 when 'purchase' then 3 end step from events), a as (select u.user_id, min(event_id) s1 from (select distinct user_id from l where step is not null) u left join l on l.user_id=u.user_id and step=1 group by 1), "
    "b as (select a.user_id, s1, min(event_id) s2 from a left join l on l.user_id=a.user_id and step=2 and event_id>s1 group by 1,2), c as (select b.user_id, s1, s2, min(event_id) s3 from b left join l on l.user_id=b.user_id and step=3 and event_id>s2 group by 1,2,3), "
    "seen as (select user_id, array_to_string(list_sort(list(distinct step)), ',') seen from l where step is not null group by 1) select user_id, (s1 is not null)::int+(s2 is not null)::int+(s3 is not null)::int reached, seen from c join seen using (user_id)"
)
def q58_procedure_steps(spark, sf_dir):
    users = events(spark, sf_dir).select("event_id", "user_id")
    parsed = logs.parse_radio(radio_log(spark, sf_dir)).join(users, "event_id")
    found = sequences.reached(parsed, ["user_id"], "event_id", expected=(("SCHED", r"prach\("), ("NGAP", "NGSetupResponse"), ("CU-CP", ": UE created")))
    return found.select("user_id", "reached", F.array_join(F.col("seen").cast("array<string>"), ",").alias("seen"))


@query(
    "with h as (select user_id, event_id from events where event_type='signup') select h.user_id, h.event_id, min(b.event_id) body_line from h "
    "left join events b on b.user_id=h.user_id and b.event_type='purchase' and b.event_id between h.event_id+1 and h.event_id+200 group by 1,2"
)
def q97_body_within(spark, sf_dir):
    """Headers with the first body line of their file, no more than 200 lines on."""
    found = logs.body_within(read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return found.select("user_id", "event_id", "body_line")
