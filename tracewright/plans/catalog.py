"""Queries over the star-schema test tables, each with the SQL it must equal.

Sequences come from ``events`` (a user is a session, an event type a tool), texts
from ``conversations`` and ``documents``.  Doubles are rounded to six places on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType

from ..frames import Frames, conversation_frames, events_frames
from ..functions import patterns as P
from ..result import REGISTRY
from . import behaviour, corpus, extras, log_catalog, numeric, process, sequence, trends
from .classify import message_class

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Frames:
    return events_frames(read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))


def conversations(spark: SparkSession, sf_dir: str) -> Frames:
    return conversation_frames(read(spark, sf_dir, "conversations"))


def plain(df: DataFrame) -> DataFrame:
    """Doubles to six places (no negative zero), whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (IntegerType, LongType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- SQL of the two session tables ---

E = """e as (
  select user_id::varchar as session_key, user_id, event_type as tool, ts, event_id,
         row_number() over (partition by user_id order by ts, event_id) as pos
  from events)"""
PAIRS = E + """,
p as (select session_key, tool as f, lead(tool) over (partition by session_key order by pos) as t from e),
b as (select * from p where t is not null)"""


def _sql_phrases(phrases) -> str:
    return P.bounded(phrases, look=False).replace("'", "''")


C = f"""m0 as (
  select conv_id::varchar as session_key, conv_id, turn as msg_idx, upper(role[1]) || role[2:] as role, coalesce(text, '') as text from conversations),
m1 as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, role = 'User' as is_user from m0),
m as (
  select session_key, conv_id, msg_idx, role, text, case
      when not is_user then 'Other'
      when {" or ".join(f"contains(text, '{x}')" for x in P.SYSTEM_TAGS)} then 'SystemMessage'
      when strlen(t) < 1000 and regexp_matches(lower(t), '{_sql_phrases(P.CORRECTIONS)}') then 'HumanCorrection'
      when strlen(t) < 1000 and regexp_matches(lower(t), '{_sql_phrases(P.APPROVALS)}') then 'HumanApproval'
      when strlen(t) < 1000 and (contains(t, '?') or regexp_matches(lower(t), '{P.starts(P.QUESTION_STARTS)}')) then 'HumanQuestion'
      when strlen(t) < 1000 or row_number() over (partition by session_key, is_user order by msg_idx) = 1 then 'HumanDirective'
      else 'Other' end as classification
  from m1)"""

# --- transitions ---


@query("markov_transitions", f"with {PAIRS}, c as (select f, t, count(*) as n from b group by f, t) select f as from_tool, t as to_tool, n, round(n / sum(n) over (partition by f), 6) as probability from c")
def _(spark, d):
    return sequence.transitions(events(spark, d).tool_calls)


@query("markov_self_loops", f"with {PAIRS}, c as (select f, t, count(*) as n from b group by f, t), p2 as (select *, n / sum(n) over (partition by f) as p from c) select f as tool, round(p, 6) as probability from p2 where f = t")
def _(spark, d):
    return sequence.transitions(events(spark, d).tool_calls).where("from_tool = to_tool").select(F.col("from_tool").alias("tool"), "probability")


@query("markov_entry_tools", f"with {E} select tool as name, count(*) as n from e where pos = 1 group by tool")
def _(spark, d):
    return sequence.entry_tools(events(spark, d).tool_calls)


@query("markov_matrix", f"""with {PAIRS}, c as (select f, t, count(*) as n from b group by f, t), q as (select f, t, n / sum(n) over (partition by f) as p from c)
select f as from_tool, {", ".join(f"round(coalesce(max(p) filter (where t = '{x}'), 0), 6) as {x}" for x in ("click", "error", "purchase", "signup", "view"))} from q group by f""")
def _(spark, d):
    return sequence.transition_matrix(sequence.transitions(events(spark, d).tool_calls), ["click", "error", "purchase", "signup", "view"])


STATIONARY = f"""{PAIRS}, c as (select f, t, count(*) as n from b group by f, t), q as (select f, t, n / sum(n) over (partition by f) as p from c),
tools as (select distinct tool from e), step(i, tool, x) as (
  select 0, tool, 1.0::double / (select count(*) from tools) from tools
  union all
  select s.i, s.tool, s.x from (
    select step.i + 1 as i, q.t as tool, sum(step.x * q.p) over (partition by q.t) as x, row_number() over (partition by q.t order by q.f) as k
    from step join q on q.f = step.tool where step.i < 60) s where s.k = 1)"""


@query("markov_stationary", f"with recursive {STATIONARY} select tool, round(x, 6) as share from step where i = 60")
def _(spark, d):
    table = sequence.transitions(events(spark, d).tool_calls)
    return spark.createDataFrame(sorted(sequence.stationary(table).items()), "tool string, share double")


# --- entropy ---

WINDOWS = f"""{PAIRS}, ordered as (select session_key, pos, tool, lead(tool) over (partition by session_key order by pos) as t, count(*) over (partition by session_key) as n from e),
starts as (select session_key, pos as start from ordered where pos <= n - 19),
inside as (select s.session_key, s.start, o.tool as f, o.t from starts s join ordered o on o.session_key = s.session_key and o.pos between s.start and s.start + 18),
cells as (select session_key, start, f, t, count(*) as c from inside group by session_key, start, f, t),
rows_ as (select *, sum(c) over (partition by session_key, start, f) as r from cells),
w as (select session_key, start, greatest(0, -sum(c / 19.0::double * log2(c / r::double))) as entropy from rows_ group by session_key, start)"""
PER = f"""{WINDOWS}, s0 as (select *, avg(entropy) over (partition by session_key) as mean, stddev_pop(entropy) over (partition by session_key) as sd from w),
s as (select session_key, any_value(mean) as mean_entropy, any_value(sd) as stddev, count(*) filter (where sd > 0 and entropy < mean - 2 * sd) as low, count(*) filter (where sd > 0 and entropy > mean + 2 * sd) as high, count(*) as windows from s0 group by session_key)"""


@query("entropy_windows", f"with {WINDOWS} select session_key, start, round(entropy, 6) as entropy from w")
def _(spark, d):
    return sequence.entropy_windows(events(spark, d).tool_calls)


@query("entropy_per_session", f"with {PER} select session_key, round(mean_entropy, 6) as mean_entropy, round(stddev, 6) as stddev, low, high, windows from s")
def _(spark, d):
    return sequence.entropy_sessions(sequence.entropy_windows(events(spark, d).tool_calls))


@query("entropy_summary", f"with {PER} select round(avg(mean_entropy), 6) as mean_entropy, coalesce(sum(low), 0)::bigint as low, coalesce(sum(high), 0)::bigint as high, count(*) as sessions from s")
def _(spark, d):
    s = sequence.entropy_sessions(sequence.entropy_windows(events(spark, d).tool_calls))
    return s.agg(F.avg("mean_entropy").alias("mean_entropy"), F.coalesce(F.sum("low"), F.lit(0)).alias("low"), F.coalesce(F.sum("high"), F.lit(0)).alias("high"), F.count("*").alias("sessions"))


# --- burstiness ---

BURST = f"""{E}, g as (select tool, row_number() over (order by user_id, pos) as place from e),
l as (select tool, place - lag(place) over w - 1 as gap, lag(place) over w - lag(place, 2) over w - 1 as before from g window w as (partition by tool order by place)),
st as (select tool, count(*) as n, count(gap) as gaps, avg(gap) as mean, stddev_pop(gap) as sd, corr(before, gap) as r from l group by tool),
bt as (select tool as tool_name, case when n = 2 then case when mean > 0 then -1.0::double else 1.0::double end when sd + mean = 0 then 1.0::double else (sd - mean) / (sd + mean) end as burstiness_b,
       case when gaps >= 3 then case when r is null or isnan(r) then 0.0::double else r end end as memory_m, mean as mean_interval, n from st where n >= 2)"""


@query("burstiness_per_tool", f'with {BURST} select tool_name, round(burstiness_b, 6) as burstiness_b, round(memory_m, 6) as memory_m, round(mean_interval, 6) as mean_interval, n as "count" from bt')
def _(spark, d):
    return sequence.tool_burstiness(events(spark, d))


@query("burstiness_aggregate", f"with {BURST} select round(sum(burstiness_b * n) / sum(n), 6) as aggregate_burstiness, round(sum(memory_m * n) / sum(n) filter (where memory_m is not null), 6) as aggregate_memory, count(*) as tools_analyzed from bt")
def _(spark, d):
    return sequence.burstiness_aggregate(sequence.tool_burstiness(events(spark, d)))


# --- diversity ---

DIV = f"""{E}, c as (select session_key, tool, count(*) as n from e group by session_key, tool),
ag as (select session_key, sum(n)::bigint as abundance, count(*) as richness, sum(n * ln(n)) as nlogn, sum(n * n)::bigint as nn from c group by session_key),
dv as (select session_key, case when richness <= 1 then 0.0::double else ln(abundance) - nlogn / abundance end as shannon, 1 - nn / (abundance * abundance)::double as simpson,
       case when richness > 1 then (ln(abundance) - nlogn / abundance) / ln(richness) else 0.0::double end as evenness, richness, abundance from ag)"""


@query("diversity_per_session", f"with {DIV} select session_key, round(shannon, 6) as shannon, round(simpson, 6) as simpson, round(evenness, 6) as evenness, richness, abundance from dv")
def _(spark, d):
    return sequence.session_diversity(events(spark, d))


@query("diversity_summary", f"with {DIV} select round(avg(shannon), 6) as mean_shannon, round(median(shannon), 6) as median_shannon, round(avg(simpson), 6) as mean_simpson, round(avg(evenness), 6) as mean_evenness, count(*) filter (where evenness < 0.3) as monoculture_count, round(count(*) filter (where evenness < 0.3) / count(*), 6) as monoculture_fraction, count(*) as sessions_analyzed from dv")
def _(spark, d):
    return sequence.diversity_summary(sequence.session_diversity(events(spark, d)))


def _days(spark, d) -> Frames:
    """Sessions by user and day, whose richness varies."""
    e = read(spark, d, "events")
    day = e.select("event_id", "ts", (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("user_id"), "event_type", "value")
    return events_frames(day)


@query("diversity_species_area", """with c as (select user_id, day(ts) as dy, event_type, count(*) as n from events group by all), s as (select user_id, dy, sum(n) as a, count(*) as r from c group by user_id, dy)
select round(regr_slope(ln(r), ln(a)), 6) as z, round(regr_r2(ln(r), ln(a)), 6) as r_squared from s""")
def _(spark, d):
    return sequence.species_area(sequence.session_diversity(_days(spark, d)))


# --- messages and sessions ---


@query("message_classes", f"with {C} select session_key, msg_idx, role, classification from m")
def _(spark, d):
    return conversations(spark, d).messages.select("session_key", "msg_idx", "role", "classification")


@query("session_types", f"with {C} select session_key, case when bool_or(role = 'User' and starts_with(classification, 'Human')) then 'Interactive' when bool_or(role = 'User') then 'Autonomous' else 'Unknown' end as session_type from m group by session_key")
def _(spark, d):
    return conversations(spark, d).sessions.select("session_key", "session_type")


CORR = f"""{C}, u as (select session_key, conv_id, (classification = 'HumanCorrection')::int as hit, row_number() over (partition by session_key order by msg_idx) - 1 as i, count(*) over (partition by session_key) as n from m where role = 'User'),
th as (select *, case when n < 3 or i < n // 3 then 0 when i < 2 * (n // 3) then 1 else 2 end as third from u),
sx as (select conv_id, {", ".join(f"coalesce(sum(hit) filter (where third = {t}), 0)::bigint as c{t}, count(hit) filter (where third = {t}) as n{t}" for t in range(3))}, sum(hit)::bigint as corrections, count(hit) as user_messages from th group by conv_id),
ss as (select k.session_key, k.conv_id, 'p' || (k.conv_id % 7) as project, {", ".join(f"coalesce({x}, 0) as {x}" for x in ("c0", "c1", "c2", "n0", "n1", "n2", "corrections", "user_messages"))} from (select distinct session_key, conv_id from m) k left join sx using (conv_id))"""
RATE = ", ".join(f"round(case when n{t} > 0 then c{t} / n{t} else 0 end, 6) as rate{t}" for t in range(3))


@query("correction_rate_per_session", f"with {CORR} select session_key, corrections, user_messages, round(case when user_messages > 0 then corrections / user_messages else 0 end, 6) as rate, {RATE} from ss")
def _(spark, d):
    return behaviour.correction_sessions(conversations(spark, d)).select("session_key", "corrections", "user_messages", "rate", "rate0", "rate1", "rate2")


@query("correction_rate_thirds", f"with {CORR} select {', '.join(f'sum(c{t})::bigint as c{t}, sum(n{t})::bigint as n{t}' for t in range(3))} from ss")
def _(spark, d):
    return behaviour.correction_sessions(conversations(spark, d)).agg(*(F.sum(f"{x}{t}").alias(f"{x}{t}") for t in range(3) for x in "cn"))


@query("correction_rate_by_project", f"with {CORR} select 'project_' || sha256(project)[1:8] as project, round(sum(corrections) / sum(user_messages), 6) as correction_rate, sum(corrections)::bigint as corrections, sum(user_messages)::bigint as user_messages, count(*) as session_count from ss group by project")
def _(spark, d):
    return behaviour.correction_projects(behaviour.correction_sessions(conversations(spark, d)))


_TOKENS = "[" + ", ".join(f"'{t}'" for t in P.RISK_TOKENS) + "]"
_RISK = "list_filter({words}, lambda x: regexp_matches({column}, '(?i)\\b' || x || '\\b'))"


@query("risk_token_divergence", f"""with m as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) as reply from conversations),
r as (select conv_id::varchar as session_key, turn as msg_idx, {_RISK.format(words=_TOKENS, column="text")} as risk, reply from m where role = 'user' and text is not null)
select session_key, msg_idx, len(risk)::bigint as risk, len(list_filter(risk, lambda x: not regexp_matches(coalesce(reply, ''), '(?i)\\b' || x || '\\b')))::bigint as hidden from r""")
def _(spark, d):
    """Surrogate: a user text stands for the thinking, the message before it for the visible text."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("thinking"), F.lag("text").over(w).alias("text")).where("role = 'user' and thinking is not null")
    rows = behaviour.risk_tokens(m)
    return rows.select(F.col("conv_id").cast("string").alias("session_key"), F.col("turn").alias("msg_idx"), F.size("risk").alias("risk"), F.size("hidden").alias("hidden"))


# --- foraging on events: a patch is an event type ---

VISITS = f"""{E}, r0 as (select *, coalesce((lag(tool) over (partition by session_key order by pos) is distinct from tool)::int, 1) as new from e),
r1 as (select *, sum(new) over (partition by session_key order by pos) as run from r0),
v as (select session_key, run::bigint as run, tool as patch, count(*) as residence, min(pos) as first_turn from r1 group by session_key, run, tool)"""


def _turns(spark, d) -> DataFrame:
    """Surrogate turns: the event type is the patch, views and clicks explore, the rest exploits."""
    explore = F.col("name").isin("view", "click").cast("int")
    return events(spark, d).tool_calls.select("session_key", F.col("pos").alias("turn"), F.col("name").alias("patch"), explore.alias("explore"), (1 - explore).alias("exploit"))


@query("foraging_visits", f"with {VISITS} select session_key, run, patch, residence, first_turn from v")
def _(spark, d):
    return behaviour.patch_visits(_turns(spark, d))


@query("foraging_metrics", f"""with {VISITS}, bv as (select session_key, count(*) as visits, count(distinct patch) as patches, avg(residence) as residence from v group by session_key),
ct as (select session_key, count(*) filter (where tool in ('view', 'click')) as explore, count(*) filter (where tool not in ('view', 'click')) as exploit, count(*) as turns from e group by session_key)
select session_key, visits, patches, round(residence, 6) as residence, round(patches / turns, 6) as efficiency, round(case when exploit > 0 then explore / exploit else 0 end, 6) as explore_exploit, round((visits - patches) / visits, 6) as revisit_rate from bv join ct using (session_key)""")
def _(spark, d):
    turns = _turns(spark, d)
    return behaviour.foraging_sessions(turns, behaviour.patch_visits(turns))


@query("patch_table", f"with {VISITS} select patch, count(*) as visits, round(avg(residence), 6) as mean_residence from v group by patch")
def _(spark, d):
    return behaviour.patch_table(behaviour.patch_visits(_turns(spark, d)))


# --- survival on events: time to the first error ---

TIMES = f"""{E}, tm as (select session_key, user_id, coalesce(min(pos) filter (where tool = 'error'), count(*)) as duration, count(*) filter (where tool = 'error') > 0 as event from e group by session_key, user_id),
rk as (select duration, count(*) filter (where event) as d, count(*) as n from tm group by duration),
rt as (select duration, d, n - d as censored, (sum(n) over (order by duration desc))::bigint as at_risk from rk)"""


def _times(spark, d) -> DataFrame:
    by = events(spark, d).tool_calls.groupBy("session_key").agg(F.min(F.when(F.col("name") == "error", F.col("pos"))).alias("first"), F.count("*").alias("n"))
    return by.select("session_key", F.coalesce("first", "n").alias("duration"), F.col("first").isNotNull().alias("event"), F.concat(F.lit("g"), F.col("session_key").cast("long") % 3).alias("grp"))


@query("km_curve", f"""with {TIMES} select duration, d, censored, at_risk, round(case when min(1 - d / at_risk) over (order by duration) <= 0 then 0 else exp(sum(ln(case when d < at_risk then 1 - d / at_risk end)) over (order by duration)) end, 6) as survival from rt""")
def _(spark, d):
    return trends.kaplan_meier(_times(spark, d))


@query("nelson_aalen", f"with {TIMES} select duration, d, censored, at_risk, round(sum(d / at_risk) over (order by duration), 6) as hazard from rt")
def _(spark, d):
    return trends.nelson_aalen(_times(spark, d))


@query("logrank_groups", f"""with {TIMES}, gm as (select 'g' || (user_id % 3) as grp, duration, event from tm), ev as (select duration, d as dd, at_risk as nn from rt where d > 0),
ex as (select g.grp, sum((select count(*) from gm where gm.grp = g.grp and gm.duration >= ev.duration) * dd / nn) as expected from (select distinct grp from gm) g, ev group by g.grp)
select grp, (select count(*) from gm where gm.grp = ex.grp and event) as observed, round(expected, 6) as expected, round(((select count(*) from gm where gm.grp = ex.grp and event) - expected) ** 2 / expected, 6) as chi2 from ex""")
def _(spark, d):
    return trends.log_rank(_times(spark, d), "grp")


# --- process ---


def _log(spark, d) -> DataFrame:
    return process.event_log(events(spark, d).tool_calls)


@query("dfg_edges", f"with {PAIRS} select f as source, t as target, count(*) as n from b group by f, t")
def _(spark, d):
    return process.directly_follows(_log(spark, d))


@query("activity_stats", f"""with {VISITS} select patch as symbol, sum(residence)::bigint as frequency, round(100.0 * count(distinct session_key) / (select count(distinct session_key) from e), 6) as coverage_pct, round(sum(residence) / count(*), 6) as mean_dwell from v group by patch""")
def _(spark, d):
    return process.activity_stats(_log(spark, d))


@query("dwell_runs", f"with {VISITS} select patch as symbol, residence as length, count(*) as n from v group by patch, residence")
def _(spark, d):
    visits = behaviour.patch_visits(_turns(spark, d))
    return visits.groupBy(F.col("patch").alias("symbol"), F.col("residence").alias("length")).agg(F.count("*").alias("n"))


@query("rework_loops", f"with {PAIRS} select f as source, count(*) as n from b where f = t group by f")
def _(spark, d):
    return process.directly_follows(_log(spark, d)).where("source = target").select("source", "n")


@query("correction_predecessors", f"with {PAIRS} select f as activity, count(*) as n from b where t = 'error' group by f")
def _(spark, d):
    return process.predecessors(_log(spark, d), "error")


VARIANT = f"{VISITS}, va as (select session_key, string_agg(patch, '>' order by run) as variant from v group by session_key)"


@query("process_variants", f"with {VARIANT} select variant, count(*) as sessions from va group by variant")
def _(spark, d):
    return process.variants(_log(spark, d))


def _ngram_sql(n: int) -> str:
    parts = " || '>' || ".join(["tool", *(f"lead(tool, {k}) over (partition by session_key order by pos)" for k in range(1, n))])
    return f"with {E}, g as (select session_key, {parts} as pattern from e) select pattern, count(*) as occurrences, count(distinct session_key) as sessions from g where pattern is not null group by pattern"


@query("trigram_support", _ngram_sql(3))
def _(spark, d):
    return process.ngram_support(_log(spark, d), 3)


@query("tool_bigram_support", _ngram_sql(2))
def _(spark, d):
    return process.ngram_support(_log(spark, d), 2)


@query("prefixspan_patterns")
def _(spark, d):
    return process.frequent_patterns(_log(spark, d))


SYMBOLS = {"click": "C", "error": "E", "purchase": "P", "signup": "S", "view": "V"}
_LETTER = "case tool " + " ".join(f"when '{k}' then '{v}'" for k, v in SYMBOLS.items()) + " else 'X' end"
KMERS = f"""{E}, st as (select session_key, user_id, string_agg({_LETTER}, '' order by pos) as s from e group by session_key, user_id),
km as (select session_key, substr(s, i::bigint, k::bigint) as kmer from st, (values (3), (4), (5)) t(k), unnest(range(1, length(s) - k + 2)) u(i)),
cv as (select kmer as motif, count(*) as frequency, 100.0 * count(distinct session_key) / (select count(*) from st) as cov from km group by kmer having count(distinct session_key) > 0.3 * (select count(*) from st))"""


@query("kmer_conserved", f"with {KMERS} select motif, frequency, round(cov, 6) as session_coverage_pct from cv")
def _(spark, d):
    return process.conserved_kmers(process.symbol_strings(_log(spark, d), SYMBOLS))


@query("kmer_enrichment", f"""with {KMERS}, f as (select motif, user_id % 2 = 1 as high, (length(s) - length(replace(s, motif, ''))) / length(motif) as times, length(s) as n from st, cv),
r as (select motif, sum(times) filter (where not high) / sum(n) filter (where not high) as low_freq, sum(times) filter (where high) / sum(n) filter (where high) as high_freq from f group by motif)
select motif, round(low_freq, 6) as low_freq, round(high_freq, 6) as high_freq, round(high_freq / low_freq, 6) as enrichment_ratio from r where low_freq > 0 and high_freq > 0""")
def _(spark, d):
    strings = process.symbol_strings(_log(spark, d), SYMBOLS)
    return process.kmer_enrichment(strings, strings.select("session_key", (F.col("session_key").cast("long") % 2 == 1).alias("high")))


# --- lag-sequential ---

LAG = f"""{E}, ll as (select e.session_key, tool as f, k as lag, lead(tool, k::int) over (partition by e.session_key, k order by pos) as t from e, (values (1), (2), (3)) v(k)),
ob as (select lag, f, t, count(*) as observed from ll where t is not null group by lag, f, t),
cl as (select a.lag, a.f, b.t, a.r, b.c, coalesce(o.observed, 0) as observed from (select lag, f, sum(observed) as r from ob group by lag, f) a join (select lag, t, sum(observed) as c from ob group by lag, t) b using (lag) left join ob o on o.lag = a.lag and o.f = a.f and o.t = b.t),
nn as (select *, sum(observed) over (partition by lag) as n from cl),
zz as (select f as "from", t as "to", lag, observed, r * c / n as expected, case when r * c / n * (1 - r / n) * (1 - c / n) > 1e-12 then (observed - r * c / n) / sqrt(r * c / n * (1 - r / n) * (1 - c / n)) else 0 end as z from nn)"""


@query("lagseq_residuals", f'with {LAG} select "from", "to", lag::bigint as lag, observed::bigint as observed, round(expected, 6) as expected, round(z, 6) as z_score from zz')
def _(spark, d):
    return process.lag_residuals(_log(spark, d))


@query("lagseq_top", f'with {LAG} select "from", "to", lag::bigint as lag, observed::bigint as observed, round(expected, 6) as expected, round(z, 6) as z_score from zz where z > 1e-4 order by z desc, lag, "from", "to" limit 20')
def _(spark, d):
    return process.top_residuals(process.lag_residuals(_log(spark, d)), True, 20)


@query("lagseq_top_negative", f'with {LAG} select "from", "to", lag::bigint as lag, observed::bigint as observed, round(expected, 6) as expected, round(z, 6) as z_score from zz where z < -1e-4 order by z, lag, "from", "to" limit 10')
def _(spark, d):
    return process.top_residuals(process.lag_residuals(_log(spark, d)), False, 10)


@query("event_frequencies", f'with {E} select tool as event, count(*) as "count", round(count(*) / (select count(*) from e), 6) as proportion from e group by tool')
def _(spark, d):
    return process.event_frequencies(_log(spark, d))


# --- control charts on the hourly share of errors ---

SPC = """p0 as (select strftime(ts, '%Y-%m-%d %H') as session_id, count(*) filter (where event_type = 'error') / count(*) as value from events group by 1),
p as (select row_number() over (order by session_id) - 1 as i, session_id, value, abs(value - lag(value) over (order by session_id)) as mr from p0),
lim as (select avg(value) as mean, avg(mr) as mr_bar, avg(value) + 2.66 * avg(mr) as ucl, greatest(0, avg(value) - 2.66 * avg(mr)) as lcl, avg(mr) / 1.128 as sigma from p)"""


SPC_MAX = SPC.replace("count(*) filter (where event_type = 'error') / count(*)", "max(value)")


def _points(spark, d, value=None) -> DataFrame:
    value = F.avg((F.col("event_type") == "error").cast("int")) if value is None else value
    by = read(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("session_id")).agg(value.alias("value"))
    return trends.in_order(by.withColumn("ts", F.to_timestamp("session_id", "yyyy-MM-dd HH")).withColumn("session_ord", F.lit(0)), "value")


@query("spc_limits", f"with {SPC} select round(mean, 6) as mean, round(ucl, 6) as ucl, round(lcl, 6) as lcl, round(mr_bar, 6) as mr_bar, round(sigma, 6) as sigma from lim")
def _(spark, d):
    return trends.control_limits(_points(spark, d))


@query("spc_out_of_control", f"with {SPC} select i, session_id, round(value, 6) as value, case when value > ucl then 'UCL' else 'LCL' end as limit_violated from p, lim where value > ucl or value < lcl")
def _(spark, d):
    return trends.out_of_control(_points(spark, d))


@query("spc_rule2", f"""with {SPC_MAX}, z as (select i, greatest(sum((value - mean > 2 * sigma)::int) over w, sum((mean - value > 2 * sigma)::int) over w)::bigint as beyond, count(*) over w as n from p, lim where sigma > 0 window w as (order by i rows between 1 preceding and 1 following))
select i, beyond from z where n = 3 and beyond >= 2""")
def _(spark, d):
    return trends.two_of_three(_points(spark, d, F.max("value")))


@query("spc_cusum", f"""with {SPC}, u as (select i, sigma, sum(value - mean - sigma / 2) over (order by i) as up, sum(mean - sigma / 2 - value) over (order by i) as dn from p, lim),
s as (select i, sigma, up - least(0, min(up) over (order by i)) as s_hi, dn - least(0, min(dn) over (order by i)) as s_lo from u)
select i, round(s_hi, 6) as s_hi, round(s_lo, 6) as s_lo, sigma > 0 and greatest(s_hi, s_lo) > 4 * sigma as alarm from s""")
def _(spark, d):
    return trends.cusum(_points(spark, d))


@query("spc_capability", f"with {SPC} select round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(avg(value) + 3 * stddev_samp(value), 6) as ucl, round(greatest(0, avg(value) - 3 * stddev_samp(value)), 6) as lcl, round(0.4 / (6 * stddev_samp(value)), 6) as cp, round(least(0.4 - avg(value), avg(value)) / (3 * stddev_samp(value)), 6) as cpk from p")
def _(spark, d):
    return trends.capability(_points(spark, d), 0.0, 0.4)


# --- further statistics ---


def _order_sql(k: int) -> str:
    context = " || '>' || ".join(f"lag(tool, {j}) over w" for j in range(k, 0, -1)) or "''"
    return f"""select {k}::bigint as k, -sum(n * log2(n / r)) / sum(n) as entropy from (select n, sum(n) over (partition by c) as r from (
      select c, tool, count(*) as n from (select {context} as c, tool from e window w as (partition by session_key order by pos)) where c is not null group by c, tool))"""


@query("order_entropy", f"with {E}, o as ({' union all '.join(map(_order_sql, range(4)))}) select k, round(entropy, 6) as entropy from o")
def _(spark, d):
    return process.order_entropy(_log(spark, d))


@query("edge_tools", f"with {E}, x as (select tool as symbol, pos, count(*) over (partition by session_key) as n from e) select symbol, count(*) filter (where pos <= 5) as first_n, count(*) filter (where pos > n - 5) as last_n from x group by symbol")
def _(spark, d):
    return process.edge_symbols(_log(spark, d))


GAINS = f"""{VISITS}, gi as (select session_key, run::bigint as run, tool as patch, (tool not in ('view', 'click'))::int as exploit, row_number() over (partition by session_key, run order by pos) as i, count(*) over (partition by session_key, run) as n from r1),
gv as (select session_key, run, patch, max(n) as residence, sum(exploit)::bigint as gain, coalesce(sum(exploit) filter (where i * 2 <= n), 0)::bigint as first_gain, coalesce(sum(exploit) filter (where i * 2 > n), 0)::bigint as second_gain,
  max(n) - coalesce(max(i) filter (where exploit > 0), 0) as giving_up from gi group by session_key, run, patch)"""


@query("mvt_visits", f"with {GAINS} select * from gv")
def _(spark, d):
    return process.visit_gains(_turns(spark, d))


@query("mvt_test", f"with {GAINS} select count(*) as visits, round(corr(residence, gain), 6) as residence_gain_r, round(avg((second_gain < first_gain)::int), 6) as mvt_share, round(avg(giving_up), 6) as giving_up_time from gv")
def _(spark, d):
    return process.mvt_test(process.visit_gains(_turns(spark, d)))


@query("cumulative_incidence", f"""with {E}, c0 as (select session_key, pos, tool from e where tool in ('error', 'purchase')), c1 as (select session_key, min(pos) as duration, arg_min(tool, pos) as cause from c0 group by session_key),
c as (select k.session_key, coalesce(c1.duration, k.n) as duration, cause from (select session_key, count(*) as n from e group by session_key) k left join c1 using (session_key)),
g as (select duration, count(cause) as d, (sum(count(*)) over (order by duration desc))::bigint as at_risk from c group by duration),
sv as (select duration, at_risk, case when min(1 - d / at_risk) over w <= 0 then 0 else exp(sum(ln(case when d < at_risk then 1 - d / at_risk end)) over w) end as s from g window w as (order by duration)),
lf as (select duration, at_risk, coalesce(lag(s) over (order by duration), 1) as lft from sv)
select duration, cause, round(sum(lft * k / at_risk) over (partition by cause order by duration), 6) as incidence from (select duration, cause, count(*) as k from c where cause is not null group by duration, cause) join lf using (duration)""")
def _(spark, d):
    calls = events(spark, d).tool_calls
    hit = F.when(F.col("name").isin("error", "purchase"), F.col("pos"))
    by = calls.groupBy("session_key").agg(F.min(hit).alias("first"), F.min_by("name", hit).alias("cause"), F.count("*").alias("n"))
    return trends.cumulative_incidence(by.select(F.coalesce("first", "n").alias("duration"), F.when(F.col("first").isNotNull(), F.col("cause")).alias("cause")))


@query("cohort_weeks", """with x as (select strftime(ts, '%G-%V') as week, user_id, count(*) filter (where event_type = 'view') = 0 as no_views from events group by 1, 2)
select week, count(*) as sessions, count(*) filter (where no_views) as without_views from x where user_id not in (select user_id from events where value > 250) group by week""")
def _(spark, d):
    """Sessions by ISO week, a flag, and a cohort left out by an anti join."""
    e = read(spark, d, "events")
    kept = e.join(e.where("value > 250").select("user_id").distinct(), "user_id", "left_anti")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "ts").cast("string"), F.lit("-"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    by = kept.groupBy(week.alias("week"), "user_id").agg((F.count_if(F.col("event_type") == "view") == 0).alias("no_views"))
    return by.groupBy("week").agg(F.count("*").alias("sessions"), F.count_if("no_views").alias("without_views"))


# --- epistemic networks on documents: the lines of a document are its turns ---

_CODE_SQL = {c: "(regexp_matches(text, '(?i)\\b(" + "|".join(P.CODE_KEYWORDS[c]) + ")\\b'))::int" if c in P.CODE_KEYWORDS else "0" for c in P.CODES}
ENA = f"""ln as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as msg_idx from documents where text is not null),
cd as (select doc_id, msg_idx, {", ".join(f"{x} as {c}" for c, x in _CODE_SQL.items())} from ln),
wi as (select doc_id, count(*) over (partition by doc_id) as turns, {", ".join(f"max({c}) over w as {c}" for c in P.CODES)} from cd window w as (partition by doc_id order by msg_idx rows between 4 preceding and current row)),
se as (select doc_id, {", ".join(f"avg({a} * {b}) as {a}_{b}" for a, b in behaviour.EDGES)} from wi where turns >= 3 group by doc_id),
ed as ({" union all ".join(f"select '{a}' as code_a, '{b}' as code_b, coalesce(avg({a}_{b}), 0) as weight from se" for a, b in behaviour.EDGES)})"""


def _coded(spark, d) -> DataFrame:
    lines = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("session_key"), F.posexplode(F.split("text", "\n", -1)).alias("msg_idx", "text"))
    return behaviour.code_columns(lines.select("*", F.lit("Assistant").alias("role"), F.lit(None).cast("string").alias("thinking"), F.lit(0).alias("n_tool_calls")))


@query("ena_edges", f"with {ENA} select code_a, code_b, round(weight, 6) as weight from ed")
def _(spark, d):
    return behaviour.network_edges(behaviour.network_sessions(_coded(spark, d)))


@query("ena_full_windows", f"""with {ENA.replace("count(*) over (partition by doc_id) as turns,", "count(*) over (partition by doc_id) as turns, count(*) over w as seen,").replace("from wi where turns >= 3", "from wi where turns >= 3 and seen = 5")} select code_a, code_b, round(weight, 6) as weight from ed""")
def _(spark, d):
    return behaviour.network_edges(behaviour.network_sessions(_coded(spark, d), full=True))


@query("ena_centrality", f"""with {ENA}, n as (select code_a as code, weight from ed union all select code_b, weight from ed), g as (select code, sum(weight) as w from n group by code)
select code, round(case when sum(w) over () > 0 then w / sum(w) over () else 0 end, 6) as centrality from g""")
def _(spark, d):
    return behaviour.network_centrality(behaviour.network_edges(behaviour.network_sessions(_coded(spark, d))))


@query("ena_discriminative", f"""with {ENA.replace("from wi where turns >= 3 group by doc_id", "from wi where turns >= 3 group by doc_id")}, dv as ({" union all ".join(f"select '{a}' as code_a, '{b}' as code_b, coalesce(avg({a}_{b}) filter (where doc_id % 2 = 0), 0) as lo, coalesce(avg({a}_{b}) filter (where doc_id % 2 = 1), 0) as hi from se" for a, b in behaviour.EDGES)})
select code_a, code_b, round(lo, 6) as lo, round(hi, 6) as hi, round(lo - hi, 6) as difference from dv""")
def _(spark, d):
    sessions = behaviour.network_sessions(_coded(spark, d))
    lo, hi = (behaviour.network_edges(sessions.where(F.col("session_key").cast("long") % 2 == r)).withColumnRenamed("weight", n) for r, n in ((0, "lo"), (1, "hi")))
    return lo.join(hi, ["code_a", "code_b"]).withColumn("difference", F.col("lo") - F.col("hi"))


# --- user signals: the lines of a document are a user's messages ---


def _sql_any(patterns) -> str:
    """Alternatives for an engine whose word edges are ASCII only: edges as consumed characters."""
    out = []
    for p in patterns:
        p = "(?:^|[^\\pL\\pN_])" + p[2:] if p.startswith("\\b") else p
        out.append("(?:" + p.replace("\\b", "(?:$|[^\\pL\\pN_])") + ")")
    return "|".join(out).replace("'", "''")


_STRIP = "regexp_replace(regexp_replace(regexp_replace({x}, '<system-reminder>.*?</system-reminder>', '', 'gs'), '<command-name>.*?</command-name>', '', 'gs'), '\\[Request interrupted\\]', '', 'g')"
SIGNALS = f"""l0 as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as msg_idx from documents where text is not null),
l1 as (select doc_id, msg_idx, regexp_replace({_STRIP.format(x="text")}, '^\\s+|\\s+$', '', 'g') as clean from l0 where trim(text) <> ''),
l2 as (select *, lower(clean) as low, regexp_replace(clean, '\\s', '', 'g') as dense, length(regexp_replace(clean, '\\P{{L}}', '', 'g')) as letters, length(regexp_replace(clean, '\\P{{Lu}}', '', 'g')) as upper_ from l1),
sg as (select doc_id::varchar as session_key, msg_idx,
  case when clean = '' then 'boilerplate' when dense <> '' and length(regexp_replace(dense, '[^A-Za-z]', '', 'g')) < 0.85 * length(dense) then 'other_language' else 'classified' end as state,
  {", ".join(f"regexp_matches(low, '{_sql_any(p)}') as {c}" for c, p in P.SIGNALS.items())},
  least(5, {" + ".join(f"{n} * regexp_matches(low, '{_sql_any(p)}')::int" for n, p in P.FRUSTRATION)} + (length(clean) > 20 and letters > 0 and 2 * upper_ >= letters)::int) as score from l2),
ok as (select * from sg where state = 'classified')"""


def _signals(spark, d) -> DataFrame:
    lines = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("session_key"), F.posexplode(F.split("text", "\n", -1)).alias("msg_idx", "text"))
    return behaviour.user_signals(lines.withColumn("role", F.lit("User")))


@query("user_signals", f"""with {SIGNALS}, c as ({" union all ".join(f"select '{c}' as category, count(*) filter (where {c}) as n, count(*) as total from ok" for c in P.SIGNALS)} union all select 'unclassified', count(*) filter (where not ({" or ".join(P.SIGNALS)})), count(*) from ok)
select category, n as "count", round(case when total > 0 then n / total else 0 end, 6) as pct_of_classified from c""")
def _(spark, d):
    return behaviour.signal_counts(_signals(spark, d))


@query("frustration_hist", f'with {SIGNALS} select i::bigint as intensity, (select count(*) from ok where score = i) as "count" from range(6) t(i)')
def _(spark, d):
    return behaviour.frustration_histogram(_signals(spark, d))


@query("escalations", f"""with {SIGNALS}, f as (select *, coalesce((score < lag(score) over w)::int, 0) as fall from ok window w as (partition by session_key order by msg_idx)),
r as (select *, sum(fall) over (partition by session_key order by msg_idx) as run from f)
select session_key as session_id, min(msg_idx) as start_index, count(*) as length, max(score)::bigint as peak_intensity from r group by session_key, run having count(*) >= 2 and max(score) >= 2""")
def _(spark, d):
    return behaviour.escalations(_signals(spark, d))


_HITS = {c: " + ".join(f"regexp_matches(low, '{_sql_any([p])}')::int" for p in ps) for c, ps in P.SIGNALS.items()}
SCORED = f"""s0 as (select conv_id::varchar as session_key, turn as msg_idx, lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as low from conversations where role = 'user'),
s1 as (select *, {", ".join(f"{_HITS[c]} as h_{c}" for c in ("correction", "approval", "question", "directive"))} from s0),
s2 as (select session_key, msg_idx, case when h_correction > 0 then least(0.95::double, 0.6 + 0.15 * (h_correction - 1)) * case when length(low) > 300 then greatest(0.5::double, 1 - (length(low) - 300) / 1400) else 1 end else 0 end as correction,
  case when h_approval > 0 then 0.85 else 0 end as approval, case when h_question >= 2 then 0.8 when h_question = 1 and regexp_matches(low, '\\?$') then 0.7 when h_question = 1 then 0.5 else 0 end as question, case when h_directive > 0 then 0.7 else 0 end as directive from s1)"""


@query("scored_messages", f"""with {SCORED} select session_key, msg_idx, round(correction, 6) as correction, approval::double as approval, question::double as question, directive::double as directive,
case greatest(correction, approval, question, directive) when 0 then 'none' when correction then 'correction' when approval then 'approval' when question then 'question' else 'directive' end as best from s2""")
def _(spark, d):
    return behaviour.scored_messages(conversations(spark, d).messages)


@query("merged_turns", f"""with {C}, r0 as (select *, (lag(role) over w is distinct from role)::int as new, lead(classification) over w as nx from m where role in ('User', 'Assistant') window w as (partition by session_key order by msg_idx)),
r1 as (select *, sum(new) over (partition by session_key order by msg_idx) as run from r0)
select session_key, min(msg_idx) as first_idx, sum(length(text))::bigint as text_len, coalesce(arg_max(nx, msg_idx) = 'HumanCorrection', false) as corrected from r1 where role = 'Assistant' group by session_key, run""")
def _(spark, d):
    return behaviour.merged_turns(conversations(spark, d).messages).select("session_key", "first_idx", "text_len", "corrected")


# --- timeline ---

DATED = "dt as (select user_id::varchar as session_key, 'p' || (user_id % 7) as project, strftime(arg_min(ts, (ts, event_id)), '%Y-%m-%d') as date from events group by user_id)"


@query("timeline_daily", f"with {DATED} select date, project, count(*) as session_count from dt group by date, project")
def _(spark, d):
    return trends.timeline_cube(trends.dated_sessions(events(spark, d))).where("level = 0").select("date", "project", "session_count")


@query("timeline_daily_totals", f"with {DATED} select date, count(*) as session_count, count(distinct project) as distinct_projects from dt group by date")
def _(spark, d):
    return trends.timeline_cube(trends.dated_sessions(events(spark, d))).where("level = 1").select("date", "session_count", F.col("cells").alias("distinct_projects"))


@query("timeline_projects", f"with {DATED} select project, count(*) as session_count, min(date) as first_seen, max(date) as last_seen from dt group by project")
def _(spark, d):
    return trends.dated_sessions(events(spark, d)).groupBy("project").agg(F.count("*").alias("session_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))


@query("timeline_grouping_sets", f"with {DATED} select date, project, grouping(date) * 2 + grouping(project) as level, count(*) as session_count from dt group by grouping sets ((date, project), (date), (project))")
def _(spark, d):
    return trends.timeline_cube(trends.dated_sessions(events(spark, d))).select("date", "project", "level", "session_count")


# --- conventions ---

CONV = f"""{PAIRS}, sp as (select distinct session_key, f || '->' || t as bigram from b), ns as (select count(distinct session_key) as n from e),
rk as (select user_id::varchar as session_key, 'p' || (user_id % 7) as project, arg_min(ts, (ts, event_id)) as ts from events group by user_id),
cn as (select bigram, count(*) as n_sessions from sp group by bigram having count(*) >= greatest(5, ceil(0.1 * (select n from ns))))"""


@query("convention_candidates", f"with {CONV} select bigram, n_sessions from cn")
def _(spark, d):
    f = events(spark, d)
    return trends.convention_candidates(trends.session_pairs(f.tool_calls), f.sessions.count())


@query("convention_adoption", f"""with {CONV}, o as (select session_key, row_number() over (order by ts, session_key) as rank from rk)
select bigram, rank, row_number() over (partition by bigram order by rank) as adopters from sp join o using (session_key)""")
def _(spark, d):
    f = events(spark, d)
    ranked = trends.ranked_sessions(trends.dated_sessions(f))
    return trends.adoption_curves(trends.session_pairs(f.tool_calls), ranked)


@query("convention_reach", f"""with {CONV}, fs as (select bigram, project, min(ts) as first_seen from sp join rk using (session_key) group by bigram, project),
og as (select *, first_value(project) over w as origin, first_value(first_seen) over w as start from fs window w as (partition by bigram order by first_seen, project))
select bigram, origin, count(*) as n_projects, round(median(case when project <> origin then (epoch_us(first_seen) - epoch_us(start)) / 86400e6 end), 6) as median_latency_days, round(count(*) / 7, 6) as reach from og group by bigram, origin""")
def _(spark, d):
    f = events(spark, d)
    return trends.propagation(trends.session_pairs(f.tool_calls), trends.dated_sessions(f), 7)


# --- excitation and friends ---


def _hawkes_sql(width: int) -> str:
    return f"""select trigger, response, {width}::bigint as "window", triggers, n, n / triggers / (base_n / al) as excitation from (
      select s.*, t.triggers, sum(s.n) over (partition by response) as base_n, (select sum(triggers) from t{width}) as al from s{width} s join t{width} t using (trigger)) where triggers > 5"""


HAWKES = E + "".join(
    f""",
n{w} as (select a.tool as trigger, b.tool as response, a.session_key, a.pos from e a join e b on a.session_key = b.session_key and b.pos between a.pos + 1 and a.pos + {w}
  where a.pos + {w} <= (select count(*) from e c where c.session_key = a.session_key)),
s{w} as (select trigger, response, count(*) as n from n{w} group by trigger, response), t{w} as (select trigger, count(distinct (session_key, pos)) as triggers from n{w} group by trigger)"""
    for w in (3, 5, 10)
)


@query("hawkes_excitation", f"with {HAWKES}, al as ({' union all '.join(_hawkes_sql(w) for w in (3, 5, 10))}) select trigger, response, \"window\", triggers, n, round(excitation, 6) as excitation from al")
def _(spark, d):
    return process.excitation(_log(spark, d))


@query("hawkes_decay", f"""with {E}, h as (select a.session_key, a.pos, k as lag, (b.tool = 'error')::int as later from e a, (select unnest(range(1, 21)) as k) join e b on b.session_key = a.session_key and b.pos = a.pos + k where a.tool = 'error')
select lag, count(*) as n, round(avg(later), 6) as rate, round((select avg((tool = 'error')::int) from e), 6) as baseline from h group by lag""")
def _(spark, d):
    return process.decay(_log(spark, d), "error")


@query("correction_cascades", f"""with {E}, c as (select session_key, pos, (coalesce(pos - lag(pos) over (partition by session_key order by pos), 4) > 3)::int as new from e where tool = 'error'), g as (select *, sum(new) over (partition by session_key order by pos) as chain from c)
select session_key, chain::bigint as chain, count(*) as length, min(pos) as first_pos, max(pos) as last_pos from g group by session_key, chain having count(*) >= 2""")
def _(spark, d):
    return process.cascades(_log(spark, d), "error", 3)


@query("lifetime_deciles", f"with {E}, x as (select tool as symbol, (pos - 1) * 10 // count(*) over (partition by session_key) as decile from e) select decile, symbol, count(*) as n from x group by decile, symbol")
def _(spark, d):
    return process.lifetime_deciles(_log(spark, d))


BETA = f"""{E}, c as (select 'p' || (user_id % 7) as g, tool, count(*) as n from e group by 1, 2), pr as (select g, tool, n / sum(n) over (partition by g) as p from c), sz as (select g, count(*) as s from c group by g),
cm as (select a.g as a, b.g as b, count(*) as both_, sum(least(a.p, b.p)) as overlap from pr a join pr b on a.tool = b.tool and a.g < b.g group by 1, 2)"""


@query("beta_diversity", f"""with {BETA} select x.g as a, y.g as b, round(1 - coalesce(both_, 0) / (x.s + y.s - coalesce(both_, 0)), 6) as jaccard, round(1 - coalesce(overlap, 0), 6) as bray_curtis
from sz x join sz y on x.g < y.g left join cm on cm.a = x.g and cm.b = y.g""")
def _(spark, d):
    rows = read(spark, d, "events").groupBy(F.concat(F.lit("p"), F.col("user_id") % 7).alias("group"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    return process.beta_diversity(rows)


@query("next_event_asof", f"""with {E} select a.session_key, a.pos, round((epoch_us((select min(b.ts) from e b where b.session_key = a.session_key and b.tool = 'purchase' and b.pos > a.pos)) - epoch_us(a.ts)) / 1e6, 6) as wait_s from e a where a.tool = 'view'""")
def _(spark, d):
    f = events(spark, d)
    log = f.tool_calls.join(f.messages.select("session_key", "msg_idx", "ts"), ["session_key", "msg_idx"]).select("session_key", "pos", F.col("name").alias("symbol"), "ts")
    return process.next_after(log, "view", "purchase")


@query("critical_interval", f"""with {E}, w as (select (epoch_us((select min(b.ts) from e b where b.session_key = a.session_key and b.tool = 'purchase' and b.pos > a.pos)) - epoch_us(a.ts)) / 1e6 as wait_s from e a where a.tool = 'view')
select count(wait_s) as n, round(quantile_cont(wait_s, 0.25), 6) as d1, round(quantile_cont(wait_s, 0.75), 6) as d2 from w""")
def _(spark, d):
    f = events(spark, d)
    log = f.tool_calls.join(f.messages.select("session_key", "msg_idx", "ts"), ["session_key", "msg_idx"]).select("session_key", "pos", F.col("name").alias("symbol"), "ts")
    return process.critical_interval(process.next_after(log, "view", "purchase"))


@query("message_class_of_documents", f"""with d0 as (select doc_id, text, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as t from documents)
select doc_id, case when strlen(t) < 1000 and regexp_matches(lower(t), '{_sql_phrases(P.CORRECTIONS)}') then 'HumanCorrection' when strlen(t) < 1000 and regexp_matches(lower(t), '{_sql_phrases(P.APPROVALS)}') then 'HumanApproval'
  when strlen(t) < 1000 and (contains(t, '?') or regexp_matches(lower(t), '{P.starts(P.QUESTION_STARTS)}')) then 'HumanQuestion' else 'HumanDirective' end as classification from d0
  where not ({" or ".join(f"contains(coalesce(text, ''), '{x}')" for x in P.SYSTEM_TAGS)})""")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("User").alias("role"), F.lit(False).alias("has_tool_result"))
    return docs.select("doc_id", message_class(F.lit(True)).alias("classification")).where("classification <> 'SystemMessage'")


for _name, (_f, _sql) in (corpus.QUERIES | log_catalog.QUERIES).items():
    query(_name, _sql)(_f)


@query("strata", f"""with {C}, st as (select session_key, case when bool_or(role = 'User' and starts_with(classification, 'Human')) then 'Interactive' when bool_or(role = 'User') then 'Autonomous' else 'Unknown' end as session_type, count(*) as n from m group by session_key),
k as (select unnest(['Interactive', 'Subagent', 'Autonomous']) as session_type)
select 'conversations' as origin, k.session_type, count(session_key) as sessions, coalesce(sum(n), 0)::bigint as messages, 0::bigint as tool_calls from k left join st using (session_type) group by k.session_type
union all select 'events', session_type, case when session_type = 'Autonomous' then (select count(distinct user_id) from events) else 0 end, case when session_type = 'Autonomous' then (select count(*) from events) else 0 end,
case when session_type = 'Autonomous' then (select count(*) from events) else 0 end from k""")
def _(spark, d):
    return log_catalog.strata(spark, d)


# --- project identity, conformance, success, maturity, exact tests ---

_FORMS = ("/home/ann/work/{}/src", "/Users/bob/{}/lib/tests", "/srv/team/{}", "/srv/team/{}/SRC/bin/", "/{}", "/home/eve", "", "/src/tests", "/data//{}//docs")
_CANONICAL = ("'work/' || t", "t", "'team/' || t", "'team/' || t", "t", "''", "null", "''", "'data/' || t")


@query("project_ids", f"""with x as (select event_id, event_id % {len(_FORMS)} as f, event_type || user_id % 5 as t from events),
c as (select event_id, case f {" ".join(f"when {i} then {c}" for i, c in enumerate(_CANONICAL))} end as canonical from x)
select event_id, case when canonical = '' then 'project_root' else 'project_' || sha1(canonical)[1:8] end as project from c""")
def _(spark, d):
    """Working folders made of event types, in several places of a file system."""
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("event_id") % len(_FORMS) + 1).cast("int"))
    cwd = F.replace(form, F.lit("{}"), F.concat("event_type", (F.col("user_id") % 5).cast("string")))
    return read(spark, d, "events").select("event_id", extras.project_id(cwd).alias("project"))


IDEAL = ("view", "click", "view", "purchase", "signup")


def _ideal_sql() -> str:
    steps = ["i1 as (select session_key, min(pos) as p from e where tool = 'view' group by session_key)"]
    steps += [f"i{k} as (select e.session_key, min(pos) as p from e join i{k - 1} b on e.session_key = b.session_key and e.pos > b.p where tool = '{x}' group by e.session_key)" for k, x in enumerate(IDEAL[1:], 2)]
    rows = " union all ".join(f"select {k}::bigint as length, count(*) as sessions, round(count(*) / (select count(distinct session_key) from e), 6) as share from i{k}" for k in range(1, len(IDEAL) + 1))
    return f"with {E}, {', '.join(steps)} {rows}"


@query("ideal_conformance", _ideal_sql())
def _(spark, d):
    return extras.ideal_conformance(_log(spark, d), list(IDEAL))


SUCCESS = f"""{C}, us as (select session_key, count(*) as n, count(*) filter (where classification = 'HumanCorrection') as corrections,
  coalesce(arg_max(classification, msg_idx) filter (where classification in ('HumanCorrection', 'HumanApproval')), '') as last from m where role = 'User' group by session_key),
cm as (select session_key, count(*) filter (where msg_idx % 3 = 0) as commits from m where role = 'Assistant' group by session_key),
sc as (select session_key, corrections, case last when 'HumanApproval' then 'positive' when 'HumanCorrection' then 'correction' else 'neutral' end as final, coalesce(commits, 0) as commits,
  case last when 'HumanApproval' then 2 when 'HumanCorrection' then -2 else 0 end - 3 * corrections / n + (coalesce(commits, 0) > 0)::int as score from us left join cm using (session_key))"""


def _scores(spark, d) -> DataFrame:
    """Every third turn of an agent stands for a commit."""
    messages = conversations(spark, d).messages
    commands = messages.where("role = 'Assistant'").select("session_key", F.when(F.col("msg_idx") % 3 == 0, "git commit -m x").otherwise("ls").alias("command"))
    return extras.success_scores(messages, commands)


@query("success_scores", f"with {SUCCESS} select session_key, corrections, final, commits, round(score, 6) as score from sc")
def _(spark, d):
    return _scores(spark, d)


@query("pattern_success", f"""with {SUCCESS}, pt as (select distinct session_key, classification as pattern from m where role = 'User'),
q as (select quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.75) as q3 from sc), r as (select session_key, score, (score <= q1)::int as low, (score >= q3)::int as high from sc, q),
o as (select pattern, count(*) as n, sum(score) as s, sum(low) as l, sum(high) as h from pt join r using (session_key) group by pattern), a as (select count(*) as n, sum(score) as s, sum(low) as l, sum(high) as h from r)
select pattern, round(o.s / o.n, 6) as present, round(case when a.n > o.n then (a.s - o.s) / (a.n - o.n) end, 6) as absent, round(o.s / o.n - case when a.n > o.n then (a.s - o.s) / (a.n - o.n) end, 6) as delta,
round(o.l / a.l, 6) as low_quarter, round(o.h / a.h, 6) as high_quarter from o, a""")
def _(spark, d):
    messages = conversations(spark, d).messages
    patterns = messages.where("role = 'User'").select("session_key", F.col("classification").alias("pattern")).distinct()
    return extras.pattern_success(patterns, _scores(spark, d))


AGES = f"""{TIMES}, fs as (select user_id, arg_min(ts, (ts, event_id)) as ts from events group by user_id), ag as (select user_id, (epoch_us(ts) - epoch_us(min(ts) over (partition by user_id % 7))) / 86400e6 as age from fs),
gm as (select case when age > (select median(age) from ag) then 'mature' else 'early' end as grp, duration, event from tm join ag using (user_id))"""


@query("maturity_logrank", f"""with {AGES}, ev as (select duration, d as dd, at_risk as nn from rt where d > 0),
ex as (select g.grp, sum((select count(*) from gm where gm.grp = g.grp and gm.duration >= ev.duration) * dd / nn) as expected from (select distinct grp from gm) g, ev group by g.grp)
select grp, (select count(*) from gm where gm.grp = ex.grp and event) as observed, round(expected, 6) as expected, round(((select count(*) from gm where gm.grp = ex.grp and event) - expected) ** 2 / expected, 6) as chi2 from ex""")
def _(spark, d):
    return trends.log_rank(extras.maturity_groups(_times(spark, d), trends.dated_sessions(events(spark, d))), "grp")


@query("hazard_shape", f"""with {TIMES}, hz as (select duration, d / at_risk as step, row_number() over (order by duration) - 1 as i from rt),
sm as (select a.i, sum(0.75 * (1 - ((a.duration - b.duration) / 3.0) ** 2) / 3.0 * b.step) as h from hz a join hz b on abs(a.duration - b.duration) <= 3 group by a.i),
th as (select avg(h) filter (where i < floor((select count(*) from sm) / 3)) as early, avg(h) filter (where i >= floor(2 * (select count(*) from sm) / 3)) as late from sm)
select round(early, 6) as early, round(late, 6) as late, round(case when early > 0 then late / early else 1 end, 6) as ratio,
case when early > 0 and late / early > 1.3 then 'increasing' when early > 0 and late / early < 0.7 then 'decreasing' else 'flat' end as trend from th""")
def _(spark, d):
    return extras.hazard_shape(_times(spark, d))


@query("three_sigma", f"""with {SPC_MAX}, s as (select avg(value) as m, stddev_samp(value) as sd from p) select i, session_id, round((value - m) / sd, 6) as z from p, s where sd > 0 and abs(value - m) > 3 * sd""")
def _(spark, d):
    return extras.three_sigma(_points(spark, d, F.max("value")))


@query("spc_cusum_sample", f"""with {SPC}, sd as (select avg(value) as m, stddev_samp(value) as s from p), u as (select i, s, sum(value - m - s / 2) over (order by i) as up, sum(m - s / 2 - value) over (order by i) as dn from p, sd),
t as (select i, s, up - least(0, min(up) over (order by i)) as s_hi, dn - least(0, min(dn) over (order by i)) as s_lo from u)
select i, round(s_hi, 6) as s_hi, round(s_lo, 6) as s_lo, s > 0 and greatest(s_hi, s_lo) > 5 * s as alarm from t""")
def _(spark, d):
    return trends.cusum(_points(spark, d), sample=True, alarm=5.0)


@query("dominance", """with c as (select 'p' || (user_id % 7) as "group", event_type as symbol, count(*) as n from events group by 1, 2)
select "group", arg_min(symbol, (-n, symbol)) as dominant, round(max(n) / sum(n), 6) as dominance from c group by 1""")
def _(spark, d):
    rows = read(spark, d, "events").groupBy(F.concat(F.lit("p"), F.col("user_id") % 7).alias("group"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    return extras.dominance(rows)


@query("diet_breadth", f"""with {E}, c as (select session_key, tool, count(*) as n from e where tool <> 'signup' group by session_key, tool), a as (select session_key, count(*) as types, sum(n) as al, sum(n * ln(n)) as nl, sum(n * n) as nn, max(n) as top from c group by session_key)
select session_key, types, round(case when types > 1 then ln(al) - nl / al else 0 end, 6) as shannon, round(1 - nn / (al * al)::double, 6) as simpson, round(top / al, 6) as dominance from a""")
def _(spark, d):
    """An event type is a prey; ``signup`` is none."""
    return extras.diet_breadth(events(spark, d).tool_calls.select("session_key", F.when(F.col("name") != "signup", F.col("name")).alias("prey")))


@query("switching_costs", f"""with {E}, x as (select session_key, pos, case when tool not in ('view', 'click') then tool end as patch from e),
y as (select session_key, patch, pos - lag(pos) over w - 1 as gap, lag(patch) over w is not distinct from patch as same from x where patch is not null window w as (partition by session_key order by pos))
select session_key, count(*) as switches, round(avg(gap), 6) as mean_cost from y where gap is not null and (not same or gap > 0) group by session_key""")
def _(spark, d):
    """Views and clicks lie between the patches."""
    return extras.switching_costs(events(spark, d).tool_calls.select("session_key", F.col("pos").alias("turn"), F.when(~F.col("name").isin("view", "click"), F.col("name")).alias("patch")))


@query("anomaly_overlap", f"""with {WINDOWS}, s0 as (select session_key, start - 1 as idx, entropy, avg(entropy) over o as mean, stddev_pop(entropy) over o as sd, count(*) over o as n from w window o as (partition by session_key)),
od as (select session_key, idx from s0 where n >= 5 and sd >= 1e-10 and abs(entropy - mean) > 2 * sd), mk as (select session_key, greatest(0, pos - 11) as mid from e where tool = 'error'),
hit as (select session_key, idx, exists (select 1 from mk where mk.session_key = od.session_key and abs(mk.mid - od.idx) <= 2) as near from od)
select session_key, count(*) as anomalies, count(*) filter (where near) as near, round(count(*) filter (where near) / count(*), 6) as share from hit group by session_key""")
def _(spark, d):
    calls = events(spark, d).tool_calls
    return extras.anomaly_overlap(sequence.entropy_windows(calls), calls.where("name = 'error'").select("session_key", "pos"))


@query("kmer_fisher", f"""with {KMERS}, ks as (select distinct session_key, kmer from km), f as (select motif, st.user_id % 2 = 1 as high, ks.kmer is not null as has from cv cross join st left join ks on ks.session_key = st.session_key and ks.kmer = cv.motif),
t as (select motif, count(*) filter (where high and has) as a, count(*) filter (where high and not has) as b, count(*) filter (where not high and has) as c, count(*) filter (where not high and not has) as d from f group by motif),
p as (select motif, a, b, c, d, unnest(range(a, least(a + c, a + b) + 1)) as i from t),
l as (select motif, a, b, c, d, exp(lgamma(a + c + 1) - lgamma(i + 1) - lgamma(a + c - i + 1) + lgamma(b + d + 1) - lgamma(a + b - i + 1) - lgamma(b + d - (a + b - i) + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1)) as x from p)
select motif, a, b, c, d, round(least(1, sum(x)), 6) as p from l group by motif, a, b, c, d""")
def _(spark, d):
    strings = process.symbol_strings(_log(spark, d), SYMBOLS)
    return extras.fisher_enrichment(process.kmer_presence(strings, strings.select("session_key", (F.col("session_key").cast("long") % 2 == 1).alias("high"))))


def _dated_references(spark, d) -> DataFrame:
    """Mentions in documents, dated by their ids."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 365).cast("int"))
    docs = corpus._docs(spark, d).where("text is not null").select(F.element_at(F.array(*map(F.lit, corpus.PROJECTS)), (F.col("doc_id") % len(corpus.PROJECTS) + 1).cast("int")).alias("src"), "text", day.cast("timestamp").alias("ts"))
    names = spark.createDataFrame([(p,) for p in corpus.PROJECTS], "project string")
    return corpus.mentions(docs, names, ("src", "ts"))


_DATED_REFS = f"""dd as (select {corpus._NAMES}[doc_id % {len(corpus.PROJECTS)} + 1] as src, lower(text) as text, date '2024-01-01' + (doc_id % 365)::int as day from documents where text is not null),
rf as (select src, n as dst, day, len(regexp_extract_all(regexp_replace(text, '([\\pL\\pN_]+)', ' \\1 ', 'g'), ' ' || n || ' ')) as c from dd, unnest({corpus._NAMES}) t(n) where n <> src)"""


@query("monthly_references", f"""with {_DATED_REFS} select strftime(day, '%Y-%m') as month, sum(c)::bigint as "references", count(distinct dst) as projects from rf where c > 0 group by 1""")
def _(spark, d):
    return extras.monthly_references(_dated_references(spark, d))


@query("first_seen", f"""with {_DATED_REFS}, a as (select src as project, min(day) as x from dd group by 1), b as (select dst as project, min(day) as y from rf where c > 0 group by 1)
select project, strftime(x, '%Y-%m-%d') as first_active, strftime(y, '%Y-%m-%d') as first_referenced from a full join b using (project)""")
def _(spark, d):
    refs = _dated_references(spark, d)
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 365).cast("int")).cast("timestamp")
    sessions = corpus._docs(spark, d).where("text is not null").select(F.element_at(F.array(*map(F.lit, corpus.PROJECTS)), (F.col("doc_id") % len(corpus.PROJECTS) + 1).cast("int")).alias("project"), day.alias("ts"))
    return extras.first_seen(sessions, refs).select("project", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_active", "first_referenced")))


# --- public metrics, warnings, clusters ---

_VALUES = ("12", "-0.5e3", "true", '"plain_word"', '"two words"', "null", '{"a":1}', '"' + "x" * 41 + '"')


@query("public_metrics", """with a as (select unnest(range(0, 12)) as k), f as (select event_id as k, ['12', '-0.5e3', 'true', '"plain_word"', '"two words"', 'null', '{"a":1}', '"' || repeat('x', 41) || '"'][event_id % 8 + 1] as value_json from events where event_id < 10)
select 't' || k % 3 as technique, 'l' || k as label, case when k < 10 and k % 8 in (0, 1, 2, 3) then value_json end as value_json,
case when value_json is null or value_json = 'null' then 'undefined' when k % 8 in (0, 1, 2, 3) then 'defined' else 'redacted' end as status from a left join f using (k)""")
def _(spark, d):
    """Findings made of the first ten events; twelve are allowed."""
    e = read(spark, d, "events").where("event_id < 10")
    value = F.element_at(F.array(*map(F.lit, _VALUES)), (F.col("event_id") % len(_VALUES) + 1).cast("int"))
    name = lambda k: (F.concat(F.lit("t"), k % 3).alias("technique"), F.concat(F.lit("l"), k).alias("label"))
    return corpus.public_metrics(e.select(*name(F.col("event_id")), value.alias("value_json")), spark.range(12).select(*name(F.col("id"))))


@query("warnings", """with s as (select source, count(*) as sessions, count(*) filter (where n_chars > 9000) as autonomous, count(*) filter (where text is null) as parse_errors from documents group by source)
select source, sessions, autonomous, parse_errors, array_to_string(list_filter([case when sessions < 30 then 'tiny_n' end, case when autonomous = 0 then 'no_autonomous_sessions' end, case when autonomous > 0 and autonomous < 10 then 'few_autonomous_sessions' end, case when parse_errors > 0 then 'parse_errors' end], lambda x: x is not null), ',') as warnings from s""")
def _(spark, d):
    """Sources are strata, long documents autonomous sessions, null texts parse errors."""
    by = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("sessions"), F.count_if(F.col("n_chars") > 9000).alias("autonomous"), F.count_if(F.col("text").isNull()).alias("parse_errors"))
    return corpus.warnings_of(by).withColumn("warnings", F.array_join("warnings", ","))


@query("similarity_clusters", "select node, g as component from (select c_custkey + 1000 as node, c_nationkey::bigint as g from customer union all select distinct c_nationkey::bigint, c_nationkey::bigint from customer)")
def _(spark, d):
    """Customers are near their nation."""
    c = read(spark, d, "customer")
    return corpus.similarity_clusters(c.select(F.col("c_nationkey").cast("bigint").alias("a"), (F.col("c_custkey") + 1000).cast("bigint").alias("b"), F.lit(0.9).alias("cosine")))


@query("status_counts", """with o as (select source as corpus, lang as metric, case when source = 'web' or avg(n_chars) is null then 'missing' else 'defined' end as status, avg(n_chars) - 500 as value from documents group by source, lang)
select metric, count(*) filter (where status = 'defined') as defined, count(*) filter (where status <> 'defined') as undefined, round(min(value) filter (where status = 'defined'), 6) as min, round(max(value) filter (where status = 'defined'), 6) as max,
round(avg(value) filter (where status = 'defined'), 6) as mean, round(max(value) filter (where status = 'defined') - min(value) filter (where status = 'defined'), 6) as range,
round(max(value) filter (where status = 'defined' and value > 0) / min(value) filter (where status = 'defined' and value > 0), 6) as ratio from o group by metric""")
def _(spark, d):
    by = read(spark, d, "documents").groupBy(F.col("source").alias("corpus"), F.col("lang").alias("metric")).agg(F.avg("n_chars").alias("v"))
    status = F.when((F.col("corpus") == "web") | F.col("v").isNull(), "missing").otherwise("defined")
    return extras.status_counts(by.select("corpus", "metric", status.alias("status"), (F.col("v") - 500).alias("value")))


# --- iterative estimators ---

AGENT_NAMES = {"view": "Read", "click": "Grep", "purchase": "Edit", "signup": "Bash", "error": "Skill"}


def _agents(spark, d) -> Frames:
    """Surrogate: event types under the names of agent tools."""
    frames = events(spark, d)
    calls = frames.tool_calls.withColumn("name", F.create_map(*(F.lit(x) for pair in AGENT_NAMES.items() for x in pair))[F.col("name")])
    return Frames(frames.sessions, frames.messages, calls, frames.tool_results)


_CATS = {"read": "('view', 'click')", "edit": "('purchase')", "bash": "('signup')", "skill": "('error')"}


@query("granger_features", f"""with {E}, r as (select session_key, pos, tool, count(*) over (partition by session_key) as n, {", ".join(f"count(*) filter (where tool in {v}) over w as {k}" for k, v in _CATS.items())}, count(*) over w as al from e window w as (partition by session_key order by pos rows between 4 preceding and current row))
select session_key, pos as turn, round({" + ".join(f"case when {k} > 0 then -({k} / al) * log2({k} / al) else 0 end" for k in _CATS)}, 6) as tool_diversity, (tool = 'error')::int::double as tool_failure from r where n >= 10""")
def _(spark, d):
    return numeric.granger_features(_agents(spark, d), 10).select("session_key", "turn", "tool_diversity", "tool_failure")


@query("granger_pairs")
def _(spark, d):
    return numeric.fisher_combined(numeric.granger_pairs(numeric.granger_features(_agents(spark, d), 10), ("tool_diversity", "tool_failure")))


@query("fisher_combine", """with p as (select event_type as cause, 'u' || (user_id % 150) as effect, ((value * 100)::bigint % 1000 + 0.5) / 1000 as p from events),
s as (select cause, effect, count(*) as k, -sum(ln(p)) as h from p group by cause, effect),
f as (select cause, effect, k, least(1, list_sum(list_transform(range(k), lambda i: exp(i * ln(h) - lgamma(i + 1) - h)))) as t from s)
select cause, effect, k as sessions, round(least(1, t * count(*) over ()), 6) as p_corrected from f""")
def _(spark, d):
    """Surrogate p values from the events' values."""
    e = read(spark, d, "events")
    p = (F.rint(F.col("value") * 100).cast("bigint") % 1000 + 0.5) / 1000  # ties to even, as the SQL's cast
    return numeric.fisher_combined(e.select(F.col("event_type").alias("cause"), F.concat(F.lit("u"), F.col("user_id") % 150).alias("effect"), p.alias("p")))


@query("hmm_states")
def _(spark, d):
    features = numeric.turn_features(_agents(spark, d))
    return numeric.hidden_states(features, numeric.fitted_hmm(features)).groupBy("state").agg(F.count("*").alias("turns"))


def _strings(spark, d) -> DataFrame:
    return process.symbol_strings(_log(spark, d), SYMBOLS)


@query("sw_scores")
def _(spark, d):
    return numeric.pair_scores(_strings(spark, d), numeric.alignment_score, "score")


@query("ncd_pairs")
def _(spark, d):
    return numeric.pair_scores(_strings(spark, d), numeric.compression_distance, "ncd")


@query("changepoints")
def _(spark, d):
    e = read(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").cast("string").alias("session_key"), (F.row_number().over(w) - 1).alias("i"), F.col("value").alias("value"), (F.col("event_type") == "error").cast("double").alias("error"))
    return numeric.session_regimes(rows, ("value", "error"))


@query("sir_fits")
def _(spark, d):
    f = events(spark, d)
    ranked = trends.ranked_sessions(trends.dated_sessions(f))
    return numeric.adoption_fits(trends.adoption_curves(trends.session_pairs(f.tool_calls), ranked))


@query("tpattern_significance")
def _(spark, d):
    log = _log(spark, d).select(F.col("session_key").cast("bigint").alias("session_ord"), "session_key", "pos", "symbol")
    return numeric.tpatterns_of(log, spark).tables["T-Patterns Level 1"]


@query("cox_covariates")
def _(spark, d):
    f = events(spark, d)
    early = f.tool_calls.where("pos <= 3").groupBy("session_key").agg(F.count_if(F.col("name") == "view").cast("double").alias("views"), F.count_if(F.col("name") == "click").cast("double").alias("clicks"))
    rows = _times(spark, d).select("session_key", "duration", "event").join(early, "session_key").drop("session_key")
    return numeric.cox_regression(rows)[0]


SIMILAR = f"""{corpus._TFIDF}, g as (select doc_id, sha256(string_agg(term || ' ' || round(weight, 9), ' ' order by term)) as h from v group by doc_id),
cl as (select doc_id, min(doc_id) over (partition by h) as rep from g), u as (select v.doc_id, term, weight from v join cl on v.doc_id = cl.rep and cl.doc_id = cl.rep),
sm as (select x.doc_id as a, y.doc_id as b, sum(x.weight * y.weight) as cosine from u x join u y on x.term = y.term and x.doc_id < y.doc_id group by 1, 2 having sum(x.weight * y.weight) > 0.4)"""


@query("similar_documents", f"with {SIMILAR} select a, b, round(cosine, 6) as cosine from sm")
def _(spark, d):
    docs = read(spark, d, "documents").where("doc_id is not null").select("doc_id", "text")
    return corpus.similar_documents(docs)


@query("similarity_links", f"with {SIMILAR}, e as (select rep, count(*) as links from (select a as rep from sm union all select b from sm) group by rep) select doc_id, rep, coalesce(links, 0) as links from cl left join e using (rep)")
def _(spark, d):
    return corpus.similarity_links(read(spark, d, "documents").where("doc_id is not null").select("doc_id", "text"))


@query("topic_terms")
def _(spark, d):
    return numeric.topic_terms(read(spark, d, "documents")).drop("weight")


@query("fingerprint_pairs")
def _(spark, d):
    return numeric.pair_scores(_strings(spark, d), numeric.fingerprint_distance, "ncd")


@query("rolling_changepoints")
def _(spark, d):
    return numeric.session_regimes(numeric.rolling_features(_agents(spark, d)), ("tool_entropy",))


@query("rolling_tool_entropy", f"""with {E}, r as (select session_key, pos, {", ".join(f"count(*) filter (where tool in {v}) over w as {k}" for k, v in _CATS.items())}, count(*) over w as al from e window w as (partition by session_key order by pos rows between 9 preceding and current row))
select session_key, pos - 1 as i, round({" + ".join(f"case when {k} > 0 then -({k} / al) * log2({k} / al) else 0 end" for k in _CATS)}, 6) as tool_entropy from r""")
def _(spark, d):
    return numeric.rolling_features(_agents(spark, d)).select("session_key", "i", "tool_entropy")


def findings_table(findings: DataFrame) -> DataFrame:
    """``label, number, text`` of findings; a struct gives its number and its names."""
    v = F.col("value_json")
    part = lambda k: F.get_json_object(v, f"$.{k}")
    inside = v.startswith("{")
    number = F.when(inside, F.coalesce(part("probability"), part("B"))).otherwise(v).try_cast("double")
    names = F.coalesce(F.when(part("from").isNotNull(), F.concat_ws("->", part("from"), part("to"))), part("name"))
    text = F.when(inside, names).when(v.startswith('"'), F.substring(v, F.lit(2), F.length(v) - 2)).when(v.isin("true", "false"), v)
    return findings.select("label", number.alias("number"), text.alias("text"))


def _technique(name: str):
    technique = REGISTRY[name]
    on_text = "tool_calls" not in technique.needs

    def run(spark, d):
        return findings_table(technique.run((conversations if on_text else events)(spark, d)).findings)

    return run


def _pairs_sql(rows: dict[str, str], source: str) -> str:
    """Findings from one row: label by label."""
    return " union all ".join(f"select '{k}' as label, {v} as number, null::varchar as text from {source}" for k, v in rows.items())


def _words_sql(rows: dict[str, str], source: str) -> str:
    return " union all ".join(f"select '{k}' as label, null::double as number, {v} as text from {source}" for k, v in rows.items())


_N = lambda x: f"round(({x})::double, 6) + 0.0"
FINDINGS = {
    "markov": f"""with recursive {STATIONARY},
top as (select f, t, p, row_number() over (order by p desc, f, t) as k from q), en as (select tool, count(*) as n, row_number() over (order by count(*) desc, tool) as k from e where pos = 1 group by tool)
select 'total_bigrams' as label, coalesce(sum(n), 0)::double as number, null::varchar as text from c union all select 'top_transition_' || k, round(p, 6), f || '->' || t from top where k <= 5
union all select 'self_loop_' || f, round(p, 6), null from q where f = t union all select 'entry_tool_' || tool, n::double, null from en where k <= 5 union all select 'stationary_' || tool, round(x, 6), null from step where i = 60""",
    "entropy": f"""with {PER}, a as (select avg(mean_entropy) as m, coalesce(sum(low), 0) as lo, coalesce(sum(high), 0) as hi, count(*) as n from s)
{_pairs_sql({"mean_entropy": _N("m"), "anomaly_count": _N("lo + hi"), "low_entropy_anomalies": _N("lo"), "high_entropy_anomalies": _N("hi"), "sessions_analyzed": _N("n")}, "a")}
union all select 'low_high_ratio', null, case when hi > 0 then (lo / hi)::varchar when lo > 0 then 'Infinity' else '0.0' end from a""",
    "burstiness": f"""with {BURST}, a as (select sum(burstiness_b * n) / sum(n) as b, sum(memory_m * n) / sum(n) filter (where memory_m is not null) as m, count(*) as k from bt)
{_pairs_sql({"aggregate_burstiness": "round(b, 4)", "aggregate_memory": "round(m, 4)", "tools_analyzed": _N("k")}, "a")}
union all (select 'burstiest_tool', round(burstiness_b, 4), tool_name from bt order by burstiness_b desc, tool_name limit 1) union all (select 'most_periodic_tool', round(burstiness_b, 4), tool_name from bt order by burstiness_b, tool_name limit 1)""",
    "diversity": f"""with {DIV}, a as (select avg(shannon) as ms, median(shannon) as md, avg(simpson) as si, avg(evenness) as ev, count(*) filter (where evenness < 0.3) as mono, count(*) as n,
  case when count(*) < 2 or var_pop(ln(abundance)) < 1e-15 then 0 else regr_slope(ln(richness), ln(abundance)) end as z,
  case when count(*) < 2 or var_pop(ln(abundance)) < 1e-15 or var_pop(ln(richness)) < 1e-15 then 0 else regr_r2(ln(richness), ln(abundance)) end as r2 from dv)
{_pairs_sql({"mean_shannon": _N("ms"), "median_shannon": _N("md"), "mean_simpson": _N("si"), "mean_evenness": _N("ev"), "monoculture_count": _N("mono"), "monoculture_fraction": _N("mono / n"), "sessions_analyzed": _N("n"), "species_area_z": _N("z"), "species_area_r_squared": _N("r2")}, "a")}""",
    "correction-rate": f"""with {CORR}, r as (select *, case when user_messages > 0 then corrections / user_messages else 0 end as rate, case when n0 > 0 then c0 / n0 else 0 end as r0, case when n2 > 0 then c2 / n2 else 0 end as r2 from ss),
a as (select avg(rate) as m, median(rate) as md, count(*) filter (where corrections > 0) || '/' || count(*) as w, avg(case when r0 > 0 then r2 / r0 when r2 > 0 then null else 0 end) as dg, sum(c0) / nullif(sum(n0), 0) as t0, sum(c1) / nullif(sum(n1), 0) as t1, sum(c2) / nullif(sum(n2), 0) as t2 from r)
{_pairs_sql({"overall_mean_rate": _N("m"), "overall_median_rate": _N("md"), "mean_degradation_ratio": _N("dg"), "first_third_rate": _N("coalesce(t0, 0)"), "middle_third_rate": _N("coalesce(t1, 0)"), "last_third_rate": _N("coalesce(t2, 0)")}, "a")}
union all {_words_sql({"sessions_with_corrections": "w"}, "a")}""",
    "corpus-timeline": f"""with a as (select count(distinct conv_id) as n from conversations)
{_pairs_sql({"total_sessions": _N("n"), "undated_sessions": _N("n"), "total_dates": "0.0::double", "total_projects": "0.0::double", "high_concurrency_day_count": "0.0::double", "date_range_min": "null::double", "date_range_max": "null::double", "peak_day": "null::double"}, "a")}""",
    "process-mining": f"""with {PAIRS}, a as (select (select count(*) from e) as n, (select count(*) from b) as k)
{_pairs_sql({"total_events": _N("n"), "unique_activities": "1.0::double", "dfg_edges": "1.0::double", "top_correction_predecessor": "null::double"}, "a")} union all {_words_sql({"most_common_activity": "'other'", "top_rework_activity": "'other'"}, "a")}""",
    "thinking-divergence": f"""with a as (select count(distinct conv_id) as n from conversations)
{_pairs_sql({"sessions_analyzed": _N("n"), "analyzed_unknown_sessions": _N("n"), **dict.fromkeys(("suppression_rate", "divergence_ratio", "sessions_with_thinking", "messages_with_both", "total_risk_tokens", "suppressed_tokens", "skipped_redacted_sessions", "analyzed_visible_sessions"), "0.0::double")}, "a")}""",
    "echo": "select 'session_count' as label, count(distinct conv_id)::double as number, null::varchar as text from conversations",
    "user-signal-analysis": f"""with {SIGNALS.replace("select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as msg_idx from documents where text is not null", "select conv_id as doc_id, text, turn as msg_idx from conversations where role = 'user'")},
f as (select *, coalesce((score < lag(score) over w)::int, 0) as fall from ok window w as (partition by session_key order by msg_idx)), r as (select *, sum(fall) over (partition by session_key order by msg_idx) as run from f),
es as (select session_key from r group by session_key, run having count(*) >= 2 and max(score) >= 2),
a as (select count(*) as n, count(*) filter (where state = 'classified') as k, count(*) filter (where state = 'other_language') as o, count(*) filter (where state = 'boilerplate') as bp, {", ".join(f"count(*) filter (where state = 'classified' and {c}) as {c}_" for c in P.SIGNALS)}, (select count(*) from es) as esc,
  arg_min(session_key, (-score, session_key::bigint, msg_idx)) filter (where state = 'classified' and score > 0) as peak from sg)
{_pairs_sql({"total_user_messages": _N("n"), "messages_classified": _N("k"), "skipped_non_english_messages": _N("o"), "boilerplate_messages": _N("bp"), **{f"{c}s": _N(f"{c}_") for c in P.SIGNALS}, "escalations_found": _N("esc")}, "a")} union all {_words_sql({"peak_frustration_session_id": "peak"}, "a")}""",
}

for _name in REGISTRY:
    query("findings_" + _name.replace("-", "_"), FINDINGS.get(_name))(_technique(_name))
